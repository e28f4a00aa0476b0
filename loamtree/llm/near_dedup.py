"""Near duplicates by inverted lists of signature coordinates."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .store import drop_rows, mark, materialize, small_side
from .textbytes import chunks, gather, gram_hashes, lower_ascii, word_table

SHINGLE = 5
#: Links have intersection : union >= NUMERATOR : 100.
NUMERATOR = 75
#: Coordinates of a signature and how many must agree. At similarity 0.75 fewer than 20 of 48 agree with probability below 1e-6, above it still more rarely.
COORDINATES, MATCHES = 48, 20
#: Members of a list whose pairs are joined one by one, the members of a block of a list of shingles, and the bins of a sketch.
SHORT, BLOCK, BINS = 8, 2048, 1024

_rng = np.random.default_rng(48)
_XOR = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_MULTIPLY = _rng.integers(0, 2**62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray):
    """Per document the sorted distinct 64-bit hashes of its shingles: SHINGLE words, or all of them where there are fewer."""
    starts, _, before, words = word_table(lower_ascii(data), offsets)
    grams = gram_hashes(words, SHINGLE)
    size = np.diff(before)
    whole = np.zeros(len(size), np.uint64)
    for k in range(1, SHINGLE):
        at = np.flatnonzero(size == k)
        whole[at] = gram_hashes(gather(words, before[at], np.full(len(at), k)), k)[::k]
    for i, (lo, hi) in enumerate(zip(before[:-1].tolist(), before[1:].tolist())):
        if hi - lo < SHINGLE:
            yield whole[i : i + 1] if hi > lo else words[:0]
        else:
            yield np.unique(grams[lo : hi - SHINGLE + 1])


def signature(shingles: np.ndarray) -> np.ndarray:
    """For each coordinate the smallest value that its hash function gives to a shingle."""
    out = np.empty(COORDINATES, np.uint32)
    for lo in range(0, COORDINATES, 16):
        values = (shingles[None, :] ^ _XOR[lo : lo + 16, None]) * _MULTIPLY[lo : lo + 16, None]
        out[lo : lo + 16] = values.min(axis=1) >> np.uint64(32)
    return out


_EDGES = np.arange(1, BINS, dtype=np.uint64) * np.uint64(2**64 // BINS)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash of each of BINS equal ranges of hashes, as one byte; 0 where there is none."""
    at = np.concatenate(([0], np.searchsorted(shingles, _EDGES), [len(shingles)]))
    out = np.zeros(BINS, np.uint8)
    some = at[1:] > at[:-1]
    out[some] = 1 + (shingles[at[:-1][some]] & np.uint64(0xFFFF)) % np.uint64(255)
    return out


def sketches_allow(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of sketches whose sets, of together `sizes` shingles, may be linked, and the share of bins that each pair of rows has in common.

    Five standard deviations below the expectation at the threshold are allowed,
    of bins drawn from the union without putting back.
    """
    used, same = ((x | y) != 0).sum(axis=1), ((x == y) & (x != 0)).sum(axis=1)
    share = NUMERATOR / 100
    spread = np.sqrt(share * (1 - share) * used * np.maximum(1 - used * (1 + share) / sizes, 0))
    return np.flatnonzero(same >= share * used - 5 * spread - 1), same / np.maximum(used, 1)


def _signatures(batches):
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column("text")):
            sizes, digests, signatures = [], [], []
            for shingles in shingle_sets(data, offsets):
                sizes.append(len(shingles))
                digests.append(np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64))
                signatures.append(signature(shingles).view(np.int32) if len(shingles) else np.zeros(COORDINATES, np.int32))
            both = np.array(digests).reshape(-1, 2)
            flat = pa.array(np.concatenate([*signatures, np.zeros(0, np.int32)]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * COORDINATES, pa.int32()), flat)
            known = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "text_hash")]
            yield pa.RecordBatch.from_arrays([*known, pa.array(sizes, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), lists], ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "sig"])


def _set_rows(batches):
    """A row for each shingle of each set."""
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column("text")):
            sets = list(shingle_sets(data, offsets))
            sizes = np.array([len(x) for x in sets])
            at = pa.array(lo + np.repeat(np.arange(hi - lo), sizes))
            columns = [batch.column("rep").take(at), pa.array(np.repeat(sizes, sizes), pa.int64()), pa.array(np.concatenate(sets).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["rep", "size", "token"])


def _sketches(batches):
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column("text")):
            rows = [sketch(s).tobytes() for s in shingle_sets(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("rep").slice(lo, hi - lo), pa.array(rows, pa.binary())], ["rep", "fine"])


def _full_sets(batches):
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column("text")):
            sets = [s.tobytes() for s in shingle_sets(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(c).slice(lo, hi - lo) for c in ("rep", "leader")] + [pa.array(sets, pa.binary())], ["rep", "leader", "shingles"])


def _agreeing(batches):
    """Pairs whose signatures agree in MATCHES coordinates or more."""
    for batch in batches:
        left, right = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES) for c in ("sig_a", "sig_b"))
        same = (left == right).sum(axis=1)
        keep = np.flatnonzero(same >= MATCHES)
        yield pa.RecordBatch.from_arrays([batch.column("leader").take(pa.array(keep)), batch.column("rep").take(pa.array(keep)), pa.array(same[keep], pa.int32())], ["leader", "rep", "same"])


def _linked(batches):
    """Pairs whose full sets are similar enough."""
    for batch in batches:
        keep = []
        for left, right in zip(batch.column("set_a"), batch.column("set_b")):
            a, b = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
            small, large = min(len(a), len(b)), max(len(a), len(b))
            linked = 100 * small >= NUMERATOR * large
            if linked:
                common = len(np.intersect1d(a, b, assume_unique=True))
                linked = 100 * common >= NUMERATOR * (len(a) + len(b) - common)
            keep.append(linked)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("leader", "rep")], ["a", "b"])


def _agree(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Counts the collisions of candidate pairs: those outside the prefixes, whose lists were not merged, by probing both signatures."""
    sig = classes.select(F.col("cid").alias("rep"), "sig")
    both = pairs.join(sig.withColumnRenamed("sig", "sig_b"), "rep").join(sig.select(F.col("rep").alias("leader"), F.col("sig").alias("sig_a")), "leader")
    return both.select("leader", "rep", "sig_a", "sig_b").mapInArrow(_agreeing, "leader long, rep long, same int")


def _texts_of(wanted: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """`wanted` (with a class rep each) and the text of the row that stands for the class, read where it is joined."""
    named = materialize(wanted.join(classes.select(F.col("cid").alias("rep"), "doc_id", "text_hash"), "rep"), "near-wanted")
    return texts.join(small_side(named), ["doc_id", "text_hash"]).select(*wanted.columns, "text")


def _confirm(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among pairs (materialized leader, rep), on the full sets of the two texts.

    What moves is a member's set, to the leader's partition, which Spark splits
    if it is large.
    """
    begin = mark()
    wanted = pairs.select("rep", "leader").unionByName(pairs.select(F.col("leader").alias("rep"), F.lit(None).cast("long").alias("leader")).distinct())
    sets = materialize(_texts_of(wanted, classes, texts).mapInArrow(_full_sets, "rep long, leader long, shingles binary"), "near-sets")
    members = sets.filter("leader IS NOT NULL").withColumnRenamed("shingles", "set_b")
    leaders = sets.filter("leader IS NULL").select(F.col("rep").alias("leader"), F.col("shingles").alias("set_a"))
    return materialize(members.join(leaders, "leader").select("leader", "rep", "set_a", "set_b").mapInArrow(_linked, "a long, b long"), "near-links", since=begin)


def _across(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """The posts of lists that hold several components, with label and the list's length n."""
    begin = mark()
    named = posts.join(labels, F.col("rep") == F.col("node"), "left").select(*posts.columns, F.coalesce("label", "rep").alias("label"))
    parts = named.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_labels"))
    lists = materialize(parts.filter("n_labels > 1").select("token", "n"), "near-lists")
    return materialize(named.join(lists, "token"), "near-open", since=begin)


def _labels(links: DataFrame) -> DataFrame:
    begin = mark()
    return materialize(connected_components(links), "near-labels", since=begin)


def _heads(posts: DataFrame, first: str, *columns: str) -> DataFrame:
    """Up to three leaders of each list: those with the smallest and the largest `first`, and one by hash. With labels first, no member has the label of all of them if the list has two."""
    whole = F.struct(first, *columns)
    three = F.array_distinct(F.array(F.min(whole), F.max(whole), F.min_by(whole, F.xxhash64("rep"))))
    heads = posts.groupBy("token").agg(three.alias("leaders"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("token", F.explode("leaders").alias("x"))
    return heads.select("token", *[F.col(f"x.{c}").alias("leader" if c == "rep" else f"leader_{c}") for c in (first, *columns)])


def _closest(counted: DataFrame, by: str) -> DataFrame:
    """Of each class the leader that it agrees with most, the smallest of several."""
    best = counted.groupBy("rep").agg(F.max(F.struct(by, (-F.col("leader")).alias("less"))).alias("x"))
    return materialize(best.select((-F.col("x.less")).alias("leader"), "rep"), "near-pairs")


def _set_posts(members: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """rep, size, token, place: the classes posted under the shingles in the prefixes of their sets, from the rarest.

    Sets that are similar enough share a shingle among the first
    size - ceil(size * NUMERATOR / 100) + 1 of each in any common order.
    Shingles that only one class has count towards the prefix and are not posted.
    """
    begin = mark()
    rows = materialize(_texts_of(members.select("rep"), classes, texts).mapInArrow(_set_rows, "rep long, size long, token long"), "near-shingles")
    shared = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    lists = rows.join(shared, "token").groupBy("rep", "size").agg(F.sort_array(F.collect_set(F.struct("n", "token"))).alias("x"))
    alone = F.col("size") - F.size("x")
    prefix = F.col("size") - F.ceil(F.col("size") * NUMERATOR / 100) + 1
    posts = lists.select("rep", "size", alone.alias("alone"), F.posexplode(F.slice("x", F.lit(1), F.greatest(F.lit(0), prefix - alone).cast("int"))).alias("at", "x"))
    return materialize(posts.select("rep", "size", F.col("x.token").alias("token"), (F.col("alone") + F.col("at")).alias("place")), "near-set-posts", since=begin)


def _possible(size_a, place_a, size_b, place_b, smaller, larger):
    """Whether two sets may be similar enough if this is their first common shingle: by their sizes and by what is left behind it."""
    common = NUMERATOR * (size_a + size_b)
    return (100 * smaller(size_a, size_b) >= NUMERATOR * larger(size_a, size_b)) & ((100 + NUMERATOR) * smaller(size_a - place_a, size_b - place_b) >= common)


def _compare_blocks(batches, best: bool):
    """Pairs across components of two blocks of a list of shingles that may be linked, by size, place and sketch. Slices of arrays; no pair is a row before it passes.

    best: only the most similar partner of each member.
    """
    columns = ("rep", "label", "size", "place")
    for batch in batches:
        for i in range(batch.num_rows):
            members = [batch.column(side)[i].values for side in ("left", "right")]
            left, right = ([m.field(c).to_numpy() for c in columns] for m in members)
            fine_a, fine_b = (np.frombuffer(b"".join(m.field("fine").to_pylist()), np.uint8).reshape(-1, BINS) for m in members)
            same_block = batch.column("i")[i].as_py() == batch.column("j")[i].as_py()
            rep_b, label_b, size_b, place_b = right
            found = [np.zeros((0, 3))]
            for lo in range(0, len(left[0]), 256):
                rep_a, label_a, size_a, place_a = (x[lo : lo + 256, None] for x in left)
                met = (label_a != label_b) & _possible(size_a, place_a, size_b, place_b, np.minimum, np.maximum)
                if same_block:
                    met &= rep_a < rep_b
                at_a, at_b = np.nonzero(met)
                for k in range(0, len(at_a), 1 << 12):
                    a, b = lo + at_a[k : k + (1 << 12)], at_b[k : k + (1 << 12)]
                    keep, share = sketches_allow(fine_a[a], fine_b[b], left[2][a] + size_b[b])
                    found.append(np.stack((a[keep], b[keep], share[keep]), axis=1))
            found = np.concatenate(found)
            if best:
                found = found[np.argsort(-found[:, 2], kind="stable")]
                found = found[np.unique(np.concatenate([np.unique(found[:, side], return_index=True)[1] for side in (0, 1)]))]
            at_a, at_b = found[:, 0].astype(np.int64), found[:, 1].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(left[0][at_a], pa.int64()), pa.array(rep_b[at_b], pa.int64())], ["leader", "rep"])


def _in_blocks(posts: DataFrame, fine: DataFrame, best: bool) -> DataFrame:
    """Candidate pairs (leader, rep) of lists (rep, size, token, place, label, n), every block of a list against every other."""
    begin, blocks = mark(), F.ceil(F.col("n") / BLOCK).cast("int")
    rows = posts.join(fine, "rep").withColumn("blocks", blocks).withColumn("i", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.groupBy("token", "blocks", "i").agg(F.collect_list(F.struct("rep", "label", "size", "place", "fine")).alias("members"))
    rows = materialize(rows, "near-blocks")
    left = rows.select("token", "i", F.col("members").alias("left"), F.explode(F.sequence(F.col("i"), F.col("blocks") - 1)).alias("j"))
    both = left.join(rows.select("token", F.col("i").alias("j"), F.col("members").alias("right")), ["token", "j"])
    pairs = both.select("i", "j", "left", "right").mapInArrow(lambda batches: _compare_blocks(batches, best), "leader long, rep long").distinct()
    return materialize(pairs, "near-pairs", since=begin)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash (xxhash64 of the text), n_shingles, component_id, kept.

    1. Documents with the same shingle set form a class, by the set's 128-bit
       digest. A class has a number of its own, and stands for all its rows.
    2. A class is posted under each coordinate-value pair of its signature.
       Values that no other class has are never shared, so they drop out; the
       others are ordered from the rarest. Two classes that agree in MATCHES of
       COORDINATES pairs share one among the first COORDINATES - MATCHES + 1 of
       each (prefix filter): only these lists are merged, the long lists of
       common values are skipped. Of the pairs that they give, all collisions
       are counted; those of MATCHES or more are confirmed on full sets.
    3. Lists are merged through leaders first: each class is counted against
       three classes of its lists and confirmed with the closest. What a link
       joins need not meet again, so a large group of copies gives a row a
       class. In lists of up to SHORT members that then still hold several
       components, all pairs across components are counted.
    4. Longer lists that still hold several components are split further, on
       their members' shingles: posted under the rarest, by the exact prefix
       filter, they meet as in 3 through leaders. What is left meets in blocks:
       bounds by size and place leave only pairs whose first common shingle may
       be this one, and sketches those that may be similar enough; first each
       member's closest partner of a block, then all that are in different
       components still. So no link is lost to a cap, and members that share
       only what all of a list share do not meet.
    5. Links become components by joins.

    Texts without words have no shingles and are linked with nothing; so are
    null ids, whose component is null and which are kept. Repeated rows share a
    component; of rows with one id and several texts, each has the component of
    its own text. No rows give no rows; other columns are
    ignored. Very large classes and lists are pre-aggregated or met in joins
    that Spark splits, never gathered.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    signed = materialize(texts.mapInArrow(_signatures, "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, sig array<int>"), "near-signatures")
    grouped = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b")
    grouped = grouped.agg(F.min(F.struct("doc_id", "text_hash")).alias("x"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig"))
    classes = materialize(grouped.select(F.monotonically_increasing_id().alias("cid"), "set_a", "set_b", "x.doc_id", "x.text_hash", "size", "sig"), "near-classes")
    posted = classes.select(F.col("cid").alias("rep"), F.posexplode("sig")).select("rep", F.expr("shiftleft(CAST(pos AS BIGINT), 32) | (CAST(col AS BIGINT) & 4294967295)").alias("token"))
    shared = posted.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).filter("freq > 1")
    ordered = posted.join(shared, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("list"))
    first = F.greatest(F.lit(0), COORDINATES - MATCHES + 1 - (COORDINATES - F.size("list")))
    posts = materialize(ordered.select("rep", F.explode(F.slice("list", F.lit(1), first)).alias("x")).select("rep", F.col("x.token").alias("token")), "near-postings")

    pairs = posts.join(_heads(posts, "rep"), "token").filter("rep <> leader").select("leader", "rep").distinct()
    links = _confirm(_closest(_agree(pairs, classes), "same"), classes, texts)
    labels = _labels(links)
    rest = _across(posts, labels)
    short = rest.filter(F.col("n") <= SHORT).select("rep", "token", "label")
    other = short.select("token", F.col("rep").alias("leader"), F.col("label").alias("leader_label"))
    few = materialize(_agree(short.join(other, "token").filter("leader_label < label").select("leader", "rep").distinct(), classes).select("leader", "rep"), "near-pairs")
    links = links.unionByName(_confirm(few, classes, texts))

    long = rest.filter(F.col("n") > SHORT).select("rep").distinct()
    if not long.isEmpty():
        labels = _labels(links)
        posts = _set_posts(long, classes, texts)
        named = _across(posts, labels)
        met = named.join(_heads(named, "label", "rep", "size", "place"), "token").filter("leader_label <> label")
        met = met.filter(_possible(F.col("leader_size"), F.col("leader_place"), F.col("size"), F.col("place"), F.least, F.greatest))
        counted = met.groupBy("leader", "rep").agg(F.count(F.lit(1)).alias("met"))
        links = links.unionByName(_confirm(_closest(counted, "met"), classes, texts))
        named = _across(posts, _labels(links))
        fine = materialize(_texts_of(named.select("rep").distinct(), classes, texts).mapInArrow(_sketches, "rep long, fine binary"), "near-sketches")
        for best in (True, False):
            links = links.unionByName(_confirm(_in_blocks(named, fine, best), classes, texts))
            if best:
                named = _across(named.drop("label", "n"), _labels(links))
    labels = _labels(links)

    linked = classes.select("set_a", "set_b", F.col("cid").alias("node"), "doc_id").join(labels, "node")
    linked = linked.join(linked.groupBy("label").agg(F.min("doc_id").alias("component")), "label").select("set_a", "set_b", "component")
    alone = classes.join(labels, F.col("cid") == F.col("node"), "left_anti").select("set_a", "set_b", F.col("doc_id").alias("component"))
    known = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = signed.drop("sig").join(linked.unionByName(alone), ["set_a", "set_b"], "left")
    out = out.select("doc_id", "text_hash", "n_shingles", F.when(known, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document, that of the smallest id, of each component. Of rows with one id only those go whose text is a copy."""
    begin = mark()
    dropped = near_duplicates(docs).filter("doc_id <> component_id").select("doc_id", "text_hash").distinct()
    return drop_rows(docs, materialize(dropped, "near-dropped", since=begin))


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")
