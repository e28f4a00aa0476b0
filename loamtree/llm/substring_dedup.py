"""Repeated passages by matching statistics of suffix automata of reference shards."""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .store import mark, materialize, rows_of
from .textbytes import chunks, gram_hashes, inside, word_table

#: Words in a window and in an anchor, and how far anchors are apart.
WINDOW, ANCHOR, ANCHOR_WORDS = 50, 12, 20
#: Windows in a segment of a reference and in a span, words in a shard, words that are streamed past one copy of a shard's automaton.
SEGMENT, SHARD, MEET = 4096, 1 << 15, 1 << 19
#: Parts that a class of copies is split into where it meets its smallest id.
SALTS = 16
#: Larger than any id, and the largest one.
NEVER, LAST_ID = 1 << 63, (1 << 63) - 1
#: Arrays of a stored automaton.
AUTOMATON = ["words", "keys", "targets", "links", "lengths", "firsts"]

_SPAN_SCHEMA = pa.schema([("shard", pa.int64()), ("reads", pa.bool_()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("symbols", pa.binary())])
_AUTOMATON_SCHEMA = pa.schema([("shard", pa.int64()), *((c, pa.binary()) for c in AUTOMATON)])
_FOUND_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("symbols", pa.binary())])


def sliding(values: np.ndarray, width: int, smaller=np.minimum) -> np.ndarray:
    """The minimum of each `width` consecutive values, by doubling."""
    n, have, out = len(values), 1, values
    if n < width:
        return values[:0]
    while 2 * have <= width:
        out = smaller(out[:-have], out[have:])
        have *= 2
    return smaller(out[: n - width + 1], out[width - have : n - have + 1])


def window_anchors(words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the windows that lie in one document, and the anchor of each: the smallest hash of its ANCHOR-word grams.

    Equal windows have equal anchors wherever they stand, so two documents that
    share a window share its anchor.
    """
    at = np.flatnonzero(inside(before, WINDOW))
    return at, sliding(gram_hashes(words, ANCHOR), WINDOW - ANCHOR + 1)[at]


def _profiles(batches):
    """A narrow row per document: its words, the digest of all of them, and its anchors with the first window of each."""
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column("text")):
            starts, ends, before, words = word_table(data, offsets)
            at, anchor = window_anchors(words, before)
            new = np.ones(len(at), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(at) > 1)
            at, anchor = at[new], anchor[new].view(np.int64)
            cut = np.searchsorted(at, before)
            raw, starts, ends = data.tobytes(), starts.tolist(), ends.tolist()
            digests, anchors, places = [], [], []
            for i, (a, b) in enumerate(zip(before.tolist(), before[1:].tolist())):
                digests.append(hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(starts[a:b], ends[a:b])])).hexdigest())
                distinct, first = np.unique(anchor[cut[i] : cut[i + 1]], return_index=True)
                anchors.append(distinct)
                places.append(at[cut[i] : cut[i + 1]][first] - a)
            bounds = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in anchors]))), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([*x, np.zeros(0, np.int64)]), t)) for x, t in ((anchors, pa.int64()), (places, pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "text_hash")), pa.array(np.diff(before), pa.int64()), pa.array(digests, pa.string()), *lists],
                ["doc_id", "text_hash", "n_words", "sha256", "anchors", "places"],
            )


def _spans(batches):
    """Of each document the runs of windows whose anchors one shard holds: for its automaton where the document owns the anchors, else to be streamed past it."""
    for batch in batches:
        out = {c: [] for c in ("shard", "reads", "doc_id", "text_hash", "start", "symbols")}
        met, ids, hashes = (batch.column(c) for c in ("met", "doc_id", "text_hash"))
        for lo, hi, data, offsets in chunks(batch.column("text")):
            _, _, before, words = word_table(data, offsets)
            at, anchor = window_anchors(words, before)
            cut = np.searchsorted(at, before)
            for i in range(lo, hi):
                a, b, first = cut[i - lo], cut[i - lo + 1], before[i - lo]
                known = met[i].values
                keys, shards, owned = (known.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "shard", "owned"))
                order = np.argsort(keys)
                keys = keys[order]
                own = anchor[a:b].view(np.int64)
                place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                # twice the shard, and one more where the windows are read
                role = np.where(keys[place] == own, (shards[order] * 2 + ~owned[order])[place], -1)
                edge = np.flatnonzero(np.concatenate(([True], role[1:] != role[:-1], [True]))) if b > a else np.zeros(0, np.int64)
                for s, e in zip(edge.tolist(), edge[1:].tolist()):
                    for x in range(s, e, SEGMENT) if role[s] >= 0 else ():
                        out["shard"].append(role[s] // 2)
                        out["reads"].append(role[s] % 2 == 1)
                        out["doc_id"].append(ids[i].as_py())
                        out["text_hash"].append(hashes[i].as_py())
                        out["start"].append(x)
                        out["symbols"].append(words[first + x : first + min(x + SEGMENT, e) + WINDOW - 1].tobytes())
        yield pa.RecordBatch.from_pydict(out, schema=_SPAN_SCHEMA)


class SuffixAutomaton:
    """Of several sequences of words, each with the id of its document; each state knows the smallest id that it occurs in.

    Takes time and memory in proportion to the sequences, which are one shard's.
    """

    def __init__(self):
        self.next, self.link, self.length, self.first = [{}], [-1], [0], [NEVER]

    def add(self, sequence: list[int], doc_id: int) -> None:
        nexts, link, length, first, last = self.next, self.link, self.length, self.first, 0
        for c in sequence:
            if c in nexts[last] and length[nexts[last][c]] == length[last] + 1:
                last = nexts[last][c]
                if doc_id < first[last]:
                    first[last] = doc_id
                continue
            p, new = last, len(nexts)
            if c in nexts[p]:
                # the longer context is there, so the state of this one is a copy of its target
                last = self._copy(p, c)
                first[last] = doc_id
                continue
            nexts.append({})
            link.append(0)
            length.append(length[last] + 1)
            first.append(doc_id)
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._copy(p, c)
            last = new

    def _copy(self, p: int, c: int) -> int:
        """A state for the contexts up to that of p before c, taken out of the one they were in."""
        nexts, link, length = self.next, self.link, self.length
        q, copy = nexts[p][c], len(nexts)
        nexts.append(dict(nexts[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        self.first.append(NEVER)
        while p >= 0 and nexts[p].get(c) == q:
            nexts[p][c] = copy
            p = link[p]
        link[q] = copy
        return copy

    def finish(self) -> None:
        """Hands each state's smallest id on to the shorter contexts."""
        first, link = self.first, self.link
        for state in np.argsort(-np.array(self.length), kind="stable").tolist():
            up = link[state]
            if up >= 0 and first[state] < first[up]:
                first[up] = first[state]

    def flat(self) -> dict[str, bytes]:
        """As arrays: the distinct words in order, the transitions by state and place of the word among these, in order, their targets, and of each state the suffix link, the length and the smallest id."""
        edges = [(state, c, to) for state, row in enumerate(self.next) for c, to in row.items()]
        states, words, targets = (np.array([e[i] for e in edges], np.int64) for i in range(3))
        distinct, rank = np.unique(words, return_inverse=True)
        keys = states * len(distinct) + rank
        order = np.argsort(keys)
        arrays = distinct, keys[order], targets[order].astype(np.int32), np.array(self.link, np.int32), np.array(self.length, np.int32), np.array([min(x, LAST_ID) for x in self.first], np.int64)
        return dict(zip(AUTOMATON, (x.tobytes() for x in arrays)))


class FlatAutomaton:
    """SuffixAutomaton.flat() read back, to stream sequences past it."""

    def __init__(self, arrays: dict[str, bytes]):
        read = lambda name, kind: np.frombuffer(arrays[name], kind)
        self.words = read("words", np.int64)
        self.next = dict(zip(read("keys", np.int64).tolist(), read("targets", np.int32).tolist()))
        self.link, self.length, self.first = read("links", np.int32).tolist(), read("lengths", np.int32).tolist(), read("firsts", np.int64).tolist()

    def earlier(self, sequence: np.ndarray, least: int, doc_id: int) -> np.ndarray:
        """For each window of `least` words whether it occurs in a document with a smaller id, by matching statistics."""
        step, link, length, first, n = self.next.get, self.link, self.length, self.first, len(self.words)
        place = np.minimum(np.searchsorted(self.words, sequence), n - 1) if n else np.zeros(len(sequence), np.int64)
        rank = np.where(self.words[place] == sequence, place, -1).tolist() if n else [-1] * len(sequence)
        state, run, found = 0, 0, np.zeros(max(0, len(sequence) - least + 1), bool)
        for i, c in enumerate(rank, 1 - least):
            if c < 0:
                state = run = 0
                continue
            to = step(state * n + c)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = step(state * n + c)
            if to is not None:
                state = to
                run += 1
                if run >= least:
                    while length[link[state]] >= least:
                        state = link[state]
                        run = length[state]
                    found[i] = first[state] < doc_id
        return found


def _built(batches):
    """Rows of references sorted by shard: one row a shard, its automaton as flat arrays."""
    key, automaton = None, None

    def row():
        automaton.finish()
        return pa.RecordBatch.from_pydict({"shard": [key]} | {c: [x] for c, x in automaton.flat().items()}, schema=_AUTOMATON_SCHEMA)

    for batch in batches:
        for shard, doc_id, symbols in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("symbols")):
            if shard != key:
                if automaton:
                    yield row()
                key, automaton = shard, SuffixAutomaton()
            automaton.add(np.frombuffer(symbols.as_buffer(), np.int64).tolist(), doc_id)
    if automaton:
        yield row()


def _streamed(rows: pa.Table) -> pa.Table:
    """The spans of one shard and salt, streamed past its automaton; without one the shard has no references.

    Gives ranges of windows: those that an earlier document has, and, with their words, those that none in the shard has.
    """
    own = rows.filter(pc.invert(rows.column("reads")))
    arrays = {c: own.column(c)[0].as_buffer() for c in AUTOMATON} if own.num_rows else SuffixAutomaton().flat()
    automaton = FlatAutomaton(arrays)
    spans = rows.select(["reads", "doc_id", "text_hash", "start", "symbols"]).filter(rows.column("reads"))
    out = {c: [] for c in _FOUND_SCHEMA.names}
    for doc_id, text_hash, start, symbols in zip(*(spans.column(c).to_pylist() for c in ("doc_id", "text_hash", "start")), spans.column("symbols")):
        words = np.frombuffer(symbols.as_buffer(), np.int64)
        found = automaton.earlier(words, WINDOW, doc_id)
        edge = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1], [True])))
        for a, b in zip(edge.tolist(), edge[1:].tolist()):
            out["doc_id"].append(doc_id)
            out["text_hash"].append(text_hash)
            out["start"].append(start + a)
            out["stop"].append(start + b)
            out["symbols"].append(None if found[a] else words[a : b + WINDOW - 1].tobytes())
    return pa.Table.from_pydict(out, schema=_FOUND_SCHEMA)


def _stream(spans: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, stop, symbols: see _streamed(), of materialized spans.

    A shard's automaton is built once, from its references, and written as flat
    arrays. It then goes once to every MEET words of the spans that read it,
    which meet its copies by a hash of themselves: a shard that very many
    documents read is spread over tasks, each of which loads the arrays. A
    copy and its spans are a group of their own, so that an Arrow batch does not
    hold the automata of as many shards as it has room for rows.
    """
    begin, size = mark(), F.octet_length("symbols") / 8
    read = spans.filter("reads").groupBy("shard").agg(F.ceil(F.sum(size) / MEET).cast("int").alias("copies"))
    read = materialize(read, "parts-shards")
    references = spans.filter("NOT reads").join(read.select("shard"), "shard", "left_semi").select("shard", "doc_id", "symbols")
    built = references.repartition("shard").sortWithinPartitions("shard", "doc_id").mapInArrow(_built, "shard long, " + ", ".join(f"{c} binary" for c in AUTOMATON))
    automata = materialize(built, "parts-automata").join(read, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("reads", F.lit(False))
    salt = F.pmod(F.xxhash64("doc_id", "text_hash", "start"), F.col("copies")).cast("int")
    readers = spans.filter("reads").join(read, "shard").withColumn("salt", salt)
    placed = automata.drop("copies").unionByName(readers.drop("copies"), allowMissingColumns=True).groupBy("shard", "salt")
    return materialize(placed.applyInArrow(_streamed, "doc_id long, text_hash long, start int, stop int, symbols binary"), "parts-found", since=begin)


def _windows(batches):
    """The hash of every window of the spans."""
    for batch in batches:
        hashes = [gram_hashes(np.frombuffer(x.as_buffer(), np.uint64), WINDOW).view(np.int64) for x in batch.column("symbols")]
        rows = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in hashes]), pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("doc_id", "text_hash", "start")), pa.array(np.concatenate([*hashes, np.zeros(0, np.int64)]))], ["doc_id", "text_hash", "start", "window"])


def _covered(count: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of `count` positions lie in one of the ranges."""
    edge = np.zeros(count + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:count]) > 0


def _kept(batches):
    for batch in batches:
        ranges = batch.column("ranges")
        counts, sizes, texts = [], [], []
        for lo, hi, data, offsets in chunks(batch.column("text")):
            starts, ends, before, _ = word_table(data, offsets, hashed=False)
            raw, starts, ends, bounds = data.tobytes(), starts.tolist(), ends.tolist(), before.tolist()
            for i in range(lo, hi):
                a, b = bounds[i - lo], bounds[i - lo + 1]
                own = ranges[i].values
                gone = _covered(b - a, own.field("start").to_numpy(), own.field("stop").to_numpy() + WINDOW - 1)
                counts.append(b - a)
                sizes.append(int(gone.sum()))
                texts.append(b" ".join([raw[starts[k]:ends[k]] for k in (a + np.flatnonzero(~gone)).tolist()]).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text_hash", "n_words", "n_removed", "kept_text"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables that together have one row per document.

    The first, of documents that lose nothing or all their words as later
    copies: doc_id, text_hash (xxhash64 of the text), n_words, n_removed,
    kept_sha256. The second, of all others: doc_id, text_hash, n_words,
    n_removed, kept_text (the kept words joined by one space).

    A word goes if a window of WINDOW words that covers it also starts in a
    document with a smaller id.

    1. Documents with the same words form a class; only the smallest id's goes
       on, the others lose all if they have a window.
    2. Each document's anchors (about one in 20 words) are met with the smallest
       id that has the anchor, its owner. The owner's windows with shared
       anchors are the references. They are dealt to shards of about SHARD
       words by owner and segment, so neither a long document nor an owner of
       many passages makes a large automaton.
    3. Every shard's suffix automaton is built once and stored as flat arrays,
       which the tasks load that read it; the windows of other documents whose
       anchors it holds are streamed past it for matching statistics. A document
       thus meets the shards that can match it, not all of them, which would
       take the square of the corpus. A state knows the smallest id it occurs in.
    4. A window that is in no reference, though an earlier document has its
       anchor, may still start in an earlier document other than the owner. Such
       windows are met by their hash with the smallest id that has them left,
       and streamed past shards made of these.

    Null and empty texts have no words. Null ids are neither references nor cut.
    Rows with the same id are one document for others, and nothing to each
    other. No rows give no rows; other columns are ignored. Memory is bounded by
    a shard's automaton and a chunk of documents, or one document.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    profile = materialize(named.mapInArrow(_profiles, "doc_id long, text_hash long, n_words long, sha256 string, anchors array<long>, places array<int>"), "parts-profiles")
    long = profile.filter(f"doc_id IS NOT NULL AND n_words >= {WINDOW}")
    copied = long.groupBy("sha256").agg(F.min("doc_id").alias("kept_id"), F.max("doc_id").alias("last")).filter("kept_id < last").select("sha256", "kept_id")
    # a hash of the id spreads a class of very many copies
    copied = copied.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = long.select("doc_id", "text_hash", "sha256", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    copies = materialize(copies.join(copied, ["sha256", "salt"]).filter("doc_id > kept_id").select("doc_id", "text_hash").distinct(), "parts-copies")
    alone = long.join(copies, ["doc_id", "text_hash"], "left_anti")
    anchors = materialize(alone.select("doc_id", "text_hash", F.explode(F.arrays_zip("anchors", "places")).alias("x")).select("doc_id", "text_hash", "x.anchors", "x.places").toDF("doc_id", "text_hash", "anchor", "place"), "parts-anchors")
    segment = F.struct(F.col("doc_id").alias("owner"), F.floor(F.col("place") / SEGMENT).alias("segment"))
    shared = anchors.groupBy("anchor").agg(F.min(segment).alias("at"), F.max("doc_id").alias("last")).filter("at.owner < last").select("anchor", "at.owner", "at.segment")
    shared = materialize(shared, "parts-shared")
    shards = 1 + shared.count() * ANCHOR_WORDS // SHARD
    placed = shared.select("anchor", "owner", F.pmod(F.xxhash64("owner", "segment"), F.lit(shards)).alias("shard"))
    entry = F.struct("anchor", "shard", (F.col("owner") == F.col("doc_id")).alias("owned"))
    met = materialize(anchors.select("doc_id", "text_hash", "anchor").distinct().join(placed, "anchor").groupBy("doc_id", "text_hash").agg(F.collect_list(entry).alias("met")), "parts-met")

    texts = rows_of(named, met, ["doc_id", "text_hash"]).join(met, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "met")
    spans = materialize(texts.mapInArrow(_spans, "shard long, reads boolean, doc_id long, text_hash long, start int, symbols binary"), "parts-spans")
    found = _stream(spans)

    rest = found.filter("symbols IS NOT NULL").drop("stop")
    windows = materialize(rest.mapInArrow(_windows, "doc_id long, text_hash long, start int, window long").distinct(), "parts-windows")
    first = windows.groupBy("window").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner < last").drop("last")
    asked = materialize(windows.join(first, "window").select("doc_id", "text_hash", "start", "owner").distinct(), "parts-asked")
    shards = 1 + asked.filter("doc_id = owner").count() * 2 * WINDOW // SHARD
    roles = asked.select(F.pmod(F.xxhash64("owner"), F.lit(shards)).alias("shard"), (F.col("doc_id") > F.col("owner")).alias("reads"), "doc_id", "text_hash", "start").distinct()
    late = _stream(materialize(roles.join(rest.dropDuplicates(["doc_id", "text_hash", "start"]), ["doc_id", "text_hash", "start"]).select(*spans.columns), "parts-spans"))

    ranges = materialize(found.unionByName(late).filter("symbols IS NULL").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("ranges")), "parts-ranges")
    kept = rows_of(named, ranges, ["doc_id", "text_hash"]).join(ranges, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "ranges").mapInArrow(_kept, "doc_id long, text_hash long, n_words long, n_removed long, kept_text string")
    settled = ranges.select("doc_id", "text_hash", F.lit(False).alias("copy")).unionByName(copies.withColumn("copy", F.lit(True)))
    judged = profile.select("doc_id", "text_hash", "n_words", "sha256").join(settled, ["doc_id", "text_hash"], "left").filter("copy IS NULL OR copy")
    gone = F.when(F.col("copy"), F.col("n_words")).otherwise(F.lit(0))
    plain = judged.select("doc_id", "text_hash", "n_words", gone.alias("n_removed"), F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.col("sha256")).alias("kept_sha256"))
    return plain, kept


def cut_repeated_passages(docs: DataFrame) -> DataFrame:
    """docs with the words that substring_dedup() keeps; documents that lose none stay as they are. n_chars, if there, is counted anew.

    Rows with one id and several texts are each cut as their own text is.
    """
    begin = mark()
    plain, kept = substring_dedup(docs)
    emptied = plain.filter("n_removed > 0").select("doc_id", "text_hash", F.lit("").alias("kept_text"))
    cut = kept.filter("n_removed > 0").select("doc_id", "text_hash", "kept_text").unionByName(emptied).dropDuplicates(["doc_id", "text_hash"])
    cut = materialize(cut, "parts-cut", since=begin)
    joined = docs.join(cut, (docs["doc_id"] == cut["doc_id"]) & (F.xxhash64(docs["text"]) == cut["text_hash"]), "left")
    text = F.coalesce(cut["kept_text"], docs["text"])
    counted = {"n_chars": F.when(cut["doc_id"].isNull(), docs["n_chars"]).otherwise(F.length(text))} if "n_chars" in docs.columns else {}
    fresh = {"text": text} | counted
    return joined.select(*[fresh[c].cast(docs.schema[c].dataType).alias(c) if c in fresh else docs[c] for c in docs.columns])


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    plain, kept = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plain.drop("text_hash").unionByName(kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")))
