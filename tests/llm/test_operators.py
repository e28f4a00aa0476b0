"""Each numbered operator against plain Python on edge cases and on the small tables."""

import base64
import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken
from brute import base_statistics, cut_windows, edge_texts, exact, near, sha
from pyspark.sql import functions as F

from loamtree.llm import bpe, exact_dedup, near_dedup, packing, quality_model, quality_rules, substring_dedup, toxicity

#: Columns with names that the operators use inside.
CLASHING = ["norm", "head", "hash", "salt", "row", "rep", "leader", "label", "token", "anchor", "owner", "cut_id", "kept_text", "dropped_id", "d2", "limit", "center", "kept", "ids", "distance"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", len(t or "")) for i, t in edge_texts().items()]
    random.Random(3).shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    for i, c in enumerate(CLASHING):
        frame = frame.withColumn(c, F.lit(None).cast("string") if i % 2 else F.lit(i))
    return frame


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return frame, {r.doc_id: r.text for r in frame.collect()}


def by_id(frame, *columns):
    rows = frame.collect()
    out = {r.doc_id: tuple(r[c] for c in columns) for r in rows}
    assert len(rows) == len(out)
    return out


def both(plain, kept):
    return plain.drop("text_hash").unionByName(kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")))


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def test_exact_dedup(docs, small):
    columns = ("keep_id", "group_size", "kept", "text_sha256")
    assert by_id(exact_dedup.exact_dedup(docs, keep="largest"), *columns) == exact(edge_texts())
    assert by_id(exact_dedup.exact_dedup(small[0], keep="largest"), *columns) == exact(small[1])
    assert sorted(exact_dedup.drop_exact_duplicates(docs).columns) == sorted(docs.columns)


def test_exact_dedup_keeps_smallest_and_takes_nulls(spark):
    rows = spark.createDataFrame([(None, "A"), (4, "a"), (2, "a"), (2, "A"), (9, None), (8, "")], "doc_id long, text string")
    out = sorted(((r.doc_id is not None, r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(rows).collect()), key=str)
    assert out == sorted([(False, 0, None, 4, True), (True, 4, None, 4, False), (True, 2, None, 4, False), (True, 2, None, 4, False), (True, 9, 8, 2, False), (True, 8, 8, 2, True)], key=str)
    assert sorted((r.doc_id, r.kept) for r in exact_dedup.exact_dedup(rows, keep="largest").filter("doc_id < 9").collect()) == [(2, False), (2, False), (4, True), (8, False)]


@pytest.fixture(scope="module")
def plain_bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, small, plain_bpe):
    for frame, texts in ((docs, edge_texts()), small):
        want = {}
        for i, t in texts.items():
            ids = plain_bpe.encode_ordinary(t or "")
            want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(t or ""))
        assert by_id(bpe.bpe_digests(frame, public_tokenizers.path("byte_bpe_50k.tiktoken")), "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_bpe_random_characters(plain_bpe):
    import numpy as np

    rng, vocabulary = random.Random(5), bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pool = list("ab'strvemdl  \t\n\r1'2") + ["\u00a0", "é", "ſ", "中", "٣", "²", "\u0301", "\x1c", "\x85", "\u200b", "😀", "'S", "ll"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    ids, before = bpe.encode_chunk(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))), vocabulary)
    wrong = [(t, ids[a:b].tolist()) for t, a, b in zip(texts, before, before[1:]) if ids[a:b].tolist() != plain_bpe.encode_ordinary(t)]
    assert not wrong, wrong[:3]


def test_bpe_round_trip(docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.bpe_encode(docs, path)
    assert {r.doc_id: bytes(r.data).decode() for r in bpe.bpe_decode(encoded, path).collect()} == {i: t or "" for i, t in edge_texts().items()}


def test_near_dedup(docs, small):
    columns = ("n_shingles", "component_id", "kept")
    assert by_id(near_dedup.near_duplicates(docs), *columns) == near(edge_texts())
    assert by_id(near_dedup.near_duplicates(small[0]), *columns) == near(small[1])


def test_near_dedup_chains_of_one_length(spark):
    """Many texts with links at and around the threshold, all pairs compared."""
    rng = random.Random(8)
    start = [f"t{i}" for i in range(60)]
    texts = {}
    for i in range(250):
        own = list(start) if i % 3 else texts[rng.choice(list(texts))].split() if texts else list(start)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
        texts[i] = " ".join(own)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert by_id(near_dedup.near_duplicates(frame), "n_shingles", "component_id", "kept") == near(texts)


def test_quality_statistics(docs, small):
    for frame, texts in ((docs, edge_texts()), small):
        out = {r.doc_id: r.asDict() for r in quality_rules.quality_rules(frame).collect()}
        want = {i: base_statistics(t) for i, t in texts.items()}
        assert {i: {c: out[i][c] for c in want[i]} for i in out} == want
        assert not any(r["kept"] and r["base_failed"] for r in out.values())


def test_quality_outliers(spark):
    """Documents of one kind stay; one kind of junk goes, also from a language and source that hold little else."""
    rng = random.Random(1)
    text = lambda: " ".join("abcdefghij"[rng.randrange(10)] * rng.randrange(2, 9) for _ in range(rng.randrange(80, 200)))
    rows = [(i, text(), "en", "web" if i % 3 else "rare") for i in range(300)]
    rows += [(1000 + i, " ".join("#|" * 9 for _ in range(80)) + f" {i} " + text(), "en", "web") for i in range(15)]
    out = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[i] for i in range(300))
    assert not any(out[1000 + i] for i in range(15))


def test_substring_dedup(docs, small, spark):
    for frame, texts in ((docs, edge_texts()), small):
        plain, kept = substring_dedup.substring_dedup(frame)
        out = by_id(both(plain, kept), "n_words", "n_removed", "kept_sha256")
        assert out == {i: (n, gone, sha(text)) for i, (n, gone, text) in cut_windows(texts).items()}


def test_substring_dedup_mixed_origins(spark):
    """Windows of a document that start in several earlier ones; periodic texts; passages of 49 and 50 words."""
    from brute import invented

    rng = random.Random(4)
    pool = [invented(n, 300 + n).split() for n in (49, 50, 51, 60, 75, 120)]
    texts = {}
    for i in range(120):
        own = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(pool)
            cut = rng.randrange(0, 12)
            own += p[cut if rng.random() < 0.5 else 0:] + invented(rng.randrange(0, 8), 1000 + rng.randrange(50)).split()
        texts[i * 3] = " ".join(own if i % 10 else ["p", "q", "r"] * rng.randrange(10, 40))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    plain, kept = substring_dedup.substring_dedup(frame)
    out = by_id(both(plain, kept), "n_words", "n_removed", "kept_sha256")
    assert out == {i: (n, gone, sha(text)) for i, (n, gone, text) in cut_windows(texts).items()}


def test_cut_passages_keeps_columns(docs):
    out = substring_dedup.cut_repeated_passages(docs)
    assert out.columns == docs.columns
    want = cut_windows(edge_texts())
    for r in out.select("doc_id", "text", "n_chars").collect():
        n, gone, text = want[r.doc_id]
        assert (r.text, r.n_chars) == ((text, len(text)) if gone else (edge_texts()[r.doc_id], len(edge_texts()[r.doc_id] or "")))


def check_pieces(rows, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in texts.items():
        ids, at = tokenizer.encode(text or "", add_special_tokens=False).ids + [0], 0
        for r in sorted(pieces.pop(i), key=lambda r: r.start):
            own = ids[r.start:r.start + r.length]
            assert (r.start, r.length, r.doc_tokens) == (at, len(own), len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))
            at += r.length
        assert at == len(ids), i
    assert not pieces
    total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        total += at
    return total / (1024 * len(sequences))


def test_packing(docs, small):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for frame, texts in ((docs, edge_texts()), small):
        assert check_pieces(packing.pack(frame.repartition(20), path).collect(), texts) > 0.9
        assert check_pieces(packing.pack(frame.repartition(20), path, fan=3).collect(), texts) > 0.9


def test_models_on_edge_cases(docs, spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in edge_texts()] + [(None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for given in (labels, none):
        for out in (toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, given)), quality_model.score_quality(docs, quality_model.fit_quality(docs, given))):
            rows = out.collect()
            assert len(rows) == len(edge_texts()) and all(0 <= r.score <= 1 for r in rows)


def test_empty_tables(spark):
    none, path = empty(spark), public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain, kept = substring_dedup.substring_dedup(none)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    models = toxicity.score_toxicity(none, toxicity.fit_toxicity(none, labels)), quality_model.score_quality(none, quality_model.fit_quality(none, labels))
    for out in (*models, exact_dedup.exact_dedup(none), bpe.bpe_digests(none, path), near_dedup.near_duplicates(none), quality_rules.quality_rules(none), plain, kept, packing.pack(none, path)):
        assert out.count() == 0


def test_null_ids_and_repeated_rows(spark):
    text = edge_texts()[9]
    rows = spark.createDataFrame([(None, text), (None, "x"), (3, text), (3, text), (7, text), (7, "other words here"), (None, None)], "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    labels = spark.createDataFrame([(3, 1, 0), (7, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for scored in (toxicity.score_toxicity(rows, toxicity.fit_toxicity(rows, labels)), quality_model.score_quality(rows, quality_model.fit_quality(rows, labels))):
        found = [(r.doc_id, r.score, r.predicted) for r in scored.collect()]
        assert len(found) == 7 and len({x for x in found if x[0] == 3}) == 1 and all(0 <= x[1] <= 1 for x in found)
    assert bpe.bpe_digests(rows, path).count() == exact_dedup.exact_dedup(rows).count() == quality_rules.quality_rules(rows).count() == 7
    out = sorted((str(r.doc_id), str(r.component_id)) for r in near_dedup.near_duplicates(rows).collect())
    assert out == [("3", "3"), ("3", "3"), ("7", "3"), ("7", "7"), ("None", "None"), ("None", "None"), ("None", "None")]
    plain, kept = substring_dedup.substring_dedup(rows)
    found = plain.select("doc_id", "n_removed").unionByName(kept.select("doc_id", "n_removed")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in found) == [("3", 0), ("3", 0), ("7", 0), ("7", 300), ("None", 0), ("None", 0), ("None", 0)]
    cut = sorted((str(r.doc_id), len(r.text or "")) for r in substring_dedup.cut_repeated_passages(rows).collect())
    assert cut == sorted([("None", len(text)), ("None", 1), ("3", len(text)), ("3", len(text)), ("7", 0), ("7", len("other words here")), ("None", 0)])
    pieces = packing.pack(rows, path).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    sizes = {r.doc_id: r.n for r in bpe.bpe_digests(rows, path).groupBy("doc_id").agg((F.sum("n_tokens") + F.count("*")).alias("n")).collect()}
    assert {r.doc_id: r.n for r in pieces} == sizes
