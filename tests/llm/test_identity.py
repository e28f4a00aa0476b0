"""Texts that linear hashes confuse, rows that share an id, and lists of very many documents."""

import base64
import random

import public_tokenizers
import numpy as np
import pytest
import tiktoken
from brute import base_statistics, cut_windows, invented, near, sha
from pyspark.sql import functions as F
from test_operators import CLASHING, both, by_id, check_pieces

import corpus_pipeline
from loamtree.llm import bpe, components, exact_dedup, near_dedup, packing, quality_rules, store, substring_dedup


def alternating(n: int) -> str:
    """The first n letters, a power of two, of the word whose halves are each other's complement: any polynomial hash modulo a power of two gives it its complement's value."""
    text = "a"
    while len(text) < n:
        text += text.translate({97: 98, 98: 97})
    return text


@pytest.fixture(scope="module")
def confusing(spark):
    one = alternating(1024)
    other = one.translate({97: 98, 98: 97})
    tail = invented(60, 3)
    texts = {1: one, 2: other, 3: f"{one}\n{other}\n{one}", 4: f"{one} {tail}", 5: f"{other} {tail}", 6: " ".join([one, other] * 40), 7: " ".join([other, one] * 40)}
    texts[8] = " ".join(one if c == "a" else other for c in alternating(128))
    texts[9] = " ".join(other if c == "a" else one for c in alternating(128))
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1), texts


def test_confusing_tokens(confusing):
    docs, texts = confusing
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: (sha(" ".join(map(str, plain.encode_ordinary(t)))), sha(t)) for i, t in texts.items()}
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for _ in range(2):  # the second time from the cache
        assert by_id(bpe.bpe_digests(docs, path), "ids_sha256", "decoded_sha256") == want
    assert check_pieces(packing.pack(docs, path).collect(), texts) > 0


def test_confusing_words(confusing):
    docs, texts = confusing
    assert by_id(near_dedup.near_duplicates(docs), "n_shingles", "component_id", "kept") == near(texts)
    out = {r.doc_id: r.asDict() for r in quality_rules.quality_rules(docs).collect()}
    for i, t in texts.items():
        want = base_statistics(t)
        assert {c: out[i][c] for c in want} == want
    assert by_id(both(*substring_dedup.substring_dedup(docs)), "n_words", "n_removed", "kept_sha256") == {i: (n, gone, sha(kept)) for i, (n, gone, kept) in cut_windows(texts).items()}


A, B = invented(40, 1), invented(40, 2)


def test_near_dedup_of_one_id_with_two_texts(spark):
    rows = [(1, A + " x"), (2, A), (2, B), (6, B + " y"), (None, A), (7, None), (7, A), (7, A)]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in out.collect())
    assert found == sorted([("1", 37, "1", True), ("2", 36, "1", False), ("2", 36, "2", True), ("6", 37, "2", False), ("None", 36, "None", True), ("7", 0, "7", True), ("7", 36, "1", False), ("7", 36, "1", False)])


def test_stages_drop_rows_not_ids(spark):
    frame = lambda rows: spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    left = lambda docs: sorted((str(r.doc_id), r.text) for r in docs.collect())
    assert left(exact_dedup.drop_exact_duplicates(frame([(7, "a"), (9, "A"), (7, "b"), (None, "b"), (None, "c")]))) == [("7", "b"), ("9", "A"), ("None", "c")]
    assert left(near_dedup.drop_near_duplicates(frame([(1, A + " x"), (2, A), (2, B), (6, B + " y"), (None, A)]))) == sorted([("1", A + " x"), ("2", B), ("None", A)])
    assert left(quality_rules.drop_poor_documents(frame([(1, A), (1, "too short"), (None, None), (None, B)]))) == sorted([("1", A), ("None", B)])


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null ids and texts, one id with several texts, repeated rows, columns whose names the stages use inside, and no rows."""
    rows = [(None, A), (None, None), (1, A), (1, B), (1, B), (3, A.upper()), (4, A + " x"), (5, ""), (6, f"{invented(70, 5)} {invented(30, 6)}"), (7, f"{invented(70, 5)} {invented(90, 7)}")]
    docs = spark.createDataFrame([(*r, None if i % 2 else "en", None, 0) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    for i, c in enumerate([*CLASHING, "text_hash", "digest", "start", "stop", "ranges", "cid", "place"]):
        docs = docs.withColumn(c, F.lit(i))
    for name, given in (("some", docs), ("none", docs.limit(0))):
        stage = given
        for what, run in corpus_pipeline.STAGES[:-1]:
            folder = f"{tmp_path}/{name}-{what.replace(' ', '-')}"
            run(spark, stage, "").write.parquet(folder)
            stage = spark.read.parquet(folder)
            assert stage.columns == docs.columns
        found = sorted((str(r.doc_id), r.text) for r in stage.collect())
        want = [("1", A), ("1", B), ("1", B), ("6", f"{invented(70, 5)} {invented(30, 6)}"), ("7", invented(90, 7))]
        if name == "some":
            # quality rules reject capitals only; of equal texts the largest id stays, a null id being smaller, and of a group then the smallest
            assert found == sorted(want)
        else:
            assert found == []
        pieces = corpus_pipeline.STAGES[-1][1](spark, stage, "").collect()
        assert {str(r.doc_id) for r in pieces} == {i for i, _ in found}


@pytest.mark.parametrize("alone", [30, 10])
def test_near_dedup_of_a_long_list(spark, alone):
    """5,200 documents that share a base too small for a link, in pairs that are linked; each pair's own words are more, or fewer, than the prefix of a set."""
    base, texts = invented(50, 9), {}
    for i in range(2600):
        own = f"{base} {invented(alone, 100 + i, 10**6)}"
        texts[2 * i], texts[2 * i + 1] = own, own + " more"
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    out = near_dedup.near_duplicates(frame).collect()
    assert len(out) == len(texts) and all(r.component_id == r.doc_id - r.doc_id % 2 for r in out)


def test_components(spark):
    rng = random.Random(2)
    links = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, 5), (3000, 3001), (3001, 3000)]
    above = {}

    def top(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((top(a), top(b)))
            above[b] = a
    frame = spark.createDataFrame([*links, (None, 7), (8, None)], "a long, b long")
    rows = components.connected_components(frame).collect()
    assert len(rows) == len({r.node for r in rows}) and {r.node: r.label for r in rows} == {x: top(x) for x in above}
    assert components.connected_components(frame.limit(0)).count() == 0


def test_automaton_knows_the_earliest_document():
    rng = random.Random(6)
    for _ in range(60):
        texts = {i: [rng.randrange(3) for _ in range(rng.randrange(1, 40))] for i in rng.sample(range(50), 6)}
        automaton = substring_dedup.SuffixAutomaton()
        for i, t in texts.items():
            automaton.add(t, i)
        automaton.finish()
        stored = substring_dedup.FlatAutomaton(automaton.flat())
        for least in (1, 3, 6):
            asked = [rng.randrange(3) for _ in range(60)]
            for limit in (0, 10, 60):
                want = [any(j < limit and t[k:k + least] == asked[i:i + least] for j, t in texts.items() for k in range(len(t) - least + 1)) for i in range(60 - least + 1)]
                assert stored.earlier(np.array(asked, np.int64), least, limit).tolist() == want


def test_passages_in_small_shards(spark, monkeypatch):
    """The same rows however small shards, segments and the words past one copy are."""
    for name, value in (("SHARD", 64), ("SEGMENT", 16), ("MEET", 100)):
        monkeypatch.setattr(substring_dedup, name, value)
    rng = random.Random(9)
    pool = [invented(n, 300 + n).split() for n in (50, 55, 80, 130)]
    texts = {i: " ".join(w for _ in range(rng.randrange(1, 4)) for w in [*rng.choice(pool)[rng.randrange(4):], *invented(rng.randrange(5), rng.randrange(40)).split()]) for i in range(60)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(2)
    assert by_id(both(*substring_dedup.substring_dedup(frame)), "n_words", "n_removed", "kept_sha256") == {i: (n, gone, sha(kept)) for i, (n, gone, kept) in cut_windows(texts).items()}


def test_intermediates_are_deleted(spark):
    frame = spark.createDataFrame([(1, A + " x"), (2, A)], "doc_id long, text string")
    begin = store.mark()
    out = near_dedup.drop_near_duplicates(frame)
    assert store.mark() == begin + 1 and out.count() == 1
    store.discard(spark, begin)
    assert store.mark() == begin
