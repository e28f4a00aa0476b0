"""The two models: scores against plain Python, held-out ranking, and what each method is there for."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loamtree.llm import labelled as labelled_rows, quality_model, registry, toxicity

WORDS = [f"w{i}" for i in range(60)]


def auc(scores, labels) -> float:
    order = sorted(zip(scores, labels))
    ranks, i = 0.0, 0
    while i < len(order):
        j = i
        while j < len(order) and order[j][0] == order[i][0]:
            j += 1
        ranks += sum(1 for k in range(i, j) if order[k][1]) * (i + j + 1) / 2
        i = j
    n = sum(labels)
    return (ranks - n * (n + 1) / 2) / (n * (len(labels) - n))


@pytest.mark.parametrize("query, label, least", [("op1_toxicity", "toxic", 0.95), ("op6_quality_model", "quality", 0.95)])
def test_held_out_ranking(spark, sf_dir, query, label, least):
    """Ranking does not reward a constant, nor does the mean over both classes of what is found."""
    data = sf_dir.replace("sf0.001", "sf0.1")
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r[label] is not None}
    rows = [r for r in registry.QUERIES[query](spark, data).collect() if r.held_out and r.doc_id in labels]
    assert auc([r.score for r in rows], [labels[r.doc_id] == 1 for r in rows]) >= least
    right = lambda kind: np.mean([r.predicted == kind for r in rows if labels[r.doc_id] == kind])
    assert (right(0) + right(1)) / 2 >= 0.9


def labelled(rng, rule, n):
    texts = [" ".join(rng.sample(WORDS, 12)) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)], [(i, int(rule(set(t.split())))) for i, t in enumerate(texts)]


def held_out(i) -> bool:
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_pairs_of_terms(spark):
    """A label that neither term of a pair tells by itself: exactly one of two is there. The additive part alone cannot rank it."""
    rows, labels = labelled(random.Random(1), lambda s: ("w1" in s or "w2" in s) != ("w3" in s or "w4" in s), 3000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    truth = dict(labels)
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    away = [i for i in truth if held_out(i)]
    assert auc([scores[i] for i in away], [truth[i] for i in away]) > 0.97
    model.factors = np.zeros_like(model.factors)
    flat = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert auc([flat[i] for i in away], [truth[i] for i in away]) < 0.8


def test_toxicity_scores_in_plain_python(spark):
    rows, labels = labelled(random.Random(2), lambda s: "w1" in s and "w2" in s or "w5" in s, 600)
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (9002, "W1 w1, (w2)\tW2")], "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    place = {int(h): k for k, h in enumerate(model.terms)}
    number = lambda term: place.get(int(toxicity.document_terms(np.frombuffer(term.encode(), np.uint8), np.array([0, len(term)]))[1][0]))
    known = {w: number(w) for w in WORDS}
    for r in toxicity.score_toxicity(docs, model).collect():
        text = dict(rows).get(r.doc_id, "w1 w2" if r.doc_id == 9002 else "")
        at = [known[w] for w in sorted(set(text.split())) if known[w] is not None]
        total = model.bias + sum(model.weights[k] for k in at) + sum(float(model.factors[a] @ model.factors[b]) for n, a in enumerate(at) for b in at[n + 1:])
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, total)))), abs=1e-9)
        assert r.held_out == held_out(r.doc_id) and r.predicted == int(r.score >= 0.7)


def test_attention_finds_the_one_passage(spark):
    """Documents of many passages of which one holds the words that tell the label; nothing but words differs."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1200):
        good = rng.random() < 0.5
        words = [rng.choice(WORDS[10:]) for _ in range(64 * rng.randrange(2, 9))]
        at = rng.randrange(len(words) // 64) * 64
        words[at:at + 12] = [rng.choice(WORDS[:5] if good else WORDS[5:10]) for _ in range(12)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality_model.fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    out = [r for r in quality_model.score_quality(docs, model).collect() if r.held_out]
    assert auc([r.score for r in out], [dict(labels)[r.doc_id] for r in out]) > 0.97


def some_passages():
    texts = [b"one two three four " * 30, b"", b"Alpha beta! gamma" * 10, b"x"]
    return quality_model.passages(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))


def random_model(rng):
    q = quality_model
    shapes = {"w1": (q.INPUTS, q.CODE), "e": (q.TERMS, q.CODE), "b1": (q.CODE,), "v": (q.CODE, q.GATE), "u": (q.CODE, q.GATE), "w": (q.GATE,), "c": (q.CODE,), "d": ()}
    return q.AttentionModel(np.zeros(q.INPUTS), np.ones(q.INPUTS), **{k: rng.normal(size=s) for k, s in shapes.items()})


def test_attention_scores_in_plain_python():
    x, model = some_passages(), random_model(np.random.default_rng(4))
    p, out = model.p, []
    for a, b in zip(x.before, x.before[1:]):
        codes, strengths = [], []
        for k in range(a, b):
            own = x.terms[x.terms_before[k]:x.terms_before[k + 1]]
            inner = np.clip(x.stats[k], -6, 6) @ p["w1"] + p["b1"] + (sum(p["e"][t] for t in own) / len(own) if len(own) else 0)
            h = np.tanh(inner)
            codes.append(h)
            strengths.append(math.exp(float((np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))) @ p["w"])))
        z = sum(s * h for s, h in zip(strengths, codes)) / sum(strengths)
        out.append(1 / (1 + math.exp(-float(z @ p["c"] + p["d"]))))
    assert x.before.tolist() == [0, 2, 3, 4, 5]
    assert model.scores(x) == pytest.approx(out, abs=1e-6)


def test_gradients():
    x, model = some_passages(), random_model(np.random.default_rng(5))
    labels, weight = np.array([1, 0, 1, 0.0]), np.array([1, 2, 0.5, 1])

    def loss():
        s = model._forward(x)[-1]
        return -(weight * (labels * np.log(s) + (1 - labels) * np.log(1 - s))).mean()

    for name, gradient in model._gradients(x, labels, weight).items():
        gradient, whole = np.asarray(gradient), np.array(model.p[name], float)
        for i in {0, whole.size // 2, int(x.terms[0]) * quality_model.CODE} if name == "e" else {0, whole.size // 2}:
            losses = []
            for step in (1e-5, -1e-5):
                moved = whole.copy().reshape(-1)
                moved[i] += step
                model.p[name] = moved.reshape(whole.shape)
                losses.append(loss())
            model.p[name] = whole
            assert gradient.reshape(-1)[i] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=1e-7)


def test_long_texts_are_learnt_from_whole():
    """Every distinct term and every passage of a text of 20,000 words goes to the fit."""
    text = " ".join(f"x{i}" for i in range(20_000))
    batch = pa.RecordBatch.from_arrays([pa.array([text, "a b", None]), pa.array([1.0, 0.0, 1.0])], ["text", "label"])
    bags = pa.Table.from_batches(toxicity._bags([batch])).column("bag").to_pylist()
    assert [len(b) // 8 for b in bags] == [20_000, 2, 0]
    rows = pa.Table.from_batches(quality_model._passage_rows([batch])).to_pylist()
    assert [len(r["terms"]) // 2 for r in rows] == [20_000, 2, 0]
    assert [len(r["sizes"]) // 2 for r in rows] == [-(-20_000 // quality_model.PASSAGE), 1, 1]


def test_training_budget(spark):
    """Whole documents in hash order while they fit; one that does not is passed over, later ones still count."""
    docs = spark.createDataFrame([(i, "a" * (1000 if i % 4 == 0 else 10)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, toxic int")
    found = [r.text for r in labelled_rows.training_texts(docs, labels, "toxic", 100, 2100).collect()]
    usable = [i for i in range(60) if not held_out(i)]
    assert sum(map(len, found)) <= 2100 and set(map(len, found)) == {10, 1000}
    assert len(found) - 2 <= sum(i % 4 != 0 for i in usable) and found.count("a" * 1000) <= 2
    assert labelled_rows.training_texts(docs, labels, "toxic", 5, 10**6).count() == 5
    assert labelled_rows.training_texts(docs, labels, "toxic", 5, 0).count() == 0


def test_gradients_of_the_factorization_machine():
    rng = np.random.default_rng(9)
    n, terms, k = 7, 6, toxicity.FACTORS
    own, at = np.divmod(np.unique(rng.integers(0, n * terms, 25)), terms)
    w, v, bias = rng.normal(0, 0.5, terms), rng.normal(0, 0.5, (terms, k)), 0.3
    labels, weight = rng.integers(0, 2, n).astype(float), rng.uniform(0.5, 2, n)

    def loss(w, v, bias):
        total = 0.0
        for d in range(n):
            own_terms = at[own == d]
            score = bias + w[own_terms].sum() + sum(float(v[a] @ v[b]) for i, a in enumerate(own_terms) for b in own_terms[i + 1 :])
            total += weight[d] * (math.log1p(math.exp(-score)) if labels[d] else math.log1p(math.exp(score)))
        return total / n

    touched, db, dw, dv = toxicity.gradients(w, v, bias, own, at, labels, weight)
    step = 1e-6
    assert db == pytest.approx((loss(w, v, bias + step) - loss(w, v, bias - step)) / (2 * step), rel=1e-5)
    for i, t in enumerate(touched):
        e = np.eye(terms)[t] * step
        assert dw[i] == pytest.approx((loss(w + e, v, bias) - loss(w - e, v, bias)) / (2 * step), rel=1e-4, abs=1e-8)
        for f in range(k):
            moved = np.zeros((terms, k))
            moved[t, f] = step
            assert dv[i, f] == pytest.approx((loss(w, v + moved, bias) - loss(w, v - moved, bias)) / (2 * step), rel=1e-4, abs=1e-8)
