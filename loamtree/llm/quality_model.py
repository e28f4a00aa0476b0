"""Quality by attention-based multiple-instance learning over passages."""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labelled import held_out, training_texts
from .textbytes import WORD, chunks, gather, mix, owners, word_table

#: Labelled documents learnt from, whole, and bytes of their texts together, of which about half as many reach the driver; words in a passage; hashed terms.
TRAIN_ROWS, TRAIN_BYTES, PASSAGE, TERMS = 6000, 48 << 20, 64, 4096
#: Widths of the passage code and of the attention; steps of documents each; step size; weight decay, of terms too.
CODE, GATE, STEPS, STEP_ROWS, RATE, DECAY, TERM_DECAY = 16, 8, 600, 192, 0.01, 1e-4, 1e-3
THRESHOLD = 0.5

#: Classes of bytes whose shares describe a passage.
_CLASSES = {
    "upper": [*range(65, 91)], "lower": [*range(97, 123)], "digit": [*range(48, 58)], "high": [*range(0xC0, 256)], "stop": [*b".,;:"],
    "bang": [*b"!?"], "mark": [*b"#*$%&"], "bar": [*b"|<>_=/\\~^"], "quote": [*b"\"'()[]{}-+@`"], "newline": [10],
}
_KIND = np.full(256, len(_CLASSES), np.uint8)
for _i, _c in enumerate(_CLASSES.values()):
    _KIND[_c] = _i
INPUTS = len(_CLASSES) + 6


class Passages(NamedTuple):
    """Of some documents: statistics of each passage, the hashed terms of all passages, the terms before each passage and the passages before each document (n+1 each)."""

    stats: np.ndarray
    terms: np.ndarray
    terms_before: np.ndarray
    before: np.ndarray

    def of(self, docs: np.ndarray) -> "Passages":
        """The given documents, in this order."""
        parts = np.diff(self.before)[docs]
        at = gather(np.arange(len(self.stats)), self.before[docs], parts)
        sizes = np.diff(self.terms_before)[at]
        ends = lambda counts: np.concatenate(([0], np.cumsum(counts)))
        return Passages(self.stats[at], gather(self.terms, self.terms_before[at], sizes), ends(sizes), ends(parts))

    @classmethod
    def together(cls, parts: "list[Passages]") -> "Passages":
        """One behind the other."""
        terms, docs = np.cumsum([0] + [p.terms_before[-1] for p in parts]), np.cumsum([0] + [p.before[-1] for p in parts])
        return cls(
            np.concatenate([p.stats for p in parts]), np.concatenate([p.terms for p in parts]),
            np.concatenate([[0], *(p.terms_before[1:] + n for p, n in zip(parts, terms))]), np.concatenate([[0], *(p.before[1:] + n for p, n in zip(parts, docs))]),
        )


def passages(data: np.ndarray, offsets: np.ndarray) -> Passages:
    """The passages of a chunk. A document without words is one passage of zeros."""
    n = len(offsets) - 1
    starts, ends, before, hashes = word_table(data, offsets)
    words = np.diff(before)
    parts = np.maximum(1, -(-words // PASSAGE))
    parts_before = np.concatenate(([0], np.cumsum(parts)))
    doc = np.repeat(np.arange(n), parts)
    first = before[:-1][doc] + PASSAGE * (np.arange(len(doc)) - parts_before[doc])
    last = np.minimum(first + PASSAGE, before[1:][doc])
    count = last - first
    full = count > 0
    lo, hi = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
    lo[full], hi[full] = starts[first[full]], ends[last[full] - 1]

    out = np.zeros((len(doc), INPUTS), np.float32)
    size = np.maximum(hi - lo, 1)
    kind = _KIND[data]
    for i in range(len(_CLASSES)):
        sums = np.concatenate(([0], np.cumsum(kind == i, dtype=np.int32)))
        out[:, i] = np.sqrt((sums[hi] - sums[lo]) / size)
    chars = np.concatenate(([0], np.cumsum(WORD[data] & ((data & 0xC0) != 0x80), dtype=np.int32)))
    some = np.maximum(count, 1)
    own = owners(before)
    passage = parts_before[own] + (np.arange(len(starts)) - before[own]) // PASSAGE if len(starts) else np.zeros(0, np.int64)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    # distinct words of each passage: first places of equal (passage, word) pairs
    _, at = np.unique(mix(hashes + mix(passage.astype(np.uint64))), return_index=True)
    i = len(_CLASSES)
    out[:, i] = (chars[hi] - chars[lo]) / some / 8
    out[:, i + 1] = np.bincount(passage[at], minlength=len(doc)) / some
    out[:, i + 2] = np.bincount(passage[same], minlength=len(doc)) / some
    out[:, i + 3] = np.log1p(count) / 4
    out[:, i + 4] = np.bincount(passage, (ends - starts == 1), len(doc)) / some
    out[:, i + 5] = np.log1p(words)[doc] / 8
    terms = (hashes % np.uint64(TERMS)).astype(np.int64)
    return Passages(out, terms, np.concatenate((first, before[-1:])), parts_before)


class AttentionModel:
    """Passage code h = tanh(W x + mean of the terms' vectors e + b), attention softmax of w . (tanh(V h) * sigmoid(U h)), score = sigmoid(c . sum a h + d)."""

    def __init__(self, mean, scale, **weights):
        self.mean, self.scale = mean, scale
        self.p = weights

    def _forward(self, x: Passages):
        p, before = self.p, x.before
        count = np.diff(x.terms_before)
        some = np.flatnonzero(count)
        inner = x.stats @ p["w1"] + p["b1"]
        if len(some):
            inner[some] += np.add.reduceat(p["e"][x.terms], x.terms_before[some], axis=0) / count[some, None]
        h = np.tanh(inner)
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * s) @ p["w"]
        doc = owners(before)
        e = np.exp(e - np.maximum.reduceat(e, before[:-1])[doc])
        a = e / np.add.reduceat(e, before[:-1])[doc]
        z = np.add.reduceat(a[:, None] * h, before[:-1], axis=0)
        score = z @ p["c"] + p["d"]
        return h, t, s, a, z, doc, 1 / (1 + np.exp(-score.clip(-30, 30)))

    def scores(self, x: Passages) -> np.ndarray:
        """Of documents; every document has at least one passage."""
        return self._forward(self._scaled(x))[-1] if len(x.before) > 1 else np.zeros(0)

    def _scaled(self, x: Passages) -> Passages:
        return x._replace(stats=((x.stats - self.mean) / self.scale).clip(-6, 6))

    @classmethod
    def fit(cls, bags: list[Passages], labels: np.ndarray, seed: int = 11) -> "AttentionModel":
        """By Adam on the documents' logistic loss, both classes weighing the same. Without documents every score is 0.5."""
        rng = np.random.default_rng(seed)
        init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        weights = {"w1": init(INPUTS, CODE), "e": np.zeros((TERMS, CODE)), "b1": np.zeros(CODE), "v": init(CODE, GATE), "u": init(CODE, GATE), "w": np.zeros(GATE), "c": np.zeros(CODE), "d": np.zeros(())}
        if not bags:
            return cls(np.zeros(INPUTS), np.ones(INPUTS), **weights)
        whole = Passages.together(bags)
        model = cls(whole.stats.mean(0, dtype=float), whole.stats.std(0, dtype=float) + 0.02, **weights)
        whole = model._scaled(whole)
        positive = labels.mean()
        weight = np.where(labels > 0, 0.5 / max(positive, 1e-3), 0.5 / max(1 - positive, 1e-3)).clip(max=10)
        moment = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in model.p.items()}
        for step in range(1, STEPS + 1):
            rows = rng.integers(0, len(bags), min(STEP_ROWS, len(bags)))
            grads = model._gradients(whole.of(rows), labels[rows], weight[rows])
            rate = RATE * min(1, 2 * (1 - step / (STEPS + 1)))
            for k, g in grads.items():
                m, q = moment[k]
                g = g + (TERM_DECAY if k == "e" else DECAY) * model.p[k]
                m, q = 0.9 * m + 0.1 * g, 0.999 * q + 0.001 * g * g
                moment[k] = m, q
                model.p[k] = model.p[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
        return model

    def _gradients(self, x: Passages, labels, weight):
        p, before = self.p, x.before
        h, t, s, a, z, doc, score = self._forward(x)
        error = weight * (score - labels) / len(labels)
        dz = error[:, None] * p["c"]
        da = (dz[doc] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, before[:-1])[doc])
        dts = de[:, None] * p["w"]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = a[:, None] * dz[doc] + dt @ p["v"].T + ds @ p["u"].T
        dx = dh * (1 - h * h)
        count = np.diff(x.terms_before)
        each = (dx / np.maximum(count, 1)[:, None])[np.repeat(np.arange(len(count)), count)]
        terms = np.stack([np.bincount(x.terms, each[:, k], TERMS) for k in range(CODE)], axis=1)
        return {"w1": x.stats.T @ dx, "e": terms, "b1": dx.sum(0), "v": h.T @ dt, "u": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ error, "d": error.sum()}


def _passage_rows(batches):
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column("text")):
            found = passages(data, offsets)
            bags = [found.of(np.array([i])) for i in range(hi - lo)]
            columns = [[b.stats.tobytes() for b in bags], [b.terms.astype(np.int16).tobytes() for b in bags], [np.diff(b.terms_before).astype(np.int16).tobytes() for b in bags]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()) for c in columns), batch.column("label").slice(lo, hi - lo)], ["stats", "terms", "sizes", "label"])


def _bag(row) -> Passages:
    stats, sizes = np.frombuffer(row.stats, np.float32).reshape(-1, INPUTS), np.frombuffer(row.sizes, np.int16).astype(np.int64)
    return Passages(stats, np.frombuffer(row.terms, np.int16).astype(np.int64), np.concatenate(([0], np.cumsum(sizes))), np.array([0, len(stats)]))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> AttentionModel:
    """Fitted on the driver from every passage of at most `rows` labelled documents of together at most `most_bytes`."""
    found = training_texts(docs, labels, label, rows, most_bytes).mapInArrow(_passage_rows, "stats binary, terms binary, sizes binary, label double").collect()
    found.sort(key=lambda r: (bytes(r.stats), bytes(r.terms)))  # one order, however Spark read the rows
    return AttentionModel.fit([_bag(r) for r in found], np.array([r.label > 0.5 for r in found], float))


def score_quality(docs: DataFrame, model: AttentionModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= threshold).

    Every passage of the whole text is encoded and weighed where it is read. A
    null or empty text is one passage without words. Repeated rows give a row
    each; no rows give no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            out = [np.zeros(0)]
            for _, _, data, offsets in chunks(batch.column("text")):
                out.append(shared.value.scores(passages(data, offsets)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.concatenate(out))], ["doc_id", "held_out", "score"])

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    scored = named.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_quality_model(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_quality(docs, fit_quality(docs, labels))
