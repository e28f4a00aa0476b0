"""Toxicity by a factorization machine over hashed terms."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labelled import held_out, training_texts
from .textbytes import byte_hashes, chunks, lower_ascii, owners, runs

#: Labelled documents learnt from, whole, and bytes of their texts together; a distinct term of one sends 8 bytes to the driver.
TRAIN_ROWS, TRAIN_BYTES = 12000, 96 << 20
#: Documents a term must be in to be learnt, factors, rows of a step, step size.
MIN_DOCUMENTS, FACTORS, STEP_ROWS, RATE = 4, 4, 128, 0.25
#: Passes, and what a step takes from a weight and from a row of factors: first to choose terms, then to fit the chosen, of at least SELECT times the largest weight.
CHOOSE, FIT, SELECT = (6, 0.005, 0.02), (40, 0.0, 1e-4), 0.15
THRESHOLD = 0.7

TERM = np.zeros(256, bool)
TERM[[*b"abcdefghijklmnopqrstuvwxyz0123456789'", *range(128, 256)]] = True


def document_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit hash) of every term of a chunk: maximal runs of letters, digits, apostrophes and non-ASCII, A-Z in lower case."""
    data = lower_ascii(data)
    starts, ends, before = runs(TERM[data], offsets)
    return owners(before), byte_hashes(data, starts, ends)


def gradients(w: np.ndarray, v: np.ndarray, bias: float, own: np.ndarray, at: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Of the mean weighted logistic loss of some documents, given as (document, term index) pairs: the terms they have, and the derivatives by the bias and by the weights and factors of these."""
    n, vx = len(labels), v[at]
    total = np.stack([np.bincount(own, vx[:, f], n) for f in range(v.shape[1])], 1)
    score = bias + np.bincount(own, w[at], n) + 0.5 * ((total * total).sum(1) - np.bincount(own, (vx * vx).sum(1), n))
    error = weight * (1 / (1 + np.exp(-score.clip(-30, 30))) - labels)
    touched, local = np.unique(at, return_inverse=True)
    dw = np.bincount(local, error[own], len(touched)) / n
    dv = np.stack([np.bincount(local, error[own] * (total[own, f] - vx[:, f]), len(touched)) for f in range(v.shape[1])], 1) / n
    return touched, error.mean(), dw, dv


class FactorizationMachine:
    """score = sigmoid(bias + sum w_i + sum over pairs of <v_i, v_j>) over the distinct terms of a document.

    Terms are known by their hash alone. Proximal AdaGrad shrinks the weights and
    factors of terms that tell nothing to or near zero; they leave the model, and
    the rest is fitted anew with next to no shrinkage.
    """

    def __init__(self, terms: np.ndarray, weights: np.ndarray, factors: np.ndarray, bias: float):
        self.terms, self.weights, self.factors, self.bias = terms, weights, factors, bias

    @classmethod
    def fit(cls, bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> "FactorizationMachine":
        """bags: the distinct term hashes of each document. Without documents every score is 0.5."""
        empty = cls(np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, FACTORS)), 0.0)
        if not len(bags):
            return empty
        terms, index, counts = np.unique(np.concatenate(bags), return_inverse=True, return_counts=True)
        sizes = np.fromiter(map(len, bags), np.int64, len(bags))
        doc = np.repeat(np.arange(len(bags)), sizes)
        common = counts >= min(MIN_DOCUMENTS, len(bags))
        number = np.cumsum(common) - 1
        keep = common[index]
        doc, index, terms = doc[keep], number[index[keep]], terms[common]
        first = np.searchsorted(doc, np.arange(len(bags) + 1))

        model = cls(terms, np.zeros(len(terms)), np.zeros((len(terms), FACTORS)), 0.0)
        model._descend(doc, index, labels, np.random.default_rng(seed), *CHOOSE)
        size = np.abs(model.weights) + np.linalg.norm(model.factors, axis=1)
        used = size > SELECT * size.max(initial=0)
        number = np.cumsum(used) - 1
        keep = used[index]
        model = cls(terms[used], np.zeros(used.sum()), np.zeros((used.sum(), FACTORS)), 0.0)
        model._descend(doc[keep], number[index[keep]], labels, np.random.default_rng(seed), *FIT)
        return model

    def _descend(self, doc: np.ndarray, index: np.ndarray, labels: np.ndarray, rng, passes: int, lasso: float, group_lasso: float) -> None:
        """Passes over the documents, given as (document, term index) pairs in document order."""
        n = len(self.terms)
        first = np.searchsorted(doc, np.arange(len(labels) + 1))
        w, v = self.weights, rng.normal(0, 0.01, (n, FACTORS))
        gw, gv, gb = np.full(n, 1e-2), np.full((n, FACTORS), 1e-2), 1e-2
        positive = labels.sum() / len(labels)
        bias = float(np.log((positive + 1e-3) / (1 - positive + 1e-3)))
        weight = np.where(labels > 0, 0.5 / max(positive, 1e-3), 0.5 / max(1 - positive, 1e-3)).clip(max=10)
        for _ in range(passes):
            order = rng.permutation(len(labels))
            for lo in range(0, len(order), STEP_ROWS):
                rows = order[lo : lo + STEP_ROWS]
                count = first[rows + 1] - first[rows]
                at = index[np.arange(count.sum()) + np.repeat(first[rows] - (np.cumsum(count) - count), count)]
                own = np.repeat(np.arange(len(rows)), count)
                touched, db, dw, dv = gradients(w, v, bias, own, at, labels[rows], weight[rows])
                gb += db**2
                bias -= RATE * db / np.sqrt(gb)
                if not len(at):
                    continue
                gw[touched] += dw * dw
                gv[touched] += dv * dv
                step = RATE / np.sqrt(gw[touched])
                new = w[touched] - step * dw
                w[touched] = np.sign(new) * np.maximum(np.abs(new) - step * lasso, 0)
                moved = v[touched] - RATE * dv / np.sqrt(gv[touched])
                norm = np.linalg.norm(moved, axis=1, keepdims=True)
                shrink = RATE * group_lasso / np.sqrt(gv[touched].mean(1, keepdims=True))
                v[touched] = moved * np.maximum(1 - shrink / np.maximum(norm, 1e-12), 0)
        self.factors, self.bias = v, bias

    def scores(self, doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
        """Of n documents, from all their (document, term) pairs; repeated terms count once."""
        place = np.searchsorted(self.terms, hashes)
        hit = np.zeros(len(hashes), bool)
        inner = place < len(self.terms)
        hit[inner] = self.terms[place[inner]] == hashes[inner]
        pairs = np.unique(doc[hit] * max(1, len(self.terms)) + place[hit])
        own, at = np.divmod(pairs, max(1, len(self.terms)))
        vx = self.factors[at]
        total = np.stack([np.bincount(own, vx[:, f], n) for f in range(FACTORS)], 1)
        score = self.bias + np.bincount(own, self.weights[at], n) + 0.5 * ((total * total).sum(1) - np.bincount(own, (vx * vx).sum(1), n))
        return 1 / (1 + np.exp(-score.clip(-30, 30)))


def _bags(batches):
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column("text")):
            doc, hashes = document_terms(data, offsets)
            cut = np.searchsorted(doc, np.arange(hi - lo + 1))
            bags = [np.unique(hashes[a:b]).tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bags, pa.binary()), batch.column("label").slice(lo, hi - lo)], ["bag", "label"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> FactorizationMachine:
    """Fitted on the driver from all terms of at most `rows` labelled documents of together at most `most_bytes`."""
    found = training_texts(docs, labels, label, rows, most_bytes).mapInArrow(_bags, "bag binary, label double").collect()
    found.sort(key=lambda r: bytes(r.bag))  # one order, however Spark read the rows
    return FactorizationMachine.fit([np.frombuffer(r.bag, np.uint64) for r in found], np.array([r.label > 0.5 for r in found], float))


def score_toxicity(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= threshold).

    Whole texts are scored where they are read; the model's size is bounded by
    the training rows. A null or empty text has no terms and gets the score of
    the bias. Repeated rows give a row each; no rows give no rows; other columns
    are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            out = [np.zeros(0)]
            for lo, hi, data, offsets in chunks(batch.column("text")):
                out.append(shared.value.scores(*document_terms(data, offsets), hi - lo))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.concatenate(out))], ["doc_id", "held_out", "score"])

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    scored = named.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_toxicity(docs, fit_toxicity(docs, labels))
