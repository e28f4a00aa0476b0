"""Whitening of embeddings by moments that partitions merge."""

import pickle
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .vectors import matrices

#: What an entry is multiplied with before it is rounded down, what is added then, the largest rounded entry (others are cut to it), components returned.
SCALE, SHIFT, LARGEST, COMPONENTS = 64, 1_000_000, 2**45, 32
#: Eigenvalues of at most this share of the largest, times the length, have no variance but that of rounding.
FLAT = 1e-14


def rounded(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * entry) as long. SHIFT is not added: covariances and deviations do not depend on it, and small numbers lose no digits."""
    with np.errstate(over="ignore"):
        return np.floor(SCALE * vectors).clip(-LARGEST, LARGEST).astype(np.int64)


class Moments(NamedTuple):
    """Of some vectors of one length: their number, the sums of their entries, exact if these are integers, the mean, and the scatter about it."""

    n: int
    sums: list
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> "Moments":
        sums = rows.sum(axis=0)
        mean = sums / len(rows)
        centred = rows - mean
        return cls(len(rows), sums.tolist(), mean, centred.T @ centred)

    def merge(self, other: "Moments") -> "Moments":
        """Chan's formula for the union of two sets of vectors."""
        n = self.n + other.n
        gap = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(gap, gap) * (self.n / n * other.n)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums)], self.mean + gap * (other.n / n), scatter)


def merged(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    """By length of the vectors."""
    return {size: a[size].merge(b[size]) if size in a and size in b else a.get(size) or b[size] for size in {**a, **b}}


def moments(vectors: DataFrame, rows_of, depth: int = 3) -> dict[int, Moments]:
    """Moments of rows_of(matrix of doubles), by length of the vectors, over all that hold no null and no non-finite entry.

    Each partition keeps one state a length; the states, of length squared
    doubles each, meet pairwise in a tree, so the driver merges few of them.
    """

    def states(batches):
        state: dict[int, Moments] = {}
        for batch in batches:
            for _, matrix in matrices(batch.column("embedding")):
                if size := matrix.shape[1]:
                    state = merged(state, {size: Moments.of(rows_of(matrix))})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)])], ["state"])

    found = vectors.select("embedding").mapInArrow(states, "state binary").rdd.map(lambda row: pickle.loads(row.state))
    return found.union(vectors.sparkSession.sparkContext.parallelize([{}], 1)).treeReduce(merged, depth)


class Whitener(NamedTuple):
    """For vectors of one length: of how many vectors, their sums, the mean, projections scaled to unit variance, the share of each component in the variance, and how far the whitened covariance is from the identity."""

    n: int
    sums: list
    mean: np.ndarray
    projection: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @classmethod
    def of(cls, m: Moments, components: int) -> "Whitener":
        """Components come by falling eigenvalue, the entry of largest magnitude positive. One without variance projects to 0."""
        values, columns = np.linalg.eigh(m.scatter / m.n)
        values, columns = values[::-1].clip(min=0), columns[:, ::-1]
        columns = columns * np.where(columns[np.abs(columns).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0)
        real = values > FLAT * len(values) * values[0]
        projection = np.where(real, columns / np.sqrt(np.where(real, values, 1)), 0)
        return cls(m.n, m.sums, m.mean, projection[:, :components], (values / max(np.trace(m.scatter) / m.n, np.finfo(float).tiny))[:components])

    def whiten(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.mean) @ self.projection

    def checked(self, whitened: Moments) -> "Whitener":
        """With the identity error of the moments of all whitened vectors, over the components that have variance."""
        real = np.abs(self.projection).any(axis=0)
        off = (whitened.scatter / whitened.n - np.eye(len(real)))[np.ix_(real, real)]
        return self._replace(identity_error=float(np.abs(off).max(initial=0.0)))

    def deviations(self, rows: np.ndarray) -> list:
        """Exact sum over the entries of (n * entry - sum) squared of each row; null beyond a long."""
        base = [s // self.n for s in self.sums]
        left = [s - self.n * b for s, b in zip(self.sums, base)]
        apart = rows - np.array(base, np.int64)
        if (self.n * (int(np.abs(apart).max(initial=0)) + 1)) ** 2 * len(base) < 2**63:
            return ((self.n * apart - np.array(left)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * apart.astype(object) - np.array(left, object)) ** 2).sum(axis=1)
        return [d if d < 2**63 else None for d in exact]


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, vector_col: str = "embedding") -> dict[int, Whitener]:
    """A whitener for each length of vectors, fitted on all of them in one pass and verified on all of them in a second one.

    Both passes merge states of partitions in a tree; eigenvectors of a matrix
    of length x length are taken on the driver.
    """
    named = vectors.select(F.col(vector_col).alias("embedding"))
    fitted = {size: Whitener.of(m, components) for size, m in moments(named, rounded).items()}
    if not fitted:
        return {}
    shared = vectors.sparkSession.sparkContext.broadcast(fitted)
    found = moments(named, lambda matrix: shared.value[matrix.shape[1]].whiten(rounded(matrix)))
    return {size: w.checked(found[size]) for size, w in fitted.items()}


def whiten(vectors: DataFrame, fitted: dict[int, Whitener], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component from 1, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, of a length without a whitener, or hold null
    or non-finite entries give no rows; neither do no rows. Repeated rows and
    null ids give rows of their own; other columns are ignored. A component
    without variance has whitened 0 and is left out of the identity error.
    Entries beyond 2^45 after scaling are cut to it. A deviation beyond a long
    is null. Rows are whitened where they are read.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(fitted)

    def rows(batches):
        for batch in batches:
            ids = batch.column("vec_id")
            for at, matrix in matrices(batch.column("embedding")):
                if not (w := shared.value.get(matrix.shape[1])):
                    continue
                z = rounded(matrix)
                k = len(w.explained)
                each = np.repeat(np.arange(len(at)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(at[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(each), w.n)), pa.array(w.deviations(z), pa.int64()).take(pa.array(each)),
                        pa.array(w.whiten(z).ravel()), pa.array(np.tile(w.explained, len(at))), pa.array(np.full(len(each), w.identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    return named.mapInArrow(rows, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whiten(vectors, fit_whitening(vectors))
