"""Centroid clustering of quantised vectors, each distinct one once with its multiplicity."""

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import mark, materialize
from .vectors import matrices

#: What a component is multiplied with before it is rounded down, components of a vector, the largest rounded component (others are cut to it, so that squared distances are longs), clusters, rounds.
SCALE, WIDTH, LARGEST, CLUSTERS, ROUNDS = 64, 64, 2**26, 16, 3


def quantised(vectors: DataFrame, width: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, point: the rounded components as little-endian 32-bit integers, of each vector of `width` components, none null or non-finite."""

    def rows(batches):
        for batch in batches:
            for at, matrix in matrices(batch.column("embedding")):
                if matrix.shape[1] == width:
                    points = np.floor(SCALE * matrix).clip(-LARGEST, LARGEST).astype("<i4")
                    flat = pa.Array.from_buffers(pa.binary(4 * width), len(at), [None, pa.py_buffer(points)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), flat], ["vec_id", "point"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).mapInArrow(rows, "vec_id long, point binary")


def points_of(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width).astype(np.int64)


class Centroids(NamedTuple):
    """Integer centroids, one a row."""

    at: np.ndarray

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and exact squared distance of the nearest centroid of each point; of several the smallest number."""
        most = max(int(np.abs(points).max(initial=0)), int(np.abs(self.at).max(initial=0)))
        kind = np.float64 if 4 * points.shape[1] * most * most < 2**53 else np.int64  # doubles hold these integers exactly, and multiply faster
        p, c = points.astype(kind), self.at.astype(kind)
        distances = (p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)
        nearest = distances.argmin(axis=1)
        return nearest, distances[np.arange(len(p)), nearest].astype(np.int64)

    def moved(self, distinct: DataFrame) -> "Centroids":
        """Each centroid with points at the floor of their weighted mean. A task sends one row of sums a cluster."""
        width = self.at.shape[1]

        def sums(batches):
            total, count = np.zeros_like(self.at), np.zeros(len(self.at), np.int64)
            for batch in batches:
                points, copies = points_of(batch.column("point"), width), batch.column("copies").to_numpy()
                cluster, _ = self.nearest(points)
                for k in np.unique(cluster):
                    own = cluster == k
                    total[k] += copies[own] @ points[own]
                    count[k] += copies[own].sum()
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "count", "sums"])

        parts = distinct.select("point", "copies").mapInArrow(sums, "cluster int, count long, sums array<long>")
        whole = parts.groupBy("cluster").agg(F.sum("count").alias("count"), F.array(*(F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")) for i in range(width))).alias("sums")).collect()
        at = self.at.copy()
        for row in whole:
            at[row.cluster] = [int(s) // row["count"] for s in row.sums]
        return Centroids(at)

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.at.tolist()]


def first_centroids(points: DataFrame, clusters: int, width: int) -> Centroids:
    """The points whose ids have the smallest SHA-256 of "1:<id>", in that order; of one id the smallest bytes first. Null ids start no centroid."""
    hashed = points.filter("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("hash"), "point")
    chosen = hashed.orderBy("hash", "point").limit(clusters).collect()
    return Centroids(np.frombuffer(b"".join(bytes(r.point) for r in chosen), "<i4").reshape(-1, width).astype(np.int64))


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector of `width` components: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Equal quantised vectors are one row with a multiplicity, written once; the
    rounds read only these, and their assignments are joined back by the
    quantised bytes. A vector that very many share is counted before it is
    shuffled, and Spark splits its partition of the last join.

    Vectors that are null, of another length, or hold null or non-finite
    components give no rows; neither do no rows. With fewer vectors than
    clusters there are fewer clusters; without any id there is none, and no
    rows. Repeated rows and null ids are vectors of their own. Components
    beyond 2^26 after scaling are cut to it. Other columns are ignored.
    """
    begin = mark()
    points = quantised(vectors, width, id_col, vector_col)
    distinct = materialize(points.groupBy("point").agg(F.count(F.lit(1)).alias("copies")), "quantised")
    centroids = first_centroids(points, clusters, width)
    schema = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids.at):
        return vectors.sparkSession.createDataFrame([], "vec_id long, " + schema)
    for _ in range(rounds):
        centroids = centroids.moved(distinct)

    def assign(batches):
        for batch in batches:
            cluster, distance = centroids.nearest(points_of(batch.column("point"), width))
            yield pa.RecordBatch.from_arrays([batch.column("point"), batch.column("copies"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["point", "copies", "cluster", "distance"])

    assigned = materialize(distinct.mapInArrow(assign, "point binary, copies long, cluster int, distance long"), "assigned", since=begin)
    inertia = {r.cluster: int(r.inertia) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("copies")).alias("inertia")).collect()}
    digests, total = centroids.digests(), sum(inertia.values())
    lines = [(k, _long(inertia[k]), _long(total), digests[k]) for k in sorted(inertia)]
    known = vectors.sparkSession.createDataFrame(lines, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = points.join(assigned.select("point", "cluster", "distance"), "point").join(F.broadcast(known), "cluster")
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _long(value: int) -> int | None:
    return value if value < 2**63 else None


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    entries = range(WIDTH)
    apart = "CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    parts = [
        f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, q FROM v QUALIFY k < {CLUSTERS})",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS (SELECT v.vec_id, any_value(v.q) AS q, min({{'d': {apart}, 'k': c.k}}) AS near FROM v CROSS JOIN c{i} AS c GROUP BY v.vec_id)")
        if i < ROUNDS:
            means = ", ".join(f"CAST(floor(sum(q[{j + 1}]) / count(*)) AS BIGINT)" for j in entries)
            parts.append(f"c{i + 1} AS (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{i} AS c LEFT JOIN (SELECT near.k AS k, [{means}] AS q FROM a{i} GROUP BY near.k) AS m ON m.k = c.k)")
    last = f"a{ROUNDS}"
    return (
        "WITH " + ", ".join(parts) + f""" SELECT vec_id, CAST(near.k AS INTEGER) AS cluster, near.d AS distance, CAST(sum(near.d) OVER (PARTITION BY near.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(near.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM {last} JOIN c{ROUNDS} AS c ON c.k = near.k"""
    )


OP12_SQL = _sql()
