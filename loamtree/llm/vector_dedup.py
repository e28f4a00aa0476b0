"""Near-duplicate vectors by sorted projection passes, and their exact number of links."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import FloatType

from .components import connected_components
from .store import mark, materialize, small_side
from .vectors import matrices

THRESHOLD = 0.9
#: Hash bits of a sort key, vectors that one is compared with on either side, share of the pairs at the threshold that the passes are to find.
BITS, WINDOW, RECALL = 64, 512, 0.98
#: Rows of a sorted partition, passes that one job makes.
PARTITION, PASSES_AT_ONCE = 1 << 18, 8
#: Bytes of a block of vectors that meets another one, blocks of a component that meet in one task.
BLOCK_BYTES, TOGETHER = 512 << 10, 8
#: Members from which a component is searched for balls, rounds of that, sampled members a pivot is made of.
BALL_FROM, BALL_ROUNDS, PIVOT_SAMPLE = 256, 4, 64
#: Cosines this near a bound of the triangle inequality do not rely on it.
MARGIN = 1e-9


def passes_for(vectors: int, threshold: float, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold has met in a window with a probability of `recall`, if vectors are spread evenly.

    One hash bit of two vectors differs with a probability of their angle over
    pi. A window spans the vectors that share log2(vectors / window) bits.
    """
    bits = math.log2(max(2.0, vectors / window))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def points(vectors: DataFrame, kind: str, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, point: the bytes of each vector, scaled by a power of two so that squares neither overflow nor vanish. Null where the vector is null, zero, or holds null or non-finite components, or where the id is null."""

    def rows(batches):
        for batch in batches:
            out: list[bytes | None] = [None] * len(batch)
            for at, matrix in matrices(batch.column("embedding")):
                most = np.abs(matrix).max(axis=1, initial=0)
                some = most > 0
                scaled = np.ldexp(matrix[some], -np.frexp(most[some])[1][:, None]) + 0.0
                for i, row in zip(at[some].tolist(), scaled.astype(kind)):
                    out[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "point"])

    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).mapInArrow(rows, "vec_id long, point binary")
    return named.withColumn("point", F.when(F.col("vec_id").isNotNull(), F.col("point")))


def by_length(column: list[bytes], kind: str):
    """(places, matrix of doubles) of the points of each length."""
    sizes = np.fromiter(map(len, column), np.int64, len(column))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join([column[i] for i in at]), kind).reshape(len(at), -1).astype(float)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / (np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1)))


def sort_keys(matrix: np.ndarray, passes: int, seed: int = 13) -> list[np.ndarray]:
    """For each pass the signs of BITS random projections as one integer, whose order is that of the concatenated bits."""
    keys = []
    for p in range(passes):
        planes = np.random.default_rng([seed, p, matrix.shape[1]]).standard_normal((matrix.shape[1], BITS))
        bits = np.packbits(matrix @ planes > 0, axis=1)
        keys.append((bits.copy().view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64))
    return keys


def _keyed(distinct: DataFrame, passes: int, kind: str) -> DataFrame:
    def rows(batches):
        for batch in batches:
            column, keys = batch.column("point").to_pylist(), np.zeros((passes, len(batch)), np.int64)
            for at, matrix in by_length(column, kind):
                keys[:, at] = sort_keys(matrix, passes)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, keys)], [*batch.schema.names, *(f"k{p}" for p in range(passes))])

    return distinct.mapInArrow(rows, "rep long, first long, copies long, point binary, " + ", ".join(f"k{p} long" for p in range(passes)))


def stars(matrix: np.ndarray, ids: np.ndarray, new: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of a window, of which the last `new` have not met the others: each linked row and the smallest id that links of the new rows join it with."""
    near = cosines(matrix[len(matrix) - new :], matrix) >= threshold
    near[np.arange(new), np.arange(len(matrix) - new, len(matrix))] = False
    mine, theirs = np.nonzero(near)
    mine = mine + len(matrix) - new
    label = ids.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, mine, label[theirs])
        np.minimum.at(label, theirs, label[mine])
        if (label == before).all():
            break
    moved = np.flatnonzero(label != ids)
    return ids[moved], label[moved]


def _pass(keyed: DataFrame, p: int, parts: int, window: int, threshold: float, kind: str) -> DataFrame:
    """a, b of the links found in the windows of one pass; and the rows at both ends of each partition, with the number of the border they are at."""

    def windows(batches):
        from pyspark import TaskContext

        here, ids, column, head = TaskContext.get().partitionId(), np.zeros(0, np.int64), [], 0
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("border", pa.int64()), ("rep", pa.int64()), ("point", pa.binary())])

        def links(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.nulls(len(a), f.type) for f in list(schema)[2:])], schema=schema)

        def border(number, reps, rows):
            return pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()), pa.array(np.full(len(rows), number)), pa.array(reps), pa.array(rows, pa.binary())], schema=schema)

        for batch in batches:
            reps, rows = batch.column("rep").to_numpy(), batch.column("point").to_pylist()
            if head < window:
                yield border(here - 1, reps[: window - head], rows[: window - head])
                head += min(len(rows), window - head)
            for lo in range(0, len(rows), window):
                ids, column = np.concatenate([ids, reps[lo : lo + window]]), column + rows[lo : lo + window]
                new = len(rows[lo : lo + window])
                for at, matrix in by_length(column, kind):
                    yield links(*stars(matrix, ids[at], int((at >= len(column) - new).sum()), threshold))
                ids, column = ids[-window:], column[-window:]
        yield border(here, ids, column)

    by = [F.octet_length("point"), F.col(f"k{p}"), F.col("rep")]
    dealt = keyed.select("rep", "point", f"k{p}").repartitionByRange(parts, *by).sortWithinPartitions(*by).select("rep", "point")
    return dealt.mapInArrow(windows, "a long, b long, border long, rep long, point binary").withColumn("pass", F.lit(p))


def near_links(keyed: DataFrame, n: int, passes: int, window: int, threshold: float, kind: str) -> DataFrame:
    """a, b: links that join the same vectors as all links that the windows of all passes hold."""

    def at_border(table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_numpy()
        found = [stars(matrix, ids[at], len(at), threshold) for at, matrix in by_length(table.column("point").to_pylist(), kind)]
        return pa.table({"a": np.concatenate([f[0] for f in found]), "b": np.concatenate([f[1] for f in found])})

    parts = max(1, -(-n // PARTITION), min(-(-n // 8192), keyed.sparkSession.sparkContext.defaultParallelism))
    links = None
    for first in range(0, passes, PASSES_AT_ONCE):
        made = None
        for p in range(first, min(first + PASSES_AT_ONCE, passes)):
            one = _pass(keyed, p, parts, window, threshold, kind)
            made = made.unionByName(one) if made is not None else one
        made = materialize(made, "passes")
        found = made.filter("a IS NOT NULL").select("a", "b")
        met = made.filter("border IS NOT NULL").select("pass", "border", "rep", "point").groupBy("pass", "border").applyInArrow(at_border, "a long, b long")
        found = found.unionByName(met).distinct()
        links = links.unionByName(found) if links is not None else found
    return links


def with_balls(members: DataFrame, threshold: float, kind: str) -> DataFrame:
    """members with ball: 0, or the number of a ball of its component, all of whose vectors are linked with each other.

    A pivot is the mean of sampled members near one of them; its ball has the
    members within half the angle of the threshold, so any two of them are
    linked by the triangle inequality, however many they are.
    """
    half = math.cos(math.acos(threshold) / 2) + MARGIN

    def pivots(batches):
        for batch in batches:
            out = []
            for sample in batch.column("sample").to_pylist():
                rows = np.frombuffer(b"".join(sample), kind).reshape(len(sample), -1).astype(float)
                rows /= np.sqrt((rows * rows).sum(axis=1))[:, None]
                out.append(rows[rows @ rows[0] >= threshold].mean(axis=0).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("component"), pa.array(out, pa.binary())], ["component", "pivot"])

    def inside(number):
        def mark_members(batches):
            for batch in batches:
                ball = np.array(batch.column("ball"), copy=True)
                pivot, column = batch.column("pivot").to_pylist(), batch.column("point").to_pylist()
                free = np.flatnonzero([b == 0 and p is not None for b, p in zip(ball.tolist(), pivot)])
                if len(free):
                    for at, matrix in by_length([column[i] for i in free], kind):
                        centre = np.frombuffer(b"".join([pivot[free[i]] for i in at]), "<f8").reshape(len(at), -1)
                        cosine = (matrix * centre).sum(axis=1) / np.sqrt((matrix * matrix).sum(axis=1) * (centre * centre).sum(axis=1))
                        ball[free[at[cosine >= half]]] = number
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("component", "rep", "copies", "point", "k0")), pa.array(ball)], ["component", "rep", "copies", "point", "k0", "ball"])

        return mark_members

    members = members.withColumn("ball", F.lit(0))
    for number in range(1, BALL_ROUNDS + 1):
        free = members.filter("ball = 0")
        salted = free.groupBy("component", F.pmod(F.xxhash64("rep"), F.lit(PIVOT_SAMPLE)).alias("salt")).agg(F.count(F.lit(1)).alias("n"), F.min_by("point", F.xxhash64("rep", F.lit("pivot"))).alias("point"))
        large = salted.groupBy("component").agg(F.sum("n").alias("n"), F.collect_list("point").alias("sample")).filter(F.col("n") >= BALL_FROM)
        found = materialize(large.select("component", "sample").mapInArrow(pivots, "component long, pivot binary"), "pivots")
        if not found.take(1):
            break
        members = materialize(members.join(small_side(found, 100_000), "component", "left").mapInArrow(inside(number), "component long, rep long, copies long, point binary, k0 long, ball int"), "balls")
    return members


def link_counts(members: DataFrame, threshold: float, kind: str) -> DataFrame:
    """rep, links: how many vectors of its component each is linked with, its own copies among them, all pairs compared but those within a ball.

    Vectors outside balls go in blocks, in the order of the first pass. Blocks
    of one component meet in a grid of buckets, a few blocks a task; members of
    a ball meet only those outside it. n vectors outside balls cost n squared
    comparisons inside their component and no row a pair.
    """

    def blocks(batches):
        """Runs of sorted rows of one component and ball. Those outside balls are compared with themselves at once."""
        from pyspark import TaskContext

        task, made, held, key, out, size = TaskContext.get().partitionId(), 0, [], None, [], 0

        def block():
            reps, copies, rows = zip(*held)
            own = np.zeros(len(rows), np.int64)
            if key[1] == 0:
                matrix = np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(float)
                near = cosines(matrix, matrix) >= threshold
                np.fill_diagonal(near, True)
                own = near @ np.array(copies, np.int64)
            return {"component": key[0], "ball": key[1], "block": (task << 32) + made, "reps": reps, "copies": copies, "points": b"".join(rows), "links": own.tolist()}

        schema = pa.schema([("component", pa.int64()), ("ball", pa.int32()), ("block", pa.int64()), ("reps", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("points", pa.binary()), ("links", pa.list_(pa.int64()))])
        for batch in batches:
            for component, ball, rep, copies, point in zip(*(batch.column(c).to_pylist() for c in ("component", "ball", "rep", "copies", "point"))):
                if held and (key != (component, ball) or (len(held) + 1) * len(point) > BLOCK_BYTES):
                    out.append(block())
                    made, size, held = made + 1, size + len(out[-1]["points"]), []
                    if size > 4 * BLOCK_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
                key = component, ball
                held.append((rep, copies, point))
        if held:
            out.append(block())
        yield pa.RecordBatch.from_pylist(out, schema)

    by = ["component", "ball", "k0", "rep"]
    dealt = members.select(*by, "copies", "point").repartitionByRange(*by).sortWithinPartitions(*by)
    made = materialize(dealt.mapInArrow(blocks, "component long, ball int, block long, reps array<long>, copies array<long>, points binary, links array<long>"), "blocks")
    balls = members.filter("ball > 0").groupBy("component", "ball").agg(F.sum("copies").alias("links"))
    counted = made.filter("ball = 0").select(F.explode(F.arrays_zip("reps", "links")).alias("x")).select("x.reps", "x.links").toDF("rep", "links")
    in_balls = members.filter("ball > 0").select("component", "ball", "rep").join(balls, ["component", "ball"]).select("rep", "links")

    counts = materialize(made.groupBy("component").agg(
        F.count_if(F.col("ball") == 0).alias("loose"), F.count_if(F.col("ball") > 0).alias("dense"), F.count_distinct(F.when(F.col("ball") > 0, F.col("ball"))).alias("balls"),
    ).filter("loose > 1 OR balls > 1 OR (loose > 0 AND dense > 0)"), "grids")
    out = counted.unionByName(in_balls)
    if counts.take(1):
        buckets = lambda c: F.ceil(F.col(c) / TOGETHER).cast("int")
        grid = made.join(small_side(counts), "component").withColumns({"loose": buckets("loose"), "dense": buckets("dense")})
        side = F.when(F.col("ball") == 0, F.col("loose")).otherwise(F.col("dense"))
        own = F.pmod(F.xxhash64("block"), F.greatest(side, F.lit(1))).cast("int") + F.when(F.col("ball") == 0, 0).otherwise(F.col("loose"))
        # buckets of loose blocks come before those of dense ones; two of dense ones meet only where there are several balls
        others = F.sequence(F.lit(0), F.col("loose") + F.when((F.col("ball") == 0) | (F.col("balls") > 1), F.col("dense")).otherwise(0) - 1)
        grid = grid.withColumn("bucket", own).filter((F.col("ball") == 0) | (F.col("loose") > 0) | (F.col("balls") > 1)).withColumn("other", F.explode(others))
        grid = grid.withColumns({"lo": F.least("bucket", "other"), "hi": F.greatest("bucket", "other")}).select("component", "lo", "hi", "bucket", "ball", "block", "reps", "copies", "points")

        def meet(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: r["block"])
            links = {r["block"]: np.zeros(len(r["reps"]), np.int64) for r in rows}
            matrix = {r["block"]: np.frombuffer(r["points"], kind).reshape(len(r["reps"]), -1).astype(float) for r in rows}
            for i, a in enumerate(rows):
                for b in rows[i + 1 :]:
                    if (a["lo"] == a["hi"] or a["bucket"] != b["bucket"]) and (a["ball"] == 0 or a["ball"] != b["ball"]):
                        near = cosines(matrix[a["block"]], matrix[b["block"]]) >= threshold
                        links[a["block"]] += near @ np.array(b["copies"], np.int64)
                        links[b["block"]] += near.T @ np.array(a["copies"], np.int64)
            reps = [x for r in rows for x in r["reps"]]
            found = np.concatenate([links[r["block"]] for r in rows])
            some = found > 0
            return pa.table({"rep": np.array(reps, np.int64)[some], "links": found[some]})

        out = out.unionByName(grid.groupBy("component", "lo", "hi").applyInArrow(meet, "rep long, links long"))
    return out.groupBy("rep").agg(F.sum("links").alias("links"))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept (vec_id = component_id).

    Vectors of one length are linked if their cosine, in doubles, is at least
    `threshold`. Vectors of the same bytes go as one with a multiplicity. Each
    pass sorts them by the concatenated signs of random projections and compares
    each with `window` neighbours on either side; links of all passes are
    united. The components that come of it are then compared within, so every
    link inside a component counts, also those that no window held.

    A vector that is null, zero, or holds null or non-finite components, or has
    no id, links with nothing and stays; with a null id component_id is null.
    Repeated rows are vectors of their own with one id, all of them kept if the
    id is. Vectors of different lengths never link. No rows give no rows. Other
    columns are ignored.
    """
    begin = mark()
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "<f8"
    rows = materialize(points(vectors, kind, id_col, vector_col), "points")
    copies = rows.filter("point IS NOT NULL").groupBy("point").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    distinct = materialize(copies.select(F.monotonically_increasing_id().alias("rep"), "first", "copies", "point"), "distinct")
    n = distinct.count()
    passes = passes_for(n, threshold, window)
    keyed = materialize(_keyed(distinct, passes, kind), "keyed")
    components = connected_components(near_links(keyed, n, passes, window, threshold, kind)).select(F.col("node").alias("rep"), F.col("label").alias("component"))
    members = materialize(keyed.select("rep", "first", "copies", "point", "k0").join(components, "rep"), "members")
    counts = link_counts(with_balls(members.select("component", "rep", "copies", "point", "k0"), threshold, kind), threshold, kind)
    smallest = members.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = materialize(members.select("rep", "component", "point").join(smallest, "component").join(counts, "rep").select("point", "component_id", "links"), "linked")
    alone = distinct.filter("copies > 1").select("point", F.col("first").alias("component_id"), F.col("copies").alias("links")).join(linked.select("point"), "point", "left_anti")
    joined = rows.join(linked.unionByName(alone), "point", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    out = joined.select("vec_id", (F.coalesce("links", F.lit(1)) - 1).alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return materialize(out, "near-vectors", since=begin)


def op13_vector_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
