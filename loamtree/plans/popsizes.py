"""Population sizes by grid time from trees that count as independent: Spark counts lineages, and each of the few sums is solved by itself."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import nearest_time, time_steps
from ..operators.forest import nested
from ..operators.ordered import TILE, with_tile
from ..operators.spr import in_slices
from ..operators.trees import internal_ages, lineages, n_leaves
from .priors import coalescent_probability, merged_intervals


def transitions(trees: DataFrame, grid: list[float], keys: list[str] = ()) -> DataFrame:
    """keys, time_bin, a, b, n: in how many trees a lineages enter the interval around a grid time and b leave it."""
    counted = trees.select(*keys, n_leaves("ptree").alias("leaves"), lineages(grid).alias("x")).select(*keys, "leaves", F.col("x.branches").alias("c"))
    pairs = F.transform(F.slice("c", 1, len(grid) - 1), lambda b, j: F.struct(F.when(j == 0, F.col("leaves")).otherwise(F.get("c", j - 1)).alias("a"), b.alias("b")))
    rows = counted.select(*keys, F.posexplode(pairs).alias("time_bin", "x")).select(*keys, "time_bin", "x.a", "x.b")
    return rows.groupBy(*keys, "time_bin", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def likeliest_size(counts: list[tuple[int, int, int]], t: float, low: float = 1e-3, high: float = 1e9) -> float | None:
    """The size, a pair joining at rate 1 / size, that makes counts (a, b, n) after a time t likeliest; null where no lineage joins. Golden section in the logarithm, between the bounds."""
    if all(a == b for a, b, _ in counts):
        return None

    def loss(x: float) -> float:
        return -sum(n * math.log(max(coalescent_probability(a, b, t, math.exp(x)), 1e-200)) for a, b, n in counts)

    ratio = (math.sqrt(5) - 1) / 2
    lo, hi = math.log(low), math.log(high)
    one, two = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    f_one, f_two = loss(one), loss(two)
    while hi - lo > 1e-9:
        if f_one <= f_two:
            hi, two, f_two = two, one, f_one
            one = hi - ratio * (hi - lo)
            f_one = loss(one)
        else:
            lo, one, f_one = one, two, f_two
            two = lo + ratio * (hi - lo)
            f_two = loss(two)
    return math.exp((lo + hi) / 2)


def likeliest_sizes(trees: DataFrame, grid: list[float], keys: list[str] = ()) -> DataFrame:
    """keys, time_bin, popsize by likeliest_size(). A group is the distinct (a, b) of a grid time with their counts, not the trees."""
    spans, _ = merged_intervals(grid, [1.0] * len(grid))
    counts = transitions(trees, grid, keys)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.select(*keys, "time_bin").schema) + ", popsize double"

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        found = rows[[*keys, "time_bin"]].head(1)
        return found.assign(popsize=likeliest_size([(int(a), int(b), int(n)) for a, b, n in zip(rows.a, rows.b, rows.n)], spans[int(rows.time_bin.iloc[0])]))

    return counts.groupBy(*keys, "time_bin").applyInPandas(solve, schema)


def size_with_prior(n_coal: int, lineage_time: float, mu: float, sigma: float) -> float:
    """The likeliest size with a normal prior: the root between 0 and 2 mu of -x^3 / sigma^2 + mu x^2 / sigma^2 - n_coal x + lineage_time / 2; mu where the ends have one sign."""
    f = lambda x: -(x**3) / sigma**2 + mu * x * x / sigma**2 - n_coal * x + lineage_time / 2
    lo, hi = 0.0, 2.0 * mu
    if f(lo) * f(hi) > 0:
        return mu
    for _ in range(200):
        middle = (lo + hi) / 2
        lo, hi = (middle, hi) if f(lo) * f(middle) > 0 else (lo, middle)
    return (lo + hi) / 2


def sizes_with_prior(trees: DataFrame, grid: list[float], mu: float, sigma: float, keys: list[str] = ()) -> DataFrame:
    """keys, time_bin, n_coal, n_lineages, popsize by size_with_prior(): the joints at each grid time, and the lineages that span the interval behind it."""
    steps = time_steps(grid)
    counts = transitions(trees, grid, keys)
    sums = counts.groupBy(*keys, "time_bin").agg(F.sum(F.col("n") * (F.col("a") - F.col("b"))).alias("n_coal"), F.sum(F.col("n") * F.col("b")).alias("n_lineages"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.schema) + ", popsize double"

    def solve(batches):
        for rows in batches:
            yield rows.assign(popsize=[size_with_prior(int(c), steps[int(j)] * int(k), mu, sigma) for j, c, k in zip(rows.time_bin, rows.n_coal, rows.n_lineages)])

    return sums.mapInPandas(solve, schema)


def in_windows(trees: DataFrame, width: int, step: int) -> DataFrame:
    """Trees with each window [window, window + width), a multiple of `step`, that their block's start is in: keys for the functions above."""
    last = F.floor(F.col("start") / step)
    first = F.greatest(F.floor((F.col("start") - width) / step) + 1, F.lit(0))
    return trees.withColumn("window", F.explode(F.transform(F.sequence(first, last), lambda i: i * step)))


#: Edits of tiles that are taken at once.
ROWS = 1 << 18


def _running(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Sums of the rows before each one in its group; groups are together."""
    before = np.cumsum(rows, axis=0) - rows
    return before - before[np.searchsorted(group, group)]


def _sums_of_tiles(bins: int):
    """Of each tile by time: the edits that join, those that count there, by how much they change the lineages, and what those that count make of the changes in the tile before them and of their own."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
        x, tile = batch.column("x").flatten(), np.repeat(np.arange(len(sizes)), sizes)
        pos, *times = (x.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "r", "p", "c"))
        order = np.lexsort((*times[::-1], pos, tile))
        j, (r, p, c) = np.arange(bins), (t[order][:, None] for t in times)
        change = (p <= j).astype(np.int64) - (c <= j)
        counts = (r <= j) & (c > j)
        own = counts * (_running(change, tile) - (p > j))
        first = np.cumsum(sizes) - sizes
        sums = [np.add.reduceat(m.astype(np.int64), first, axis=0).ravel() for m in (c == j, counts, change, own)]
        lists = [nested(pa.array(m, kind), np.full(len(sizes), bins)) for m, kind in zip(sums, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("sample", "chrom", "tile")), *lists], ["sample", "chrom", "tile", "coal", "counts", "change", "own"])

    def fold(batches):
        for batch in batches:
            yield from map(of, in_slices(batch, "x", ROWS))

    return fold


def _sums_of_histories(grid: list[float]):
    """One row a time of all histories of a batch, from their first trees and the sums of their tiles."""
    times, bins = np.array(grid), len(grid) - 1

    def fold(batches):
        for batch in batches:
            trees, tiles = batch.column("trees"), batch.column("tiles")
            n_trees, n_tiles = (c.value_lengths().to_numpy(zero_copy_only=False) for c in (trees, tiles))
            if not n_trees.sum():
                continue
            ages, leaves = trees.flatten().field("ages"), trees.flatten().field("n").to_numpy(zero_copy_only=False)
            near = np.minimum(np.abs(ages.flatten().to_numpy(zero_copy_only=False)[:, None] - times).argmin(axis=1), bins - 1)
            joints = np.zeros((len(leaves), bins), np.int64)
            np.add.at(joints, (np.repeat(np.arange(len(leaves)), ages.value_lengths().to_numpy(zero_copy_only=False)), near), 1)
            below = np.cumsum(joints, axis=1)
            lines = leaves[:, None] - below
            # above a first tree's root there is one line that counts for nothing
            coal, lineages = joints.sum(axis=0), np.where(below < below[:, -1:], lines, 0).sum(axis=0)
            history = np.repeat(np.arange(len(n_tiles)), n_tiles)
            found = tiles.flatten()
            order = np.lexsort((found.field("tile").to_numpy(zero_copy_only=False), history))
            made, counts, change, own = (found.field(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, bins)[order] for c in ("coal", "counts", "change", "own"))
            of_trees = np.zeros((len(n_trees), bins), np.int64)
            np.add.at(of_trees, np.repeat(np.arange(len(n_trees)), n_trees), lines)
            k = n_trees[history][:, None]
            coal = coal + (k * made).sum(axis=0)
            lineages = lineages + (counts * of_trees[history] + k * (counts * _running(change, history) + own)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(bins), pa.int32()), pa.array(coal, pa.int64()), pa.array(lineages, pa.int64())], ["time_bin", "n_coal", "n_lineages"])

    return fold


def transitions_in_windows(trees: DataFrame, grid: list[float], width: int, step: int) -> DataFrame:
    """window, time_bin, a, b, n: transitions() of the windows of in_windows(). Windows begin and end between tiles of gcd(width, step), in which trees are counted once; counts, not trees, go to each window."""
    tile = math.gcd(width, step)
    counts = transitions(trees.withColumn("start", F.floor(F.col("start") / tile) * tile), grid, ["start"])
    return in_windows(counts, width, step).groupBy("window", "time_bin", "a", "b").agg(F.sum("n").alias("n"))


def counts_from_edits(first_trees: DataFrame, edits: DataFrame, grid: list[float], width: int = TILE) -> DataFrame:
    """time_bin, n_coal, n_lineages of whole histories, without a tree a block.

    first_trees: sample, chrom, ptree, age of each history's first tree. edits:
    sample, chrom, pos, recomb_time, broken_time (the age of the joint that the
    cut leaves) and coal_time. The lineages at a time are the leaves less the
    joints up to it, so an edit changes them by one between two times, and the
    counts before each edit are running sums of its predecessors. An edit counts
    at the times from its cut to where it joins, for each the lineages other
    than the cut one; a first tree counts with all its branches but the one
    above the root. Times are grid times, the nearest. Running sums are made in
    tiles, for all tiles of an Arrow batch at once; a history is a row a tile,
    with which those of the earlier ones and the first tree come in.
    """
    top, keys = len(grid) - 2, ["sample", "chrom"]
    at = lambda c: F.least(nearest_time(F.col(c), grid), F.lit(top))
    placed = with_tile(edits.dropna(subset=keys).select(*keys, "pos", at("recomb_time").alias("r"), at("broken_time").alias("p"), at("coal_time").alias("c")), "pos", width)
    lists = placed.groupBy(*keys, "tile").agg(F.collect_list(F.struct("pos", "r", "p", "c")).alias("x"))
    sums = "coal array<int>, counts array<int>, change array<int>, own array<long>"
    tiles = lists.mapInArrow(_sums_of_tiles(top + 1), f"sample {dict(edits.dtypes)['sample']}, chrom {dict(edits.dtypes)['chrom']}, tile long, {sums}")
    first = first_trees.select(*keys, F.struct(n_leaves("ptree").alias("n"), internal_ages().alias("ages")).alias("tree"))
    rows = first.unionByName(tiles.select(*keys, F.struct("tile", "coal", "counts", "change", "own").alias("part")), allowMissingColumns=True)
    histories = rows.groupBy(*keys).agg(F.collect_list("tree").alias("trees"), F.collect_list("part").alias("tiles")).select("trees", "tiles")
    counted = histories.mapInArrow(_sums_of_histories(grid), "time_bin int, n_coal long, n_lineages long")
    return counted.groupBy("time_bin").agg(F.sum("n_coal").alias("n_coal"), F.sum("n_lineages").alias("n_lineages"))


def sizes_from_edits(first_trees: DataFrame, edits: DataFrame, grid: list[float], mu: float, sigma: float, width: int = TILE) -> DataFrame:
    """time_bin, n_coal, n_lineages, popsize by size_with_prior() of counts_from_edits()."""
    steps = time_steps(grid)

    def solve(batches):
        for rows in batches:
            yield rows.assign(popsize=[size_with_prior(int(c), steps[int(j)] * int(k), mu, sigma) for j, c, k in zip(rows.time_bin, rows.n_coal, rows.n_lineages)])

    return counts_from_edits(first_trees, edits, grid, width).mapInPandas(solve, "time_bin int, n_coal long, n_lineages long, popsize double")
