"""Interval algebra. Every join has an equality on (chrom, level, bin), so Spark hashes it; bins split a long chromosome over tasks.

Bins of level l are 8 ** l times as wide as those of level 0. An interval is
kept in bins of its own level, of which it touches at most nine, so a few very
long intervals do not become very many rows.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .ordered import TILE, blocks_from_breaks, from_earlier_tiles, with_tile


STEP = 8


class Bins(NamedTuple):
    """Width of the bins of level 0, and how many levels there are."""

    width: int
    levels: int = 1

    def of(self, level: int) -> int:
        return self.width * STEP**level


def _bins(width: "int | Bins") -> Bins:
    return width if isinstance(width, Bins) else Bins(width)


def choose_bin_width(intervals: DataFrame, start: str = "start", stop: str = "stop") -> Bins:
    """Twice the median length, as a power of two: most intervals then lie in one or two bins of level 0; and levels up to the longest. One small job."""
    length = F.col(stop) - F.col(start)
    median, longest = intervals.agg(F.percentile_approx(length, 0.5, 1000), F.max(length)).first()
    width, levels = 1 << max(0, int(2 * (median or 1) - 1).bit_length()), 1
    while STEP * width * STEP ** (levels - 1) < (longest or 1):
        levels += 1
    return Bins(width, levels)


def overlapping(intervals: DataFrame, chrom: str, start: int, stop: int) -> DataFrame:
    """Intervals that share a base with [start, stop) of a chromosome. The predicates reach a Parquet scan."""
    return intervals.filter((F.col("chrom") == chrom) & (F.col("start") < stop) & (F.col("stop") > start))


def clipped(intervals: DataFrame, start: int | Column, stop: int | Column) -> DataFrame:
    """Intervals cut to [start, stop); what lies outside goes."""
    start, stop = (F.lit(x) if isinstance(x, int) else x for x in (start, stop))
    return intervals.withColumns({"start": F.greatest("start", start), "stop": F.least("stop", stop)}).filter("start < stop")


def _level(bins: Bins) -> Column:
    """The lowest level in which [start, stop) touches at most nine bins, the last for what is longer."""
    length, level = F.col("stop") - F.col("start"), F.lit(bins.levels - 1)
    for k in reversed(range(bins.levels - 1)):
        level = F.when(length <= STEP * bins.of(k), F.lit(k)).otherwise(level)
    return level


def _touched(bins: Bins, k: int, first_only: bool = False) -> Column:
    lo = F.floor(F.col("start") / bins.of(k))
    hi = lo if first_only else F.floor((F.col("stop") - 1) / bins.of(k))
    return F.transform(F.sequence(lo, hi), lambda b: F.struct(F.lit(k).alias("level"), b.alias("bin")))


def with_bins(intervals: DataFrame, width: int | Bins, coarser: bool = False, first_only: bool = False) -> DataFrame:
    """A row with `level` and `bin` for each bin of its level that an interval touches; with `coarser` of the levels above it too, with `first_only` the first bin of every level."""
    bins = _bins(width)
    if bins.levels == 1:
        cells = _touched(bins, 0, first_only)
    else:
        own = _level(bins)
        none = F.array().cast("array<struct<level:int,bin:bigint>>")
        wanted = lambda k: F.lit(True) if first_only else own <= k if coarser else own == k
        cells = F.concat(*[F.when(wanted(k), _touched(bins, k, first_only)).otherwise(none) for k in range(bins.levels)])
    return intervals.withColumn("cell", F.explode(cells)).withColumns({"level": F.col("cell.level"), "bin": F.col("cell.bin")}).drop("cell")


def join_points(points: DataFrame, intervals: DataFrame, width: int | Bins, pos: str = "pos", how: str = "inner", closed: str = "left") -> DataFrame:
    """Points with the intervals of their chromosome that hold them: [start, stop), or (start, stop] if closed is "right".

    A point has one bin a level, an interval the bins of its level that it
    touches, so each pair is found once. With how "left" the points without an
    interval follow, found by what the join has not reached. Both sides need a
    column chrom, which the result has once.
    """
    if how == "left":
        found = join_points(points, intervals, width, pos, "inner", closed)
        rest = points.join(found.select("chrom", pos).distinct(), ["chrom", pos], "left_anti")
        return found.unionByName(rest.select(*points.columns), allowMissingColumns=True)
    bins = _bins(width)
    at = F.col(pos) if closed == "left" else F.col(pos) - 1
    cells = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(at / bins.of(k)).alias("bin")) for k in range(bins.levels)])
    left = points.withColumn("cell", F.explode(cells) if bins.levels > 1 else cells[0])
    right = with_bins(intervals, bins).withColumnRenamed("chrom", "chrom_")
    inside = (left[pos] >= right["start"]) & (left[pos] < right["stop"]) if closed == "left" else (left[pos] > right["start"]) & (left[pos] <= right["stop"])
    same = (left["chrom"] == right["chrom_"]) & (left["cell.level"] == right["level"]) & (left["cell.bin"] == right["bin"])
    return left.join(right, same & inside, how).drop("cell", "level", "bin", "chrom_")


def join_intervals(left: DataFrame, right: DataFrame, width: int | Bins, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Pairs of overlapping intervals and their common part (start, stop).

    Columns other than chrom get the prefixes in `names`. A pair is emitted in
    the first bin that both touch, of the higher of their levels, so no
    duplicates have to be removed.
    """
    bins = _bins(width)
    keys = ("chrom", "level", "bin")
    a, b = (with_bins(x.withColumn("own", _level(bins)), bins, coarser=True).select([F.col(c).alias(c if c in keys else f"{n}_{c}") for c in [*x.columns, "own", "level", "bin"]]) for x, n in zip((left, right), names))
    start, stop = F.greatest(f"{names[0]}_start", f"{names[1]}_start"), F.least(f"{names[0]}_stop", f"{names[1]}_stop")
    both = a.join(b, list(keys)).withColumns({"start": start, "stop": stop})
    size = F.element_at(F.array(*[F.lit(bins.of(k)) for k in range(bins.levels)]), F.col("level") + 1)
    first = (F.col("bin") == F.floor(F.col("start") / size)) & (F.col("level") == F.greatest(f"{names[0]}_own", f"{names[1]}_own"))
    return both.filter((F.col("start") < F.col("stop")) & first).drop("level", "bin", f"{names[0]}_own", f"{names[1]}_own")


def segments(intervals: DataFrame, width: int | Bins) -> DataFrame:
    """(chrom, start, stop) between neighbouring interval ends, covered or not."""
    ends = intervals.select("chrom", F.explode(F.array("start", "stop")).alias("pos"))
    return blocks_from_breaks(ends, ["chrom"], "pos", _bins(width).width)


def intersect_samples(intervals: DataFrame, width: int | Bins) -> DataFrame:
    """Maximal segments of constant membership, with a row for each interval that covers one; gaps have none.

    The columns of the interval other than its coordinates stay.
    """
    bins, others = _bins(width), [c for c in intervals.columns if c not in ("chrom", "start", "stop")]
    members = with_bins(intervals.select("chrom", "start", "stop", *others), bins).withColumnsRenamed({"start": "from", "stop": "to"})
    # a segment lies inside every interval that covers it: its first bin of each level is enough
    parts = with_bins(segments(intervals, bins), bins, first_only=True).withColumnsRenamed({"chrom": "chrom_", "level": "level_", "bin": "bin_"})
    covered = (members["from"] <= parts["start"]) & (members["to"] >= parts["stop"])
    joined = members.join(parts, (members["chrom"] == parts["chrom_"]) & (members["level"] == parts["level_"]) & (members["bin"] == parts["bin_"]) & covered)
    return joined.select("chrom", parts["start"], parts["stop"], *others)


def complete_track(track: DataFrame, chrom_ends: DataFrame, default: float, width: int = TILE) -> DataFrame:
    """A track with its gaps filled by `default`, from 0 to each chromosome's stop (chrom, chrom_stop). Overlaps are an error for check_disjoint()."""
    tiled = with_tile(track, "start", width)
    earlier = from_earlier_tiles(tiled, ["chrom"], reached=(F.max_by("stop", "start"), "last"))
    inner = F.lag("stop").over(Window.partitionBy("chrom", "tile").orderBy("start"))
    linked = tiled.withColumn("inner", inner).join(earlier, ["chrom", "tile"]).withColumn("prev", F.coalesce("inner", "reached", F.lit(0).cast("long")))
    before = linked.filter("prev < start").select("chrom", F.col("prev").alias("start"), F.col("start").alias("stop"))
    last = chrom_ends.join(track.groupBy("chrom").agg(F.max("stop").alias("last")), "chrom", "left")
    tail = last.select("chrom", F.coalesce("last", F.lit(0).cast("long")).alias("start"), F.col("chrom_stop").alias("stop")).filter("start < stop")
    gaps = before.unionByName(tail).withColumn("value", F.lit(default))
    return track.select("chrom", "start", "stop", "value").unionByName(gaps)


def check_disjoint(track: DataFrame, width: int = TILE) -> DataFrame:
    """The intervals that begin before an earlier one of their chromosome ends; empty for a valid track."""
    tiled = with_tile(track, "start", width)
    earlier = from_earlier_tiles(tiled, ["chrom"], most=(F.max("stop"), "max"))
    order = Window.partitionBy("chrom", "tile").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    found = tiled.withColumn("inner", F.max("stop").over(order)).join(earlier, ["chrom", "tile"])
    return found.withColumn("reached", F.greatest("inner", "most")).filter("reached > start").drop("inner", "most", "tile")


def lookup_track(points: DataFrame, track: DataFrame, width: int | Bins, default: float) -> DataFrame:
    """Points with the track's value there, or the default."""
    found = join_points(points, track, width, how="left")
    return found.withColumn("value", F.coalesce("value", F.lit(default))).drop("start", "stop")


def tiles(regions: DataFrame, step: int, flank: int) -> DataFrame:
    """Tiles of `step` bases from the start of each region (chrom, start, stop), and with their flanks (flank_start, flank_stop) inside it."""
    cut = regions.withColumn("tile", F.explode(F.sequence(F.col("start"), F.col("stop") - 1, F.lit(step))))
    stop = F.least(F.col("tile") + step, F.col("stop"))
    return cut.select(
        "chrom", F.col("tile").alias("start"), stop.alias("stop"),
        F.greatest(F.col("tile") - flank, F.col("start")).alias("flank_start"), F.least(stop + flank, F.col("stop")).alias("flank_stop"),
    )


def grid_positions(intervals: DataFrame, step: int) -> DataFrame:
    """A row with `pos` for each multiple of `step` in an interval."""
    first = F.ceil(F.col("start") / step) * step
    return intervals.filter(first < F.col("stop")).withColumn("pos", F.explode(F.sequence(first, F.col("stop") - 1, F.lit(step).cast("long"))))
