"""Operators over neighbours in an order.

Where a key may be a whole chromosome, windows are partitioned by tiles of
`width` positions too; what a tile needs of those before or behind it comes from
a table of one row a tile.
"""

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

TILE = 1 << 16


def with_tile(rows: DataFrame, pos: str | Column, width: int = TILE) -> DataFrame:
    return rows.withColumn("tile", F.floor((F.col(pos) if isinstance(pos, str) else pos) / width))


def from_earlier_tiles(rows: DataFrame, keys: list[str], **aggregates: tuple[Column, str]) -> DataFrame:
    """keys, tile and for each name an aggregate over all rows in earlier tiles: "sum" of sums, "max" of maxima, or "last", the value of the last earlier tile; null where there is none."""
    per_tile = rows.groupBy(*keys, "tile").agg(*[column.alias(name) for name, (column, _) in aggregates.items()])
    before = Window.partitionBy(*keys).orderBy("tile")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    how = {"sum": lambda c: F.sum(c).over(earlier), "max": lambda c: F.max(c).over(earlier), "last": lambda c: F.lag(c).over(before)}
    return per_tile.select(*keys, "tile", *[how[kind](name).alias(name) for name, (_, kind) in aggregates.items()])


def with_halo(rows: DataFrame, pos: str, half_width: int, width: int = TILE) -> DataFrame:
    """Each row in every tile that is at most half_width from it; `own` marks the row's own tile."""
    width = max(width, half_width)
    reach = F.array_distinct(F.array(*[F.floor((F.col(pos) + d) / width) for d in (-half_width, 0, half_width)]))
    return rows.withColumn("tile", F.explode(reach)).withColumn("own", F.col("tile") == F.floor(F.col(pos) / width))


def adjacent_pairs(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], width: int = TILE) -> DataFrame:
    """Each row with the `columns` of the row before it, as prev_...; the first row of a key has none. The order begins with a position."""
    tiled = with_tile(rows, order[0], width)
    held = F.struct(*columns)
    earlier = from_earlier_tiles(tiled, keys, earlier=(F.max_by(held, F.struct(*order)), "last"))
    inner = F.lag(held).over(Window.partitionBy(*keys, "tile").orderBy(*order))
    linked = tiled.withColumn("inner", inner).join(earlier, [*keys, "tile"]).withColumn("before", F.coalesce("inner", "earlier"))
    return linked.withColumns({f"prev_{c}": F.col("before")[c] for c in columns}).drop("inner", "earlier", "before", "tile")


def blocks_from_breaks(breaks: DataFrame, keys: list[str], pos: str = "pos", width: int = TILE) -> DataFrame:
    """[start, stop) between neighbouring distinct breakpoints of a key."""
    starts = with_tile(breaks.select(*keys, F.col(pos).alias("start")).distinct(), "start", width)
    inner = starts.withColumn("stop", F.lead("start").over(Window.partitionBy(*keys, "tile").orderBy("start")))
    first = starts.groupBy(*keys, "tile").agg(F.min("start").alias("first"))
    behind = first.select(*keys, "tile", F.lead("first").over(Window.partitionBy(*keys).orderBy("tile")).alias("behind"))
    return inner.join(behind, [*keys, "tile"]).select(*keys, "start", F.coalesce("stop", "behind").alias("stop")).filter("stop IS NOT NULL")


def merge_islands(rows: DataFrame, keys: list[str], order: list[str], equal: list[str], touching: bool = False, width: int = TILE) -> DataFrame:
    """Runs of neighbouring rows with the same `equal` columns become one: start, stop, n_rows.

    With `touching`, a gap between stop and the next start also ends a run.
    """
    linked = adjacent_pairs(rows.withColumn("row", F.lit(1)), keys, order, [*equal, "stop", "row"], width)
    same = F.lit(True)
    for c in equal:
        same = same & F.col(c).eqNullSafe(F.col(f"prev_{c}"))
    if touching:
        same = same & (F.col("prev_stop") == F.col("start"))
    tiled = with_tile(linked.withColumn("opens", F.when(F.col("prev_row").isNull() | ~same, 1).otherwise(0)), order[0], width)
    earlier = from_earlier_tiles(tiled, keys, opened=(F.sum("opens"), "sum"))
    inner = F.sum("opens").over(Window.partitionBy(*keys, "tile").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    marked = tiled.withColumn("inner", inner).join(earlier, [*keys, "tile"]).withColumn("island", F.col("inner") + F.coalesce("opened", F.lit(0)))
    return marked.groupBy(*keys, "island", *equal).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("n_rows")).drop("island")


def sliding_counts(points: DataFrame, keys: list[str], pos: str, half_width: int) -> DataFrame:
    """Distinct positions of each key with the points at most `half_width` away."""
    per_pos = points.groupBy(*keys, pos).agg(F.count(F.lit(1)).alias("here"))
    window = Window.partitionBy(*keys, "tile").orderBy(pos).rangeBetween(-half_width, half_width)
    return with_halo(per_pos, pos, half_width).withColumn("n_near", F.sum("here").over(window)).filter("own").drop("own", "tile")


def sliding_means(rows: DataFrame, keys: list[str], pos: str, value: str, half_width: int, name: str) -> DataFrame:
    """Each row with the mean value of the rows of its key at most `half_width` away, as `name`."""
    window = Window.partitionBy(*keys, "tile").orderBy(pos).rangeBetween(-half_width, half_width)
    return with_halo(rows, pos, half_width).withColumn(name, F.avg(value).over(window)).filter("own").drop("own", "tile")


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "i", width: int = TILE) -> DataFrame:
    """Each row with its number from 0 in its key's order, whose first column is a position."""
    tiled = with_tile(rows, order[0], width)
    before = from_earlier_tiles(tiled, keys, before=(F.count(F.lit(1)), "sum"))
    number = F.row_number().over(Window.partitionBy(*keys, "tile").orderBy(*order)) - 1
    return tiled.join(before, [*keys, "tile"]).withColumn(name, (F.coalesce("before", F.lit(0)) + number).cast("long")).drop("before", "tile")


def unique_positions(rows: DataFrame, keys: list[str], order: list[str], pos: str, width: int = TILE) -> DataFrame:
    """Whole positions that rise by at least one in the given order, which begins with `pos`: row number i gets i + the largest max(int(pos) - i, 0) so far."""
    ahead = with_tile(numbered(rows, keys, order, "i", width).withColumn("ahead", F.floor(pos) - F.col("i")), order[0], width)
    earlier = from_earlier_tiles(ahead, keys, most=(F.max("ahead"), "max"))
    inner = F.max("ahead").over(Window.partitionBy(*keys, "tile").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = ahead.withColumn("inner", inner).join(earlier, [*keys, "tile"])
    return joined.withColumn("unique_pos", F.col("i") + F.greatest(F.lit(0), F.col("inner"), F.col("most"))).drop("i", "ahead", "inner", "most", "tile")


def compressed_positions(sites: DataFrame, keys: list[str], start: int, step: int) -> DataFrame:
    """Sites (pos) with new_pos, one column in about `step`: every site keeps a column of its own, and moves behind the one before it where they would share one."""
    scaled = sites.withColumn("scaled", F.floor((F.col("pos") - start) / step))
    return unique_positions(scaled, keys, ["scaled", "pos"], "scaled", max(1, TILE // step)).withColumnRenamed("unique_pos", "new_pos").drop("scaled")


def compression_map(compressed: DataFrame, chrom: str, start: int, stop: int, step: int) -> DataFrame:
    """new_pos, old_pos of every column that is kept on a chromosome: its sites', and in each other block the position half a step before the block's end."""
    own = compressed.filter(F.col("chrom") == chrom).select("new_pos", F.col("pos").alias("site"))
    last = own.agg(F.max("new_pos").alias("last"))
    columns = last.select(F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.coalesce("last", F.lit(-1)), F.lit((stop - start) // step - 1)))).alias("new_pos"))
    middle = F.lit(start) + (F.col("new_pos") + 1) * step - step // 2
    return columns.join(own, "new_pos", "left").select("new_pos", F.coalesce("site", middle).alias("old_pos"))


def interleave(trees: DataFrame, sprs: DataFrame, width: int = TILE) -> DataFrame:
    """Trees (at start) and subtree edits (at pos) as one ordered table; at the same position the edit comes first."""
    items = trees.select("sample", "chrom", F.col("start").alias("at"), F.lit(1).alias("kind")).unionByName(
        sprs.select("sample", "chrom", F.col("pos").alias("at"), F.lit(0).alias("kind"))
    )
    return numbered(items, ["sample", "chrom"], ["at", "kind"], "place", width).withColumn("place", (F.col("place") + 1).cast("int"))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows with the same key the last in the given order: an upsert of appended loads."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*key, *[F.col("x")[c].alias(c) for c in rest]).select(*rows.columns)


def next_event(rows: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Each distinct position of a key with the next one, as next_pos; the last has none."""
    distinct = rows.select(*keys, pos).distinct()
    blocks = blocks_from_breaks(distinct, keys, pos).withColumnsRenamed({"start": pos, "stop": "next_pos"})
    return distinct.join(blocks, [*keys, pos], "left")


def partitioned(blocks: DataFrame, pos: int) -> DataFrame:
    """Blocks cut at a position: `side` is "left" before it and "right" from it on."""
    left = blocks.filter(F.col("start") < pos).withColumn("stop", F.least("stop", F.lit(pos))).withColumn("side", F.lit("left"))
    right = blocks.filter(F.col("stop") > pos).withColumn("start", F.greatest("start", F.lit(pos))).withColumn("side", F.lit("right"))
    return left.unionByName(right)


def thin_samples(rows: DataFrame, first: int, behind: int, step: int, sample: str = "sample") -> DataFrame:
    """Samples first, first + step, ... below `behind`."""
    s = F.col(sample)
    return rows.filter((s >= first) & (s < behind) & ((s - first) % step == 0))


def rank_quantiles(rows: DataFrame, key: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """scalar.rank_quantile of a key's values, by name, from counts of its distinct values; no key's rows are put together."""
    counts = rows.groupBy(key, value).agg(F.count(value).alias("n"))
    order = Window.partitionBy(key).orderBy(value)
    ranked = counts.withColumns({"behind": F.sum("n").over(order), "total": F.sum("n").over(Window.partitionBy(key))})
    found = []
    for name, q in quantiles.items():
        at = F.least(F.floor(F.lit(q) * F.col("total")), F.col("total") - 1)
        between = (at > 0) & (F.abs(F.lit(q) - at / F.col("total")) < 1e-5)
        upper, lower = (F.min(F.when(F.col("behind") > at - back, F.col(value))) for back in (0, 1))
        found.append(F.when(F.max(between), (upper + lower) / 2).otherwise(upper).alias(name))
    return ranked.groupBy(key).agg(*found)


def log_sums(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, total: log(sum(exp(value))) from a key's largest value down, by partial sums."""
    top = rows.groupBy(F.col(key).alias("key_")).agg(F.max(value).alias("top"))
    held = rows.join(top, F.col(key).eqNullSafe(F.col("key_")))
    return held.groupBy(key).agg((F.max("top") + F.log(F.sum(F.exp(F.col(value) - F.col("top"))))).alias("total"))
