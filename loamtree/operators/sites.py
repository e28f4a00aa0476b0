"""Variant sites: (chrom, pos, col), where col has one base per sequence."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .intervals import Bins, choose_bin_width, join_points
from .ordered import TILE, from_earlier_tiles, numbered, with_halo, with_tile
from .spr import in_slices


def letters(col: Column) -> Column:
    return F.filter(F.split(col, ""), lambda x: x != "")


def is_variant(col: Column) -> Column:
    """More than one symbol."""
    return F.size(F.array_distinct(letters(col))) > 1


def is_masked(col: Column) -> Column:
    """One symbol, and that is N."""
    return ~is_variant(col) & (F.substring(col, 1, 1) == "N")


def variant_sites(sites: DataFrame) -> DataFrame:
    return sites.filter(is_variant(F.col("col")))


def biallelic_sites(sites: DataFrame) -> DataFrame:
    """Sites of exactly two symbols."""
    return sites.filter(F.size(F.array_distinct(letters(F.col("col")))) == 2)


def project_sequences(sites: DataFrame, keep: list[int]) -> DataFrame:
    """Sites of the sequences with these indices, in this order; what is invariant among them stays."""
    return sites.withColumn("col", F.concat(*[F.substring("col", i + 1, 1) for i in keep]))


def sites_in_range(sites: DataFrame, chrom: str, first: int, last: int) -> DataFrame:
    """Sites from first to last, both included."""
    return sites.filter((F.col("chrom") == chrom) & F.col("pos").between(first, last))


def allele_counts(sites: DataFrame) -> DataFrame:
    """(chrom, pos, base, n) of every symbol of every site."""
    return sites.select("chrom", "pos", F.explode(letters(F.col("col"))).alias("base")).groupBy("chrom", "pos", "base").agg(F.count(F.lit(1)).alias("n"))


def minor_allele(sites: DataFrame) -> DataFrame:
    """Each biallelic site with its symbols: the first sequence's is `first`; minor is the rarer, `first` on a tie."""
    two = biallelic_sites(sites)
    first = F.substring("col", 1, 1)
    n_first = F.length("col") - F.length(F.replace(F.col("col"), first, F.lit("")))
    other = F.substring(F.replace(F.col("col"), first, F.lit("")), 1, 1)
    n_other = F.length("col") - n_first
    return two.select(
        "chrom", "pos",
        F.when(n_first <= n_other, first).otherwise(other).alias("minor"), F.when(n_first <= n_other, other).otherwise(first).alias("major"),
        F.least(n_first, n_other).alias("n_minor"), F.greatest(n_first, n_other).alias("n_major"),
    )


def minor_split(col: Column) -> Column:
    """Indices of the sequences with the rarest symbol, the first in the alphabet on a tie."""
    parts = letters(col)
    rarest = F.array_min(F.transform(F.array_distinct(parts), lambda a: F.struct(F.size(F.filter(parts, lambda x: x == a)).alias("n"), a.alias("a"))))["a"]
    return F.filter(F.transform(parts, lambda x, i: F.when(x == rarest, i)), lambda i: i.isNotNull())


def near_pairs(sites: DataFrame, distance: int) -> DataFrame:
    """Pairs of sites of a chromosome at most `distance` apart, the left first: columns a_... and b_....

    A site meets those of its own and the next bin of `distance` bases, so the
    pairs follow the density of sites, not the square of their number.
    """
    a = sites.select("chrom", *[F.col(c).alias(f"a_{c}") for c in sites.columns if c != "chrom"])
    a = a.withColumn("bin", F.explode(F.array(F.floor(F.col("a_pos") / distance), F.floor(F.col("a_pos") / distance) + 1)))
    b = sites.select("chrom", *[F.col(c).alias(f"b_{c}") for c in sites.columns if c != "chrom"]).withColumn("bin", F.floor(F.col("b_pos") / distance))
    return a.join(b, ["chrom", "bin"]).filter((F.col("a_pos") < F.col("b_pos")) & (F.col("b_pos") - F.col("a_pos") <= distance)).drop("bin")


#: Sequences in the first word of a mask; the others have words of as many bits each in an array.
WORD = 62


def bit_mask(flags: Column) -> Column:
    """struct(low, more) of an array of booleans: bit i of `low` is flag i, the flags from WORD on are in the words of `more`."""
    bits = lambda x: F.aggregate(F.transform(x, lambda f, i: F.when(f, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, y: s + y)
    words = F.ceil(F.size(flags) / WORD).cast("int")
    more = F.when(words > 1, F.transform(F.sequence(F.lit(1), words - 1), lambda w: bits(F.slice(flags, w * WORD + 1, WORD)))).otherwise(F.array().cast("array<bigint>"))
    return F.struct(bits(F.slice(flags, 1, WORD)).alias("low"), more.alias("more"))


def _lowest(n: Column) -> Column:
    """A word whose lowest n bits are set, for n from 0 to WORD, as a table lookup."""
    return F.get(F.lit([(1 << k) - 1 for k in range(WORD + 1)]), F.least(F.greatest(n, F.lit(0)), F.lit(WORD)))


def common_bits(size: Column, *masks: Column) -> Column:
    """How many of the first `size` sequences all masks have. Only columns of more than WORD sequences take the array's way."""
    low = _lowest(size)
    for m in masks:
        low = low.bitwiseAND(m["low"])
    rest = F.transform(F.sequence(F.lit(0), F.ceil(size / WORD).cast("int") - 2), lambda w: _lowest(size - (w + 1) * WORD))
    for m in masks:
        rest = F.zip_with(rest, m["more"], lambda x, y: x.bitwiseAND(F.coalesce(y, F.lit(0))))
    return F.bit_count(low) + F.when(size > WORD, F.aggregate(rest, F.lit(0), lambda s, x: s + F.bit_count(F.coalesce(x, F.lit(0).cast("long"))))).otherwise(F.lit(0))


def linkage(sites: DataFrame, distance: int) -> DataFrame:
    """chrom, a_pos, b_pos, d, d_prime, r2 of the columns of sites at most `distance` apart, over all sequences that both have; a symbol counts as 1 if it is not the column's first.

    A site meets the others as a bit mask made once. D' is 0 where D is; r2 is
    null where a column is invariant.
    """
    parts = letters(F.col("col"))
    masked = sites.select("chrom", "pos", F.length("col").alias("size"), bit_mask(F.transform(parts, lambda c: c != F.substring("col", 1, 1))).alias("off"))
    pairs = near_pairs(masked, distance)
    size = F.least("a_size", "b_size")
    share = lambda *masks: common_bits(size, *masks) / size
    named = pairs.withColumns({"x": share(F.col("a_off"), F.col("b_off")), "p": share(F.col("a_off")), "q": share(F.col("b_off"))}).withColumn("d", F.col("x") - F.col("p") * F.col("q"))
    d, p, q = F.col("d"), F.col("p"), F.col("q")
    most = F.when(d < 0, F.least(p * q, (1 - p) * (1 - q))).otherwise(F.least(p * (1 - q), (1 - p) * q))
    spread = p * (1 - p) * q * (1 - q)
    d_prime, r2 = F.when(d == 0, F.lit(0.0)).otherwise(d / most), F.when(spread != 0, d * d / spread)
    return named.select("chrom", "a_pos", "b_pos", "d", d_prime.alias("d_prime"), r2.alias("r2"))


def haplotype_frequencies(sites: DataFrame, distance: int) -> DataFrame:
    """chrom, a_pos, b_pos, n and the counts n_00, n_01, n_10, n_11 of near sites: 1 where a sequence differs from its column's first."""
    masked = sites.select("chrom", "pos", F.length("col").alias("size"), bit_mask(F.transform(letters(F.col("col")), lambda c: c != F.substring("col", 1, 1))).alias("off"))
    pairs = near_pairs(masked, distance)
    size = F.least("a_size", "b_size")
    named = pairs.select("chrom", "a_pos", "b_pos", size.alias("n"), common_bits(size, F.col("a_off"), F.col("b_off")).alias("n_11"), common_bits(size, F.col("a_off")).alias("a"), common_bits(size, F.col("b_off")).alias("b"))
    return named.select("chrom", "a_pos", "b_pos", "n", (F.col("n") - F.col("a") - F.col("b") + F.col("n_11")).alias("n_00"), (F.col("b") - F.col("n_11")).alias("n_01"), (F.col("a") - F.col("n_11")).alias("n_10"), "n_11")


def _split_mask(col: Column) -> Column:
    parts = letters(col)
    counts = F.transform(F.array_distinct(parts), lambda a: F.struct(F.size(F.filter(parts, lambda x: x == a)).alias("n"), a.alias("a")))
    rarest = F.array_min(counts)["a"]
    return bit_mask(F.transform(parts, lambda x: x == rarest))


def _prefix_masks(columns: list[str]) -> np.ndarray:
    """For each column and each k, the rarest symbol's places among the first k + 1 sequences as bits, up to WORD of them."""
    out = np.zeros((len(columns), max([1, *(min(len(c), WORD) for c in columns)])), np.int64)
    for row, column in zip(out, columns):
        counts, masks = {}, {}
        for k, symbol in enumerate(column[:WORD]):
            counts[symbol], masks[symbol] = counts.get(symbol, 0) + 1, masks.get(symbol, 0) | 1 << k
            row[k] = masks[min(counts, key=lambda c: (counts[c], c))]  # noqa: B023
    return out


def _narrow_conflicts(distance: int):
    """Conflicts of the sites of each tile with those behind them, where both share WORD sequences at most: each site with the next one, then with the one after it, until all are too far."""

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
        x, group = batch.column("x").flatten(), np.repeat(np.arange(len(sizes)), sizes)
        pos, own = x.field("pos").to_numpy(), x.field("own").to_numpy(zero_copy_only=False)
        named = x.field("col").dictionary_encode()
        columns, code = named.dictionary.to_pylist(), named.indices.to_numpy()
        masks, length = _prefix_masks(columns), np.array([len(c) for c in columns], np.int64)[code]
        a, pairs = np.flatnonzero(own), []
        b = a
        while len(a):
            b = b + 1
            near = b < len(pos)
            near[near] = (group[a[near]] == group[b[near]]) & (pos[b[near]] - pos[a[near]] <= distance)
            a, b = a[near], b[near]
            size = np.minimum(length[a], length[b])
            at = np.clip(size, 1, masks.shape[1]) - 1
            one, two = masks[code[a], at], masks[code[b], at]
            both = one & two
            hit = (size > 0) & (size <= WORD) & (pos[a] < pos[b]) & (both != 0) & (both != one) & (both != two)
            pairs.append((a[hit], b[hit]))
        a, b = (np.concatenate([p[k] for p in pairs] or [np.zeros(0, np.int64)]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([batch.column("chrom").take(pa.array(group[a])), pa.array(pos[a]), pa.array(pos[b])], ["chrom", "a_pos", "b_pos"])

    return lambda batches: (found(part) for batch in batches for part in in_slices(batch, "x", 1 << 20))


def conflicting_pairs(sites: DataFrame, distance: int) -> DataFrame:
    """(chrom, a_pos, b_pos) of near sites whose minor splits conflict, over all sequences that both have.

    Sites go to tiles, those near a border to both, and meet as bits inside
    them: a pair that does not conflict is no row. Only pairs of columns that
    share more than WORD sequences are joined as rows, and take the way of arrays.
    """
    known = sites.filter("col IS NOT NULL")
    tiles = with_halo(known.select("chrom", "pos", "col"), "pos", distance, 16 * distance).groupBy("chrom", "tile").agg(F.sort_array(F.collect_list(F.struct("pos", "own", "col"))).alias("x"))
    narrow = tiles.mapInArrow(_narrow_conflicts(distance), "chrom string, a_pos long, b_pos long")
    pairs = near_pairs(known.filter(F.length("col") > WORD).select("chrom", "pos", F.length("col").alias("size"), F.col("col").alias("wide")), distance)
    pairs = pairs.select("chrom", "a_pos", "b_pos", F.least("a_size", "b_size").alias("size"), "a_wide", "b_wide")
    size = F.col("size")
    a, b = (_split_mask(F.substring(F.col(f"{x}_wide"), F.lit(1), size)) for x in "ab")
    meet = common_bits(size, a, b)
    broad = pairs.filter((meet > 0) & (meet < common_bits(size, a)) & (meet < common_bits(size, b)))
    return narrow.unionByName(broad.select("chrom", "a_pos", "b_pos"))


def nearest_conflicts(pairs: DataFrame) -> DataFrame:
    """Of conflicting pairs (chrom, a_pos, b_pos): each site with the nearest conflict on its left and right."""
    right = pairs.select("chrom", F.col("a_pos").alias("pos"), F.lit(None).cast("long").alias("left"), F.col("b_pos").alias("right"))
    left = pairs.select("chrom", F.col("b_pos").alias("pos"), F.col("a_pos").alias("left"), F.lit(None).cast("long").alias("right"))
    return right.unionByName(left).groupBy("chrom", "pos").agg(F.max("left").alias("left"), F.min("right").alias("right"))


def unnested_conflicts(pairs: DataFrame, width: int = 4096) -> DataFrame:
    """Conflicting pairs that hold no other: of those with one left end the shortest, if none inside begins later and ends no later.

    Pairs meet inside a tile of `width` bases, and with the later tiles by one row a tile.
    """
    shortest = pairs.groupBy("chrom", "a_pos").agg(F.min("b_pos").alias("b_pos")).withColumn("tile", F.floor(F.col("a_pos") / width))
    later = lambda keys, order: Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    first = shortest.groupBy("chrom", "tile").agg(F.min("b_pos").alias("first"))
    behind = first.select("chrom", "tile", F.min("first").over(later(["chrom"], "tile")).alias("behind"))
    inner = shortest.withColumn("inner", F.min("b_pos").over(later(["chrom", "tile"], "a_pos"))).join(behind, ["chrom", "tile"])
    return inner.filter("least(inner, behind) IS NULL OR least(inner, behind) > b_pos").drop("inner", "behind", "tile")


def stab_intervals(pairs: DataFrame, width: int = 4096) -> DataFrame:
    """Fewest breakpoints that cut every conflicting pair (chrom, a_pos, b_pos): the greedy choice just left of the first open right end.

    On pairs that do not nest, whose ends rise together, the next break is the
    right end of the first pair that begins at or behind the last break. Each
    tile of `width` bases is reduced to the pairs by which the breaks may enter
    it, with the break by which they leave it; these few rows a tile are
    followed in one task a chromosome, and each tile then makes its own breaks.
    """
    import pandas as pd

    tiled = unnested_conflicts(pairs, width).withColumn("tile", F.floor(F.col("a_pos") / width))
    before = Window.partitionBy("chrom").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    reach = tiled.groupBy("chrom", "tile").agg(F.max("b_pos").alias("b")).select("chrom", "tile", F.max("b").over(before).alias("reached"))

    def ways(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("a_pos")
        a, b, reached = rows.a_pos.to_numpy(), rows.b_pos.to_numpy(), rows.reached.iloc[0]
        then, leave = np.searchsorted(a, b), b.copy()
        for i in range(len(a) - 1, -1, -1):
            if then[i] < len(a):
                leave[i] = leave[then[i]]
        n = 1 if pd.isna(reached) else 1 + int(np.searchsorted(a[:-1], reached))
        return pd.DataFrame({"chrom": rows.chrom.iloc[0], "tile": rows.tile.iloc[0], "entry": a[:n], "leave": leave[:n]})

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        taken, last, tile = [], None, None
        for t, entry, leave in rows.sort_values("entry")[["tile", "entry", "leave"]].itertuples(index=False):
            if t != tile and (last is None or entry >= last):
                tile, last = t, leave
                taken.append((rows.chrom.iloc[0], t, entry))
        return pd.DataFrame(taken, columns=["chrom", "tile", "entry"])

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        breaks, last = [], rows.entry.iloc[0]
        for a, b in rows.sort_values("a_pos")[["a_pos", "b_pos"]].itertuples(index=False):
            if a >= last:
                last = b
                breaks.append(b)
        return pd.DataFrame({"chrom": rows.chrom.iloc[0], "pos": breaks})

    steps = tiled.join(reach, ["chrom", "tile"]).groupBy("chrom", "tile").applyInPandas(ways, "chrom string, tile long, entry long, leave long")
    entries = steps.groupBy("chrom").applyInPandas(follow, "chrom string, tile long, entry long")
    return tiled.join(entries, ["chrom", "tile"]).groupBy("chrom", "tile").applyInPandas(greedy, "chrom string, pos long")


def apply_mask(sites: DataFrame, mask: DataFrame, width: int | Bins | None = None) -> DataFrame:
    """Sites whose column is all N where a mask interval (chrom, start, stop) holds them. Very long intervals touch few bins, those of their level."""
    held = join_points(sites.select("chrom", "pos").distinct(), mask.select("chrom", "start", "stop"), width or choose_bin_width(mask))
    masked = held.select("chrom", "pos").distinct().withColumn("hidden", F.lit(True))
    return sites.join(masked, ["chrom", "pos"], "left").withColumn("col", F.when(F.col("hidden"), F.repeat(F.lit("N"), F.length("col"))).otherwise(F.col("col"))).drop("hidden")


def bootstrap_sites(sites: DataFrame, seed: int) -> DataFrame:
    """As many sites as given, drawn with replacement: sites are numbered in order, draw k takes a number by a hash of k. It does not depend on partitions."""
    placed = numbered(sites.withColumn("all", F.lit(0)), ["all"], ["pos", "chrom", "col"], "number").drop("all")
    total = sites.agg(F.count(F.lit(1)).alias("total"))
    draws = placed.select("number").withColumn("total", total.scalar()).select(F.pmod(F.xxhash64(F.lit(seed), "number"), F.col("total")).alias("number"))
    times = draws.groupBy("number").agg(F.count(F.lit(1)).cast("int").alias("times"))
    return placed.join(times, "number").withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "number")


def drop_polyallelic(sites: DataFrame) -> DataFrame:
    """Sites of at most two symbols."""
    return sites.filter(F.size(F.array_distinct(letters(F.col("col")))) <= 2)


def allele_names(sites: DataFrame, names: list[str]) -> DataFrame:
    """chrom, pos, minor, major: the names of the sequences with the rarer and with the other symbol of biallelic sites, the first sequence's part being the minor on a tie; names beyond the columns' width do not occur."""
    two = biallelic_sites(sites)
    parts = letters(F.col("col"))
    named = F.zip_with(parts, F.slice(F.lit(names), 1, F.size(parts)), lambda c, n: F.struct(c.alias("c"), n.alias("n")))
    first = F.substring("col", 1, 1)
    of = lambda test: F.transform(F.filter("x", test), lambda y: y["n"])
    split = two.withColumn("x", named).select("chrom", "pos", of(lambda y: y["c"] == first).alias("own"), of(lambda y: y["c"] != first).alias("other"))
    rarer = F.size("own") <= F.size("other")
    return split.select("chrom", "pos", F.when(rarer, F.col("own")).otherwise(F.col("other")).alias("minor"), F.when(rarer, F.col("other")).otherwise(F.col("own")).alias("major"))


def places_of(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """name, place of each wanted name, of names (name, place); the place is null where a name is missing."""
    return wanted.select("name").join(F.broadcast(names.select("name", "place")), "name", "left")


def name_faults(names: DataFrame) -> DataFrame:
    """place, name, reason of names that are empty, begin or end with a space, are only digits, have other symbols than letters, digits and . _ -, or occur again."""
    times = names.groupBy("name").agg(F.count(F.lit(1)).alias("times"))
    reason = (
        F.when(F.length("name") == 0, "empty").when(F.trim("name") != F.col("name"), "outer space").when(F.col("name").rlike("^[0-9]+$"), "digits")
        .when(~F.col("name").rlike("^[A-Za-z0-9._ -]+$"), "symbol").when(F.col("times") > 1, "repeated")
    )
    return names.join(times, "name").select("place", "name", reason.alias("reason")).filter("reason IS NOT NULL")


def names_differ(one: DataFrame, two: DataFrame) -> DataFrame:
    """place and both names where two lists (place, name) are not the same; a list that ends early has null."""
    both = one.select("place", F.col("name").alias("one")).join(two.select("place", F.col("name").alias("two")), "place", "full")
    return both.filter(~F.col("one").eqNullSafe(F.col("two")))


def pairs_by_name(names: DataFrame) -> DataFrame:
    """place, pair: the two haplotypes x_1 and x_2 of one individual; null where the other is not there."""
    base = names.select("place", F.substring_index("name", "_", -1).alias("end"), F.expr("substring(name, 1, length(name) - 2)").alias("base")).filter("end IN ('1', '2')")
    other = base.select("base", (F.lit(3) - F.col("end").cast("int")).cast("string").alias("end"), F.col("place").alias("pair"))
    return base.join(other, ["base", "end"], "left").select("place", "pair")


def pairs_by_place(names: DataFrame) -> DataFrame:
    """place, pair of neighbours: 0 and 1, 2 and 3, ..."""
    return names.select("place", F.col("place").bitwiseXOR(F.lit(1)).alias("pair"))


def pairs_by_list(names: DataFrame, listed: DataFrame) -> DataFrame:
    """place, pair of names that a list (one, two) pairs."""
    both = listed.select("one", "two").unionByName(listed.select(F.col("two").alias("one"), F.col("one").alias("two")))
    places = names.select("name", "place")
    found = both.join(places.withColumnRenamed("name", "one"), "one")
    return found.join(places.select(F.col("name").alias("two"), F.col("place").alias("pair")), "two").select("place", "pair")


def alignment(sites: DataFrame, chrom: str, n: int, width: int, default: str = "A") -> DataFrame:
    """tile, place, seq: the sequences of a chromosome from its sites, in tiles of `width` positions that have any; other positions are `default`."""
    own = sites.filter(F.col("chrom") == chrom).select(F.floor(F.col("pos") / width).alias("tile"), F.pmod("pos", F.lit(width)).cast("int").alias("at"), "col")
    tiles = own.groupBy("tile").agg(F.map_from_entries(F.collect_list(F.struct("at", "col"))).alias("cols"))
    rows = tiles.select("tile", "cols", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("place"))
    base = lambda i: F.coalesce(F.substring(F.col("cols")[i], F.col("place") + 1, F.lit(1)), F.lit(default))
    return rows.select("tile", "place", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), base), "").alias("seq"))


def least_recombinations(pairs: DataFrame, width: int = 4096) -> DataFrame:
    """chrom, a_pos, b_pos: the fewest breaks that part every conflicting pair, each with the first site behind the last break that conflicts with the site where it is found."""
    breaks = stab_intervals(pairs, width)
    last = F.lag("pos").over(Window.partitionBy("chrom").orderBy("pos"))
    known = breaks.withColumn("last", F.coalesce(last, F.lit(-(1 << 62)))).withColumnRenamed("pos", "b_pos")
    return pairs.join(known, ["chrom", "b_pos"]).filter("a_pos >= last").groupBy("chrom", "b_pos").agg(F.min("a_pos").alias("a_pos"))


def split_tracks(pairs: DataFrame, sites: DataFrame, width: int = 4096, breaks: DataFrame | None = None) -> DataFrame:
    """chrom, pos, start, stop: how far around a site its split can hold, bounded by breaks.

    stop is the last break up to the nearest conflict on the right, start the
    largest stop of the sites that conflict on the left; null where there is no
    conflict. A break is named by the site right of it. `breaks` are those of
    stab_intervals(), where they are known.
    """
    breaks = (stab_intervals(pairs, width) if breaks is None else breaks).select("chrom", F.col("pos").alias("break"))
    near = nearest_conflicts(pairs)
    # a pair has a break in (a_pos, b_pos], so only the breaks of the nearest pair have to be looked at
    stops = near.filter("right IS NOT NULL").select("chrom", "pos", "right")
    tiled = stops.withColumn("tile", F.explode(F.sequence(F.floor(F.col("pos") / width), F.floor(F.col("right") / width))))
    held = tiled.join(breaks.withColumn("tile", F.floor(F.col("break") / width)), ["chrom", "tile"]).filter("break > pos AND break <= right")
    stops = held.groupBy("chrom", "pos").agg(F.max("break").alias("stop"))
    starts = pairs.join(stops.withColumnRenamed("pos", "a_pos"), ["chrom", "a_pos"]).groupBy("chrom", F.col("b_pos").alias("pos")).agg(F.max("stop").alias("start"))
    return sites.select("chrom", "pos").join(starts, ["chrom", "pos"], "left").join(stops, ["chrom", "pos"], "left").select("chrom", "pos", "start", "stop")


def split_spans(tracks: DataFrame, breaks: DataFrame, splits: DataFrame, width: int = TILE) -> DataFrame:
    """chrom, split, first, last: the runs of blocks between breaks (chrom, pos) that the tracks of each split's sites cover, cut so that no block is in two of a split. Block 0 is before the first break."""
    known = tracks.join(splits, ["chrom", "pos"]).select("chrom", "start", "stop", "split").distinct()
    order = numbered(breaks.select("chrom", F.col("pos").alias("at")), ["chrom"], ["at"], "number")
    first = known.join(order.select("chrom", F.col("at").alias("start"), (F.col("number") + 1).alias("first")), ["chrom", "start"], "left")
    last = first.join(order.select("chrom", F.col("at").alias("stop"), F.col("number").alias("last")), ["chrom", "stop"], "left")
    total = breaks.groupBy("chrom").agg(F.count(F.lit(1)).alias("total"))
    spans = last.join(F.broadcast(total), "chrom", "left").select("chrom", "split", F.coalesce("first", F.lit(0)).alias("first"), F.coalesce("last", "total", F.lit(0)).alias("last"))
    longest = with_tile(spans.groupBy("chrom", "split", "first").agg(F.max("last").alias("last")), "first", width)
    earlier = from_earlier_tiles(longest, ["chrom", "split"], most=(F.max("last"), "max"))
    before = Window.partitionBy("chrom", "split", "tile").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    reached = longest.withColumn("inner", F.max("last").over(before)).join(earlier, ["chrom", "split", "tile"])
    return reached.select("chrom", "split", F.greatest("first", F.col("inner") + 1, F.col("most") + 1).alias("first"), "last").filter("first <= last")


def split_blocks(tracks: DataFrame, breaks: DataFrame, splits: DataFrame) -> DataFrame:
    """chrom, block, split: split_spans() with a row a block."""
    return split_spans(tracks, breaks, splits).select("chrom", F.explode(F.sequence("first", "last")).alias("block"), "split")


def split_counts(spans: DataFrame, width: int = TILE) -> DataFrame:
    """chrom, block, n of split_spans(): how many splits each block has, by running sums of the runs that begin and end there; no row a split and block."""
    last = spans.groupBy("chrom").agg(F.max("last").alias("last"))
    tiles = last.select("chrom", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / width))).alias("t")).repartition("chrom", "t")
    every = tiles.select("chrom", F.explode(F.sequence(F.col("t") * width, F.least(F.col("t") * width + width - 1, F.col("last")))).alias("block"), F.lit(0).cast("long").alias("change"))
    ends = F.explode(F.array(F.struct(F.col("first").alias("block"), F.lit(1).alias("change")), F.struct((F.col("last") + 1).alias("block"), F.lit(-1).alias("change"))))
    changes = spans.select("chrom", ends.alias("x")).select("chrom", "x.*").unionByName(every).groupBy("chrom", "block").agg(F.sum("change").alias("change"))
    tiled = with_tile(changes, "block", width)
    earlier = from_earlier_tiles(tiled, ["chrom"], before=(F.sum("change"), "sum"))
    inner = F.sum("change").over(Window.partitionBy("chrom", "tile").orderBy("block"))
    n = F.col("inner") + F.coalesce("before", F.lit(0))
    return tiled.withColumn("inner", inner).join(earlier, ["chrom", "tile"]).select("chrom", "block", n.alias("n")).filter("n > 0")
