"""Summaries of a statistic over samples, along the genome."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import rank_quantile
from ..operators.intervals import clipped, intersect_samples, join_points, overlapping
from ..operators.ordered import sliding_means
from ..operators.trees import tree_statistics


def aggregates(value: str, quantiles: list[float] = ()) -> list[Column]:
    """mean, stdev (null for one sample) and quantile_... of a column."""
    named = [F.avg(value).alias(f"{value}_mean"), F.stddev_samp(value).alias(f"{value}_stdev")]
    return named + [rank_quantile(F.collect_list(value), q).alias(f"{value}_quantile_{q:g}") for q in quantiles]


def summarize_segments(tracks: DataFrame, width: int, values: list[str], quantiles: list[float] = ()) -> DataFrame:
    """(chrom, start, stop) of constant membership with n_samples and the aggregates of each value over the samples there."""
    parts = intersect_samples(tracks.select("chrom", "start", "stop", *values), width)
    return parts.groupBy("chrom", "start", "stop").agg(F.count(F.lit(1)).alias("n_samples"), *[c for v in values for c in aggregates(v, quantiles)])


def summarize_region(trees: DataFrame, statistics: list[str], width: int, region: tuple[str, int, int] | None = None, quantiles: list[float] = ()) -> DataFrame:
    """Tree statistics of all samples (sample, chrom, start, stop, ptree, age) summarised by segment, in a region or everywhere."""
    if region:
        trees = clipped(overlapping(trees, *region), region[1], region[2])
    return summarize_segments(tree_statistics(trees, statistics), width, statistics, quantiles)


def summarize_regions(tracks: DataFrame, regions: DataFrame, width: int) -> DataFrame:
    """Each of many regions (name, chrom, start, stop) with the base-weighted mean of all sample intervals in it: one range join for all.

    Values count in whole millionths and the mean is rounded half up to them, so
    the order of summation cannot matter. Values are not negative.
    """
    from ..operators.intervals import join_intervals

    joined = join_intervals(regions.select("chrom", "start", "stop", "name"), tracks.select("chrom", "start", "stop", "value"), width, ("r", "t"))
    size = F.col("stop") - F.col("start")
    millionths = F.round(F.col("t_value") * 1000000).cast("decimal(20,0)")
    sums = joined.groupBy(F.col("r_name").alias("name")).agg(F.count(F.lit(1)).alias("n_parts"), F.sum(size).alias("bases"), F.sum(millionths * size).alias("total"))
    return sums.withColumn("mean_value", F.expr("(2 * total + bases) div (2 * bases)") / 1000000).drop("total")


def allele_summary(sites: DataFrame, tracks: DataFrame, width: int) -> DataFrame:
    """Each site (chrom, pos, ...) with its samples' (sample, age, infinite_sites, derived): means over all samples and over those with infinite sites, and the majority's derived allele, that of the smallest sample on a tie."""
    found = join_points(sites, tracks, width)
    certain = F.when(F.col("infinite_sites"), F.col("age"))
    votes = found.groupBy("chrom", "pos", "derived").agg(
        F.count(F.lit(1)).alias("n"), F.min("sample").alias("first"), F.sum("age").alias("age"), F.count(certain).alias("n_certain"), F.sum(certain).alias("certain")
    )
    return votes.groupBy("chrom", "pos").agg(
        F.sum("n").alias("n_samples"),
        (F.sum("age") / F.sum("n")).alias("age_mean"),
        F.when(F.sum("n_certain") > 0, F.sum("certain") / F.sum("n_certain")).alias("age_mean_infinite"),
        F.max_by("derived", F.struct("n", (-F.col("first")).alias("first"))).alias("derived"),
    )


def recombination_rates(breaks: DataFrame, lengths: DataFrame, width: int, half_width: int) -> DataFrame:
    """Breakpoints (chrom, pos) a base, generation and lineage: those at each segment's start over the samples' mean tree length there, meaned over starts at most half_width away."""
    parts = intersect_samples(lengths, width).groupBy("chrom", "start", "stop").agg(F.avg("branchlen").alias("mean_length"), F.count(F.lit(1)).alias("n_samples"))
    here = breaks.groupBy("chrom", F.col("pos").alias("start")).agg(F.count(F.lit(1)).alias("n_breaks"))
    rate = F.coalesce("n_breaks", F.lit(0)) / F.col("mean_length") / F.col("n_samples")
    rates = parts.join(here, ["chrom", "start"], "left").select("chrom", "start", "stop", rate.alias("rate"))
    return sliding_means(rates, ["chrom"], "start", "rate", half_width, "rate_near")
