"""Summaries over samples, as a user of posterior samples asks for them."""

from pyspark.sql import functions as F

from ..catalogue import query
from ..functions.scalar import or_na
from ..operators import forest, ordered, trees as tr
from ..plans import summaries
from ..tables import JOINTS_SQL, POINTS_SQL, TRACKS_SQL, points, tracks, trees
from .core import _sql_quantile, rounded

#: Blocks of the samples of a region: every fourth tree is of one sample, blocks of ten that begin where the sample's number says, so samples change at different places.
_BLOCKS = f"""{JOINTS_SQL}, statistics AS (SELECT k, max(age) AS tmrca, sum(age) + max(age) AS branchlen, sum((size - j + 1) * (size - j) * (age - below)) / (4 * max(size) - 4) AS popsize
 FROM (SELECT *, coalesce(lag(age) OVER (PARTITION BY k ORDER BY j), 0) AS below FROM joints) GROUP BY k),
blocks AS (SELECT k % 4 AS sample, '1' AS chrom, (k // 4) * 10 + k % 4 AS start, (k // 4) * 10 + k % 4 + 10 AS stop, tmrca, branchlen, popsize FROM statistics),
ends AS (SELECT DISTINCT unnest([start, stop]) AS p FROM blocks), parts AS (SELECT p AS start, lead(p) OVER (ORDER BY p) AS stop FROM ends QUALIFY stop IS NOT NULL)"""


def sample_trees(spark, d):
    start = F.floor(F.col("start") / 40) * 10 + F.col("sample")
    return trees(spark, d).withColumns({"start": start, "stop": start + 10})


def _held(cut: str = "") -> str:
    return f"{_BLOCKS}, held AS (SELECT p.start, p.stop, t.* EXCLUDE (start, stop) FROM parts p JOIN blocks t ON t.start <= p.start AND t.stop >= p.stop {cut})"


def _summary_sql(value: str) -> str:
    return f"""WITH {_held()}, lists AS (SELECT start, stop, count(*) AS n_samples, avg({value}) AS m, list_sort(list({value})) AS v FROM held GROUP BY ALL)
SELECT '1' AS chrom, start, stop, n_samples, round(m, 6) AS mean, {_sql_quantile('v', 0.025)} AS low, {_sql_quantile('v', 0.975)} AS high FROM lists"""


def _summary(spark, d, value: str):
    found = summaries.summarize_region(sample_trees(spark, d), [value], 32, quantiles=[0.025, 0.975])
    return rounded(found.select("chrom", "start", "stop", "n_samples", F.col(f"{value}_mean").alias("mean"), F.col(f"`{value}_quantile_0.025`").alias("low"), F.col(f"`{value}_quantile_0.975`").alias("high")), "mean", "low", "high")


@query(_summary_sql("tmrca"))
def segment_tmrca(spark, d):
    return _summary(spark, d, "tmrca")


@query(_summary_sql("branchlen"))
def segment_tree_length(spark, d):
    return _summary(spark, d, "branchlen")


@query(_summary_sql("popsize"))
def segment_popsize(spark, d):
    return _summary(spark, d, "popsize")


@query(f"""WITH {_BLOCKS}, inside AS (SELECT sample, greatest(start, 1005) AS start, least(stop, 2002) AS stop, tmrca, branchlen FROM blocks WHERE start < 2002 AND stop > 1005),
cuts AS (SELECT DISTINCT unnest([start, stop]) AS p FROM inside), pieces AS (SELECT p AS start, lead(p) OVER (ORDER BY p) AS stop FROM cuts QUALIFY stop IS NOT NULL)
SELECT '1' AS chrom, p.start, p.stop, count(*) AS n_samples, round(avg(tmrca), 6) AS tmrca_mean, round(stddev_samp(tmrca), 6) AS tmrca_stdev, round(avg(branchlen), 6) AS branchlen_mean, round(stddev_samp(branchlen), 6) AS branchlen_stdev
FROM pieces p JOIN inside t ON t.start <= p.start AND t.stop >= p.stop GROUP BY ALL""")
def region_summary(spark, d):
    """Several statistics at once, of one region only."""
    found = summaries.summarize_region(sample_trees(spark, d), ["tmrca", "branchlen"], 32, ("1", 1005, 2002))
    return rounded(found, "tmrca_mean", "tmrca_stdev", "branchlen_mean", "branchlen_stdev")


@query(f"""WITH {TRACKS_SQL}, {POINTS_SQL}, asked AS (SELECT DISTINCT chrom, pos FROM points),
found AS (SELECT a.chrom, a.pos, sample, t.value AS age, t.start % 2 = 0 AS infinite_sites, CASE WHEN t.start % 3 = 0 THEN 'A' ELSE 'G' END AS derived FROM asked a JOIN tracks t ON a.chrom = t.chrom AND a.pos >= t.start AND a.pos < t.stop),
votes AS (SELECT chrom, pos, derived, count(*) AS n, min(sample) AS first FROM found GROUP BY ALL)
SELECT chrom, pos, n_samples, round(age_mean, 6) AS age_mean, round(age_mean_infinite, 6) AS age_mean_infinite, derived
FROM (SELECT chrom, pos, count(*) AS n_samples, avg(age) AS age_mean, avg(age) FILTER (WHERE infinite_sites) AS age_mean_infinite FROM found GROUP BY ALL) JOIN (SELECT chrom, pos, arg_max(derived, (n, -first)) AS derived FROM votes GROUP BY ALL) USING (chrom, pos)""")
def allele_age_summary(spark, d):
    """Ages of each site over samples, over all and over those where one branch explains it, and the allele that most samples call derived."""
    aged = tracks(spark, d).selectExpr("sample", "chrom", "start", "stop", "value AS age", "start % 2 = 0 AS infinite_sites", "IF(start % 3 = 0, 'A', 'G') AS derived")
    found = summaries.allele_summary(points(spark, d).select("chrom", "pos").distinct(), aged, 1024)
    return rounded(found, "age_mean", "age_mean_infinite")


@query(f"""WITH {TRACKS_SQL}, here AS (SELECT sample, chrom, start, stop, (SELECT count(*) FROM tracks b WHERE b.sample = a.sample AND b.chrom = a.chrom AND b.start BETWEEN a.start - 600 AND a.start + 600) AS n FROM tracks a),
ends AS (SELECT DISTINCT chrom, unnest([start, stop]) AS p FROM tracks), parts AS (SELECT chrom, p AS start, lead(p) OVER (PARTITION BY chrom ORDER BY p) AS stop FROM ends QUALIFY stop IS NOT NULL),
lists AS (SELECT p.chrom, p.start, p.stop, avg(n) AS m, list_sort(list(n)) AS v FROM parts p JOIN here t ON p.chrom = t.chrom AND t.start <= p.start AND t.stop >= p.stop GROUP BY ALL)
SELECT chrom, start, stop, round(m, 6) AS mean, {_sql_quantile('v', 0.025)} AS low, {_sql_quantile('v', 0.975)} AS high FROM lists""")
def segment_breaks(spark, d):
    """Breakpoints at most 600 from each block's start, by segment over samples."""
    t = tracks(spark, d).drop("value")
    counts = ordered.sliding_counts(t.select("sample", "chrom", "start"), ["sample", "chrom"], "start", 600).select("sample", "chrom", "start", F.col("n_near").cast("double").alias("n"))
    found = summaries.summarize_segments(t.join(counts, ["sample", "chrom", "start"]), 1024, ["n"], [0.025, 0.975])
    return rounded(found.select("chrom", "start", "stop", F.col("n_mean").alias("mean"), F.col("`n_quantile_0.025`").alias("low"), F.col("`n_quantile_0.975`").alias("high")), "mean", "low", "high")


@query(f"WITH {TRACKS_SQL}, x AS (SELECT sample, avg(value) FILTER (WHERE chrom = 'click') AS m, stddev_samp(value) FILTER (WHERE chrom = 'click' AND start % 400 = 0) AS s FROM tracks GROUP BY 1) SELECT sample, coalesce(printf('%.2f', CAST(floor(m * 100) / 100 AS DOUBLE)), 'NA') AS mean, CASE WHEN s IS NULL THEN 'NA' ELSE 'known' END AS spread FROM x")
def printed_summary(spark, d):
    """What is printed of a vector: NA for no values, and for the deviation of one."""
    found = tracks(spark, d).groupBy("sample").agg(F.avg(F.when(F.col("chrom") == "click", F.col("value"))).alias("m"), F.stddev_samp(F.when((F.col("chrom") == "click") & (F.col("start") % 400 == 0), F.col("value"))).alias("s"))
    return found.select("sample", or_na(F.floor(F.col("m") * 100) / 100, "%.2f").alias("mean"), F.when(or_na(F.col("s"), "%f") == "NA", "NA").otherwise("known").alias("spread"))


@query(f"WITH {_BLOCKS}, tops AS (SELECT k, size, age, j FROM joints WHERE j < size - 1) SELECT size AS leaves, array_to_string(range(j + 1), ',') AS clade, count(*) AS n_trees, round(avg(age), 6) AS age FROM tops GROUP BY size, j")
def consensus_trees(spark, d):
    """The clades of the majority's tree for each number of leaves, with their mean age: nested, so they are the tree."""
    named = trees(spark, d).withColumn("leaves", tr.n_leaves("ptree").cast("long"))
    return rounded(tr.consensus(named, ["leaves"]), "age")


@query(f"WITH {JOINTS_SQL}, pruned AS (SELECT k % 4 AS sample, k, max(age) AS age FROM joints GROUP BY k), o AS (SELECT *, lag(age) OVER (PARTITION BY sample ORDER BY k) IS DISTINCT FROM age AS opens FROM pruned) SELECT sample, count(*) FILTER (WHERE opens) AS n_blocks, count(*) AS n_trees FROM o GROUP BY sample")
def pruned_blocks(spark, d):
    """Trees of each sample pruned to the first and the last leaf; neighbours that are then the same become one block."""
    t = trees(spark, d).select("sample", "start", "stop", forest.prune(F.array(F.lit(0), tr.n_leaves("ptree") - 1)).alias("t"))
    same = t.select("sample", "start", "stop", F.xxhash64("t.ptree", "t.age").alias("tree"))
    merged = ordered.merge_islands(same, ["sample"], ["start"], ["tree"])
    return merged.groupBy("sample").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("n_rows").alias("n_trees"))
