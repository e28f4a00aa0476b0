"""Intervals, ordered neighbours, sites and trees."""

import math

from pyspark.sql import functions as F

from ..catalogue import query
from ..functions.scalar import grid_up_to, nearest_time, rank_quantile, time_grid
from ..operators import forest, intervals as iv, ordered, sites as st, spr, trees as tr
from ..plans import summaries
from ..sources.newick import format_newick, parse_newick
from ..sources.scratch import stored
from ..tables import JOINTS_SQL, NODES_SQL, POINTS_SQL, SITES_SQL, TRACKS_SQL, bushy_trees, one_track, points, sites, table, tracks, trees

GRID = time_grid(12, 400.0, 0.01)
DISTANCE = 40


def nine_decimals(x):
    """round(x, 9). A small number that is not near the middle of two results goes by way of whole numbers, without a decimal for each value; the quotient of two whole numbers is the double nearest to it."""
    scaled = x * 1e9
    clear = (F.abs(x) < 10) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(clear, F.floor(scaled + 0.5) / 1e9).otherwise(F.round(x, 9))


def rounded(frame, *columns):
    return frame.withColumns({c: F.round(c, 6) for c in columns})


_SEGMENTS = f"""WITH {TRACKS_SQL},
ends AS (SELECT DISTINCT chrom, unnest([start, stop]) AS p FROM tracks),
parts AS (SELECT chrom, p AS start, lead(p) OVER (PARTITION BY chrom ORDER BY p) AS stop FROM ends QUALIFY stop IS NOT NULL),
held AS (SELECT p.chrom, p.start, p.stop, t.value FROM parts p JOIN tracks t ON p.chrom = t.chrom AND t.start <= p.start AND t.stop >= p.stop)"""


def _sql_quantile(values: str, q: float) -> str:
    n, at = f"len({values})", f"least(CAST(floor({q} * len({values})) AS BIGINT), len({values}) - 1)"
    mean = f"({values}[{at} + 1] + {values}[{at}]) / 2"
    return f"round(CASE WHEN {at} > 0 AND abs({q} - {at} / {n}) < 1e-5 THEN {mean} ELSE {values}[{at} + 1] END, 6)"


@query(_SEGMENTS + " SELECT chrom, start, stop, count(*) AS n_samples, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_stdev FROM held GROUP BY ALL")
def interval_intersection_summary(spark, d):
    found = summaries.summarize_segments(t := stored(tracks(spark, d), "tracks"), iv.choose_bin_width(t), ["value"])
    return rounded(found, "value_mean", "value_stdev")


@query(_SEGMENTS + f", lists AS (SELECT chrom, start, stop, list_sort(list(value)) AS v FROM held GROUP BY ALL) SELECT chrom, start, stop, {_sql_quantile('v', 0.025)} AS low, {_sql_quantile('v', 0.5)} AS middle, {_sql_quantile('v', 0.975)} AS high FROM lists")
def interval_quantiles(spark, d):
    parts = iv.intersect_samples(t := stored(tracks(spark, d).drop("sample"), "tracks"), iv.choose_bin_width(t)).groupBy("chrom", "start", "stop").agg(F.collect_list("value").alias("v"))
    return parts.select("chrom", "start", "stop", *[F.round(rank_quantile(F.col("v"), q), 6).alias(n) for n, q in (("low", 0.025), ("middle", 0.5), ("high", 0.975))])


@query(f"WITH lists AS (SELECT l_suppkey, list_sort(list(l_quantity)) AS v FROM lineitem GROUP BY 1) SELECT l_suppkey, {_sql_quantile('v', 0.25)} AS low, {_sql_quantile('v', 0.75)} AS high FROM lists")
def supplier_quantiles(spark, d):
    return rounded(ordered.rank_quantiles(table(spark, d, "lineitem"), "l_suppkey", "l_quantity", {"low": 0.25, "high": 0.75}), "low", "high")


_REGION = f"WITH {TRACKS_SQL}, span AS (SELECT chrom AS c, min(start) + 500 AS a, min(start) + 5000 AS b FROM tracks WHERE chrom = 'click' GROUP BY 1)"


def _region(spark, d):
    first = tracks(spark, d).filter("chrom = 'click'").agg(F.min("start")).first()[0] or 0
    return "click", first + 500, first + 5000


@query(_REGION + " SELECT sample, chrom, start, stop, round(value, 6) AS value FROM tracks, span WHERE chrom = c AND start < b AND stop > a")
def tree_overlap_lookup(spark, d):
    return rounded(iv.overlapping(tracks(spark, d), *_region(spark, d)), "value")


@query(_REGION + " SELECT sample, chrom, greatest(start, a) AS start, least(stop, b) AS stop, round(value, 6) AS value FROM tracks, span WHERE chrom = c AND start < b AND stop > a")
def region_filter_clip(spark, d):
    region = _region(spark, d)
    return rounded(iv.clipped(iv.overlapping(tracks(spark, d), *region), region[1], region[2]), "value")


@query(f"WITH {TRACKS_SQL}, {POINTS_SQL} SELECT point, sample, p.pos, t.start, t.stop FROM points p JOIN tracks t ON p.chrom = t.chrom AND p.pos >= t.start AND p.pos < t.stop")
def point_in_interval(spark, d):
    return iv.join_points(points(spark, d).drop("value"), t := tracks(spark, d), iv.choose_bin_width(t)).select("point", "sample", "pos", "start", "stop")


@query(f"WITH {TRACKS_SQL}, {POINTS_SQL} SELECT point, sample FROM points p JOIN tracks t ON p.chrom = t.chrom AND p.pos > t.start AND p.pos <= t.stop")
def point_in_interval_right(spark, d):
    return iv.join_points(points(spark, d).drop("value"), t := tracks(spark, d), iv.choose_bin_width(t), closed="right").select("point", "sample")


_THIRDS = "one AS (SELECT chrom, start, stop, value FROM tracks WHERE sample = 0), thin AS (SELECT * FROM one WHERE start % 3 <> 0), ends AS (SELECT chrom, max(stop) + 100 AS top FROM one GROUP BY 1)"


def _by_sample(track):
    """A track whose chromosomes are those of each sample, (sample, chrom)."""
    return track.withColumn("chrom", F.struct("sample", "chrom")).drop("sample")


def _samples_apart(found):
    return found.withColumns({"sample": F.col("chrom.sample"), "chrom": F.col("chrom.chrom")})


#: The same for all samples.
@query(f"WITH {TRACKS_SQL}, {POINTS_SQL}, s AS (SELECT DISTINCT sample FROM tracks) SELECT point, s.sample, round(coalesce(t.value, -1), 6) AS value FROM points p CROSS JOIN s LEFT JOIN tracks t ON t.sample = s.sample AND p.chrom = t.chrom AND p.pos >= t.start AND p.pos < t.stop")
def track_lookup(spark, d):
    t = tracks(spark, d)
    asked = _by_sample(points(spark, d).drop("value").crossJoin(F.broadcast(t.select("sample").distinct())))
    return rounded(_samples_apart(iv.lookup_track(asked, _by_sample(t), iv.choose_bin_width(t), -1.0)).select("point", "sample", "value"), "value")


@query(f"""WITH {TRACKS_SQL}, ends AS (SELECT sample, chrom, top FROM (SELECT DISTINCT sample FROM tracks) CROSS JOIN (SELECT chrom, max(stop) + 100 AS top FROM tracks GROUP BY 1)),
gaps AS (SELECT sample, chrom, coalesce(lag(stop) OVER (PARTITION BY sample, chrom ORDER BY start), 0) AS start, start AS stop FROM tracks UNION ALL SELECT sample, chrom, coalesce(max(stop), 0), max(top) FROM ends LEFT JOIN tracks USING (sample, chrom) GROUP BY sample, chrom)
SELECT sample, chrom, start, stop, round(value, 6) AS value FROM tracks UNION ALL SELECT sample, chrom, start, stop, 9 FROM gaps WHERE start < stop""")
def track_complete(spark, d):
    t = tracks(spark, d)
    ends = t.groupBy("chrom").agg((F.max("stop") + 100).alias("chrom_stop")).crossJoin(F.broadcast(t.select("sample").distinct()))
    return rounded(_samples_apart(iv.complete_track(_by_sample(t), _by_sample(ends), 9.0)), "value")


@query(f"""WITH {TRACKS_SQL}
SELECT a.sample, a.chrom, greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS stop, round(a.value, 6) AS a_value, round(b.value, 6) AS b_value FROM tracks a JOIN tracks b ON b.sample = a.sample + 1 AND a.chrom = b.chrom AND a.start < b.stop AND b.start < a.stop""")
def track_refine(spark, d):
    """Each sample against the next."""
    t = tracks(spark, d)
    after = t.withColumn("sample", F.col("sample") - 1)
    return rounded(_samples_apart(iv.join_intervals(_by_sample(t), _by_sample(after), iv.choose_bin_width(t))).select("sample", "chrom", "start", "stop", "a_value", "b_value"), "a_value", "b_value")


@query(f"WITH {TRACKS_SQL}, order_ AS (SELECT *, max(stop) OVER (PARTITION BY chrom ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM (SELECT chrom, start, max(stop) AS stop FROM tracks GROUP BY ALL)) SELECT chrom, start, stop, reached FROM order_ WHERE reached > start")
def track_overlaps(spark, d):
    return iv.check_disjoint(tracks(spark, d).groupBy("chrom", "start").agg(F.max("stop").alias("stop"))).select("chrom", "start", "stop", "reached")


@query(f"WITH {TRACKS_SQL} SELECT sample, chrom, start, unnest(range(CAST(ceil(start / 60) * 60 AS BIGINT), stop, 60)) AS pos FROM tracks")
def grid_positions(spark, d):
    return iv.grid_positions(tracks(spark, d), 60).select("sample", "chrom", "start", "pos")


@query(f"""WITH {TRACKS_SQL}, base AS (SELECT min(start) AS a FROM tracks), regions AS (SELECT n_name AS name, 'click' AS chrom, a + n_nationkey * 700 AS start, a + n_nationkey * 700 + 1000 AS stop FROM nation, base),
held AS (SELECT name, CAST(round(t.value * 1000000) AS HUGEINT) AS millionths, least(r.stop, t.stop) - greatest(r.start, t.start) AS size FROM regions r JOIN tracks t ON r.chrom = t.chrom AND r.start < t.stop AND t.start < r.stop),
sums AS (SELECT name, count(*) AS n_parts, sum(size) AS bases, sum(millionths * size) AS total FROM held GROUP BY name)
SELECT name, n_parts, CAST(bases AS BIGINT) AS bases, CAST((2 * total + bases) // (2 * bases) AS BIGINT) / 1000000 AS mean_value FROM sums""")
def region_batch(spark, d):
    t = tracks(spark, d)
    first = t.agg(F.min("start").alias("a"))
    start = F.col("a") + F.col("n_nationkey") * 700
    nations = table(spark, d, "nation").withColumn("a", first.scalar())
    regions = nations.select(F.col("n_name").alias("name"), F.lit("click").alias("chrom"), start.alias("start"), (start + 1000).alias("stop"))
    return summaries.summarize_regions(t, regions, iv.choose_bin_width(t))


@query(f"WITH {TRACKS_SQL} SELECT a.sample, a.chrom, a.start, a.stop AS pos, round(b.value, 6) AS next_value FROM tracks a JOIN tracks b ON a.sample = b.sample AND a.chrom = b.chrom AND a.stop = b.start")
def tree_spr_pair(spark, d):
    t = tracks(spark, d)
    edits = t.select("sample", "chrom", F.col("start").alias("pos"), F.col("value").alias("next_value"))
    return rounded(t.select("sample", "chrom", "start", F.col("stop").alias("pos")).join(edits, ["sample", "chrom", "pos"]), "next_value")


@query(f"WITH {TRACKS_SQL}, items AS (SELECT sample, chrom, start AS \"at\", 1 AS kind FROM tracks UNION ALL SELECT sample, chrom, stop, 0 FROM tracks) SELECT sample, chrom, \"at\", kind, row_number() OVER (PARTITION BY sample, chrom ORDER BY \"at\", kind) AS place FROM items")
def tree_spr_interleave(spark, d):
    t = tracks(spark, d)
    return ordered.interleave(t, t.select("sample", "chrom", F.col("stop").alias("pos")))


@query(f"WITH {TRACKS_SQL} SELECT sample, chrom, start, stop FROM tracks WHERE sample >= 1 AND sample < 9 AND (sample - 1) % 3 = 0")
def sample_thinning(spark, d):
    return ordered.thin_samples(tracks(spark, d), 1, 9, 3).drop("value")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark, d):
    return ordered.latest(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""WITH marked AS (SELECT user_id, event_type, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type AS opens, ts FROM events),
runs AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM marked)
SELECT user_id, event_type, min(event_id) AS start, max(event_id) + 1 AS stop, count(*) AS n_rows FROM runs GROUP BY user_id, event_type, island""")
def islands_merge(spark, d):
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    rows = table(spark, d, "events").select("user_id", "event_type", at.alias("at"), "event_id", F.col("event_id").alias("start"), (F.col("event_id") + 1).alias("stop"))
    return ordered.merge_islands(rows, ["user_id"], ["at", "event_id"], ["event_type"], width=86_400_000_000)


@query(f"WITH {TRACKS_SQL} SELECT sample, chrom, start, lag(start) OVER w AS prev_start, lag(stop) OVER w AS prev_stop FROM tracks WINDOW w AS (PARTITION BY sample, chrom ORDER BY start)")
def adjacent_pairs(spark, d):
    return ordered.adjacent_pairs(tracks(spark, d), ["sample", "chrom"], ["start"], ["start", "stop"]).select("sample", "chrom", "start", "prev_start", "prev_stop")


@query(f"WITH {POINTS_SQL} SELECT chrom, pos AS start, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS stop FROM (SELECT DISTINCT chrom, pos FROM points) QUALIFY stop IS NOT NULL")
def blocks_from_breaks(spark, d):
    return ordered.blocks_from_breaks(points(spark, d), ["chrom"])


@query(f"WITH {POINTS_SQL}, here AS (SELECT chrom, pos, count(*) AS here FROM points GROUP BY ALL) SELECT chrom, pos, here, CAST(sum(here) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 120 PRECEDING AND 120 FOLLOWING) AS BIGINT) AS n_near FROM here")
def break_windows(spark, d):
    return ordered.sliding_counts(points(spark, d), ["chrom"], "pos", 120)


@query("""WITH regions AS (SELECT n_name AS chrom, n_nationkey * 10 AS start, n_nationkey * 10 + 95 AS stop FROM nation), cut AS (SELECT *, unnest(range(start, stop, 20)) AS t FROM regions)
SELECT chrom, CAST(t AS BIGINT) AS start, CAST(least(t + 20, stop) AS BIGINT) AS stop, CAST(greatest(t - 5, start) AS BIGINT) AS flank_start, CAST(least(least(t + 20, stop) + 5, stop) AS BIGINT) AS flank_stop FROM cut""")
def tiles_with_flanks(spark, d):
    start = (F.col("n_nationkey") * 10).cast("long")
    return iv.tiles(table(spark, d, "nation").select(F.col("n_name").alias("chrom"), start.alias("start"), (start + 95).alias("stop")), 20, 5)


@query(f"WITH {POINTS_SQL}, n AS (SELECT point, chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos, point) - 1 AS i FROM points) SELECT point, chrom, i + greatest(0, max(pos - i) OVER (PARTITION BY chrom ORDER BY pos, point)) AS unique_pos FROM n")
def unique_positions(spark, d):
    return ordered.unique_positions(points(spark, d), ["chrom"], ["pos", "point"], "pos").select("point", "chrom", "unique_pos")


@query(f"WITH {SITES_SQL} SELECT * FROM sites")
def sites_from_rows(spark, d):
    return sites(spark, d)


@query(f"WITH {SITES_SQL} SELECT * FROM sites WHERE replace(col, left(col, 1), '') <> ''")
def variant_sites(spark, d):
    return st.variant_sites(sites(spark, d))


_SYMBOLS = "len(list_distinct(string_split(col, '')))"


@query(f"WITH {SITES_SQL} SELECT * FROM sites WHERE {_SYMBOLS} = 2")
def biallelic_sites(spark, d):
    return st.biallelic_sites(sites(spark, d))


@query(f"WITH {SITES_SQL} SELECT * FROM sites WHERE replace(col, 'N', '') = ''")
def masked_sites(spark, d):
    found = sites(spark, d)
    return found.filter(st.is_masked(F.col("col")))


@query()
def bootstrap_sites(spark, d):
    return st.bootstrap_sites(sites(spark, d), 1)


@query(f"WITH {SITES_SQL} SELECT chrom, pos, col[3] || col[1] AS col FROM sites")
def sites_project(spark, d):
    return st.project_sequences(sites(spark, d), [2, 0])


@query(f"WITH {SITES_SQL} SELECT * FROM sites WHERE pos BETWEEN 100 AND 900")
def site_range_lookup(spark, d):
    return st.sites_in_range(sites(spark, d), "1", 100, 900)


@query(f"WITH {SITES_SQL}, x AS (SELECT pos, unnest(string_split(col, '')) AS base FROM sites) SELECT '1' AS chrom, pos, base, count(*) AS n FROM x GROUP BY ALL")
def allele_counts(spark, d):
    return st.allele_counts(sites(spark, d))


@query(f"""WITH {SITES_SQL}, two AS (SELECT *, left(col, 1) AS f, left(replace(col, left(col, 1), ''), 1) AS o, length(col) - length(replace(col, left(col, 1), '')) AS nf FROM sites WHERE {_SYMBOLS} = 2)
SELECT chrom, pos, CASE WHEN 2 * nf <= length(col) THEN f ELSE o END AS minor, CASE WHEN 2 * nf <= length(col) THEN o ELSE f END AS major, CAST(least(nf, length(col) - nf) AS INT) AS n_minor, CAST(greatest(nf, length(col) - nf) AS INT) AS n_major FROM two""")
def minor_allele(spark, d):
    return st.minor_allele(sites(spark, d))


_FOUR = f"{SITES_SQL}, four AS (SELECT pos, left(col, 4) AS col FROM sites WHERE length(col) >= 4)"


def _four(spark, d):
    return sites(spark, d).filter("length(col) >= 4").withColumn("col", F.substring("col", 1, 4))


def _sql_mean(test: str) -> str:
    return "(" + " + ".join(f"CAST({test.format(i=i)} AS INT)" for i in range(1, 5)) + ") / 4"


_CONFLICTS = f"""WITH {_FOUR}, letters AS (SELECT pos, unnest(range(4)) AS i, col FROM four), counted AS (SELECT pos, col[i + 1] AS base, count(*) AS n, list(i) AS leaves FROM letters GROUP BY ALL),
splits AS (SELECT pos, arg_min(leaves, (n, base)) AS s FROM counted GROUP BY pos),
conflicts AS (SELECT a.pos AS a_pos, b.pos AS b_pos FROM splits a JOIN splits b ON a.pos < b.pos AND b.pos - a.pos <= {DISTANCE} AND list_has_any(a.s, b.s) AND NOT list_has_all(a.s, b.s) AND NOT list_has_all(b.s, a.s))"""


def _conflicts(spark, d):
    return st.conflicting_pairs(_four(spark, d), DISTANCE)


#: The same over whole columns: a pair of sites is compared over all sequences that both have.
@query(f"""WITH {SITES_SQL}, marks AS (SELECT pos, i, CAST(col[i] <> col[1] AS INT) AS m FROM (SELECT pos, col, unnest(range(1, length(col) + 1)) AS i FROM sites)),
x AS (SELECT a.pos AS a_pos, b.pos AS b_pos, sum(a.m) / count(*) AS p, sum(b.m) / count(*) AS q, sum(a.m * b.m) / count(*) AS x FROM marks a JOIN marks b ON a.i = b.i AND a.pos < b.pos AND b.pos - a.pos <= {DISTANCE} GROUP BY ALL),
y AS (SELECT *, x - p * q AS d FROM x)
SELECT a_pos, b_pos, round(d, 6) AS d, round(CASE WHEN d = 0 THEN 0 WHEN d < 0 THEN d / least(p * q, (1 - p) * (1 - q)) ELSE d / least(p * (1 - q), (1 - p) * q) END, 6) AS d_prime,
round(CASE WHEN p * (1 - p) * q * (1 - q) <> 0 THEN d * d / (p * (1 - p) * q * (1 - q)) END, 6) AS r2 FROM y""")
def ld_pairs(spark, d):
    return rounded(st.linkage(sites(spark, d), DISTANCE).drop("chrom"), "d", "d_prime", "r2")


_WHOLE_CONFLICTS = f"""WITH {SITES_SQL}, parts AS (SELECT pos, size, col, unnest(range(1, size + 1)) AS i FROM (SELECT pos, col, unnest(range(1, length(col) + 1)) AS size FROM sites)),
counted AS (SELECT pos, size, col[i] AS base, count(*) AS n, list(i) AS leaves FROM parts GROUP BY ALL),
splits AS (SELECT pos, size, arg_min(leaves, (n, base)) AS s FROM counted GROUP BY ALL),
pairs AS (SELECT a.pos AS a_pos, b.pos AS b_pos, least(length(a.col), length(b.col)) AS size FROM (SELECT pos, col, unnest(range(1, {DISTANCE} + 1)) AS d FROM sites) a JOIN sites b ON b.pos = a.pos + a.d),
conflicts AS (SELECT a_pos, b_pos FROM pairs p JOIN splits a ON a.pos = a_pos AND a.size = p.size JOIN splits b ON b.pos = b_pos AND b.size = p.size WHERE list_has_any(a.s, b.s) AND NOT list_has_all(a.s, b.s) AND NOT list_has_all(b.s, a.s))"""


def _whole_conflicts(spark, d):
    return st.conflicting_pairs(sites(spark, d), DISTANCE)


@query(_WHOLE_CONFLICTS + " SELECT '1' AS chrom, a_pos, b_pos FROM conflicts")
def split_conflicts(spark, d):
    return _whole_conflicts(spark, d)


@query(_WHOLE_CONFLICTS + ", both_ AS (SELECT a_pos AS pos, NULL AS l, b_pos AS r FROM conflicts UNION ALL SELECT b_pos, a_pos, NULL FROM conflicts) SELECT '1' AS chrom, pos, max(l) AS \"left\", min(r) AS \"right\" FROM both_ GROUP BY pos")
def nearest_conflict(spark, d):
    return st.nearest_conflicts(_whole_conflicts(spark, d))


@query(_WHOLE_CONFLICTS + " SELECT '1' AS chrom, a.a_pos, min(a.b_pos) AS b_pos FROM conflicts a GROUP BY a.a_pos HAVING NOT EXISTS (SELECT 1 FROM conflicts b WHERE b.a_pos > a.a_pos AND b.b_pos <= min(a.b_pos))")
def unnested_conflicts(spark, d):
    return st.unnested_conflicts(_whole_conflicts(spark, d))


#: Breaks one after the other: the next is the first right end of a pair that begins at or behind the last.
_BREAKS = _WHOLE_CONFLICTS.replace("WITH ", "WITH RECURSIVE ", 1) + ", breaks AS (SELECT min(b_pos) AS pos FROM conflicts UNION ALL SELECT (SELECT min(b_pos) FROM conflicts WHERE a_pos >= breaks.pos) FROM breaks WHERE pos IS NOT NULL)"


@query(_BREAKS + " SELECT '1' AS chrom, pos FROM breaks WHERE pos IS NOT NULL")
def break_points(spark, d):
    return st.stab_intervals(_whole_conflicts(spark, d))


@query(f"WITH {SITES_SQL} SELECT chrom, pos, CASE WHEN EXISTS (SELECT 1 FROM nation WHERE pos >= n_nationkey * 50 AND pos < n_nationkey * 50 + 20) THEN repeat('N', length(col)) ELSE col END AS col FROM sites")
def mask_sites(spark, d):
    start = (F.col("n_nationkey") * 50).cast("long")
    return st.apply_mask(sites(spark, d), table(spark, d, "nation").select(F.lit("1").alias("chrom"), start.alias("start"), (start + 20).alias("stop")))


@query(f"""WITH {JOINTS_SQL} SELECT k * 10 AS start, max(age) AS tmrca, sum(age) + max(age) AS branchlen,
round(sum((size - j + 1) * (size - j) * (age - below)) / (4 * max(size) - 4), 6) AS popsize, 0 + count(*) FILTER (WHERE age - below < 1e-4) AS zero_len
FROM (SELECT *, coalesce(lag(age) OVER (PARTITION BY k ORDER BY j), 0) AS below FROM joints) GROUP BY k""")
def tree_statistics(spark, d):
    found = tr.tree_statistics(trees(spark, d), ["tmrca", "branchlen", "popsize", "zero_len"]).select("start", "tmrca", "branchlen", "popsize", F.col("zero_len").cast("long").alias("zero_len"))
    return rounded(found, "popsize")


@query(f"WITH {JOINTS_SQL}, l AS (SELECT k, sum(age) + max(age) AS len FROM joints GROUP BY k) SELECT k % 4 AS sample, sum(len * 10) AS arg_length FROM l GROUP BY 1")
def arg_length(spark, d):
    return trees(spark, d).groupBy("sample").agg(F.sum(tr.tree_length() * (F.col("stop") - F.col("start"))).alias("arg_length"))


def _sql_bin(age: str) -> str:
    return f"(SELECT arg_min(i - 1, (abs({age} - g[i]), i)) FROM (SELECT {GRID} AS g, unnest(range(1, {len(GRID) + 1})) AS i))"


@query(f"WITH {JOINTS_SQL}, b AS (SELECT k, {_sql_bin('age')} AS time_bin FROM joints) SELECT k * 10 AS start, CAST(time_bin AS INT) AS time_bin, count(*) AS n_coal FROM b GROUP BY ALL")
def coal_counts(spark, d):
    return tr.coal_counts(trees(spark, d), ["start"], GRID)


_BRANCHES = f"{JOINTS_SQL}, branches AS (SELECT k, 0.0 AS low, age AS high FROM joints UNION ALL SELECT k, 0.0, age FROM joints WHERE j = 1 UNION ALL SELECT k, below, age FROM (SELECT *, lag(age) OVER (PARTITION BY k ORDER BY j) AS below FROM joints) WHERE below IS NOT NULL)"


@query(f"WITH {_BRANCHES}, b AS (SELECT k, {_sql_bin('low')} AS l, {_sql_bin('high')} AS h FROM branches), x AS (SELECT k, unnest(range(l, h)) AS time_bin FROM b) SELECT k * 10 AS start, CAST(time_bin AS INT) AS time_bin, count(*) AS n_branches FROM x GROUP BY ALL")
def lineage_counts(spark, d):
    return tr.lineage_counts(trees(spark, d), ["start"], GRID)


@query(f"WITH {_BRANCHES}, all_ AS (SELECT * FROM branches UNION ALL SELECT k, max(age), NULL FROM joints GROUP BY k), b AS (SELECT k, {_sql_bin('low')} AS l, least({len(GRID) - 2}, CASE WHEN high IS NULL THEN {len(GRID) - 2} ELSE {_sql_bin('high')} END) AS h FROM all_) SELECT k * 10 AS start, CAST(sum(greatest(h - l + 1, 0)) AS BIGINT) AS n_states FROM b GROUP BY k")
def coal_states(spark, d):
    found = tr.coal_states(trees(spark, d), ["start"], GRID).groupBy("start").agg(F.count(F.lit(1)).alias("n"))
    return trees(spark, d).select("start").join(found, "start", "left").select("start", F.coalesce("n", F.lit(0)).cast("long").alias("n_states"))


@query(f"SELECT l_quantity, CAST({_sql_bin('l_quantity')} AS INT) AS time_bin, count(*) AS n FROM lineitem GROUP BY ALL")
def nearest_grid_time(spark, d):
    return table(spark, d, "lineitem").groupBy("l_quantity", nearest_time(F.col("l_quantity"), GRID).alias("time_bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {JOINTS_SQL}, tops AS (SELECT k % 4 AS sample, max(age) AS top FROM joints GROUP BY 1) SELECT sample, CAST(i AS INT) AS i, round((exp(i * ln(1 + 0.01 * top) / 11) - 1) / 0.01, 6) AS t FROM tops, (SELECT unnest(range(12)) AS i)")
def time_points(spark, d):
    """A grid of twelve times for each sample, up to the oldest joint of its trees."""
    tops = trees(spark, d).groupBy("sample").agg(F.max(tr.tmrca()).alias("top"))
    return rounded(tops.select("sample", F.posexplode(grid_up_to(F.col("top"), 12)).alias("i", "t")), "t")


@query("SELECT user_id, round(max(value) + ln(sum(exp(value - m))), 6) AS total FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def log_sum(spark, d):
    return rounded(ordered.log_sums(table(spark, d, "events").select("user_id", "value"), "user_id", "value"), "total")


@query(_SEGMENTS + f""", m AS (SELECT chrom, start, stop, avg(value) AS len, count(*) AS n FROM held GROUP BY ALL), {POINTS_SQL}, b AS (SELECT chrom, pos AS start, count(*) AS c FROM points GROUP BY ALL),
r AS (SELECT m.chrom, m.start, m.stop, coalesce(c, 0) / len / n AS rate FROM m LEFT JOIN b USING (chrom, start))
SELECT chrom, start, stop, round(rate, 6) AS rate, round(avg(rate) OVER (PARTITION BY chrom ORDER BY start RANGE BETWEEN 60 PRECEDING AND 60 FOLLOWING), 6) AS rate_near FROM r""")
def recombination_rates(spark, d):
    lengths = stored(tracks(spark, d).drop("sample").withColumnRenamed("value", "branchlen"), "tracks")
    return rounded(summaries.recombination_rates(points(spark, d), lengths, iv.choose_bin_width(lengths), 60), "rate", "rate_near")


@query()
def tree_halves(spark, d):
    return tr.tree_statistics(trees(spark, d), ["tmrca_half", "rth"]).select("start", "tmrca_half", "rth")


@query(f"WITH {JOINTS_SQL} SELECT k * 10 AS start, 2 * age AS distance FROM joints WHERE j = size - 1")
def leaf_distances(spark, d):
    return trees(spark, d).select("start", tr.leaf_distance(F.lit(0), tr.n_leaves("ptree") - 1).alias("distance"))


@query(f"WITH {JOINTS_SQL} SELECT size AS leaves, array_to_string(range(j + 1), ',') AS clade, count(*) AS n_trees FROM joints GROUP BY size, j")
def majority_clades(spark, d):
    return tr.majority_clades(trees(spark, d).withColumn("leaves", F.size("ptree") - tr.n_leaves("ptree") + 1), ["leaves"]).select(F.col("leaves").cast("long").alias("leaves"), "clade", "n_trees")


@query(f"""WITH {NODES_SQL}, runs AS (SELECT g.k, g.size, coalesce((SELECT max(o.i) FROM gaps o WHERE o.k = g.k AND o.i < g.i AND o.r > g.r), 0) AS lo, coalesce((SELECT min(o.i) FROM gaps o WHERE o.k = g.k AND o.i > g.i AND o.r > g.r), g.size) AS hi FROM gaps g),
shapes AS (SELECT k, size, list((lo, hi) ORDER BY lo, hi) AS shape FROM runs GROUP BY k, size) SELECT CAST(size AS INT) AS leaves, count(*) AS n_trees, count(DISTINCT shape) AS n_topologies FROM shapes GROUP BY size""")
def tree_topologies(spark, d):
    return bushy_trees(spark, d).groupBy(tr.n_leaves("ptree").alias("leaves")).agg(F.count(F.lit(1)).alias("n_trees"), F.count_distinct(tr.topology_hash()).alias("n_topologies"))


@query(f"WITH {JOINTS_SQL} SELECT k * 10 AS start, [2, 2, -1] AS ptree, [0.0, 0.0, max(age)] AS age FROM joints GROUP BY k")
def pruned_trees(spark, d):
    """The first and the last leaf."""
    return trees(spark, d).select("start", forest.prune(F.array(F.lit(0), tr.n_leaves("ptree") - 1)).alias("t")).select("start", "t.ptree", "t.age")


@query()
def allele_ages(spark, d):
    return trees(spark, d).select("start", tr.allele_age(F.array(F.lit(0))).alias("a")).select("start", "a.age", "a.infinite_sites", "a.flipped")


@query()
def newick_round_trip(spark, d):
    named = trees(spark, d).withColumn("names", F.transform("ptree", lambda x: F.lit("n")))
    return named.withColumn("newick", format_newick("ptree", "age", "names")).select("start", "newick", parse_newick("newick").alias("t")).select("start", "newick", "t.age")


@query()
def spr_replay(spark, d):
    """Every tree as the first of a region of its own, with an edit for each leaf: leaf i, from base i + 1 of the block on, joins leaf i + 1, the last leaf 0."""
    region = F.concat_ws(":", "chrom", "start")
    first = trees(spark, d).withColumn("chrom", region)
    edits = first.select("sample", "chrom", "start", tr.n_leaves("ptree").alias("n"), F.explode(F.sequence(F.lit(0), tr.n_leaves("ptree") - 1)).alias("recomb_node"))
    edits = edits.select("sample", "chrom", (F.col("start") + F.col("recomb_node") + 1).alias("pos"), "recomb_node", ((F.col("recomb_node") + 1) % F.col("n")).alias("coal_node"), F.lit(0.5).alias("coal_time"))
    return spr.replay(first.drop("stop"), edits, first.select("sample", "chrom", "stop")).withColumn("chrom", F.substring_index("chrom", ":", 1))
