"""What is written in a text format and read again is what was written."""

from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import ordered, trees as tr
from ..sources import text
from ..sources.newick import format_newick, parse_newick
from ..sources.scratch import scratch_folder, stored
from ..tables import JOINTS_SQL, SITES_SQL, TRACKS_SQL, sites, table, tracks, trees
from .core import rounded


@query(f"WITH {SITES_SQL} SELECT * FROM sites")
def sites_file(spark, d):
    path = scratch_folder(spark, "sites")
    text.write_sites(sites(spark, d), [f"n{i}" for i in range(8)], "1", 0, 10**9, path)
    return text.read_sites(spark, path)[0].drop("file")


@query(f"""WITH {SITES_SQL} SELECT chrom, pos, CASE WHEN length(col) <> 4 THEN 'width' WHEN NOT regexp_matches(col, '^[ACGTN]+$') THEN 'symbol' WHEN times > 1 THEN 'repeated position' END AS reason
FROM (SELECT *, count(*) OVER (PARTITION BY pos) AS times FROM (SELECT '1' AS chrom, pos // 2 AS pos, col FROM sites)) WHERE reason IS NOT NULL""")
def site_faults(spark, d):
    """Two sites a position, of a set of four names; other symbols than bases are faults too."""
    found = sites(spark, d).select(F.lit("x").alias("file"), "chrom", F.expr("pos div 2").alias("pos"), "col")
    names = table(spark, d, "nation").filter("n_nationkey < 4").select(F.lit("x").alias("file"), F.col("n_nationkey").alias("place"), F.col("n_name").alias("name"))
    return text.site_violations(found, names).drop("file")


@query(f"WITH {SITES_SQL} SELECT * FROM sites")
def snp_bed_file(spark, d):
    path = scratch_folder(spark, "snps")
    text.write_snp_bed(sites(spark, d), [f"n{i}" for i in range(8)], path)
    return text.read_snp_bed(spark, path)[0]


@query(f"""WITH {SITES_SQL}, letters AS (SELECT pos, col, col[i] AS base FROM (SELECT pos, col, unnest(range(1, length(col) + 1)) AS i FROM sites)),
counted AS (SELECT pos, col, base, count(*) AS n FROM letters WHERE base <> 'N' GROUP BY ALL)
SELECT '1' AS chrom, pos, col, arg_min(base, (n, base)) AS minor FROM counted GROUP BY pos, col HAVING count(*) = 2""")
def biallelic_snps(spark, d):
    return text.biallelic_snps(sites(spark, d))


@query(f"WITH {TRACKS_SQL} SELECT sample || ':' || chrom AS chrom, start, stop, round(value, 6) AS value FROM tracks")
def track_file(spark, d):
    path = scratch_folder(spark, "track")
    text.write_track(tracks(spark, d).withColumn("chrom", F.concat_ws(":", F.col("sample").cast("string"), "chrom")), path)
    return rounded(text.read_track(spark, path), "value")


@query(f"WITH {TRACKS_SQL} SELECT chrom || '.' || sample AS chrom, start, stop, CAST(NULL AS DOUBLE) AS value FROM tracks")
def mask_file(spark, d):
    """The spans of every sample, chromosomes named after it."""
    path = scratch_folder(spark, "mask")
    text.write_track(tracks(spark, d).select(F.concat_ws(".", "chrom", F.col("sample").cast("string")).alias("chrom"), "start", "stop"), path)
    return text.read_track(spark, path)


def _newick_trees(spark, d):
    leaf = F.transform("ptree", lambda up, i: F.when(i < tr.n_leaves("ptree"), i.cast("string")).otherwise(F.lit("")))
    return trees(spark, d).withColumn("newick", format_newick("ptree", "age", leaf))


@query(f"WITH {JOINTS_SQL}, leaves AS (SELECT k, unnest(range(max(size))) AS x FROM joints GROUP BY k) SELECT k * 10 AS start, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT k, coalesce(n_name, CAST(x AS VARCHAR)) AS name FROM leaves LEFT JOIN nation ON n_nationkey = x) GROUP BY k")
def named_leaves(spark, d):
    """Trees read from Newick whose leaves get the nations' names by place; further leaves keep their numbers."""
    parsed = _newick_trees(spark, d).select("start", parse_newick("newick").alias("tree"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("name"))
    found = text.renamed_leaves(parsed, names)
    return found.select("start", F.array_join(F.array_sort(F.filter("names", lambda x: x != "")), ",").alias("names"))


@query(f"WITH {JOINTS_SQL} SELECT k % 4 AS sample, '1' AS chrom, k * 10 AS start, k * 10 + 10 AS stop, max(age) AS tmrca, sum(age) + max(age) AS branchlen, array_to_string(range(max(size)), ',') AS leaves FROM joints GROUP BY k")
def smc_files(spark, d):
    """A file for each of four samples, read as one set, with the sample's number from the file's name; trees are parsed from their text."""
    path, rows = scratch_folder(spark, "smc"), stored(_newick_trees(spark, d).select("sample", "chrom", "start", "stop", "newick"), "trees", by=("sample",))
    none = spark.createDataFrame([], "chrom string, pos long, recomb_node int, recomb_time double, coal_node int, coal_time double")
    for sample in range(4):
        text.write_smc(rows.filter(F.col("sample") == sample), none, ["a", "b"], "1", f"{path}/out.{sample}.smc")
    found = text.read_smc(spark, f"{path}/out.*.smc", r"out\.(\d+)\.smc")[0].withColumn("tree", parse_newick("newick"))
    named = found.select("sample", "chrom", "start", "stop", "tree.*")
    leaves = F.array_join(F.transform(F.array_sort(F.transform(F.filter("names", lambda x: x != ""), lambda x: x.cast("int"))), lambda x: x.cast("string")), ",")
    return named.select("sample", "chrom", "start", "stop", tr.tmrca().alias("tmrca"), tr.tree_length().alias("branchlen"), leaves.alias("leaves"))


@query(f"WITH {TRACKS_SQL}, e AS (SELECT * FROM tracks WHERE sample = 1 AND chrom = 'click') SELECT chrom, start AS pos, CAST(sample AS INT) AS recomb_node, round(value, 6) AS recomb_time, CAST(2 AS INT) AS coal_node, round(value + 1, 6) AS coal_time FROM e")
def smc_edits(spark, d):
    path = scratch_folder(spark, "smc")
    own = tracks(spark, d).filter("sample = 1 AND chrom = 'click'")
    edits = own.select("chrom", F.col("start").alias("pos"), F.col("sample").cast("int").alias("recomb_node"), F.col("value").alias("recomb_time"), F.lit(2).alias("coal_node"), (F.col("value") + 1).alias("coal_time"))
    text.write_smc(own.select("chrom", "start", "stop", F.lit("0;").alias("newick")), edits, ["a", "b"], "click", f"{path}/x.1.smc")
    return rounded(text.read_smc(spark, f"{path}/x.1.smc", r"x\.(\d+)\.smc")[1].drop("sample"), "recomb_time", "coal_time")


@query(f"WITH {JOINTS_SQL} SELECT k % 4 AS sample, greatest(k * 10, 1005) AS start, least(k * 10 + 10, 3001) AS stop, max(age) AS tmrca FROM joints GROUP BY k HAVING k * 10 < 3001 AND k * 10 + 10 > 1005")
def smc_region(spark, d):
    cut, _ = text.clip_smc(trees(spark, d), trees(spark, d).select("chrom", F.col("start").alias("pos")), "1", 1005, 3001)
    return cut.select("sample", "start", "stop", tr.tmrca().alias("tmrca"))


@query(f"WITH {JOINTS_SQL} SELECT k * 10 AS start, k * 10 + 10 AS stop, k % 4 AS sample, max(age) AS tmrca, CASE WHEN k % 3 = 0 THEN max(age) / 2 END AS recomb_time FROM joints GROUP BY k")
def tree_bed_file(spark, d):
    path, rows = scratch_folder(spark, "bed"), _newick_trees(spark, d)
    text.write_tree_bed(rows, path)
    back = text.read_tree_bed(spark, path)
    edits = rows.filter("start % 30 = 0").select("sample", "chrom", F.col("stop").alias("pos"), (tr.tmrca() / 2).alias("recomb_time"), tr.tmrca().alias("coal_time"))
    joined = text.smc_to_bed(back, edits).withColumn("tree", parse_newick("newick"))
    return joined.select("start", "stop", "sample", F.array_max("tree.age").alias("tmrca"), "recomb_time")


_SEQUENCES = "seqs AS (SELECT 's' || l_suppkey AS name, replace(string_agg(l_returnflag, '' ORDER BY l_orderkey, l_linenumber, l_partkey, l_returnflag), 'R', 'G') AS seq FROM lineitem GROUP BY l_suppkey)"


def _sequences(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"))).alias("x"))
    return rows.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("name"), F.translate(F.array_join(F.transform("x", lambda s: s["l_returnflag"]), ""), "R", "G").alias("seq"))


@query(f"WITH {_SEQUENCES} SELECT * FROM seqs")
def fasta_file(spark, d):
    path = scratch_folder(spark, "fasta")
    text.write_fasta(_sequences(spark, d), path)
    return text.read_fasta(spark, path).drop("file")


@query(f"WITH {_SEQUENCES} SELECT name, CAST(length(seq) AS INT) AS length FROM seqs WHERE length(seq) < (SELECT max(length(seq)) FROM seqs)")
def fasta_faults(spark, d):
    return text.fasta_faults(_sequences(spark, d).withColumn("file", F.lit("x"))).drop("file")


@query(f"WITH {_SEQUENCES}, cut AS (SELECT row_number() OVER (ORDER BY name) - 1 AS place, rpad(seq, 200, 'A')[1:200] AS seq FROM seqs WHERE name IN ('s1', 's2', 's3', 's4')), cols AS (SELECT i - 1 AS pos, string_agg(seq[i], '' ORDER BY place) AS col FROM cut, range(1, 201) t(i) GROUP BY i) SELECT 'c' AS chrom, pos, col FROM cols WHERE replace(col, left(col, 1), '') <> ''")
def sites_of_alignment(spark, d):
    own = _sequences(spark, d).filter("name IN ('s1', 's2', 's3', 's4')").select((F.substring("name", 2, 1).cast("int") - 1).alias("place"), F.substring(F.rpad("seq", 200, "A"), 1, 200).alias("seq"))
    return text.fasta_to_sites(own, "c")


@query("SELECT 'r' || r_regionkey AS chrom, r_regionkey * 10 AS start, r_regionkey * 10 + 10 AS stop, n_name AS name, CAST(n_nationkey + 0.5 AS DOUBLE) AS y FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey >= 1")
def layout_file(spark, d):
    path = scratch_folder(spark, "layout")
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_nationkey") + 0.5))).alias("ys"))
    start = (F.col("n_regionkey") * 10).cast("long")
    text.write_layout(rows.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("chrom"), start.alias("start"), (start + 10).alias("stop"), "ys"), path)
    found = [text.read_layout(spark, path, (f"r{i}", 10 * i + 9, 10 * i + 30)) for i in range(1, 5)]
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole.select("chrom", "start", "stop", F.explode("ys").alias("name", "y"))


@query("SELECT n_name || '_1' AS one, n_name || '_2' AS two FROM nation")
def name_pairs_file(spark, d):
    path = scratch_folder(spark, "pairs")
    table(spark, d, "nation").select(F.concat("n_name", F.lit("_1 \t"), "n_name", F.lit("_2"))).write.text(path)
    return text.read_name_pairs(spark, path)


@query("SELECT CAST(event_id AS DOUBLE) AS pos, round(value, 6) AS age, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'n' || user_id || ',m' || user_id END AS leaves FROM events")
def mutation_file(spark, d):
    path = scratch_folder(spark, "mutations")
    leaves = F.when(F.col("event_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(*[F.concat(F.lit(x), F.col("user_id").cast("string")) for x in "nm"]))
    text.write_mutations(table(spark, d, "events").select("event_id", leaves.alias("leaves"), F.col("value").alias("age"), F.col("event_id").cast("double").alias("pos")), path)
    return rounded(text.read_mutations(spark, path).withColumn("leaves", F.array_join("leaves", ",")), "age")


@query("SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'seq' ELSE 'resample' END AS stage, CAST(max(l_orderkey) AS INT) AS iter FROM lineitem GROUP BY 1")
def run_stats_file(spark, d):
    """Appended twice, as a run that is resumed does."""
    path = scratch_folder(spark, "stats")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_tax").alias("prior"), F.sum("l_discount").alias("likelihood"), F.count(F.lit(1)).cast("int").alias("recombs"))
    stats = rows.select(F.when(F.col("l_orderkey") % 2 == 0, "seq").otherwise("resample").alias("stage"), F.col("l_orderkey").cast("int").alias("iter"), "prior", "likelihood", (F.col("prior") + F.col("likelihood")).alias("joint"), "recombs", F.lit(0).alias("noncompats"), F.lit(1.5).alias("arglen"))
    for part in ("iter % 3 = 0", "iter % 3 <> 0"):
        text.append_run_stats(stats.filter(part), path)
    return text.last_iteration(text.read_run_stats(spark, path))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS name, 'coal' AS event, sum(l_quantity) AS age, CAST(count(*) AS DOUBLE) AS pos, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) AS parents, '' AS children FROM lineitem GROUP BY l_orderkey")
def arg_file(spark, d):
    path = scratch_folder(spark, "arg")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("age"), F.count(F.lit(1)).cast("double").alias("pos"), F.sort_array(F.collect_list("l_suppkey")).alias("x"))
    nodes = rows.select(F.col("l_orderkey").cast("string").alias("name"), F.lit("coal").alias("event"), "age", "pos", F.transform("x", lambda y: y.cast("string")).alias("parents"), F.array().cast("array<string>").alias("children"))
    text.write_arg(nodes, 0, 100, path)
    back = text.read_arg(spark, path).drop("file")
    return back.withColumns({c: F.array_join(c, ",") for c in ("parents", "children")})


@query(f"WITH {TRACKS_SQL} SELECT sample, chrom, start, stop, round(CASE WHEN start % 2 = 0 THEN value + 1 ELSE value END, 6) AS value FROM tracks")
def stored_tracks(spark, d):
    """Two loads of a store; where both have a block the later one counts."""
    path = scratch_folder(spark, "store")
    t = tracks(spark, d)
    text.store(t, path, ["start"], load=1)
    text.store(t.filter("start % 2 = 0").withColumn("value", F.col("value") + 1), path, ["start"], load=2)
    back = ordered.latest(spark.read.parquet(path), ["sample", "chrom", "start", "stop"], ["load"])
    return rounded(back.select("sample", "chrom", "start", "stop", "value"), "value")
