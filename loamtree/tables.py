"""Genomic roles on the star-schema tables: tracks, points, sites and trees that any of the operators can be run on."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _minute():
    return F.floor(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 60).cast("long")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point, chrom, pos, value: an event each, by minute."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("point"), F.col("event_type").alias("chrom"), _minute().alias("pos"), "value")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, chrom, start, stop, value: from each event of a sample to its next."""
    events = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("sample"), F.col("event_type").alias("chrom"), _minute().alias("start")).agg(F.avg("value").alias("value"))
    window = Window.partitionBy("sample", "chrom").orderBy("start")
    return events.withColumn("stop", F.lead("start").over(window)).filter("stop IS NOT NULL").select("sample", "chrom", "start", "stop", "value")


def one_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The disjoint intervals of sample 0."""
    return tracks(spark, sf_dir).filter("sample = 0").drop("sample")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, pos, col: the return flags of an order's lines as one column, by line."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x"))
    return lines.select(F.lit("1").alias("chrom"), F.col("l_orderkey").alias("pos"), F.array_join(F.transform("x", lambda s: s["l_returnflag"]), "").alias("col"))


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, chrom, start, stop, ptree, age: for each order of two lines or more a ladder whose k-th joint is as old as its k + 1 smallest quantities together."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_quantity")).alias("q")).filter("size(q) > 1")
    k = F.size("q")
    leaf_up = F.transform(F.sequence(F.lit(0), k - 1), lambda i: (k + F.greatest(i - 1, F.lit(0))).cast("int"))
    joint_up = F.transform(F.sequence(F.lit(0), k - 2), lambda j: F.when(j == k - 2, F.lit(-1)).otherwise(k + j + 1).cast("int"))
    joint_age = F.transform(F.sequence(F.lit(2), k), lambda n: F.aggregate(F.slice("q", F.lit(1), n), F.lit(0.0), lambda s, x: s + x))
    return lines.select(
        (F.col("l_orderkey") % 4).alias("sample"), F.lit("1").alias("chrom"), (F.col("l_orderkey") * 10).alias("start"), (F.col("l_orderkey") * 10 + 10).alias("stop"),
        F.concat(leaf_up, joint_up).alias("ptree"), F.concat(F.array_repeat(F.lit(0.0), k), joint_age).alias("age"),
    )


def bushy_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, chrom, start, stop, ptree, age, as trees(), but of any shape: an order's lines are the leaves, and the gap before each further line is a joint.

    Joints are numbered by the line's quantity, then by place; one is as old as
    the quantities up to its own together, and has the run of leaves around its
    gap that no older joint cuts.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("x")).filter("size(x) > 1")
    n = F.size("x")
    gaps = F.transform(F.slice("x", F.lit(2), n - 1), lambda s, i: F.struct(s["l_quantity"].alias("q"), i.alias("i")))
    placed = lines.withColumn("g", gaps).withColumn("by_age", F.sort_array("g"))
    placed = placed.withColumn("rank", F.transform("g", lambda y: (F.array_position("by_age", y) - 1).cast("int")))
    leaf_up = F.transform("x", lambda _, j: n + F.least(F.get("rank", j - 1), F.get("rank", j)))

    def joint_up(y, r):
        left = F.get(F.reverse(F.filter(F.slice("rank", F.lit(1), y["i"]), lambda o: o > r)), F.lit(0))
        right = F.get(F.filter(F.slice("rank", y["i"] + 2, n), lambda o: o > r), F.lit(0))
        return F.coalesce(n + F.least(left, right), F.lit(-1))

    joint_age = F.transform("by_age", lambda _, r: F.aggregate(F.slice("by_age", F.lit(1), r + 1), F.lit(0.0), lambda s, y: s + y["q"]))
    return placed.select(
        (F.col("l_orderkey") % 4).alias("sample"), F.lit("1").alias("chrom"), (F.col("l_orderkey") * 10).alias("start"), (F.col("l_orderkey") * 10 + 10).alias("stop"),
        F.concat(leaf_up, F.transform("by_age", joint_up)).cast("array<int>").alias("ptree"), F.concat(F.array_repeat(F.lit(0.0), n), joint_age).alias("age"),
    )


#: The same in SQL, to start a WITH.
POINTS_SQL = "points AS (SELECT event_id AS point, event_type AS chrom, CAST(floor(epoch(ts) / 60) AS BIGINT) AS pos, value FROM events)"
TRACKS_SQL = """tracks AS (
  SELECT sample, chrom, start, lead(start) OVER (PARTITION BY sample, chrom ORDER BY start) AS stop, value
  FROM (SELECT user_id % 10 AS sample, event_type AS chrom, CAST(floor(epoch(ts) / 60) AS BIGINT) AS start, avg(value) AS value FROM events GROUP BY ALL) QUALIFY stop IS NOT NULL)"""
SITES_SQL = "sites AS (SELECT '1' AS chrom, l_orderkey AS pos, string_agg(l_returnflag, '' ORDER BY l_linenumber, l_returnflag) AS col FROM lineitem GROUP BY l_orderkey)"
#: A row for each joint of each tree: its number j from 1 and age.
JOINTS_SQL = """lines AS (SELECT l_orderkey AS k, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS n, count(*) OVER (PARTITION BY l_orderkey) AS size FROM lineitem),
joints AS (SELECT k, size, n - 1 AS j, age FROM (SELECT *, sum(q) OVER (PARTITION BY k ORDER BY n) AS age FROM lines) WHERE n > 1)"""
#: A row for each node of each of bushy_trees(): size leaves, node, its parent up (null at the root), age.
NODES_SQL = """lines AS (SELECT l_orderkey AS k, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS size FROM lineitem),
gaps AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY q, i) - 1 AS r, sum(q) OVER (PARTITION BY k ORDER BY q, i) AS age FROM lines WHERE i > 0),
lefts AS (SELECT g.k, g.r, arg_max(o.r, o.i) AS r_left FROM gaps g JOIN gaps o ON o.k = g.k AND o.i < g.i AND o.r > g.r GROUP BY ALL),
rights AS (SELECT g.k, g.r, arg_min(o.r, o.i) AS r_right FROM gaps g JOIN gaps o ON o.k = g.k AND o.i > g.i AND o.r > g.r GROUP BY ALL),
nodes AS (SELECT l.k, l.size, l.i AS node, l.size + least(a.r, b.r) AS up, 0.0::DOUBLE AS age FROM lines l LEFT JOIN gaps a ON a.k = l.k AND a.i = l.i LEFT JOIN gaps b ON b.k = l.k AND b.i = l.i + 1 WHERE l.size > 1
 UNION ALL SELECT g.k, g.size, g.size + g.r, g.size + least(r_left, r_right), g.age FROM gaps g LEFT JOIN lefts USING (k, r) LEFT JOIN rights USING (k, r)),
tree_joints AS (SELECT p.k, p.size, p.node, p.node - p.size AS r, p.up, p.age, min(c.node) AS one, max(c.node) AS two, arg_min(c.age, c.node) AS one_age, arg_max(c.age, c.node) AS two_age FROM nodes p JOIN nodes c ON c.k = p.k AND c.up = p.node GROUP BY ALL)"""
