"""Sites as alignments, names of sequences, and compressed coordinates."""

from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import ordered, sites as st
from ..tables import SITES_SQL, sites, table

_SYMBOLS = "len(list_distinct(string_split(col, '')))"
NAMES = [f"n{i}" for i in range(1, 65)]


@query(f"WITH {SITES_SQL} SELECT * FROM sites WHERE {_SYMBOLS} <= 2")
def two_allele_sites(spark, d):
    return st.drop_polyallelic(sites(spark, d))


@query(f"""WITH {SITES_SQL}, two AS (SELECT pos, col, col[1] AS f, length(col) AS n, len(list_filter(range(1, length(col) + 1), lambda i: col[i] = col[1])) AS own FROM sites WHERE {_SYMBOLS} = 2),
named AS (SELECT *, array_to_string(list_transform(list_filter(range(1, n + 1), lambda i: col[i] = f), lambda i: 'n' || i), ' ') AS a, array_to_string(list_transform(list_filter(range(1, n + 1), lambda i: col[i] <> f), lambda i: 'n' || i), ' ') AS b FROM two)
SELECT '1' AS chrom, pos, CASE WHEN 2 * own <= n THEN a ELSE b END AS minor, CASE WHEN 2 * own <= n THEN b ELSE a END AS major FROM named""")
def allele_names(spark, d):
    found = st.allele_names(sites(spark, d), NAMES)
    return found.select("chrom", "pos", F.array_join("minor", " ").alias("minor"), F.array_join("major", " ").alias("major"))


@query(f"""WITH {SITES_SQL}, wide AS (SELECT pos, rpad(col, 8, 'N') AS col FROM sites), tiles AS (SELECT DISTINCT pos // 64 AS tile FROM wide),
letters AS (SELECT tile, place, string_agg(coalesce(col[place + 1], 'A'), '' ORDER BY i) AS seq FROM tiles, range(8) p(place), range(64) x(i) LEFT JOIN wide ON pos = tile * 64 + i GROUP BY ALL)
SELECT tile, CAST(place AS INT) AS place, seq FROM letters""")
def alignment_tiles(spark, d):
    """Columns are filled up to eight sequences by N."""
    return st.alignment(sites(spark, d).withColumn("col", F.rpad("col", F.lit(8), F.lit("N"))), "1", 8, 64)


@query(f"""WITH {SITES_SQL}, near_ AS (SELECT a.pos AS a_pos, b.pos AS b_pos, a.col AS a, b.col AS b, least(length(a.col), length(b.col)) AS n FROM sites a JOIN sites b ON a.pos < b.pos AND b.pos - a.pos <= 20),
c AS (SELECT *, len(list_filter(range(1, n + 1), lambda i: a[i] <> a[1] AND b[i] <> b[1])) AS n_11, len(list_filter(range(1, n + 1), lambda i: a[i] <> a[1])) AS p, len(list_filter(range(1, n + 1), lambda i: b[i] <> b[1])) AS q FROM near_)
SELECT '1' AS chrom, a_pos, b_pos, CAST(n AS INT) AS n, CAST(n - p - q + n_11 AS INT) AS n_00, CAST(q - n_11 AS INT) AS n_01, CAST(p - n_11 AS INT) AS n_10, CAST(n_11 AS INT) AS n_11 FROM c""")
def haplotype_frequencies(spark, d):
    return st.haplotype_frequencies(sites(spark, d), 20)


#: Haplotype names of individuals: each nation's, with suffixes.
_NAMES = "names AS (SELECT CAST(2 * n_nationkey + h AS INT) AS place, n_name || '_' || (h + 1) AS name FROM nation, range(2) t(h) WHERE NOT (n_nationkey = 3 AND h = 1))"


def _names(spark, d):
    two = table(spark, d, "nation").withColumn("h", F.explode(F.array(F.lit(0), F.lit(1)))).filter("NOT (n_nationkey = 3 AND h = 1)")
    return two.select((2 * F.col("n_nationkey") + F.col("h")).cast("int").alias("place"), F.concat("n_name", F.lit("_"), (F.col("h") + 1).cast("string")).alias("name"))


@query(f"WITH {_NAMES}, wanted AS (SELECT n_name || '_2' AS name FROM nation) SELECT w.name, place FROM wanted w LEFT JOIN names USING (name)")
def sequence_places(spark, d):
    """Of the second haplotypes; one is missing."""
    return st.places_of(_names(spark, d), table(spark, d, "nation").select(F.concat("n_name", F.lit("_2")).alias("name")))


@query(f"WITH {_NAMES} SELECT a.place, b.place AS pair FROM names a LEFT JOIN names b ON a.place <> b.place AND left(a.name, length(a.name) - 2) = left(b.name, length(b.name) - 2)")
def haplotype_pairs(spark, d):
    return st.pairs_by_name(_names(spark, d))


@query(f"WITH {_NAMES} SELECT place, CAST(CASE WHEN place % 2 = 0 THEN place + 1 ELSE place - 1 END AS INT) AS pair FROM names")
def neighbour_pairs(spark, d):
    return st.pairs_by_place(_names(spark, d))


@query(f"WITH {_NAMES}, listed AS (SELECT n_name || '_1' AS one, n_name || '_2' AS two FROM nation WHERE n_regionkey = 1), b AS (SELECT * FROM listed UNION ALL SELECT two, one FROM listed) SELECT x.place, y.place AS pair FROM b JOIN names x ON x.name = one JOIN names y ON y.name = two")
def listed_pairs(spark, d):
    name = lambda i: F.concat("n_name", F.lit(f"_{i}"))
    return st.pairs_by_list(_names(spark, d), table(spark, d, "nation").filter("n_regionkey = 1").select(name(1).alias("one"), name(2).alias("two")))


@query("""WITH names AS (SELECT CAST(n_nationkey AS INT) AS place, CASE n_nationkey WHEN 0 THEN '' WHEN 1 THEN ' a' WHEN 2 THEN '123' WHEN 3 THEN 'a;b' WHEN 4 THEN 'x' WHEN 5 THEN 'x' ELSE n_name END AS name FROM nation)
SELECT place, name, CASE place WHEN 0 THEN 'empty' WHEN 1 THEN 'outer space' WHEN 2 THEN 'digits' WHEN 3 THEN 'symbol' ELSE 'repeated' END AS reason FROM names WHERE place < 6""")
def faulty_names(spark, d):
    name = F.expr("CASE n_nationkey WHEN 0 THEN '' WHEN 1 THEN ' a' WHEN 2 THEN '123' WHEN 3 THEN 'a;b' WHEN 4 THEN 'x' WHEN 5 THEN 'x' ELSE n_name END")
    return st.name_faults(table(spark, d, "nation").select(F.col("n_nationkey").alias("place"), name.alias("name")))


@query("SELECT CAST(n_nationkey AS INT) AS place, n_name AS one, CASE WHEN n_nationkey < 20 THEN lower(n_name) END AS two FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey >= 20")
def different_names(spark, d):
    one = table(spark, d, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("name"))
    two = one.filter("place < 20").withColumn("name", F.when(F.col("place") % 3 == 0, F.lower("name")).otherwise(F.col("name")))
    return st.names_differ(one, two)


_COMPRESSED = f"{SITES_SQL}, n AS (SELECT pos, (pos - 0) // 10 AS b, row_number() OVER (ORDER BY pos) - 1 AS i FROM sites), packed AS (SELECT pos, i + greatest(0, max(b - i) OVER (ORDER BY pos)) AS new_pos FROM n)"


@query(f"WITH {_COMPRESSED} SELECT '1' AS chrom, pos, new_pos FROM packed")
def compressed_sites(spark, d):
    """One column in about ten."""
    return ordered.compressed_positions(sites(spark, d), ["chrom"], 0, 10).select("chrom", "pos", "new_pos")


@query(f"WITH {_COMPRESSED} SELECT x AS new_pos, coalesce(pos, (x + 1) * 10 - 5) AS old_pos FROM (SELECT unnest(range(greatest((SELECT max(new_pos) + 1 FROM packed), 400000 // 10))) AS x) LEFT JOIN packed ON new_pos = x")
def compression_map(spark, d):
    return ordered.compression_map(ordered.compressed_positions(sites(spark, d), ["chrom"], 0, 10), "1", 0, 400000, 10)
