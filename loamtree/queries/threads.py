"""A further lineage on each tree: where it joins, where it moves, how likely its base is; ancestral bases. The trees are tables.bushy_trees()."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalogue import query
from ..functions.scalar import half_steps, time_steps
from ..operators import forest, intervals as iv
from ..plans import joining, likelihood
from ..sources.scratch import stored
from ..tables import NODES_SQL, SITES_SQL, bushy_trees, sites, table, trees
from .core import GRID, _sql_bin, nine_decimals, rounded

TOP = len(GRID) - 2
#: Population size at each grid time, recombination and mutation rate, and the factor of a place that needs a change of its own.
SIZES, RHO, MU, PENALTY = [60.0 + 5 * i for i in range(len(GRID))], 1e-4, 1e-3, 0.1

_SPANS = f"""{NODES_SQL}, spans AS (SELECT n.k, n.node, n.up, least({_sql_bin('n.age')}, {TOP}) AS low, CASE WHEN n.up IS NULL THEN {TOP} ELSE least({_sql_bin('p.age')}, {TOP}) END AS high FROM nodes n LEFT JOIN nodes p ON p.k = n.k AND p.node = n.up)"""
#: For each tree: branches and places by time; rates by half step; whole length and root time; cuts (u where the lineage goes on, v where it ends) and what a cut at time c joins at time b with.
_JOINS = f"""{_SPANS},
consts AS (SELECT {GRID} AS g, {half_steps(GRID)} AS h, {time_steps(GRID)} AS w, {SIZES} AS z),
times AS (SELECT unnest(range({TOP + 1})) AS b),
counts AS (SELECT k, b, count(*) FILTER (WHERE low <= b AND b < high OR up IS NULL AND b = {TOP}) AS branches, count(*) AS places FROM spans JOIN times ON low <= b AND b <= high GROUP BY ALL),
lens AS (SELECT k, sum(g[high + 1] - g[low + 1]) FILTER (WHERE up IS NOT NULL) AS len, max(low) FILTER (WHERE up IS NULL) AS root FROM spans, consts GROUP BY k),
rates AS (SELECT k, b, h[2 * b + 1] * branches / (2 * z[b + 1]) AS above, h[2 * b + 2] * branches / (2 * z[b + 1]) AS next_below FROM counts, consts),
sums AS (SELECT *, coalesce(lag(next_below) OVER w, 0) AS below, coalesce(sum(above + next_below) OVER (PARTITION BY k ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS here FROM rates WINDOW w AS (PARTITION BY k ORDER BY b)),
joins AS (SELECT c.k, c.b AS c, b.b, exp(-greatest(b.here - b.below - c.here, 0)) * CASE WHEN b.b = {TOP} THEN 1 ELSE 1 - exp(-b.above - CASE WHEN b.b > c.b THEN b.below ELSE 0 END) END AS p FROM sums c JOIN sums b ON b.k = c.k AND b.b >= c.b),
cuts AS (SELECT k, b, places, w[b + 1] * (branches + 1) / (places + 1) AS u, w[b + 1] * branches / (places + 1 + (b < root)::INT) AS v, len + g[b + 1] + CASE WHEN b > root THEN g[b + 1] - g[root + 1] ELSE 0 END AS l, w[greatest(b, root) + 1] AS stub
 FROM counts JOIN lens USING (k), consts),
lasting AS (SELECT *, exp(-{RHO} * greatest(l, 1)) AS stays, (1 - exp(-{RHO} * greatest(l, 1))) / (l + stub) AS leaves FROM cuts)"""

@query(f"WITH {_JOINS} SELECT k * 10 AS start, CAST(j.b AS INT) AS time_bin, places AS n_places, round(p / places, 9) AS prior FROM joins j JOIN counts USING (k, b) WHERE j.c = 0")
def join_priors(spark, d):
    """By tree and grid time, the probability of each place where a new leaf may join."""
    found = bushy_trees(spark, d).select("start", F.posexplode(joining.join_priors(GRID, SIZES)).alias("time_bin", "x"))
    return found.select("start", "time_bin", F.col("x.places").cast("long").alias("n_places"), nine_decimals(F.col("x.prior")).alias("prior"))


_MOVE_SQL = f"""WITH {_JOINS}, weights AS (SELECT a.k, a.b AS a, j.b, a.leaves, a.stays, sum(CASE WHEN j.c < a.b THEN c.u ELSE a.v END * j.p) AS s
 FROM lasting a JOIN joins j ON j.k = a.k AND j.c <= a.b JOIN lasting c ON c.k = a.k AND c.b = j.c GROUP BY a.k, a.b, a.leaves, a.stays, j.b),
moved AS (SELECT x.*, x.leaves * s / e.places AS p FROM weights x JOIN counts e ON e.k = x.k AND e.b = x.b)"""


@query(f"{_MOVE_SQL} SELECT k * 10 AS start, CAST(a AS INT) AS a, {', '.join(f'round(max(p) FILTER (WHERE b = {b}), 9) AS to_{b}' for b in range(TOP + 1))}, round(max(2 * p + stays) FILTER (WHERE b = a), 9) AS stays_on_leaf FROM moved GROUP BY k, a")
def join_moves(spark, d):
    """From each time to a place of another branch at each time; and from a leaf's branch to the same place."""
    found = bushy_trees(spark, d).select("start", F.posexplode(joining.join_moves(GRID, SIZES, RHO)).alias("a", "x"))
    return found.select("start", "a", *[nine_decimals(F.get("x.other", F.lit(b))).alias(f"to_{b}") for b in range(TOP + 1)], nine_decimals(F.get("x.leaf", F.col("a"))).alias("stays_on_leaf"))


@query(f"""{_MOVE_SQL}, anywhere AS (SELECT k, a, sum(p * e.places) AS p FROM moved m JOIN counts e USING (k, b) GROUP BY k, a),
early AS (SELECT s.k, s.node, j.b, sum(c.u * j.p) / any_value(e.places) AS p FROM spans s JOIN joins j ON j.k = s.k AND j.c < s.low AND j.b >= s.low AND j.b <= s.high JOIN lasting c ON c.k = s.k AND c.b = j.c JOIN counts e ON e.k = s.k AND e.b = j.b GROUP BY s.k, s.node, j.b),
below AS (SELECT k, node, sum(p) AS p FROM early GROUP BY ALL),
own AS (SELECT s.k, s.node, m.a, sum(m.p) AS p FROM spans s JOIN moved m ON m.k = s.k AND m.a BETWEEN s.low AND s.high AND m.b BETWEEN s.low AND s.high GROUP BY ALL)
SELECT o.k * 10 AS start, CAST(o.node AS INT) AS node, CAST(o.a AS INT) AS time_bin, round(w.p + o.p - l.leaves * coalesce(b.p, 0) + l.stays, 9) AS total
FROM own o JOIN anywhere w ON w.k = o.k AND w.a = o.a JOIN lasting l ON l.k = o.k AND l.b = o.a LEFT JOIN below b ON b.k = o.k AND b.node = o.node""")
def join_totals(spark, d):
    """Of each place, the probability that the lineage is on the same tree at the next base."""
    return bushy_trees(spark, d).select("start", F.explode(joining.join_totals(GRID, SIZES, RHO)).alias("x")).select("start", "x.node", "x.time_bin", nine_decimals(F.col("x.total")).alias("total"))


def _columns(spark, d):
    """The sites of the trees' orders, R standing for G; then the base of a further leaf by the smallest line status."""
    status = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("pos")).agg(F.translate(F.min("l_linestatus"), "OF", "AG").alias("base"))
    found = sites(spark, d).join(status, "pos")
    return found.select("chrom", (F.col("pos") * 10 + 3).alias("pos"), F.translate("col", "R", "G").alias("col"), "base")


def _on_trees(spark, d):
    return iv.join_points(_columns(spark, d), t := bushy_trees(spark, d), iv.choose_bin_width(t))


def _vector(base: str) -> str:
    return f"CASE {base} WHEN 'A' THEN [1.0, 0, 0, 0] WHEN 'R' THEN [0.0, 0, 1, 0] WHEN 'O' THEN [1.0, 0, 0, 0] WHEN 'F' THEN [0.0, 0, 1, 0] ELSE [1.0, 1, 1, 1] END::DOUBLE[]"


def _through(part: str, length: str) -> str:
    kept = f"exp(-4 / 3.0 * {MU} * greatest({length}, 1))"
    return f"list_transform({part}, lambda y: {kept} * y + (1 - {kept}) / 4 * list_sum({part}))"


def _times(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])"


def _with_leaf(part: str, age: str, node: str) -> str:
    joined = _times(_through(part, f"t - {age}"), _through("base", "t"))
    return f"CASE WHEN place = {node} THEN {{'v': {joined}, 'age': t}} ELSE {{'v': {part}, 'age': {age}}} END"


_LIKE = f"""WITH RECURSIVE {_SPANS}, {SITES_SQL}, status AS (SELECT l_orderkey AS k, min(l_linestatus) AS base FROM lineitem GROUP BY 1), consts AS (SELECT {GRID} AS g),
steps AS (SELECT j.k, j.r, j.size, j.one, j.two, g[a.low + 1] AS one_age, g[b.low + 1] AS two_age, g[x.low + 1] AS age, j.node, j.up IS NULL AS last FROM tree_joints j JOIN spans x ON x.k = j.k AND x.node = j.node JOIN spans a ON a.k = j.k AND a.node = j.one JOIN spans b ON b.k = j.k AND b.node = j.two, consts),
walk AS (SELECT s.k, s.node AS place, t.b AS time_bin, g[t.b + 1] AS t, {_vector('status.base')} AS base, 0 AS r,
  list_transform(string_split(col, ''), lambda c: {_vector('c')}) AS parts FROM spans s JOIN (SELECT unnest(range({TOP + 1})) AS b) t ON t.b BETWEEN s.low AND s.high JOIN sites ON pos = s.k JOIN status ON status.k = s.k, consts
 UNION ALL SELECT w.k, place, time_bin, t, base, w.r + 1, list_append(parts, {_times(_through('one_.v', 's.age - one_.age'), _through('two_.v', 's.age - two_.age'))})
  FROM (SELECT w.*, s.age, {_with_leaf('parts[one + 1]', 'one_age', 'one')} AS one_, {_with_leaf('parts[two + 1]', 'two_age', 'two')} AS two_ FROM walk w JOIN steps s ON s.k = w.k AND s.r = w.r) w JOIN steps s ON s.k = w.k AND s.r = w.r)
SELECT w.k * 10 + 3 AS pos, CAST(place AS INT) AS node, CAST(time_bin AS INT) AS time_bin,
 round(list_sum(CASE WHEN place = s.node THEN {_times(_through('parts[s.node + 1]', 't - s.age'), _through('base', 't'))} ELSE parts[s.node + 1] END) / 4, 9) AS likelihood
FROM walk w JOIN steps s ON s.k = w.k AND s.last AND w.r = s.r + 1"""


@query(_LIKE)
def join_likelihoods(spark, d):
    """Of each site with the base of a further leaf, at every place where this may join; nodes are at their grid times."""
    rows = _on_trees(spark, d).withColumn("col", F.concat("col", "base"))
    found = joining.join_likelihoods(rows, GRID, MU).select("pos", F.explode("places").alias("x"))
    return found.select("pos", "x.node", "x.time_bin", nine_decimals(F.col("x.likelihood")).alias("likelihood"))


@query(f"""WITH RECURSIVE {NODES_SQL}, {SITES_SQL},
walk AS (SELECT pos AS k, flat, 0 AS r, list_transform(string_split(CASE WHEN flat THEN repeat('A', length(col)) ELSE col END, ''), lambda c: {_vector('c')}) AS parts FROM sites, (SELECT unnest([false, true]) AS flat) WHERE length(col) > 1
 UNION ALL SELECT w.k, flat, w.r + 1, list_append(parts, {_times(_through('parts[one + 1]', 'age - one_age'), _through('parts[two + 1]', 'age - two_age'))}) FROM walk w JOIN tree_joints j ON j.k = w.k AND j.r = w.r)
SELECT w.k % 4 AS sample, round(sum(ln(list_sum(parts[j.node + 1]) / 4) * CASE WHEN flat THEN 9 ELSE 1 END), 6) AS log_likelihood FROM walk w JOIN tree_joints j ON j.k = w.k AND j.up IS NULL AND w.r = j.r + 1 GROUP BY 1""")
def tree_likelihood(spark, d):
    """All trees, each of ten bases with the site of its own order at one of them."""
    columns = _columns(spark, d).select("chrom", "pos", "col")
    found = likelihood.tree_log_likelihood(bushy_trees(spark, d), columns, MU)
    return found.select("sample", F.round("log_likelihood", 6).alias("log_likelihood"))


_SETS = f"""WITH RECURSIVE {NODES_SQL}, {SITES_SQL},
up AS (SELECT k, 0 AS r, list_transform(string_split(col, ''), lambda c: CASE c WHEN 'A' THEN 1 WHEN 'R' THEN 4 ELSE 15 END) AS sets FROM (SELECT pos AS k, col FROM sites WHERE length(col) > 1)
 UNION ALL SELECT u.k, u.r + 1, list_append(sets, CASE WHEN sets[one + 1] & sets[two + 1] > 0 THEN sets[one + 1] & sets[two + 1] ELSE sets[one + 1] | sets[two + 1] END) FROM up u JOIN tree_joints j ON j.k = u.k AND j.r = u.r),
whole AS (SELECT k, sets, r AS joints FROM up QUALIFY row_number() OVER (PARTITION BY k ORDER BY r DESC) = 1),
down AS (SELECT n.k, n.node, sets, sets[n.node + 1] & -sets[n.node + 1] AS base, CAST(NULL AS BIGINT) AS above FROM nodes n JOIN whole w ON w.k = n.k WHERE up IS NULL
 UNION ALL SELECT n.k, n.node, sets, CASE WHEN sets[n.node + 1] & base > 0 THEN base ELSE sets[n.node + 1] & -sets[n.node + 1] END, base FROM down d JOIN nodes n ON n.k = d.k AND n.up = d.node),
letters AS (SELECT *, CASE base WHEN 1 THEN 'A' WHEN 2 THEN 'C' WHEN 4 THEN 'G' ELSE 'T' END AS letter FROM down)"""


@query(f"{_SETS} SELECT k * 10 + 3 AS pos, string_agg(letter, '' ORDER BY node) AS bases, count(*) FILTER (WHERE above <> base) AS n_mutations FROM letters GROUP BY k")
def ancestral_states(spark, d):
    """A base of every node by parsimony, and the changes these need."""
    found = _on_trees(spark, d).withColumn("x", forest.ancestral_states("ptree", "col"))
    return found.select("pos", "x.bases", F.size("x.mutated").cast("long").alias("n_mutations"))


@query(f"{_SETS}, sizes AS (SELECT k, max(node) // 2 + 1 AS leaves FROM letters GROUP BY k) SELECT leaves, CAST(node AS INT) AS node, letter AS derived, count(*) AS n FROM letters JOIN sizes USING (k) WHERE above <> base GROUP BY ALL")
def mutations_by_branch(spark, d):
    """Mutations that parsimony puts on each branch, by the tree's number of leaves and the base behind."""
    found = _on_trees(spark, d).withColumn("x", forest.ancestral_states("ptree", "col")).select((F.size("ptree") + 1).alias("n2"), F.explode(F.arrays_zip("x.mutated", "x.derived")).alias("m"))
    return found.groupBy(F.expr("CAST(n2 div 2 AS BIGINT)").alias("leaves"), F.col("m.mutated").alias("node"), F.col("m.derived").alias("derived")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_SETS} SELECT k * 10 + 3 AS pos, CAST(count(*) FILTER (WHERE above <> base) AS INT) AS cost FROM letters GROUP BY k")
def parsimony_costs(spark, d):
    """The fewest changes of each site on its tree, R standing for G; N may be any base."""
    return _on_trees(spark, d).select("pos", forest.parsimony_cost("ptree", "col").alias("cost"))


@query(f"""WITH {NODES_SQL}, runs AS (SELECT g.k, g.size, g.r, g.age, coalesce((SELECT max(o.i) FROM gaps o WHERE o.k = g.k AND o.i < g.i AND o.r > g.r), 0) AS lo, coalesce((SELECT min(o.i) FROM gaps o WHERE o.k = g.k AND o.i > g.i AND o.r > g.r), g.size) AS hi FROM gaps g),
numbered AS (SELECT k, size + r AS node, size + row_number() OVER (PARTITION BY k ORDER BY hi - lo, lo) - 1 AS number FROM runs UNION ALL SELECT k, node, node FROM nodes WHERE node < size)
SELECT n.k * 10 AS start, list(CAST(coalesce(u.number, -1) AS INT) ORDER BY x.number) AS ptree, list(n.age ORDER BY x.number) AS age FROM nodes n JOIN numbered x ON x.k = n.k AND x.node = n.node LEFT JOIN numbered u ON u.k = n.k AND u.node = n.up GROUP BY n.k""")
def canonical_trees(spark, d):
    """Joints numbered by what is below them, of trees whose joints are first numbered backwards."""
    n = (F.size("ptree") + 1) / 2
    turned = lambda x: F.when(x >= n, 3 * n - 2 - x).otherwise(x).cast("int")
    nodes = F.sequence(F.lit(0), F.size("ptree") - 1)
    backwards = bushy_trees(spark, d).select("start", F.transform(nodes, lambda x: turned(F.get("ptree", turned(x)))).alias("ptree"), F.transform(nodes, lambda x: F.get("age", turned(x))).alias("age"))
    return backwards.select("start", forest.canonical("ptree", "age").alias("t")).select("start", "t.ptree", "t.age")


@query(f"""WITH RECURSIVE {NODES_SQL}, up_ AS (SELECT k, node AS leaf, node, CAST(0 AS DOUBLE) AS d FROM nodes WHERE node < size UNION ALL SELECT u.k, leaf, n.up, d + p.age - n.age FROM up_ u JOIN nodes n ON n.k = u.k AND n.node = u.node JOIN nodes p ON p.k = n.k AND p.node = n.up),
pairs AS (SELECT a.k, a.leaf AS a, b.leaf AS b, min(a.d + b.d) AS d FROM up_ a JOIN up_ b ON b.k = a.k AND b.node = a.node AND b.leaf > a.leaf GROUP BY ALL)
SELECT k * 10 AS start, round(sum(d), 6) AS path_sum, round(max(d), 6) AS longest FROM pairs GROUP BY k""")
def rerooted_paths(spark, d):
    """Sum and largest of the paths between leaves, after the root has moved to the middle of the branch above the last leaf: as before."""
    last = ((F.size("ptree") - 1) / 2).cast("int")
    moved = stored(bushy_trees(spark, d).select("start", forest.rerooted(last, F.lit(0.5), "ptree", "age").alias("t")).select("start", "t.ptree", "t.length"), "rerooted")
    rows = moved.select("start", F.posexplode(F.arrays_zip("ptree", "length")).alias("node", "x")).select("start", "node", "x.ptree", "x.length")
    held = moved.select("start", F.posexplode(forest.clades("ptree")).alias("node", "leaves")).select("start", "node", F.size("leaves").alias("m"))
    n = F.max("m").over(Window.partitionBy("start"))
    crossed = rows.join(held, ["start", "node"]).withColumn("n", n)
    sums = crossed.groupBy("start").agg(F.sum(F.col("length") * F.col("m") * (F.col("n") - F.col("m"))).alias("path_sum"))
    return rounded(sums.join(moved.select("start", forest.longest_path("ptree", "length").alias("longest")), "start"), "path_sum", "longest")


@query(f"""WITH RECURSIVE {NODES_SQL}, sizes AS (SELECT k, any_value(size) AS size FROM nodes GROUP BY k),
ladder AS (SELECT k, i AS node, size + greatest(i - 1, 0) AS up FROM sizes, range(size) t(i) UNION ALL SELECT k, size + j, CASE WHEN j < size - 2 THEN size + j + 1 END FROM sizes, range(size - 1) t(j)),
both_ AS (SELECT 1 AS t, k, node, up FROM nodes UNION ALL SELECT 2, k, node, up FROM ladder),
up_ AS (SELECT t, b.k, node AS leaf, node, 0 AS d FROM both_ b JOIN sizes s ON s.k = b.k AND node < s.size UNION ALL SELECT u.t, u.k, leaf, b.up, d + 1 FROM up_ u JOIN both_ b ON b.t = u.t AND b.k = u.k AND b.node = u.node WHERE b.up IS NOT NULL),
pairs AS (SELECT a.t, a.k, a.leaf AS a, b.leaf AS b, min(a.d + b.d) AS d FROM up_ a JOIN up_ b ON b.t = a.t AND b.k = a.k AND b.node = a.node AND b.leaf > a.leaf GROUP BY ALL)
SELECT x.k * 10 AS start, round(CASE WHEN stddev_pop(x.d) > 0 AND stddev_pop(y.d) > 0 THEN corr(x.d, y.d) END, 6) AS correlation FROM pairs x JOIN pairs y ON y.t = 2 AND y.k = x.k AND y.a = x.a AND y.b = x.b WHERE x.t = 1 GROUP BY x.k""")
def path_correlations(spark, d):
    """Of two trees of each order, of any shape and a ladder."""
    other = trees(spark, d).select("start", F.col("ptree").alias("ladder"))
    found = bushy_trees(spark, d).select("start", "ptree").join(other, "start")
    return rounded(found.select("start", forest.path_correlation("ptree", "ladder").alias("correlation")), "correlation")
