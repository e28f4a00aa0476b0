"""Queries with SQL give the same rows as DuckDB; those without are compared with plain Python on all rows (see also test_whole.py)."""

import math
import random
from itertools import product

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from loamtree.operators import forest, ordered, sites as st, trees as tr
from loamtree.plans import popsizes, priors
from loamtree.queries import ORACLE_SQL, QUERIES, core
from loamtree.tables import trees


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    assert_same(spark, name, QUERIES[name], ORACLE_SQL[name], sf_dir)


def test_every_query_has_a_test():
    elsewhere = {"spr_replay"}  # test_whole.py
    assert set(QUERIES) - set(ORACLE_SQL) - elsewhere == {"tree_halves", "allele_ages", "newick_round_trip", "bootstrap_sites", "tree_priors", "edit_priors", "likeliest_popsizes", "popsizes_with_prior"}


@pytest.fixture(scope="module")
def ladders(spark, sf_dir):
    return {r.start: (list(r.ptree), list(r.age)) for r in trees(spark, sf_dir).collect()}


def leaves_below(parents, x):
    below = [y for y, up in enumerate(parents) if up == x]
    return {x} if not below else set().union(*(leaves_below(parents, y) for y in below))


def test_tree_halves(spark, sf_dir, ladders):
    def half(parents, age):
        size = lambda x: 2 * len(leaves_below(parents, x)) - 1
        want, node = (len(parents) - 1) / 2, parents.index(-1)
        while size(node) != want:
            large = [y for y, up in enumerate(parents) if up == node and size(y) >= want]
            if not large:
                break
            node = min(large, key=lambda y: (age[y], y))
        return age[node]

    rows = QUERIES["tree_halves"](spark, sf_dir).collect()
    assert {r.start: (r.tmrca_half, r.rth) for r in rows} == {k: (half(p, a), half(p, a) / max(a)) for k, (p, a) in ladders.items()}


def branches_of(parents, derived):
    inside = [x for x in range(len(parents)) if leaves_below(parents, x) <= derived]
    return [x for x in inside if parents[x] not in inside]


def test_allele_ages(spark, sf_dir, ladders):
    want = {}
    for start, (p, a) in ladders.items():
        n = (len(p) + 1) // 2
        minor, major = branches_of(p, {0}), branches_of(p, set(range(1, n)))
        flipped = len(minor) > 1 and len(major) < len(minor)
        chosen = major if flipped else minor
        want[start] = (max((a[x] + a[p[x]]) / 2 for x in chosen), len(chosen) == 1, flipped)
    assert {r.start: (r.age, r.infinite_sites, r.flipped) for r in QUERIES["allele_ages"](spark, sf_dir).collect()} == want


def test_newick(spark, sf_dir, ladders):
    for r in QUERIES["newick_round_trip"](spark, sf_dir).collect():
        p, age = ladders[r.start]
        assert sorted(r.age) == pytest.approx(sorted(age), abs=1e-6)
        assert r.newick.count("(") == len(p) - (len(p) + 1) // 2 and r.newick.endswith(";")


def random_trees(spark, n):
    """Trees of all shapes, with joints numbered in any order."""
    rng, rows = random.Random(n), []
    for i in range(n):
        leaves = rng.randint(2, 6)
        inner = list(range(leaves, 2 * leaves - 1))
        rng.shuffle(inner)
        parents, age, open_, now = [-1] * (2 * leaves - 1), [0.0] * (2 * leaves - 1), list(range(leaves)), 0.0
        for x in inner:
            a, b = rng.sample(open_, 2)
            parents[a] = parents[b] = x
            now += rng.randint(0, 5)
            age[x] = now
            open_ = [y for y in open_ if y not in (a, b)] + [x]
        rows.append((i, parents, age, "".join(rng.choice("ACGTN") for _ in range(leaves)), sorted(rng.sample(range(leaves), rng.randint(1, leaves)))))
    return rows, spark.createDataFrame(rows, "start long, ptree array<int>, age array<double>, col string, keep array<int>")


def test_parsimony(spark, sf_dir, ladders):
    def cost(parents, col):
        n, best = len(col), math.inf
        for bases in product(*["ACGT" if x >= n or col[x] == "N" else col[x] for x in range(len(parents))]):
            best = min(best, sum(up >= 0 and bases[x] != bases[up] for x, up in enumerate(parents)))
        return best

    rows, frame = random_trees(spark, 40)
    found = {r.start: r.cost for r in frame.select("start", forest.parsimony_cost("ptree", "col").alias("cost")).collect()}
    small = [r for r in rows if len(r[3]) < 6 and r[3].count("N") < 3]
    assert {r[0]: found[r[0]] for r in small} == {r[0]: cost(r[1], r[3]) for r in small}


def test_pruned_shapes(spark):
    rows, frame = random_trees(spark, 60)
    for r in frame.select("start", forest.prune(F.col("keep")).alias("t")).collect():
        _, parents, age, _, keep = rows[r.start]
        clades = {(frozenset(c), t) for x, t in enumerate(age) if len(c := leaves_below(parents, x) & set(keep)) > 1}
        clades = {(c, min(t for d, t in clades if d == c)) for c, _ in clades}
        own = {(frozenset(keep[y] for y in leaves_below(list(r.t.ptree), x)), r.t.age[x]) for x in range(len(keep), 2 * len(keep) - 1)}
        assert own == clades and list(r.t.nodes[: len(keep)]) == keep and len(r.t.ptree) == 2 * len(keep) - 1
        assert [age[x] for x in r.t.nodes] == list(r.t.age)


def test_halves_and_faults_of_shapes(spark):
    rows, frame = random_trees(spark, 50)
    assert frame.filter(F.size(tr.tree_faults()) > 0).count() == 0
    bad = [(0, [2, 2], [0.0, 0.0]), (1, [2, 2, -1], [0.0, 3.0, 1.0]), (2, [1, -1, -1], [0.0, 0.0, 0.0]), (3, [2, 2, 9], [0.0, 0.0, 1.0])]
    found = {r.start: set(r.f) for r in spark.createDataFrame(bad, "start long, ptree array<int>, age array<double>").select("start", tr.tree_faults().alias("f")).collect()}
    assert found[1] == {"order of ages"} and "roots" in found[2] and "parents" in found[3] and found[0]


def slow_coalescent(a, b, t, n):
    """By the chain of counts with a rate for each, as a product of matrix powers over many small steps."""
    p = [0.0] * (a + 1)
    p[a] = 1.0
    steps = 20000
    for _ in range(steps):
        q = p[:]
        for k in range(2, a + 1):
            moved = p[k] * k * (k - 1) / 2 / n * t / steps
            q[k] -= moved
            q[k - 1] += moved
        p = q
    return p[b]


def test_coalescent_probability():
    for a, b, t, n in ((2, 1, 1.0, 1.0), (5, 2, 0.7, 2.0), (6, 6, 0.1, 1.0), (4, 3, 3.0, 10.0)):
        assert priors.coalescent_probability(a, b, t, n) == pytest.approx(slow_coalescent(a, b, t, n), rel=2e-3)
    for a in (1, 4, 9):
        assert sum(priors.coalescent_probability(a, b, 0.4, 1.5) for b in range(1, a + 1)) == pytest.approx(1)


def test_tree_priors(spark, sf_dir, ladders):
    grid, sizes = core.GRID, [50.0] * len(core.GRID)
    spans, means = priors.merged_intervals(grid, sizes)
    assert len(spans) == len(grid) - 1 and sum(spans) == pytest.approx(math.sqrt((grid[-2] + 1) * (grid[-1] + 1)))
    near = lambda x: min(min(range(len(grid)), key=lambda i: (abs(grid[i] - x), i)), len(grid) - 2)
    rows = {r.start: r.log_prior for r in QUERIES["tree_priors"](spark, sf_dir).collect()}
    assert len(rows) == len(ladders)
    for start, (p, a) in list(ladders.items())[:200]:
        n, total = (len(p) + 1) // 2, 0.0
        lines = n
        for i in range(len(grid) - 1):
            left = lines - sum(near(x) == i for x in a[n:])
            total += math.log(max(priors.coalescent_probability(lines, left, spans[i], 2 * means[i]), 1e-200))
            lines = left
        assert rows[start] == pytest.approx(total, rel=1e-9)


def test_edit_priors(spark, sf_dir, ladders):
    """Every place where a cut lineage may join, with its probability, adds up to one."""
    grid, sizes = core.GRID, [50.0] * len(core.GRID)
    rows = QUERIES["edit_priors"](spark, sf_dir).collect()
    assert len(rows) == len(ladders) and all(r.log_prior < 0 for r in rows)
    start, (p, a) = next((k, v) for k, v in sorted(ladders.items()) if len(v[0]) == 7)
    near = lambda x: min(min(range(len(grid)), key=lambda i: (abs(grid[i] - x), i)), len(grid) - 2)
    broken, cut = near(a[p[0]]), 0
    tries = [(start, p, a, cut, j, broken) for j in range(cut, len(grid) - 1)]
    frame = spark.createDataFrame(tries, "start long, ptree array<int>, age array<double>, recomb_time int, coal_time int, broken_time int")
    found = {r.coal_time: math.exp(r.log_prior) for r in priors.edit_log_prior(frame, grid, sizes).collect()}
    total = 0.0
    for j, probability in found.items():
        lines = sum(near(a[x]) <= j <= (near(a[p[x]]) if p[x] >= 0 else len(grid) - 2) for x in range(len(p)))
        total += probability * (lines - (j <= broken) - (j == broken))
    lines = sum(near(a[x]) <= cut < (near(a[p[x]]) if p[x] >= 0 else len(grid)) for x in range(len(p)))
    points = sum(near(a[x]) <= cut <= (near(a[p[x]]) if p[x] >= 0 else len(grid) - 2) for x in range(len(p)))
    length = sum(grid[near(a[up])] - grid[near(a[x])] for x, up in enumerate(p) if up >= 0)
    top = near(max(a))
    assert total == pytest.approx(lines * (grid[1] - grid[0]) / (points * (length + grid[top + 1] - grid[top])), rel=1e-9)


def test_bootstrap(spark, sf_dir):
    given = [(r.pos, r.col) for r in core.sites(spark, sf_dir).collect()]
    drawn = [[(r.pos, r.col) for r in st.bootstrap_sites(core.sites(spark, sf_dir).repartition(k), 1).collect()] for k in (3, 7)]
    assert sorted(drawn[0]) == sorted(drawn[1]) and len(drawn[0]) == len(given) and set(drawn[0]) < set(given)
    assert 0.6 < len(set(drawn[0])) / len(given) < 0.67


def test_long_columns(spark):
    """Masks of more than one word."""
    rng = random.Random(7)
    columns = {i: "".join(rng.choice("AC") for _ in range(rng.choice([3, 61, 62, 63, 124, 130, 200]))) for i in range(14)}
    frame = spark.createDataFrame([("1", i, c) for i, c in columns.items()], "chrom string, pos long, col string")
    linked = {(r.a_pos, r.b_pos): r.d for r in st.linkage(frame, 20).collect()}
    assert len(linked) == 14 * 13 / 2
    conflicts = set()
    for (i, j), d in linked.items():
        n = min(len(columns[i]), len(columns[j]))
        x, y = ([c != columns[k][0] for c in columns[k][:n]] for k in (i, j))
        assert d == pytest.approx(sum(a and b for a, b in zip(x, y)) / n - sum(x) * sum(y) / n**2, abs=1e-12)
        s, t = ({q for q in range(n) if columns[k][q] == min(set(columns[k][:n]), key=lambda b: (columns[k][:n].count(b), b))} for k in (i, j))
        if s & t and s - t and t - s:
            conflicts.add((i, j))
    assert {(r.a_pos, r.b_pos) for r in st.conflicting_pairs(frame, 20).collect()} == conflicts


def test_order_in_small_tiles(spark):
    rng = random.Random(8)
    rows = sorted((k, rng.randint(0, 300), i) for k in "ab" for i in range(120))
    frame = spark.createDataFrame(rows, "k string, pos long, id long").repartition(5)
    for k in "ab":
        own, ahead = [r for r in rows if r[0] == k], 0
        found = {r.id: r.unique_pos for r in ordered.unique_positions(frame, ["k"], ["pos", "id"], "pos", 16).filter(F.col("k") == k).collect()}
        for i, (_, pos, key) in enumerate(own):
            ahead = max(ahead, pos - i)
            assert found[key] == i + ahead
        breaks = sorted({r[1] for r in own})
        assert sorted((r.start, r.stop) for r in ordered.blocks_from_breaks(frame, ["k"], "pos", 16).filter(F.col("k") == k).collect()) == list(zip(breaks, breaks[1:]))


def test_prior_of_a_graph(spark):
    """Blocks of a sample: a rate for each by its tree's length, and an edit behind all but the last."""
    grid, sizes, rho = core.GRID, [50.0] * len(core.GRID), 1e-4
    tree = ([2, 2, -1], [0.0, 0.0, grid[3]])
    rows = [(1, 0, 100, *tree, 1, 4, 3), (1, 100, 130, *tree, None, None, None), (2, 0, 50, *tree, None, None, None)]
    blocks = spark.createDataFrame(rows, "sample long, start long, stop long, ptree array<int>, age array<double>, recomb_time int, coal_time int, broken_time int")
    edit = priors.edit_log_prior(blocks.filter("coal_time = 4"), grid, sizes).first().log_prior
    rate = rho * 2 * grid[3]
    found = {r["sample"]: r.log_prior for r in priors.arg_log_prior(blocks, grid, sizes, rho).collect()}
    assert found == pytest.approx({1: math.log(rate) - rate * 100 + edit - rate * 30, 2: -rate * 50})
    likelihood = spark.createDataFrame([(1, -5.0), (2, -1.0)], "sample long, log_likelihood double")
    joint = priors.joint_log_probability(likelihood, priors.arg_log_prior(blocks, grid, sizes, rho))
    assert {r["sample"]: r.log_joint for r in joint.collect()} == pytest.approx({1: found[1] - 5, 2: found[2] - 1})


def test_sizes_for_a_grid():
    from loamtree.functions.scalar import population_sizes

    assert population_sizes(5, [0.0, 1.0]) == [5.0, 5.0]
    with pytest.raises(ValueError):
        population_sizes([1, 2, 3], [0.0, 1.0])


def test_likeliest_popsizes(spark, sf_dir):
    """No size near by, larger or smaller, is likelier; no joint gives none."""
    spans, _ = priors.merged_intervals(core.GRID, [1.0] * len(core.GRID))
    counts = {}
    for r in popsizes.transitions(trees(spark, sf_dir), core.GRID).collect():
        counts.setdefault(r.time_bin, []).append((r.a, r.b, r.n))
    found = {r.time_bin: r.popsize for r in QUERIES["likeliest_popsizes"](spark, sf_dir).collect()}
    assert set(found) == set(counts) == set(range(len(core.GRID) - 1))
    fit = lambda j, size: sum(n * math.log(max(priors.coalescent_probability(a, b, spans[j], size), 1e-200)) for a, b, n in counts[j])
    for j, size in found.items():
        if all(a == b for a, b, _ in counts[j]):
            assert size is None or math.isnan(size)
        else:
            assert fit(j, size) >= max(fit(j, size * x) for x in (0.5, 0.9, 0.999, 1.001, 1.1, 2)) - 1e-6


def test_popsizes_with_prior(spark, sf_dir):
    for r in QUERIES["popsizes_with_prior"](spark, sf_dir).collect():
        step = core.GRID[r.time_bin + 1] - core.GRID[r.time_bin]
        f = lambda x: -(x**3) / 1600 + 100 * x * x / 1600 - r.n_coal * x + step * r.n_lineages / 2
        assert abs(f(r.popsize)) < 1e-6 * max(1, step * r.n_lineages) or r.popsize == 100
    assert popsizes.size_with_prior(5, 1e9, 10.0, 3.0) == 10.0
