"""Graphs, node numbers, joined lists and counts by edits, on random edits of random trees against a plain fold."""

import random

import pytest
from test_joining import random_tree

from loamtree.functions.scalar import time_grid
from loamtree.operators import forest, graphs, numbering
from loamtree.operators.spr import apply_spr
from loamtree.plans import popsizes

BLOCKS = "sample long, chrom string, start long, stop long, ptree array<int>, age array<double>"
EDITS = "sample long, chrom string, pos long, recomb_node int, recomb_time double, coal_node int, coal_time double"


def below(parents, x):
    found, more = {x}, True
    while more:
        new = {y for y, up in enumerate(parents) if up in found} - found
        found, more = found | new, bool(new)
    return found


def random_edit(rng, parents, ages):
    """A cut on any branch, and any place above it in time outside what it cuts."""
    x = rng.choice([y for y, up in enumerate(parents) if up >= 0])
    t = rng.uniform(ages[x], ages[parents[x]])
    inside = below(parents, x)
    free = [y for y, up in enumerate(parents) if y not in inside and (up < 0 or ages[up] > t)]
    c = rng.choice(free)
    lo, hi = max(t, ages[c]), ages[parents[c]] if parents[c] >= 0 else max(t, ages[c]) + 50
    return x, t, c, rng.uniform(lo, hi)


def history(rng, sample, n, edits, chrom="1", start=100):
    """Blocks and edits of one sample, by a plain fold."""
    parents, ages = random_tree(rng, n, on_grid=False)
    blocks, made, at = [], [], start
    for i in range(edits + 1):
        stop = at + rng.randint(1, 30)
        blocks.append((sample, chrom, at, stop, list(parents), list(ages)))
        if i < edits:
            x, t, c, u = random_edit(rng, parents, ages)
            made.append((sample, chrom, stop, x, t, c, u))
            parents, ages = apply_spr(parents, ages, x, c, u)
        at = stop
    return blocks, made


@pytest.fixture(scope="module")
def histories(spark):
    rng = random.Random(11)
    blocks, edits = [], []
    for sample, n, k, chrom in ((0, 2, 12, "1"), (1, 5, 60, "1"), (1, 4, 25, "2"), (2, 7, 40, "1"), (3, 3, 0, "1")):
        b, e = history(rng, sample, n, k, chrom)
        blocks, edits = blocks + b, edits + e
    return blocks, edits, spark.createDataFrame(blocks, BLOCKS).cache(), spark.createDataFrame(edits, EDITS).cache()


def plain(rows):
    return sorted((r.sample, r.chrom, r.start, r.stop, list(r.ptree), list(r.age)) for r in rows)


def test_graph_round_trip(histories):
    blocks, edits, b, e = histories
    nodes, edges = graphs.graph_nodes(b, e), graphs.graph_edges(b, e)
    assert plain(graphs.graph_blocks(nodes, edges).collect()) == sorted(blocks)
    got = {(r.sample, r.chrom, r.pos): (r.recomb_node, r.recomb_time, r.coal_node, r.coal_time) for r in graphs.graph_edits(nodes, edges).collect()}
    trees = {(s, c, stop): (p, a) for s, c, _, stop, p, a in blocks}
    assert set(got) == {x[:3] for x in edits}
    for s, c, pos, *edit in edits:
        x, t, y, u = got[s, c, pos]
        p, a = trees[s, c, pos]
        assert (x, t, u) == (edit[0], edit[1], edit[3])
        assert apply_spr(p, a, x, y, u) == apply_spr(p, a, edit[0], edit[2], edit[3])
    counted = nodes.groupBy("sample", "chrom", "event").count().collect()
    n = {(r.sample, r.chrom, r.event): r["count"] for r in counted}
    assert n[1, "1", "gene"] == 5 and n[1, "1", "coal"] == 4 + 60 and n[1, "1", "recomb"] == 60 and (3, "1", "recomb") not in n


def test_sub_graph(histories):
    blocks, edits, b, e = histories
    own = sorted(x for x in blocks if x[0] == 1 and x[1] == "1")
    start, stop = own[7][2] + 1, own[30][3] - 1
    nodes, edges = graphs.sub_graph(graphs.graph_nodes(b, e), graphs.graph_edges(b, e), "1", start, stop)
    want = sorted((s, c, max(x, start), min(y, stop), p, a) for s, c, x, y, p, a in blocks if c == "1" and x < stop and y > start)
    assert plain(graphs.graph_blocks(nodes, edges).collect()) == want
    assert sorted((r.sample, r.pos) for r in graphs.graph_edits(nodes, edges).collect()) == sorted((s, pos) for s, c, pos, *_ in edits if c == "1" and start < pos < stop)


def scrambled(rng, blocks, edits):
    """The same blocks with joints numbered anew in each, and the mapping from each block to the next."""
    out, broken = [], {(s, c, pos): x for s, c, pos, x, *_ in edits}
    before = None
    for s, c, start, stop, p, a in blocks:
        n = (len(p) + 1) // 2
        new = list(range(n)) + rng.sample(range(n, len(p)), n - 1)
        q, b = [0] * len(p), [0.0] * len(p)
        for x, up in enumerate(p):
            q[new[x]], b[new[x]] = (new[up] if up >= 0 else -1), a[x]
        mapping = None
        if before and before[:2] == (s, c):
            old, tree = before[2], before[3]
            gone = tree[broken[s, c, start]]
            mapping = [0] * len(p)
            for x in range(len(p)):
                mapping[old[x]] = -1 if x == gone else new[x]
        out.append((s, c, start, stop, q, b, mapping, new))
        before = (s, c, new, p)
    return out


MAPPED = BLOCKS + ", mapping array<int>"


@pytest.mark.parametrize("width", [2, 5, 1000])
def test_numbers_stay(spark, histories, width):
    blocks, edits, *_ = histories
    mixed = scrambled(random.Random(12), blocks, edits)
    got = numbering.stable_numbers(spark.createDataFrame([x[:7] for x in mixed], MAPPED), width)
    trees = got.select("sample", "chrom", "start", "stop", *(c.alias(n) for c, n in zip(numbering.renumbered("ptree", "age", "number"), ("ptree", "age"))))
    first = {}
    for s, c, *_, new in mixed:
        first.setdefault((s, c), new)
    want = []
    for s, c, start, stop, p, a in blocks:  # numbers are those of the first scrambled tree
        new = first[s, c]
        q, b = [0] * len(p), [0.0] * len(p)
        for x, up in enumerate(p):
            q[new[x]], b[new[x]] = (new[up] if up >= 0 else -1), a[x]
        want.append((s, c, start, stop, q, b))
    assert plain(trees.collect()) == sorted(want)


def test_lists_joined(spark, histories):
    """Cut between two blocks or inside one, the second part numbered anew: joined they are the same trees, and node numbers go on over the border."""
    blocks, edits, *_ = histories
    rng = random.Random(13)
    for inside in (False, True):
        left, right, cut = [], [], {}
        for key in sorted({x[:2] for x in blocks}):
            own = [x for x in blocks if x[:2] == key]
            k = rng.randrange(1, len(own)) if len(own) > 1 else 0
            middle = own[k][2] + 1 if (inside or not k) and own[k][3] - own[k][2] > 1 else None
            if middle is None and not k:
                continue
            cut[key] = middle or own[k][2]
            a, b = own[:k] + ([(*key, own[k][2], middle, *own[k][4:])] if middle else []), [(*key, middle or own[k][2], *own[k][3:])] + own[k + 1 :]
            left += [x[:7] for x in scrambled(rng, a, edits)]
            right += [x[:7] for x in scrambled(rng, b, edits)]
        whole, made = numbering.joined_blocks(spark.createDataFrame(left, MAPPED), spark.createDataFrame(right, MAPPED))
        stable = numbering.stable_numbers(whole, 4)
        trees = stable.select("sample", "chrom", "start", "stop", *(c.alias(n) for c, n in zip(numbering.renumbered("ptree", "age", "number"), ("ptree", "age")))).collect()
        clades = lambda p, a: {(frozenset(below(p, x) & set(range((len(p) + 1) // 2))), a[x]) for x in range(len(p))}
        got = {(r.sample, r.chrom, r.start, r.stop): clades(list(r.ptree), list(r.age)) for r in trees}
        assert got == {x[:4]: clades(x[4], x[5]) for x in blocks if x[:2] in cut}
        # one edit apart, one number changes at most
        ordered_trees = sorted((r.sample, r.chrom, r.start, list(r.age)) for r in trees)
        for x, y in zip(ordered_trees, ordered_trees[1:]):
            if x[:2] == y[:2]:
                assert sum(t != u for t, u in zip(x[3], y[3])) <= 1
        between = {(r.sample, r.chrom): r.pos for r in made.collect()}
        starts = {x[:3] for x in blocks}
        assert between == {k: pos for k, pos in cut.items() if (*k, pos) in starts}


GRID = time_grid(7, 300.0, 0.01)


@pytest.mark.parametrize("width", [7, 1 << 16])
def test_counts_by_edits_equal_those_of_trees(spark, histories, width):
    blocks, edits, *_ = histories
    near = lambda t: min(min(range(len(GRID)), key=lambda i: (abs(GRID[i] - t), i)), len(GRID) - 2)
    coal, lines = [0] * (len(GRID) - 1), [0] * (len(GRID) - 1)
    trees = {(s, c, stop): (p, a) for s, c, _, stop, p, a in blocks}
    first, given = {}, []
    for s, c, start, stop, p, a in blocks:
        if (s, c) not in first:
            first[s, c] = (s, c, p, a)
            for x, up in enumerate(p):
                coal[near(a[x])] += x >= (len(p) + 1) // 2
                for j in range(near(a[x]), near(a[up]) if up >= 0 else 0):
                    lines[j] += 1
    for s, c, pos, x, t, y, u in edits:
        p, a = trees[s, c, pos]
        given.append((s, c, pos, t, a[p[x]], u))
        coal[near(u)] += 1
        for j in range(near(t), near(u)):
            lines[j] += sum(near(a[z]) <= j and (up < 0 or near(a[up]) > j) for z, up in enumerate(p)) - (j < near(a[p[x]]))
    found = popsizes.sizes_from_edits(
        spark.createDataFrame(list(first.values()), "sample long, chrom string, ptree array<int>, age array<double>"),
        spark.createDataFrame(given, "sample long, chrom string, pos long, recomb_time double, broken_time double, coal_time double"), GRID, 100.0, 40.0, width,
    ).collect()
    assert {r.time_bin: (r.n_coal, r.n_lineages) for r in found} == {j: (coal[j], lines[j]) for j in range(len(GRID) - 1)}
    steps = [b - a for a, b in zip(GRID, GRID[1:])]
    assert all(r.popsize == popsizes.size_with_prior(r.n_coal, steps[r.time_bin] * r.n_lineages, 100.0, 40.0) for r in found)


def test_trees_of_splits(spark):
    """Random trees with dropped clades, splits in any order and repeated; both sides of a branch if unrooted; a conflict is told."""
    rng = random.Random(14)
    rows, want = [], {}
    for i in range(60):
        n = rng.randint(2, 70)
        p, _ = random_tree(rng, n, on_grid=False)
        clades = {frozenset(below(p, x) & set(range(n))) for x in range(n, 2 * n - 1) if rng.random() < 0.7} - {frozenset(range(n))}
        want[i] = clades
        given = [sorted(c) for c in clades] * 2 + [[0], list(range(n))]
        rng.shuffle(given)
        rows.append((i, n, given))
    frame = spark.createDataFrame(rows, "i int, n int, splits array<array<int>>")
    for r in frame.select("i", "n", forest.tree_of_splits()("splits", "n").alias("t")).collect():
        check_family(r, want[r.i])
    sides = spark.createDataFrame([(i, n, [s if rng.random() < 0.5 or len(s) == n else sorted(set(range(n)) - set(s)) for s in given]) for i, n, given in rows], "i int, n int, splits array<array<int>>")
    for r in sides.select("i", "n", forest.tree_of_splits(False)("splits", "n").alias("t")).collect():
        turned = {c if r.n - 1 not in c else frozenset(range(r.n)) - c for c in want[r.i]}
        check_family(r, {c for c in turned if len(c) > 1})
    wrong = spark.createDataFrame([(0, 4, [[0, 1], [2, 3], [1, 2]]), (1, 3, []), (2, 4, [[0, 1]])], "i int, n int, splits array<array<int>>")
    out = {r.i: r.t for r in wrong.select("i", forest.tree_of_splits()("splits", "n").alias("t")).collect()}
    assert out[0].parent is None and 2 in out[0].conflict and list(out[1].parent) == [3, 3, 3, -1] and list(out[2].parent) == [4, 4, 5, 5, 5, -1]


def check_family(r, clades):
    assert r.t.conflict is None
    whole = frozenset(range(r.n))
    assert [frozenset(c) for c in r.t.clades][-1] == whole and {frozenset(c) for c in r.t.clades} == clades | {whole}
    parents = list(r.t.parent)
    for x, up in enumerate(parents):
        own = frozenset([x]) if x < r.n else frozenset(r.t.clades[x - r.n])
        holders = [c for c in clades | {whole} if own < c]
        assert (up == -1 and own == whole) or frozenset(r.t.clades[up - r.n]) == min(holders, key=len)
