"""Places of a further lineage, likelihood passes and ancestral bases against plain Python on random trees."""

import math
import random
from itertools import product

import numpy as np
import pandas as pd
import pytest

from loamtree.functions.scalar import half_steps, time_grid, time_steps
from loamtree.operators import forest
from loamtree.operators.forest import Forest
from loamtree.plans import joining, likelihood
from loamtree.plans.joining import JoinTimes
from loamtree.queries import core
from loamtree.tables import bushy_trees

GRID = time_grid(9, 300.0, 0.01)
SIZES = [40.0 + 3 * i for i in range(len(GRID))]


def random_tree(rng, n, grid=GRID, on_grid=True):
    """Lineages that join in random order; nodes at grid times or anywhere below the last but one."""
    top = len(grid) - 2
    times = sorted(rng.choice(grid[: top + 1]) if on_grid else rng.uniform(0, grid[top]) for _ in range(n - 1))
    parents, ages, free = [-1] * n, [0.0] * n, list(range(n))
    for t in times:
        a, b = rng.sample(free, 2)
        parents.append(-1)
        ages.append(t)
        parents[a] = parents[b] = len(parents) - 1
        free = [x for x in free if x not in (a, b)] + [len(parents) - 1]
    return parents, ages


def forests(rng, sizes, **kind):
    trees = [random_tree(rng, n, **kind) for n in sizes]
    return trees, Forest(pd.Series([t[0] for t in trees]), pd.Series([t[1] for t in trees]))


class Literal:
    """One tree, one pair of places at a time, by definition."""

    def __init__(self, parents, ages, rho, since):
        self.p, self.rho, self.since, self.top = parents, rho, since, len(GRID) - 2
        self.bin = [GRID.index(t) for t in ages]
        self.root = parents.index(-1)
        ends = [(self.bin[x], self.bin[up] if up >= 0 else self.top) for x, up in enumerate(parents)]
        self.ends = ends
        self.lines = [sum(lo <= k < hi for lo, hi in ends) + (k == self.top) for k in range(self.top + 1)]
        self.spots = [sum(lo <= k <= hi for lo, hi in ends) for k in range(self.top + 1)]
        self.length = sum(GRID[hi] - GRID[lo] for x, (lo, hi) in enumerate(ends) if x != self.root)
        self.places = [(x, t) for x, (lo, hi) in enumerate(ends) for t in range(max(lo, since), hi + 1)]

    def joins(self, k, b):
        half, total = half_steps(GRID), 0.0
        rate = lambda m: half[m] * self.lines[m // 2] / (2 * SIZES[m // 2])
        for m in range(2 * k, 2 * b - 1):
            total += rate(m)
        around = rate(2 * b) + (rate(2 * b - 1) if b > k else 0)
        return math.exp(-total) * (1 if b == self.top else 1 - math.exp(-around)) / self.spots[b]

    def cut(self, a, k):
        top = max(a, self.bin[self.root])
        length = self.length + GRID[a] - GRID[self.since] + max(0.0, GRID[a] - GRID[self.bin[self.root]])
        spots = self.spots[k] + (k <= a) + (k == a < top)
        share = (self.lines[k] + (k < a)) * time_steps(GRID)[k] / (spots * (length + time_steps(GRID)[top]))
        return share * (1 - math.exp(-self.rho * max(length, 1))), math.exp(-self.rho * max(length, 1))

    def move(self, one, two):
        (x, a), (y, b) = one, two
        cuts = list(range(self.since, min(a, b) + 1))
        if x == y:
            cuts += range(max(self.bin[x], self.since), min(a, b) + 1)
        p = sum(self.cut(a, k)[0] * self.joins(k, b) for k in cuts)
        return p + (self.cut(a, a)[1] if one == two else 0)


@pytest.mark.parametrize("since", [0, 2])
def test_moves_equal_the_literal_sum(since):
    rng = random.Random(3)
    trees, f = forests(rng, [1, 2, 2, 3, 5, 8, 12])
    rho = 2e-3
    times = JoinTimes(f, GRID, SIZES, rho, since)
    prior, moved = times.prior(), times.moved()
    node, at, total = times.totals(GRID)
    found = {(int(x), int(a)): float(t) for x, a, t in zip(node, at, total)}
    for i, (parents, ages) in enumerate(trees):
        slow = Literal(parents, ages, rho, since)
        assert sum(prior[i][a] for _, a in slow.places) == pytest.approx(1, abs=1e-12)
        for x, a in slow.places:
            assert prior[i][a] == pytest.approx(slow.joins(since, a), rel=1e-9)
            row = [slow.move((x, a), to) for to in slow.places]
            assert found[int(f.first[i]) + x, a] == pytest.approx(sum(row), rel=1e-9)
            assert sum(row) <= 1 + 1e-12
            own = times.moved_on_branch(moved, np.array([slow.bin[x] if j == i else 0 for j in range(len(trees))]))
            for (y, b), p in zip(slow.places, row):
                assert (own if x == y else moved)[i][a][b] == pytest.approx(p, rel=1e-9), (x, a, y, b)
    # of one leaf nothing but the lineage's own tree can come
    assert all(t == pytest.approx(1, abs=1e-12) for (x, _), t in found.items() if x == 0) or since


def brute_likelihood(parents, ages, col, mu, least):
    n, root = len(parents), parents.index(-1)
    may = lambda c: {"A": {0}, "C": {1}, "G": {2}, "T": {3}}.get(c, {0, 1, 2, 3})
    leaves, total = [x for x in range(n) if x not in parents], 0.0
    inner = [x for x in range(n) if x in parents]
    for bases in product(range(4), repeat=len(inner)):
        for tip in product(*(may(c) for c in col)):
            own = dict(zip(inner, bases)) | dict(zip(leaves, tip))
            p = 0.25
            for x, up in enumerate(parents):
                if x != root:
                    kept = math.exp(-4 / 3 * mu * max(ages[up] - ages[x], least))
                    p *= (kept if own[x] == own[up] else 0) + (1 - kept) / 4
            total += p
    return total


def attached(parents, ages, x, t):
    """The tree with a further leaf, number n, that joins the branch above x at t; all other nodes move up by one, the joint is the last."""
    n = (len(parents) + 1) // 2
    new = lambda y: y if y < n else y + 1
    p = [new(up) if up >= 0 else -1 for up in parents]
    p, a = p[:n] + [None] + p[n:], list(ages[:n]) + [0.0] + list(ages[n:])
    joint = len(p)
    p.append(p[new(x)])
    a.append(t)
    p[new(x)] = p[n] = joint
    return p, a


def test_likelihood_of_a_further_leaf():
    rng = random.Random(4)
    trees, f = forests(rng, [1, 2, 3, 4, 4])
    cols = ["".join(rng.choice("ACGTN") for _ in range((len(p) + 1) // 2 + 1)) for p, _ in trees]
    mu, least = 2e-3, 1.0
    found = joining.place_likelihoods(f, cols, GRID, mu, least)
    rows = {(int(x), int(a)): float(v) for x, a, v in zip(*found)}
    for i, (parents, ages) in enumerate(trees):
        slow = Literal(parents, ages, 0, 0)
        for x, a in slow.places:
            p, t = attached(parents, ages, x, GRID[a])
            want = brute_likelihood(p, t, cols[i], mu, least)
            assert rows[int(f.first[i]) + x, a] == pytest.approx(want, rel=1e-9)
            again = likelihood.SiteMessages(Forest(pd.Series([p]), pd.Series([t])), np.ones(1, np.int64), cols[i], mu, least)
            assert again.likelihood()[0] == pytest.approx(want, rel=1e-9)
    assert len(rows) == sum(len(Literal(p, a, 0, 0).places) for p, a in trees)


def test_penalty_of_a_change_of_its_own():
    """The leaf's G is in neither end of the branches of a tree of A, and in one of G's."""
    f = Forest(pd.Series([[3, 3, 4, 4, -1]]), pd.Series([[0.0, 0.0, 0.0, GRID[2], GRID[4]]]))
    plain, strict = (joining.place_likelihoods(f, ["AAAG"], GRID, 1e-3, 1.0, p) for p in (1.0, 0.01))
    np.testing.assert_allclose(strict[2], plain[2] * 0.01)
    plain, strict = (joining.place_likelihoods(f, ["AGAG"], GRID, 1e-3, 1.0, p) for p in (1.0, 0.01))
    assert {int(x) for x, a, p, s in zip(*plain[:2], plain[2], strict[2]) if s < p} == {0, 2, 3, 4}  # only the branch of the leaf with G is free


def test_outer_and_inner_meet_in_every_node():
    """The likelihood of a column is the same from every branch; several columns of a tree at once."""
    rng = random.Random(5)
    trees, f = forests(rng, [3, 6, 9], on_grid=False)
    columns = np.array([4, 1, 7])
    symbols = "".join(rng.choice("ACGTN") for (p, _), c in zip(trees, columns) for _ in range(c * ((len(p) + 1) // 2)))
    m = likelihood.SiteMessages(f, columns, symbols, 1e-3, 1.0)
    whole = np.zeros(len(m.inner))
    for items in m.levels:
        whole[items] = np.where(m.up[items] >= 0, whole[m.up[items]], m.inner[items].mean(axis=1))
    joint = (likelihood.through(m.outer(), m.length, 1e-3) * m.inner).sum(axis=1) / 4
    inside = m.up >= 0
    np.testing.assert_allclose(joint[inside], whole[inside], rtol=1e-9)


def fewest_changes(parents, col):
    n, best = len(parents), 10**9
    inner = [x for x in range(n) if x in parents]
    for bases in product("ACGT", repeat=len(inner)):
        own = dict(zip(inner, bases))
        tips = {x: c if c in "ACGT" else own.get(parents[x], "A") for x, c in enumerate(col)}
        own |= tips
        best = min(best, sum(up >= 0 and own[x] != own[up] for x, up in enumerate(parents)))
    return best


def test_ancestral_bases_need_the_fewest_changes():
    rng = random.Random(6)
    trees, f = forests(rng, [2, 3, 4, 5, 5, 6], on_grid=False)
    cols = ["".join(rng.choice("ACGTN") for _ in range((len(p) + 1) // 2)) for p, _ in trees]
    sets, cost = f.parsimony_sets("".join(cols))
    states = f.parsimony_states(sets)
    for i, ((parents, _), col) in enumerate(zip(trees, cols)):
        own = states[f.first[i] : f.first[i + 1]]
        letters = [{1: "A", 2: "C", 4: "G", 8: "T"}[int(s)] for s in own]
        assert all(c == "N" or letters[x] == c for x, c in enumerate(col))
        changes = sum(up >= 0 and letters[x] != letters[up] for x, up in enumerate(parents))
        assert changes == cost[i] == fewest_changes(parents, col)


def test_bushy_trees(spark, sf_dir):
    """Any shape, sound, and ages rise with the numbers of joints."""
    shapes = set()
    for r in bushy_trees(spark, sf_dir).collect():
        n = (len(r.ptree) + 1) // 2
        assert sorted(up for up in r.ptree if up >= 0) == sorted(2 * list(range(n, 2 * n - 1))) and r.ptree.count(-1) == 1
        assert all(up < 0 or (up > x and r.age[up] > r.age[x]) for x, up in enumerate(r.ptree))
        shapes.add((n, sum(sum(y < n for y, up in enumerate(r.ptree) if up == x) == 2 for x in range(n, 2 * n - 1))))
    assert len([s for s in shapes if s[1] > 1]) > 2
    assert core.GRID[-2] > 0


def test_whole_likelihood_is_the_sum_over_bases(spark):
    """Blocks with and without sites, and more sites than go in one part."""
    rng = random.Random(7)
    parents, ages = random_tree(rng, 4)
    blocks = spark.createDataFrame([(0, "1", 0, 1000, parents, ages), (0, "1", 1000, 1010, parents, ages)], "sample long, chrom string, start long, stop long, ptree array<int>, age array<double>")
    sites = [("1", p, "".join(rng.choice("ACGTN") for _ in range(4))) for p in rng.sample(range(1005), 700)]
    got = likelihood.tree_log_likelihood(blocks, spark.createDataFrame(sites, "chrom string, pos long, col string"), 1e-3).first().log_likelihood
    f = Forest(pd.Series([parents]), pd.Series([ages]))
    each = likelihood.SiteMessages(f, np.array([len(sites) + 1]), "".join(c for _, _, c in sites) + "AAAA", 1e-3).likelihood()
    assert got == pytest.approx(np.log(each[:-1]).sum() + (1010 - 700) * np.log(each[-1]), rel=1e-9)


def leaf_paths(parents, length):
    n = (len(parents) + 1) // 2
    up = lambda x: [x, *(up(parents[x]) if parents[x] >= 0 else [])]
    out = {}
    for a in range(n):
        for b in range(a):
            one, two = up(a), up(b)
            out[a, b] = sum(length[x] for x in set(one) ^ set(two))
    return out


def test_rerooting_keeps_all_paths():
    rng = random.Random(8)
    for n in (2, 3, 5, 9):
        p, a = random_tree(rng, n, on_grid=False)
        length = [a[up] - a[x] if up >= 0 else 0.0 for x, up in enumerate(p)]
        nodes = [x for x, up in enumerate(p) if up >= 0]
        found = forest.rerooted.func(pd.Series(nodes), pd.Series([0.3] * len(nodes)), pd.Series([p] * len(nodes)), pd.Series([a] * len(nodes)))
        for x, q, b in zip(nodes, found.ptree, found.length):
            q, b = q.tolist(), b.tolist()
            assert q.count(-1) == 1 and q[p.index(-1)] == -1 and sorted(q) == sorted(p) and q[x] == p.index(-1)
            assert b[x] == pytest.approx(0.3 * length[x])
            want = leaf_paths(p, length)
            assert leaf_paths(q, b) == pytest.approx(want)
            assert forest.longest_path.func(pd.Series([q]), pd.Series([b]))[0] == pytest.approx(max(want.values()))
    with pytest.raises(ValueError):
        forest.rerooted.func(pd.Series([2]), pd.Series([0.5]), pd.Series([[2, 2, -1]]), pd.Series([[0.0, 0.0, 1.0]]))


def test_canonical_form_and_path_correlation():
    rng = random.Random(9)
    for n in (2, 3, 4, 8, 15):
        (p, a), (q, _) = random_tree(rng, n, on_grid=False), random_tree(rng, n, on_grid=False)
        new = list(range(n)) + rng.sample(range(n, 2 * n - 1), n - 1)
        turned, ages = [0] * len(p), [0.0] * len(p)
        for x, up in enumerate(p):
            turned[new[x]], ages[new[x]] = (new[up] if up >= 0 else -1), a[x]
        one = forest.canonical.func(pd.Series([p, turned, q]), pd.Series([a, ages, a]))
        assert one.ptree[0].tolist() == one.ptree[1].tolist() and one.age[0].tolist() == one.age[1].tolist()
        clades = lambda t: {frozenset(y for y in range(n) if x in path(t, y)) for x in range(len(t))}
        path = lambda t, y: [y, *(path(t, t[y]) if t[y] >= 0 else [])]
        assert (one.ptree[0].tolist() == one.ptree[2].tolist()) == (clades(p) == clades(q))
        d, e = (np.array([v for _, v in sorted(leaf_paths(t, [1] * len(t)).items())], float) for t in (p, q))
        got = forest.path_correlation.func(pd.Series([p]), pd.Series([q]))[0]
        assert got is None if d.std() == 0 or e.std() == 0 else got == pytest.approx(np.corrcoef(d, e)[0, 1])
