"""Where a further lineage joins a local tree: how likely each place is, how likely it moves from one base to the next, and how likely its base is there.

A place is a branch, numbered by the node below it, and a grid time the branch
has; the last grid time has none. Whole Arrow batches of trees are worked on at
once, by times and not by places: a tree costs its nodes and the square of the
number of times.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalar import half_steps, time_steps
from ..operators.forest import Forest, nested
from .likelihood import SiteMessages, through


class JoinTimes:
    """Of each tree of a forest and each pair of times, how a lineage that begins at grid time `since` joins and moves.

    It joins at a rate of the tree's branches over twice the population size,
    at time b if it does in the half steps around b, and at the last but one
    time at the latest; all branches that have the time are alike. Between two
    bases a recombination falls on the tree with the lineage at a rate rho and
    cuts it at a time k; it then joins anew from k on. A tree counts as long as
    one generation at least.
    """

    def __init__(self, forest: Forest, grid: list[float], sizes: list[float], rho: float = 0.0, since: int = 0):
        self.forest, n = forest, len(grid) - 1
        times, steps = np.array(grid[:n]), np.array(time_steps(grid))
        branches, places = forest.branches(grid)[:, :n], forest.points(grid)[:, :n]
        root = forest.spans(grid)[0][forest.parent < 0][:, None]
        at, top = np.arange(n), n - 1

        rates = np.array(half_steps(grid)) * np.repeat(branches / (2 * np.array(sizes[:n])), 2, axis=1)
        waited = np.concatenate((np.zeros((len(rates), 1)), np.cumsum(rates, axis=1)), axis=1)
        above = rates[:, 0::2]
        below = np.concatenate((np.zeros((len(rates), 1)), rates[:, 1:-1:2]), axis=1)
        # joined around a time when coming from an earlier one, and when cut at this very time
        self.joined, self.rejoined = (np.where(at == top, 1.0, -np.expm1(-r)) for r in (above + below, above))
        self.places, self.before, self.here = places, waited[:, 2 * at - (at > 0)], waited[:, 2 * at]

        length = forest.length(grid)[:, None] + times - times[since] + np.where(at > root, times - times[root], 0)
        lasting = np.maximum(length, 1)
        self.stays, self.leaves = np.exp(-rho * lasting), -np.expm1(-rho * lasting) / (length + steps[np.maximum(at, root)])
        cut = at >= since
        # cuts at a time where the lineage goes on, and at the one where it ends, which the joint has a share in below the root
        self.inner = steps * (branches + 1) / (places + 1) * cut
        self.last = steps * branches / (places + 1 + (at < root)) * cut
        # weight of all cuts before each time that have not joined again
        free = np.zeros_like(self.inner)
        for b in range(1, n):
            free[:, b] = free[:, b - 1] * np.exp(-below[:, b - 1] - above[:, b - 1]) + self.inner[:, b - 1] * np.exp(-above[:, b - 1])
        self.free, self.since = free, since

    def prior(self) -> np.ndarray:
        """(tree, time): probability of each place at a time; over all places of a tree 1."""
        s = self.since
        came = np.exp(-(self.before - self.here[:, [s]]).clip(min=0)) * self.joined
        came[:, s] = self.rejoined[:, s]
        came[:, :s] = 0
        return came / self.places

    def survived(self) -> np.ndarray:
        """(tree, a, b): the weight of cuts before a that join at b; 0 where b < a."""
        n = self.places.shape[1]
        gap = self.before[:, None, :] - self.before[:, :, None]
        return np.where(np.arange(n)[:, None] <= np.arange(n), self.free[:, :, None] * np.exp(-gap.clip(min=0)), 0) * self.joined[:, None, :]

    def moved(self) -> np.ndarray:
        """(tree, a, b): probability of a move from a place at time a to one at time b on another branch."""
        n = self.places.shape[1]
        a, b = np.arange(n)[:, None], np.arange(n)
        early = self.survived()
        on_time = self.last[:, :, None] * np.exp(-(self.before[:, None, :] - self.here[:, :, None]).clip(min=0)) * self.joined[:, None, :]
        arrive = (self.free * self.joined)[:, None, :]
        later = early + on_time
        same = arrive + (self.last * self.rejoined)[:, None, :]
        earlier = arrive + (self.inner * self.rejoined)[:, None, :]
        weight = np.where(a < b, later, np.where(a == b, same, earlier))
        out = self.leaves[:, :, None] * weight / self.places[:, None, :]
        return np.where((a >= self.since) & (b >= self.since), out, 0)

    def moved_on_branch(self, moved: np.ndarray, low: np.ndarray) -> np.ndarray:
        """(item, a, b) for items of trees with their branch's lower end `low`: probability of ending on the branch that the lineage was on, by a cut of either or none."""
        n = self.places.shape[1]
        tree = np.arange(len(moved))
        apart = self.leaves[:, :, None] / self.places[:, None, :]
        out = 2 * moved - apart * self.survived()[tree, np.maximum(low, self.since)][:, None, :]
        out[:, np.arange(n), np.arange(n)] += self.stays
        return np.where((np.arange(n)[:, None] >= self.since) & (np.arange(n) >= self.since), out, 0)

    def totals(self, grid: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Node, time and probability of ending anywhere on the same tree, of every place. What is missing to 1 are recombinations that change the tree."""
        f, n = self.forest, self.places.shape[1]
        low, high = (np.maximum(x, self.since) for x in f.spans(grid))
        moved = self.moved()
        anywhere = (moved * self.places[:, None, :]).sum(axis=2)
        sums = lambda x: np.concatenate((np.zeros((*x.shape[:-1], 1)), np.cumsum(x, axis=-1)), axis=-1)
        own, early, share = sums(moved), sums(self.survived() / self.places[:, None, :]), self.leaves
        size = high - low + 1
        node = np.repeat(np.arange(len(low)), size)
        a = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size) + low[node]
        t = f.tree[node]
        back = own[t, a, high[node] + 1] - own[t, a, low[node]] - share[t, a] * (early[t, low[node], high[node] + 1] - early[t, low[node], low[node]])
        return node, a, anywhere[t, a] + back + self.stays[t, a]


_PRIOR = T.StructType([T.StructField("places", T.IntegerType()), T.StructField("prior", T.DoubleType())])


def join_priors(grid: list[float], sizes: list[float], ptree="ptree", age="age") -> Column:
    """array of struct(places, prior): by grid time how many places there are, the branches that have it, and the probability of each that a new leaf joins there."""

    @F.arrow_udf(T.ArrayType(_PRIOR))
    def prior(ptree: pa.Array, age: pa.Array) -> pa.Array:
        times = JoinTimes(Forest(ptree, age), grid, sizes)
        rows = pa.StructArray.from_arrays([pa.array(times.places.ravel(), pa.int32()), pa.array(times.prior().ravel())], ["places", "prior"])
        return nested(rows, np.full(len(ptree), len(grid) - 1))

    return prior(ptree, age)


_MOVES = T.StructType([T.StructField("other", T.ArrayType(T.DoubleType())), T.StructField("leaf", T.ArrayType(T.DoubleType()))])


def join_moves(grid: list[float], sizes: list[float], rho: float, ptree="ptree", age="age") -> Column:
    """array of struct(other, leaf): by time, and in the arrays by time at the next base, the probability of a move to a given place of another branch, and of the same branch if it is a leaf's."""

    @F.arrow_udf(T.ArrayType(_MOVES))
    def moves(ptree: pa.Array, age: pa.Array) -> pa.Array:
        times, n = JoinTimes(Forest(ptree, age), grid, sizes, rho), len(grid) - 1
        other = times.moved()
        leaf = times.moved_on_branch(other, np.zeros(len(other), np.int64))
        rows = pa.StructArray.from_arrays([nested(pa.array(x.ravel()), np.full(len(x) * n, n)) for x in (other, leaf)], ["other", "leaf"])
        return nested(rows, np.full(len(other), n))

    return moves(ptree, age)


def by_tree(f: Forest, node: np.ndarray, columns: dict[str, pa.Array]) -> pa.ListArray:
    """For each tree a list of structs, of items that follow the order of the trees."""
    return nested(pa.StructArray.from_arrays(list(columns.values()), list(columns)), np.bincount(f.tree[node], minlength=len(f.sizes)))


def join_totals(grid: list[float], sizes: list[float], rho: float, ptree="ptree", age="age") -> Column:
    """array of struct(node, time_bin, total): of each place the probability that the lineage is somewhere on the same tree at the next base."""

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("node", T.IntegerType()), T.StructField("time_bin", T.IntegerType()), T.StructField("total", T.DoubleType())])))
    def totals(ptree: pa.Array, age: pa.Array) -> pa.Array:
        f = Forest(ptree, age)
        node, time, total = JoinTimes(f, grid, sizes, rho).totals(grid)
        return by_tree(f, node, {"node": pa.array(f.place[node], pa.int32()), "time_bin": pa.array(time, pa.int32()), "total": pa.array(total)})

    return totals(ptree, age)


def place_likelihoods(f: Forest, cols: list[str], grid: list[float], mu: float, min_length: float = 1.0, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, time and likelihood of every place of each tree for its column, whose last base is the further leaf's."""
    times = np.array(grid)
    (low, high), f.age = f.spans(grid), times[f.spans(grid)[0]]  # nodes at their grid times, as the places are
    known, last = "".join(c[:-1] for c in cols), "".join(c[-1] for c in cols)
    found = SiteMessages(f, np.ones(len(cols), np.int64), known, mu, min_length)
    size = high - low + 1
    node = np.repeat(np.arange(len(low)), size)
    a = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size) + low[node]
    tree, up = f.tree[node], f.parent[node]
    side = lambda part, length: through(part, np.maximum(length, min_length), mu)
    part = side(found.bases(last)[tree], times[a]) * side(found.inner[node], times[a] - f.age[node])
    part *= np.where((up >= 0)[:, None], side(found.outer()[node], f.age[up] - times[a]), 1.0)
    like = part.sum(axis=1) / 4
    if penalty < 1:
        sets, own = f.parsimony_refined(f.parsimony_sets(known)[0]), found.bits(last)[tree]
        like = np.where((own & sets[node]) | np.where(up >= 0, own & sets[up], 0), like, like * penalty)
    return node, a, like


def join_likelihoods(rows: DataFrame, grid: list[float], mu: float, min_length: float = 1.0, penalty: float = 1.0) -> DataFrame:
    """rows (ptree, age, col) with places: array of struct(node, time_bin, likelihood), the likelihood of the column with the further leaf at each place.

    A column has a base of each leaf, then that of the further leaf; other
    symbols are unknown. One pass from the leaves and one from the root give
    every place. With a penalty below 1 a place that needs a change of its own,
    where neither end of its branch may have the leaf's base by parsimony, is
    multiplied by it.
    """
    place = T.StructType([T.StructField("node", T.IntegerType()), T.StructField("time_bin", T.IntegerType()), T.StructField("likelihood", T.DoubleType())])

    @F.arrow_udf(T.ArrayType(place))
    def score(ptree: pa.Array, age: pa.Array, col: pa.Array) -> pa.Array:
        f = Forest(ptree, age)
        node, a, like = place_likelihoods(f, col.to_pylist(), grid, mu, min_length, penalty)
        return by_tree(f, node, {"node": pa.array(f.place[node], pa.int32()), "time_bin": pa.array(a, pa.int32()), "likelihood": pa.array(like)})

    return rows.withColumn("places", score("ptree", "age", "col"))
