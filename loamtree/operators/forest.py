"""Trees of a whole Arrow batch as flat arrays: each step is one array operation for all trees at once."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

#: Bits of the bases; anything else may be any of them.
BASES = {"A": 1, "C": 2, "G": 4, "T": 8}
BITS = np.full(128, 15, np.uint8)
for _base, _bit in BASES.items():
    BITS[ord(_base)] = _bit


def _lengths(lists: pd.Series | pa.ListArray) -> np.ndarray:
    if isinstance(lists, pa.Array):
        return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.fromiter(map(len, lists), np.int64, len(lists))


def _flat(lists: pd.Series | pa.ListArray, kind: type) -> np.ndarray:
    if isinstance(lists, pa.Array):
        return lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return np.concatenate([np.zeros(0, kind), *(np.asarray(x, kind) for x in lists)])


def nested(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    """Arrays of the given sizes, one behind the other in `values`."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)


class Forest:
    """Parents and ages of the nodes of some trees, one tree behind the other; a parent is a place in the flat array, -1 above a root."""

    def __init__(self, ptree: pd.Series | pa.ListArray, age: pd.Series | pa.ListArray | None = None):
        self.sizes = _lengths(ptree)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.tree = np.repeat(np.arange(len(ptree)), self.sizes)
        local = _flat(ptree, np.int64)
        self.parent = np.where(local < 0, -1, local + self.first[self.tree])
        self.age = _flat(age, float) if age is not None else None
        self.place = np.arange(len(local)) - self.first[self.tree]
        self.leaf = self.place < ((self.sizes + 1) // 2)[self.tree]

    def depth(self) -> np.ndarray:
        """Steps to the root."""
        depth, up = np.zeros(len(self.parent), np.int64), self.parent.copy()
        while (go := up >= 0).any():
            depth += go
            up = np.where(go, self.parent[up], -1)
        return depth

    def below(self, of: np.ndarray) -> np.ndarray:
        """How many of the nodes `of` are below each node, itself included."""
        count, up = np.zeros(len(self.parent), np.int64), of
        while len(up):
            count += np.bincount(up, minlength=len(count))
            up = self.parent[up]
            up = up[up >= 0]
        return count

    def lists(self, values: np.ndarray, keep: np.ndarray | None = None) -> list[np.ndarray]:
        """The values of each tree's nodes, or of those to keep."""
        if keep is None:
            return np.split(values, self.first[1:-1])
        return np.split(values[keep], np.cumsum(np.bincount(self.tree[keep], minlength=len(self.sizes)))[:-1])

    def held(self, leaves: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """How many leaves, and how many of the given ones, are below each node."""
        given = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) + start for x, start in zip(leaves, self.first))])
        return self.below(np.flatnonzero(self.leaf)), self.below(given)

    def outermost(self, member: np.ndarray) -> np.ndarray:
        """Nodes of a kind whose parent is not of it, where all nodes below one of the kind are."""
        return np.flatnonzero(member & ~((self.parent >= 0) & member[self.parent]))

    def middle(self) -> np.ndarray:
        """Age of the middle of the branch above each node, the root's own age."""
        return np.where(self.parent >= 0, (self.age + self.age[self.parent]) / 2, self.age)

    def ancestor(self, all_: np.ndarray, own: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Of each tree the node with the fewest leaves that has all `count` of those in `own`; -1 for none."""
        holds = np.flatnonzero((own == count[self.tree]) & (own > 0))
        holds = holds[np.lexsort((all_[holds], self.tree[holds]))]
        trees, at = np.unique(self.tree[holds], return_index=True)
        out = np.full(len(self.sizes), -1)
        out[trees] = holds[at]
        return out

    def spans(self, grid: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Grid times of each node and its parent, the last but one above the root; no node lies at the last."""
        times = np.array(grid)
        near = np.abs(self.age[:, None] - times[None, :]).argmin(axis=1)
        low = np.minimum(near, len(grid) - 2)
        return low, np.where(self.parent >= 0, low[self.parent], len(grid) - 2)

    def branches(self, grid: list[float]) -> np.ndarray:
        """Of each tree the branches between each grid time and the next; the root's goes on over the last but one time, the last has one."""
        (low, high), n = self.spans(grid), len(grid)
        edge = np.zeros((len(self.sizes), n + 1), np.int64)
        np.add.at(edge, (self.tree, low), 1)
        np.add.at(edge, (self.tree, high), -1)
        counts = np.cumsum(edge, axis=1)[:, :n]
        counts[:, n - 2] += 1
        counts[:, n - 1] = 1
        return counts

    def points(self, grid: list[float]) -> np.ndarray:
        """Of each tree the branches that have each grid time, their ends included."""
        (low, high), n = self.spans(grid), len(grid)
        edge = np.zeros((len(self.sizes), n + 1), np.int64)
        np.add.at(edge, (self.tree, low), 1)
        np.add.at(edge, (self.tree, high + 1), -1)
        return np.cumsum(edge, axis=1)[:, :n]

    def parsimony_sets(self, symbols: str) -> tuple[np.ndarray, np.ndarray]:
        """Of each tree with a column, a base a leaf, the bases of each node from below as bits, and the changes they need."""
        sets = np.zeros(len(self.parent), np.uint8)
        sets[self.leaf] = BITS[np.frombuffer(symbols.encode("ascii"), np.uint8)]
        return sets, _cost(self, sets)

    def parsimony_states(self, sets: np.ndarray) -> np.ndarray:
        """One base of each node, as a bit, from the sets: its parent's where its set has it, else the first of A, C, G, T that it has. The changes along branches are the fewest."""
        first = sets & (~sets + np.uint8(1))
        out, depth = first.copy(), self.depth()
        for d in range(1, int(depth.max(initial=0)) + 1):
            nodes = np.flatnonzero(depth == d)
            own = sets[nodes] & out[self.parent[nodes]]
            out[nodes] = np.where(own > 0, own, first[nodes])
        return out

    def parsimony_refined(self, sets: np.ndarray) -> np.ndarray:
        """The sets with the bases they share with those of their parent, refined before, where there are any."""
        out, depth = sets.copy(), self.depth()
        for d in range(1, int(depth.max(initial=0)) + 1):
            nodes = np.flatnonzero(depth == d)
            own = sets[nodes] & out[self.parent[nodes]]
            out[nodes] = np.where(own > 0, own, sets[nodes])
        return out

    def length(self, grid: list[float]) -> np.ndarray:
        """Of each tree its length with every node at its grid time."""
        low, high = self.spans(grid)
        times, inner = np.array(grid), self.parent >= 0
        return np.bincount(self.tree[inner], (times[high] - times[low])[inner], len(self.sizes))


_AGE = T.StructType([T.StructField("age", T.DoubleType()), T.StructField("infinite_sites", T.BooleanType()), T.StructField("flipped", T.BooleanType())])


@F.pandas_udf(_AGE)
def allele_age(derived: pd.Series, ptree: pd.Series, age: pd.Series) -> pd.DataFrame:
    """Age of a site whose minor allele the leaves in `derived` have.

    The largest branch middle among the branches that explain the minor allele,
    or the other allele where that takes fewer branches (flipped); -1 where all
    leaves agree. One branch means infinite sites.
    """
    f = Forest(ptree, age)
    all_, own = f.held(derived)
    n = len(f.sizes)
    minor, major = f.outermost(own == all_), f.outermost(own == 0)
    n_minor, n_major = (np.bincount(f.tree[x], minlength=n) for x in (minor, major))
    flipped = (n_minor > 1) & (n_major < n_minor)
    chosen = np.concatenate((minor[~flipped[f.tree[minor]]], major[flipped[f.tree[major]]]))
    out = np.full(n, -np.inf)
    np.maximum.at(out, f.tree[chosen], f.middle()[chosen])
    return pd.DataFrame({"age": np.where((n_minor == 0) | (n_major == 0), -1.0, out), "infinite_sites": np.where(flipped, n_major, n_minor) == 1, "flipped": flipped})


@F.pandas_udf(T.DoubleType())
def mutation_age(derived: pd.Series, ptree: pd.Series, age: pd.Series) -> pd.Series:
    """The middle of the one branch that explains the leaves in `derived`, the root's age above the root; 0 where no leaf is left or no one branch does."""
    f = Forest(ptree, age)
    all_, own = f.held(derived)
    nodes = f.outermost(own == all_)
    out = np.zeros(len(f.sizes))
    out[f.tree[nodes]] = f.middle()[nodes]
    return pd.Series(np.where(np.bincount(f.tree[nodes], minlength=len(out)) == 1, out, 0.0))


_BOUNDS = T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("flipped", T.BooleanType())])


@F.pandas_udf(_BOUNDS)
def derived_clade_age(derived: pd.Series, ptree: pd.Series, age: pd.Series) -> pd.DataFrame:
    """The ends of the branch above the common ancestor of the leaves in `derived`.

    Where that is the root, the other leaves count as derived (flipped), if
    there are any; above the root a branch ends at a million.
    """
    f = Forest(ptree, age)
    all_, own = f.held(derived)
    count, leaves = np.array([len(x) for x in derived]), (f.sizes + 1) // 2
    node = f.ancestor(all_, own, count)
    flipped = (f.parent[node] < 0) & (count < leaves)
    node = np.where(flipped, f.ancestor(all_, all_ - own, leaves - count), node)
    up = f.parent[node]
    return pd.DataFrame({"low": f.age[node], "high": np.where(up >= 0, f.age[up], 1e6), "flipped": flipped})


@F.pandas_udf(T.IntegerType())
def common_ancestor(leaves: pd.Series, ptree: pd.Series) -> pd.Series:
    """The node with the fewest leaves that has all the given ones below it."""
    f = Forest(ptree)
    return pd.Series(f.place[f.ancestor(*f.held(leaves), np.array([len(set(x)) for x in leaves]))])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def clades(ptree: pd.Series) -> pd.Series:
    """For each node the ascending leaves below it."""
    f = Forest(ptree)
    leaf = np.flatnonzero(f.leaf)
    nodes, leaves, up, own = [], [], leaf, f.place[leaf]
    while len(up):
        nodes.append(up)
        leaves.append(own)
        own, up = own[f.parent[up] >= 0], f.parent[up]
        up = up[up >= 0]
    nodes, leaves = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (nodes, leaves))
    order = np.lexsort((leaves, nodes))
    parts = np.split(leaves[order], np.cumsum(np.bincount(nodes, minlength=len(f.parent)))[:-1]) if len(f.parent) else []
    return pd.Series([parts[a:b] for a, b in zip(f.first, f.first[1:])])


@F.pandas_udf(T.IntegerType())
def split_cost(derived: pd.Series, ptree: pd.Series) -> pd.Series:
    """parsimony_cost() of a column of two symbols, of which the leaves in `derived` have one."""
    f = Forest(ptree)
    sets = np.where(f.leaf, 1, 0).astype(np.uint8)
    sets[np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) + start for x, start in zip(derived, f.first))])] = 2
    return pd.Series(_cost(f, sets))


def _cost(f: Forest, sets: np.ndarray) -> np.ndarray:
    """Changes that the sets of bases of the leaves need; those of inner nodes are set from below."""
    depth, cost = f.depth(), np.zeros(len(f.sizes), np.int64)
    shared, either = np.full(len(sets), 15, np.uint8), np.zeros(len(sets), np.uint8)
    for d in range(int(depth.max(initial=0)), 0, -1):
        nodes = np.flatnonzero(depth == d)
        np.bitwise_and.at(shared, f.parent[nodes], sets[nodes])
        np.bitwise_or.at(either, f.parent[nodes], sets[nodes])
        done = np.unique(f.parent[nodes])
        sets[done] = np.where(shared[done] > 0, shared[done], either[done])
        cost += np.bincount(f.tree[done[shared[done] == 0]], minlength=len(cost))
    return cost.astype(np.int32)


_PRUNED = T.StructType([T.StructField("ptree", T.ArrayType(T.IntegerType())), T.StructField("age", T.ArrayType(T.DoubleType())), T.StructField("nodes", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(_PRUNED)
def pruned(keep: pd.Series, ptree: pd.Series, age: pd.Series) -> pd.DataFrame:
    """The subtree of the leaves in `keep`, without nodes that keep one child; nodes keep their order, and `nodes` has their old numbers."""
    f = Forest(ptree, age)
    leaves = np.concatenate([np.zeros(0, np.int64), *(np.asarray(k, np.int64) + start for k, start in zip(keep, f.first))])
    count = f.below(np.unique(leaves))
    inner = np.flatnonzero((count > 0) & (f.parent >= 0))
    stays = np.where(f.leaf, count > 0, np.bincount(f.parent[inner], minlength=len(count)) > 1)
    up = f.parent.copy()
    while (go := (up >= 0) & ~stays[up]).any():
        up[go] = f.parent[up[go]]
    number = np.cumsum(stays) - 1
    number -= (np.concatenate(([0], np.cumsum(stays)))[f.first[:-1]])[f.tree]
    parents = np.where(up >= 0, number[up], -1)
    return pd.DataFrame({"ptree": f.lists(parents, stays), "age": f.lists(f.age, stays), "nodes": f.lists(f.place, stays)})


@F.pandas_udf(T.DoubleType())
def half_age(ptree: pd.Series, age: pd.Series) -> pd.Series:
    """Age of the node reached from the root by stepping, while a child has (nodes - 1) / 2 or more nodes below it and itself, to that child; of two such children to the younger. Trees are binary."""
    f = Forest(ptree, age)
    size = f.below(np.arange(len(f.parent)))
    half = (f.sizes - 1) / 2
    inner = np.flatnonzero(f.parent >= 0)
    large = inner[size[inner] >= half[f.tree[inner]]]
    # of the large children of a node the youngest, the first of several
    order = large[np.lexsort((large, f.age[large], f.parent[large]))]
    to = np.full(len(f.parent), -1)
    heads, at = np.unique(f.parent[order], return_index=True)
    to[heads] = order[at]
    node = np.flatnonzero(f.parent < 0)
    while (go := (size[node] != half) & (to[node] >= 0)).any():
        node = np.where(go, to[node], node)
    return pd.Series(f.age[node])


@F.pandas_udf(T.IntegerType())
def parsimony_cost(ptree: pd.Series, col: pd.Series) -> pd.Series:
    """The fewest changes of base along a binary tree that explain a column, one base a leaf; a symbol other than A C G T may be any base."""
    return pd.Series(Forest(ptree).parsimony_sets("".join(col))[1])


_STATES = T.StructType([T.StructField("bases", T.StringType()), T.StructField("mutated", T.ArrayType(T.IntegerType())), T.StructField("derived", T.ArrayType(T.StringType()))])
_LETTER = np.zeros(16, "U1")
_LETTER[list(BASES.values())] = list(BASES)


@F.pandas_udf(_STATES)
def ancestral_states(ptree: pd.Series, col: pd.Series) -> pd.DataFrame:
    """A base of every node that explains a column with the fewest changes, by Forest.parsimony_states(): bases, a letter a node; the nodes whose branch has a change; and the base each of these has below it. Unknown leaves take the base of the node above."""
    f = Forest(ptree)
    states = f.parsimony_states(f.parsimony_sets("".join(col))[0])
    changed = (f.parent >= 0) & (states != states[f.parent])
    letters = _LETTER[states]
    return pd.DataFrame({"bases": ["".join(x) for x in f.lists(letters)], "mutated": f.lists(f.place, changed), "derived": f.lists(letters.astype(object), changed)})


_CANONICAL = T.StructType([T.StructField("ptree", T.ArrayType(T.IntegerType())), T.StructField("age", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(_CANONICAL)
def canonical(ptree: pd.Series, age: pd.Series) -> pd.DataFrame:
    """The same tree with its joints numbered by leaves below them, then by the smallest of these: trees that differ in numbers alone become equal."""
    f = Forest(ptree, age)
    leaf = np.flatnonzero(f.leaf)
    count, least = f.below(leaf), np.full(len(f.parent), np.iinfo(np.int64).max)
    own, up = f.place[leaf], leaf
    while len(up):
        np.minimum.at(least, up, own)
        own, up = own[f.parent[up] >= 0], f.parent[up]
        up = up[up >= 0]
    order = np.lexsort((least, np.where(f.leaf, 0, count), f.tree))  # nested joints differ in count, apart ones in their smallest leaf
    number = np.empty(len(order), np.int64)
    number[order] = f.place  # places run through each tree in turn
    parents = np.where(f.parent >= 0, number[f.parent], -1)[order]
    return pd.DataFrame({"ptree": f.lists(parents), "age": f.lists(f.age[order])})


_REROOTED = T.StructType([T.StructField("ptree", T.ArrayType(T.IntegerType())), T.StructField("length", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(_REROOTED)
def rerooted(node: pd.Series, share: pd.Series, ptree: pd.Series, age: pd.Series) -> pd.DataFrame:
    """Parents and branch lengths of a binary tree with its root on the branch above `node`, a share of the branch from it. The root keeps its number; paths between leaves keep their lengths."""
    f = Forest(ptree, age)
    length = np.where(f.parent >= 0, f.age[f.parent] - f.age, 0.0)
    x = node.to_numpy(np.int64) + f.first[:-1]
    root = np.flatnonzero(f.parent < 0)
    parent, out = f.parent.copy(), length.copy()
    below = np.zeros(len(parent), np.int64)
    inner = np.flatnonzero(f.parent >= 0)
    np.add.at(below, f.parent[inner], inner)
    if (f.parent[x] < 0).any():
        raise ValueError("the root has no branch above it")
    # the cut branch: its upper end hangs from the new root, or the root's other child if that end was the root
    at, up, given = x, f.parent[x], share.to_numpy(float)
    parent[x], out[x] = root, given * length[x]
    rest = (1 - given) * length[x]
    first = np.ones(len(x), bool)
    while len(at):
        top = f.parent[up] < 0
        side = below[up] - at  # the other child of the root
        hang = np.where(top, side, up)
        parent[hang] = np.where(first, root[f.tree[at]], at)
        out[hang] = np.where(top, length[side], 0.0) + np.where(first, rest[f.tree[at]], length[at])
        at, up, first = up[~top], f.parent[up[~top]], np.zeros((~top).sum(), bool)
    local = np.where(parent >= 0, f.place[parent], -1)
    return pd.DataFrame({"ptree": f.lists(local), "length": f.lists(out)})


@F.pandas_udf(T.DoubleType())
def longest_path(ptree: pd.Series, length: pd.Series) -> pd.Series:
    """The longest path between two leaves, by branch lengths: at each joint the two deepest sides, level by level."""
    f = Forest(ptree, length)
    deep, longest, depth = np.zeros(len(f.parent)), np.zeros(len(f.sizes)), f.depth()
    for d in range(int(depth.max(initial=0)), 0, -1):
        nodes = np.flatnonzero(depth == d)
        reach = deep[nodes] + f.age[nodes]
        up = f.parent[nodes]
        order = np.lexsort((-reach, up))
        nodes, reach, up = nodes[order], reach[order], up[order]
        head = np.concatenate(([True], up[1:] != up[:-1])) if len(up) else np.zeros(0, bool)
        second = np.flatnonzero(head[:-1] & ~head[1:]) + 1
        np.maximum.at(longest, f.tree[up[second]], reach[second] + reach[second - 1])
        deep[up[head]] = reach[head]
    return pd.Series(longest)


#: Entries of the matrices of nodes by leaves that are worked on at once, those of one tree at least.
ENTRIES = 1 << 22


def _paths_of(f: Forest):
    """A function of trees of one size: (tree, pair), the branches between each two leaves: the ancestors of each, less those of both."""
    leaf = np.flatnonzero(f.leaf)
    nodes, leaves, up, own = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], leaf, f.place[leaf]
    while len(up):
        nodes.append(up)
        leaves.append(own)
        own, up = own[f.parent[up] >= 0], f.parent[up]
        up = up[up >= 0]
    nodes, leaves = np.concatenate(nodes), np.concatenate(leaves)
    order = np.argsort(f.tree[nodes], kind="stable")
    nodes, leaves = nodes[order], leaves[order]
    first = np.searchsorted(f.tree[nodes], np.arange(len(f.sizes) + 1))

    def paths(trees: np.ndarray) -> np.ndarray:
        size = int(f.sizes[trees[0]])
        count = first[trees + 1] - first[trees]
        at = np.repeat(first[trees], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        held = np.zeros((len(trees), size, (size + 1) // 2))
        held[np.repeat(np.arange(len(trees)), count), f.place[nodes[at]], leaves[at]] = 1
        both = held.transpose(0, 2, 1) @ held
        own = np.diagonal(both, axis1=1, axis2=2)
        one, two = np.triu_indices(own.shape[1], 1)
        return own[:, one] + own[:, two] - 2 * both[:, one, two]

    return paths


def correlations(f: Forest, other: Forest) -> np.ndarray:
    """path_correlation() of the trees of two forests, NaN for null: those of one size together."""
    out, one, two = np.full(len(f.sizes), np.nan), _paths_of(f), _paths_of(other)
    _, kind = np.unique(np.stack((f.sizes, other.sizes)), axis=1, return_inverse=True)
    kind = kind.ravel()
    order = np.argsort(kind, kind="stable")
    for alike in np.split(order, np.cumsum(np.bincount(kind))[:-1]) if len(order) else []:
        size = int(f.sizes[alike[0]])
        if size < 3:
            continue
        most = max(1, ENTRIES // (size * size))
        for start in range(0, len(alike), most):
            trees = alike[start : start + most]
            a, b = (x - x.mean(axis=1, keepdims=True) for x in (one(trees), two(trees)))
            spread = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
            out[trees] = np.where(spread > 0, (a * b).sum(axis=1) / np.where(spread > 0, spread, 1), np.nan)
    return out


@F.arrow_udf(T.DoubleType())
def path_correlation(ptree: pa.Array, other: pa.Array) -> pa.Array:
    """Correlation, over all pairs of leaves, of the numbers of branches between them in two trees of the same leaves; null where either does not vary. Called on pandas series it gives one, with None for null."""
    found = correlations(Forest(ptree), Forest(other))
    none = np.isnan(found)
    return pd.Series(np.where(none, None, found), dtype=object) if isinstance(ptree, pd.Series) else pa.array(found, mask=none)


_FAMILY = T.StructType([T.StructField("parent", T.ArrayType(T.IntegerType())), T.StructField("clades", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("conflict", T.ArrayType(T.IntegerType()))])


def tree_of_splits(rooted: bool = True):
    """A function of an array of splits, each an array of leaves, and the number of leaves: the one tree that has just these clades.

    struct(parent, clades, conflict): parents of the leaves, then of the clades
    in the order of `clades`, by size and then by leaves, all leaves last; -1
    above them. Splits may repeat; those of one leaf or all tell nothing.
    Unrooted splits are sides of a branch: the side without the last leaf is the
    clade. Where two splits neither nest nor are disjoint, `conflict` has the
    places of two such splits and the rest is null.
    """

    @F.pandas_udf(_FAMILY)
    def family(splits: pd.Series, leaves: pd.Series) -> pd.DataFrame:
        n = leaves.to_numpy(np.int64)
        counts = np.fromiter((len(s) for s in splits), np.int64, len(splits)) + 1
        row, words = np.repeat(np.arange(len(n)), counts), -(-int(n.max(initial=1)) // 64)
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        lists = [x for s, k in zip(splits, n) for x in (*s, np.arange(k))]
        flat = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in lists)])
        item = np.repeat(np.arange(len(lists)), np.fromiter(map(len, lists), np.int64, len(lists)))
        held = np.zeros((len(lists), 64 * words), bool)
        held[item, flat] = True
        if not rooted:
            turned = held[np.arange(len(lists)), n[row] - 1] & (place < counts[row] - 1)
            held[turned] = (np.arange(64 * words) < n[row[turned], None]) & ~held[turned]
        size = held.sum(axis=1)
        mask = np.packbits(held, axis=1, bitorder="little").view(np.uint64)
        told = (size > 1) & ((size < n[row]) | (place == counts[row] - 1))
        # one of each mask, in order of row, size, mask
        order = np.lexsort((*(mask[:, w] for w in range(words)), size, row))
        order = order[told[order]]
        same = np.zeros(len(order), bool)
        same[1:] = (mask[order[1:]] == mask[order[:-1]]).all(axis=1) & (row[order[1:]] == row[order[:-1]])
        order = order[~same]
        mask, size, row, place, held = mask[order], size[order], row[order], place[order], held[order]
        number = np.bincount(row, minlength=len(n))
        first = np.cumsum(number) - number
        # each clade with the later ones of its row
        later = first[row] + number[row] - 1 - np.arange(len(row))
        a = np.repeat(np.arange(len(row)), later)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
        both = mask[a] & mask[b]
        inside, apart = (both == mask[a]).all(axis=1), ~both.any(axis=1)
        up = np.full(len(row), -1)
        nested = np.flatnonzero(inside)[::-1]
        up[a[nested]] = b[nested]  # the first that holds it is written last
        wrong = np.flatnonzero(~inside & ~apart)[::-1]
        conflict: list = [None] * len(n)
        for i in wrong.tolist():
            conflict[row[a[i]]] = [int(place[a[i]]), int(place[b[i]])]
        parents, clades = [None] * len(n), [None] * len(n)
        clade, leaf = np.nonzero(held)
        smallest = np.full((len(n), int(n.max(initial=0))), -1)
        smallest[row[clade[::-1]], leaf[::-1]] = clade[::-1]
        own = np.split(leaf, np.cumsum(np.bincount(clade, minlength=len(row)))[:-1]) if len(row) else []
        for i, (start, k) in enumerate(zip(first.tolist(), number.tolist())):
            if conflict[i] is None:
                at = np.concatenate((smallest[i, : n[i]], up[start : start + k]))
                parents[i] = np.where(at < 0, -1, at - start + n[i])
                clades[i] = own[start : start + k]
        return pd.DataFrame({"parent": parents, "clades": clades, "conflict": conflict})

    return family


_ORDERS = T.StructType([T.StructField("preorder", T.ArrayType(T.IntegerType())), T.StructField("inorder", T.ArrayType(T.IntegerType())), T.StructField("postorder", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(_ORDERS)
def node_orders(ptree: pd.Series) -> pd.DataFrame:
    """The nodes of each binary tree in three orders, a node's first child having the smaller number."""
    rows = []
    for parents in ptree:
        children: dict[int, list[int]] = {}
        for x, up in enumerate(parents):
            children.setdefault(up, []).append(x)
        before, between, behind, todo = [], [], [], [(children[-1][0], 0)]
        while todo:
            x, step = todo.pop()
            own = children.get(x, [])
            if step == 0:
                before.append(x)
            if step == (1 if own else 0):
                between.append(x)
            if step == len(own):
                behind.append(x)
            else:
                todo += [(x, step + 1), (own[step], 0)]
        rows.append((before, between, behind))
    return pd.DataFrame(rows, columns=["preorder", "inorder", "postorder"])


def prune(keep: Column, ptree="ptree", age="age") -> Column:
    return pruned(keep, F.col(ptree) if isinstance(ptree, str) else ptree, F.col(age) if isinstance(age, str) else age)


def lineages(grid: list[float]):
    """A function of ptree and age: Forest.branches() and Forest.points() on a grid."""

    @F.pandas_udf(T.StructType([T.StructField("branches", T.ArrayType(T.IntegerType())), T.StructField("points", T.ArrayType(T.IntegerType()))]))
    def counted(ptree: pd.Series, age: pd.Series) -> pd.DataFrame:
        f = Forest(ptree, age)
        return pd.DataFrame({"branches": list(f.branches(grid)), "points": list(f.points(grid))})

    return counted


def inner_branches(grid: list[float]):
    """A function of ptree and age: array of the branches that span each grid interval, that above the root left out."""
    times = np.array(grid)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def counted(ptree: pd.Series, age: pd.Series) -> pd.Series:
        f = Forest(ptree, age)
        near = np.abs(f.age[:, None] - times[None, :]).argmin(axis=1)
        inner = np.flatnonzero(f.parent >= 0)
        edge = np.zeros((len(f.sizes), len(grid)), np.int64)
        np.add.at(edge, (f.tree[inner], near[inner]), 1)
        np.add.at(edge, (f.tree[inner], near[f.parent[inner]]), -1)
        return pd.Series(list(np.cumsum(edge, axis=1)[:, :-1]))

    return counted
