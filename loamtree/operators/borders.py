"""Two trees of the same leaves whose joints have other numbers, for many pairs at once: whether they are the same, the one edit that makes one into the other, and which nodes stay."""

import numpy as np

from .graphs import matches
from .spr import kids_of, moved


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64 bits of each number."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Side:
    """The nodes of one tree of each pair, one tree behind the other; binary trees, leaves first."""

    def __init__(self, p: np.ndarray, age: np.ndarray, size: np.ndarray):
        self.size, self.first = size, np.cumsum(size) - size
        self.tree = np.repeat(np.arange(len(size)), size)
        self.place = np.arange(len(p)) - self.first[self.tree]
        self.local, self.up = p, np.where(p < 0, -1, p + self.first[self.tree])
        self.age, self.leaf = age + 0.0, self.place < ((size + 1) // 2)[self.tree]
        depth, up = np.zeros(len(p), np.int64), self.up
        while (go := up >= 0).any():
            depth += go
            up = np.where(go, self.up[up], -1)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])[:0:-1] if len(p) else []

    def upward(self, values: np.ndarray, by=np.add) -> np.ndarray:
        """Of each node its value with those of all below it."""
        out = values.copy()
        for nodes in self.levels:
            by.at(out, self.up[nodes], out[nodes])
        return out

    def clades(self, words: int) -> list[np.ndarray]:
        """The leaves below each node, 64 bits a word."""
        bit = np.uint64(1) << (self.place % 64).astype(np.uint64)
        return [self.upward(np.where(self.leaf & (self.place // 64 == w), bit, np.uint64(0))).view(np.int64) for w in range(words)]

    def hashed(self) -> None:
        """Hashes of clades, which are sums over leaves, and of nodes (clade and age), and sums of the latter over all below a node."""
        self.clade = self.upward(np.where(self.leaf, _mixed(self.place), np.uint64(0)))
        self.old = _mixed(self.age.view(np.uint64))
        self.node = _mixed(self.clade ^ self.old)
        self.below = self.upward(self.node)
        self.total = self.below[self.up < 0]

    def without(self, x: np.ndarray) -> np.ndarray:
        """Of each tree the sum of its nodes' hashes without the branch x: those below and the joint go, those above have fewer leaves."""
        joint = self.up[x]
        out = self.total[self.tree[x]] - self.below[x] - self.node[joint]
        at, k = self.up[joint], np.arange(len(x))
        while len(k := k[at >= 0]):
            at = at[at >= 0]
            out[k] += _mixed((self.clade[at] - self.clade[x[k]]) ^ self.old[at]) - self.node[at]
            at = self.up[at]
        return out


def edits_between(p, age, q, other_age, size, slow) -> tuple[np.ndarray, ...]:
    """For pairs of trees, flat arrays of parents and ages with `size` nodes in both of a pair: same, recomb_node, coal_node, coal_time, and of each node of the first tree its number in the second, -1 if it is gone.

    Of several edits that would do, the first by the smallest leaf below the cut
    branch, then by size. Candidates are told by hashes; the edited trees are
    compared with the second ones clade by clade, and a pair that fails this
    goes to `slow`, a function of one pair that gives the same or raises.
    """
    one, two = _Side(p, age, size), _Side(q, other_age, size)
    n, words = len(size), -(-int(((size + 1) // 2).max(initial=1)) // 64)
    clades, others = one.clades(words), two.clades(words)
    y = matches((two.tree, *others), (one.tree, *clades))
    good = (y >= 0) & (one.age == two.age[y])
    same = np.bincount(one.tree[~good], minlength=n) == 0
    x, coal, time, mapping = np.full(n, -1), np.full(n, -1), np.full(n, np.nan), two.place[y]
    if same.all():
        return same, x, coal, time, mapping
    one.hashed()
    two.hashed()
    whole = one.upward((~good).astype(np.int64)) == 0
    cut = np.flatnonzero(whole & ~same[one.tree] & (one.up >= 0) & (two.up[y] >= 0))
    cut = cut[one.without(cut) == two.without(y[cut])]
    least = one.upward(np.where(one.leaf, one.place, np.iinfo(np.int64).max), np.minimum)
    cut = cut[np.lexsort((one.upward(one.leaf.astype(np.int64))[cut], least[cut], one.tree[cut]))]
    pair, at = np.unique(one.tree[cut], return_index=True)
    cut = cut[at]
    kids, joint, made = kids_of(p, size), one.up[cut], two.up[y[cut]]
    first = one.first[pair]
    sibling, beside = first + kids[joint] - one.place[cut], first + kids_of(q, size)[made] - two.place[y[cut]]
    back = np.full(len(p), -1)
    back[y[y >= 0]] = np.flatnonzero(y >= 0)
    to = np.where(y[sibling] == beside, np.where(two.age[made] > one.age[joint], joint, sibling), back[beside])
    # a branch that had the cut one below it
    open_ = np.flatnonzero(to < 0)
    above = one.up[joint[open_]]
    while len(open_ := open_[above >= 0]):
        above = above[above >= 0]
        held = np.ones(len(open_), bool)
        for mine, theirs in zip(clades, others):
            held &= (mine[above] & ~mine[cut[open_]]) == theirs[beside[open_]]
        to[open_[held]] = above[held]
        open_, above = open_[~held], one.up[above[~held]]
    told = to >= 0
    pair, cut, to, joint, made, first = (v[told] for v in (pair, cut, to, joint, made, first))
    edited, ages = p.copy(), age.copy()
    moved(edited, kids, first, one.place[cut], to - first, size[pair])
    ages[joint] = two.age[made]
    behind = _Side(edited, ages, size)
    z = matches((two.tree, *others), (behind.tree, *behind.clades(words)))
    wrong = np.bincount(behind.tree[(z < 0) | (behind.age != two.age[z])], minlength=n) > 0
    x[pair], coal[pair], time[pair] = one.place[cut], to - first, two.age[made]
    changed = ~same[one.tree]
    mapping = np.where(changed, two.place[z], mapping)
    mapping[joint] = -1
    for i in np.flatnonzero(~same & (wrong | (x < 0))).tolist():
        own = slice(one.first[i], one.first[i] + size[i])
        x[i], coal[i], time[i], mapping[own] = slow(*(v[own].tolist() for v in (p, age, q, other_age)))
    return same, x, coal, time, mapping
