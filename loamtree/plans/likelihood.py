"""Likelihoods of sites on trees: every (tree, sites) row is scored where it is, and the results are summed."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.forest import BASES, BITS, Forest
from ..operators.intervals import Bins, choose_bin_width, join_points

#: By symbol the four bases it may be.
_MAY = (BITS[:, None] & np.array(list(BASES.values()), np.uint8) > 0).astype(float)


def through(part: np.ndarray, length: np.ndarray, mu: float) -> np.ndarray:
    """Likelihoods (item, base) at one end of branches from those at the other: each base changes to each other one alike, at rate mu a generation in all."""
    kept = np.exp(-4 / 3 * mu * length)[:, None]
    return kept * part + (1 - kept) / 4 * part.sum(axis=1, keepdims=True)


class SiteMessages:
    """Likelihoods of columns below and above the nodes of a forest, for all its trees and columns at once, one step a level.

    `inner` has a row for each node and column of its tree, the columns of a
    node together: the likelihood of what is below, given the node's base.
    `columns` is how many a tree has; `symbols` the bases of each tree's
    columns, a base a leaf, column after column. Branches count as min_length at least.
    """

    def __init__(self, forest: Forest, columns: np.ndarray, symbols: str, mu: float, min_length: float = 1.0):
        self.forest, self.mu, f = forest, mu, forest
        self.width = columns[f.tree]
        self.start = np.concatenate(([0], np.cumsum(self.width)))
        self.node = np.repeat(np.arange(len(self.width)), self.width)
        column = np.arange(len(self.node)) - self.start[self.node]
        self.up = np.where(f.parent[self.node] >= 0, self.start[f.parent[self.node]] + column, -1)
        self.length = np.maximum(np.where(f.parent >= 0, f.age[f.parent] - f.age, 0), min_length)[self.node]
        self.inner = np.ones((len(self.node), 4))
        leaves = (f.sizes + 1) // 2
        first = np.concatenate(([0], np.cumsum(leaves * columns)))
        at_leaf = np.flatnonzero(f.leaf[self.node])
        x = self.node[at_leaf]
        self.inner[at_leaf] = self.bases(symbols)[first[f.tree[x]] + column[at_leaf] * leaves[f.tree[x]] + f.place[x]]
        depth = f.depth()[self.node]
        # a stable sort has the nodes of a level, and the items of a node, together
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(order) else []
        self.sent = np.ones_like(self.inner)
        for items in self.levels[:0:-1]:
            self.sent[items] = through(self.inner[items], self.length[items], mu)
            np.multiply.at(self.inner, self.up[items], self.sent[items])

    @staticmethod
    def bits(symbols: str) -> np.ndarray:
        return BITS[np.frombuffer(symbols.encode("ascii", "replace"), np.uint8) & 127]

    @classmethod
    def bases(cls, symbols: str) -> np.ndarray:
        return _MAY[np.frombuffer(symbols.encode("ascii", "replace"), np.uint8) & 127]

    def outer(self) -> np.ndarray:
        """Rows as in `inner`: the likelihood of all that is not below a node, given the base at the upper end of its branch; 1 at a root."""
        below = np.zeros(len(self.inner), np.int64)
        inside = np.flatnonzero(self.up >= 0)
        np.add.at(below, self.up[inside], inside)
        out, came = np.ones_like(self.inner), np.ones_like(self.inner)
        for items in self.levels[1:]:
            other = below[self.up[items]] - items
            out[items] = came[self.up[items]] * self.sent[other]
            came[items] = through(out[items], self.length[items], self.mu)
        return out

    def likelihood(self) -> np.ndarray:
        """Of every tree's columns, tree after tree; the root's bases are equally likely."""
        return self.inner[self.up < 0].mean(axis=1)


def tree_log_likelihood(trees: DataFrame, sites: DataFrame, mu: float, width: int | Bins | None = None, min_length: float = 1.0) -> DataFrame:
    """sample, log_likelihood of all sites under each sample's trees (sample, chrom, start, stop, ptree, age); bases without a site are invariant A.

    Columns go to their trees in parts of 256, so no row holds all sites of a long block.
    """

    @F.pandas_udf("double")
    def score(ptree: pd.Series, age: pd.Series, cols: pd.Series, bases: pd.Series) -> pd.Series:
        lists = [[] if c is None else list(c) for c in cols]
        flat = ["A" * ((len(p) + 1) // 2) for p in ptree]
        counts = np.array([len(x) + 1 for x in lists], np.int64)
        found = np.log(SiteMessages(Forest(ptree, age), counts, "".join("".join(x) + a for x, a in zip(lists, flat)), mu, min_length).likelihood())
        ends = np.cumsum(counts)
        own = np.add.reduceat(found, ends - counts) - found[ends - 1] if len(ends) else found
        return pd.Series(own + found[ends - 1] * bases.to_numpy(float))

    blocks = trees.withColumn("block", F.struct("sample", "chrom", "start"))
    spans = blocks.select("chrom", "start", "stop", "block")
    placed = join_points(sites.select("chrom", "pos", "col"), spans, width or choose_bin_width(spans))
    held = placed.groupBy("block", F.pmod(F.xxhash64("pos"), F.greatest(F.ceil((F.col("stop") - F.col("start")) / 256), F.lit(1))).alias("part")).agg(F.collect_list("col").alias("cols"))
    parts = held.select("block", "cols", (-F.size("cols")).cast("long").alias("bases"))
    whole = blocks.select("block", F.array().cast("array<string>").alias("cols"), (F.col("stop") - F.col("start")).cast("long").alias("bases"))
    scored = blocks.join(parts.unionByName(whole), "block").withColumn("ll", score("ptree", "age", "cols", "bases"))
    return scored.groupBy("sample").agg(F.sum("ll").alias("log_likelihood"))
