"""Probabilities of trees and edits under the coalescent on a time grid. Each row is scored by itself and the results are summed."""

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.scalar import half_steps, nearest_time, time_steps
from ..operators.forest import Forest
from ..operators.trees import tmrca


@lru_cache(1 << 16)
def coalescent_probability(a: int, b: int, t: float, n: float) -> float:
    """That a lineages have b ancestors a time t ago, of a pair joining at rate 1 / n: a sum of exponentials over k = b .. a with the terms' products in log space, signs apart."""
    if b > a or b < 1:
        return 0.0
    terms = []
    for k in range(b, a + 1):
        log_term = -k * (k - 1) * t / 2 / n + math.log(2 * k - 1) - math.lgamma(b + 1) - math.lgamma(k - b + 1)
        log_term += math.lgamma(b + k - 1) - math.lgamma(b) + math.lgamma(a + 1) - math.lgamma(a - k + 1) + math.lgamma(a) - math.lgamma(a + k)
        terms.append((-1) ** (k - b) * math.exp(log_term))
    return min(1.0, max(0.0, math.fsum(terms)))


def merged_intervals(grid: list[float], sizes: list[float]) -> tuple[list[float], list[float]]:
    """Length and size of the interval around each grid time but the last: its half steps on both sides, sizes as harmonic means."""
    halves = half_steps(grid)
    spans, means = [halves[0]], [sizes[0]]
    for i in range(1, len(grid) - 1):
        below, above = halves[2 * i - 1], halves[2 * i]
        spans.append(below + above)
        means.append((below + above) / (below / sizes[i - 1] + above / sizes[i]))
    return spans, means


def tree_log_prior(trees: DataFrame, grid: list[float], sizes: list[float]) -> DataFrame:
    """trees with log_prior: over the grid times, that the lineages that enter an interval become those that leave it. A floor of 1e-200 stands for what underflows."""
    spans, means = merged_intervals(grid, sizes)

    @F.pandas_udf(T.DoubleType())
    def score(ptree: pd.Series, age: pd.Series) -> pd.Series:
        trees = Forest(ptree, age)
        chains = np.concatenate(((trees.sizes[:, None] + 1) // 2, trees.branches(grid)[:, : len(spans)]), axis=1).tolist()
        known = list(zip(spans, means))
        return pd.Series([sum(math.log(max(coalescent_probability(a, b, t, 2 * size), 1e-200)) for a, b, (t, size) in zip(c, c[1:], known)) for c in chains], dtype=float)

    return trees.withColumn("log_prior", score("ptree", "age"))


def edit_log_prior(edits: DataFrame, grid: list[float], sizes: list[float]) -> DataFrame:
    """edits with log_prior of each subtree edit of a tree.

    edits: ptree, age, recomb_time and coal_time as grid indices, broken_time,
    that of the cut branch's upper end. The cut falls anywhere on the tree by
    length, the stub above the root included; the cut lineage then joins any
    branch at a rate of the lineages left over twice the size.
    """
    steps, halves = time_steps(grid), np.array(half_steps(grid))
    double_sizes = 2 * np.repeat(np.array(sizes)[: len(steps)], 2)

    @F.pandas_udf(T.DoubleType())
    def score(ptree: pd.Series, age: pd.Series, cut: pd.Series, joined: pd.Series, broken: pd.Series) -> pd.Series:
        f, out = Forest(ptree, age), []
        tops = f.spans(grid)[0][f.parent < 0]
        for lines, places, total, top, k, j, above in zip(f.branches(grid), f.points(grid), f.length(grid), tops, cut, joined, broken):
            left = np.repeat(lines[: len(steps)] - (np.arange(len(steps)) < above), 2)
            rates = halves * left / double_sizes
            log_p = math.log(lines[k] * steps[k] / ((places[k] - (k == top)) * (total + steps[top])))
            log_p -= math.log(places[j] - (j <= above) - (j == above))
            if j < len(grid) - 2:
                log_p += math.log(-math.expm1(-rates[2 * j] - (rates[2 * j - 1] if j > k else 0.0)))
            out.append(log_p - rates[2 * k : max(2 * k, 2 * j - 1)].sum())
        return pd.Series(out, dtype=float)

    return edits.withColumn("log_prior", score("ptree", "age", "recomb_time", "coal_time", "broken_time"))


def tree_length_on(grid: list[float], ptree="ptree", age="age"):
    """Tree length with every node at its grid time."""

    @F.pandas_udf(T.DoubleType())
    def length(ptree: pd.Series, age: pd.Series) -> pd.Series:
        return pd.Series(Forest(ptree, age).length(grid))

    return length(ptree, age)


def arg_log_prior(blocks: DataFrame, grid: list[float], sizes: list[float], rho: float) -> DataFrame:
    """sample, log_prior: of each sample's blocks (sample, start, stop, ptree, age, and recomb_time, coal_time, broken_time of the edit behind it, null for the last block). The first tree's own prior is not in it."""
    scored = edit_log_prior(blocks.filter("recomb_time IS NOT NULL"), grid, sizes).select("sample", "start", "log_prior")
    rate = F.greatest(rho * tree_length_on(grid), F.lit(rho))
    spans = blocks.select("sample", "start", (F.when(F.col("recomb_time").isNotNull(), F.log(rate)).otherwise(0.0) - rate * (F.col("stop") - F.col("start"))).alias("span"))
    both = spans.join(scored, ["sample", "start"], "left")
    return both.groupBy("sample").agg(F.sum(F.col("span") + F.coalesce("log_prior", F.lit(0.0))).alias("log_prior"))


def joint_log_probability(log_likelihood: DataFrame, log_prior: DataFrame) -> DataFrame:
    """sample, log_joint of both."""
    return log_likelihood.join(log_prior, "sample").select("sample", (F.col("log_likelihood") + F.col("log_prior")).alias("log_joint"))


def example_edits(trees: DataFrame, grid: list[float]) -> DataFrame:
    """Trees with an edit each: leaf 0 is cut at the grid time below that of its parent, or there, and joined one time above the root, below the last but one."""
    at = lambda x: F.least(nearest_time(x, grid), F.lit(len(grid) - 2))
    broken = at(F.get("age", F.get("ptree", F.lit(0))))
    coal = F.least(at(tmrca()) + 1, F.lit(len(grid) - 2))
    return trees.withColumns({"broken_time": broken, "recomb_time": F.greatest(broken - 1, F.lit(0)), "coal_time": coal})
