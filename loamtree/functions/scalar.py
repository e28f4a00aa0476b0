"""Scalar and list functions as Spark expressions."""

import math

from pyspark.sql import Column, functions as F


def rank_quantile(values: Column, q: float) -> Column:
    """The q-quantile of an array by rank: with n sorted values, the value at int(q * n), at most the last.

    Where q * n is a whole number up to 1e-5 of n and not 0, the mean of that
    value and the one before it. An empty array gives null. `values` is sorted
    here, so it may come from collect_list; a group has one value per sample.
    """
    ordered = F.array_sort(values)
    n = F.size(ordered)
    at = F.least(F.floor(F.lit(q) * n).cast("int"), n - 1)
    upper = F.get(ordered, at)
    between = (at > 0) & (F.abs(F.lit(q) - at / n) < 1e-5)
    return F.when(n > 0, F.when(between, (upper + F.get(ordered, at - 1)) / 2).otherwise(upper))


def time_grid(n: int, top: float, delta: float = 0.01) -> list[float]:
    """n times from 0 to `top`, spaced evenly in log(1 + delta * t)."""
    scale = math.log(1 + delta * top) / (n - 1)
    return [(math.exp(i * scale) - 1) / delta for i in range(n)]


def grid_up_to(top: Column, n: int, delta: float = 0.01) -> Column:
    """time_grid() as an array, up to the `top` of each row."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.exp(i * F.log(1 + delta * top) / (n - 1)) - 1) / delta)


def steps_of(times: Column) -> Column:
    """Of an array of times, for each interval: its length (step), the lengths to and from its geometric middle (lower_half, upper_half), and the time of the even grid with as many times (linear)."""
    last = F.element_at(times, -1)

    def interval(a, i):
        b = F.get(times, i + 1)
        middle = F.sqrt((a + 1) * (b + 1))
        return F.struct((b - a).alias("step"), (middle - a).alias("lower_half"), (b - middle).alias("upper_half"), (i * last / (F.size(times) - 1)).alias("linear"))

    return F.transform(F.slice(times, F.lit(1), F.size(times) - 1), interval)


def nearest_time(age: Column, grid: list[float]) -> Column:
    """Index of the ascending grid's time nearest to `age`; of two equally near the earlier. A search over the midpoints: as many comparisons as halvings."""

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        cut = (lo + hi) // 2
        return F.when(F.abs(age - grid[cut]) <= F.abs(age - grid[cut + 1]), between(lo, cut)).otherwise(between(cut + 1, hi))

    return F.when(age.isNotNull(), between(0, len(grid) - 1))


def linear_grid(n: int, top: float) -> list[float]:
    """n times from 0 to `top`, evenly spaced."""
    return [i * top / (n - 1) for i in range(n)]


def time_steps(grid: list[float]) -> list[float]:
    """The length of each interval between neighbouring times."""
    return [b - a for a, b in zip(grid, grid[1:])]


def half_steps(grid: list[float]) -> list[float]:
    """The lengths in turn from each time to the geometric middle of its interval, sqrt((a + 1) * (b + 1)), and on to the next time."""
    middles = [math.sqrt((a + 1) * (b + 1)) for a, b in zip(grid, grid[1:])]
    return [x for a, m, b in zip(grid, middles, grid[1:]) for x in (m - a, b - m)]


def population_sizes(sizes: float | list[float], grid: list[float]) -> list[float]:
    """One size a grid time, from one for all or from a list that must have as many."""
    sizes = [float(sizes)] * len(grid) if isinstance(sizes, (int, float)) else [float(x) for x in sizes]
    if len(sizes) != len(grid):
        raise ValueError(f"{len(sizes)} sizes for {len(grid)} times")
    return sizes


def round_time(age: Column, grid: list[float], how: str = "closer") -> Column:
    """Index of a grid time for `age`: the nearest, the first at or above it ("up"; the last time beyond the grid), or the last at or below it ("down")."""
    if how == "closer":
        return nearest_time(age, grid)

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        if how == "up":
            cut = (lo + hi) // 2
            return F.when(age <= grid[cut], between(lo, cut)).otherwise(between(cut + 1, hi))
        cut = (lo + hi + 1) // 2
        return F.when(age >= grid[cut], between(cut, hi)).otherwise(between(lo, cut - 1))

    return F.when(age.isNotNull(), between(0, len(grid) - 1))


def snapped_time(age: Column, grid: list[float], tolerance: float = 1.0) -> Column:
    """Index of the grid time nearest to `age`; null where that is farther than `tolerance`."""
    times = F.array(*[F.lit(t) for t in grid])
    at = nearest_time(age, grid)
    return F.when(F.abs(F.get(times, at) - age) <= tolerance, at)


def log_sum_exp(values: Column) -> Column:
    """log(sum(exp(x))) of an array, from its largest value down, so that nothing overflows. An empty array gives null."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def or_na(value: Column, form: str) -> Column:
    """A number as text, NA where there is none."""
    return F.when(value.isNull(), F.lit("NA")).otherwise(F.format_string(form, value))
