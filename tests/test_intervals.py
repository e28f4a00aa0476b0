"""Joins of intervals of very different lengths, in bins of several levels, against all pairs."""

import random

import pytest

from pyspark.sql import functions as F

from loamtree.operators import intervals as iv, ordered, sites as st


@pytest.fixture(scope="module", params=[iv.Bins(4), iv.Bins(2, 4), iv.Bins(16, 2)])
def bins(request):
    return request.param


def some(seed, n):
    rng = random.Random(seed)
    return [(i, rng.choice("xy"), a := rng.randrange(3000), a + rng.choice([1, 2, 5, 17, 130, 900, 5000])) for i in range(n)]


def frame(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, chrom string, start long, stop long")


def test_points(spark, bins):
    rows, points = some(1, 80), [(i, random.Random(i).choice("xy"), random.Random(-i).randrange(4000)) for i in range(60)]
    asked = spark.createDataFrame(points, "point long, chrom string, pos long")
    for closed, holds in (("left", lambda p, a, z: a <= p < z), ("right", lambda p, a, z: a < p <= z)):
        found = iv.join_points(asked, frame(spark, rows, "id"), bins, closed=closed).collect()
        assert sorted((r.point, r.id) for r in found) == sorted((p, i) for p, c, x in points for i, d, a, z in rows if c == d and holds(x, a, z))


def test_pairs(spark, bins):
    one, two = some(2, 60), some(3, 60)
    found = iv.join_intervals(frame(spark, one, "id"), frame(spark, two, "id"), bins).collect()
    want = [(i, j, max(a, b), min(y, z)) for i, c, a, y in one for j, d, b, z in two if c == d and max(a, b) < min(y, z)]
    assert sorted((r.a_id, r.b_id, r.start, r.stop) for r in found) == sorted(want)


def test_segments(spark, bins):
    rows = some(4, 50)
    found = iv.intersect_samples(frame(spark, rows, "id"), bins).collect()
    want = []
    for c in "xy":
        ends = sorted({p for _, d, *ends in rows if d == c for p in ends})
        want += [(c, a, z, i) for a, z in zip(ends, ends[1:]) for i, d, b, y in rows if d == c and b <= a and y >= z]
    assert sorted((r.chrom, r.start, r.stop, r.id) for r in found) == sorted(want)


def test_long_intervals_stay_few_rows(spark):
    rows = [(i, "x", 10 * i, 10 * i + 9) for i in range(50)] + [(99, "x", 0, 10**8)]
    chosen = iv.choose_bin_width(frame(spark, rows, "id"))
    assert chosen.width == 32 and chosen.levels > 5
    assert iv.with_bins(frame(spark, rows, "id"), chosen).filter("id = 99").count() <= 9


def test_left_joins_and_masks_with_a_very_long_interval(spark):
    """One interval of 10^8 bases beside short ones: no side of a left join or of a mask grows by more than a few rows."""
    rng = random.Random(21)
    rows = [("1", 100 * i, 100 * i + rng.randint(1, 90)) for i in range(300)] + [("2", 0, 10**8)]
    spans = spark.createDataFrame(rows, "chrom string, start long, stop long")
    asked = [("1", rng.randrange(30_000)) for _ in range(400)] + [("2", rng.randrange(2 * 10**8)) for _ in range(20)] + [("3", 5), ("1", rows[0][1])]
    points = spark.createDataFrame(asked, "chrom string, pos long")
    bins = iv.choose_bin_width(spans)
    assert iv.with_bins(spans, bins).count() <= len(rows) + 400
    found = sorted((r.chrom, r.pos, r.start if r.start is not None else -1) for r in iv.join_points(points, spans, bins, how="left").collect())
    holds = lambda c, p: [s for k, s, e in rows if k == c and s <= p < e] or [-1]
    assert found == sorted((c, p, s) for c, p in asked for s in holds(c, p))
    sites = spark.createDataFrame([(c, p, "AC") for c, p in sorted(set(asked))], "chrom string, pos long, col string")
    masked = {(r.chrom, r.pos): r.col for r in st.apply_mask(sites, spans).collect()}
    assert masked == {(c, p): "NN" if holds(c, p) != [-1] else "AC" for c, p in set(asked)}


def test_neighbours_in_small_tiles(spark):
    """Previous rows, islands and order numbers are the same whatever the tile."""
    rng = random.Random(22)
    rows = sorted({(k, rng.randrange(400)): rng.choice("ab") for k in ("x", "y") for _ in range(60)}.items())
    frame = spark.createDataFrame([(k, p, p + 2, v) for (k, p), v in rows], "key string, start long, stop long, kind string")
    want_pairs, want_islands = [], []
    for i, ((k, p), v) in enumerate(rows):
        first = i == 0 or rows[i - 1][0][0] != k
        before = None if first else rows[i - 1][0][1]
        want_pairs.append((k, p, before if before is not None else -1))
        if not first and rows[i - 1][1] == v:
            want_islands[-1][2:] = [p + 2, want_islands[-1][3] + 1]
        else:
            want_islands.append([k, p, p + 2, 1])
    for width in (3, 50, 1 << 16):
        pairs = ordered.adjacent_pairs(frame, ["key"], ["start"], ["start"], width)
        assert sorted((r.key, r.start, r.prev_start if r.prev_start is not None else -1) for r in pairs.collect()) == want_pairs
        islands = ordered.merge_islands(frame, ["key"], ["start"], ["kind"], width=width)
        assert sorted([r.key, r.start, r.stop, r.n_rows] for r in islands.collect()) == want_islands
        trees = frame.select(F.lit(0).alias("sample"), F.col("key").alias("chrom"), "start")
        both = ordered.interleave(trees, trees.withColumnRenamed("start", "pos"), width).orderBy("chrom", "place").collect()
        assert [(r.chrom, r.at, r.kind, r.place) for r in both] == [(k, p, kind, 2 * i + kind + 1) for key in ("x", "y") for i, (k, p) in enumerate([r for r, _ in rows if r[0] == key]) for kind in (0, 1)]
