"""Queries over small tables of their own, compared with plain Python on all rows."""

import math
import random
from itertools import combinations, product

import pytest

from loamtree.operators import ordered, sites as st
from loamtree.queries import QUERIES
from loamtree.tables import tracks


@pytest.fixture(scope="module")
def lines_dir(spark, tmp_path_factory):
    """Orders of one to seven lines; some pairs conflict only from the fifth sequence on, some have three sequences."""
    columns = {1: "AAAAARR", 2: "AAAARAR", 3: "AR", 4: "ARN", 5: "RAA", 6: "AAAARR", 8: "AAAARA", 9: "RNRNRN", 12: "A", 13: "AAAAARR", 30: "NNRRA", 33: "NRNRA", 90: "ANRRA", 91: "RANNA"}
    rows = [(k, i + 1, c, float((7 * k + 5 * i) % 11 + 1)) for k, col in columns.items() for i, c in enumerate(col)]
    home = str(tmp_path_factory.mktemp("lines"))
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double").write.parquet(f"{home}/lineitem.parquet")
    return home, columns


def minor(col):
    rarest = min(set(col), key=lambda x: (col.count(x), x))
    return {i for i, x in enumerate(col) if x == rarest}


def conflicts(columns):
    found = []
    for a, b in combinations(sorted(columns), 2):
        n = min(len(columns[a]), len(columns[b]))
        s, t = minor(columns[a][:n]), minor(columns[b][:n])
        if b - a <= 40 and s & t and s - t and t - s:
            found.append((a, b))
    return found


def test_conflicts_of_whole_columns(spark, lines_dir):
    home, columns = lines_dir
    want = conflicts(columns)
    assert (1, 2) in want
    assert sorted((r.a_pos, r.b_pos) for r in QUERIES["split_conflicts"](spark, home).collect()) == want
    last, breaks = None, []
    for a, b in sorted(want, key=lambda x: x[1]):
        if last is None or a >= last:
            breaks.append(last := b)
    assert sorted(r.pos for r in QUERIES["break_points"](spark, home).collect()) == breaks


def test_linkage_of_whole_columns(spark, lines_dir):
    home, columns = lines_dir
    found = {(r.a_pos, r.b_pos): r.d for r in QUERIES["ld_pairs"](spark, home).collect()}
    assert set(found) == {(a, b) for a, b in combinations(sorted(columns), 2) if b - a <= 40}
    for (a, b), d in found.items():
        n = min(len(columns[a]), len(columns[b]))
        x, y = ([c != col[0] for c in col[:n]] for col in (columns[a], columns[b]))
        assert d == pytest.approx(sum(p and q for p, q in zip(x, y)) / n - sum(x) * sum(y) / n**2, abs=1e-6)


def ladders(columns):
    """start: parents and ages of each order's tree."""
    found = {}
    for k, col in columns.items():
        q, n = sorted(float((7 * k + 5 * i) % 11 + 1) for i in range(len(col))), len(col)
        if n > 1:
            parents = [n, *range(n, 2 * n - 1), *range(n + 1, 2 * n - 1), -1]
            found[k * 10] = parents, [0.0] * n + [sum(q[: j + 2]) for j in range(n - 1)]
    return found


def test_prune_all_trees(spark, lines_dir):
    home, columns = lines_dir
    got = {r.start: (list(r.ptree), list(r.age)) for r in QUERIES["pruned_trees"](spark, home).collect()}
    assert got == {start: ([2, 2, -1], [0.0, 0.0, age[-1]]) for start, (_, age) in ladders(columns).items()}


def nested(parents, age):
    """Leaves and age of every inner node, whatever its number."""
    def leaves(x):
        below = [y for y, up in enumerate(parents) if up == x]
        return frozenset([x]) if not below else frozenset().union(*map(leaves, below))

    return {(leaves(x), age[x]) for x in range((len(parents) + 1) // 2, len(parents))}


def test_replay_all_trees(spark, lines_dir):
    home, columns = lines_dir
    want = {}
    for start, (parents, age) in ladders(columns).items():
        n, at, clades = len(columns[start // 10]), start, nested(parents, age)
        for i in range(n):
            want[at, start + i + 1] = clades
            at, j, left = start + i + 1, (i + 1) % n, {}
            for c, t in clades:  # the cut leaf goes; a node with one child goes with it
                left.setdefault(c - {i}, set()).add(t)
            left = {(c, min(ts)) for c, ts in left.items() if len(c) > 1}
            clades = {(c | {i} if j in c else c, t) for c, t in left} | {(frozenset({i, j}), 0.5)}
        want[at, start + 10] = clades
    rows = QUERIES["spr_replay"](spark, home).collect()
    assert {r.chrom for r in rows} == {"1"} and len(rows) == len(want)
    assert {(r.start, r.stop): nested(r.ptree, r.age) for r in rows} == want


def test_tracks_of_all_samples(spark, sf_dir):
    track = tracks(spark, sf_dir)
    held = {(r["sample"], r.chrom) for r in track.select("sample", "chrom").distinct().collect()}
    samples = {s for s, _ in held}
    assert len(samples) == 10
    for name in ("track_complete", "grid_positions"):
        assert {(r["sample"], r.chrom) for r in QUERIES[name](spark, sf_dir).select("sample", "chrom").distinct().collect()} >= held, name
    assert {r["sample"] for r in QUERIES["track_refine"](spark, sf_dir).select("sample").distinct().collect()} == samples - {max(samples)}
    points = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert QUERIES["track_lookup"](spark, sf_dir).count() == points * len(samples)


def test_breaks_over_tiles(spark):
    r = random.Random(1)
    pairs = {(c, a, a + r.randint(1, 70)) for c in "xy" for a in (r.randint(0, 900) for _ in range(150))} | {("x", 2000, 2400), ("z", 5, 6)}
    frame = spark.createDataFrame(sorted(pairs), "chrom string, a_pos long, b_pos long")
    want, alone = [], []
    for c in "xyz":
        last, mine = None, sorted((b, a) for k, a, b in pairs if k == c)
        for b, a in mine:
            if last is None or a >= last:
                want.append((c, last := b))
        alone += [(c, a, b) for b, a in mine if not any((x, y) != (a, b) and x >= a and y <= b for y, x in mine)]
    for width in (8, 64, 4096):
        found = st.stab_intervals(frame, width)
        assert sorted(map(tuple, found.select("chrom", "pos").collect())) == sorted(want), width
        assert sorted(map(tuple, st.unnested_conflicts(frame, width).select("chrom", "a_pos", "b_pos").collect())) == sorted(alone), width
    largest = st.stab_intervals(frame, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert largest.count("FlatMapGroupsInPandas [chrom#") >= 3 and ", tile#" in largest


def test_no_key_in_one_array(spark, sf_dir):
    for name in ("supplier_quantiles", "log_sum"):
        assert "collect_list" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString(), name
    rows = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 5.0), (1, 9.0), (2, 1000.0), (2, 1000.0), (None, 3.0)], "k long, v double")
    assert {r.k: (r.low, r.mid) for r in ordered.rank_quantiles(rows, "k", "v", {"low": 0.25, "mid": 0.5}).collect()} == {1: (2.0, 3.5), 2: (1000.0, 1000.0), None: (3.0, 3.0)}
    assert {r.k: r.total for r in ordered.log_sums(rows, "k", "v").collect()} == pytest.approx({1: math.log(2 * math.exp(2) + math.exp(5) + math.exp(9)), 2: 1000 + math.log(2), None: 3.0})
