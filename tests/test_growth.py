"""Steps whose work has to grow with their rows alone: whole batches at once, no group of Python calls a key, no row a pair of a key's members."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamtree.operators import graphs, numbering, sites, spr
from loamtree.operators import forest
from loamtree.operators.forest import Forest
from loamtree.plans import joining, popsizes
from loamtree.queries import core, formats
from loamtree.sources import newick, text
from loamtree.streaming import segments


def plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_replay_takes_whole_batches(monkeypatch):
    """Histories of unequal trees and numbers of edits, written in several parts, are those of one edit after the other."""
    monkeypatch.setattr(spr, "FLUSH", 10)
    trees = [([2, 2, -1], [0.0, 0.0, 5.0]), ([3, 3, 4, 4, -1], [0.0, 0.0, 0.0, 2.0, 7.0]), ([3, 4, 3, 4, -1], [0.0, 0.0, 0.0, 1.0, 9.0])]
    edits = [[(1, 0, 1, 3.0), (4, 1, 2, 6.0)], None, [(2, 1, 0, 0.5), (3, 2, 4, 11.0), (8, 0, 3, 0.25)]]
    names = ("pos", "recomb_node", "coal_node", "coal_time")
    kinds = pa.list_(pa.struct([("pos", pa.int64()), ("recomb_node", pa.int32()), ("coal_node", pa.int32()), ("coal_time", pa.float64())]))
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([0, 1, 2]), pa.array(["a", "b", "c"]), pa.array([0, 0, 1]), pa.array([9, 9, 10]), pa.array([p for p, _ in trees], pa.list_(pa.int32())), pa.array([a for _, a in trees], pa.list_(pa.float64())),
            pa.array([e and [dict(zip(names, x)) for x in e] for e in edits], kinds),
        ],
        ["sample", "chrom", "start", "stop", "ptree", "age", "edits"],
    )
    want = []
    for i, ((p, a), own) in enumerate(zip(trees, edits)):
        start, stop = (0, 9) if i < 2 else (1, 10)
        for pos, x, coal, time in own or []:
            want.append((i, "abc"[i], start, pos, p, a))
            (p, a), start = spr.apply_spr(p, a, x, coal, time), pos
        want.append((i, "abc"[i], start, stop, p, a))
    parts = list(spr._fold([batch]))
    got = [tuple(r.values()) for part in parts for r in part.to_pylist()]
    assert len(parts) > 1 and sorted(got) == sorted(want)


def test_graph_trees_over_tiles(spark):
    """Edges within one tile, over tiles that no edge begins in, and a joint that takes over a number."""
    blocks = spark.createDataFrame([(0, "1", 0, 300, [2, 2, -1], [0.0, 0.0, 5.0]), (0, "1", 300, 5000, [2, 2, -1], [0.0, 0.0, 7.0]), (0, "1", 5000, 5001, [2, 2, -1], [0.0, 0.0, 3.0])], "sample long, chrom string, start long, stop long, ptree array<int>, age array<double>")
    edits = spark.createDataFrame([(0, "1", 300, 0, 1.0, 1, 7.0), (0, "1", 5000, 1, 2.0, 0, 3.0)], "sample long, chrom string, pos long, recomb_node int, recomb_time double, coal_node int, coal_time double")
    nodes, edges = graphs.graph_nodes(blocks, edits), graphs.graph_edges(blocks, edits)
    found = graphs.graph_blocks(nodes, edges)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, blocks.collect()))
    assert "MapInArrow" in plan(found)
    back = graphs.graph_edits(nodes, edges)
    assert sorted((r.pos, r.recomb_node, r.recomb_time, r.coal_time) for r in back.collect()) == [(300, 0, 1.0, 7.0), (5000, 1, 2.0, 3.0)]
    assert "Join" not in plan(back).split("Aggregate")[0]  # its parts meet by one grouping


def test_numbers_without_a_call_a_tile(spark):
    rows = [(0, str(c), s, s + 1, [2, 2, -1], None if s == 7 else [0, 1, -1]) for c in range(3) for s in range(7, 20)]
    found = numbering.stable_numbers(spark.createDataFrame(rows, "sample long, chrom string, start long, stop long, ptree array<int>, mapping array<int>"), 4)
    assert "FlatMapGroups" not in plan(found)
    assert {tuple(r.number) for r in found.collect()} == {(0, 1, 2)} and found.count() == len(rows)


def test_spans_of_a_split_are_one_row(spark):
    """Sites of one split that cover the same blocks do not become a row a site and block."""
    tracks = spark.createDataFrame([("1", p, None, None) for p in range(300)] + [("1", 300, 20, 60), ("1", 301, 40, 80), ("1", 302, None, 20)], "chrom string, pos long, start long, stop long")
    breaks = spark.createDataFrame([("1", p) for p in range(20, 100, 20)], "chrom string, pos long")
    splits = spark.createDataFrame([("1", p, "a" if p < 300 else "b") for p in range(303)], "chrom string, pos long, split string")
    spans = sites.split_spans(tracks, breaks, splits, 2)
    assert sorted((r.split, r.first, r.last) for r in spans.collect()) == [("a", 0, 4), ("b", 0, 0), ("b", 1, 2), ("b", 3, 3)]
    found = {(r.block, r.split) for r in sites.split_blocks(tracks, breaks, splits).collect()}
    assert found == {(b, "a") for b in range(5)} | {(b, "b") for b in range(4)}
    assert sorted((r.block, r.n) for r in sites.split_counts(spans, 2).collect()) == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 1)]


def test_conflicts_are_rows_only_where_they_conflict(spark):
    rng = random.Random(5)
    columns = [(7 * i + rng.randint(0, 6), "".join(rng.choice("ACN"[: rng.randint(1, 3)]) for _ in range(rng.choice((1, 4, 6, 62, 63, 70))))) for i in range(60)]

    def split(col, k):
        part = col[:k]
        rarest = min(set(part), key=lambda s: (part.count(s), s))
        return {i for i, s in enumerate(part) if s == rarest}

    want = set()
    for p, a in columns:
        for q, b in columns:
            k = min(len(a), len(b))
            one, two = split(a, k), split(b, k)
            if p < q <= p + 40 and one & two and not one <= two and not two <= one:
                want.add((p, q))
    found = sites.conflicting_pairs(spark.createDataFrame([("1", p, c) for p, c in columns], "chrom string, pos long, col string"), 40)
    assert {(r.a_pos, r.b_pos) for r in found.collect()} == want and found.count() == len(want) > 20
    assert "MapInArrow" in plan(found)


def test_stream_replay_by_buckets(spark):
    """Histories of one bucket; one starts anew in the batch in which it was edited, one is edited before it has a tree."""
    kinds = "sample long, chrom string, pos long, ptree array<int>, age array<double>, recomb_node int, coal_node int, coal_time double"
    tree, edit = ([2, 2, -1], [0.0, 0.0, 4.0]), (0, 1, 6.0)
    parts = [
        [(0, "1", 0, *tree, None, None, None), (0, "1", 3, None, None, *edit), (0, "1", 4, None, None, *edit), (0, "1", 9, [2, 2, -1], [0.0, 0.0, 8.0], None, None, None), (1, "1", 0, *tree, None, None, None), (2, "1", 1, None, None, *edit)],
        [(0, "1", 12, None, None, *edit), (1, "1", 5, None, None, *edit), (2, "1", 2, *tree, None, None, None)],
        [(2, "1", 6, None, None, *edit), (0, "1", 13, None, None, *edit)],
    ]
    made = segments.run_in_parts(lambda s: segments.stream_replay(s, 1), [spark.createDataFrame(p, kinds) for p in parts], "replay")
    got = sorted((r.sample, r.start, r.stop, r.age[2]) for r in made.collect())
    assert got == [(0, 0, 3, 4.0), (0, 3, 4, 6.0), (0, 9, 12, 8.0), (0, 12, 13, 6.0), (1, 0, 5, 4.0), (2, 2, 6, 4.0)]


def test_graph_of_changes_alone(spark):
    """Edges and nodes of a graph, and how many there are, come from first trees and edits: the same as from the trees of all blocks, which no plan moves."""
    first = [(0, "a", 0, [2, 2, -1], [0.0, 0.0, 5.0], 9), (1, "b", 2, [3, 4, 3, 4, -1], [0.0, 0.0, 0.0, 1.0, 9.0], 12), (2, "c", 0, [2, 2, -1], [0.0, 0.0, 1.0], 4)]
    edits = [(0, "a", 1, 0, 0.5, 1, 3.0), (0, "a", 4, 1, 0.5, 2, 6.0), (1, "b", 3, 1, 0.1, 0, 0.5), (1, "b", 5, 2, 0.1, 4, 11.0), (1, "b", 8, 0, 0.1, 3, 0.25)]
    first = spark.createDataFrame(first, "sample long, chrom string, start long, ptree array<int>, age array<double>, region_stop long")
    edits = spark.createDataFrame(edits, "sample long, chrom string, pos long, recomb_node int, recomb_time double, coal_node int, coal_time double")
    blocks = spr.replay(first.drop("region_stop"), edits, first.selectExpr("sample", "chrom", "region_stop AS stop"))
    made, want = spr.replayed_changes(first, edits), graphs.changes(blocks, edits)
    assert sorted(made.columns) == sorted(want.columns) and sorted(map(repr, made.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    nodes, edges = graphs.nodes_of(first, made), graphs.edges_of(first, made)
    for ours, theirs in ((nodes, graphs.graph_nodes(blocks, edits)), (edges, graphs.graph_edges(blocks, edits))):
        assert sorted(map(repr, ours.collect())) == sorted(map(repr, theirs.select(ours.columns).collect()))
    sizes = graphs.sizes_of(first, made)
    assert "Window" not in plan(sizes)
    count = {}
    for row in edges.filter("parent >= 0").collect():
        count.setdefault(row.chrom, [0, 0])[0] += 1
    for row in nodes.filter("event <> 'recomb'").collect():
        count[row.chrom][1] += 1
    assert {r.chrom: [r.n_edges, r.n_standing] for r in sizes.collect()} == count


def test_nine_decimals_are_those_of_round(spark):
    """On ties, near them, large and missing numbers too."""
    rng = random.Random(5)
    values = [rng.random() for _ in range(20000)] + [rng.randrange(10**9) / 1e9 + 5e-10 for _ in range(2000)] + [-rng.random() * 20 for _ in range(500)]
    values += [0.0, -0.0, 1.0, 2.5e-9, -2.5e-9, 4.9999999999e-10, 123456.7890123455, 1e300, float("nan"), float("inf"), None]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", core.nine_decimals(F.col("x")).alias("ours"), F.round("x", 9).alias("theirs"))
    assert rows.filter(~F.col("ours").eqNullSafe(F.col("theirs"))).collect() == []


def test_forests_and_places_by_arrow():
    """A forest from a slice of an Arrow array is the one from its rows, and its items go back as Arrow arrays without a Python object each."""
    p, a = [[2, 2, -1], [3, 4, 3, 4, -1], [3, 3, 4, 4, -1]], [[0.0, 0.0, 5.0], [0.0, 0.0, 0.0, 1.0, 9.0], [0.0, 0.0, 0.0, 2.0, 7.0]]
    ours = Forest(pa.array(p, pa.list_(pa.int32())).slice(1), pa.array(a, pa.list_(pa.float64())).slice(1))
    theirs = Forest(pd.Series(p[1:]), pd.Series(a[1:]))
    assert all((getattr(ours, c) == getattr(theirs, c)).all() for c in ("sizes", "first", "tree", "parent", "age", "place", "leaf"))
    found = joining.by_tree(ours, np.array([1, 2, 7]), {"node": pa.array([1, 2, 2], pa.int32())})
    assert isinstance(found, pa.ListArray) and found.to_pylist() == [[{"node": 1}, {"node": 2}], [{"node": 2}]]
    assert len(Forest(pa.array([], pa.list_(pa.int32())), pa.array([], pa.list_(pa.float64()))).parent) == 0


def test_newick_of_whole_forests():
    """Texts of all trees of a batch are those of render(), also with more than two children; broken brackets are errors."""
    trees = [([2, 2, -1], [0.0, 0.0, 5.0]), ([3, 4, 3, 4, -1], [0.0, 0.0, 0.0, 1.25, 9.0]), ([5, 5, 4, 4, 5, -1], [0.0, 1.0, 0.0, 0.0, 2.0, 1 / 3]), ([-1], [0.5])]
    names = [[f"n{i}" if i % 2 == 0 else "" for i in range(len(p))] for p, _ in trees]
    f = Forest(pa.array([p for p, _ in trees], pa.list_(pa.int32())), pa.array([a for _, a in trees], pa.list_(pa.float64())))
    assert newick.rendered(f, sum(names, [])) == [newick.render(p, a, x) for (p, a), x in zip(trees, names)]
    assert newick.parse("(a:1 [x=1:age=2] , b[&&NHX:age=3]:4)r:5;") == ([2, 2, -1], [2.0, 3.0, 7.0], ["a", "b", "r"])
    for wrong in ("(a[b,c);", "(a:,b:1);"):
        with pytest.raises(ValueError):
            newick.parse(wrong)


def test_smc_files_make_trees_once(spark, sf_dir, monkeypatch):
    """Files are written from stored trees, of which each reads those of its own sample."""
    plans = []
    monkeypatch.setattr(text, "write_smc", lambda trees, *_: plans.append(plan(trees)))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        formats.smc_files(spark, sf_dir)
    assert len(plans) == 4 and all("lineitem" not in p and "PartitionFilters: [isnotnull(sample" in p for p in plans)


def test_counts_from_edits_take_whole_batches(spark):
    """No window or join of edits: a history is met once, with a row a tile. Edits without a first tree count for nothing, trees without edits do."""
    grid = [0.0, 1.0, 4.0, 9.0, 20.0]
    trees = spark.createDataFrame([(0, "a", [2, 2, -1], [0.0, 0.0, 4.0]), (1, "a", [3, 3, 4, 4, -1], [0.0, 0.0, 0.0, 1.0, 9.0])], "sample long, chrom string, ptree array<int>, age array<double>")
    edits = [(0, "a", 5, 0.5, 4.0, 9.0), (0, "a", 300, 1.0, 9.0, 4.0), (0, "a", 1, 0.0, 4.0, 4.0), (7, "a", 1, 0.0, 4.0, 9.0)]
    edits = spark.createDataFrame(edits, "sample long, chrom string, pos long, recomb_time double, broken_time double, coal_time double")
    for width in (2, 64, 1000):
        found = popsizes.counts_from_edits(trees, edits, grid, width)
        assert "Window" not in plan(found) and "Join" not in plan(found)
        got = {r.time_bin: (r.n_coal, r.n_lineages) for r in found.collect()}
        # the trees, then the edits by position: one other line at times 0 and 1; at 0, 1 and 2 (0.5 is at 0); at 1
        assert got == {0: (0, 5 + 1 + 1), 1: (1, 4 + 1 + 1 + 1), 2: (1 + 2, 2 + 1), 3: (1 + 1, 0)}, got


def test_windows_count_trees_once(spark):
    """Trees of tiles between the windows' ends are counted once, and windows have the counts of their trees."""
    rng, grid = random.Random(3), [0.0, 1.0, 4.0, 9.0, 20.0]
    rows = [(10 * i, [3, 3, 4, 4, -1], [0.0, 0.0, 0.0, float(a := rng.randint(1, 5)), a + rng.random() * 9]) for i in range(400)]
    trees = spark.createDataFrame(rows, "start long, ptree array<int>, age array<double>")
    for width, step in ((1000, 500), (700, 300), (50, 200)):
        want = popsizes.transitions(popsizes.in_windows(trees, width, step), grid, ["window"])
        found = popsizes.transitions_in_windows(trees, grid, width, step)
        assert sorted(map(tuple, found.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_correlations_of_trees_of_one_size_together(monkeypatch):
    """Also in parts of one tree: as from the paths between all pairs of leaves of each tree alone."""
    def distances(parents):
        above = []
        for x in range((len(parents) + 1) // 2):
            above.append(set())
            while x >= 0:
                above[-1].add(x)
                x = parents[x]
        return [len(a ^ b) for i, a in enumerate(above) for b in above[i + 1 :]]

    one = [[2, 2, -1], [4, 4, 5, 6, 5, 6, -1], [3, 4, 3, 4, -1], [4, 4, 5, 5, 6, 6, -1], [4, 5, 4, 6, 5, 6, -1]]
    two = [[2, 2, -1], [4, 4, 5, 6, 5, 6, -1], [3, 3, 4, 4, -1], [4, 4, 5, 6, 5, 6, -1], [4, 4, 5, 6, 5, 6, -1]]
    want = [np.nan if np.std(distances(p)) * np.std(distances(q)) == 0 else np.corrcoef(distances(p), distances(q))[0, 1] for p, q in zip(one, two)]
    for most in (1, 1 << 22):
        monkeypatch.setattr(forest, "ENTRIES", most)
        assert np.allclose(forest.correlations(Forest(pd.Series(one)), Forest(pd.Series(two))), want, equal_nan=True)
    assert len(forest.correlations(Forest(pd.Series([], dtype=object)), Forest(pd.Series([], dtype=object)))) == 0
