"""Graphs in tiles, made from histories without moving anything: what readers of tiles give, on histories that go over many tiles."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_graphs import BLOCKS, EDITS, MAPPED, history, plain, random_edit, scrambled
from test_growth import plan
from test_joining import random_tree

from loamtree.operators import borders, graphs, numbering, spr
from loamtree.operators.spr import apply_spr
from loamtree.queries import histories as queries


@pytest.fixture(scope="module")
def held(spark):
    """Blocks and edits, and the histories as rows; of one the positions are far apart."""
    rng = random.Random(21)
    blocks, edits = [], []
    for sample, n, k, chrom, times in ((0, 2, 12, "1", 1), (1, 5, 60, "1", 1), (1, 4, 25, "2", 60), (2, 7, 90, "1", 7), (3, 3, 0, "1", 1)):
        b, e = history(rng, sample, n, k, chrom)
        blocks += [(s, c, x * times, y * times, p, a) for s, c, x, y, p, a in b]
        edits += [(s, c, pos * times, *rest) for s, c, pos, *rest in e]
    rows = spark.createDataFrame(blocks, BLOCKS)
    first = rows.groupBy("sample", "chrom").agg(F.min_by(F.struct("start", "ptree", "age"), "start").alias("x")).select("sample", "chrom", "x.*")
    jobs = spr.histories(first, spark.createDataFrame(edits, EDITS), rows.groupBy("sample", "chrom").agg(F.max("stop").alias("stop")))
    found = jobs.collect()
    return blocks, edits, spark.createDataFrame(found, jobs.schema)


def test_trees_of_tiles(spark, held):
    blocks, edits, jobs = held
    tiles = graphs.tiles_of_histories(jobs)
    assert tiles.groupBy("sample", "chrom").count().agg(F.max("count")).first()[0] > 3
    edges = tiles.select("sample", "chrom", F.explode(F.arrays_zip(*graphs.EDGE)).alias("x")).select("sample", "chrom", "x.*").distinct()
    want = graphs.graph_edges(spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(edits, EDITS)).select(edges.columns)
    assert sorted(map(repr, edges.collect())) == sorted(map(repr, want.collect()))
    made = graphs.blocks_of_tiles(tiles)
    assert plain(made.collect()) == sorted(blocks) and "Exchange" not in plan(made)


def test_graph_blocks_moves_lines_alone(spark, sf_dir):
    assert plan(queries.graph_blocks(spark, sf_dir)).count("Exchange") == 1


def test_edits_of_tiles(spark, held, sf_dir):
    """Also those at a tile's first position, whose old links end where the tile begins."""
    blocks, edits, jobs = held
    far = spark.createDataFrame([(9, "3", 0, 2000, [2, 2, -1], [0.0, 0.0, 5.0], [(256, 0, 1.0, 1, 7.0), (1024, 1, 2.0, 0, 3.0)])], jobs.schema)
    want = edits + [(9, "3", 256, 0, 1.0, 1, 7.0), (9, "3", 1024, 1, 2.0, 0, 3.0)]
    trees = {(s, c, stop): (p, a) for s, c, _, stop, p, a in blocks} | {(9, "3", 256): ([2, 2, -1], [0.0, 0.0, 5.0]), (9, "3", 1024): ([2, 2, -1], [0.0, 0.0, 7.0])}
    made = graphs.edits_of_tiles(graphs.tiles_of_histories(jobs.unionByName(far)))
    assert "Exchange" not in plan(made)
    got = {(r.sample, r.chrom, r.pos): (r.recomb_node, r.recomb_time, r.coal_node, r.coal_time) for r in made.collect()}
    assert set(got) == {x[:3] for x in want} and len(got) == len(want)
    for s, c, pos, x, t, y, u in want:
        assert got[s, c, pos][:2] == (x, t) and got[s, c, pos][3] == u
        assert apply_spr(*trees[s, c, pos], x, got[s, c, pos][2], u) == apply_spr(*trees[s, c, pos], x, y, u)
    assert plan(queries.graph_edits(spark, sf_dir)).count("Exchange") == 1


@pytest.mark.parametrize("start, stop", [(101, 103), (150, 900), (256, 512), (1100, 1110), (700, 99999), (0, 100)])
def test_regions_of_tiles(spark, held, sf_dir, start, stop):
    """Also regions that begin or lie where no tile has a start, or before the first position."""
    blocks, edits, jobs = held
    tiles = graphs.tiles_of_histories(jobs).withColumns({"from": F.lit(start).cast("long"), "to": F.lit(stop).cast("long")})
    cut = graphs.region_of_tiles(tiles)
    want = sorted((s, c, max(x, start), min(y, stop), p, a) for s, c, x, y, p, a in blocks if x < stop and y > start)
    assert plain(graphs.blocks_of_tiles(cut).collect()) == want
    assert sorted((r.sample, r.chrom, r.pos) for r in graphs.edits_of_tiles(cut).collect()) == sorted(x[:3] for x in edits if start < x[2] < stop)
    again = graphs.region_of_tiles(cut.withColumns({"from": F.lit(start + 1).cast("long"), "to": F.lit(stop - 1).cast("long")}))
    assert plain(graphs.blocks_of_tiles(again).collect()) == sorted((s, c, max(x, start + 1), min(y, stop - 1), p, a) for s, c, x, y, p, a in blocks if max(x, start + 1) < min(y, stop - 1))
    assert plan(queries.sub_graph_blocks(spark, sf_dir)).count("Exchange") == 1


def test_lists_of_blocks(held, monkeypatch):
    """Written in parts, a list has the whole of its tile all the same, and joints that edits move."""
    blocks, edits, jobs = held
    batch = pa.Table.from_batches(jobs.toArrow().to_batches()).combine_chunks().to_batches()[0]
    broken = {(s, c, pos): x for s, c, pos, x, *_ in edits}
    for flush, width in ((30, 64), (30, 1 << 20), (1 << 20, 64)):
        monkeypatch.setattr(spr, "FLUSH", flush)
        parts = list(spr._blocks_of(batch, width))
        assert (len(parts) > 1) == (flush == 30)
        found, before = {}, {}
        for r in (r for part in parts for r in part.to_pylist()):
            assert (r["sample"], r["chrom"], r["tile"]) not in found and {x["start"] // width for x in r["x"]} == {r["tile"]}
            found[r["sample"], r["chrom"], r["tile"]] = [(r["sample"], r["chrom"], x["start"], x["stop"], x["ptree"], x["age"], x["joint"]) for x in r["x"]]
        for x in (x for key in sorted(found) for x in found[key]):
            moved = before[x[:2]][4][broken[x[:3]]] if x[:2] in before else None
            assert x[6] == moved
            before[x[:2]] = x
        assert [x[:6] for key in sorted(found) for x in found[key]] == sorted(blocks)


def test_numbers_in_lists_move_lines_alone(spark, sf_dir):
    assert plan(queries.stable_node_numbers(spark, sf_dir)).count("Exchange") == 1


def test_a_mapping_has_one_place_for_each_new_node():
    with pytest.raises(ValueError):
        numbering._permutations(pa.array([[0, 1, 1]], pa.list_(pa.int32())), np.array([3]))


@pytest.mark.parametrize("width", [16, 1 << 20])
def test_trees_of_lists_get_their_numbers(spark, held, width):
    """In one step where a tile holds a chromosome, else over its tiles: as rows of blocks get them."""
    blocks, edits, _ = held
    rows = spark.createDataFrame([x[:7] for x in scrambled(random.Random(22), blocks, edits)], MAPPED)
    p, a = numbering.renumbered("ptree", "age", "number")
    want = numbering.stable_numbers(rows, 7).select("sample", "chrom", "start", "stop", p.alias("ptree"), a.alias("age"))
    tiles = rows.groupBy("sample", "chrom", F.floor(F.col("start") / width).alias("tile")).agg(F.collect_list(F.struct("start", "stop", "ptree", "age", "mapping")).alias("x"))
    last = max(x[2] for x in blocks)
    assert plain(numbering.stable_trees(tiles, last, width).collect()) == plain(want.collect())


def test_borders_of_many_pairs():
    """The edits and mappings of a Python walk over each pair: equal trees, one edit apart, ages that tie, more than 64 leaves, in any order of joints."""
    rng, pairs = random.Random(23), []
    for i in range(300):
        n = 70 if i % 50 == 0 else rng.randint(2, 9)
        p, a = random_tree(rng, n, on_grid=i % 3 == 0)
        q, b = list(p), list(a)
        if i % 7:
            x, t, c, u = random_edit(rng, p, a)
            q, b = apply_spr(p, a, x, c, float(round(u)) if i % 3 == 0 and max(t, a[c]) <= round(u) and (p[c] < 0 or round(u) <= a[p[c]]) else u)
        new = list(range(n)) + rng.sample(range(n, 2 * n - 1), n - 1)
        turned, ages = [0] * len(q), [0.0] * len(q)
        for x, up in enumerate(q):
            turned[new[x]], ages[new[x]] = (new[up] if up >= 0 else -1), b[x]
        pairs.append((p, a, turned, ages))

    def slow(*pair):
        raise AssertionError("no pair here goes the slow way")

    flat = [np.concatenate([np.array(x[k], kind) for x in pairs]) for k, kind in enumerate((np.int64, float, np.int64, float))]
    size = np.array([len(x[0]) for x in pairs])
    same, x, coal, time, mapping = borders.edits_between(*flat, size, slow)
    assert 20 < same.sum() < 200
    for i, own in enumerate(np.split(mapping, np.cumsum(size)[:-1])):
        p, a, q, b = pairs[i]
        edit, two = numbering.edit_between(p, a, q, b), {held: y for y, held in numbering._upward(q, b).items()}
        if edit is None:
            assert same[i] and own.tolist() == [two[held] for _, held in sorted(numbering._upward(p, a).items())]
        else:
            assert not same[i] and (x[i], coal[i], time[i]) == edit and own.tolist() == numbering._mapping_over(p, a, edit, two)
    far = [np.array(v) for v in ([4, 4, 5, 6, 5, 6, -1], [0.0, 0, 0, 0, 1, 2, 3], [4, 5, 4, 6, 5, 6, -1], [0.0, 0, 0, 0, 4, 5, 6])]
    with pytest.raises(ValueError, match="more than one edit"):
        borders.edits_between(*far, np.array([7]), numbering._one_pair)


def test_lists_joined_side_by_side(spark, held, monkeypatch, sf_dir):
    """Cut between blocks or inside one, or with one side empty, in parts of one row: as rows of blocks are joined."""
    blocks, edits, _ = held
    rng, rows, left, right = random.Random(24), [], [], []
    for i, key in enumerate(sorted({x[:2] for x in blocks}) * 2):
        own = [x for x in blocks if x[:2] == key]
        k, inside = rng.randrange(0, len(own)), i % 2 and own[0][3] - own[0][2] > 1
        key = (key[0] + 10 * i, key[1])
        own = [(*key, *x[2:]) for x in own]
        broken = [(*key, *x[2:]) for x in edits if (x[0] + 10 * i, x[1]) == key]
        a, b = (own[:1], own[:]) if inside else (own[:k], own[k:])
        if inside:
            middle = own[0][2] + 1
            a, b = [(*key, own[0][2], middle, *own[0][4:])], [(*key, middle, *own[0][3:]), *own[1:]]
        a, b = (scrambled(rng, x, broken) for x in (a, b))
        left, right = left + [x[:7] for x in a], right + [x[:7] for x in b]
        names = ("start", "stop", "ptree", "age", "mapping")
        rows.append((*key, 0, *([dict(zip(names, x[2:7])) for x in side] for side in (a, b))))
    kind = "array<struct<start:long,stop:long,ptree:array<int>,age:array<double>,mapping:array<int>>>"
    tiles = spark.createDataFrame(rows, f"sample long, chrom string, tile long, left {kind}, right {kind}")
    want = numbering.joined_blocks(spark.createDataFrame(left, MAPPED), spark.createDataFrame(right, MAPPED))[0].collect()
    monkeypatch.setattr(numbering, "NODES", 1)
    batch = tiles.toArrow().combine_chunks().to_batches()[0]
    parts = list(numbering._in_parts(numbering._joined)([batch]))
    assert len(parts) == len(rows)
    got = sorted((r["sample"], r["chrom"], *b.values()) for part in parts for r in part.to_pylist() for b in r["x"])
    assert got == sorted((r.sample, r.chrom, r.start, r.stop, r.ptree, r.age, r.mapping) for r in want)
    assert plan(queries.joined_lists(spark, sf_dir)).count("Exchange") == 1
