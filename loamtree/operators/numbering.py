"""Node numbers that stay over the blocks of a chromosome, and lists of blocks joined into one."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from . import forest
from .borders import edits_between
from .spr import apply_spr, in_slices, lists, places

KEYS = ["sample", "chrom"]
#: Rows of a tile that one task composes.
TILE_ROWS = 1024


#: Nodes of lists of blocks that are numbered or joined at once.
NODES = 1 << 20


def _in_parts(of):
    """A function of one batch of lists of blocks as one of batches, in parts of NODES nodes or one row."""

    def parts(batches):
        for batch in batches:
            x = [c for c in batch.schema.names if pa.types.is_list(batch.schema.field(c).type)]
            nodes = sum(_totals(batch.column(c)) for c in x)
            yield from map(of, in_slices(batch, nodes, NODES))

    return parts


def _totals(column: pa.ListArray) -> np.ndarray:
    """Of each list of blocks how many nodes their trees have together."""
    behind = np.concatenate(([0], np.cumsum(_lengths(column.flatten().field("ptree")))))
    ends = np.cumsum(_lengths(column))
    return np.diff(behind[np.concatenate(([0], ends))])


def _lengths(column: pa.ListArray) -> np.ndarray:
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _permutations(mapping: pa.ListArray, size: np.ndarray) -> np.ndarray:
    """The number in the block before of each node of a block, from the mapping the other way, one block behind the other; the new joint has that of the one that is gone. Without a mapping nothing moves."""
    begin = np.cumsum(size) - size
    first = np.repeat(begin, size)
    place = np.arange(len(first)) - first
    to, old = place.copy(), np.full(len(place), -1)
    given = np.repeat(mapping.is_valid().to_numpy(zero_copy_only=False), size)
    to[given] = mapping.flatten().to_numpy(zero_copy_only=False)
    stays = to >= 0
    old[(to + first)[stays]] = place[stays]
    gone, new = np.flatnonzero(~stays), np.flatnonzero(old < 0)
    if len(gone) != len(new) or (first[gone] != first[new]).any():
        raise ValueError("a mapping has to leave one node out for each that comes")
    old[new] = place[gone]
    return old


def _numbered(what: str):
    """A function of lists of blocks: their blocks as rows with `number`, composed inside each list, the i-th blocks of all lists at once; or what="ends": the last numbers of each list alone; or "trees": blocks with their trees renumbered, without numbers and mapping."""

    def numbered(batch):
        rows, x = _lengths(batch.column("x")), batch.column("x").flatten()
        of, start = np.repeat(np.arange(len(rows)), rows), x.field("start").to_numpy(zero_copy_only=False)
        if len(x) and ((np.diff(of) == 0) & (np.diff(start) < 0)).any():
            x = x.take(pa.array(np.lexsort((start, of))))
        size = _lengths(x.field("ptree"))
        number = _permutations(x.field("mapping"), size)
        at, begin = np.cumsum(rows) - rows, np.cumsum(size) - size
        for i in range(1, int(rows.max(initial=0))):
            now = at[rows > i] + i
            here = places(begin[now], size[now])
            number[here] = number[number[here] + np.repeat(begin[now - 1], size[now])]
        if what == "ends":
            held = np.flatnonzero(rows)
            last = at[held] + rows[held] - 1
            keys = [batch.column(c).take(pa.array(held)) for c in (*KEYS, "tile")]
            return pa.RecordBatch.from_arrays([*keys, lists(number[places(begin[last], size[last])], size[last], pa.int32())], [*KEYS, "i", "perm"])
        keys, names = [batch.column(c).take(pa.array(of)) for c in (*KEYS, "tile")], [f.name for f in x.type]
        if what == "trees":
            number = lists(number, size, pa.int32())
            trees = [_tree_by(x.field("ptree"), number), _age_by(x.field("age"), number)]
            return pa.RecordBatch.from_arrays([*keys[:2], x.field("start"), x.field("stop"), *trees], [*KEYS, "start", "stop", "ptree", "age"])
        return pa.RecordBatch.from_arrays([*keys, *(x.field(c) for c in names), lists(number, size, pa.int32())], [*KEYS, "tile", *names, "number"])

    return _in_parts(numbered)


def _running(batches):
    """Rows of a tile in order, their permutations composed one after the other, the i-th rows of all tiles of a batch at once."""
    for batch in batches:
        column = batch.column("x")
        rows = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        x = column.flatten()
        perm = x.field("perm")
        flat, size = perm.flatten().to_numpy().copy(), perm.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        at, begin = np.cumsum(rows) - rows, np.cumsum(size) - size
        for i in range(1, int(rows.max(initial=0))):
            now = at[rows > i] + i
            place = np.repeat(begin[now], size[now]) + np.arange(size[now].sum()) - np.repeat(np.cumsum(size[now]) - size[now], size[now])
            flat[place] = flat[flat[place] + np.repeat(begin[now - 1], size[now])]
        tile = np.repeat(np.arange(len(rows)), rows)
        keys = [batch.column(c).take(pa.array(tile)) for c in (*KEYS, "tile")]
        yield pa.RecordBatch.from_arrays([*keys, x.field("i"), lists(flat, size, pa.int32())], [*KEYS, "tile", "i", "total"])


def _composed(rows: DataFrame, width: int, last: int) -> DataFrame:
    """sample, chrom, i, total: for rows (i from 0 to `last`, perm) the composition of the perms of a (sample, chrom) up to each, perm_a[perm_b[... perm_i]].

    A tile of `width` places is one row, whose perms are composed in one task;
    the last totals of tiles are composed in the same way, and each tile starts
    from what came before it. So a chromosome takes log `last` / log width
    rounds, and no task more than `width` rows of one tile at once.
    """
    tiled = rows.groupBy(*KEYS, F.floor(F.col("i") / width).alias("tile")).agg(F.sort_array(F.collect_list(F.struct("i", "perm"))).alias("x"))
    parts = tiled.mapInArrow(_running, "sample long, chrom string, tile long, i long, total array<int>")
    if last < width:
        return parts.drop("tile")
    ends = parts.groupBy(*KEYS, F.col("tile").alias("i")).agg(F.max_by("total", "i").alias("perm"))
    ahead = Window.partitionBy(*KEYS).orderBy("i")
    before = _composed(ends, width, last // width).select(*KEYS, F.lead("i").over(ahead).alias("tile"), F.col("total").alias("earlier"))
    both = parts.join(before, [*KEYS, "tile"], "left")
    total = F.when(F.col("earlier").isNull(), F.col("total")).otherwise(F.transform("total", lambda x: F.get(F.col("earlier"), x)))
    return both.select(*KEYS, "i", total.alias("total"))


def stable_numbers(blocks: DataFrame, width: int = TILE_ROWS) -> DataFrame:
    """blocks with `number`: of each node the number it has had since it came into the trees; a joint that an edit makes takes over the number of the one it breaks.

    blocks: sample, chrom, start, stop, ptree, and mapping, of each node of the
    block before its number in this one, -1 if it is gone; null in the first;
    other columns stay. Tiles are of positions, from the first one of all, and
    a block goes to its tile once.
    """
    least, most = blocks.agg(F.min("start"), F.max("start")).first()
    others = [c for c in blocks.columns if c not in KEYS]
    tiles = blocks.groupBy(*KEYS, F.floor((F.col("start") - (least or 0)) / width).alias("tile")).agg(F.collect_list(F.struct(*others)).alias("x"))
    return numbers_in_lists(tiles, (most or 0) - (least or 0), width).select(*blocks.columns, "number")


def numbers_in_lists(tiles: DataFrame, last: int, width: int = TILE_ROWS) -> DataFrame:
    """stable_numbers() of lists of blocks, a row a tile: sample, chrom, tile, and x, an array of structs. The tiles are of `width` positions from 0 to `last`; where one holds a chromosome, nothing is moved."""
    fields = tiles.schema["x"].dataType.elementType.fields
    kinds = T.StructType([*(tiles.schema[c] for c in KEYS), T.StructField("tile", T.LongType()), *fields, T.StructField("number", T.ArrayType(T.IntegerType()))])
    tiles = tiles.select(*KEYS, F.col("tile").cast("long").alias("tile"), "x")
    parts = tiles.mapInArrow(_numbered("rows"), kinds)
    if last < width:
        return parts.drop("tile")
    ends = tiles.mapInArrow(_numbered("ends"), "sample long, chrom string, i long, perm array<int>")
    ahead = Window.partitionBy(*KEYS).orderBy("i")
    before = _composed(ends, width, last // width).select(*KEYS, F.lead("i").over(ahead).alias("tile"), F.col("total").alias("earlier"))
    total = F.when(F.col("earlier").isNull(), F.col("number")).otherwise(F.transform("number", lambda x: F.get(F.col("earlier"), x)))
    return parts.join(before, [*KEYS, "tile"], "left").withColumn("number", total).drop("tile", "earlier")


def _turned(number: pa.Array, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sizes of lists of numbers, where each list begins, and values in the order of the numbers."""
    size = _lengths(number)
    first = np.repeat(np.cumsum(size) - size, size)
    out = np.empty(len(values), values.dtype)
    out[first + number.flatten().to_numpy(zero_copy_only=False)] = values
    return size, first, out


def _tree_by(ptree: pa.Array, number: pa.Array) -> pa.Array:
    up, to = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (ptree, number))
    size = _lengths(number)
    first = np.repeat(np.cumsum(size) - size, size)
    out = np.empty(len(up), np.int32)
    out[first + to] = np.where(up < 0, -1, to[first + np.maximum(up, 0)])
    return lists(out, size, pa.int32())


def _age_by(age: pa.Array, number: pa.Array) -> pa.Array:
    values, size = age.flatten().to_numpy(zero_copy_only=False), _lengths(number)
    out = np.empty(len(values), float)
    out[np.repeat(np.cumsum(size) - size, size) + number.flatten().to_numpy(zero_copy_only=False)] = values
    return lists(out, size, pa.float64())


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _renumbered_tree(ptree: pa.Array, number: pa.Array) -> pa.Array:
    return _tree_by(ptree, number)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _renumbered_age(age: pa.Array, number: pa.Array) -> pa.Array:
    return _age_by(age, number)


def renumbered(ptree: str, age: str, number: str) -> tuple:
    """ptree and age of a tree whose nodes have the given numbers."""
    return _renumbered_tree(ptree, number), _renumbered_age(age, number)


def stable_trees(tiles: DataFrame, last: int, width: int = TILE_ROWS) -> DataFrame:
    """sample, chrom, start, stop, ptree, age: the blocks of numbers_in_lists() with the numbers they get; where a tile holds a chromosome, in one step."""
    if last < width:
        return tiles.mapInArrow(_numbered("trees"), "sample long, chrom string, start long, stop long, ptree array<int>, age array<double>")
    p, a = renumbered("ptree", "age", "number")
    return numbers_in_lists(tiles, last, width).select(*KEYS, "start", "stop", p.alias("ptree"), a.alias("age"))


def congruent_mapping(ptree: str, other: str):
    """Of each node of a tree its number in another tree of the same leaves: the node with the same leaves below it; -1 if there is none."""
    return F.transform(forest.clades(F.col(ptree)), lambda c: F.array_position(forest.clades(F.col(other)), c).cast("int") - 1)


def _upward(p, a, skip=frozenset()):
    """leaves below and age of every node, without some leaves and the nodes that they alone make."""
    n, held = (len(p) + 1) // 2, {}
    for leaf in range(n):
        x = leaf
        while leaf not in skip and x >= 0:
            held.setdefault(x, set()).add(leaf)
            x = p[x]
    return {x: (frozenset(h), a[x]) for x, h in held.items()}


def edit_between(p, a, q, b):
    """(recomb_node, coal_node, coal_time) of an edit that makes the tree (p, a) into (q, b), whatever the numbers of joints; None if they are the same, an error if no one edit does. The coal_node is a number of the first tree."""
    one, two = _upward(p, a), _upward(q, b)
    if set(one.values()) == set(two.values()):
        return None
    places = {clade: x for x, (clade, _) in one.items()}
    for x, (clade, age) in one.items():
        again = [y for y, held in two.items() if held == (clade, age)]
        if p[x] < 0 or not again or q[again[0]] < 0:
            continue
        rest, left = _upward(p, a, clade), _upward(q, b, clade)
        distinct = lambda tree: {min((t, c) for c, t in tree.values() if c == held)[::-1] for held in {c for c, _ in tree.values()}}
        joint = q[again[0]]
        inside = lambda tree: {held for held in tree.values() if held[0] <= clade}  # noqa: E731, B023
        if distinct(rest) != distinct(left) or inside(one) != inside(two):
            continue
        other = next(y for y, up in enumerate(q) if up == joint and y != again[0])
        at = two[other][0]
        sibling = next(y for y, up in enumerate(p) if up == p[x] and y != x)
        if at == one[sibling][0]:
            return x, (p[x] if b[joint] > a[p[x]] else sibling), b[joint]
        node = places.get(at) if at in places else next(y for y, (c, _) in one.items() if c - clade == at and y != p[x])
        return x, node, b[joint]
    raise ValueError("the trees are more than one edit apart")


def _one_pair(p, a, q, b):
    edit = edit_between(p, a, q, b)
    return *edit, _mapping_over(p, a, edit, {held: y for y, held in _upward(q, b).items()})


def _border(left: dict, right: dict) -> tuple:
    """edits_between() the trees of two columns of blocks."""
    size = _lengths(left["ptree"])
    if (size != _lengths(right["ptree"])).any():
        raise ValueError("the trees at a border do not have the same leaves")
    trees = [x.flatten().to_numpy(zero_copy_only=False).astype(kind) for side in (left, right) for x, kind in ((side["ptree"], np.int64), (side["age"], float))]
    return size, *edits_between(*trees, size, _one_pair)


def _fields(x: pa.StructArray) -> dict:
    return dict(zip((f.name for f in x.type), x.flatten()))


def _connected(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The border of each chromosome, from the last block on its left and the first on its right."""
    left, right = _fields(batch.column("l")), _fields(batch.column("r"))
    size, same, x, coal, time, mapping = _border(left, right)
    own = [pa.array(v, kind, mask=same) for v, kind in ((x, pa.int32()), (coal, pa.int32()), (time, pa.float64()))]
    columns = [*(batch.column(c) for c in KEYS), left["start"], right["start"], pa.array(same), *own, lists(mapping, size, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, [*KEYS, "left_start", "pos", "same", "recomb_node", "coal_node", "coal_time", "border_mapping"])


BLOCK = ["start", "stop", "ptree", "age", "mapping"]


def _joined(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Lists `left` and `right` as one; where one is empty, the other."""
    sides = [batch.column(c) for c in ("left", "right")]
    counts, (left, right) = [_lengths(c) for c in sides], [_fields(c.flatten()) for c in sides]
    ends = np.cumsum(counts[0]) - 1, np.cumsum(counts[1]) - counts[1]
    met = np.flatnonzero((counts[0] > 0) & (counts[1] > 0))
    last, head = ends[0][met], ends[1][met]
    one, two = ({c: side[c].take(pa.array(at)) for c in BLOCK} for side, at in ((left, last), (right, head)))
    size, same, *_, border = _border(one, two)
    # the mapping into the block at a border: over it, or of two equal blocks into the first and on
    into = one["mapping"]
    known, none = into.is_valid().to_numpy(zero_copy_only=False), np.zeros(len(met), bool)
    told = np.repeat(known, size)
    carried, first = np.full(len(border), -1), np.repeat(np.cumsum(size) - size, size)
    carried[told] = into.flatten().to_numpy(zero_copy_only=False)
    carried = np.where(carried >= 0, border[first + np.maximum(carried, 0)], -1)
    none[:] = same & ~known
    new = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(np.where(np.repeat(same, size), carried, border), pa.int32()), mask=pa.array(none))
    # the order of the blocks: those on the left, less equal ones at borders, then those on the right, whose heads there are anew
    n, m = len(left["start"]), len(right["start"])
    goes = np.zeros(n + m, bool)
    goes[last[same]] = True
    row = np.concatenate([np.repeat(np.arange(len(c)), c) for c in counts])
    order = np.argsort(row, kind="stable")
    order = order[~goes[order]]
    starts = np.concatenate([side["start"].to_numpy() for side in (left, right)])
    starts[n + head[same]] = starts[last[same]]
    maps = np.arange(n + m)
    maps[n + head] = n + m + np.arange(len(met))
    held = {c: pa.concat_arrays([left[c], right[c]]).take(pa.array(order)) for c in ("stop", "ptree", "age")}
    held |= {"start": pa.array(starts[order]), "mapping": pa.concat_arrays([left["mapping"], right["mapping"], new]).take(pa.array(maps[order]))}
    count = np.bincount(row[order], minlength=batch.num_rows)
    x = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.StructArray.from_arrays([held[c] for c in BLOCK], BLOCK))
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*KEYS, "tile")), x], [*KEYS, "tile", "x"])


LISTS = "sample long, chrom string, tile long, x array<struct<start:long,stop:long,ptree:array<int>,age:array<double>,mapping:array<int>>>"


def joined_in_lists(tiles: DataFrame) -> DataFrame:
    """joined_blocks() of lists side by side, `left` and `right`, arrays of structs in order, a row for each tile of a chromosome that a border lies in: one list x. Nothing is moved; the mapping of the first block on the right is not looked at."""
    return tiles.select(*KEYS, "tile", "left", "right").mapInArrow(_in_parts(_joined), LISTS)


def joined_blocks(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two lists of blocks (sample, chrom, start, stop, ptree, age, mapping) as one, the second going on where the first ends, and the edit (sample, chrom, pos, recomb_node, coal_node, coal_time) between them where their border trees differ.

    Equal border trees become one block. The mapping over a border is that of
    the nodes with the same leaves below, or for trees one edit apart of those
    that the edit leaves. Work beyond the lists is one row a chromosome, the
    borders of a whole Arrow batch at once.
    """
    last = left.groupBy(*KEYS).agg(F.max_by(F.struct("start", "stop", "ptree", "age", "mapping"), "start").alias("l"))
    first = right.groupBy(*KEYS).agg(F.min_by(F.struct("start", "stop", "ptree", "age"), "start").alias("r"))
    schema = "sample long, chrom string, left_start long, pos long, same boolean, recomb_node int, coal_node int, coal_time double, border_mapping array<int>"
    found = last.join(first, KEYS).mapInArrow(lambda batches: map(_connected, batches), schema)
    own = ["start", "stop", "ptree", "age", "mapping"]
    ends = found.select(*KEYS, "left_start", "pos", "same", "border_mapping")
    # of two equal border trees the first goes, and its mapping is carried on to the second
    gone = ends.filter("same").select(*KEYS, F.col("left_start").alias("start"))
    kept = left.select(*KEYS, *own).join(gone, [*KEYS, "start"], "left_anti")
    before = ends.join(left.select(*KEYS, F.col("start").alias("left_start"), F.col("mapping").alias("into")), [*KEYS, "left_start"])
    carried = F.when(F.col("into").isNotNull(), F.transform("into", lambda x: F.when(x >= 0, F.get(F.col("border_mapping"), x)).otherwise(F.lit(-1))))
    heads = before.select(*KEYS, F.col("pos").alias("start"), "same", "left_start", F.when(F.col("same"), carried).otherwise(F.col("border_mapping")).alias("new_mapping"))
    rest = right.select(*KEYS, *own).join(heads, [*KEYS, "start"], "left")
    rest = rest.withColumn("mapping", F.when(F.col("same").isNull(), F.col("mapping")).otherwise(F.col("new_mapping"))).withColumn("start", F.when(F.col("same"), F.col("left_start")).otherwise(F.col("start")))
    edits = found.filter("NOT same").select(*KEYS, "pos", "recomb_node", "coal_node", "coal_time")
    return kept.unionByName(rest.select(*KEYS, *own)), edits


def _mapping_over(p, a, edit, two) -> list[int]:
    """Numbers behind an edit: each node of the edited tree is known by its leaves and age."""
    x, coal, time = edit
    edited = _upward(*apply_spr(p, a, x, coal, time))
    return [-1 if y == p[x] else two[held] for y, held in sorted(edited.items())]
