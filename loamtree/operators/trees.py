"""Statistics of local trees as Spark expressions.

A tree is two arrays: ptree, the parent of each node (-1 for the root), and
age. Nodes 0 .. n-1 of the 2n-1 are the leaves.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import nearest_time
from . import forest
from .intervals import join_points
from .ordered import merge_islands


def _arrays(ptree="ptree", age="age") -> tuple[Column, Column]:
    return (F.col(x) if isinstance(x, str) else x for x in (ptree, age))


def n_leaves(ptree="ptree") -> Column:
    return ((F.size(ptree) + 1) / 2).cast("int")


def internal_ages(ptree="ptree", age="age") -> Column:
    p, a = _arrays(ptree, age)
    return F.array_sort(F.slice(a, n_leaves(p) + 1, F.size(a) - n_leaves(p)))


def tmrca(age="age") -> Column:
    """The root's age."""
    return F.array_max(age)


def branch_lengths(ptree="ptree", age="age") -> Column:
    """Of every node but the root."""
    p, a = _arrays(ptree, age)
    return F.filter(F.zip_with(p, a, lambda up, x: F.get(a, up) - x), lambda d: d.isNotNull())


def tree_length(ptree="ptree", age="age") -> Column:
    return F.aggregate(branch_lengths(ptree, age), F.lit(0.0), lambda s, d: s + d)


def zero_branches(ptree="ptree", age="age") -> Column:
    """Branches shorter than 1e-4."""
    return F.size(F.filter(branch_lengths(ptree, age), lambda d: F.abs(d) < 1e-4))


def tree_popsize(ptree="ptree", age="age") -> Column:
    """Sum of k(k-1) times the time with k lineages, over 4(n-1)."""
    p, _ = _arrays(ptree, age)
    ages, n = internal_ages(ptree, age), n_leaves(p)
    parts = F.transform(ages, lambda x, i: (n - i) * (n - i - 1) * (x - F.coalesce(F.get(ages, i - 1), F.lit(0.0))))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / (4 * n - 4)


def path_to_root(node: Column, ptree="ptree") -> Column:
    """node, its parent, ..., the root."""
    p, _ = _arrays(ptree, ptree)
    steps = F.sequence(F.lit(1), F.size(p))
    up = lambda path: F.get(p, F.element_at(path, -1))
    return F.aggregate(steps, F.array(node), lambda path, _: F.when(up(path) >= 0, F.concat(path, F.array(up(path)))).otherwise(path))


def leaf_distance(a: Column, b: Column, ptree="ptree", age="age") -> Column:
    """Length of the path between two leaves, through their lowest common ancestor."""
    _, ages = _arrays(ptree, age)
    meet = F.get(F.array_intersect(path_to_root(a, ptree), path_to_root(b, ptree)), F.lit(0))
    return 2 * F.get(ages, meet) - F.get(ages, a) - F.get(ages, b)


def clades(ptree="ptree") -> Column:
    """For each node the sorted leaves below it."""
    return forest.clades(F.col(ptree) if isinstance(ptree, str) else ptree)


def topology_hash(ptree="ptree") -> Column:
    """Equal for trees with the same clades, whatever their node numbers."""
    return F.xxhash64(F.array_sort(F.transform(clades(ptree), lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ","))))


def tmrca_half(ptree="ptree", age="age") -> Column:
    return forest.half_age(*_arrays(ptree, age))


def coal_counts(trees: DataFrame, keys: list[str], grid: list[float]) -> DataFrame:
    """Coalescences of each tree (by `keys`) at each grid time, by nearest time."""
    ages = trees.select(*keys, F.explode(internal_ages()).alias("t"))
    return ages.groupBy(*keys, nearest_time(F.col("t"), grid).alias("time_bin")).agg(F.count(F.lit(1)).alias("n_coal"))


def lineage_counts(trees: DataFrame, keys: list[str], grid: list[float]) -> DataFrame:
    """Branches of each tree, that above the root left out, that span each grid interval [t, next t); ages are at grid times. Counted in the tree's own row; nothing is shuffled."""
    found = trees.select(*keys, F.posexplode(forest.inner_branches(grid)(*_arrays())).alias("time_bin", "n_branches"))
    return found.filter("n_branches > 0").withColumn("n_branches", F.col("n_branches").cast("long"))


def coal_states(trees: DataFrame, keys: list[str], grid: list[float]) -> DataFrame:
    """Where a new leaf may join each tree: every branch with every grid time it has, the top time left out."""
    top = len(grid) - 1
    nodes = trees.select(*keys, F.posexplode(F.zip_with("ptree", "age", lambda up, x: F.struct(x.alias("low"), F.get(F.col("age"), up).alias("high")))).alias("node", "b"))
    low = nearest_time(F.col("b.low"), grid)
    high = F.when(F.col("b.high").isNull(), F.lit(top - 1)).otherwise(F.least(nearest_time(F.col("b.high"), grid), F.lit(top - 1)))
    return nodes.select(*keys, "node", low.alias("low"), high.alias("high")).filter("low <= high").select(*keys, "node", F.explode(F.sequence("low", "high")).alias("time_bin"))


def allele_age(derived: Column, ptree="ptree", age="age") -> Column:
    return forest.allele_age(derived, *_arrays(ptree, age))


def clade_rows(trees: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each internal clade of each tree: keys, clade (leaves joined by commas), size."""
    exploded = trees.select(*keys, F.explode(F.slice(clades("ptree"), n_leaves("ptree") + 1, F.size("ptree"))).alias("clade_leaves"))
    return exploded.select(*keys, F.array_join(F.transform("clade_leaves", lambda x: x.cast("string")), ",").alias("clade"), F.size("clade_leaves").alias("size"))


def split_regions(trees: DataFrame, mutations: DataFrame, width: int) -> DataFrame:
    """Mutations (chrom, pos, clade) with start and stop of the run of touching blocks (chrom, start, stop, ptree) around them whose trees all have the clade; without such a run a mutation is left out."""
    rows = clade_rows(trees, ["chrom", "start", "stop"]).join(mutations.select("chrom", "clade").distinct(), ["chrom", "clade"], "left_semi")
    key = F.struct("chrom", "clade")
    runs = merge_islands(rows.select(key.alias("chrom"), "start", "stop"), ["chrom"], ["start"], [], touching=True).drop("n_rows")
    found = join_points(mutations.select(key.alias("chrom"), "pos"), runs, width)
    return found.select("chrom.chrom", "pos", "chrom.clade", "start", "stop")


def majority_clades(trees: DataFrame, segment: list[str], share: float = 0.5) -> DataFrame:
    """Clades in more than `share` of a segment's trees: any two of them nest or are disjoint, so they are the consensus tree."""
    rows = clade_rows(trees, segment).groupBy(*segment, "clade", "size").agg(F.count(F.lit(1)).alias("n_trees"))
    total = trees.groupBy(*segment).agg(F.count(F.lit(1)).alias("n_all"))
    return rows.join(total, segment).filter(F.col("n_trees") > share * F.col("n_all"))


def consensus(trees: DataFrame, segment: list[str], share: float = 0.5) -> DataFrame:
    """The clades in more than `share` of a segment's trees, without leaves and the whole, with their mean age over these: segment, clade, n_trees, age."""
    inner = F.filter(F.arrays_zip(clades("ptree").alias("c"), F.col("age").alias("age")), lambda x: (F.size(x["c"]) > 1) & (F.size(x["c"]) < n_leaves("ptree")))
    rows = trees.select(*segment, F.explode(inner).alias("x"))
    counted = rows.groupBy(*segment, F.array_join(F.transform("x.c", lambda y: y.cast("string")), ",").alias("clade")).agg(F.count(F.lit(1)).alias("n_trees"), F.avg("x.age").alias("age"))
    total = trees.groupBy(*segment).agg(F.count(F.lit(1)).alias("n_all"))
    return counted.join(total, segment).filter(F.col("n_trees") > share * F.col("n_all")).drop("n_all")


def children(ptree="ptree") -> Column:
    """For each node the numbers of its children, in order: the tree seen from the root."""
    p, _ = _arrays(ptree, ptree)
    nodes = F.sequence(F.lit(0), F.size(p) - 1)
    return F.transform(nodes, lambda x: F.filter(nodes, lambda y: F.get(p, y) == x))


def sibling(node: Column, ptree="ptree") -> Column:
    p, _ = _arrays(ptree, ptree)
    return F.get(F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda x: (F.get(p, x) == F.get(p, node)) & (x != node)), F.lit(0))


def stub_length(grid: list[float], age="age") -> Column:
    """The grid interval above the root: the branch that carries on over it."""
    steps = F.array(*[F.lit(b - a) for a, b in zip(grid, grid[1:])])
    return F.get(steps, F.least(nearest_time(tmrca(age), grid), F.lit(len(grid) - 2)))


def branch_length_with(node: Column, time: Column, grid: list[float], ptree="ptree", age="age", basal: bool = False) -> Column:
    """Tree length once a leaf has joined the branch above `node` at a time; with `basal` the stub above the root then counts."""
    p, a = _arrays(ptree, age)
    above = F.get(p, node) < 0
    longer = tree_length(p, a) + time + F.when(above, time - tmrca(a)).otherwise(0.0)
    if not basal:
        return longer
    steps = F.array(*[F.lit(y - x) for x, y in zip(grid, grid[1:])])
    stub = F.when(above, F.get(steps, F.least(nearest_time(time, grid), F.lit(len(grid) - 2)))).otherwise(stub_length(grid, a))
    return longer + stub


def lineages(grid: list[float], ptree="ptree", age="age") -> Column:
    """struct(branches, points): branches between each grid time and the next, and branches that have each grid time, where they may be cut or joined. Arrow batches; nothing is shuffled."""
    return forest.lineages(grid)(*_arrays(ptree, age))


def popsize_by_time(trees: DataFrame, grid: list[float]) -> DataFrame:
    """time_bin, n_pairs, n_coal, popsize: half the interval's length times the pairs of lineages that enter it over those that join in it, 0 where none does. Trees count as independent."""
    counted = trees.select(n_leaves("ptree").alias("n"), lineages(grid).alias("x")).select("n", F.col("x.branches").alias("c"))
    pairs = F.transform(F.slice("c", 1, len(grid) - 1), lambda end, j: F.struct(F.when(j == 0, F.col("n")).otherwise(F.get("c", j - 1)).alias("start"), end.alias("end")))
    rows = counted.select(F.posexplode(pairs).alias("time_bin", "x"))
    sums = rows.groupBy("time_bin").agg(F.sum(F.expr("CAST(x.start AS BIGINT) * (x.start - 1) div 2")).alias("n_pairs"), F.sum(F.col("x.start") - F.col("x.end")).alias("n_coal"))
    steps = F.array(*[F.lit(b - a) for a, b in zip(grid, grid[1:])])
    return sums.withColumn("popsize", F.when(F.col("n_coal") == 0, F.lit(0.0)).otherwise(0.5 * F.get(steps, F.col("time_bin")) * F.col("n_pairs") / F.col("n_coal")))


def split_error(one: Column, two: Column) -> Column:
    """Over the clades of one tree, without leaves and the root's: the share of leaves by which the smallest clade of the other tree that holds it is larger, on average. Null if there is none."""
    n = F.array_max(F.transform(one, lambda c: F.size(c)))
    inner = F.filter(one, lambda c: (F.size(c) > 1) & (F.size(c) < n))
    smallest = lambda c: F.array_min(F.transform(F.filter(two, lambda d: F.size(F.array_except(c, d)) == 0), lambda d: F.size(d)))
    over = F.aggregate(inner, F.lit(0), lambda s, c: s + smallest(c) - F.size(c))
    return F.when(F.size(inner) > 0, over / (n * F.size(inner)))


def clade_difference(one: Column, two: Column) -> Column:
    """Clades that only one of two trees has."""
    return F.size(F.array_except(one, two)) + F.size(F.array_except(two, one))


def node_mapping(recomb_node: Column, ptree="ptree") -> Column:
    """Of each node its number behind an edit: the same, or -1 for the parent of the cut branch, which leaves its place."""
    p, _ = _arrays(ptree, ptree)
    return F.transform(p, lambda up, x: F.when(x == F.get(p, recomb_node), F.lit(-1)).otherwise(x))


def tree_faults(ptree="ptree", age="age") -> Column:
    """What is wrong with a tree, in words; empty if nothing is."""
    p, a = _arrays(ptree, age)
    nodes = F.sequence(F.lit(0), F.size(p) - 1)
    below = lambda x: F.size(F.filter(p, lambda up: up == x))
    faults = [
        (F.size(p) != F.size(a), "ages"),
        (F.size(F.filter(p, lambda up: up < 0)) != 1, "roots"),
        (F.exists(p, lambda up: up >= F.size(p)), "parents"),
        (F.exists(nodes, lambda x: F.when(x < n_leaves(p), below(x) != 0).otherwise(below(x) != 2)), "children"),
        (F.exists(nodes, lambda x: F.get(a, F.get(p, x)) < F.get(a, x)), "order of ages"),
    ]
    return F.filter(F.array(*[F.when(wrong, F.lit(word)) for wrong, word in faults]), lambda x: x.isNotNull())


def edit_faults(recomb_node: Column, recomb_time: Column, coal_node: Column, coal_time: Column, ptree="ptree", age="age") -> Column:
    """What is wrong with a subtree edit of a tree, in words."""
    p, a = _arrays(ptree, age)
    faults = [
        (F.get(p, recomb_node) < 0, "root cut"),
        ((recomb_time < F.get(a, recomb_node)) | (recomb_time > F.get(a, F.get(p, recomb_node))), "cut off its branch"),
        ((coal_time < F.get(a, coal_node)) | (coal_time > F.get(a, F.get(p, coal_node))), "joined off its branch"),
        (coal_time < recomb_time, "joined before the cut"),
        (F.array_contains(path_to_root(coal_node, p), recomb_node), "joined below the cut"),
    ]
    return F.filter(F.array(*[F.when(wrong, F.lit(word)) for wrong, word in faults]), lambda x: x.isNotNull())


def tree_statistics(trees: DataFrame, names: list[str]) -> DataFrame:
    """The statistics asked for as columns; no other is computed. "coalcount.<t>" counts joints at age t, "node_dist-a,b" is the path between two leaves."""
    known = {
        "tmrca": lambda: tmrca(), "branchlen": lambda: tree_length(), "tmrca_half": lambda: tmrca_half(),
        "rth": lambda: tmrca_half() / tmrca(), "popsize": lambda: tree_popsize(), "zero_len": lambda: zero_branches(),
        "breaks": lambda: 1 / (F.col("stop") - F.col("start")), "recomb": lambda: 1 / (tree_length() * (F.col("stop") - F.col("start"))),
    }

    def column(name: str) -> Column:
        if name.startswith("coalcount."):
            time = float(name.split(".", 1)[1])
            return F.size(F.filter(internal_ages(), lambda x: x == time))
        if name.startswith("node_dist-"):
            a, b = map(int, name.split("-", 1)[1].split(","))
            return F.when(n_leaves() > max(a, b), leaf_distance(F.lit(a), F.lit(b)))
        return known[name]()

    return trees.withColumns({name: column(name).cast("double") for name in names})
