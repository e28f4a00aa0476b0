"""The line formats. Whole directories are read at once; the file a line is from names its sample or dataset.

gzip files are read but not split: load them into Parquet once (store()).
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def _field(i: int, kind: str = "string"):
    return F.get(F.split("value", "\t"), F.lit(i)).cast(kind)


def read_track(spark: SparkSession, path) -> DataFrame:
    """chrom, start, stop, value: tab-separated and half-open; value is null in a mask of three columns."""
    return _lines(spark, path).filter("value <> ''").select(_field(0).alias("chrom"), _field(1, "long").alias("start"), _field(2, "long").alias("stop"), _field(3, "double").alias("value"))


def read_sites(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Sites (file, chrom, pos, col) with 0-based positions, and names (file, place, name). The file has NAMES and REGION lines, then 1-based positions."""
    lines = _lines(spark, path)
    names = lines.filter(F.col("value").startswith("NAMES\t")).select("file", F.posexplode(F.slice(F.split("value", "\t"), 2, 1 << 20)).alias("place", "name"))
    regions = lines.filter(F.col("value").startswith("REGION\t")).select("file", _field(1).alias("chrom"))
    body = lines.filter(F.col("value").rlike("^[0-9]")).select("file", (_field(0, "long") - 1).alias("pos"), F.upper(_field(1)).alias("col"))
    return body.join(F.broadcast(regions), "file").select("file", "chrom", "pos", "col"), names


def site_violations(sites: DataFrame, names: DataFrame) -> DataFrame:
    """Sites whose width is not the number of names, with other symbols than A C G T N, or at a repeated position, with the reason."""
    width = names.groupBy("file").agg(F.count(F.lit(1)).alias("n_names"))
    checked = sites.join(width, "file", "left").withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("file", "chrom", "pos")))
    reason = F.when(F.length("col") != F.coalesce("n_names", F.lit(0)), "width").when(~F.col("col").rlike("^[ACGTN]+$"), "symbol").when(F.col("times") > 1, "repeated position")
    return checked.withColumn("reason", reason).filter("reason IS NOT NULL").select("file", "chrom", "pos", "reason")


def _write_ranges(body: DataFrame, header: list[str], keys: list[str], path: str) -> None:
    """Lines (value) in files by ranges of the keys, in order, each file with the header of its own that readers join its lines to. Without lines there is no header either."""

    def headed(batches):
        import pyarrow as pa

        due = True
        for batch in batches:
            if due and batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(header)], ["value"])
                due = False
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    body.repartitionByRange(*keys).sortWithinPartitions(*keys).select("value").mapInArrow(headed, "value string").write.text(path)


def write_sites(sites: DataFrame, names: list[str], chrom: str, start: int, stop: int, path: str) -> None:
    """Text files of one chromosome by ranges of positions, 1-based as the format asks for: each has the names, the whole region and a sorted body."""
    body = sites.filter(F.col("chrom") == chrom).select(F.col("pos").alias("at"), F.concat_ws("\t", (F.col("pos") + 1).cast("string"), "col").alias("value"))
    _write_ranges(body, ["NAMES\t" + "\t".join(names), f"REGION\t{chrom}\t{start + 1}\t{stop}"], ["at"], path)


def variable_sites(sites: DataFrame) -> DataFrame:
    """Sites whose column has two symbols or more: what write_sites() is given where invariant columns are not to be kept."""
    return sites.filter(F.replace("col", F.substring("col", 1, 1), F.lit("")) != "")


def read_smc(spark: SparkSession, path, sample: str = r"\.(\d+)\.[^/]*$") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trees (sample, chrom, start, stop, newick), edits (sample, chrom, pos, recomb_node, recomb_time, coal_node, coal_time) and names (sample, place, name).

    sample: a pattern whose first group in the file's name is the sample number.
    Rows are 1-based and closed: TREE start end newick; SPR pos recomb_node
    recomb_time coal_node coal_time, pos being the last base of the left block,
    which is the first of the right one counted from 0.
    """
    lines = _lines(spark, path).withColumn("sample", F.regexp_extract("file", sample, 1).try_cast("long"))
    names = lines.filter(F.col("value").startswith("NAMES\t")).select("sample", F.posexplode(F.slice(F.split("value", "\t"), 2, 1 << 20)).alias("place", "name")).distinct()
    chroms = F.broadcast(lines.filter(F.col("value").startswith("REGION\t")).select("file", _field(1).alias("chrom")))
    trees = lines.filter(F.col("value").startswith("TREE\t")).join(chroms, "file")
    sprs = lines.filter(F.col("value").startswith("SPR\t")).join(chroms, "file")
    return (
        trees.select("sample", "chrom", (_field(1, "long") - 1).alias("start"), _field(2, "long").alias("stop"), _field(3).alias("newick")),
        sprs.select("sample", "chrom", _field(1, "long").alias("pos"), _field(2, "int").alias("recomb_node"), _field(3, "double").alias("recomb_time"), _field(4, "int").alias("coal_node"), _field(5, "double").alias("coal_time")),
        names,
    )


def write_smc(trees: DataFrame, sprs: DataFrame, names: list[str], chrom: str, path: str) -> None:
    """Text files of one sample and chromosome by ranges of positions, trees and edits in order; each has the names and the whole region."""
    ends = trees.filter(F.col("chrom") == chrom).agg(F.min("start"), F.max("stop")).first()
    header = ["NAMES\t" + "\t".join(names), f"REGION\t{chrom}\t{(ends[0] or 0) + 1}\t{ends[1] or 0}"]
    text = lambda *cs: F.concat_ws("\t", *[c.cast("string") for c in cs])
    body = trees.filter(F.col("chrom") == chrom).select(F.col("start").alias("at"), F.lit(1).alias("kind"), text(F.lit("TREE"), F.col("start") + 1, F.col("stop"), F.col("newick")).alias("value"))
    edits = sprs.filter(F.col("chrom") == chrom).select(F.col("pos").alias("at"), F.lit(0).alias("kind"), text(F.lit("SPR"), *[F.col(c) for c in ("pos", "recomb_node", "recomb_time", "coal_node", "coal_time")]).alias("value"))
    _write_ranges(body.unionByName(edits), header, ["at", "kind"], path)


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """file, name (the whole header line) and seq."""
    records = spark.read.option("lineSep", ">").text(path).select("value", F.col("_metadata.file_path").alias("file")).filter("trim(value) <> ''")
    rest = F.regexp_replace(F.substring(F.col("value"), F.instr("value", "\n") + 1, F.length("value")), r"\s", "")
    return records.select("file", F.trim(F.substring_index("value", "\n", 1)).alias("name"), F.upper(rest).alias("seq"))


def write_fasta(haplotypes: DataFrame, path: str) -> None:
    haplotypes.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq")).write.text(path)


def fasta_to_sites(haplotypes: DataFrame, chrom: str) -> DataFrame:
    """Variant columns of aligned haplotypes (place, seq): chrom, pos, col, one base per haplotype by place."""
    bases = haplotypes.select("place", F.posexplode(F.split("seq", "")).alias("pos", "base")).filter("base <> ''")
    columns = bases.groupBy(F.col("pos").cast("long").alias("pos")).agg(F.sort_array(F.collect_list(F.struct("place", "base"))).alias("x"))
    col = F.array_join(F.transform("x", lambda s: s["base"]), "")
    return columns.filter(F.size(F.array_distinct(F.transform("x", lambda s: s["base"]))) > 1).select(F.lit(chrom).alias("chrom"), "pos", col.alias("col"))


def read_arg(spark: SparkSession, path) -> DataFrame:
    """file, name, event, age, pos, parents, children of a graph file; the lines before the nodes (start=..., name ...) are skipped."""
    body = _lines(spark, path).filter(F.col("value").contains("\t") & ~F.col("value").startswith("start=") & ~F.col("value").startswith("name\t"))
    names = lambda i: F.filter(F.split(F.coalesce(_field(i), F.lit("")), ","), lambda x: x != "")
    return body.select("file", _field(0).alias("name"), _field(1).alias("event"), _field(2, "double").alias("age"), _field(3, "double").alias("pos"), names(4).alias("parents"), names(5).alias("children"))


def read_snp_bed(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """chrom, pos, col of chrom, start, stop, alleles lines, and names (place, name) of the #NAMES line."""
    lines = _lines(spark, path)
    names = lines.filter(F.col("value").startswith("#NAMES\t")).select(F.posexplode(F.slice(F.split("value", "\t"), 2, 1 << 20)).alias("place", "name"))
    return lines.filter(~F.col("value").startswith("#") & (F.col("value") != "")).select(_field(0).alias("chrom"), _field(1, "long").alias("pos"), F.upper(_field(3)).alias("col")), names


def read_lines(spark: SparkSession, path) -> list[str]:
    """A short list file: times, sizes or names, one per line."""
    return [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]


def store(rows: DataFrame, path: str, keys: list[str], load: int, mode: str = "append") -> None:
    """Appends a load to a Parquet table by chromosome, in ranges of (chrom, keys) so that a long chromosome is written by many tasks and range predicates skip files. `load` orders loads for operators.ordered.latest()."""
    placed = rows.withColumn("load", F.lit(load)).repartitionByRange("chrom", *keys).sortWithinPartitions("chrom", *keys)
    placed.write.mode(mode).partitionBy("chrom").parquet(path)


def _write(rows: DataFrame, path: str, *columns) -> None:
    """Tab-separated lines, in the parts that the rows are in; null is an empty field."""
    rows.select(F.concat_ws("\t", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns])).write.text(path)


def write_track(track: DataFrame, path: str) -> None:
    _write(track, path, "chrom", "start", "stop", *(["value"] if "value" in track.columns else []))


def fasta_faults(haplotypes: DataFrame) -> DataFrame:
    """file, name, length of the sequences that are shorter than the longest of their file: an alignment needs one length."""
    sized = haplotypes.select("file", "name", F.length("seq").alias("length"))
    return sized.join(sized.groupBy("file").agg(F.max("length").alias("longest")), "file").filter("length < longest").drop("longest")


def write_snp_bed(sites: DataFrame, names: list[str], path: str) -> None:
    """chrom, start, stop, alleles lines in parts; each has the #NAMES line, so each can be read by itself."""
    head = "#NAMES\t" + "\t".join(names)
    lines = sites.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), (F.col("pos") + 1).cast("string"), "col").alias("value"))
    lines.mapInArrow(_with_head(head), "value string").write.text(path)


def _with_head(head: str):
    import pyarrow as pa

    def add(batches):
        first = True
        for batch in batches:
            if first:
                yield pa.RecordBatch.from_arrays([pa.array([head], batch.schema.field(0).type)], schema=batch.schema)
                first = False
            yield batch

    return add


def biallelic_snps(sites: DataFrame) -> DataFrame:
    """Sites of a SNP file with exactly two symbols other than N, and the rarer one, `minor`; of two as frequent the first in the alphabet."""
    parts = F.filter(F.split("col", ""), lambda x: ~x.isin("", "N"))
    counted = F.transform(F.array_distinct(parts), lambda a: F.struct(F.size(F.filter(parts, lambda x: x == a)).alias("n"), a.alias("a")))
    return sites.withColumn("x", counted).filter("size(x) = 2").withColumn("minor", F.array_min("x")["a"]).drop("x")


def write_tree_bed(trees: DataFrame, path: str) -> None:
    """chrom, start, stop, sample, newick lines."""
    _write(trees, path, "chrom", "start", "stop", "sample", "newick")


def read_tree_bed(spark: SparkSession, path) -> DataFrame:
    lines = _lines(spark, path).filter("value <> '' AND value NOT LIKE '#%'")
    return lines.select(_field(0).alias("chrom"), _field(1, "long").alias("start"), _field(2, "long").alias("stop"), _field(3, "long").alias("sample"), _field(4).alias("newick"))


def smc_to_bed(trees: DataFrame, sprs: DataFrame) -> DataFrame:
    """sample, chrom, start, stop, newick, and recomb_time and coal_time of the edit behind the tree; null for the last of a chromosome."""
    edits = sprs.select("sample", "chrom", F.col("pos").alias("stop"), "recomb_time", "coal_time")
    return trees.join(edits, ["sample", "chrom", "stop"], "left").select("sample", "chrom", "start", "stop", "newick", "recomb_time", "coal_time")


def write_layout(layouts: DataFrame, path: str) -> None:
    """chrom, start, stop (from 1, closed, in the file), then name and y of each leaf of the map `ys`, by name."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("ys")), lambda e: F.concat(e["key"], F.lit("\t"), e["value"].cast("string"))), "\t")
    _write(layouts, path, "chrom", F.col("start") + 1, "stop", pairs)


def read_layout(spark: SparkSession, path, region: tuple[str, int, int] | None = None) -> DataFrame:
    """chrom, start, stop, ys; of the blocks that share a base with a region, if one is given."""
    fields = F.split("value", "\t")
    entries = F.transform(F.sequence(F.lit(0), F.floor((F.size(fields) - 3) / 2).cast("int") - 1), lambda i: F.struct(F.get(fields, 3 + 2 * i), F.get(fields, 4 + 2 * i).cast("double")))
    found = _lines(spark, path).filter("value <> ''").select(_field(0).alias("chrom"), (_field(1, "long") - 1).alias("start"), _field(2, "long").alias("stop"), F.map_from_entries(entries).alias("ys"))
    if region:
        found = found.filter((F.col("chrom") == region[0]) & (F.col("start") < region[2]) & (F.col("stop") > region[1]))
    return found


def read_name_pairs(spark: SparkSession, path) -> DataFrame:
    """one, two: the names of the two haplotypes of each line, parted by white space."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter("trim(value) <> ''").select(F.get(parts, F.lit(0)).alias("one"), F.get(parts, F.lit(1)).alias("two"))


def write_mutations(mutations: DataFrame, path: str) -> None:
    """pos, age, leaves lines; the leaves are names joined by commas."""
    _write(mutations, path, "pos", "age", F.array_join("leaves", ","))


def read_mutations(spark: SparkSession, path) -> DataFrame:
    leaves = F.filter(F.split(F.coalesce(_field(2), F.lit("")), ","), lambda x: x != "")
    return _lines(spark, path).filter("value <> ''").select(_field(0, "double").alias("pos"), _field(1, "double").alias("age"), leaves.alias("leaves"))


STATS = "stage string, iter int, prior double, likelihood double, joint double, recombs int, noncompats int, arglen double"


def append_run_stats(stats: DataFrame, path: str) -> None:
    """Appends lines of a run's statistics, with a header in each part."""
    names = [c.split()[0] for c in STATS.split(", ")]
    stats.select(*names).write.mode("append").option("sep", "\t").option("header", True).csv(path)


def read_run_stats(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(STATS).option("sep", "\t").option("header", True).csv(path)


def last_iteration(stats: DataFrame) -> DataFrame:
    """Each stage with its last iteration, from which a run resumes."""
    return stats.groupBy("stage").agg(F.max("iter").alias("iter"))


def write_arg(nodes: DataFrame, start: int, stop: int, path: str) -> None:
    """Graph files by ranges of names: each has the header, then name, event, age, pos, parents, children of each node."""
    lists = [F.array_join(c, ",") for c in ("parents", "children")]
    body = nodes.select("name", F.concat_ws("\t", "name", "event", F.col("age").cast("string"), F.col("pos").cast("string"), *lists).alias("value"))
    _write_ranges(body, [f"start={start}\tend={stop}", "name\tevent\tage\tpos\tparents\tchildren"], ["name"], path)


def clip_smc(trees: DataFrame, sprs: DataFrame, chrom: str, start: int, stop: int) -> tuple[DataFrame, DataFrame]:
    """The trees that share a base with [start, stop), cut to it, and the edits inside it. Predicates reach a Parquet scan."""
    from ..operators.intervals import clipped, overlapping

    return clipped(overlapping(trees, chrom, start, stop), start, stop), sprs.filter((F.col("chrom") == chrom) & (F.col("pos") > start) & (F.col("pos") < stop))


def renamed_leaves(trees: DataFrame, names: DataFrame) -> DataFrame:
    """Parsed trees (tree.names with the leaves' places as text) whose leaves have the names of the table (place, name)."""
    known = F.broadcast(names.agg(F.map_from_entries(F.collect_list(F.struct(F.col("place").cast("string"), "name"))).alias("known")))
    named = trees.crossJoin(known)
    return named.withColumn("names", F.transform("tree.names", lambda x: F.coalesce(F.col("known")[x], x))).drop("known")
