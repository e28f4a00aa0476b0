"""Exact duplicates by content sort, in DataFrame operations only."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .store import mark, materialize

#: Code points of a text that the splitters see.
HEAD = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text):
    """The text with A-Z in lower case and nothing else changed; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", salts: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are range-partitioned on (first bytes of the normalised text, its hash,
    salt) by splitters that Spark samples, so a sample is narrow whatever the
    texts, and sorted externally; a window over the sorted rows compares
    neighbouring texts in full, so equal ones form runs. The salt, a hash of the
    id, lets the range partitioner split a text with very many copies, which
    then forms up to `salts` runs. Only one narrow row per run goes on, and the
    runs of a text meet by its SHA-256.

    keep: which id stays, "smallest" or "largest". Null and empty texts are
    equal. Of repeated rows with the id that stays, one is kept. A null id is
    smaller than any other. No rows give no rows; other columns are ignored.
    """
    best, order = (F.min, F.asc_nulls_first) if keep == "smallest" else (F.max, F.desc_nulls_last)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.withColumns({"head": F.substring("norm", 1, HEAD), "hash": F.xxhash64("norm"), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")})
    run = Window.partitionBy("head", "hash", "norm", "salt")
    in_order = run.orderBy(order("doc_id"))
    placed = (
        rows.repartitionByRange("head", "hash", "salt")
        .withColumn("place", F.row_number().over(in_order))
        .withColumn("run_id", F.first("doc_id").over(in_order))
        .withColumn("run_size", F.count(F.lit(1)).over(run))
        .select("doc_id", "salt", "place", "run_id", "run_size", F.sha2("norm", 256).alias("text_sha256"))
    )
    placed = materialize(placed, "exact-runs")
    heads = placed.filter("place = 1").select("text_sha256", "salt", "run_id", "run_size")
    null_best = F.max(F.col("run_id").isNull()) if keep == "smallest" else F.lit(False)
    totals = heads.groupBy("text_sha256").agg(best("run_id").alias("some_id"), null_best.alias("none"), F.sum("run_size").alias("group_size"))
    totals = totals.select("text_sha256", F.when(~F.col("none"), F.col("some_id")).alias("keep_id"), "group_size")
    settled = heads.select("text_sha256", "salt").join(totals, "text_sha256")
    return placed.join(settled, ["text_sha256", "salt"]).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("place") == 1)).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """docs without those whose text another id keeps; repeated rows of the id that stays all stay. Of rows with one id only those go whose text is a copy.

    A null id is smaller than any other, so it goes where another id keeps its text.
    """
    begin = mark()
    found = exact_dedup(docs, keep=keep).filter("NOT doc_id <=> keep_id").select("doc_id", F.unhex("text_sha256").alias("digest"))
    dropped = materialize(found.distinct(), "exact-dropped", since=begin)
    digest = F.unhex(F.sha2(normalised(docs["text"]), 256))
    return docs.join(dropped, docs["doc_id"].eqNullSafe(dropped["doc_id"]) & (digest == dropped["digest"]), "left_anti")


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


OP2_SQL = f"""
WITH norm AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
FROM norm
"""
