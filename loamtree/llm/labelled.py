"""Labelled rows to learn from, and the rows that are held out."""

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; such rows are never learnt from. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def training_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text and label of labelled documents that are not held out: whole texts in the order of their id hashes, at most `rows` ids, and of these what fits in `most_bytes`.

    A document is learnt from whole or not at all; one that no longer fits is
    passed over. Of several labels of one id the largest counts; rows with one
    id go together. The ids, `rows` at most, come to the driver with the bytes
    of their texts; the documents are read twice and not moved.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(label).cast("double").alias("label")).filter("label_id IS NOT NULL AND label IS NOT NULL")
    known = known.filter(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("label").alias("label"))
    first = known.orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).alias("text"))
    sizes = texts.join(F.broadcast(first), "label_id").groupBy("label_id").agg(F.max("label").alias("label"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    chosen, left = [], most_bytes
    for r in sizes.orderBy(F.xxhash64("label_id"), "label_id").collect():
        if r.size <= left:
            chosen.append((r.label_id, r.label))
            left -= r.size
    wanted = docs.sparkSession.createDataFrame(chosen, "label_id long, label double")
    return texts.join(F.broadcast(wanted), "label_id").select("text", "label")
