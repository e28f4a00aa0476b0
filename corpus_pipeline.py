"""From raw documents to packed training sequences.

Each stage takes what its predecessor kept, as Parquet read again; all but the
last return the columns of documents.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loamtree.llm.exact_dedup import drop_exact_duplicates
from loamtree.llm.near_dedup import drop_near_duplicates
from loamtree.llm.packing import pack
from loamtree.llm.quality_rules import drop_poor_documents
from loamtree.llm.store import mark, materialize
from loamtree.llm.substring_dedup import cut_repeated_passages


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null ids among them; of rows with one id only those whose own text is poor. Null texts are empty and so go; null languages and sources are groups of their own. No rows give no rows; extra columns stay."""
    return drop_poor_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to the case of A-Z the largest id stays; repeated rows of that id stay, other texts of an id that goes stay. A null id is smaller than any other."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest id stays. Texts without words and null ids stay; of rows with one id only the copies go."""
    return drop_near_duplicates(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words go that a window of 50 words covers which an earlier document has; a document stays even if nothing is left of it. Null ids stay whole."""
    return cut_repeated_passages(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence of 1024 ids; a null or empty text is its end id alone, repeated rows are packed each on their own."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("substring dedup", substring), ("packing", packing)]

#: The robust estimates of the quality rules have no SQL form; tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. What a stage made on its way is deleted when its result is written."""
    begin, docs = mark(), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = materialize(docs, "stage-" + name.replace(" ", "-"), since=begin)
    return docs
