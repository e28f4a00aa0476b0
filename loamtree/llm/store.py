"""Intermediate tables in the folder that all executors share."""

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a folder of our own if everything runs on this machine; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loamtree-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class _Made(threading.local):
    """Folders of the intermediates that this thread's queries have made and that are still there."""

    def __init__(self):
        self.paths: list[str] = []


_made = _Made()


def mark() -> int:
    """A point in time for materialize(since=...) and discard()."""
    return len(_made.paths)


def discard(spark: SparkSession, since: int) -> None:
    """Deletes the intermediates made since a mark; nothing that is still to be read may depend on them."""
    files, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    while len(_made.paths) > since:
        path = jvm.org.apache.hadoop.fs.Path(_made.paths.pop())
        path.getFileSystem(files).delete(path, True)


def materialize(df: DataFrame, name: str, since: int | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    The copy cuts the lineage and outlives lost executors; its size is known to
    the planner. Folders are named after the application, so a finished
    application's intermediates can be removed as a whole. With `since`, those
    made since that mark are deleted, as only df was made from them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loamtree/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    if since is not None:
        discard(spark, since)
    _made.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of two long columns that are broadcast to a join with texts, about 100 MB; longer tables are shuffled with the texts.
MAX_BROADCAST_ROWS = 2_000_000


def small_side(rows: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A materialized table for a join with texts or their statistics: broadcast if it has at most `most` rows, so that the other side need not move."""
    return F.broadcast(rows) if rows.count() <= most else rows


def rows_of(docs: DataFrame, keyed: DataFrame, keys: list[str]) -> DataFrame:
    """docs, without the rows that no row of the materialized table `keyed` has the keys of, where these are few enough to broadcast: a join by them then moves fewer texts."""
    found = keyed.select(*keys)
    return docs.join(F.broadcast(found), keys, "left_semi") if found.count() <= MAX_BROADCAST_ROWS else docs


def drop_rows(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id and xxhash64 of the text are in the materialized table `dropped` (doc_id, text_hash); null ids and hashes match their like.

    The planner knows the table's size: it broadcasts it below
    spark.sql.autoBroadcastJoinThreshold and shuffles both sides above.
    """
    return docs.join(dropped, docs[id_col].eqNullSafe(dropped["doc_id"]) & F.xxhash64(docs[text_col]).eqNullSafe(dropped["text_hash"]), "left_anti")
