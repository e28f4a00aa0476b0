"""A folder for files on their way, which all executors must share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in spark.checkpoint.dir; where that is unset and everything runs on this machine, in a temporary folder."""
    home = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not home:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        home = "file://" + tempfile.mkdtemp(prefix="loamtree-scratch-")
    return f"{home.rstrip('/')}/loamtree/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(rows: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """rows as a table in the shared folder, where more than one step reads them; it outlives lost executors. A step that asks for one value of the columns `by` reads the files of that value alone."""
    path = scratch_folder(rows.sparkSession, name)
    rows.write.partitionBy(*by).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)
