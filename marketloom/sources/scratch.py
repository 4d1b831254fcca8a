"""Tables that a run writes for itself: in the folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only a local session without that setting gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="marketloom-")
    return f"{found.rstrip('/')}/marketloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a written table: its lineage is cut, and it outlives executors."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(table: DataFrame) -> None:
    """Deletes what ``written`` wrote, once nothing reads it any more."""
    spark = table.sparkSession
    for place in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
