"""Daily bars as a stream: each micro-batch is merged by key into a Parquet table that panels read.

The batch job has no stream to match; this keeps its input fresh with the same batch code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """One row per (date, symbol): the one that came last, by batch and, within a batch, by ``arrived`` if bars
    have such a column; of equal arrival the higher price, so that reruns agree."""
    both = new.withColumn("_new", F.lit(1)) if old is None else new.withColumn("_new", F.lit(1)).unionByName(old.withColumn("_new", F.lit(0)))
    last = Window.partitionBy("date", "symbol").orderBy(F.desc("_new"), *([F.desc("arrived")] if "arrived" in new.columns else []), F.desc("price"))
    return both.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k", "_new")


def refresh(bars: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream; batch b writes ``folder``/v=b from the version before it, so a rerun is safe.

    Only the last two versions are kept: the newest, and the one that its batch would be rerun from.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = version(spark, folder, number - 1)
        merge(old, batch).write.mode("overwrite").parquet(f"{folder}/v={number}")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v={number - 2}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return bars.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def version(spark: SparkSession, folder: str, number: int) -> DataFrame | None:
    return spark.read.parquet(f"{folder}/v={number}") if number >= 0 else None
