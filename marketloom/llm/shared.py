"""What the operators of this subpackage share: tables, the shared folder, written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word; every other character belongs to one.
SPACES = r"[\x20\x09-\x0D]+"
#: Files of shards or archives, which have a stated size, that a task reads one after the other.
FILES_PER_TASK = 8
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    All that this application writes lies in one folder there, which ``sweep`` deletes. Only a local
    session without that setting gets a folder of its own.
    """
    app = spark.sparkContext.applicationId
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        if found not in _OWN:  # a folder without a scheme is in Spark's own file system, not on each machine's disk
            path = spark._jvm.org.apache.hadoop.fs.Path(found)
            _OWN[found] = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        return f"{_OWN[found].rstrip('/')}/marketloom-{app}"
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="marketloom-")
    return _OWN[app]


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, what: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and outlives executors."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Delete everything this application wrote, once its results have been used: they are read from there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete what ``saved`` wrote, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Bound the rows and bytes that Arrow hands to a Python worker at once; texts can be long.

    The setting is read when the job runs, after the operator has returned, so it stays; it is only ever
    lowered, and results do not depend on it.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        held = int(spark.conf.get(name).rstrip("bB"))  # 0 or less: no bound
        if not 0 < held <= most:
            spark.conf.set(name, str(most))


def tasks_for(spark: SparkSession, files: int) -> int:
    """Tasks that read ``files`` files: ``FILES_PER_TASK`` files each, but no fewer than a few tasks a core."""
    return max(1, -(-files // FILES_PER_TASK), min(files, 4 * spark.sparkContext.defaultParallelism))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def filesystem(uri: str):
    """(pyarrow file system, path) of a shared folder, for use inside tasks; raises if it cannot be reached."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    return fs.FileSystem.from_uri(f"file://{rest}" if scheme == "file" and not rest.startswith("//") else uri)
