"""Tables written between the steps of a job."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a session in one process may name none: then it is a new local one, since nothing else reads it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    kept = getattr(context, "_own_shared_dir", None)
    if kept is None:
        kept = context._own_shared_dir = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    return kept


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str = "table") -> DataFrame:
    """The same rows, written to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again._written_to = path
    return again


def rename(spark: SparkSession, source: str, target: str, over_empty: bool = False) -> bool:
    """Give a folder another name in one step; False if there is something under that name (an empty folder may be taken over)."""
    fs = spark._jvm.org.apache.hadoop.fs
    where = fs.Path(target)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where.getParent())
    option = getattr(getattr(fs, "Options$Rename"), "OVERWRITE" if over_empty else "NONE")
    options = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    options[0] = option
    try:
        fs.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else fs.FileSystem.get(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration()).rename(fs.Path(source), where, options)
    except Exception as x:
        if "FileAlreadyExists" in str(x) or "non empty" in str(x) or "non-empty" in str(x):
            return False
        raise
    return True


def discard(df: DataFrame) -> None:
    """Delete a table made by materialise() that nothing reads any more."""
    spark, path = df.sparkSession, df._written_to
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs whose results were written: it does so as the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
