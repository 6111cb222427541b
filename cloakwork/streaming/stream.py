"""De-identification of arriving rows, and numbering of patients batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.crosswalk import continue_pseudo_ids
from ..operators.elements import deid_elements
from ..rules import Policy


def stream_deid(arriving: DataFrame, tokens: DataFrame, policy: Policy = Policy(), **options) -> DataFrame:
    """The same columns as the batch job: a stream-static join and projections, no state."""
    return deid_elements(arriving, tokens, policy, **options)


def run_available(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> None:
    """Write everything that is there to `path` as Parquet, each batch once."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()


def latest_crosswalk(spark: SparkSession, root: str, batch: int | None = None) -> DataFrame:
    """The newest finished version (before `batch`, if given); an empty table if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = []
    if files.exists(folder):
        for x in files.listStatus(folder):
            name = x.getPath().getName()
            if name.startswith("batch=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/_SUCCESS")):
                done.append(int(name[6:]))
    done = [b for b in done if batch is None or b < batch]
    schema = "patient_key string, pseudo_id string"
    return spark.read.schema(schema).parquet(f"{root}/batch={max(done)}") if done else spark.createDataFrame([], schema)


def assign_batch(root: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch writes a new version of the crosswalk under its own number, so a batch run again gives the same."""

    def run(batch: DataFrame, number: int) -> None:
        before = latest_crosswalk(batch.sparkSession, root, number)
        continue_pseudo_ids(batch.select("patient_key"), before).select("patient_key", "pseudo_id").write.mode("overwrite").parquet(f"{root}/batch={number}")

    return run


def stream_assign(arriving: DataFrame, root: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """New patients of each batch get the next numbers, old ones keep theirs."""
    return arriving.writeStream.foreachBatch(assign_batch(root)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
