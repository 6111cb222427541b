"""Folders that appear whole or not at all, and to one writer only.

What is to be published is written to a staging folder beside the target, with a manifest of its files, and takes the target's name in one
step. While that goes on the target is claimed by a file that only one writer can create, so a second run is refused before it
writes anything; if both got past it, only one could take the name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..functions.tables import rename

MANIFEST = "_manifest"


def _hadoop(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def claim(spark: SparkSession, target: str) -> str:
    """Create the target's claim, or refuse; gives its path. One that a killed run has left is removed by release_claim()."""
    path = f"{target.rstrip('/')}.claim"
    where, files = _hadoop(spark, path)
    files.mkdirs(where.getParent())
    fs = spark._jvm.org.apache.hadoop.fs
    if where.toUri().getScheme() in (None, "file") and files.getScheme() == "file":
        try:  # the local file system of Hadoop looks first and creates then
            spark._jvm.java.nio.file.Files.createFile(spark._jvm.java.io.File(where.toUri().getPath()).toPath(), spark.sparkContext._gateway.new_array(spark._jvm.java.nio.file.attribute.FileAttribute, 0))
        except Exception as x:
            if "FileAlreadyExists" in str(x):
                raise ValueError(f"another run writes to {target}") from None
            raise
        return path
    try:
        files.create(where, False).close()
    except Exception as x:
        if "FileAlreadyExists" in str(x) or files.exists(fs.Path(path)):
            raise ValueError(f"another run writes to {target}") from None
        raise
    return path


def release_claim(spark: SparkSession, target: str) -> None:
    where, files = _hadoop(spark, f"{target.rstrip('/')}.claim")
    files.delete(where, False)


def _digests(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch["name"].to_pylist():
                files, path = FileSystem.from_uri(f"{root}/{name}")
                sha = hashlib.sha256()
                with files.open_input_stream(path) as f:
                    while piece := f.read(1 << 20):
                        sha.update(piece)
                found.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch["name"], batch["bytes"], pa.array(found, pa.string())], names=["name", "bytes", "sha256"])

    return digest


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(name, bytes, sha256) of the data files below a folder; the tasks read them piece by piece."""
    ship(spark)
    where, files = _hadoop(spark, folder)
    root = files.makeQualified(where).toString().rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"))
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+:)/+", "$1/")
    name = F.substring(plain(F.col("path")), F.char_length(plain(F.lit(root))) + 2, F.char_length("path"))
    return listed.select(name.alias("name"), "bytes").mapInArrow(_digests(root), "name string, bytes long, sha256 string")


def changed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, what) of the files that are not as the manifest of a published folder has them: missing, added or changed."""
    told = spark.read.schema("name string, bytes long, sha256 string").parquet(f"{folder}/{MANIFEST}").alias("a")
    now = manifest(spark, folder).where(~F.startswith("name", F.lit(f"{MANIFEST}/"))).alias("b")
    both = told.join(now, "name", "full")
    what = F.when(F.col("b.sha256").isNull(), "missing").when(F.col("a.sha256").isNull(), "added").when(F.col("a.sha256") != F.col("b.sha256"), "changed")
    return both.select("name", what.alias("what")).where("what is not null")


def publish(spark: SparkSession, target: str, put: Callable[[str], None]) -> None:
    """Let `put` write below a staging folder, add the manifest, and give the folder the target's name.

    Raises ValueError if another run has claimed the target or has been faster; then, or if `put` fails, the staging folder goes and nothing is
    visible under the target's name.
    """
    target = target.rstrip("/")
    claim(spark, target)
    staged = f"{target}.staging-{uuid.uuid4().hex}"
    try:
        put(staged)
        manifest(spark, staged).write.parquet(f"{staged}/{MANIFEST}")
        if not rename(spark, staged, target, over_empty=True):
            raise ValueError(f"the target is not empty: {target}")
    finally:
        where, files = _hadoop(spark, staged)
        files.delete(where, True)
        release_claim(spark, target)
