"""What the operators share: the cluster's shared folder, written intermediate tables, and the package on the executors."""

from __future__ import annotations

from pyarrow.fs import FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship as ship
from ..functions.tables import discard as discard
from ..functions.tables import materialise as materialise
from ..functions.tables import new_folder as new_folder
from ..functions.tables import release as release
from ..functions.tables import shared_dir as shared_dir

#: White space as the contracts define it: blank and \t \n \v \f \r.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """A text, null as the empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def make_folder(spark: SparkSession, folder: str) -> None:
    """So that a folder nothing is written to can be read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """The table with columns of these names renamed, for an operator that needs the names itself, and how to rename them back."""
    taken, moved = set(df.columns) | set(names), {}
    for c in df.columns:
        if c in names:
            other = f"{c}_own"
            while other in taken:
                other += "_"
            taken.add(other)
            moved[c] = other
    return df.withColumnsRenamed(moved), {other: c for c, other in moved.items()}


def put(folder: str, name: str, data: bytes, attempt: int) -> str:
    """A whole file or none: written under another name first; attempts of a task write the same bytes."""
    files, root = FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/.{name}.{attempt}") as out:
        out.write(data)
    try:
        files.move(f"{root}/.{name}.{attempt}", f"{root}/{name}")
    except OSError:
        if files.get_file_info(f"{root}/{name}").type != FileType.File:
            raise
        files.delete_file(f"{root}/.{name}.{attempt}")  # an earlier attempt has put the same there
    return f"{folder}/{name}"
