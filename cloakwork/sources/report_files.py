"""Folders of reports as a Spark source and sink: one file a report, each in the code page that it declares.

    register(spark)
    spark.read.format("report_files").load(folder)
    df.select("rel_path", "encoding", "text").write.format("report_files").mode("append").save(folder)

Reading deals the files out by their bytes. Writing goes to a staging folder beside the target, which takes the target's name in
one step when all tasks are done; a job that fails leaves nothing, and a target that has something already is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.codecs import FALLBACK, decode_one, encode_one
from ..functions.shipping import ship

SCHEMA = "file_id string, rel_path string, length long, encoding string, text string, error string"
PARTITION_BYTES = 64 << 20


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ReportFiles)


class Files(InputPartition):
    """Files of one task, below the folder."""

    def __init__(self, names: list[str]) -> None:
        super().__init__(None)
        self.names = names


class ReportReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"].rstrip("/")
        self.fallback = tuple(x.strip() for x in options.get("fallback", ",".join(FALLBACK)).split(",") if x.strip())
        self.suffix = options.get("suffix", ".xml").lower()
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[Files]:
        files, root = FileSystem.from_uri(self.folder)
        found = files.get_file_info(FileSelector(root, recursive=True))
        names = sorted((x.path[len(root) :].lstrip("/"), x.size) for x in found if x.type == FileType.File and x.path.lower().endswith(self.suffix))
        parts, own, size = [], [], 0
        for name, n in names:
            if own and size + n > self.most:
                parts.append(Files(own))
                own, size = [], 0
            own.append(name)
            size += n
        return [*parts, Files(own)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, root = FileSystem.from_uri(self.folder)
        for name in partition.names:
            with files.open_input_stream(f"{root}/{name}") as f:
                data = f.read()
            text, encoding = decode_one(data, self.fallback)
            row = [f"{self.folder}/{name}", name, len(data), encoding, text, None if text is not None else "no code page fits"]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["file_id", "rel_path", "length", "encoding", "text", "error"])


class Written(WriterCommitMessage):
    def __init__(self, files: int) -> None:
        self.files = files


class ReportWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder = options["path"].rstrip("/")
        self.staged = f"{self.folder}.staging-{uuid.uuid4().hex}"
        if overwrite:
            raise ValueError("report_files does not overwrite: take another folder")
        files, root = FileSystem.from_uri(self.folder)
        there = files.get_file_info(root)
        if there.type == FileType.File or there.type == FileType.Directory and files.get_file_info(FileSelector(root)):
            raise ValueError(f"the target is not empty: {self.folder}")

    def write(self, rows: Iterator) -> Written:
        files, root = FileSystem.from_uri(self.staged)
        attempt, n, made = TaskContext.get().taskAttemptId(), 0, set()
        for row in rows:
            parts = row["rel_path"].split("/")
            if not all(parts) or any(p in (".", "..") or p.startswith(".part-") for p in parts):
                raise ValueError("a report's name must lie inside the folder")
            above = "/".join([root, *parts[:-1]])
            if above not in made:
                files.create_dir(above, recursive=True)
                made.add(above)
            # an attempt that is run again writes the same under the same name
            with files.open_output_stream(f"{above}/.part-{attempt}") as out:
                out.write(encode_one(row["text"], row["encoding"]) or b"")
            files.move(f"{above}/.part-{attempt}", f"{above}/{parts[-1]}")
            n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = FileSystem.from_uri(self.staged)
        files.create_dir(root, recursive=True)
        left = [x.path for x in files.get_file_info(FileSelector(root, recursive=True)) if x.path.rpartition("/")[2].startswith(".part-")]
        for path in left:  # of attempts that were stopped
            files.delete_file(path)
        target = FileSystem.from_uri(self.folder)[1]
        if files.get_file_info(target).type == FileType.Directory:
            files.delete_dir(target) if not files.get_file_info(FileSelector(target)) else None
        files.move(root, target)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = FileSystem.from_uri(self.staged)
        if files.get_file_info(root).type == FileType.Directory:
            files.delete_dir(root)


class ReportFiles(DataSource):
    """Options: path; fallback (code pages tried after the declared one, in order); suffix (.xml); partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "report_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ReportReader:
        return ReportReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(dict(self.options), overwrite)
