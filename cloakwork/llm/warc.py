"""WARC archives: a writer with revisit records, and a reader that salvages what damage leaves.

Records are gzip members of their own. The reader checks every record (member, header, length, end mark and
digests). Where a check fails it looks for the next member or version line that begins a valid record, goes
on there, and reports the bytes in between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import make_folder, materialise, new_folder, put, ship

VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 16 << 20
RECORD = "path string, at long, length long, kind string, reason string, row_id long, target_uri string, refers_to long, payload_digest string, payload_bytes long"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
VERSION_BYTES = 10
_END = re.compile(re.escape(END))
_MEMBER = b"\x1f\x8b\x08"
_MEMBERS = re.compile(re.escape(_MEMBER))
WINDOW, PIECE = 4 << 20, 1 << 16
#: A header of this length without an end is none.
MOST_HEADER = 16 << 20
#: Stores that tasks open themselves, to read archives in ranges; of others Spark hands over whole files.
OPENED = ("", "file", "hdfs", "s3", "gs")
_NUMBER = re.compile(r"-?[0-9]{1,18}").fullmatch


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(kind: str, row_id: int | None, uri: str, payload: bytes, sha1: str, refers_to: int | None, date: str) -> bytes:
    """One record, uncompressed. Extension fields carry the row id, and of a revisit the full payload's length."""
    http = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    block = "\r\n".join(http).encode() + END + (payload if kind == "response" else b"")
    name = lambda i: f"<urn:uuid:{hashlib.md5(f'{i} {uri} {sha1}'.encode()).hexdigest()}>"
    fields = {"WARC-Type": kind, "WARC-Record-ID": name(row_id), "WARC-Date": date}
    if uri:
        fields["WARC-Target-URI"] = re.sub(r"[\r\n]", " ", uri)
    fields |= {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{sha1}", "WARC-Block-Digest": f"sha1:{digest(block)}"}
    if row_id is not None:
        fields["X-Row-Id"] = row_id
    if kind == "revisit":
        fields |= {"WARC-Profile": REVISIT, "X-Refers-To-Row-Id": refers_to, "X-Payload-Length": len(payload)}
    fields["Content-Length"] = len(block)
    fields["X-Header-Digest"] = header_digest({k.lower(): str(v).encode().strip().decode() for k, v in fields.items()})
    head = "\r\n".join(f"{k}: {v}" for k, v in fields.items())
    return b"".join([VERSION, b"\r\n", head.encode(), END, block, END])


def header_digest(fields: dict[str, str]) -> str:
    """The digest of all fields but itself, whatever their order."""
    return "sha1:" + digest("\n".join(f"{k}:{v}" for k, v in sorted(fields.items()) if k != "x-header-digest").encode("utf-8", "surrogateescape"))


def same_sha1(told: str, data: bytes) -> bool:
    """Whether a field's SHA-1 (after its label, in base32 or hex, in any case) is that of the data."""
    value = told.partition(":")[2].strip()
    return value.lower() == hashlib.sha1(data).hexdigest() if len(value) == 40 else value.upper() == digest(data)


#: Extension fields that hold numbers.
NUMBERS = ("x-row-id", "x-refers-to-row-id", "x-payload-length")


class Damaged(ValueError):
    pass


class Ranged:
    """Bytes that are read in ranges; one window of them is held."""

    def __init__(self, read: Callable[[int, int], bytes], size: int) -> None:
        self.read, self.size, self.base, self.data = read, size, 0, b""

    @classmethod
    def of(cls, raw: bytes) -> Ranged:
        return cls(lambda at, n: raw[at : at + n], len(raw))

    def get(self, at: int, n: int) -> bytes:
        n = min(n, max(0, self.size - at))
        if not self.base <= at <= at + n <= self.base + len(self.data):
            self.base, self.data = at, self.read(at, min(max(n, WINDOW), self.size - at))
        return self.data[at - self.base : at - self.base + n]

    def search(self, pattern: re.Pattern, at: int, width: int, until: int | None = None) -> int:
        """Where a match of `width` bytes begins (before `until`), or -1."""
        while at < (self.size if until is None else min(until, self.size)):
            piece = self.get(at, WINDOW)
            if found := pattern.search(piece):
                return at + found.start()
            if at + len(piece) >= self.size:
                break
            at += len(piece) - width + 1
        return -1

    def ended(self, at: int) -> bool:
        return at >= self.size

    def forget(self, at: int) -> None:
        pass


class Inflated:
    """The content of the gzip member at `at`, inflated as far as it is asked for; what was read may be forgotten.

    At the end, hurt says what was wrong with the member, and pos is where it ended or the damage was met.
    """

    def __init__(self, raw: Ranged, at: int) -> None:
        self.raw, self.start, self.pos, self.inflate, self.data, self.base, self.hurt, self.over = raw, at, at, zlib.decompressobj(31), bytearray(), 0, "", False
        self.failing: bool | None = None

    def _more(self) -> bool:
        if self.over:
            return False
        piece, before = self.raw.get(self.pos, PIECE), self.inflate.copy()
        try:
            # a piece of blanks is a thousand times as long inflated: so much at once, at most
            more = self.inflate.decompress(piece, WINDOW)
            if not piece and not more:
                self.over, self.hurt = True, "member cut off"
                return False
            self.data += more
            self.over = self.inflate.eof
            self.pos += len(piece) - len(self.inflate.unused_data if self.over else self.inflate.unconsumed_tail)
        except zlib.error:
            self.over, self.hurt = True, "member"
            try:  # what comes before the damage
                for k in range(len(piece)):
                    self.data += before.decompress(piece[k : k + 1])
                    self.pos += 1
            except zlib.error:
                pass
        return True

    def _reach(self, end: int) -> None:
        while self.base + len(self.data) < end and self._more():
            pass

    def get(self, at: int, n: int) -> bytes:
        self._reach(at + n)
        return bytes(self.data[at - self.base : at - self.base + n])

    def search(self, pattern: re.Pattern, at: int, width: int, until: int | None = None) -> int:
        """Where a match begins (before `until`), or -1; without `until` what was searched is forgotten."""
        while True:
            if found := pattern.search(self.data, at - self.base):
                return self.base + found.start()
            at = max(at, self.base + len(self.data) - width + 1)
            if until is None:
                self.forget(at)
            elif at >= until:
                return -1
            if not self._more():
                return -1

    def fails(self) -> bool:
        """Whether the member's own checks fail: inflated once more to its end, holding none of it."""
        if self.failing is None:
            other = Inflated(self.raw, self.start)
            while other._more():
                other.data.clear()
            self.failing = other.hurt == "member"
        return self.failing

    def ended(self, at: int) -> bool:
        self._reach(at + 1)
        return self.base + len(self.data) <= at

    def forget(self, at: int) -> None:
        del self.data[: at - self.base]
        self.base = at


def parse_record(source: Ranged | Inflated, at: int) -> tuple[dict, bytes, int]:
    """Fields (names in lower case), block and end of the record at `at`; Damaged if any check fails."""
    if not _VERSION_LINE.match(source.get(at, VERSION_BYTES)):
        raise Damaged("no version line")
    stop = source.search(_END, at, len(END), at + MOST_HEADER)
    if stop < 0:
        raise Damaged("no end of the header")
    fields, name = {}, None
    for line in source.get(at, stop - at).split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if line[:1] in (b" ", b"\t") and name is not None:  # the line before goes on
            fields[name] += " " + line.strip().decode("utf-8", "surrogateescape")
            continue
        if not colon:
            raise Damaged("broken header")
        name = key.strip().lower().decode("latin-1")
        fields[name] = value.strip().decode("utf-8", "surrogateescape")
    if "x-header-digest" in fields and fields["x-header-digest"] != header_digest(fields):
        raise Damaged("header digest")
    fields = {k: v.encode("utf-8", "surrogateescape").decode("utf-8", "replace") for k, v in fields.items()}
    length = fields.get("content-length", "")
    if not _NUMBER(length) or length.startswith("-"):
        raise Damaged("no content length")
    if any(not _NUMBER(fields[k]) for k in NUMBERS if k in fields):
        raise Damaged("broken number")
    begin, end = stop + 4, stop + 4 + int(length)
    # the end mark first: a wrong length reads nothing else of an archive
    if source.get(end, 4) != END:
        raise Damaged("no end mark")
    block = source.get(begin, end - begin)
    told = fields.get("warc-block-digest", "")
    if told.lower().startswith("sha1:") and not same_sha1(told, block):
        raise Damaged("block digest")
    return fields, block, end + 4


def has_digests(fields: dict) -> bool:
    """Whether a record that was read has shown by itself that its header and its block are sound."""
    return fields.get("warc-block-digest", "").lower().startswith("sha1:") and "x-header-digest" in fields


def _inside(source: Inflated) -> Iterator[tuple[dict | None, bytes | str]]:
    """(fields, block) of each sound record of a member, and (None, reason) of each gap in its content.

    Where the member's own checks fail, only digests of header and block show that a record is sound; at the first record without them
    the member is therefore inflated to its end once more, and if it fails such records are gaps.
    """
    at, reason = 0, ""
    while not source.ended(at):
        try:
            fields, block, end = parse_record(source, at)
        except Damaged as x:
            reason = reason or str(x)
            at = source.search(_VERSION_LINE, at + 1, VERSION_BYTES)
            if at < 0:
                break
            source.forget(at)
            continue
        if not has_digests(fields) and source.fails():
            fields, reason = None, reason or "unverified"
        if fields is not None:
            if reason:
                yield None, reason
            yield fields, block
            reason = ""
        at = end
        source.forget(at)
    if reason:
        yield None, reason


def _begins(source: Ranged, at: int) -> bool:
    """Whether a sound record, or a member with one, begins at `at`."""
    if source.get(at, len(_MEMBER)) == _MEMBER:
        return any(fields for fields, _ in _inside(Inflated(source, at)))
    try:
        parse_record(source, at)
    except Damaged:
        return False
    return True


def _next_start(source: Ranged, at: int, known: int = 0) -> int:
    """Where the next member, or version line not before `known`, with a sound record begins, or the end."""
    line = member = at - 1
    while True:
        # each kind is sought again only once the place found last is passed
        if line is not None and line < at:
            found = source.search(_VERSION_LINE, max(at, known), VERSION_BYTES)
            line = found if found >= 0 else None
        if member is not None and member < at:
            found = source.search(_MEMBERS, at, len(_MEMBER))
            member = found if found >= 0 else None
        starts = [x for x in (line, member) if x is not None]
        if not starts:
            return source.size
        at = min(starts)
        if _begins(source, at):
            return at
        at += 1


def salvage(raw: bytes | Ranged) -> Iterator[tuple[int, int, dict | None, bytes | str]]:
    """(start, end, fields, block) of each sound record, and (start, end, None, reason) of each gap, in file order.

    Records and gaps inside a member have its place; if it has several, those before the last end where the
    archive had been read to. A damaged member gives its sound records and one gap. No more of the archive is held than a window and a record.
    """
    source = raw if isinstance(raw, Ranged) else Ranged.of(raw)
    at = 0
    while at < source.size:
        if source.get(at, len(_MEMBER)) != _MEMBER:
            try:
                fields, block, end = parse_record(source, at)
                yield at, end, fields, block
            except Damaged as x:
                end = _next_start(source, at + 1)
                yield at, end, None, str(x)
            at = end
            continue
        content, last, sound = Inflated(source, at), None, 0
        for found in _inside(content):
            if last:
                yield at, content.pos, *last
            last, sound = found, sound + (found[0] is not None)
        if sound and not content.hurt:
            end = content.pos
            yield at, end, *last
        else:
            # lines before the damage were read as the member's, even where they are stored without compression
            end = _next_start(source, at + 1, content.pos if sound else 0)
            if sound and last[0] is not None:
                yield at, content.pos, *last
            yield at, end, None, content.hurt or (last[1] if last else "empty member")
        at = end


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> tuple[str, DataFrame]:
    """One record for each row, in .warc.gz files of some 16 MB; returns the folder and the table of files.

    Of rows with equal payloads of at least `least_bytes` bytes, those with the smallest id are responses and
    the others revisits of it. A null payload is empty; a null id never is the smallest unless all are null,
    and then the rows are responses. Payloads are compared by SHA-256. Other columns are not read.
    """
    spark = pages.sparkSession
    ship(spark)
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("body"))
    rows = rows.withColumn("same", F.unhex(F.sha2("body", 256)))
    copies = rows.where(F.length("body") >= least_bytes).groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    copies = materialise(copies.select("same", "first"), "warc-copies")  # so that Spark can split a payload of many rows
    rows = rows.join(copies, "same", "left").drop("same")
    folder = folder or new_folder(spark, "warc")
    make_folder(spark, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # attempts of a task may see other rows, so each has files of its own, and the index names those of the one that counts
        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        held, size, count, number = [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            path = put(folder, f"{task:06d}-{attempt}-{number:06d}.warc.gz", b"".join(held), attempt)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            for row, uri, data, first in zip(*(batch[c] for c in ("id", "url", "body", "first")), strict=True):
                row, first, data = row.as_py(), first.as_py(), data.as_py()
                kind = "response" if first is None or row == first else "revisit"
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                held.append(packer.compress(record_bytes(kind, row, uri.as_py(), data, digest(data), first, date)) + packer.flush())
                size, count = size + len(held[-1]), count + 1
                if size >= FILE_BYTES:
                    yield flush()
                    held, size, count, number = [], 0, 0, number + 1
        if held:
            yield flush()

    return folder, materialise(rows.mapInArrow(write, "path string, records long, bytes long"), "warc-index")


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False, glob: str = "*.warc*", files: DataFrame | None = None) -> DataFrame:
    """A row for each sound record and each gap of the archives in `folder` (kind: the record's type, or gap).

    A payload whose digest does not match its field makes the record a gap with that reason. `files` is the table that write_warc() gives:
    then only the archives that it names are read, and not what stopped attempts have left. Without it Spark lists the
    archives; each is read by one task, in ranges, which holds a window of it and one record. An archive cut off in the middle
    gives a gap at its end; an empty one gives no row.
    """
    ship(spark)
    opened = urlsplit(folder).scheme in OPENED

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        for batch in batches:
            for k, path in enumerate(batch["path"].to_pylist()):
                rows, held = [], 0
                for start, end, fields, block in salvage(_open(path) if opened else batch["content"][k].as_py()):
                    if fields is None:
                        row, body = (path, start, end - start, "gap", block, None, None, None, None, None), None
                    else:
                        kind, told = fields.get("warc-type", ""), fields.get("warc-payload-digest", "")
                        body = block.partition(END)[2] if fields.get("content-type", "").startswith("application/http") else block
                        sha1 = told.partition(":")[2] if told and kind == "revisit" else digest(body)
                        if kind == "response" and told.lower().startswith("sha1:") and not same_sha1(told, body):
                            row, body = (path, start, end - start, "gap", "payload digest", None, None, None, None, None), None
                        else:
                            number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
                            size = number("x-payload-length") if kind == "revisit" else len(body)
                            row = (path, start, end - start, kind, None, number("x-row-id"), fields.get("warc-target-uri"), number("x-refers-to-row-id"), sha1, size)
                    rows.append((*row, body) if with_payload else row)
                    held += len(body or b"") if with_payload else 1000
                    if held > 8 << 20:
                        yield _rows(rows, names, with_payload)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows, names, with_payload)

    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", *["content"] * (not opened))
    if files is not None and opened:
        found = files.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    elif files is not None:
        last = lambda c: F.substring_index(c, "/", -1)
        found = found.join(files.select(last("path").alias("_name")), last("path") == F.col("_name"), "left_semi")
    return found.mapInArrow(read, RECORD + ", payload binary" * with_payload)


def _open(path: str) -> Ranged:
    files, name = FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
    file = files.open_input_file(name)

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    return Ranged(read, file.size())


def _rows(rows: list[tuple], names: list[str], with_payload: bool) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    types = [kinds[f.split()[1]] for f in RECORD.split(", ")] + [pa.binary()] * with_payload
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[*names, *["payload"] * with_payload])
