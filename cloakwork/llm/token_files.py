"""Token ids in binary files: canonical Huffman codes of limited length, from counts over all ids.

A file holds whole documents in ascending id order: a header with the code lengths, the documents' ids and
token counts, a bit offset for each block of tokens, and the bits. Every block can be decoded on its own;
decoding looks up one table entry a token and takes many blocks side by side.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import make_folder, materialise, new_folder, put, release, ship
from .tokens import encoder

MAGIC = b"HTOK1\n"
HEADER = struct.Struct("<6sBIIQQQQIIIQ")  # magic, longest code, symbols, block, shard, seq, documents, tokens, three packed sizes, bits
BLOCK = 512
FILE_TOKENS = 1 << 21
SLICE = 1 << 18
NULL_ID = -(1 << 63)


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Lengths of an optimal prefix code with no code over `longest` bits (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids need codes of more than {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    levels = []  # of each level: which entries of its sorted list are single ids
    packed = np.empty(0)
    for _ in range(longest):
        both = np.concatenate([weight, packed])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(weight))
        both = both[rank]
        packed = both[0 : len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(order) - 2
    total = np.zeros(len(order), dtype=np.int64)
    for single in reversed(levels):
        singles = int(single[:take].sum())
        total[:singles] += 1
        take = 2 * (take - singles)
    lengths[order] = total
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    code = 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        same = np.flatnonzero(lengths == n)
        code <<= 1
        codes[same] = code + np.arange(len(same))
        code += len(same)
    return codes


def decode_table(lengths: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """For every `longest` bits ahead: the id that they begin with, and its length."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    width = np.left_shift(1, longest - lengths[order].astype(np.int64))
    ids, sizes = np.repeat(order, width), np.repeat(lengths[order], width)
    pad = (1 << longest) - len(ids)
    return np.append(ids, np.zeros(pad, ids.dtype)).astype(np.uint32), np.append(sizes, np.ones(pad, sizes.dtype)).astype(np.int64)


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int) -> tuple[bytes, np.ndarray, int]:
    """The bits, the bit offset of every block, and the number of bits; some blocks at a time. No code may exceed 17 bits."""
    out, offsets, total = [], [np.empty(0, dtype=np.int64)], 0
    rest = 0  # what the slices so far have put into the byte that they did not fill
    step = max(1, SLICE // block) * block
    for at in range(0, len(ids), step):
        some = ids[at : at + step]
        sizes = lengths[some].astype(np.int64)
        first = total & 7
        ends = np.cumsum(sizes) + first
        starts = ends - sizes
        word = codes[some].astype(np.int64) << (24 - sizes - (starts & 7))
        byte = starts >> 3
        n = int(ends[-1])
        joined = np.zeros(n // 8 + 4)
        joined[0] = rest
        for k in range(3):  # codes do not overlap, so adding their bytes is joining them
            joined += np.bincount(byte + k, weights=(word >> (16 - 8 * k)) & 255, minlength=len(joined))[: len(joined)]
        offsets.append(starts[::block] + (total - first))
        out.append(joined[: n // 8].astype(np.uint8).tobytes())
        rest = int(joined[n // 8])
        total += n - first
    return b"".join([*out, bytes([rest, 0, 0, 0])]), np.concatenate(offsets), total


def unpack_bits(bits: bytes, offsets: np.ndarray, n: int, block: int, table: tuple[np.ndarray, np.ndarray], longest: int) -> np.ndarray:
    """All n ids; the blocks advance side by side, one token a step."""
    data = np.frombuffer(bits + bytes(4), dtype=np.uint8)
    ids, sizes = table
    at = offsets.astype(np.int64)
    out = np.empty((len(at), block), dtype=np.uint32)
    last, mask = len(data) - 3, (1 << longest) - 1
    for k in range(block):
        byte = np.minimum(at >> 3, last)
        ahead = ((data[byte].astype(np.int64) << 16 | data[byte + 1].astype(np.int64) << 8 | data[byte + 2]) >> (24 - longest - (at & 7))) & mask
        out[:, k] = ids[ahead]
        at = at + sizes[ahead]
    return out.ravel()[:n]


def write_file(shard: int, seq: int, docs: list[int | None], sizes: list[int], ids: np.ndarray, lengths: np.ndarray, longest: int) -> bytes:
    bits, offsets, total = pack_bits(ids, lengths, canonical_codes(lengths), BLOCK)
    packed = [zlib.compress(x, 1) for x in (lengths.tobytes(), np.array([[NULL_ID if d is None else d for d in docs], sizes], dtype="<i8").tobytes(), np.diff(offsets, prepend=0).astype("<u4").tobytes())]
    head = HEADER.pack(MAGIC, longest, len(lengths), BLOCK, shard, seq, len(docs), len(ids), *map(len, packed), total)
    return b"".join([head, *packed, bits])


def read_file(raw: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """shard, seq, document ids, their token counts, and all ids."""
    magic, longest, symbols, block, shard, seq, n_docs, n, a, b, c, total = HEADER.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEADER.size
    lengths, docs, offsets = (zlib.decompress(raw[i:j]) for i, j in ((at, at + a), (at + a, at + a + b), (at + a + b, at + a + b + c)))
    table = decode_table(np.frombuffer(lengths, dtype=np.uint8), longest)
    docs = np.frombuffer(docs, dtype="<i8").reshape(2, n_docs)
    ids = unpack_bits(raw[at + a + b + c :], np.cumsum(np.frombuffer(offsets, dtype="<u4").astype(np.int64)), n, block, table, longest)
    return shard, seq, docs[0], docs[1], ids


def encoded_rows(df: DataFrame, path: str, id_col: str, text: str, end: int, special: bool = False) -> DataFrame:
    """(shard, seq, id, ids binary) in ascending id order: shards are ranges of ids, seq counts the rows of a shard."""
    ship(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(text)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), tie.alias("tie"))
    rows = rows.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie").drop("tie")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard, seq = encoder(path, special), TaskContext.get().partitionId(), 0
        for batch in batches:
            every, at = words.encode_all(batch["text"], end)
            every, at = memoryview(every.tobytes()), (at * words.dtype.itemsize).tolist()
            ids = [every[a:b] for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(ids), pa.int64()), pa.array(range(seq, seq + len(ids)), pa.int64()), batch["id"], pa.array(ids, pa.binary())], names=["shard", "seq", "id", "ids"])
            seq += len(ids)

    return rows.mapInArrow(encode, "shard long, seq long, id long, ids binary")


def id_counts(rows: DataFrame, size: int, dtype: str) -> np.ndarray:
    """How often each id occurs in all rows; summed in the tasks, then by id. The result is as long as the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for ids in batch["ids"]:
                total += np.bincount(np.frombuffer(ids.as_buffer(), dtype=dtype), minlength=size) if len(ids.as_buffer()) > 8 * size else 0
            joined = b"".join(x.as_py() for x in batch["ids"] if len(x.as_buffer()) <= 8 * size)
            total += np.bincount(np.frombuffer(joined, dtype=dtype), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["token", "n"])

    counts = np.zeros(size, dtype=np.int64)
    found = rows.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    counts[found["token"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return counts


def write_token_files(df: DataFrame, path: str, folder: str | None = None, id_col: str = "doc_id", text: str = "text", end: int = 2, special: bool = False) -> tuple[str, DataFrame]:
    """Encode every text with the tokenizers file at `path`, append `end`, and write token files.

    Returns the folder and a table of its files (shard, seq, docs, tokens). Files sort by (shard, seq) as
    their documents do by id; null ids come first, ties in the order of a hash of the text. Null and empty
    texts have the end id only. special: as of Encoder. The ids are kept once in the shared folder between counting and coding.
    """
    spark = df.sparkSession
    words = encoder(path, special)
    size, dtype = max(words.size, end + 1), words.dtype.str
    longest = 16 if size <= 1 << 15 else 17
    rows = materialise(encoded_rows(df, path, id_col, text, end, special), "token-rows")
    release(spark)
    lengths = code_lengths(id_counts(rows, size, dtype), longest)
    folder = folder or new_folder(spark, "token-files")
    make_folder(spark, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        docs, sizes, held, first, total = [], [], [], None, 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype=dtype)
            put(folder, f"{first[0]:08d}-{first[1]:010d}.htok", write_file(*first, docs, sizes, ids, lengths, longest), attempt)
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*first, len(docs), len(ids))], names=["shard", "seq", "docs", "tokens"])

        for batch in batches:
            for shard, seq, doc, ids in zip(*(batch[c].to_pylist() for c in ("shard", "seq", "id", "ids")), strict=True):
                if first is not None and (shard != first[0] or seq != first[1] + len(docs) or total >= FILE_TOKENS):
                    yield flush()
                    docs, sizes, held, first, total = [], [], [], None, 0
                first = first or (shard, seq)
                docs.append(doc)
                sizes.append(len(ids) // np.dtype(dtype).itemsize)
                held.append(ids)
                total += sizes[-1]
        if first is not None:
            yield flush()

    files = materialise(rows.mapInArrow(write, "shard long, seq long, docs long, tokens long"), "token-index")
    return folder, files


def read_token_files(spark, folder: str, files: DataFrame, with_ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, ids array if asked for) of every document in the files; start counts all ids before it.

    Null ids come back as null, repeated rows as rows of their own, in the files' order; a table without files gives no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch["content"]:
                shard, seq, docs, sizes, ids = read_file(raw.as_py())
                ends = np.cumsum(sizes)
                ids = ids.astype("<u4")
                parts = [ids[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                n = len(docs)
                columns = [pa.array([shard] * n, pa.int64()), pa.array([seq] * n, pa.int64()), pa.array([None if d == NULL_ID else d for d in docs.tolist()], pa.int64()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "seq", "id", "inside", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    schema = "shard long, seq long, id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    # one file of up to FILE_TOKENS and one document at a time
    docs = spark.read.format("binaryFile").option("pathGlobFilter", "*.htok").load(folder).select("content").mapInArrow(read, schema)
    before = files.groupBy("shard").agg(F.sum("tokens").alias("t"))
    before = before.select("shard", (F.sum("t").over(W.orderBy("shard")) - F.col("t")).alias("ahead"))
    inside = F.sum("tokens").over(W.partitionBy("shard").orderBy("seq")) - F.col("tokens")
    offsets = files.select("shard", "seq", inside.alias("lead")).join(before, "shard").select("shard", "seq", (F.col("ahead") + F.col("lead")).alias("lead"))
    return docs.join(offsets, ["shard", "seq"]).withColumn("start", F.col("lead") + F.col("inside")).drop("shard", "seq", "lead", "inside")
