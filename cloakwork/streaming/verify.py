"""The residual scan as a stream: new texts against all tokens, new tokens against the texts seen before.

Each batch writes its tokens, texts, rows and findings under its own number, so a batch run again writes the same. Beside the texts it
writes an index: for each block of some megabytes of texts a map of the parts that occur in it. Tokens that come later are only looked for in blocks
that have all parts of one of them; the other texts are not read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.shipping import ship
from ..functions.tables import materialise
from ..operators.verify import CHUNK, GRAM, _known, _leaks, _points, keyed_hits, keyed_texts, part_names, text_key

#: Characters of the texts of a block, about, and the bits of its map.
BLOCK = 1 << 22
BITS = 1 << 22
#: With more new tokens in a batch than this all blocks are read.
MOST_NEW = 100_000
TEXTS = "key long, check long, text string, block string"
FOUND = "key long, check long, kind string, token string, detail string"
ROWS = "file_id string, tag string, key long, check long"
INDEX = "block string, bits binary"


def _into_blocks(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The texts with the name of the block that each belongs to; blocks lie together."""

    def into(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, size = TaskContext.get().taskAttemptId(), 0, 0
        for batch in batches:
            names = []
            for n in (len(t) for t in batch["text"].to_pylist()):
                if size and size + n > most:
                    number, size = number + 1, 0
                names.append(f"{task}-{number}")
                size += n
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("key", "check", "text")), pa.array(names, pa.string())], names=["key", "check", "text", "block"])

    return into


def _maps(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each block (or a part of one) the map, of so many bits, of all parts of 2 to GRAM characters in its texts."""

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, bits = None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for name, text in zip(batch["block"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if name != block:
                    if block is not None:
                        yield told()
                    block, bits = name, np.zeros(size, dtype=bool)
                for cut in range(0, max(1, len(text)), CHUNK):
                    points = _points(text[cut : cut + CHUNK + GRAM - 1])
                    for q in range(2, GRAM + 1):
                        bits[(part_names(points, q) % np.uint64(size)).astype(np.int64)] = True
        if block is not None:
            yield told()

    return maps


def _may_hold(tokens: list[str], size: int = BITS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks whose map has all parts of one of the tokens."""
    places = [(part_names(_points(t), min(GRAM, len(t))) % np.uint64(size)).astype(np.int64) for t in tokens]
    every, starts = np.concatenate([np.empty(0, np.int64), *places]), np.append(0, np.cumsum([len(p) for p in places]))[:-1]

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = []
            for name, data in zip(batch["block"].to_pylist(), batch["bits"].to_pylist(), strict=True):
                bits = np.frombuffer(data, dtype=np.uint8)
                there = (bits[every >> 3] >> (every & 7).astype(np.uint8)) & 1
                if len(every) and np.minimum.reduceat(there, starts).any():
                    some.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["block"])

    return held


def _before(spark: SparkSession, root: str, what: str, schema: str, number: int | None) -> DataFrame:
    """What the batches before this one (None: all) have written, one finished folder each."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{what}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    paths = []
    if files.exists(folder):
        for x in files.listStatus(folder):
            name = x.getPath().getName()
            if name.startswith("batch=") and (number is None or int(name[6:]) < number) and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{what}/{name}/_SUCCESS")):
                paths.append(f"{root}/{what}/{name}")
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def verify_batch(root: str, block: int = BLOCK, bits: int = BITS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows (file_id, tag, text, token); a row is a text (of a file, or of the element `tag` of one) or a token.

    block and bits, the length of a block and of its map, stay the same for all batches of a folder.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ship(spark)
        write = lambda df, what: df.write.mode("overwrite").parquet(f"{root}/{what}/batch={number}")
        put = lambda df, what, schema: (write(df, what), spark.read.schema(schema).parquet(f"{root}/{what}/batch={number}"))[1]
        batch = materialise(batch.select("file_id", "tag", "text", "token"), "arrived")
        old_tokens, old_texts = _before(spark, root, "tokens", "token string", number), _before(spark, root, "texts", TEXTS, number)
        new_tokens = put(_known(batch.where("token is not null")).join(old_tokens.hint("merge"), "token", "left_anti"), "tokens", "token string")
        rows = batch.where("text is not null").select("file_id", "tag", "text")
        write(rows.select("file_id", "tag", *text_key()), "rows")
        fresh = keyed_texts(rows).join(old_texts.select("key", "check").hint("merge"), ["key", "check"], "left_anti")
        texts = put(fresh.select("key", "check", "text").mapInArrow(_into_blocks(block), TEXTS), "texts", TEXTS)
        write(texts.select("block", "text").mapInArrow(_maps(bits), INDEX), "index")
        found = _leaks(texts.drop("block"), old_tokens.union(new_tokens))
        listed = [x.token for x in new_tokens.limit(MOST_NEW + 1).collect()]
        if listed:
            again = old_texts
            if len(listed) <= MOST_NEW:
                blocks = _before(spark, root, "index", INDEX, number).mapInArrow(_may_hold(listed, bits), "block string").distinct()
                again = old_texts.join(materialise(blocks, "blocks"), "block", "left_semi")
            late = keyed_hits(materialise(again.drop("block"), "again"), new_tokens)
            found = found.union(late.select("key", "check", F.lit("token").alias("kind"), "token", "detail"))
        write(found, "found")

    return run


def stream_verify(arriving: DataFrame, root: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Scan arriving texts and tokens (columns as for verify_batch()); leaks_so_far() has what was found."""
    return arriving.writeStream.foreachBatch(verify_batch(root)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def leaks_so_far(spark: SparkSession, root: str) -> DataFrame:
    """(file_id, kind, token, detail), as verify_reports() and verify_elements() give them for all that has arrived: detail is the tag of an
    element and the surroundings in a report."""
    rows, found = _before(spark, root, "rows", ROWS, None), _before(spark, root, "found", FOUND, None)
    return rows.join(found.hint("merge"), ["key", "check"]).select("file_id", "kind", "token", F.coalesce("tag", "detail").alias("detail"))
