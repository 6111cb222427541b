"""Packing of tokenised documents into sequences: first-fit decreasing in randomised groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, ship
from .tokens import encoder

GROUP = 2048


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each item, none over `capacity`: largest items first, each into the first bin that has room.

    A tournament tree over the bins holds the most room of any bin below each node, so that the first bin
    with room is found from the root in steps of one level.
    """
    order = np.argsort(-sizes, kind="stable")
    leaves = 1 << max(0, (len(sizes) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    for item, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[item], offsets[item] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def cut_pieces(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", end: int = 2, capacity: int = 4096, with_ids: bool = True, special: bool = False) -> DataFrame:
    """Encode every text, append `end`, and cut it after every `capacity` ids: a row (id, start, length, ids_crc32, doc_tokens, lot, ids) a piece.

    lot is a random-looking number that stays the same when a task is run again.
    """
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path, special)
        lots = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            rows, parts = [], []
            every, at = words.encode_all(batch["text"], end)
            every, at = every.astype("<u4"), at.tolist()
            for i in range(batch.num_rows):
                ids = every[at[i] : at[i + 1]]
                for a in range(0, len(ids), capacity):
                    part = ids[a : a + capacity]
                    rows.append((i, a, len(part), zlib.crc32(part), len(ids)))
                    if with_ids:
                        parts.append(part)
            table = np.array(rows, dtype=np.int64).reshape(-1, 5)
            columns = [batch["id"].take(pa.array(table[:, 0])), *(pa.array(table[:, k]) for k in range(1, 5)), pa.array(lots.integers(0, 1 << 62, len(table)), pa.int64())]
            if with_ids:
                columns.append(pa.array([p.tolist() for p in parts], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "ids_crc32", "doc_tokens", "lot", *["ids"] * with_ids])

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, lot long" + ", ids array<int>" * with_ids
    return df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = 4096, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces with length and lot.

    Pieces are dealt at random into groups of about `group`, each packed by itself: the work is in
    proportion to the pieces, a group is small whatever the table holds, and groups share no sequence. A
    table without rows gives none. Pieces of equal length keep the order of their lots; repeated rows and null ids are pieces
    like others, and other columns are carried along.
    """
    groups = max(1, -(-pieces.count() // group))
    columns = pieces.columns
    own = "_group"
    while own in columns:
        own += "_"

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lot", kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=(pdf[own].to_numpy() << 32) + bins, offset=offsets)[[*columns, "sequence_id", "offset"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return pieces.withColumn(own, F.pmod("lot", F.lit(groups))).groupBy(own).applyInPandas(place, schema)


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", end: int = 2, capacity: int = 4096, with_ids: bool = True, special: bool = False) -> DataFrame:
    """Pack all texts into sequences of at most `capacity` ids; one row a piece: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    Every id of every document lies in exactly one piece; offsets in a sequence have no gap. Null and empty
    texts are the end id alone. Repeated rows are packed like different ones. Extra columns are not read. special: as of Encoder.
    """
    pieces = materialise(cut_pieces(df, path, id_col, text, end, capacity, with_ids, special), "pieces")
    return pack(pieces, capacity).drop("lot").withColumnRenamed("id", id_col)
