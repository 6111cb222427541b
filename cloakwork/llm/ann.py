"""Nearest neighbours by counting collisions in single-projection windows.

Each vector has one value on each of a number of random lines. The index, written once, gives every vector a
block and its place in the block's sorted array of each line. A query looks at the windows around its own values.
Vectors that fall into the windows of enough lines are verified exactly. If too few near ones are found,
all windows widen by a constant factor (virtual rehashing: the arrays stay as they are) and only what is new
is counted. Collisions are counted inside blocks: as rows, they would be many times the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialise, ship

LINES = 48
WIDEN = 1.6
QUERY_BLOCK = 4096
LEAST_BLOCK, MOST_BLOCK = 1 << 14, 1 << 16


def usable(vec: str) -> Column:
    """Not null, not empty, all components finite and present, not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vec).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def places(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Of each vector, its place in the sorted array of each line."""
    order = np.argsort(vectors @ directions, axis=0, kind="stable")
    out = np.empty(order.shape, dtype="<u2")
    np.put_along_axis(out, order, np.arange(len(vectors), dtype="<u2")[:, None], axis=0)
    return out


class Lines:
    """The sorted arrays of a block of vectors."""

    def __init__(self, vectors: np.ndarray, directions: np.ndarray, place: np.ndarray) -> None:
        self.vectors, self.directions = vectors, directions
        on = vectors @ directions
        self.order = np.empty(place.T.shape, dtype=np.int64)
        np.put_along_axis(self.order, place.T.astype(np.int64), np.arange(len(vectors))[None, :], axis=1)
        self.sorted = np.take_along_axis(on.T, self.order, axis=1)
        self.scale = np.median(np.abs(on - np.median(on, axis=0))) or 1.0

    def _edges(self, at: np.ndarray, half: float, side: str) -> list[list[int]]:
        """Of each query and line, where the window's end lies in the sorted array."""
        return np.stack([np.searchsorted(s, at[:, k] + half, side=side) for k, s in enumerate(self.sorted)], axis=1).tolist()

    def search(self, queries: np.ndarray, k: int, share: float, spare: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query, places and distances of at least the k nearest found.

        A vector is verified once it lies in the windows of `share` of the lines. The search ends when the
        k-th distance is within what the windows surely cover at that share, or all vectors were verified.
        """
        n, m = len(self.vectors), len(self.directions.T)
        at = queries @ self.directions
        need = max(1, int(np.ceil(share * m)))
        middle = self._edges(at, 0.0, "left")
        rounds: list[tuple[float, list[list[int]], list[list[int]]]] = []  # the same widths for all queries
        for i, query in enumerate(queries):
            counts, seen = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
            found, squares = np.empty(0, dtype=np.int64), np.empty(0)
            left = right = middle[i]
            for step in count():
                if step == len(rounds):
                    half = self.scale / 4 * WIDEN**step
                    rounds.append((half, self._edges(at, -half, "left"), self._edges(at, half, "right")))
                half, lows, highs = rounds[step]
                low, high = lows[i], highs[i]
                new = [o[a:b] for o, a, b in zip(self.order, low, left, strict=True)] + [o[a:b] for o, a, b in zip(self.order, right, high, strict=True)]
                counts += np.bincount(np.concatenate(new), minlength=n)
                left, right = low, high
                fresh = np.flatnonzero((counts >= need) & ~seen)
                seen[fresh] = True
                found = np.append(found, fresh)
                squares = np.append(squares, ((self.vectors[fresh] - query) ** 2).sum(axis=1))
                # a vector at distance d lies in a window of half width h with the probability that |N(0, d)| < h
                if len(found) >= min(n, k + spare):
                    kth = np.partition(squares, min(k, len(squares)) - 1)[min(k, len(squares)) - 1]
                    if len(found) == n or half * half >= kth:
                        break
            near = found[squares <= kth * (1 + 1e-9)]
            yield near, np.sqrt(np.cumsum((self.vectors[near] - query) ** 2, axis=1)[:, -1])


def nearest(df: DataFrame, id_col: str, vec: str, queries: Column, k: int = 10, lines: int = LINES, share: float = 0.5, seed: int = 17) -> DataFrame:
    """(query_id, rank, id, score): for each row that `queries` selects, its k nearest other rows by Euclidean distance.

    The vectors are dealt into blocks of bounded size whose sorted arrays are written once; queries, in blocks of
    QUERY_BLOCK, meet every block, and no task holds more than a block of each. Scores are exact, in double
    precision, summed from the first component on; ties go to the smaller id. Vectors that are null, zero, not
    finite or of another dimension than most have no part. Repeated rows count as rows; only the query's own
    row is left out, which is told by its number in the written table. Other columns are not read, so their names may clash.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    rows = materialise(rows.where(usable("v") & F.col("id").isNotNull()).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if("q").alias("queries")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, query_row long, id long, score double"
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    d, n = sizes["d"], sizes["n"]
    rows = rows.where(F.size("v") == d)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # hashes deal blocks unevenly: half of what the places' two bytes allow
    v_blocks = max(1, -(-n // min(MOST_BLOCK // 2, max(LEAST_BLOCK, n // tasks))))
    q_blocks = max(1, -(-sizes["queries"] // QUERY_BLOCK))
    directions = np.random.default_rng(seed).standard_normal((d, lines))
    wide = lambda pdf: np.stack(pdf["v"].to_numpy()).astype(np.float64)

    def sort_block(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) >= MOST_BLOCK:
            raise ValueError("a block has too many vectors")
        pdf = pdf.sort_values(["id", "row"], ignore_index=True)
        return pdf.assign(place=[x.tobytes() for x in places(wide(pdf), directions)])

    def search(key: tuple, own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(others):
            return pd.DataFrame({"query_id": [], "query_row": [], "id": [], "score": []})
        ids, numbers = others["id"].to_numpy(), others["row"].to_numpy()
        place = np.frombuffer(b"".join(others["place"]), dtype="<u2").reshape(-1, lines)
        block = Lines(wide(others), directions, place)
        out = []
        for query, number, (found, distances) in zip(own["id"].to_numpy(), own["row"].to_numpy(), block.search(wide(own), k + 1, share, spare=2 * k), strict=True):
            mine = numbers[found] != number
            found, distances = found[mine], distances[mine]
            best = np.lexsort((ids[found], distances))[:k]
            out.append(pd.DataFrame({"query_id": query, "query_row": number, "id": ids[found[best]], "score": distances[best]}))
        return pd.concat(out, ignore_index=True)

    kind = df.schema[vec].dataType.simpleString()
    block_of = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    index = rows.select("id", "row", "v", block_of(v_blocks, 2).alias("vb")).groupBy("vb").applyInPandas(sort_block, f"id long, row long, v {kind}, vb long, place binary")
    index = materialise(index, "lines")
    own = rows.where("q").select("id", "row", "v", block_of(q_blocks, 1).alias("qb")).withColumn("vb", every(v_blocks))
    found = own.groupBy("qb", "vb").cogroup(index.withColumn("qb", every(q_blocks)).groupBy("qb", "vb")).applyInPandas(search, schema)
    order = W.partitionBy("query_id", "query_row").orderBy("score", "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
