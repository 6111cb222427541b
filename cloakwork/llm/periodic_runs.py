"""Runs of a repeated period in the words of texts, tile by tile and octave by octave.

A run is a stretch of consecutive words with smallest period q, at least twice that long and of `least` words, that neither
neighbour extends. Periods are taken in octaves [G, 2G). For each octave a text is taken apart into overlapping tiles with
boundaries every G words: each run of the octave has a boundary c such that c and c + q lie in it, and how far the words from c on agree with
those from c + q on, and those before c with those before c + q, are Z-values of the words around c. A tile is
solved alone; what it finds is cut off 2G words from its boundaries, and pieces of one text and period that share q
words or more are stitched. Only tiles are dealt out where some G words occur again G to 2G - 1 words later, as they do in every run of the octave.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialise, ship

#: Periods below are solved together, by comparing the words at each distance.
SMALL = 8
#: Words between the first and the last boundary of a tile, at most (one octave's step if that is longer).
TILE = 2048
#: Words of tiles that are handed over together.
BATCH = 1 << 19


def words_of(text: str | None) -> list[bytes]:
    """The words between white space (blank and \\t to \\r)."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers, by first sight."""
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))


def _grams(ids: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit number for each stretch of q words, equal for equal ones."""
    n = max(0, len(ids) - q + 1)
    h = np.full(n, q, dtype=np.uint64)
    for i in range(q):
        h = (h ^ ids[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def may_repeat(ids: np.ndarray, least: int) -> bool:
    """False only for words without a run: in a run of length L the words from its start agree for L - q >= least / 2 words with those q later."""
    if len(ids) < max(2, least):
        return False
    seen = np.sort(_grams(ids, max(1, (least + 1) // 2)))
    return bool((seen[1:] == seen[:-1]).any())


@lru_cache(100_000)
def _parts(q: int) -> tuple[int, ...]:
    """q divided by each of its prime factors."""
    found, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            found.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return tuple(found + [q // rest] * (rest > 1))


def _is_smallest(ids: np.ndarray, start: int, end: int, q: int) -> bool:
    """Of a stretch of 2q words or more with period q: whether no smaller one holds (it would divide q)."""
    return not any((ids[start : end - d] == ids[start + d : end]).all() for d in _parts(q))


def z_values(s: list[int]) -> list[int]:
    """How many elements from each place on agree with the first ones."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _small(ids: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) for the periods below SMALL."""
    for q in range(1, min(SMALL, len(ids) // 2 + 1)):
        same = np.concatenate([[False], ids[q:] == ids[:-q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        starts, ends = edges[::2], edges[1::2] + q
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s >= max(least, 2 * q) and _is_smallest(ids, s, e, q):
                yield q, s, e


def _around(ids: np.ndarray, octave: int, c: int) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of the stretches with a period of the octave that hold both c and c + period, at most 2 * octave words beyond either."""
    n, g = len(ids), octave
    last = min(2 * g - 1, n - c)  # the largest period
    if last < g:
        return
    own = ids[c : c + 2 * g]
    ahead = z_values([*own.tolist(), -1, *ids[c + g : c + 4 * g].tolist()])[len(own) + 1 :]
    before, stop = ids[max(0, c - 2 * g) : c][::-1], c + last
    behind = z_values([*before.tolist(), -1, *ids[max(0, c - g) : stop][::-1].tolist()])[len(before) + 1 :]
    for q in range(g, last + 1):
        right = ahead[q - g] if c + q < n else 0
        left = behind[stop - c - q] if c else 0
        if left + right >= q and _is_smallest(ids, c - left, c + q + right, q):
            yield q, c - left, c + q + right


def solve(ids: np.ndarray, octave: int, boundaries: list[int], least: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of one tile, pieces that share their period's length stitched."""
    found = sorted(_small(ids, least)) if octave < SMALL else sorted(x for c in boundaries for x in _around(ids, octave, c))
    joined: list[tuple[int, int, int]] = []
    for q, s, e in found:
        if joined and joined[-1][0] == q and s <= joined[-1][2] - q:
            joined[-1] = (q, joined[-1][1], max(e, joined[-1][2]))
        else:
            joined.append((q, s, e))
    return joined


def _marked(grams: np.ndarray, octave: int) -> np.ndarray | None:
    """The places whose stretch occurs again octave to 2 * octave - 1 words later; None if none occurs again anywhere."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    new = ranked[1:] != ranked[:-1]
    if new.all():
        return None
    key = np.append(0, np.cumsum(new)) * (len(grams) + 2 * octave) + order
    until = np.searchsorted(key, key + 2 * octave - 1, side="right") - 1
    return np.sort(order[order[until] - order >= octave])


def tiles(ids: np.ndarray, least: int) -> Iterator[tuple[int, int, list[int], np.ndarray]]:
    """(octave, first word, boundaries counted from it, words) of the tiles that may hold a run."""
    n = len(ids)
    for lo in range(0, max(1, n), TILE):  # an overlap in which a piece of every period below SMALL is long enough to be found
        own = ids[lo : lo + TILE + 4 * max(SMALL, least)]
        need = lambda q: max(1, least - q, q)
        for q in range(1, min(SMALL, len(own))):
            runs = np.append(0, np.cumsum(own[q:] == own[:-q]))
            if len(runs) > need(q) and (runs[need(q) :] - runs[: -need(q)] == need(q)).any():
                yield 1, lo, [], own
                break
    octave, grams = SMALL, _grams(ids, SMALL)
    while 2 * octave <= n:
        marked = _marked(grams, octave)
        if marked is None:
            break
        at = np.unique(np.concatenate([-(-marked // octave) * octave, (marked // octave + 1) * octave]))
        group = at // max(octave, TILE)
        for t in np.unique(group):
            some = at[group == t]
            lo = max(0, int(some[0]) - 2 * octave)
            yield octave, lo, (some - lo).tolist(), ids[lo : int(some[-1]) + 4 * octave]
        left, right = grams[:-octave], grams[octave:]
        grams = (left ^ (right >> np.uint64(31)) ^ (right * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
        octave *= 2


def _narrow(ids: np.ndarray) -> bytes:
    """Numbers in as few bytes as the largest needs: the width, then the numbers. Only which are equal matters."""
    new = np.unique(ids, return_inverse=True)[1]
    width = 1 if len(ids) < 256 or new.max(initial=0) < 256 else 2 if new.max(initial=0) < 65536 else 4
    return bytes([width]) + new.astype(f"<u{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)


def collapse(words: list[bytes], runs: list[dict]) -> bytes:
    """The words, joined by one blank, without those that a run holds after its first period."""
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for r in runs:
        gone[r["start"] + r["period"]] += 1
        gone[r["start"] + r["length"]] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    return b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)


def stitched(pieces: DataFrame) -> DataFrame:
    """(key, period, first, last) of tiles -> (key, start, length, period): pieces of one text and period that share a period's length are one run."""
    by = W.partitionBy("key", "period").orderBy("first", "last")
    reach = F.max("last").over(by.rowsBetween(W.unboundedPreceding, -1))
    part = F.sum(F.when(F.col("first") <= reach - F.col("period"), 0).otherwise(1)).over(by)
    whole = pieces.withColumn("part", part).groupBy("key", "period", "part").agg(F.min("first").alias("start"), F.max("last").alias("end"))
    return whole.select("key", "start", (F.col("end") - F.col("start")).alias("length"), "period")


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 12, with_text: bool = False) -> DataFrame:
    """One row per input row: the id, n_words, runs (array of start, length, period, by start, then period) and collapsed_sha256.

    with_text adds collapsed, the text without the words that a run holds after its first period, words joined by one blank.
    Null, empty and blank texts have no words, no runs and collapse to the empty text. Ids may be null or repeated; each row is judged by
    itself, and texts of equal words are solved once. Runs of equal place or length are all kept. Other columns are not carried along, whatever
    their names. A text is held whole by the task that takes it apart; tiles are dealt out one by one.
    """
    spark = df.sparkSession
    ship(spark)
    kind = df.schema[id_col].dataType.simpleString()

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without a run are done; of the others the words."""
        for batch in batches:
            keys, counts, digests, kept = [], [], [], []
            for t in batch["text"].to_pylist():
                words = words_of(t)
                joined, some = b" ".join(words), may_repeat(numbered(words), least)
                keys.append(xxhash.xxh3_128_digest(joined) if some else None)
                counts.append(len(words))
                digests.append(None if some else hashlib.sha256(joined).hexdigest())
                kept.append(joined if some or with_text else None)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], names=["id", "key", "n_words", "collapsed_sha256", "words"])

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "octave", "lo", "at", "ids"])

        for batch in batches:
            rows, size = [], 0
            for key, words in zip(batch["key"].to_pylist(), batch["words"].to_pylist(), strict=True):
                for octave, lo, at, ids in tiles(numbered(words.split()), least):
                    rows.append((key, octave, lo, at, _narrow(ids)))
                    size += len(ids)
                    if size > BATCH:
                        yield told(rows)
                        rows, size = [], 0
            if rows:
                yield told(rows)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for x in batch.to_pylist():
                new = [(q, s + x["lo"], e + x["lo"]) for q, s, e in solve(_wide(x["ids"]), x["octave"], x["at"], least)]
                rows += new
                keys += [x["key"]] * len(new)
            period, first, last = np.array(rows, dtype=np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(period), pa.array(first), pa.array(last)], names=["key", "period", "first", "last"])

    def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [collapse(w.split(), r) for w, r in zip(batch["words"].to_pylist(), batch["runs"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["runs"], pa.array([hashlib.sha256(x).hexdigest() for x in left]), pa.array(left if with_text else [None] * len(left), pa.binary())], names=["key", "runs", "collapsed_sha256", "words"])

    listed = "array<struct<start: long, length: long, period: long>>"
    texts = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    sifted = materialise(texts.mapInArrow(sift, f"id {kind}, key binary, n_words long, collapsed_sha256 string, words binary"), "sifted")
    once = materialise(sifted.where("key is not null").dropDuplicates(["key"]).select("key", "words"), "run-texts")
    dealt = once.mapInArrow(apart, "key binary, octave long, lo long, at array<long>, ids binary")
    pieces = dealt.repartition(_shuffles(df), "key", "octave", "lo").mapInArrow(solved, "key binary, period long, first long, last long")
    runs = stitched(pieces).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    both = once.join(runs.hint("merge"), "key", "left").select("key", "words", F.coalesce("runs", F.array()).cast(listed).alias("runs"))
    found = materialise(both.mapInArrow(collapsed, f"key binary, runs {listed}, collapsed_sha256 string, words binary"), "runs")
    rows = sifted.where("key is not null").select("id", "key", "n_words").join(found.hint("merge"), "key").select("id", "n_words", "runs", "collapsed_sha256", "words")
    easy = sifted.where("key is null").select("id", "n_words", F.array().cast(listed).alias("runs"), "collapsed_sha256", "words")
    every = easy.union(rows)
    return every.select(F.col("id").alias(id_col), "n_words", "runs", "collapsed_sha256", *([F.col("words").cast("string").alias("collapsed")] if with_text else []))


def _shuffles(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def longest(runs: Column) -> Column:
    """struct(start, length, period) of the longest run, ties by start, then period; null without runs."""
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), (-best["n"]).alias("length"), best["period"].alias("period")))
