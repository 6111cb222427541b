"""Exact removal of repeated byte strings by distributed prefix doubling over run-length coded positions.

Every start of a `length`-byte string is a suffix position. In prefix doubling, the rank of the 2h bytes at a
position comes of a pair, the ranks of the h bytes there and h bytes on; equal prefixes get one rank, what is unique
is dropped, and so on at growing offsets until the threshold is passed. Two changes make that fit a corpus:

* Ranks are names: the rank of a pair is a mix of the two ranks (8, 16, 32, ... bytes, starting from the bytes
  themselves), so that equal strings get equal ranks without a global numbering, and a rank between two powers of two is
  that of the pair of overlapping halves. Pairs are formed where the text is, and Spark sorts and counts the ranks.
* Neighbouring positions travel together as one run. All starts whose string has the same least
  `seed`-byte word (by rank, leftmost) form a run; its members share that word at a fixed distance, so
  the word is a rank for all of them. About one row for 75 bytes results, instead of 75.

Each round has a core (what all members of a run share) and a reach (all bytes of all members). A core
found once: all members are unique and leave. A reach found again: all members are repeats and are settled.
What is neither is cut into shorter runs, whose cores are longer: `seed` bytes first, then all but 15 bytes
of the string, then the whole string with one position to a run, which settles everything.

Equal texts take part once: they are found by two 64-bit hashes, and all of a text that occurs again goes if it has
`length` bytes. In the last round a string has two ranks of 64 bits, of mixes that have nothing in common, so two
different ones among n are taken for equal with a chance of about n * n / 2^129; in the rounds before, a
wrongly equal core costs only work, and a reach is compared among runs of the same core. Groups are only ever counted, by
aggregation before the shuffle; members are found again by equi-joins that Spark can split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise, release, ship

CHUNK = 1 << 18
PART = 16
BITS = 11  # of a position for the distance to the seed, and for the length of the run
RUN = "core long, reach long, key long, at long"
LEAST = 8  # bytes that are their own rank

_MIX = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93), (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xA24BAED4963EE407))


def paired(a: np.ndarray, b: np.ndarray, family: int = 0) -> np.ndarray:
    """The rank of each pair of ranks: equal for equal pairs, and not the same for (a, b) and (b, a)."""
    p, q, r = (np.uint64(x) for x in _MIX[family])
    h = a * p
    h ^= h >> np.uint64(31)
    h += b
    h *= q
    h ^= h >> np.uint64(29)
    h *= r
    h ^= h >> np.uint64(32)
    return h


class Ranks:
    """Ranks of any slices of some bytes, from those of 8, 16, 32, ... bytes at every position."""

    def __init__(self, data: np.ndarray, family: int = 0) -> None:
        self.n, self.family = len(data), family
        padded = np.concatenate([data, np.zeros(2 * LEAST, dtype=np.uint8)])
        whole = np.empty(self.n, dtype="<u8")
        for k in range(LEAST):
            part = padded[k : k + (self.n - k + LEAST - 1) // LEAST * LEAST].view("<u8")
            whole[k::LEAST] = part[: len(whole[k::LEAST])]
        self.levels = [whole]

    def level(self, k: int) -> np.ndarray:
        """Ranks of LEAST << k bytes at each position; those that reach over the end mean nothing."""
        while len(self.levels) <= k:
            half, h = self.levels[-1], LEAST << (len(self.levels) - 1)
            self.levels.append(paired(half[: max(0, len(half) - h)], half[h:], self.family))
        return self.levels[k]

    def all_of(self, size: int) -> np.ndarray:
        """The rank of the `size` bytes at each position that has so many."""
        k = (size // LEAST).bit_length() - 1
        m = self.n - size + 1
        return paired(self.level(k)[:m], self.level(k)[size - (LEAST << k) :][:m], self.family)

    def of(self, start: np.ndarray, end: np.ndarray, tag: np.ndarray | int = 0) -> np.ndarray:
        """The rank of the bytes from `start` to `end`, at least LEAST, with their number and `tag`."""
        size = end - start
        if len(size) and (size == size[0]).all():
            k = (int(size[0]) // LEAST).bit_length() - 1
            level = self.level(k)
            out = paired(level[start], level[end - (LEAST << k)], self.family)
            return paired(out, (size.astype(np.uint64) << np.uint64(32)) + np.asarray(tag, dtype=np.uint64), self.family)
        out = np.empty(len(start), dtype=np.uint64)
        powers = np.log2(np.maximum(size, LEAST) // LEAST).astype(np.int64)
        for k in np.unique(powers).tolist():
            level, mine = self.level(k), powers == k
            out[mine] = paired(level[start[mine]], level[end[mine] - (LEAST << k)], self.family)
        return paired(out, (size.astype(np.uint64) << np.uint64(32)) + np.asarray(tag, dtype=np.uint64), self.family)


def seed_runs(ranks: Ranks, windows: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Runs of the starts marked in `windows`: first start, position of the seed, number of starts, and the seed's rank."""
    n = ranks.n
    at = np.arange(n - seed + 1)
    words = ranks.all_of(seed)
    wide, low = length - seed + 1, np.uint64((1 << 24) - 1)
    keyed = (words & ~low) | at.astype(np.uint64)
    padded = np.concatenate([keyed, np.full(-len(keyed) % wide, ~np.uint64(0))]).reshape(-1, wide)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - length + 1
    least = (np.minimum(after[:m], before[wide - 1 : wide - 1 + m]) & low).astype(np.int64)
    new = np.ones(m, dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (windows[1:] != windows[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, m))
    inside = windows[first]
    first, count = first[inside], count[inside]
    seeds = least[first]
    return first, seeds, count, words[seeds]


def pack(first: np.ndarray, back: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (first << 2 * BITS) | (back << BITS) | count


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 2 * BITS, (at >> BITS) & ((1 << BITS) - 1), at & ((1 << BITS) - 1)


def _pieces(keys: list[int], texts: list[bytes | None], length: int) -> Iterator[tuple[np.ndarray, list[int], list[int], list[int]]]:
    """Texts of at least `length` bytes joined to some CHUNK bytes, longer ones cut so that each start is in one piece whole.

    Yields the bytes, and of each text in them its key, first byte there and offset in the text.
    """
    held: list[bytes] = []
    at: list[tuple[int, int, int]] = []
    size = 0
    for key, text in zip(keys, texts, strict=True):
        if text is None or len(text) < length:
            continue
        for cut in range(0, len(text) - length + 1, CHUNK):
            part = text[cut : cut + CHUNK + length - 1] if cut or len(text) > CHUNK + length - 1 else text
            if size and size + len(part) > CHUNK:
                yield np.frombuffer(b"".join(held), dtype=np.uint8), *map(list, zip(*at, strict=True))
                held, at, size = [], [], 0
            at.append((key, size, cut))
            held.append(part)
            size += len(part)
    if held:
        yield np.frombuffer(b"".join(held), dtype=np.uint8), *map(list, zip(*at, strict=True))


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.uint64, copy=False).view(np.int64) if c.dtype != np.int64 else c) for c in columns], names=["core", "reach", "key", "at"])


def first_runs(length: int, seed: int) -> Callable:
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, keys, starts, cuts in _pieces(batch["key"].to_pylist(), batch["data"].to_pylist(), length):
                ranks = Ranks(data)
                edge = np.zeros(len(data) + 1, dtype=np.int32)
                begin = np.array(starts)
                end = np.append(begin[1:], len(data))
                edge[begin] += 1
                edge[end - length + 1] -= 1
                first, at, count, core = seed_runs(ranks, np.cumsum(edge[: len(data) - length + 1]) > 0, length, seed)
                back = at - first
                text = np.searchsorted(begin, first, side="right") - 1
                reach = ranks.of(first, first + count - 1 + length, (back << BITS) | count)
                place = pack(first - begin[text] + np.array(cuts)[text], back, count)
                yield _batch(core, reach, np.array(keys, dtype=np.int64)[text], place)

    return runs


def shorter_runs(length: int, part: int) -> Callable:
    """Cuts the runs listed for each text into runs of up to `part` starts, at multiples of `part` from the seed."""

    def cut(data: np.ndarray, ats: list[np.ndarray], keys: list[int], bases: list[int]) -> Iterator[pa.RecordBatch]:
        """The runs `ats` of several texts that begin at `bases` in `data`."""
        many = [len(a) for a in ats]
        key, base = np.repeat(np.array(keys, dtype=np.int64), many), np.repeat(np.array(bases, dtype=np.int64), many)
        first, back, count = unpack(np.concatenate([np.sort(a) for a in ats]))
        first = first + base
        at = 0
        # only the neighbourhoods of the listed runs are ranked, in pieces: texts may be very long
        while at < len(first):
            stop = int(np.searchsorted(first, first[at] + CHUNK, side="right"))
            low = int(first[at])
            high = int((first[at:stop] + count[at:stop]).max()) + length - 1
            ranks = Ranks(data[low:high])
            n = count[at:stop]
            run = np.repeat(np.arange(at, stop), n)
            starts = np.repeat(first[at:stop] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            seeds = first[run] + back[run]
            behind = seeds - starts
            new = np.ones(len(starts), dtype=bool)
            new[1:] = (behind[1:] // part != behind[:-1] // part) | (seeds[1:] != seeds[:-1])
            lead = np.flatnonzero(new)
            size = np.diff(np.append(lead, len(starts)))
            begin, seat, run = starts[lead], seeds[lead], run[lead]
            far = (behind[lead] // part) * part
            whole = seat - far - low  # the last start of a whole run of this part
            core = ranks.of(whole, whole - (part - 1) + length, far if part > 1 else 0)
            span = begin - low
            if part > 1:
                reach = ranks.of(span, span + size - 1 + length, (behind[lead] << BITS) | size)
            else:
                reach = Ranks(data[low:high], family=1).of(span, span + length)
            yield _batch(core, reach, key[run], pack(begin - base[run], behind[lead], size))
            at = stop

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: tuple[list, list, list, list] = ([], [], [], [])
            size = 0
            for key, data, ats in zip(batch["key"].to_pylist(), batch["data"], batch["ats"], strict=True):
                raw = np.frombuffer(data.as_buffer(), dtype=np.uint8)
                for x, value in zip(held, (raw, ats.values.to_numpy(), key, size), strict=True):
                    x.append(value)
                size += len(raw)
                if size >= CHUNK:
                    yield from cut(np.concatenate(held[0]), *held[1:])
                    held, size = ([], [], [], []), 0
            if held[0]:
                yield from cut(np.concatenate(held[0]), *held[1:])

    return runs


def _rerank(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: (key, at) of settled runs, and of one run for each reach whose core has several."""
    cores = runs.groupBy("core").agg(F.count("*").alias("n"), F.min("reach").alias("a"), F.max("reach").alias("b"))
    # written first: with two plain sides, Spark splits a core that very many runs share over several tasks
    cores = materialise(cores.where("n > 1").select("core", F.expr("a = b").alias("whole")), "cores")
    release(runs.sparkSession)
    alive = materialise(runs.join(cores, "core"), "runs")
    discard(cores)
    release(runs.sparkSession)
    reaches = alive.where("not whole").groupBy("core", "reach").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("one"))
    reaches = materialise(reaches, "reaches")
    again = alive.where("not whole").join(reaches.where("n > 1").select("core", "reach"), ["core", "reach"])
    settled = materialise(alive.where("whole").select("key", "at").union(again.select("key", "at")), "settled")
    unsettled = materialise(reaches.select("one.key", "one.at"), "unsettled")
    for old in (alive, reaches):
        discard(old)
    release(runs.sparkSession)
    return settled, unsettled


def repeated_runs(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """docs (key, data binary) -> (key, ats): for each text, its runs of starts of strings that start elsewhere too."""
    listed = lambda x: x.groupBy("key").agg(F.collect_list("at").alias("ats"))
    found, unsettled = _rerank(docs.mapInArrow(first_runs(length, seed), RUN))
    for part in (PART, 1):
        # each text comes with its runs; those are at most as many as it has bytes
        runs = materialise(docs.join(listed(unsettled), "key").mapInArrow(shorter_runs(length, part), RUN), "shorter")
        release(docs.sparkSession)
        settled, unsettled = _rerank(runs)
        discard(runs)
        found = found.union(settled)
    return listed(found)


def _spans(ats: np.ndarray | None, length: int) -> list[tuple[int, int]]:
    if ats is None or not len(ats):
        return []
    first, _, count = unpack(np.sort(ats))
    end = np.maximum.accumulate(first + count - 1 + length)
    new = np.flatnonzero(np.append(True, first[1:] > end[:-1]))
    return list(zip(first[new].tolist(), end[np.append(new[1:], len(end)) - 1].tolist(), strict=True))


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 200, seed: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """Remove every byte of each text that is covered by a `length`-byte string starting anywhere else too.

    Returns, for each input row, the id, n_bytes, spans (maximal removed runs, array of (start, stop) in bytes),
    n_removed, kept (the remaining bytes, binary), kept_text (the same as text, without characters that a cut
    went through) and the columns `keep`. Matches never cross texts; strings are judged on the
    input. A null text counts as empty; a text shorter than `length` keeps all. Repeated rows are copies of
    each other, so all that reach `length` lose everything. Further columns of the input are not
    read.
    """
    if not LEAST <= seed <= length or length - seed >= (1 << BITS) or length <= PART + LEAST:
        raise ValueError(f"seed must lie in {LEAST}..length, length above {PART + LEAST} and less than 2048 more than the seed")
    ship(df.sparkSession)
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    named = [F.xxhash64(data).alias("h1"), F.xxhash64(F.lit(1), data, F.length(data)).alias("h2")]
    copies = df.select(*named, data.alias("data")).groupBy("h1", "h2").agg(F.first("data").alias("data"), F.count("*").alias("n"))
    texts = materialise(copies.withColumn("key", F.monotonically_increasing_id()), "texts")
    release(df.sparkSession)
    lists = repeated_runs(texts.select("key", "data"), length, seed)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, ats, n in zip(batch["data"], batch["ats"], batch["n"].to_pylist(), strict=True):
                raw = text.as_py()
                again = n > 1 and len(raw) >= length
                spans = [(0, len(raw))] if again else _spans(ats.values.to_numpy() if ats.is_valid else None, length)
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                rows.append((len(raw), [{"start": a, "stop": b} for a, b in spans], sum(b - a for a, b in spans), b"".join(kept), "".join(x.decode("utf-8", "ignore") for x in kept)))
            n, spans, gone, kept, cut = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch["h1"], batch["h2"], pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()), pa.array(cut, pa.string())],
                names=["h1", "h2", "n_bytes", "spans", "n_removed", "kept", "kept_text"],
            )

    joined = texts.join(lists, "key", "left").select("h1", "h2", "data", "n", "ats")
    cut = joined.mapInArrow(remove, "h1 long, h2 long, n_bytes long, spans array<struct<start:long,stop:long>>, n_removed long, kept binary, kept_text string")
    rows = df.select(*named, F.col(id_col).alias("_id"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    whole = rows.join(cut.hint("merge"), ["h1", "h2"])
    return whole.select(F.col("_id").alias(id_col), "n_bytes", "spans", "n_removed", "kept", "kept_text", *(F.col(f"_keep_{c}").alias(c) for c in keep))
