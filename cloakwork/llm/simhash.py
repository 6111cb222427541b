"""SimHash near-duplicates by segment popcounts.

A fingerprint's 22 segments of three bits are replaced by their bit counts. The Manhattan distance of two
such vectors is a lower bound of the Hamming distance of the fingerprints, so a range join on a grid of
these vectors keeps every pair in range. Two grid points at distance two or less share a point at distance
one or less from both; meeting at those points makes the range join an equi-join, and grouping there keeps
it linear. The pairs that the grid leaves are settled the same way on the fingerprints themselves (a second
meeting at values one bit away), which is exact. Sides that grow with the input are never broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import discard, materialise, release, ship

SEED = 42
SLICE = 200_000


def fingerprint(text: str | None, n: int = 3) -> int:
    """SimHash of a whole text: ASCII lower case, words between white space, shingles of `n` words with repeats.

    Fewer than n words make one shingle; no word gives 0. A bit is set if over half the XXH64 values have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = min(n, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(words) - n + 1], ends[n - 1 :]
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), SLICE):
        pieces = map(joined.__getitem__, map(slice, starts[at : at + SLICE].tolist(), ends[at : at + SLICE].tolist()))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), dtype="<u8", count=len(starts[at : at + SLICE]))
        total += _bit_sums(hashes)
    return _majority(total, len(starts))


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(total: np.ndarray, n: int) -> int:
    return int(np.packbits((2 * total > n).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprint_of_set(shingles: np.ndarray) -> int:
    """SimHash of distinct shingle hashes, each counted once."""
    total = sum((_bit_sums(shingles[at : at + SLICE]) for at in range(0, len(shingles), SLICE)), np.zeros(64, dtype=np.int64))
    return _majority(total, len(shingles)) if len(shingles) else 0


def fingerprints(df: DataFrame, text: str = "text", words: int = 3) -> Column:
    """The fingerprint of each text as a (signed) long column."""
    ship(df.sparkSession)

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t, words) for t in batch], dtype="int64")

    return simhash(F.col(text))


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def segment_counts(fp: Column) -> Column:
    """Bit counts of the 22 segments of three bits (the last has one), each in its three bits of a long."""
    ones = [F.shiftrightunsigned(fp, k).bitwiseAND(_signed(0x9249249249249249)) for k in range(3)]
    return ones[0] + ones[1] + ones[2]


def _grid_points(cell: Column) -> Column:
    """The grid points at Manhattan distance one or less."""
    steps = [1 << (3 * j) for j in range(21)]
    up = [cell + F.lit(s) for s in steps]
    down = [F.when(F.shiftrightunsigned(cell, 3 * j).bitwiseAND(F.lit(7)) > 0, cell - F.lit(s)) for j, s in enumerate(steps)]
    last = cell.bitwiseXOR(_signed(1 << 63))  # one up or one down, as it is a single bit
    return F.array_compact(F.array(cell, last, *up, *down))


def _flips(fp: Column) -> Column:
    """The 65 values at Hamming distance one or less."""
    return F.array(fp, *[fp.bitwiseXOR(_signed(1 << j)) for j in range(64)])


def near_links(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) at Hamming distance two or less that connect all that are so linked.

    The grid keeps the fingerprints with any other in Manhattan range. Of those that then meet at one value
    (each at Hamming distance one or less from it) all are in range of each other; each is linked to the least.
    So a group of k takes k edges, never k * k pairs. A null fingerprint has no edge; other columns are not read.
    """
    cells = prints.groupBy(segment_counts(F.col("fp")).alias("cell")).agg(F.count("*").alias("n"))
    points = cells.select("cell", "n", F.explode(_grid_points(F.col("cell"))).alias("point"))
    shared = points.groupBy("point").agg(F.sum("n").alias("n")).where("n > 1").select("point")
    near = points.join(shared.hint("merge"), "point").select("cell").distinct()
    kept = prints.withColumn("cell", segment_counts(F.col("fp"))).join(near.hint("merge"), "cell").select("fp")
    meets = materialise(kept, "simhash-near").select("fp", F.explode(_flips(F.col("fp"))).alias("at"))
    hubs = meets.groupBy("at").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").select("at", "hub")
    return meets.join(hubs.hint("merge"), "at").where("fp <> hub and bit_count(fp ^ hub) <= 2").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """One row per input row: the id, fingerprint (16 hex digits) and component_id.

    Texts whose fingerprints differ in two bits or fewer are linked; component_id is the least id reachable.
    Null, empty and blank texts have fingerprint zero and are linked like others. Copies fall together in an
    aggregation before any join. Null ids never name a component unless all ids of it are null.
    """
    prints = materialise(df.select(F.col(id_col).alias("id"), fingerprints(df, text, words).alias("fp")), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    links = near_links(distinct.select("fp"))
    member = connected_components(links).select(F.col("node").alias("fp"), F.col("component"))
    root = F.coalesce("component", "fp")
    known = materialise(distinct.join(member.hint("merge"), "fp", "left").select("fp", "least", root.alias("root")), "simhash-roots")
    least = materialise(known.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = known.join(least.hint("merge"), "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named.hint("merge"), "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


#: For similar_groups: one text in so many is sampled for common shingles; found there so often, a shingle is common; so many are told apart.
SAMPLED = 16
COMMON = 4
MOST_COMMON = 200_000
#: So many hashes of texts to compare are broadcast; if there are more, all texts are shuffled to meet them.
MOST_WANTED = 1_000_000
#: Bits of the map of a set's hashes.
MAP = 1024
#: hub_rounds(): so many hubs a shingle at first, at shingles that have over GROWTH times as many sets; in each round after, GROWTH times as many, if no other growth is given.
HUBS = 8
GROWTH = 4


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """The distinct XXH64 values of a text's shingles of `n` words, in order; words as in fingerprint()."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    joined, n = b" ".join(words), min(n, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(words) - n + 1], ends[n - 1 :]
    hashes = np.empty(len(starts), dtype="<u8")
    for at in range(0, len(starts), SLICE):
        pieces = map(joined.__getitem__, map(slice, starts[at : at + SLICE].tolist(), ends[at : at + SLICE].tolist()))
        hashes[at : at + SLICE] = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), dtype="<u8", count=len(starts[at : at + SLICE]))
    return np.unique(hashes)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, "<u8"), *arrays]).view("<i8")))


def _node(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), SEED)).astype(np.int64))


def _map(shingles: np.ndarray) -> np.ndarray:
    """Which of MAP bits the hashes fall on, as longs: two maps differ in no more bits than the sets have shingles of their own."""
    bits = np.zeros(MAP, dtype=np.uint8)
    bits[(shingles % np.uint64(MAP)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def _common_shingles(df: DataFrame, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample of the texts, in order, and how often they are. They only say in which order shingles are tried."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch["text"].to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, words).view("<i8"))], names=["shingle"])

    sample = df.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).mapInArrow(shingles, "shingle long")
    counts = sample.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    found = counts.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).toArrow()
    at, n = found["shingle"].to_numpy().view("<u8"), found["n"].to_numpy()
    order = np.argsort(at)
    return at[order], n[order]


def _differ(x: str, y: str) -> Column:
    """In how many bits two maps differ."""
    parts = [F.bit_count(F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))) for k in range(MAP // 64)]
    return sum(parts[1:], parts[0])


def _alike(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """Of the pairs (a, b) those whose shingle sets have that Jaccard similarity.

    The maps rule out most others; of those left the sets are made from the texts and compared.
    """

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(t, words) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(_node, own)), pa.int64()), _lists(own)], names=["node", "shingles"])

    x, y = (nodes.select(F.col("node").alias(k), F.col("n").alias(f"{k}n"), F.col("copy").alias(f"{k}copy"), F.col("map").alias(f"{k}map")) for k in "ab")
    left = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").where(_differ("amap", "bmap") <= _most_own(similarity) * (F.col("an") + F.col("bn"))).select("a", "b", "acopy", "bcopy")
    left = materialise(left, "left")
    # each text once, by its hash; a text that shares the hash by chance has a node of its own
    wanted = materialise(left.select(F.explode(F.array("acopy", "bcopy")).alias("copy")).distinct(), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= MOST_WANTED else wanted.hint("merge")
    sets = texts.join(few, "copy", "left_semi").dropDuplicates(["copy"]).select("text").mapInArrow(shingles, "node long, shingles array<long>")
    sets = materialise(sets, "sets")
    release(pairs.sparkSession)
    x, y = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"{k}set")) for k in "ab")
    both = left.select("a", "b").join(x.hint("merge"), "a").join(y.hint("merge"), "b")
    both = both.select("a", "b", (F.size("aset") + F.size("bset")).alias("n"), F.size(F.array_intersect("aset", "bset")).alias("same"))
    found = materialise(both.where(F.col("same") >= F.lit(similarity - 1e-9) * (F.col("n") - F.col("same"))).select("a", "b"), "alike")
    for old in (left, wanted, sets):
        discard(old)
    release(pairs.sparkSession)
    return found


def _most_own(similarity: float) -> Column:
    """The share of both sets' shingles that sets of that similarity do not share, at most."""
    return F.lit(1 - 2 * similarity / (1 + similarity) + 1e-9)


def _near_prints(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes whose fingerprints near_links() joins, each fingerprint by its least node, and nodes of equal fingerprints with that."""
    least = materialise(nodes.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    ends = [least.select(F.col("fp").alias(k), F.col("first").alias(f"{k}_first")) for k in "ab"]
    links = near_links(least.select("fp")).join(ends[0].hint("merge"), "a").join(ends[1].hint("merge"), "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    same = nodes.select("node", "fp").join(least.hint("merge"), "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return links.union(same)


def mixed_rows(rest: DataFrame, member: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of `rest` at shingles where unlike components meet, with the component (c) and the map."""
    named = rest.join(member.hint("merge"), "node", "left").select(*rest.columns, F.coalesce("component", "node").alias("c"))
    named = materialise(named, "named")
    mixed = materialise(named.groupBy("shingle").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a < b").select("shingle"), "mixed")
    found = materialise(named.join(mixed.hint("merge"), "shingle").join(nodes.select("node", "map").hint("merge"), "node"), "rest")
    for old in (named, mixed):
        discard(old)
    return found


def hub_rounds(rest: DataFrame, nodes: DataFrame, member: DataFrame, pairs: DataFrame, links: Callable[[DataFrame], DataFrame], near: Column, growth: int = GROWTH) -> tuple[DataFrame, list[DataFrame], Column]:
    """Compare the sets of large groups with more and more hubs, so that few pairs of unlike components are left.

    rest: (shingle, k, node, n, left), k sets at each shingle; member: (node, component); pairs: (a, b) that need no comparison any more.
    links: candidate pairs (a, b, probe) -> links (a, b), written and without repeats; growth: so many times as many hubs in each round; near: what two rows x and y must fulfil. A set that has a share s of a group for
    neighbours falls in with it after about 1 / s hubs, so only sets with few neighbours are ever compared with many.
    Returns the new members, the tables of all pairs compared, and the number of hubs a row's shingle has had: a row whose turn() is
    below it has met all others there.
    """
    compared, tried, hubs, bar = [pairs], 0, HUBS, F.lit(0)
    most = rest.agg(F.max("k")).first()[0] or 0
    while most > GROWTH * hubs:
        large = mixed_rows(rest.where(F.col("k") > GROWTH * hubs), member, nodes)
        if large.isEmpty():
            discard(large)
            break
        x, y = (large.select(*(F.col(c).alias(f"{s}{c}") for c in large.columns), turn().alias(f"{s}turn")) for s in "xy")
        y = y.where((F.col("yturn") >= tried) & (F.col("yturn") < hubs))
        more = x.join(y.hint("merge"), (F.col("xshingle") == F.col("yshingle")) & (F.col("xc") != F.col("yc")) & near)
        more = more.groupBy(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b")).agg(F.max("xnode").alias("probe"))
        more = materialise(more.join(known_pairs(compared).hint("merge"), ["a", "b"], "left_anti"), "hub-pairs")
        discard(large)
        if not more.isEmpty():
            then, found = member, links(more)
            member = connected_components(found.union(then), written=True)
            for old in (then, found):
                discard(old)
            release(rest.sparkSession)
        compared.append(more)
        bar = F.when(F.col("k") > GROWTH * hubs, hubs).otherwise(bar)
        tried, hubs = hubs, growth * hubs
    return member, compared, bar


def known_pairs(compared: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, (x.select("a", "b") for x in compared))


def turn() -> Column:
    """When a set is a hub at a shingle: spread evenly from 0 to k - 1, in the same order at all shingles."""
    return F.shiftrightunsigned(F.shiftrightunsigned(F.xxhash64("node"), 33) * F.col("k"), 31)


def similar_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id_col, group): documents linked, over any number of steps, by a Jaccard similarity of their shingle sets of at least that.

    Exact, up to collisions of 64-bit hashes. Equal sets fall together first. Candidates come from two sides, and
    every one is compared by its sets. Fingerprints of the sets within two bits meet by their segments' bit counts,
    as in near_duplicates(): a large group of close copies costs links in proportion to its size. But sets of
    similarity 0.8 differ in about ten of 64 bits, where no such bound rules anything out. So shingles also have one
    order, common ones last; of two sets of that similarity J, the first n - ceil(J n) + 1 shingles of each have
    one in common (prefix filtering), so sets meet at those. At each such shingle all are compared with the two that a hash
    puts first. Components of these links need no further comparison inside; where many sets of different components still meet,
    they are compared with more hubs (hub_rounds()). Then the pairs of different
    components that meet anywhere, and whose sizes, places and maps allow the similarity, are compared. No pair is left out.
    group is the least id; null and empty texts are one group.
    """
    spark = df.sparkSession
    ship(spark)
    common, often = _common_shingles(df, text, words)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prints, maps, firsts = [], [], [], [], []
            for t in batch["text"].to_pylist():
                own = shingle_set(t, words)
                if len(common) and len(own):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    tried = own[np.argsort(np.where(common[at] == own, often[at], 0), kind="stable")]
                else:
                    tried = own
                nodes.append(_node(own))
                sizes.append(len(own))
                prints.append(fingerprint_of_set(own))
                maps.append(_map(own))
                firsts.append(tried[: len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1].copy())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["copy"], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), _lists(maps), _lists(firsts)], names=["id", "copy", "node", "n", "fp", "map", "firsts"])

    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("copy"), F.col(text).alias("text"))
    signed = materialise(texts.mapInArrow(sign, f"id {kind}, copy long, node long, n int, fp long, map array<long>, firsts array<long>"), "shingles")
    rows = materialise(signed.select("id", "node"), "rows")
    nodes = signed.groupBy("node").agg(F.min("copy").alias("copy"), *(F.first(c).alias(c) for c in ("n", "fp", "map", "firsts")))
    nodes = materialise(nodes, "nodes")
    discard(signed)
    release(spark)
    # left: the shingles of a set from this one on, the most that two sets share which meet at it first
    meets = nodes.select("node", "n", F.posexplode("firsts").alias("at", "shingle")).select("node", "n", (F.col("n") - F.col("at")).alias("left"), "shingle")
    shared = materialise(nodes.select(F.explode("firsts").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("k")).where("k > 1"), "shared")
    release(spark)
    meets = materialise(meets.join(shared.hint("merge"), "shingle"), "meets")
    slim = materialise(nodes.drop("firsts"), "nodes")
    for old in (shared, nodes):
        discard(old)
    nodes = slim
    release(spark)
    # the same hubs at all shingles of a group, so that few different pairs come of it
    order = F.struct(F.xxhash64("node"), "node", "n", "left")
    hubs = meets.groupBy("shingle").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    hubs = materialise(hubs, "hubs")  # so that Spark can split a shingle of many documents
    need = similarity / (1 + similarity) - 1e-9
    in_range = lambda x, y: F.least(f"{x}left", f"{y}left") >= F.lit(need) * (F.col(f"{x}n") + F.col(f"{y}n"))
    pairs = meets.join(hubs.hint("merge"), "shingle").select("node", "n", "left", F.explode(F.array("first", "last")).alias("o"))
    pairs = pairs.select("node", "n", "left", F.col("o.node").alias("other"), F.col("o.n").alias("o_n"), F.col("o.left").alias("o_left"))
    pairs = pairs.where((F.col("node") != F.col("other")) & in_range("", "o_")).select(F.col("node").alias("a"), F.col("other").alias("b"))
    pairs = pairs.union(_near_prints(nodes)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialise(pairs.distinct(), "pairs")
    release(spark)
    member = connected_components(_alike(pairs, nodes, texts, similarity, words), written=True)
    release(spark)
    # with up to three sets, all have met
    rest = meets.where("k > 3").join(hubs.hint("merge"), "shingle").where("node <> first.node and node <> last.node")
    rest = materialise(rest.select("shingle", "k", "node", "n", "left"), "rest")
    for old in (meets, hubs):
        discard(old)
    near = in_range("x", "y") & (_differ("xmap", "ymap") <= _most_own(similarity) * (F.col("xn") + F.col("yn")))
    member, compared, bar = hub_rounds(rest, nodes, member, pairs, lambda more: _alike(more.select("a", "b"), nodes, texts, similarity, words), near)
    left = mixed_rows(rest.where(turn() >= bar), member, nodes)
    release(spark)
    x, y = (left.select(*(F.col(c).alias(f"{k}{c}") for c in ("shingle", "node", "n", "left", "c", "map"))) for k in "xy")
    more = x.join(y.hint("merge"), (F.col("xshingle") == F.col("yshingle")) & (F.col("xc") < F.col("yc")) & near)
    more = more.select(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b")).distinct()
    more = materialise(more.join(known_pairs(compared).hint("merge"), ["a", "b"], "left_anti"), "more")
    for old in (rest, left, *compared):
        discard(old)
    links = _alike(more, nodes, texts, similarity, words).union(member)
    for old in (nodes, more):
        discard(old)
    member = connected_components(links, written=True)
    rooted = rows.join(member.hint("merge"), "node", "left").select("id", F.coalesce("component", "node").alias("root"))
    rooted = materialise(rooted, "simhash-roots")
    discard(rows)
    release(spark)
    named = materialise(rooted.groupBy("root").agg(F.min("id").alias("group")), "groups")
    return rooted.join(named.hint("merge"), "root").select(F.col("id").alias(id_col), "group")
