"""Set similarity join of n-gram sets by prefix trees.

A text's set is its distinct shingles in one global order: common ones first, told from a sample, then by hash. Read from its rare end, the
order gives the prefix filter: sets of Jaccard similarity t share one of their n - ceil(t n) + 1 rarest shingles, so sets meet at
those. Where they meet they are joined by tries: the candidates of a set are stored in a trie of ordered shingles, in
blocks of bounded size; one walk with that set counts overlaps along the paths, once for all candidates that share them, and leaves a subtree when
what remains of either side cannot make up the overlap that its smallest set would need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import discard, materialise, release, ship
from .simhash import MOST_WANTED, _common_shingles, _differ, _lists, _map, _most_own, _node, hub_rounds, known_pairs, mixed_rows, shingle_set, turn

#: Shingles of the candidates that are put into one trie, about.
BLOCK = 1 << 18
#: So many times as many hubs in each round of hub_rounds(): walks through tries make a pair cheap, and a round is many jobs.
GROWTH = 8


def least_overlap(n: int, m: int, part: int, whole: int) -> int:
    """The least size of the intersection of sets of n and m elements with similarity part / whole."""
    return -(-part * (n + m) // (part + whole))


class Trie:
    """Ordered arrays of 64-bit shingles; paths without a branch are one edge."""

    __slots__ = ("edge", "ends", "kids", "largest", "smallest")

    def __init__(self, edge: np.ndarray) -> None:
        self.edge, self.kids, self.ends = edge, {}, []
        self.smallest, self.largest = 1 << 62, 0

    def sized(self, n: int) -> None:
        self.smallest, self.largest = min(self.smallest, n), max(self.largest, n)

    def put(self, tokens: np.ndarray, name: int) -> None:
        node, at, n = self, 0, len(tokens)
        node.sized(n)
        while at < n:
            kid = node.kids.get(int(tokens[at]))
            if kid is None:
                kid = node.kids[int(tokens[at])] = Trie(tokens[at:])
                kid.sized(n)
                node, at = kid, n
                break
            both = min(len(kid.edge), n - at)
            differ = np.flatnonzero(kid.edge[:both] != tokens[at : at + both])
            same = int(differ[0]) if len(differ) else both
            if same < len(kid.edge):  # cut the edge there
                upper = Trie(kid.edge[:same])
                upper.smallest, upper.largest = kid.smallest, kid.largest
                kid.edge = kid.edge[same:]
                upper.kids[int(kid.edge[0])] = kid
                node.kids[int(tokens[at])] = kid = upper
            kid.sized(n)
            node, at = kid, at + same
        node.ends.append(name)


def walk(trie: Trie, probe: np.ndarray, part: int, whole: int) -> Iterator[int]:
    """The names in the trie whose sets have similarity part / whole or more with the probe, a non-empty ordered array."""
    order = np.argsort(probe)
    ranked, n = probe[order], len(probe)
    stack = [(trie, 0, 0, n)]
    while stack:
        node, depth, overlap, left = stack.pop()
        if len(node.edge):
            at = np.minimum(np.searchsorted(ranked, node.edge), n - 1)
            hits = at[ranked[at] == node.edge]
            depth += len(node.edge)
            overlap += len(hits)
            if len(hits):  # what lies before the last hit in the order cannot be met any more
                left = n - 1 - int(order[hits[-1]])
        if overlap + min(node.largest - depth, left) < least_overlap(n, node.smallest, part, whole):
            continue
        if node.ends and overlap >= least_overlap(n, depth, part, whole):
            yield from node.ends
        stack += [(kid, depth, overlap, left) for kid in node.kids.values()]


def _walks(part: int, whole: int):
    """Rows sorted by (probe, block, kind): the probe's own set, then its candidates -> links (a, b)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, trie = None, None, None

        def links() -> pa.RecordBatch:
            names = list(walk(trie, own, part, whole)) if trie is not None else []
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(names), pa.int64()), pa.array(names, pa.int64())], names=["a", "b"])

        for batch in batches:
            lists = batch["shingles"]
            values, ends = lists.flatten().to_numpy(zero_copy_only=False).view("<u8"), np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            for i, (probe, block, kind, node) in enumerate(zip(*(batch[c].to_pylist() for c in ("probe", "block", "kind", "node")), strict=True)):
                tokens = values[ends[i] : ends[i + 1]].copy()
                if (probe, block) != now:
                    if now is not None:
                        yield links()
                    now, own, trie = (probe, block), None, Trie(np.empty(0, "<u8"))
                if kind:
                    trie.put(tokens, node)
                else:
                    own = tokens
        if now is not None:
            yield links()

    return found


class _Order:
    """The global order of shingles."""

    def __init__(self, common: np.ndarray, often: np.ndarray) -> None:
        self.common, self.often = common, often

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """Distinct sorted shingles, common ones first."""
        if not len(self.common) or not len(shingles):
            return shingles
        at = np.minimum(np.searchsorted(self.common, shingles), len(self.common) - 1)
        return shingles[np.argsort(np.where(self.common[at] == shingles, -self.often[at], 0), kind="stable")]


def _wanted_sets(sized: DataFrame, texts: DataFrame, order: _Order, words: int) -> DataFrame:
    """(node, shingles) of the texts whose hashes (copy) are named, each once, in the global order."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(t, words) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(_node, own)), pa.int64()), _lists([order(s) for s in own])], names=["node", "shingles"])

    wanted = named = sized.select("copy").distinct()
    if sized.count() > MOST_WANTED:
        wanted = materialise(named, "wanted")
    few = F.broadcast(wanted) if wanted is named or wanted.count() <= MOST_WANTED else wanted.hint("merge")
    made = texts.join(few, "copy", "left_semi").dropDuplicates(["copy"]).select("text").mapInArrow(shingles, "node long, shingles array<long>")
    made = materialise(made, "sets")
    if wanted is not named:
        discard(wanted)
    return made


def trie_links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, order: _Order, words: int, part: int, whole: int) -> DataFrame:
    """Of the candidate pairs (probe, node), distinct, the links (a, b) that the tries find.

    The candidates of one probe are dealt into blocks by their number of shingles, and the probe (kind 0) goes to each of its blocks.
    """
    ends = pairs.select("probe", "node", F.lit(1).alias("kind")).union(pairs.select("probe", F.col("probe").alias("node"), F.lit(0)).distinct())
    sized = materialise(ends.join(nodes.select("node", "n", "copy").hint("merge"), "node"), "sized")
    blocks = F.ceil(F.sum(F.col("n") * F.col("kind")) / BLOCK)
    # written first, so that Spark can split a probe of many candidates; most often there is none of several blocks
    large = materialise(sized.groupBy("probe").agg(blocks.alias("blocks")).where("blocks > 1"), "large-probes")
    if large.isEmpty():
        dealt, used = sized.withColumn("block", F.lit(0).cast("long")), [sized, large]
    else:
        blocks = F.coalesce("blocks", F.lit(1).cast("long"))
        block = F.when(F.col("kind") == 1, F.array(F.pmod(F.xxhash64("node"), blocks))).otherwise(F.sequence(F.lit(0).cast("long"), blocks - 1))
        dealt = sized.join(large.hint("merge"), "probe", "left").select("probe", "node", "kind", F.explode(block).alias("block"))
        dealt = materialise(dealt, "dealt")
        used = [sized, large, dealt]
    sets = _wanted_sets(sized, texts, order, words)
    release(pairs.sparkSession)
    rows = dealt.join(sets.hint("merge"), "node").select("probe", "block", "kind", "node", "shingles")
    shuffles = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(shuffles, "probe", "block").sortWithinPartitions("probe", "block", "kind")
    found = materialise(rows.mapInArrow(_walks(part, whole), "a long, b long"), "links")
    for old in (*used, sets):
        discard(old)
    release(pairs.sparkSession)
    return found


def _towards(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of which one is the probe -> (probe, node)."""
    return pairs.select("probe", F.when(F.col("probe") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("node"))


def _size_class(n: Column, similarity: float) -> Column:
    """Sets of that similarity are in the same class or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.lit(-np.log(similarity - 1e-9))).cast("int")


def ngram_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 4, part: int = 85, whole: int = 100) -> DataFrame:
    """One row per input row: the id, n_shingles (size of its set) and component_id, the least id reachable by links.

    Two rows are linked if their sets of `words`-word shingles (ASCII lower case; with fewer words the whole sequence is the one shingle) have a
    Jaccard similarity of part / whole or more, compared in whole numbers, exact up to collisions of 64-bit hashes. Null, empty and blank
    texts have no shingles and are linked with nothing: component_id is their own id. Equal sets fall together first. Sets that meet at
    a shingle of their prefixes are first joined with two of them, the same ones at most shingles of a group; inside the
    components of these links nothing more needs comparing; where many sets of unlike components still meet, they are joined with more hubs
    (hub_rounds()). Then all pairs of unlike components that still meet, and whose sizes, places and bit maps
    allow the similarity, are joined. So a group of k copies costs candidates in proportion to k, and no link between components is lost.
    Null ids name a component only if all its ids are null; repeated ids are rows of their own; other columns are not looked at.
    """
    spark, similarity = df.sparkSession, part / whole
    ship(spark)
    order = _Order(*_common_shingles(df, text, words))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(t, words) for t in batch["text"].to_pylist()]
            rare = [order(s)[::-1][: len(s) - -(-part * len(s) // whole) + 1].copy() if len(s) else s for s in own]
            sizes = pa.array([len(s) for s in own], pa.int32())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["copy"], pa.array(list(map(_node, own)), pa.int64()), sizes, _lists(list(map(_map, own))), _lists(rare)], names=["id", "copy", "node", "n", "map", "firsts"])

    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("copy"), F.col(text).alias("text"))
    signed = materialise(texts.mapInArrow(sign, f"id {kind}, copy long, node long, n int, map array<long>, firsts array<long>"), "shingles")
    rows = materialise(signed.select("id", "node", "n"), "rows")
    nodes = signed.where("n > 0").groupBy("node").agg(F.min("copy").alias("copy"), *(F.first(c).alias(c) for c in ("n", "map", "firsts")))
    nodes = materialise(nodes, "nodes")
    discard(signed)
    release(spark)
    # left: the shingles of a set from this one to the common end, the most that two sets share which meet at it first
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
    hub = F.struct(F.xxhash64("node"), "node", "n", "left")
    hubs = materialise(meets.groupBy("shingle").agg(F.min(hub).alias("first"), F.max(hub).alias("last")), "hubs")
    in_range = lambda x, y: F.least(f"{x}left", f"{y}left") * F.lit(part + whole) >= F.lit(part) * (F.col(f"{x}n") + F.col(f"{y}n"))
    pairs = meets.join(hubs.hint("merge"), "shingle").select("node", "n", "left", F.explode(F.array("first", "last")).alias("o"))
    pairs = pairs.select("node", "n", "left", F.col("o.node").alias("other"), F.col("o.n").alias("o_n"), F.col("o.left").alias("o_left"))
    pairs = pairs.where((F.col("node") != F.col("other")) & in_range("", "o_")).select("node", "other")
    pairs = pairs.groupBy(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).agg(F.max("other").alias("probe"))
    pairs = materialise(pairs, "pairs")
    release(spark)
    member = connected_components(trie_links(_towards(pairs), nodes, texts, order, words, part, whole), written=True)
    release(spark)
    # with up to three sets, all have met
    rest = meets.where("k > 3").join(hubs.hint("merge"), "shingle").where("node <> first.node and node <> last.node")
    rest = materialise(rest.select("shingle", "k", "node", "n", "left"), "rest")
    for old in (meets, hubs):
        discard(old)
    near = in_range("x", "y") & (_differ("xmap", "ymap") <= _most_own(similarity) * (F.col("xn") + F.col("yn")))
    walked = lambda more: trie_links(_towards(more), nodes, texts, order, words, part, whole)
    member, compared, bar = hub_rounds(rest, nodes, member, pairs, walked, near, GROWTH)
    left = mixed_rows(rest.where(turn() >= bar), member, nodes)
    release(spark)
    sized = left.withColumn("size", _size_class(F.col("n"), similarity))
    x, y = (sized.select(*(F.col(c).alias(f"{k}{c}") for c in ("shingle", "node", "n", "left", "c", "map", "size"))) for k in "xy")
    y = y.withColumn("ysize", F.explode(F.array(F.col("ysize") - 1, F.col("ysize"), F.col("ysize") + 1)))
    more = x.join(y.hint("merge"), (F.col("xshingle") == F.col("yshingle")) & (F.col("xsize") == F.col("ysize")) & (F.col("xc") < F.col("yc")) & near)
    more = more.select(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b")).distinct()
    more = materialise(more.join(known_pairs(compared).hint("merge"), ["a", "b"], "left_anti"), "more")
    for old in (rest, left, *compared):
        discard(old)
    links = trie_links(more.select(F.col("a").alias("probe"), F.col("b").alias("node")), nodes, texts, order, words, part, whole).union(member)
    for old in (nodes, more):
        discard(old)
    member = connected_components(links, written=True)
    rooted = rows.where("n > 0").join(member.hint("merge"), "node", "left").select("id", "n", F.coalesce("component", "node").alias("root"))
    rooted = materialise(rooted, "ngram-roots")
    release(spark)
    named = materialise(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "groups")
    found = rooted.join(named.hint("merge"), "root").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")
    return found.union(rows.where("n = 0").select("id", F.lit(0).cast("long"), "id"))
