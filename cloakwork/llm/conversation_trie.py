"""The prefix trie of conversations: adaptive radix trees over fixed-width turn ids, joined where blocks meet.

A turn is named by 16 bytes, a conversation by the ids of its turns in order. Conversations are sorted by those bytes over range partitions,
and each task puts its range, block by block, into an adaptive radix tree: nodes of 4, 16, 48 or 256 children that
grow as needed, with compressed paths. Trie nodes are emitted at byte depths that are whole turns only. A node that
lies on the path of a block's first or last key may go on in the next block: those open nodes are merged afterwards, and
what their subtrees hold is summed by pointer doubling. All others are finished where they are.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise, ship

WIDTH = 16
#: A block ends after so many conversations or bytes of keys.
BLOCK_ROWS = 100_000
BLOCK_BYTES = 1 << 25
NOTHING = hashlib.sha256(b"").hexdigest()


class Sorted:
    """Children of up to `most` bytes, in order beside their bytes: the layouts of 4 and 16."""

    __slots__ = ("keys", "kids", "most")

    def __init__(self, most: int) -> None:
        self.keys, self.kids, self.most = bytearray(), [], most

    def get(self, byte: int) -> Node | None:
        at = self.keys.find(byte)
        return self.kids[at] if at >= 0 else None

    def put(self, byte: int, node: Node) -> Sorted | Indexed:
        at = bisect_left(self.keys, byte)
        if at < len(self.keys) and self.keys[at] == byte:
            self.kids[at] = node
            return self
        if len(self.keys) == self.most:
            larger = Sorted(16) if self.most == 4 else Indexed()
            for b, kid in self.items():
                larger.put(b, kid)
            return larger.put(byte, node)
        self.keys.insert(at, byte)
        self.kids.insert(at, node)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.keys, self.kids, strict=True)


class Indexed:
    """Up to 48 children in the order of arrival, found by a table of 256 places."""

    __slots__ = ("kids", "place")

    def __init__(self) -> None:
        self.place, self.kids = bytearray(256), []

    def get(self, byte: int) -> Node | None:
        at = self.place[byte]
        return self.kids[at - 1] if at else None

    def put(self, byte: int, node: Node) -> Indexed | Direct:
        if at := self.place[byte]:
            self.kids[at - 1] = node
            return self
        if len(self.kids) == 48:
            larger = Direct()
            for b, kid in self.items():
                larger.put(b, kid)
            return larger.put(byte, node)
        self.kids.append(node)
        self.place[byte] = len(self.kids)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, self.kids[at - 1]) for b, at in enumerate(self.place) if at)


class Direct:
    """A child for every byte."""

    __slots__ = ("kids",)

    def __init__(self) -> None:
        self.kids: list[Node | None] = [None] * 256

    def get(self, byte: int) -> Node | None:
        return self.kids[byte]

    def put(self, byte: int, node: Node) -> Direct:
        self.kids[byte] = node
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, kid) for b, kid in enumerate(self.kids) if kid is not None)


class Node:
    """A compressed path after the byte that leads here, the children below it, and the conversations that end here."""

    __slots__ = ("chars", "ends", "kids", "path")

    def __init__(self, path: bytes, kids: Sorted | Indexed | Direct | None = None) -> None:
        self.path, self.kids, self.ends, self.chars = path, kids, None, None


class RadixTree:
    """An adaptive radix tree of byte keys; each key keeps the list of values put under it."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def put(self, key: bytes, value: int, chars: list[int] | None = None) -> None:
        node, above, came, depth = self.root, None, 0, 0
        while True:
            path = node.path
            if not key.startswith(path, depth):
                node = self._split(node, above, came, key, depth)
                path = node.path
            depth += len(path)
            if depth == len(key):
                break
            kid = node.kids.get(key[depth]) if node.kids is not None else None
            if kid is None:
                kid = Node(key[depth + 1 :])
                node.kids = (Sorted(4) if node.kids is None else node.kids).put(key[depth], kid)
                node = kid
                break
            above, came, node, depth = node, key[depth], kid, depth + 1
        if node.ends is None:
            node.ends, node.chars = [], chars
        node.ends.append(value)

    @staticmethod
    def _split(node: Node, above: Node, came: int, key: bytes, depth: int) -> Node:
        """Cut the node's path where the key leaves it (or ends)."""
        path, n = node.path, 0
        for a, b in zip(path, key[depth : depth + len(path)], strict=False):
            if a != b:
                break
            n += 1
        upper = Node(path[:n], Sorted(4))
        node.path = path[n + 1 :]
        upper.kids.put(path[n], node)
        above.kids = above.kids.put(came, upper)
        return upper


def node_ids(key: bytes, width: int) -> list[bytes]:
    """A name of fixed length for each whole-turn prefix of a key, the empty one first."""
    names = [bytes(16)]
    for at in range(0, len(key), width):
        names.append(hashlib.md5(names[-1] + key[at : at + width]).digest())
    return names


class _Sum:
    """What the part of the trie below a place holds, as far as it is finished: its nodes next below, and their sums."""

    __slots__ = ("below", "chars", "closed", "least", "leaves", "n", "saved")

    def __init__(self) -> None:
        self.n = self.leaves = self.saved = self.closed = 0
        self.least, self.chars, self.below = None, None, []

    def add(self, other: _Sum) -> None:
        self.n += other.n
        self.leaves += other.leaves
        self.saved += other.saved
        self.closed += other.closed
        self.least = other.least if self.least is None else min(self.least, other.least)
        self.chars = other.chars if self.chars is None else self.chars
        self.below += other.below


COLUMNS = ["open", "node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "chars", "ends", "first_end"]
TYPES = [pa.bool_(), pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.string(), pa.int64()]
SCHEMA = "open boolean, node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, ends string, first_end long"


def block_rows(tree: RadixTree, first: bytes, last: bytes, width: int = WIDTH) -> list[list]:
    """The trie nodes of a block of sorted keys, in COLUMNS; the tree must hold the first and last key.

    Open nodes (prefixes of the first or last key) have sums over their closed parts, and the ids that end there; closed
    ones are finished, but for the parent's conv_id if that is open: then its name is given.
    """
    rows: list[list] = []
    spine = {False: node_ids(first, width), True: node_ids(last, width)}

    def emit(depth: int, s: _Sum, ends: list[int] | None, on: list[bool]) -> _Sum:
        d = depth // width
        chars = s.chars[d - 1] if d else 0
        side = next((k for k in (False, True) if on[k]), None)
        up = _Sum()
        up.n, up.least, up.chars, up.below = s.n, s.least, s.chars, [len(rows)]
        if side is None:
            for k in s.below:
                rows[k][5] = s.least
            up.leaves, up.saved, up.closed = s.leaves if s.below else 1, s.saved + (s.n - 1) * chars, 1
            digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() if ends else NOTHING
            rows.append([False, None, None, d, s.least, None, s.n, len(s.below), up.leaves, up.saved, None, digest, None])
            return up
        name = spine[side][d]
        for k in s.below:
            if not rows[k][0]:
                rows[k][2] = name
        rows.append([True, name, spine[side][d - 1] if d else None, d, s.least, None, s.n, s.closed, s.leaves, s.saved, chars, ",".join(map(str, ends)) if ends else None, ends[0] if ends else None])
        return up

    def children(node: Node) -> Iterator[tuple[int, Node]]:
        return iter(node.kids.items()) if node.kids is not None else iter(())

    stack = [(tree.root, -1, 0, children(tree.root), _Sum(), [True, True])]
    while True:
        node, above, depth, kids, s, on = stack[-1]
        step = next(kids, None)
        if step is not None:
            byte, kid = step
            below = depth + 1 + len(kid.path)
            edge = bytes([byte]) + kid.path
            stack.append((kid, depth, below, children(kid), _Sum(), [on[k] and key[depth:below] == edge for k, key in enumerate((first, last))]))
            continue
        stack.pop()
        if node.ends is not None:
            s.n += len(node.ends)
            s.least = node.ends[0] if s.least is None else min(s.least, node.ends[0])
            s.chars = node.chars if s.chars is None else s.chars
        for d in range(depth // width * width, above, -width):
            s = emit(d, s, node.ends if d == depth else None, on)
        if not stack:
            return rows
        stack[-1][4].add(s)


def _tries(most_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted conversations -> the trie nodes of their blocks."""

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, first, last, n, size = RadixTree(), None, b"", 0, 0

        def told() -> pa.RecordBatch:
            columns = zip(*block_rows(tree, first, last), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, TYPES, strict=True)], names=COLUMNS)

        for batch in batches:
            for conv, ids, chars in zip(*(batch[c].to_pylist() for c in ("conv_id", "ids", "chars")), strict=True):
                if n >= most_rows or size >= BLOCK_BYTES:
                    yield told()
                    tree, first, n, size = RadixTree(), None, 0, 0
                last = b"".join(ids)
                first = last if first is None else first
                tree.put(last, conv, chars)
                n, size = n + 1, size + len(last)
        if n:
            yield told()

    return tries


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the lists of ids, sorted by node and place -> the digest of each node's whole list, holding one piece at a time."""
    now, digest = None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], names=["node", "sha"])

    for batch in batches:
        for node, ends in zip(batch["node"].to_pylist(), batch["ends"].to_pylist(), strict=True):
            if node != now:
                if digest is not None:
                    yield told()
                now, digest = node, hashlib.sha256()
                digest.update(ends.encode())
            else:
                digest.update(b"," + ends.encode())
    if digest is not None:
        yield told()


def turn_lists(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns by number (null first), equal numbers by id; a turn is its id (16 bytes of role and text) and the text's code points.

    Null roles and texts are empty; rows without conv_id belong to no conversation; repeated rows are turns of their own.
    """
    said, who = F.coalesce(text, F.lit("")), F.coalesce(role, F.lit(""))
    name = F.unhex(F.md5(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, said).cast("binary")))
    rows = df.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), name.alias("id"), F.char_length(said).alias("chars")).alias("t"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["chars"].alias("chars"))).alias("turns"))


def _subtree_sums(opened: DataFrame) -> DataFrame:
    """(node, parent, …, n_leaves, saved_tokens) -> the same with both summed over the open nodes below, by doubling the step to the node above."""
    steps = int(opened.agg(F.max("depth")).first()[0] or 0)
    now = opened.select("node", F.col("parent").alias("up"), "n_leaves", "saved_tokens")
    made = []
    for _ in range(steps.bit_length()):
        gained = now.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        above = now.select(F.col("node").alias("up"), F.col("up").alias("next"))
        both = now.join(gained.hint("merge"), "node", "left").join(above.hint("merge"), "up", "left")
        plus = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
        now = materialise(both.select("node", F.col("next").alias("up"), plus("n_leaves", "more_leaves"), plus("saved_tokens", "more_saved")), "trie-sums")
        made.append(now)
    sums = now.select("node", "n_leaves", "saved_tokens")
    whole = materialise(opened.drop("n_leaves", "saved_tokens").join(sums.hint("merge"), "node"), "trie-open")
    for old in made:
        discard(old)
    return whole


def prefix_trie(lists: DataFrame, most_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv_id, turns) with distinct conv_ids -> one row per node of their trie: conv_id (the smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    n_convs counts the conversations that begin with the node's turns; n_leaves the childless nodes of its subtree; saved_tokens sums over
    the subtree each node's (n_convs - 1) times the code points of its last text; ends_sha256 is the digest of the ascending
    decimal ids, joined by commas, of the conversations that end there. Turnless conversations end at the root; without any conversation there
    is no node. However many conversations share turns or are equal, they are sorted, dealt out in ranges and
    counted block by block (of at most most_rows conversations); a list of ids is hashed piece by piece.
    """
    ship(lists.sparkSession)
    shuffles = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = lists.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.chars").alias("chars"))
    ranged = keys.repartitionByRange(shuffles, "ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    rows = materialise(ranged.mapInArrow(_tries(most_rows), SCHEMA), "trie-rows")
    closed, parts = rows.where("not open"), rows.where("open")
    merged = parts.groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("chars").alias("chars"))
    merged = materialise(merged, "trie-open")
    kids = merged.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("open_children"))
    counted = merged.join(kids.hint("merge"), "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("open_children", F.lit(0)))
    own = [F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")]
    opened = _subtree_sums(materialise(counted.select("node", "parent", "depth", "conv_id", "n_convs", "n_children", *own), "trie-open"))
    pieces = parts.where("ends is not null").select("node", "first_end", "ends")
    digests = pieces.repartition(shuffles, "node").sortWithinPartitions("node", "first_end").mapInArrow(_digests, "node binary, sha string")
    names = opened.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_name"))
    opened = opened.join(digests.hint("merge"), "node", "left").withColumn("ends", F.coalesce("sha", F.lit(NOTHING))).withColumn("parent_conv_id", F.lit(None).cast("long"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    edge = [*columns[:2], F.col("parent_name").alias("parent_conv_id"), *columns[3:]]
    inside = closed.where("parent is null").select(*columns)
    border = closed.where("parent is not null").drop("node").join(names.hint("merge"), "parent").select(*edge)
    return inside.union(border).union(opened.join(names.hint("merge"), "parent", "left").select(*edge))


def conversation_trie(df: DataFrame, **columns: str) -> DataFrame:
    """prefix_trie() of a table of turns; `columns` as turn_lists() takes them. Other columns are not looked at."""
    return prefix_trie(turn_lists(df, **columns))


def started_alike(lists: DataFrame, base: Column, turns: Column) -> DataFrame:
    """Conversations whose first `turns` turns are those of conversation `base` (none if it is absent), followed by their own after as many."""
    bases = lists.join(lists.select(base.alias("conv_id")).distinct().hint("merge"), "conv_id", "left_semi").select(F.col("conv_id").alias("_base"), F.col("turns").alias("_first"))
    own = lists.withColumns({"_base": base, "_h": turns.cast("int")})
    both = own.join(bases.hint("merge"), "_base", "left")
    head = F.slice(F.coalesce("_first", F.slice("turns", 1, 0)), F.lit(1), F.col("_h"))
    return both.select("conv_id", F.concat(head, F.slice("turns", F.col("_h") + 1, F.size("turns"))).alias("turns"))
