"""Byte-level BPE as a finite-state transducer that is determinised as texts need it.

A text's split into tokens is right exactly if every two neighbours are the merges' own split of their
bytes. So reading bytes from the left, it is enough to carry, for each start at which a longer token may
still be open, its place in the trie of tokens and the tokens before it. Those sets are the states; what
all members of a set have in common can be emitted at once, and no token is held back longer than the
longest token lasts. Steps that were taken once are looked up from then on.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship

ROWS = 256
_MOST_STEPS = 400_000
_MOST_PARTS = 300_000
#: Fixed value: the pattern of which is known that no match crosses a lone blank or newline from left to right, and that it
#: takes a word and the marks after it apart. Texts are split by other patterns as a whole.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A word with the marks after it: two matches.
_PLAIN = regex.compile(r"( ?\p{L}+)([.,;:!?*#%&$]*)").fullmatch
_LOOSE = regex.compile(r"\s[ \n]|[ \n]\s")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """tokens(piece) gives the ids that merging by rank gives for one piece of text."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.trie: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        self.inner: set[int] = set()
        n = 0
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                below = self.trie.get(node << 8 | byte)
                if below is None:
                    n += 1
                    below = self.trie[node << 8 | byte] = n
                    self.inner.add(node)
                node = below
            self.ends[node] = rank
        self.neighbours: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.states = [((0, ()),)]
        self.numbers = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.last: list[tuple[int, ...]] = [()]

    def merge(self, data: bytes) -> list[int]:
        """The merges themselves: join the pair of lowest rank, leftmost first, while there is one."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank, none = self.ranks.get, 1 << 60
        pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (least := min(pairs)) != none:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def _follows(self, before: tuple[int, ...], token: int) -> bool:
        pair = (before[-1] if before else -1, token)
        found = self.neighbours.get(pair)
        if found is None:
            left = self.bytes_of[pair[0]] if before else b""
            found = self.neighbours[pair] = self.merge(left + self.bytes_of[token]) == [*before[-1:], token]
        return found

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Determinise one step: (next state, tokens that every way on begins with)."""
        if len(self.steps) > _MOST_STEPS:
            raise MemoryError
        open_now, whole = [], None
        for node, before in self.states[state]:
            below = self.trie.get(node << 8 | byte)
            if below is None:
                continue
            token = self.ends.get(below)
            if whole is None and token is not None and self._follows(before, token):
                whole = (*before, token)
            if below in self.inner:
                open_now.append((below, before))
        if whole is None:
            raise ValueError(f"no token ends with byte {byte}")
        open_now.append((0, whole))
        # the last token of each way stays, as it decides what may follow
        sure = min(len(before) for _, before in open_now) - 1
        k = 0
        while k < sure and len({before[k] for _, before in open_now}) == 1:
            k += 1
        key = tuple(sorted((node, before[k:]) for node, before in open_now))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.last.append(whole[k:])
        self.steps[state << 8 | byte] = found = (number, whole[:k])
        return found

    def tokens(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        for _ in range(2):
            state, out, steps = 0, [], self.steps
            try:
                for byte in piece:
                    state, sure = steps.get(state << 8 | byte) or self._step(state, byte)
                    if sure:
                        out.extend(sure)
            except MemoryError:
                self._forget()
                continue
            return out + list(self.last[state])
        return self.merge(piece)


class ByteBpe:
    """Whole texts: split by the pattern, each match through the transducer; parts met before are looked up."""

    def __init__(self, path: str, pattern: str) -> None:
        self.machine = Transducer(read_ranks(path))
        self.split = regex.compile(pattern).findall
        self.dtype = np.dtype("i4")
        self.by_parts = pattern == PATTERN
        self.pieces: dict[str, bytes] = {}
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({"": b""}, {})

    def _ids(self, text: str) -> bytes:
        return array("i", [t for piece in self.split(text) for t in self.machine.tokens(piece.encode())]).tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) > _MOST_PARTS:
                self.pieces.clear()
            found = self.pieces[piece] = array("i", self.machine.tokens(piece.encode())).tobytes()
        return found

    def _look(self, part: str, spaced: int) -> bytes:
        found = self.known[spaced].get(part)
        if found is None:
            if len(self.known[spaced]) > _MOST_PARTS:
                self.known[spaced].clear()
            whole = " " + part if spaced else part
            if split := _PLAIN(whole):
                word, marks = split.groups()
                found = self._piece(word) + self._piece(marks) if marks else self._piece(word)
            else:
                found = self._ids(whole)
            self.known[spaced][part] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """Parts between lone blanks and newlines are looked up."""
        if not text:
            return np.empty(0, dtype=self.dtype)
        if not self.by_parts or _LOOSE.search(text):
            return np.frombuffer(self._ids(text), dtype=self.dtype)
        out, feed = [], None
        for line in text.split("\n"):
            if feed is None:
                feed = self._look("\n", 0)
            else:
                out.append(feed)
            first, *rest = line.split(" ")
            out.append(self.known[0].get(first) or self._look(first, 0))
            found = list(map(self.known[1].get, rest))
            if None in found:
                found = [self._look(part, 1) if ids is None else ids for part, ids in zip(rest, found, strict=True)]
            out += found
        return np.frombuffer(b"".join(out), dtype=self.dtype)


class Decoder:
    """Ids to text by a table of the tokens' bytes."""

    def __init__(self, path: str) -> None:
        bytes_of = {rank: token for token, rank in read_ranks(path).items()}
        self.table = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]

    def decode(self, ids: np.ndarray) -> str:
        stream, out = Utf8Stream(), []
        for at in range(0, len(ids), 1 << 16):
            out.append(stream.feed(b"".join(map(self.table.__getitem__, ids[at : at + (1 << 16)].tolist()))))
        return "".join([*out, stream.finish()])


#: Of each byte that begins a character of several bytes: how many follow, and which the next may be (Unicode's table of
#: well-formed sequences).
_LEADS = {lead: (n, low, high) for leads, n, low, high in (
    (range(0xC2, 0xE0), 1, 0x80, 0xBF), ((0xE0,), 2, 0xA0, 0xBF), ((*range(0xE1, 0xED), 0xEE, 0xEF), 2, 0x80, 0xBF), ((0xED,), 2, 0x80, 0x9F),
    ((0xF0,), 3, 0x90, 0xBF), (range(0xF1, 0xF4), 3, 0x80, 0xBF), ((0xF4,), 3, 0x80, 0x8F)) for lead in leads}


class Utf8Stream:
    """UTF-8 from pieces that may end inside a character: a state machine over the bytes.

    The state is how many bytes the open character still needs and which the next may be, (0, 0, 0) between
    characters. A byte that may not follow makes what was open one U+FFFD and is read anew. Only from the last byte that
    can begin a character on does it matter in which state a piece ends, so the machine steps over those bytes, and
    what lies before is turned into text at once.
    """

    def __init__(self) -> None:
        self.state, self.held = (0, 0, 0), b""

    def _step(self, byte: int) -> bool:
        """Whether a character ends with this byte, as a whole or broken."""
        need, low, high = self.state
        if need and low <= byte <= high:
            self.state = (need - 1, 0x80, 0xBF) if need > 1 else (0, 0, 0)
        else:
            self.state = _LEADS.get(byte, (0, 0, 0))
        return self.state == (0, 0, 0)

    def feed(self, piece: bytes) -> str:
        data = self.held + piece
        begin = next((len(data) - back for back in range(1, min(3, len(data)) + 1) if data[-back] in _LEADS), len(data))
        self.state, whole = (0, 0, 0), begin
        for at in range(begin, len(data)):
            if self._step(data[at]):
                whole = at + 1
            elif self.state == _LEADS.get(data[at]):
                whole = at  # what was open before is broken
        self.held = data[whole:]
        return data[:whole].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held, self.state = self.held, b"", (0, 0, 0)
        return rest.decode("utf-8", "replace")


_KEPT: dict[tuple, ByteBpe | Decoder] = {}


def kept(kind: type, *settings: str) -> ByteBpe | Decoder:
    """One for each worker and settings."""
    if (kind, *settings) not in _KEPT:
        _KEPT[kind, *settings] = kind(*settings)
    return _KEPT[kind, *settings]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *parts]).astype(np.int32)))


def bpe_encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), round_trip: bool = False) -> DataFrame:
    """The columns `keep` and ids (array of int) of each whole text; null and empty texts have none. No special tokens.

    round_trip adds decoded, the text that decoding those ids gives, in the same task.
    """
    ship(df.sparkSession)
    df = df.select(*keep, F.col(text).alias("_text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, back = kept(ByteBpe, path, pattern), kept(Decoder, path) if round_trip else None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                ids = [bpe.encode(t) for t in some["_text"].to_pylist()]
                columns = [*(some[c] for c in keep), _lists(ids)]
                if back:
                    columns.append(pa.array([back.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "ids", *["decoded"] * round_trip])

    return df.mapInArrow(encode, ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", ids array<int>" + ", decoded string" * round_trip)


def bpe_decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns and decoded, the text of `ids`; ids outside the vocabulary fail, broken UTF-8 becomes U+FFFD."""
    ship(df.sparkSession)
    names = df.columns

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept(Decoder, path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                texts = [bpe.decode(x.values.to_numpy() if x.is_valid else np.empty(0, np.int32)) for x in some[ids]]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return df.mapInArrow(decode, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", decoded string")
