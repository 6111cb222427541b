"""Encoding of whole texts with a file of the tokenizers library, each different word of a batch once.

A vocabulary that drops white space and never merges across it gives a text the ids of its parts between
blanks and newlines, one after the other. So a batch of texts is split, its different parts are found, those are
taken apart into words and the marks after them, and only words that the task does not remember go through the merges;
the ids are then put in the order of the texts. Files that normalise or split in another way are left to the
library as a whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that normalisation only lower-cases, with the marks after them: each is one piece that needs the merges alone.
_PLAIN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!\"#$%&()*+,\-./:;=?@]*)$"
#: Words remembered; most of what a corpus has beyond them occurs once.
_MOST = 150_000
#: Bytes of text taken at a time; a longer text is cut at a blank.
BATCH = 8 << 20

#: The normaliser and the splitting for which texts may be taken apart at blanks.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BLANK = re.compile(r"[ \n]")
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def _byte_letters() -> dict[int, str]:
    """The visible letter that byte-level vocabularies use for each byte: itself if printable, else the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _by_parts(path: str) -> bool:
    """Whether the file's settings let a text be encoded part by part."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    steps = lambda name, key: (told.get(name) or {}).get(key)
    plain = told.get("post_processor") is None and told.get("truncation") is None and told.get("padding") is None
    added = all(x.get("special") and not (x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"])) for x in told.get("added_tokens", []))
    return plain and added and steps("normalizer", "normalizers") == _NORMALIZER and steps("pre_tokenizer", "pretokenizers") == [_SPLIT, _BYTES]


def _gather(table: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of a table that begin at `starts`, one after the other."""
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(n, len(table)) < 1 << 31 else np.int64
    at = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    at += np.arange(n, dtype=kind)
    return table[at]


class Encoder:
    """Ids of texts, with no special tokens added, as arrays of `dtype`.

    special: a special token spelled out in the text gets its own id, the library's default; else it is text like other.
    """

    def __init__(self, path: str, special: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.letters = _byte_letters()
        self.by_parts = _by_parts(path)
        self.known: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _merged(self, piece: str) -> bytes:
        """One word or run of marks by the merges alone."""
        if not piece:
            return b""
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [x.id for x in self.model.tokenize(letters)]).tobytes()

    def _looked_up(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.known.get, pieces))
        if None in found:
            if len(self.known) > _MOST:
                self.known = {}
            known, merged = self.known, self._merged
            for k, ids in enumerate(found):
                if ids is None:
                    found[k] = known[pieces[k]] = merged(pieces[k])
        return found

    def _batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.values.dictionary_encode()
        parts, at = coded.dictionary, coded.indices.to_numpy()
        plain = pc.extract_regex(parts, _PLAIN)
        is_plain = plain.is_valid().to_numpy(zero_copy_only=False)
        plain = plain.drop_null()
        words, marks = pc.utf8_lower(plain.field("word")).dictionary_encode(), plain.field("marks").dictionary_encode()
        other = [self._library(x) for x in parts.filter(pa.array(~is_plain)).to_pylist()]
        pieces = [*self._looked_up(words.dictionary.to_pylist()), *self._looked_up(marks.dictionary.to_pylist()), *other, b""]
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) // self.dtype.itemsize
        # of each part, its word and marks, or all of it and nothing
        of = np.full((len(parts), 2), len(pieces) - 1, dtype=np.int64)
        of[is_plain, 0] = words.indices.to_numpy()
        of[is_plain, 1] = marks.indices.to_numpy() + len(words.dictionary)
        of[~is_plain, 0] = np.arange(len(other)) + len(words.dictionary) + len(marks.dictionary)
        table = _gather(np.frombuffer(b"".join(pieces), dtype=self.dtype), (np.cumsum(sizes) - sizes)[of.ravel()], sizes[of.ravel()])
        sizes = sizes[of].sum(axis=1)
        starts = np.cumsum(sizes) - sizes
        ids = _gather(table, starts[at], sizes[at])
        ends = np.append(0, np.cumsum(sizes[at]))
        return ids, ends[lists.offsets.to_numpy()]

    def encode_all(self, texts: pa.Array | list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by `end` if given, and where each text's begin and the last's end. A null is empty."""
        whole = texts.to_pylist() if isinstance(texts, pa.Array) else texts
        out, sizes, held, owners, size = [np.empty(0, dtype=self.dtype)], np.zeros(len(whole), dtype=np.int64), [], [], 0

        def flush() -> None:
            ids, offsets = self._batch(pa.array(held, pa.large_string()))
            out.append(ids)
            np.add.at(sizes, owners, np.diff(offsets))
            held.clear()
            owners.clear()

        for k, text in enumerate(whole):
            if not text:
                continue
            if not self.by_parts:
                out.append(np.frombuffer(self._library(text), dtype=self.dtype))
                sizes[k] = len(out[-1])
                continue
            at = 0
            while at < len(text):
                cut = len(text)
                if cut - at > BATCH and (blank := _BLANK.search(text, at + BATCH)):
                    cut = blank.end()
                held.append(text[at:cut])
                owners.append(k)
                size, at = size + cut - at, cut
                if size >= BATCH:
                    flush()
                    size = 0
        if held:
            flush()
        ids, offsets = np.concatenate(out), np.append(0, np.cumsum(sizes))
        if end is not None:
            ids, offsets = np.insert(ids, offsets[1:], end), offsets + np.arange(len(offsets))
        return ids, offsets

    def ids(self, text: str | None, end: int | None = None) -> np.ndarray:
        return self.encode_all([text], end)[0]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special: bool = False) -> Encoder:
    """One for each worker, file and setting."""
    if (path, special) not in _ENCODERS:
        _ENCODERS[path, special] = Encoder(path, special)
    return _ENCODERS[path, special]
