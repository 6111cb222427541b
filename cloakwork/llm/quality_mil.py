"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded from its characters and repetitions, a gated
attention network learns from the documents' labels alone how much each passage counts, and the weighted
mean of the passages is scored. Every passage of every text takes part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ship

PASSAGE = 100
HIDDEN = 24
ATTENTION = 12
MOST_LABELLED = 4000
CHUNK = 1 << 20

#: The classes of bytes that are counted, and which bytes each has.
_CLASSES = (
    range(0x61, 0x7B),
    range(0x41, 0x5B),
    range(0x30, 0x3A),
    b".,;:",
    b"!?",
    b"#*$%&<>^~=+_@\\{}[]",
    b"|",
    b"\"'`()-/",
    range(0x80, 0x100),
)
_CLASS = np.full(256, len(_CLASSES), dtype=np.uint8)
for _k, _bytes in enumerate(_CLASSES):
    _CLASS[list(_bytes)] = _k
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
FEATURES = len(_CLASSES) + 6


def _distinct(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """How many different values each group has."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return np.bincount(g[new], minlength=groups)


def _encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    blank = _BLANK[data]
    inside = np.flatnonzero(~blank)
    if not len(inside):
        return np.zeros((len(texts), FEATURES)), np.arange(len(texts))
    starts = inside[np.append(True, blank[inside[1:] - 1])]
    ends = np.searchsorted(np.flatnonzero(blank), starts)
    ends = np.flatnonzero(blank)[ends]
    doc = np.searchsorted(begin, starts, side="right") - 1
    first = np.searchsorted(doc, np.arange(len(texts)))
    passage_in_doc = (np.arange(len(starts)) - first[doc]) // PASSAGE
    words = np.bincount(doc, minlength=len(texts))
    per_doc = np.maximum(1, -(-words // PASSAGE))
    lead = np.cumsum(per_doc) - per_doc
    passage = lead[doc] + passage_in_doc
    m = int(per_doc.sum())
    hashes = _word_hashes(data, starts, ends)
    count = np.maximum(1, np.bincount(passage, minlength=m)).astype(float)
    length = ends - starts
    chars = np.maximum(1.0, np.bincount(passage, weights=length, minlength=m))
    of = np.repeat(passage, length)
    kinds = _CLASS[data[np.repeat(starts - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())]]
    table = np.bincount(of * (len(_CLASSES) + 1) + kinds, minlength=m * (len(_CLASSES) + 1)).reshape(m, -1)[:, : len(_CLASSES)]
    again = np.append(False, (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1]))
    before = np.append(np.uint64(0), hashes[:-1])
    before[np.append(True, passage[1:] != passage[:-1])] = 0  # a passage's features depend on its own words only
    pair = hashes * np.uint64(3) + before
    lines = np.bincount(passage, weights=data[ends] == 10, minlength=m)
    more = [chars / count / 10, lines / count, np.bincount(passage, weights=again, minlength=m) / count, _distinct(passage, hashes, m) / count, _distinct(passage, pair, m) / count, count / PASSAGE]
    out = np.column_stack([table / chars[:, None], *more])
    out[np.bincount(passage, minlength=m) == 0] = 0
    return out, np.repeat(np.arange(len(texts)), per_doc)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words: of its length and its letters by place."""
    length = ends - starts
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    letters = data[np.repeat(starts, length) + place].astype(np.uint64) + np.uint64(1)
    factors = np.multiply.accumulate(np.full(int(length.max()) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    return np.add.reduceat(letters * factors[place], np.cumsum(length) - length)


def _cut(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of some CHUNK bytes that hold whole passages, and the rest."""
    if len(raw) > CHUNK:
        raw = _LONG_WORD.sub(rb"\1 ", raw)
    at = 0
    while len(raw) - at > CHUNK:
        size, whole = CHUNK, 0
        while not whole and size < 2 * (len(raw) - at):
            inside = ~_BLANK[np.frombuffer(raw[at : at + size], dtype=np.uint8)]
            starts = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
            whole, size = max(0, len(starts) - 1) // PASSAGE * PASSAGE, size * 2  # the last word may go on
        if not whole:
            break
        yield raw[at : at + int(starts[whole])]
        at += int(starts[whole])
    yield raw[at:]


#: Words of more than 65,536 bytes count as several words.
_LONG_WORD = re.compile(rb"([^\x20\x09-\x0D]{65536})(?=[^\x20\x09-\x0D])")


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage of up to PASSAGE words, and the number of its text; a text without words has one of zeros.

    Long texts are taken in pieces, so that memory does not grow with a text beyond its passages' rows.
    """
    rows, owners, held, of, size = [np.zeros((0, FEATURES))], [np.zeros(0, dtype=np.int64)], [], [], 0

    def flush() -> None:
        if held:
            x, piece = _encode(held)
            rows.append(x)
            owners.append(np.array(of)[piece])
            held.clear()
            of.clear()

    for k, text in enumerate(texts):
        for raw in _cut((text or "").encode("utf-8", "replace")):
            if size + len(raw) > CHUNK:
                flush()
                size = 0
            held.append(raw)
            of.append(k)
            size += len(raw)
    flush()
    return np.concatenate(rows), np.concatenate(owners)


class Attention:
    """h = tanh(xA), weight ~ exp(w . tanh(hV) * sigmoid(hU)) within a bag, score = sigmoid(c . sum of weight * h)."""

    def __init__(self, seed: int = 7) -> None:
        draw = np.random.default_rng(seed).standard_normal
        self.p = {"A": draw((FEATURES, HIDDEN)) / np.sqrt(FEATURES), "a": np.zeros(HIDDEN), "V": draw((HIDDEN, ATTENTION)) / 5, "U": draw((HIDDEN, ATTENTION)) / 5, "w": draw(ATTENTION) / 4, "c": draw(HIDDEN) / 5, "d": np.zeros(1)}
        self.mean, self.std = np.zeros(FEATURES), np.ones(FEATURES)

    def _forward(self, x: np.ndarray, owner: np.ndarray) -> tuple:
        p = self.p
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        bag = np.cumsum(np.append(False, owner[1:] != owner[:-1]))
        h = np.tanh(x @ p["A"] + p["a"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return starts, bag, h, t, g, a, z, y

    def scores(self, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.std, owner)[-1]

    def _gradients(self, x: np.ndarray, owner: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy, by each parameter."""
        p = self.p
        starts, bag, h, t, g, a, z, y = self._forward(x, owner)
        dy = (y - label) / len(label)
        dz = dy[:, None] * p["c"]
        da = (dz[bag] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, starts)[bag])
        dt, dg = de[:, None] * p["w"] * g * (1 - t**2), de[:, None] * p["w"] * t * g * (1 - g)
        dh = a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T
        dx = dh * (1 - h**2)
        return {"A": x.T @ dx, "a": dx.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ dy, "d": dy.sum(keepdims=True)}

    def fit(self, x: np.ndarray, owner: np.ndarray, label: np.ndarray, rounds: int = 250, rate: float = 0.02, decay: float = 1e-4) -> Attention:
        """owner ascending; label of each bag in that order."""
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-6
        x, p = (x - self.mean) / self.std, self.p
        first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        for step in range(1, rounds + 1):
            grads = self._gradients(x, owner, label)
            for k, v in p.items():
                grad = grads[k] + decay * v
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                v -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(id_col: str) -> Column:
    """True where crc32 of the id as text is divisible by five; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_LABELLED) -> Attention | float:
    """Fit on at most `most` labelled documents outside the held-out fifth, the least by a hash of their ids.

    An id with several labels counts by the least. Only features of those documents come to the driver.
    Without two different labels the result is the share of ones (0.5 for none), which scores all alike.
    """
    ship(docs.sparkSession)
    known = labels.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(label).isin(0, 1))
    known = known.groupBy(id_col).agg(F.min(label).cast("int").alias("_label")).join(docs.select(id_col).distinct(), id_col, "left_semi")
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(most)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, owner = passages(batch["text"].to_pylist())
            each = [x[owner == i].ravel() for i in range(batch.num_rows)] if len(x) else []
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array(each, pa.list_(pa.float64()))], names=["id", "label", "x"])

    # at most `most` ids of eight bytes are broadcast
    rows = docs.join(F.broadcast(chosen), id_col).select(F.col(id_col).cast("string").alias("id"), F.col("_label").alias("label"), F.col(text).alias("text"))
    found = rows.mapInArrow(encode, "id string, label int, x array<double>").toPandas()
    if not len(found) or found["label"].nunique() < 2:
        return float(found["label"].mean()) if len(found) else 0.5
    found = found.sort_values(["id", "label"], ignore_index=True)
    bags = [np.asarray(x).reshape(-1, FEATURES) for x in found["x"]]
    return Attention().fit(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), found["label"].to_numpy(dtype=float))


def score(docs: DataFrame, model: Attention | float, text: str = "text", into: str = "score") -> DataFrame:
    """Adds the score (0 to 1, higher: better) of every whole text; null and empty texts are a bag of one empty passage.

    Equal texts have equal scores. Other columns are carried along; one that is named like `into` is replaced.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if isinstance(model, float) or not len(batch):
                yield pd.Series(np.full(len(batch), model if isinstance(model, float) else 0.5))
                continue
            parts = [passages(batch.iloc[at : at + 1000].tolist()) for at in range(0, len(batch), 1000)]
            yield pd.Series(np.concatenate([model.scores(x, owner) for x, owner in parts]))

    return docs.select(*(c for c in docs.columns if c != into), scored(F.col(text)).alias(into))
