"""Words of a whole Arrow batch as 64-bit hashes, without a Python object per word.

Texts are worked on as UTF-8 bytes, many documents at a time, in blocks of bounded size, so memory
follows the block and the number of words, not the number of documents in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 20
LONG_WORD = 1024  # longer words are hashed one by one

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_BASE, k + 1, 1 << 64) for k in range(LONG_WORD)], dtype=np.uint64)
_LENGTH = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """The texts of a slice of a batch: their bytes end to end, and where each begins and ends."""

    def __init__(self, batch: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray):
        self.batch = batch
        self.data = data
        self.bounds = bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """Number of true marks (one per byte) in each text."""
        sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return np.diff(sums[self.bounds])

    def words(self, fold: bool, between: np.ndarray = SPACE) -> Words:
        """Maximal runs of bytes not marked in `between`, by default those that are no ASCII white
        space; `fold` lower-cases A-Z first."""
        return Words(self, fold, between)


class Words:
    """Hashes of the words of some texts, and the range of words of each text."""

    def __init__(self, texts: Texts, fold: bool, between: np.ndarray = SPACE):
        data, bounds = texts.data, texts.bounds
        inside = ~between[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = bounds[(bounds > 0) & (bounds < len(data))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, bounds)
        self.inside = inside
        self.hashes = np.empty(len(self.starts), dtype=np.uint64)
        blocks = np.searchsorted(self.starts, np.arange(0, len(data), SLICE_BYTES))
        for a, b in zip(blocks, [*blocks[1:], len(self.starts)]):
            if a < b:
                self.hashes[a:b] = self._hash(data, a, b, fold)

    def _hash(self, data: np.ndarray, a: int, b: int, fold: bool) -> np.ndarray:
        low, high = self.starts[a], self.ends[b - 1]
        picked = data[low:high][self.inside[low:high]]
        if fold:
            picked = _FOLD[picked]
        lengths = self.ends[a:b] - self.starts[a:b]
        begin = np.cumsum(lengths) - lengths
        rank = np.arange(len(picked)) - np.repeat(begin, lengths)
        terms = (picked.astype(np.uint64) + np.uint64(1)) * _POWERS[np.minimum(rank, LONG_WORD - 1)]
        out = mix(np.add.reduceat(terms, begin) + lengths.astype(np.uint64) * _LENGTH)
        for k in np.flatnonzero(lengths > LONG_WORD):
            out[k] = xxhash.xxh3_64_intdigest(picked[begin[k] : begin[k] + lengths[k]].tobytes())
        return out

    def count(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.count())


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words within one text, and the bounds of each text's runs."""
    runs = np.maximum(np.diff(bounds) - width + 1, 0)
    out_bounds = np.concatenate([[0], np.cumsum(runs)])
    total = len(hashes) - width + 1
    if total <= 0:
        return np.empty(0, dtype=np.uint64), out_bounds
    code = np.zeros(total, dtype=np.uint64)
    for k in range(width):
        code = code * np.uint64(_BASE) + hashes[k : k + total]
    begin = np.repeat(bounds[:-1] - out_bounds[:-1], runs) + np.arange(out_bounds[-1])
    return mix(code[begin]), out_bounds


def one_run(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole short sequence of words, apart from the hashes of windows."""
    code = np.zeros(1, dtype=np.uint64)
    for h in hashes:
        code = code * np.uint64(_BASE) + h
    return mix(code + np.array([len(hashes) + 1], dtype=np.uint64) * _LENGTH)[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int | None = None) -> Iterator[Texts]:
    """Parts of a batch of up to `SLICE_BYTES` of text and `most` texts each; a longer text is a
    part of its own.

    A null text is an empty one.
    """
    if batch.num_rows == 0:
        return
    text = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset :][: len(text) + 1]
    buffer = text.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer else np.empty(0, dtype=np.uint8)
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, side="right")) - 1)
        b = min(b, len(text), a + most if most else len(text))
        bounds = offsets[a : b + 1] - offsets[a]
        yield Texts(batch.slice(a, b - a), data[offsets[a] : offsets[b]], bounds)
        a = b
