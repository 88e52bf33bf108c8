"""Distinct words of Arrow batches, for models whose score of a text adds up over words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose values a task keeps at most.
WORD_TABLE = 300_000
WORD_LONGEST = 64
TEXTS = 256

_FIRST = np.uint64(0xBF58476D1CE4E5B9)
_SECOND = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _FIRST
    x = (x ^ (x >> np.uint64(27))) * _SECOND
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as bytes: ASCII white space, exactly the six characters, separates."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordSums:
    """Sums of per-word values over texts; each distinct word is valued once.

    ``value`` turns a list of words into an array of one row per word.
    """

    def __init__(self, value: Callable[[list[bytes]], np.ndarray], width: int, table: int = WORD_TABLE):
        self.value, self.width, self.limit = value, width, table
        self.place: dict[bytes, int] = {}
        self.values = np.zeros((0, width))

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """One row per text: words, words equal to the one before, then sums of the values."""
        split = [words_of(t) for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        fresh = set().union(*split).difference(self.place) if split else set()
        if fresh:
            if len(self.place) > self.limit:
                self.place.clear()
                self.values = self.values[:0]
                fresh = set().union(*split)
            order = list(fresh)
            base = len(self.place)
            self.place.update(zip(order, range(base, base + len(order)), strict=True))
            self.values = np.concatenate([self.values[:base], self.value(order)])
        out = np.zeros((len(split), 2 + self.width))
        out[:, 0] = sizes
        place = self.place
        for k, words in enumerate(split):
            if words:
                at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                out[k, 1] = np.count_nonzero(at[1:] == at[:-1])
                out[k, 2:] = self.values[at].sum(axis=0)
        return out


class Words:
    """Words of texts, one after the other, as numbers of a dictionary of their own.

    Arrow splits and numbers them: ASCII white space, exactly the six characters, separates.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        full = pc.greater(pc.binary_length(flat), 0)
        # Words before each text; white space at either end leaves an empty word.
        before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
        self.offsets = before[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])]
        self.flat = flat.filter(full)
        coded = self.flat.dictionary_encode()
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.values = coded.dictionary

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words: mixed sums of one mixed number per byte and place."""
        if not len(self.values):
            return np.zeros(0, np.uint64)
        _, bounds, data = self.values.buffers()
        at = self.values.offset
        bounds = np.frombuffer(bounds, np.int32)[at:at + len(self.values) + 1].astype(np.int64)
        own = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]].astype(np.uint64)
        begins = bounds[:-1] - bounds[0]
        place = np.arange(len(own)) - np.repeat(begins, np.diff(bounds))
        own += (place.astype(np.uint64) + np.uint64(1)) << np.uint64(8)
        return mix(np.add.reduceat(mix(own), begins))[self.codes]

    def starts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where n words of one text begin, and the number of that text."""
        counts = np.maximum(np.diff(self.offsets) - n + 1, 0)
        owner = np.repeat(np.arange(len(counts)), counts)
        skipped = self.offsets[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]])
        return np.arange(len(owner)) + skipped[owner], owner


def each_part(batches: Iterator[pa.RecordBatch], texts: int = TEXTS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, texts):
            yield batch.slice(first, texts)
