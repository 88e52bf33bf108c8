"""Word hashes of Arrow texts, and bit tables of bounded size.

A bit table says of a 64-bit hash whether it may belong to a set. It has ``BITS`` bits
whatever the set's size, so what tasks are sent has a fixed bound; a set too large for it
only lets more hashes through, and every use is followed by an exact join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgraph.llm.ngram_join import mix

#: Bits of a table: 1 MiB, at most 256 rows of 4 KiB on their way to the driver.
BITS = 1 << 23
_ROW_BITS = 4096 * 8

#: Bytes worked on at once; arrays of a step are about 40 times as large.
SLICE = 1 << 20

_BASE = 0xD6E8FEB86659FD93
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _cell(column: Column) -> Column:
    """The bit of a hash; Spark numbers bits from 1."""
    return F.pmod(column, F.lit(BITS)) + 1


def _bit_rows(hashes: DataFrame, column: str) -> DataFrame:
    """(row, bits): the bit table of a long column, built by Spark's bitmap aggregate."""
    cell = _cell(F.col(column))
    return hashes.where(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(cell).alias("row")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits")
    )


def bit_table(hashes: DataFrame, column: str) -> bytes:
    """The bit table of a long column."""
    rows = _bit_rows(hashes, column).toArrow()
    table = bytearray(BITS // 8)
    for row, bits in zip(rows.column("row").to_pylist(), rows.column("bits").to_pylist(), strict=True):
        first = (row - 1) * _ROW_BITS // 8
        table[first:first + len(bits)] = bits
    return bytes(table)


def may_hold(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Of each hash (uint64), whether its bit is set in a table read as uint8."""
    cell = hashes % np.uint64(BITS)
    return (table[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0


def rows_that_may_join(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key may be among ``keys``, so that an exact join shuffles few others.

    The bit table is broadcast, 1 MiB at most; rows with a null key go.
    """
    cell = _cell(F.xxhash64(column))
    place = F.bitmap_bit_position(cell)
    table = _bit_rows(keys.where(F.col(column).isNotNull()).select(F.xxhash64(column).alias("_hash")), "_hash")
    table = table.select(F.col("row").alias("_row"), F.col("bits").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    known = F.getbit(byte, (place % 8).cast("int")) == 1
    held = rows.where(F.col(column).isNotNull()).join(F.broadcast(table), F.bitmap_bucket_number(cell) == F.col("_row"))
    return held.where(known).drop("_row", "_bits")


def _powers(base: int) -> np.ndarray:
    out = np.full(SLICE + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class ByteWords:
    """Words of UTF-8 texts as hashes and byte places, found in whole buffers at once.

    ``lower`` maps each byte to itself, to another byte, or to 0 where it ends a word.
    """

    def __init__(self, lower: np.ndarray):
        self.lower = lower
        self.up, self.down = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))

    def _slice(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, hashes) of a slice; a word also ends at each of ``breaks``."""
        low = self.lower[data]
        padded = np.zeros(len(low) + 2, bool)
        padded[1:-1] = low != 0
        begin, end = padded[1:-1] & ~padded[:-2], padded[1:-1] & ~padded[2:]
        inner = breaks[(breaks > 0) & (breaks < len(low))]
        begin[inner] = padded[1:-1][inner]
        end[inner - 1] = padded[1:-1][inner - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        sums = np.zeros(len(low) + 1, np.uint64)
        np.cumsum(low * self.up[:len(low)], out=sums[1:])
        return starts, ends, mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def of(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of whole texts: (first text, offsets, data, starts, ends, hashes).

        ``offsets`` are the bytes of the run's texts in ``data``. A run has at most SLICE
        bytes or is a single longer text, which is worked on in slices that end between words.
        """
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1)
            own, cuts = data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
            if len(own) <= SLICE:
                yield first, cuts, own, *self._slice(own, cuts)
            else:
                parts = [
                    (s + at, e + at, h) for at, piece in self._pieces(own)
                    for s, e, h in [self._slice(piece, np.zeros(0, np.int64))]
                ]
                yield first, cuts, own, *(np.concatenate(x) for x in zip(*parts, strict=True))
            first = last

    def _pieces(self, data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        at = 0
        while at < len(data):
            stop = min(len(data), at + SLICE)
            if stop < len(data):
                gaps = np.flatnonzero(self.lower[data[at:stop]] == 0)
                while not len(gaps) and stop < len(data):
                    fresh = np.flatnonzero(self.lower[data[stop:stop + SLICE]] == 0)
                    gaps = fresh + (stop - at)
                    stop = min(len(data), stop + SLICE)
                if len(gaps):
                    stop = at + int(gaps[-1]) + 1
            if stop - at >= len(self.up):
                longest = 1 << int(stop - at).bit_length()
                self.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(longest, _BASE, np.uint64)])
                self.down = np.multiply.accumulate(
                    np.r_[np.uint64(1), np.full(longest, pow(_BASE, -1, 1 << 64), np.uint64)]
                )
            yield at, data[at:stop]
            at = stop


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, different for each n."""
    out = np.full(max(0, len(words) - n + 1), n, np.uint64)
    for k in range(n):
        out = (out ^ words[k:len(words) - n + 1 + k]) * _STEP
        out ^= out >> np.uint64(29)
    return mix(out)
