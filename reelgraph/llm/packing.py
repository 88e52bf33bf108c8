"""Best-fit packing: tokens of documents into sequences by the sum of squares.

``tokenize_pieces`` turns every text into ids and cuts what is longer than a sequence.
``pack`` places pieces: of the open bins (and a new one) it takes that after which the
squared counts of open bins per residual gap sum to least, ties to the tightest fit.

Pieces are dealt evenly into groups of about ``GROUP_PIECES``; each group is packed by
one task, so a task's memory is bounded and the number of groups follows the table.
Only lengths travel to the packer. Its state is one count per gap, whatever the group.
Pieces are placed from the longest to the shortest, which leaves fewer open bins.

Ids are those of the tokenizers file. They are worked out by tiktoken, which reads the
same vocabulary and merges by the same ranks; tests hold both against each other.

Defined cases: a null text is empty and has the closing id alone; texts longer than a
sequence are cut, the first piece the shorter one; equal rows give a piece each; a null
doc_id is carried; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.llm.common import Shared

CAPACITY = 2048
#: Pieces that one task packs, on average.
GROUP_PIECES = 65_536

# The split rule of byte-level vocabularies and the bytes they write as themselves.
SPLIT = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def load_encoding(path: str):
    """The vocabulary of a tokenizers file as a tiktoken encoding: the same ids, faster.

    Ids of a byte-level vocabulary grow in the order of its merges, so they are ranks.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    others = [b for b in range(256) if b not in PRINTABLE]
    byte_of = {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in content["added_tokens"]}
    ranks = {
        bytes(byte_of[c] for c in token): rank
        for token, rank in content["model"]["vocab"].items() if token not in special
    }
    return tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.encoding = load_encoding(path)
        self.special = tuple(self.encoding.special_tokens_set)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            ids = self.encoding.encode(text, allowed_special="all")
        else:
            ids = self.encoding.encode_ordinary(text)
        return np.asarray(ids, "<u4").tobytes()


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: the first may be shorter."""
    head = length % capacity or min(length, capacity)
    starts = [0, *range(head, length, capacity)]
    return [(s, head if s == 0 else capacity) for s in starts]


def tokenize_pieces(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id",
                    capacity: int = CAPACITY, closing_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian uint32)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        close = np.asarray([closing_id], "<u4").tobytes()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                keys = part.column(0).to_pylist()
                texts = [t or "" for t in part.column(1).to_pylist()]
                out: list[tuple] = []
                for key, content in zip(keys, texts, strict=True):
                    ids = encoder.encode(content) + close
                    for number, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                        out.append((key, number, start, length, ids[4 * start:4 * (start + length)]))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(
                        columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of every piece, placed in the order given.

    ``count[g]`` is the number of open bins with gap ``g``. A piece of length ``s`` put
    into gap ``g`` changes the sum of squares by ``2 (count[g - s] - count[g] + 1)``; into
    a new bin by ``2 count[capacity - s] + 1``; filling a bin by ``1 - 2 count[s]``.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        change = 2 * (count[:capacity - s + 1] - count[s:] + 1)
        change[0] = 1 - 2 * count[s]
        change[count[s:] == 0] = np.iinfo(np.int64).max
        # A gap of the whole capacity stands for a new bin.
        change[capacity - s] = 2 * count[capacity - s] + 1 if s < capacity else 0
        gap = s + int(change.argmin())
        if gap == capacity:
            number, made = made, made + 1
        else:
            number = open_bins[gap].pop()
            count[gap] -= 1
        bins[k], offsets[k] = number, capacity - gap
        if gap > s:
            open_bins[gap - s].append(number)
            count[gap - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (no ``ids``) with ``sequence_id`` and ``offset``.

    Pieces are written once, so that their numbers and the deal into groups are fixed.
    """
    shared = Shared(pieces.sparkSession)
    table = shared.save(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-table.count() // group_pieces))
    # The place in the writing task, not a value of the row: copies spread as others do.
    group = F.pmod(F.col("_row") + F.shiftright("_row", 33) * 7919, F.lit(groups))
    columns = pieces.columns

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "_row"], ascending=[False, True], kind="stable")
        bins, offsets = sum_of_squares(frame["length"].to_numpy(), capacity)
        frame["sequence_id"] = bins * groups + frame["_group"].iloc[0]
        frame["offset"] = offsets
        return frame[[*columns, "sequence_id", "offset"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return (
        table.withColumn("_group", group)
        .groupBy("_group")
        .applyInPandas(place, f"{fields}, sequence_id long, offset long")
    )
