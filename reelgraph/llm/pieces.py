"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model holds a white-space marker after another character (checked when
the model is loaded), so a merge never crosses from a word into the next marker. A text
is cut before each marker that follows another character; each distinct chunk of a batch
is segmented once, and ids are joined back by position. What was segmented stays in a
table of bounded size per task. Decoding gives the joined ids to the library as a whole.

Defined cases: a null text is empty and has the end id alone; texts are encoded whole;
equal rows are encoded alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks that a task keeps at most, and the longest that is kept.
CHUNK_TABLE = 300_000
CHUNK_LONGEST = 64
#: Texts of a batch that are worked on at once.
TEXTS = 256

MARK = "▁"
_BREAK = re.compile(r"(?<=[^ ])(?= )")


class ChunkEncoder:
    def __init__(self, path: str, table: int = CHUNK_TABLE):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        crossing = [p for p in pieces if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces cross the white-space marker: {crossing[:3]}")
        self.alone = self.model.piece_to_id(MARK)
        self.end = self.model.eos_id()
        self.limit = table
        self.known: dict[str, tuple[list[int], str]] = {}

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Chunks without the marker that each begins with; the first marker is implied.

        Where no space stands before a line end, texts are also cut there: no piece holds
        a line end. ``MARK`` before such a chunk says that it has no marker of its own.
        """
        text = text.replace(MARK, " ")
        if not text:
            return []
        if "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " ":
            return [chunk[1:] for chunk in _BREAK.split(" " + text)]
        return text.replace("\n", f" {MARK}\n").split(" ")

    def segment(self, chunks: list[str]) -> list[tuple[list[int], str]]:
        """Ids of chunks, also as decimals; the library itself adds the first marker."""
        coded = self.model.encode([c.lstrip(MARK) for c in chunks], num_threads=1)
        coded = [
            ids[1:] if c[:1] == MARK else ids if c else [self.alone]
            for c, ids in zip(chunks, coded, strict=True)
        ]
        return [(ids, " ".join(map(str, ids))) for ids in coded]

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """Ids of every text with the end id, and the same as decimals joined by spaces."""
        known, out = self.known, []
        split = [self.chunks(t) for t in texts]
        if len(known) > self.limit:
            known.clear()
        found = [list(map(known.get, chunks)) for chunks in split]
        missing = {
            c for chunks, parts in zip(split, found, strict=True) if None in parts
            for c, p in zip(chunks, parts, strict=True) if p is None
        }
        order = list(missing)
        table = dict(zip(order, self.segment(order), strict=True)) if order else {}
        known.update((c, p) for c, p in table.items() if len(c) <= CHUNK_LONGEST)
        for chunks, parts in zip(split, found, strict=True):
            if None in parts:
                parts = [p or table[c] for c, p in zip(chunks, parts, strict=True)]
            ids = list(chain.from_iterable([p[0] for p in parts]))
            ids.append(self.end)
            out.append((ids, " ".join([*[p[1] for p in parts], str(self.end)])))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.model.decode(ids, num_threads=1)


def encode_decode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids (little-endian uint32), decoded text, and ``ids_text``, the decimal ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkEncoder(path)
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                part = batch.slice(first, TEXTS)
                coded = coder.encode([t or "" for t in part.column(1).to_pylist()])
                ids = [i for i, _ in coded]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([np.asarray(i, "<u4").tobytes() for i in ids], pa.binary()),
                        pa.array(coder.decode(ids), pa.string()),
                        pa.array([decimals for _, decimals in coded], pa.string()),
                    ],
                    names=["doc_id", "ids", "decoded", "ids_text"],
                )

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, ids binary, decoded string, ids_text string")
