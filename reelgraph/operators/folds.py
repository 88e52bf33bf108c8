"""Rows of a group as an ordered Arrow stream, for rules that depend on order.

Groups are (key, time chunk), so no key is one task: rows are dealt by group, sorted, and
streamed through Arrow batches. What passes from chunk to chunk is the caller's: a small
row per chunk that is composed in time order (``timestamps``, ``dedup``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of an Arrow batch that small pieces are joined into.
BATCH_ROWS = 10_000


def cuts(batch: pa.RecordBatch, group: Sequence[str]) -> list[int]:
    """Row numbers where a group begins, and the end; NULL equals NULL."""
    changed = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
    for name in group:
        codes = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy()
        changed |= codes[1:] != codes[:-1]
    return [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]


def whole_groups(
    batches: Iterator[pa.RecordBatch], group: Sequence[str]
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of whole groups with the row numbers where each begins, and the end."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = [tuple(batch.column(c)[row].as_py() for c in group) for row in (0, batch.num_rows - 1)]
        held.append(batch)
        # The last group may go on in the next batch; nothing is whole while it does.
        if ends != [last, last]:
            table, starts = _joined(held, group)
            if len(starts) > 2:
                yield table.slice(0, int(starts[-2])), starts[:-1]
                table = table.slice(int(starts[-2]))
            held, last = table.to_batches(), ends[1]
    if held:
        yield _joined(held, group)


def _joined(held: list[pa.RecordBatch], group: Sequence[str]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(held).combine_chunks()
    return table, np.array(cuts(table.to_batches()[0], group))


def arranged(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    return rows.repartition(*group).sortWithinPartitions(*group, *order)


def coalesced(run: Callable) -> Callable:
    """Join the small pieces of a task into fuller batches."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for piece in run(batches):
            held.append(piece)
            rows += piece.num_rows
            if rows >= BATCH_ROWS:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined
