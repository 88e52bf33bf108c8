"""Streams: latest job state and intake of new media, with keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from reelgraph import config
from reelgraph.functions import text

# --- fixed values -----------------------------------------------------------
VIDEO_SUFFIXES = (".mp4", ".mov", ".webm", ".m4v", ".mkv")
# --- end of fixed values ----------------------------------------------------

#: A snapshot replaces the change folders before it every so many batches.
COMPACT_EVERY = 16

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query on the state store that keyed state of several columns needs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return start()
    finally:
        spark.conf.set(_PROVIDER, before)


# Latest state -------------------------------------------------------------------


def _newer(updated_at: Any, terminal: bool | None, seq: Any) -> tuple:
    """Sort key of an update: time, then terminal, then ``seq``, NULL lowest."""
    return updated_at, -1 if terminal is None else int(terminal), seq is not None, seq if seq is not None else 0


class _Latest(StatefulProcessor):
    """Per id the newest update, or the fact that the id was deleted."""

    def __init__(self, row: T.StructType, terminal: Sequence[str]):
        self.row, self.terminal = row, tuple(terminal)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", self.row)
        self.gone = handle.getValueState("gone", T.StructType([T.StructField("gone", T.BooleanType())]))

    def _order(self, row: Any) -> tuple:
        status = row["status"]
        return _newer(row["updated_at"], None if status is None else status in self.terminal, row["seq"])

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        best, deleted = None, False
        for row in rows:
            deleted = deleted or row["_deleted"]
            if not row["_deleted"] and (best is None or self._order(row) > self._order(best)):
                best = row
        names = self.row.names
        if self.gone.exists():
            return
        if deleted:
            self.newest.clear()
            self.gone.update((True,))
            yield Row(id=key[0], **dict.fromkeys(names), _deleted=True)
            return
        if best is None:
            return
        if self.newest.exists():
            held = dict(zip(names, self.newest.get(), strict=True))
            if self._order(best) <= self._order(held):
                return
        values = {n: best[n] for n in names}
        self.newest.update(tuple(values.values()))
        yield Row(id=key[0], **values, _deleted=False)

    def close(self) -> None:
        pass


def _newest_of_batch(terminal: Sequence[str]):
    """Keep the newest update of an id in every Arrow batch, so a hot id sends few rows."""
    statuses = pa.array(list(terminal), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status = batch.column("status").cast(pa.string())
            ended = pc.if_else(status.is_null(), None, pc.is_in(status, statuses).cast(pa.int8()))
            table = pa.table({
                "id": batch.column("id"), "deleted": batch.column("_deleted").cast(pa.int8()),
                "time": batch.column("updated_at"), "ended": ended, "seq": batch.column("seq"),
            })
            order = pc.sort_indices(
                table, [(c, "ascending") for c in table.column_names], null_placement="at_start"
            ).to_numpy()
            ids = pc.take(batch.column("id"), pa.array(order)).to_numpy(zero_copy_only=False)
            last = np.append(ids[1:] != ids[:-1], True) if len(ids) else np.zeros(0, bool)
            yield batch.take(pa.array(np.sort(order[last])))

    return run


def latest_state_stream(
    updates: DataFrame,
    sink: str,
    checkpoint: str,
    terminal: Sequence[str] = config.TERMINAL_STATUSES,
    tombstones: DataFrame | None = None,
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Follow job-status updates; every batch writes the states that changed.

    ``updates`` has id, status, updated_at, seq and any other columns; ``tombstones`` (a
    stream too) ids that never return. Both are kept per id by ``transformWithState``: a
    late or repeated update loses against the held one by the total order (time, terminal,
    seq) and writes nothing. A batch owns the folder ``batch=N``, so a replayed batch
    overwrites itself; every ``compact_every`` batches a snapshot ``base=N`` takes their
    place. State holds one row per id, without expiry: a job may be updated at any age.
    Rows without an id take no part; those without a time go to ``quarantine_stream``.
    """
    spark = updates.sparkSession
    row = T.StructType([f for f in updates.schema if f.name != "id"])
    changes = updates.where("id is not null and updated_at is not null").withColumn("_deleted", F.lit(False))
    if tombstones is not None:
        ids = tombstones.where("id is not null").select(F.col("id").cast(updates.schema["id"].dataType))
        changes = changes.unionByName(ids.withColumn("_deleted", F.lit(True)), allowMissingColumns=True)
    combined = changes.mapInArrow(_newest_of_batch(terminal), changes.schema)
    out = T.StructType([updates.schema["id"], *row, T.StructField("_deleted", T.BooleanType())])
    state = combined.groupBy("id").transformWithState(
        statefulProcessor=_Latest(row, terminal), outputStructType=out, outputMode="Update", timeMode="None"
    )

    def upsert(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        if number % compact_every == compact_every - 1:
            _compact(batch.sparkSession, sink, number)

    return _start(spark, lambda: (
        state.writeStream.outputMode("update")
        .foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    ))


def quarantine_stream(updates: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Updates that no order can place: without a time, or without an id."""
    odd = updates.where("id is null or updated_at is null")
    reason = F.when(F.col("id").isNull(), F.lit("unknown_id")).otherwise(F.lit("unknown_time"))
    return (
        odd.withColumn("reason", reason).writeStream.format("parquet").option("path", sink)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _folders(spark: SparkSession, sink: str, kind: str) -> list[int]:
    """Numbers of the complete ``kind=N`` folders, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sink)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/{kind}=*/_SUCCESS"))
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in done or ())


def _written(spark: SparkSession, sink: str, upto: int | None = None) -> tuple[int, DataFrame | None]:
    """The newest snapshot's number (-1: none), and it with the changes after it."""
    base = max((n for n in _folders(spark, sink, "base") if upto is None or n < upto), default=-1)
    later = [n for n in _folders(spark, sink, "batch") if n > base and (upto is None or n <= upto)]
    paths = [f"{sink}/batch={n}" for n in later] + ([f"{sink}/base={base}"] if base >= 0 else [])
    if not paths:
        return base, None
    rows = spark.read.parquet(*paths)
    folder = F.regexp_extract(F.input_file_name(), r"/(?:base|batch)=(\d+)/", 1).cast("long")
    return base, rows.withColumn("_folder", folder)


def _newest_rows(rows: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c not in ("id", "_folder")]
    newest = rows.groupBy("id").agg(F.max_by(F.struct(*rest), "_folder").alias("row"))
    return newest.select("id", "row.*").where("not _deleted")


def _compact(spark: SparkSession, sink: str, number: int) -> None:
    """Write snapshot ``number``, then drop what the snapshot before it made needless.

    One generation stays, so a reader that began before this snapshot still finds its files.
    Deleted ids leave the snapshot; the stream's state keeps them out for good.
    """
    older, rows = _written(spark, sink, number)
    if rows is not None:
        _newest_rows(rows).write.mode("overwrite").parquet(f"{sink}/base={number}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(sink).getFileSystem(spark._jsc.hadoopConfiguration())
    for kind, least in (("batch", older + 1), ("base", older)):
        for n in _folders(spark, sink, kind):
            if n < least:
                files.delete(hadoop.Path(f"{sink}/{kind}={n}"), True)


def current_state(spark: SparkSession, sink: str) -> DataFrame:
    """The newest written state per id, without deleted ids."""
    _, rows = _written(spark, sink)
    if rows is None:
        raise ValueError(f"no batch was written to {sink} yet")
    return _newest_rows(rows).drop("_deleted")


# Intake ---------------------------------------------------------------------------


def intake_reason(max_bytes: int = config.MAX_UPLOAD_BYTES):
    """Why a new file is refused by itself; NULL if it is fine."""
    suffix = text.file_suffix(text.base_name("filename"))
    size = F.coalesce(F.col("size_bytes"), F.lit(0))
    return (
        F.when(~suffix.isin(*VIDEO_SUFFIXES), F.lit("unsupported_suffix"))
        .when(size <= 0, F.lit("empty_file"))
        .when(size > max_bytes, F.lit("too_large"))
    )


def judge_intake(
    rows: DataFrame, known: DataFrame | None = None, max_bytes: int = config.MAX_UPLOAD_BYTES
) -> DataFrame:
    """Add ``reason``: NULL for accepted rows of a table.

    Of the acceptable rows of an id the first (by ``seq``) is taken, unless the
    id is already known; others are duplicates. The first is found by an
    aggregate, so an id sent very often does not gather in one task.
    """
    judged = rows.withColumn("_own", intake_reason(max_bytes))
    first = (
        judged.where(F.col("_own").isNull()).groupBy("id").agg(F.min("seq").alias("_first"))
    )
    if known is not None:
        taken = known.select("id", F.lit(True).alias("_known")).distinct()
        first = first.join(taken, "id", "left")
    else:
        first = first.withColumn("_known", F.lit(None).cast("boolean"))
    duplicate = F.coalesce(F.col("_known"), F.lit(False)) | (F.col("seq") != F.col("_first"))
    return (
        judged.join(first, "id", "left")
        .withColumn(
            "reason", F.coalesce(F.col("_own"), F.when(duplicate, F.lit("duplicate_id")))
        )
        .drop("_own", "_first", "_known")
    )


def _first_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In every Arrow batch leave only the first acceptable row of an id undecided."""
    for batch in batches:
        reasons = batch.column("reason")
        table = pa.table({
            "id": batch.column("id"), "own": reasons.is_valid().cast(pa.int8()), "seq": batch.column("seq"),
        })
        order = pc.sort_indices(
            table, [(c, "ascending") for c in table.column_names], null_placement="at_start"
        ).to_numpy()
        ids = pc.take(batch.column("id"), pa.array(order)).to_numpy(zero_copy_only=False)
        first = np.zeros(len(ids), bool)
        if len(ids):
            first[order[np.append(True, ids[1:] != ids[:-1])]] = True
        open_ = reasons.is_null().to_numpy(zero_copy_only=False)
        at = batch.schema.get_field_index("reason")
        yield batch.set_column(
            at, batch.schema.field(at), pc.if_else(pa.array(open_ & ~first), "duplicate_id", reasons)
        )


class _Taken(StatefulProcessor):
    """Per id whether it was accepted; only rows without a reason so far arrive."""

    def __init__(self, names: Sequence[str]):
        self.names = tuple(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", T.StructType([T.StructField("taken", T.BooleanType())]))

    def _row(self, row: Row, reason: str | None) -> Row:
        return Row(**{n: row[n] for n in self.names}, reason=reason)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known, first = self.taken.exists(), None
        for row in rows:
            if known or (first is not None and row["seq"] >= first["seq"]):
                yield self._row(row, "duplicate_id")
                continue
            if first is not None:
                yield self._row(first, "duplicate_id")
            first = row
        if first is not None:
            self.taken.update((True,))
            yield self._row(first, None)

    def close(self) -> None:
        pass


def intake_stream(
    rows: DataFrame,
    sink: str,
    checkpoint: str,
    max_bytes: int = config.MAX_UPLOAD_BYTES,
) -> StreamingQuery:
    """Judge arriving media rows (id, filename, size_bytes, seq) batch by batch.

    Accepted ids are keyed state of the stream, one flag per accepted video without
    expiry, as ids never expire; a batch reads nothing but itself. Of the acceptable rows
    of an id in a batch the first by ``seq`` is taken, unless a batch before took one. Rows
    that are judged without state, by themselves or as later rows of their id in an Arrow
    batch, pass beside it, so that no id gathers in one task. Every row is
    written once, with ``reason`` NULL if accepted. Rows without an id or a ``seq`` are
    refused: ``unknown_id``, ``unknown_seq``.
    """
    spark = rows.sparkSession
    own = F.coalesce(
        F.when(F.col("id").isNull(), F.lit("unknown_id")).when(F.col("seq").isNull(), F.lit("unknown_seq")),
        intake_reason(max_bytes),
    )
    judged = rows.withColumn("reason", own)
    judged = judged.mapInArrow(_first_of_batch, judged.schema)
    undecided = judged.where("reason is null").groupBy("id").transformWithState(
        statefulProcessor=_Taken(rows.columns), outputStructType=judged.schema, outputMode="Append", timeMode="None"
    )
    out = judged.where("reason is not null").unionByName(undecided)
    return _start(spark, lambda: (
        out.writeStream.outputMode("append").format("parquet").option("path", sink)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    ))
