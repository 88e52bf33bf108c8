"""Near-duplicate frames inside a section."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from reelgraph import config
from reelgraph.functions import vectors
from reelgraph.operators.folds import arranged, coalesced, cuts
from reelgraph.session import cut_lineage

SECTION = ("video_id", "section_index")


def with_unit_histogram(frames: DataFrame, column: str = "histogram") -> DataFrame:
    """Centre and scale each frame's histogram once, ahead of any comparison."""
    return frames.withColumn("unit_histogram", vectors.centered_unit(F.col(column)))


def _bands(bits: Column, count: int) -> list[Column]:
    """``count`` disjoint slices that together hold the 64 bits."""
    edges = [64 * k // count for k in range(count + 1)]
    return [
        F.shiftrightunsigned(bits, low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("bigint"))
        if high - low < 64 else bits
        for low, high in zip(edges, edges[1:])
    ]


def duplicate_pairs(
    features: DataFrame,
    limits: config.DedupLimits = config.DEDUP,
    keys: Sequence[str] = SECTION,
    histograms: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Pairs of frames of a section close in time and alike in colour and hash.

    Needs ``unit_histogram`` and ``phash``; each frame of a section once. ``histograms``
    may add a ``histogram`` to rows of keys and frame_id instead. Hashes that
    differ in at most k bits agree in one of k + 1 disjoint bands, so frames meet on
    (section, window-wide time bucket, band, its bits); the later frame looks in its own and
    the preceding bucket. A pair is taken in the first band in which it agrees, so none
    comes twice. Pairs carry ids, times and hashes only; histograms are fetched for those
    that pass the hash.
    """
    w = limits.window_ms
    count = max(1, min(64, limits.max_hamming + 1))
    light = features.where("phash is not null").select(*keys, "frame_id", "timestamp_ms", "phash")
    bucket = F.floor(F.col("timestamp_ms") / w)
    banded = light.select("*", F.posexplode(F.array(*_bands(F.col("phash"), count))).alias("_band", "_bits"))
    e = banded.withColumn("_b", bucket).alias("e")
    l = banded.withColumn("_b", F.explode(F.array(bucket, bucket - 1))).alias("l")
    same = F.lit(True)
    for key in (*keys, "_b", "_band", "_bits"):
        same = same & (F.col(f"e.{key}") == F.col(f"l.{key}"))
    ordered = F.struct("e.timestamp_ms", "e.frame_id") < F.struct("l.timestamp_ms", "l.frame_id")
    near = (F.col("l.timestamp_ms") - F.col("e.timestamp_ms")) <= w
    differing = F.col("e.phash").bitwiseXOR(F.col("l.phash"))
    distance = F.bit_count(differing)
    agree = F.array_position(F.array(*[b == 0 for b in _bands(differing, count)]), F.lit(True))
    pairs = e.join(l, same & ordered & near & (distance <= limits.max_hamming)).where(
        agree == F.col("e._band") + 1
    ).select(
        *[F.col(f"e.{k}").alias(k) for k in keys],
        F.col("e.frame_id").alias("left_frame_id"),
        F.col("l.frame_id").alias("right_frame_id"),
        distance.alias("hash_distance"),
    )
    for side in ("left", "right"):
        if histograms is None:
            units = features.select(
                *[F.col(k).alias(f"_{k}") for k in keys],
                F.col("frame_id").alias("_frame"), F.col("unit_histogram").alias(f"_{side}"),
            )
            own = F.col(f"{side}_frame_id") == F.col("_frame")
            for key in keys:
                own = own & (F.col(key) == F.col(f"_{key}"))
            pairs = pairs.join(units, own).drop("_frame", *[f"_{k}" for k in keys])
        else:
            told = histograms(pairs.withColumnRenamed(f"{side}_frame_id", "frame_id"))
            pairs = told.withColumnRenamed("frame_id", f"{side}_frame_id").withColumn(
                f"_{side}", vectors.centered_unit(F.col("histogram"))
            ).drop("histogram")
    return pairs.withColumn("correlation", vectors.dot(F.col("_left"), F.col("_right"))).drop("_left", "_right").where(
        F.col("correlation") >= limits.min_correlation
    )


class _Group:
    """A live group: its number (or place at the border, below 0) and representative."""

    __slots__ = ("home", "frame", "time", "quality", "unit", "bits")

    def __init__(self, home: int, frame: tuple):
        self.home = home
        self.represent(frame)

    def represent(self, frame: tuple) -> None:
        self.frame, self.time, self.quality, self.unit, self.bits = frame

    def alike(self, unit: np.ndarray | None, bits: int, limits: config.DedupLimits) -> bool:
        if ((self.bits ^ bits) & 0xFFFFFFFFFFFFFFFF).bit_count() > limits.max_hamming:
            return False
        if unit is None or self.unit is None or len(unit) != len(self.unit):
            return 0.0 >= limits.min_correlation
        return float(np.dot(self.unit, unit)) >= limits.min_correlation


class _Live:
    """Groups that a frame may still join, in order of creation.

    A frame joins the newest one whose representative it duplicates; a strictly better
    frame then represents it.
    """

    def __init__(self, limits: config.DedupLimits):
        self.limits, self.live, self.opened = limits, [], 0

    def expire(self, time: int) -> None:
        self.live = [g for g in self.live if g.time >= time - self.limits.window_ms]

    def visit(self, frame: tuple) -> int:
        _, time, quality, unit, bits = frame
        self.expire(time)
        home = next((g for g in reversed(self.live) if g.alike(unit, bits, self.limits)), None)
        if home is None:
            self.opened += 1
            self.live.append(_Group(self.opened, frame))
            return self.opened
        if quality is not None and (home.quality is None or quality > home.quality):
            home.represent(frame)
        return home.home


class _Chunk:
    """One chunk while its frames pass: first those that lead to it, then its own."""

    def __init__(self, values: tuple, told: list | None, limits: config.DedupLimits):
        self.values, self.told, self.state = values, told, _Live(limits)
        self.lead: dict = {}
        self.entry: list | None = None
        self.first = None

    def lead_by(self, frame: tuple) -> None:
        if self.told is None:
            self.state.visit(frame)
        elif frame[0] in self.told:
            self.lead[frame[0]] = frame

    def _enter(self, time: int) -> None:
        if self.told is None:
            self.state.expire(time)
            frames = [(g.frame, g.time, g.quality, g.unit, g.bits) for g in self.state.live]
        else:
            frames = [self.lead[i] for i in self.told]
        self.entry, self.first, self.state.opened = [f[0] for f in frames], time, 0
        self.state.live = [_Group(-k - 1, f) for k, f in enumerate(frames)]

    def visit(self, frame: tuple) -> int:
        if self.entry is None:
            self._enter(frame[1])
        return self.state.visit(frame)

    def border(self, group: Sequence[str]) -> dict:
        return dict(zip(group, self.values)) | {
            "_border": True, "entry": self.entry, "first_ms": self.first, "opened": self.state.opened,
            "leaving": [{"frame": g.frame, "ms": g.time, "home": g.home} for g in self.state.live],
        }


def _centered(lists: pa.ListArray) -> list[np.ndarray | None]:
    """``vectors.centered_unit`` of every row: the same sums in the same order."""
    offsets = lists.offsets.to_numpy()
    lengths = np.diff(offsets)
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    unknown = np.flatnonzero(lists.values.is_null().to_numpy(zero_copy_only=False))
    units: list[np.ndarray | None] = [None] * len(lists)
    whole = lists.is_valid().to_numpy(zero_copy_only=False) & (lengths > 0)
    whole &= np.searchsorted(unknown, offsets[:-1]) == np.searchsorted(unknown, offsets[1:])
    for length in np.unique(lengths[whole]):
        at = np.flatnonzero(whole & (lengths == length))
        rows = values[offsets[at][:, None] + np.arange(length)]
        rows -= rows.cumsum(axis=1)[:, -1:] / length
        norms = np.sqrt((rows * rows).cumsum(axis=1)[:, -1])
        for i, row, norm in zip(at, rows, norms):
            if not norm <= 0:
                units[i] = row / norm
    return units


def _frames_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    if "histogram" in batch.schema.names:
        units = _centered(batch.column("histogram"))
    else:
        lists = batch.column("unit_histogram")
        values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy().tolist()
        present = lists.is_valid().to_pylist()
        units = (values[offsets[i] : offsets[i + 1]] if present[i] else None for i in range(batch.num_rows))
    columns = (batch.column(c).to_pylist() for c in ("frame_id", "timestamp_ms", "quality_score"))
    yield from zip(*columns, units, batch.column("phash").to_pylist())


def _group_rows(keys: Sequence[str], limits: config.DedupLimits, arrow: pa.Schema):
    """The rows of every chunk with their groups, and one border row.

    A chunk is led by the frames before it (``_warm``). Groups live at its first own frame
    are those the lead produces, or those the border names in ``_told``.
    """
    group = [*keys, "_chunk"]

    def columns(batch: pa.RecordBatch, homes: list[int]) -> pa.RecordBatch:
        added = {"home": homes, "_border": [False] * batch.num_rows}
        return pa.RecordBatch.from_arrays([
            pa.array(added[f.name], f.type) if f.name in added
            else batch.column(f.name).cast(f.type) if f.name in batch.schema.names
            else pa.nulls(batch.num_rows, f.type)
            for f in arrow
        ], schema=arrow)

    def borders(done: list[_Chunk]) -> pa.RecordBatch:
        found = (c.border(group) for c in done if c.entry is not None)
        return pa.RecordBatch.from_pylist([{n: b.get(n) for n in arrow.names} for b in found], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = None
        for batch in batches:
            if not batch.num_rows:
                continue
            homes, done = [], []
            firsts = set(cuts(batch, group)[:-1])
            names = [batch.column(c) for c in group]
            warm = batch.column("_warm").to_pylist()
            for i, (is_warm, frame) in enumerate(zip(warm, _frames_of(batch))):
                if i in firsts:
                    values = tuple(c[i].as_py() for c in names)
                    if chunk is None or chunk.values != values:
                        done += [chunk] if chunk is not None else []
                        chunk = _Chunk(values, batch.column("_told")[i].as_py(), limits)
                if is_warm:
                    chunk.lead_by(frame)
                else:
                    homes.append(chunk.visit(frame))
            yield columns(batch.filter(pc.invert(batch.column("_warm"))), homes)
            yield borders(done)
        if chunk is not None:
            yield borders([chunk])

    return run


def _numbers(keys: Sequence[str], arrow: pa.Schema):
    """Per chunk, in order: the number of groups before it and those of its entry groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, made, held = None, 0, {}
        for batch in batches:
            before, entering = [], []
            for row in batch.to_pylist():
                if key != (key := tuple(row[c] for c in keys)):
                    made, held = 0, {}
                numbers = [held[i] for i in row["entry"]]
                before.append(made)
                entering.append(numbers)
                held = {
                    g["frame"]: made + g["home"] if g["home"] > 0 else numbers[-g["home"] - 1]
                    for g in row["leaving"]
                }
                made += row["opened"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in [*keys, "_chunk"]), pa.array(before, pa.int64()),
                 pa.array(entering, pa.list_(pa.int64()))], schema=arrow,
            )

    return run


def _same(columns: Sequence[str], other: str) -> Column:
    """Equality with the columns of the same names after a prefix, NULL equal to NULL."""
    matched = F.lit(True)
    for c in columns:
        matched = matched & F.col(c).eqNullSafe(F.col(other + c))
    return matched


def near_duplicate_groups(
    frames: DataFrame,
    limits: config.DedupLimits = config.DEDUP,
    keys: Sequence[str] = SECTION,
    chunk_ms: int = 6 * 3_600_000,
    lead_windows: int = 3,
) -> DataFrame:
    """One row per frame with its duplicate group, and whether it represents it.

    ``frames``: passed frames of each section with quality_score, phash and unit_histogram,
    or histogram, which the tasks then centre and scale themselves: a list of 4-byte numbers
    is half as much to shuffle. Each frame comes once. Frames may carry the ``window_end_ms``
    after which their section has none: they then lead to no chunk that begins later.
    Groups depend on time order and on changing representatives, hence a fold
    over (section, time chunk). Each chunk is led by the frames of ``lead_windows`` windows
    before it, from which the groups live at its border follow in all but rare cases. Where
    the groups that leave a chunk are not those that the next one began with, that chunk
    alone runs again from the right ones: their frames' ids are the whole state that
    passes, since the frames themselves lie in the lead. Groups are numbered by adding up
    the groups that earlier chunks opened. The final representative is the best member,
    the earliest among equals.

    The closing window is per group: copies of one picture never replace their
    representative, so a group of them ends one time window after it began.
    """
    if lead_windows < 1:
        raise ValueError("a chunk needs the frames of one window before it")
    lead = lead_windows * limits.window_ms
    span = max(chunk_ms, lead, 1)
    group = [*keys, "_chunk"]
    chunk = F.floor(F.col("timestamp_ms") / span)
    follows = F.col("timestamp_ms") >= (chunk + 1) * span - lead
    if "window_end_ms" in frames.columns:
        follows = follows & F.coalesce(F.col("window_end_ms") >= (chunk + 1) * span, F.lit(True))
    leads = F.when(
        follows, F.array(F.struct((chunk + 1).alias("_chunk"), F.lit(True).alias("_warm")))
    ).otherwise(F.array().cast("array<struct<_chunk:bigint,_warm:boolean>>"))
    at = F.concat(F.array(F.struct(chunk.alias("_chunk"), F.lit(False).alias("_warm"))), leads)
    colours = "histogram" if "histogram" in frames.columns else "unit_histogram"
    rows = frames.select(*keys, "frame_id", "timestamp_ms", "quality_score", colours, "phash", F.inline(at))
    frame = rows.schema["frame_id"].dataType
    number = T.LongType()
    grouped = T.StructType([
        *(rows.schema[c] for c in (*keys, "_chunk", "frame_id", "timestamp_ms", "quality_score")),
        T.StructField("home", number), T.StructField("_border", T.BooleanType()),
        T.StructField("entry", T.ArrayType(frame)), T.StructField("first_ms", number), T.StructField("opened", number),
        T.StructField("leaving", T.ArrayType(T.StructType([
            T.StructField("frame", frame), T.StructField("ms", number), T.StructField("home", number)
        ]))),
    ])
    grouped = T.StructType([T.StructField(f.name, f.dataType) for f in grouped])

    def run(some: DataFrame) -> DataFrame:
        return arranged(some, group, ["timestamp_ms", "frame_id"]).mapInArrow(
            coalesced(_group_rows(keys, limits, to_arrow_schema(grouped))), grouped
        )

    found = cut_lineage(run(rows.withColumn("_told", F.lit(None).cast(T.ArrayType(frame)))))
    previous = F.lag("leaving").over(Window.partitionBy(*keys).orderBy("_chunk"))
    while True:
        alive = F.filter("previous", lambda g: g["ms"] >= F.col("first_ms") - limits.window_ms)
        told = F.coalesce(F.transform(alive, lambda g: g["frame"]), F.array().cast(T.ArrayType(frame)))
        wrong = cut_lineage(
            found.where("_border").withColumn("previous", previous).withColumn("_told", told)
            .where(F.col("_told") != F.col("entry")).select(*[F.col(c).alias(f"w_{c}") for c in group], "_told")
        )
        if wrong.isEmpty():
            break
        w = _same(group, "w_")
        again = run(rows.join(wrong, w).drop(*[f"w_{c}" for c in group]))
        found = cut_lineage(found.join(wrong.drop("_told"), w, "left_anti").unionByName(again))

    numbered = T.StructType([
        *(T.StructField(c, grouped[c].dataType) for c in group),
        T.StructField("before", number), T.StructField("entering", T.ArrayType(number)),
    ])
    offsets = arranged(found.where("_border").select(*group, "entry", "leaving", "opened"), keys, ["_chunk"]).mapInArrow(
        coalesced(_numbers(keys, to_arrow_schema(numbered))), numbered
    ).select(*[F.col(c).alias(f"o_{c}") for c in group], "before", "entering")
    number_of = F.when(F.col("home") > 0, F.col("before") + F.col("home")).otherwise(
        F.element_at("entering", (-F.col("home")).cast("int"))
    )
    members = found.where("not _border").join(offsets, _same(group, "o_")).select(
        *keys, "frame_id", "timestamp_ms", "quality_score", number_of.alias("group_no")
    )
    same = Window.partitionBy(*keys, "group_no")
    best = F.min_by(
        "frame_id", F.struct(-F.col("quality_score"), F.col("timestamp_ms"), F.col("frame_id"))
    )
    return (
        members.withColumn("member_no", F.row_number().over(same.orderBy("timestamp_ms", "frame_id")).cast("long"))
        .withColumn("representative_frame_id", best.over(same))
        .withColumn("group_size", F.count(F.lit(1)).over(same))
        .withColumn("is_representative", F.col("frame_id") == F.col("representative_frame_id"))
    )


def group_label(keys_prefix: bool = True):
    number = F.format_string("dedup_group_%04d", F.col("group_no"))
    if not keys_prefix:
        return number
    return F.concat(
        F.lit("section_"), F.col("section_index").cast("string"), F.lit("_query_graph_"), number
    )


def dedup_frame_report(members: DataFrame) -> DataFrame:
    """Per frame: kept or rejected, its group, and the frame it duplicates."""
    kept = F.col("is_representative")
    return members.select(
        *SECTION,
        "frame_id",
        F.when(kept, F.lit("kept")).otherwise(F.lit("duplicate_rejected")).alias("dedup_status"),
        group_label().alias("dedup_group_id"),
        F.when(~kept, F.col("representative_frame_id")).alias("duplicate_of_frame_id"),
        "quality_score",
    )


def dedup_group_report(members: DataFrame, part_rows: int = config.PART_ROWS) -> DataFrame:
    """Per group: representative, size and member ids in time order.

    Ids come in parts of ``part_rows`` members; a smaller group is part 0.
    """
    ids = F.sort_array(F.collect_list(F.struct("member_no", "frame_id")))
    return (
        members.withColumn("part_no", F.floor((F.col("member_no") - 1) / part_rows))
        .groupBy(*SECTION, "group_no", "representative_frame_id", "group_size", "part_no")
        .agg(F.transform(ids, lambda x: x["frame_id"]).alias("frame_ids"))
        .withColumn("dedup_group_id", group_label())
        .drop("group_no")
    )
