"""Detections of a frame: normal form, masks, relations and signals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgraph import config
from reelgraph.functions import geometry as g
from reelgraph.functions import text
from reelgraph.functions.geometry import Box
from reelgraph.operators.skew import split_hot

BOX = ("x1", "y1", "x2", "y2")
MASK_BOX = ("mx1", "my1", "mx2", "my2")
SALTS = 64


def mask_metrics(detections: DataFrame, pixels: DataFrame) -> DataFrame:
    """Add mask box, area, centre and border touch from set mask pixels.

    pixels: frame_id, det_no, x, y. detections: has_mask, mask_width,
    mask_height and the image width and height. Pixels are combined before the
    shuffle; a mask without pixels takes the image centre; detections without
    a mask keep NULL and fall back to their box later.
    """
    key = ["frame_id", "det_no"]
    found = pixels.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"),
        *[f(c).alias(f"_{n}{c}") for c in "xy" for n, f in
          (("lo", F.min), ("hi", F.max), ("mid", F.avg))],
    )
    sx = F.col("width") / F.greatest(F.lit(1.0), F.col("mask_width").cast("double"))
    sy = F.col("height") / F.greatest(F.lit(1.0), F.col("mask_height").cast("double"))
    empty = F.col("_n").isNull()

    def of(full: Column, default: Column) -> Column:
        return F.when(F.col("has_mask"), F.when(empty, default).otherwise(full))

    zero = F.lit(0.0)
    box = {
        "mx1": of(F.col("_lox") * sx, zero),
        "my1": of(F.col("_loy") * sy, zero),
        "mx2": of((F.col("_hix") + 1) * sx, zero),
        "my2": of((F.col("_hiy") + 1) * sy, zero),
    }
    border = g.touches_border(Box(**dict(zip(BOX, box.values()))), F.col("width"), F.col("height"))
    return (
        detections.join(found, key, "left")
        .withColumns(
            {
                **box,
                "mask_area_ratio": of(
                    F.col("_n") / (F.col("mask_width") * F.col("mask_height")), zero
                ),
                "centroid_x": of(F.col("_midx") * sx, F.col("width") / 2.0),
                "centroid_y": of(F.col("_midy") * sy, F.col("height") / 2.0),
                "touches_border": F.when(empty & F.col("has_mask"), F.lit(False)).otherwise(border),
            }
        )
        .drop("_n", *[f"_{n}{c}" for n in ("lo", "hi", "mid") for c in "xy"])
    )


def normalize_detections(
    detections: DataFrame, synonyms: Mapping[str, str] | None = config.LABEL_SYNONYMS
) -> DataFrame:
    """Fill what a detection leaves out: mask box from box, areas, centre, border.

    An area of 0 counts as missing, a centre or border flag only when NULL.
    """
    width = F.greatest(F.lit(1), F.coalesce(F.col("width"), F.lit(0)))
    height = F.greatest(F.lit(1), F.coalesce(F.col("height"), F.lit(0)))

    def given(name: str, kind: str = "double") -> Column:
        return F.col(name) if name in detections.columns else F.lit(None).cast(kind)

    def filled(name: str, default: Column) -> Column:
        return F.coalesce(F.when(given(name) != 0, given(name)), default)

    boxed = detections.withColumns(
        {m: F.coalesce(given(m), F.col(c)) for m, c in zip(MASK_BOX, BOX)}
        | {"width": width, "height": height}
    )
    mask = Box(*[F.col(m) for m in MASK_BOX])
    cx, cy = g.box_center(mask)
    bbox_area = filled("bbox_area_ratio", g.box_area_ratio(Box.of(""), F.col("width"), F.col("height")))
    # A generator computes the label once; a filter on a plain column would do so again below.
    label = F.explode(F.array(text.normalize_label("label", synonyms)))
    return (
        boxed.withColumn("label", label)
        .withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
        .withColumn("bbox_area_ratio", bbox_area)
        .withColumn("area", filled("mask_area_ratio", F.col("bbox_area_ratio")))
        .withColumn("centroid_x", F.coalesce(given("centroid_x"), cx))
        .withColumn("centroid_y", F.coalesce(given("centroid_y"), cy))
        .withColumn(
            "touches_border",
            F.coalesce(
                given("touches_border", "boolean"),
                g.touches_border(mask, F.col("width"), F.col("height")),
            ),
        )
        .drop("mask_area_ratio")
    )


def fill_image_size(detections: DataFrame) -> DataFrame:
    """Sizes of images whose detector gave none, from the largest box corner in the frame.

    ``detections``: normalised, with one size per frame; width or height of 1 or less counts
    as missing, and then neither becomes smaller than the corners. Rows with a size pass by
    without a shuffle; the corners of the others are combined before it.
    """
    missing = (F.col("width") <= 1) | (F.col("height") <= 1)
    without = detections.where(missing)
    corners = without.groupBy(F.col("frame_id").alias("_frame")).agg(
        F.max("mx2").alias("_right"), F.max("my2").alias("_bottom")
    )
    kinds = detections.schema

    def grown(size: str, corner: str) -> Column:
        return F.greatest(F.col(size), F.ceil(F.coalesce(corner, F.lit(0.0)))).cast(kinds[size].dataType)

    filled = without.join(corners, F.col("frame_id") == F.col("_frame")).withColumns(
        {"width": grown("width", "_right"), "height": grown("height", "_bottom")}
    )
    return detections.where(~missing).unionByName(filled.drop("_frame", "_right", "_bottom"))


def _related(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """First pair per (frame, from, relation, to) in detection order.

    Pairs stream from the join into the aggregate, whose buffers are plain
    numbers (pair order in one BIGINT), so they are never stored.
    """
    l, r = left.alias("l"), right.alias("r")
    same = F.col("l.det_no") != F.col("r.det_no")
    for key in on:
        same = same & (F.col(f"l.{key}") == F.col(f"r.{key}"))
    lbox = Box(*[F.col(f"l.{m}") for m in MASK_BOX])
    rbox = Box(*[F.col(f"r.{m}") for m in MASK_BOX])
    overlap = g.overlap_ratio(lbox, rbox)
    distance = g.center_distance(
        F.col("l.centroid_x"), F.col("l.centroid_y"), F.col("r.centroid_x"),
        F.col("r.centroid_y"), F.col("l.width"), F.col("l.height"),
    )
    hand = F.col("from") == "hand"
    relation = (
        F.when(hand & (F.col("overlap") >= 0.03), F.lit("occludes"))
        .when(hand & (F.col("distance") <= 0.28), F.lit("near"))
        .when(F.col("overlap") >= 0.10, F.lit("overlaps"))
        .when(F.col("distance") <= 0.22, F.lit("near"))
    )
    place = F.col("l.det_no").cast("bigint") * F.lit(2**31) + F.col("r.det_no")
    score = F.greatest("overlap", F.greatest(F.lit(0.0), F.lit(1.0) - F.col("distance")))
    return (
        l.join(r, same)
        .select(
            F.col("l.frame_id").alias("frame_id"),
            F.col("l.label").alias("from"),
            F.col("r.label").alias("to"),
            place.alias("place"),
            overlap.alias("overlap"),
            distance.alias("distance"),
        )
        .withColumn("relation", relation)
        .where(F.col("relation").isNotNull())
        .withColumn("score", score)
        .groupBy("frame_id", "from", "relation", "to")
        .agg(F.min("place").alias("place"), F.min_by("score", "place").alias("score"))
    )


def scene_relations(
    detections: DataFrame,
    cap: int = config.MAX_RELATIONS_PER_FRAME,
    max_detections: int = 1_000,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Relations between a frame's objects, at most ``cap`` in detection order.

    A detector returns a dozen boxes per frame, so objects meet within their
    frame. Frames with more than ``max_detections`` boxes go through the same
    join with their left side salted, which spreads the pairs of one frame.
    """
    columns = ["frame_id", "det_no", "label", *MASK_BOX, "centroid_x", "centroid_y", "width", "height"]
    rows = detections.where(F.col("label") != "").select(*columns)
    cold, hot = split_hot(rows, ["frame_id"], max_detections, counted)
    found = _related(cold, cold, ["frame_id"])
    if hot is not None:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        salted = hot.withColumn("_salt", F.pmod(F.col("det_no"), F.lit(SALTS)).cast("int"))
        spread = _related(salted, hot.withColumn("_salt", salts), ["frame_id", "_salt"])
        found = found.unionByName(spread)
    order = Window.partitionBy("frame_id").orderBy("place")
    return (
        found.withColumn("relation_no", F.row_number().over(order))
        .where(F.col("relation_no") <= cap)
        .select("frame_id", "from", "relation", "to", F.round("score", 4).alias("score"), "relation_no")
    )


def frame_scenes(
    frames: DataFrame,
    detections: DataFrame,
    relations: DataFrame,
    min_blur: float = config.QUALITY.min_blur,
) -> DataFrame:
    """One row per frame: signals, detected labels, relation keys and its hand.

    frames: frame_id, blur_score. Frames without detections get the signals of
    an empty scene. Detections and relations shrink to one row per frame before
    they meet it.
    """
    center = g.image_center_distance(
        F.col("centroid_x"), F.col("centroid_y"), F.col("width"), F.col("height")
    )
    # Among equally large objects the last one decides.
    largest = F.struct("area", "det_no")
    # The hand of a frame: largest, then most certain, then uncut, then first.
    is_hand = F.col("label") == "hand"
    hand_order = F.struct(
        -F.col("area"), -g.clamp_unit(F.col("confidence")),
        F.col("touches_border").cast("int"), "det_no",
    )
    hand = F.min_by(F.struct("area", *MASK_BOX), F.when(is_hand, hand_order))
    shapes = detections.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("area").alias("_total"),
        F.max("area").alias("_largest"),
        F.max_by(center, largest).alias("_center"),
        F.sum(F.when(is_hand, F.col("area"))).alias("_hand"),
        hand.alias("hand"),
        F.array_sort(F.collect_set(F.when(F.col("label") != "", F.col("label")))).alias("labels"),
    )
    links = relations.groupBy("frame_id").agg(
        F.max(F.col("relation") == "occludes").alias("_occludes"),
        F.collect_list(F.concat_ws("__", "from", "relation", "to")).alias("relation_keys"),
    )
    zero, no_text = F.lit(0.0), F.array().cast("array<string>")
    largest_area = F.coalesce(F.col("_largest"), zero)
    total = F.coalesce(F.col("_total"), zero)
    sharp = F.coalesce(F.col("blur_score"), zero) >= min_blur
    occluded = F.coalesce(F.col("_occludes"), F.lit(False)) | (
        F.coalesce(F.col("_hand"), zero) >= 0.12
    )
    distance = F.coalesce(F.col("_center"), F.lit(1.0))
    return (
        frames.join(shapes, "frame_id", "left")
        .join(links, "frame_id", "left")
        .withColumns(
            {
                "labels": F.coalesce("labels", no_text),
                "relation_keys": F.coalesce("relation_keys", no_text),
                "sharp": sharp,
                "not_blurry": sharp,
                "occluded": occluded,
                "detail_rich": (F.coalesce(F.col("_n"), F.lit(0)) >= 2) | (total >= 0.08),
                "close_up": largest_area >= 0.10,
                "clear_key_region": (largest_area >= 0.03) & (distance <= 0.42) & ~occluded,
                "stable_frame": sharp & ~occluded,
                "main_subject_large": largest_area >= 0.08,
                "tiny_subject": ((largest_area > 0) & (largest_area < 0.02)) | (total < 0.01),
            }
        )
        .drop("_n", "_total", "_largest", "_center", "_hand", "_occludes")
    )


SIGNALS = (
    "clear_key_region", "close_up", "sharp", "not_blurry", "detail_rich", "occluded",
    "stable_frame", "main_subject_large", "tiny_subject",
)


def signal_map(scenes: DataFrame) -> DataFrame:
    """``signals``: MAP of the boolean columns plus has_hand, has_tool, has_<label>."""
    named = F.transform("labels", lambda x: F.concat(F.lit("has_"), F.replace(x, F.lit(" "), F.lit("_"))))
    always = F.array(F.lit("has_hand"), F.lit("has_tool"))
    present = F.map_from_entries(
        F.transform(
            F.array_union(always, named),
            lambda n: F.struct(n, F.array_contains(named, n)),
        )
    )
    fixed = F.create_map(*[part for s in SIGNALS for part in (F.lit(s), F.col(s))])
    return scenes.withColumn("signals", F.map_concat(fixed, present))
