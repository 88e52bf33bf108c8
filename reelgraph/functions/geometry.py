"""Quality, box and object measures: Column in, Column out.

A box is any struct-like set of four columns x1, y1, x2, y2; ``Box`` groups
them so that formulas read like the definitions.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelgraph import config


def clamp_unit(value: Column) -> Column:
    """Clamp a value that is never NULL: one mention keeps formulas small, as
    they nest and generated code must stay within what the JVM compiles."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, source: Column | str, prefix: str = "") -> "Box":
        """Columns of a struct column, or plain columns with a name prefix."""
        if isinstance(source, str):
            return cls(*[F.col(f"{source}{name}") for name in ("x1", "y1", "x2", "y2")])
        return cls(*[source[f"{prefix}{name}"] for name in ("x1", "y1", "x2", "y2")])


def quality_score(blur: Column, brightness: Column, dark: Column, bright: Column) -> Column:
    blur, brightness = F.coalesce(blur, F.lit(0.0)), F.coalesce(brightness, F.lit(0.0))
    dark, bright = F.coalesce(dark, F.lit(0.0)), F.coalesce(bright, F.lit(0.0))
    sharpness = clamp_unit(blur / 200.0)
    light = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(brightness - 128.0) / 128.0)
    exposure = F.lit(1.0) - F.greatest(dark, bright)
    return clamp_unit(sharpness * 0.6 + light * 0.3 + exposure * 0.1)


def box_area(box: Box) -> Column:
    return (box.x2 - box.x1) * (box.y2 - box.y1)


def box_area_ratio(box: Box, width: Column, height: Column) -> Column:
    w = F.greatest(F.lit(0.0), box.x2 - box.x1)
    h = F.greatest(F.lit(0.0), box.y2 - box.y1)
    return clamp_unit(w * h / (width * height).cast("double"))


def box_center(box: Box) -> tuple[Column, Column]:
    return (box.x1 + box.x2) / 2.0, (box.y1 + box.y2) / 2.0


def touches_border(box: Box, width: Column, height: Column, margin: float = 0.0) -> Column:
    mx, my = width * margin, height * margin
    return (
        (box.x1 <= mx) | (box.y1 <= my) | (box.x2 >= width - mx) | (box.y2 >= height - my)
    )


def _intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def overlap_ratio(a: Box, b: Box) -> Column:
    """Intersection over the smaller box (not over the union)."""
    smaller = F.greatest(F.lit(1.0), F.least(box_area(a), box_area(b)))
    return clamp_unit(_intersection(a, b) / smaller)


def target_overlap_ratio(cover: Box, target: Box) -> Column:
    return clamp_unit(_intersection(cover, target) / F.greatest(F.lit(1.0), box_area(target)))


def center_distance(
    ax: Column, ay: Column, bx: Column, by: Column, width: Column, height: Column
) -> Column:
    dx, dy = (ax - bx) / width, (ay - by) / height
    return F.sqrt(dx * dx + dy * dy)


def image_center_distance(cx: Column, cy: Column, width: Column, height: Column) -> Column:
    return center_distance(cx, cy, width / 2.0, height / 2.0, width, height)


def ideal_area(frame_type: Column, areas: Mapping[str, float] = config.IDEAL_AREA) -> Column:
    chain = F
    for name, area in areas.items():
        chain = chain.when(frame_type == name, F.lit(area))
    return chain.otherwise(F.lit(config.IDEAL_AREA_DEFAULT))


def object_quality(
    confidence: Column,
    area: Column,
    center: Column,
    border: Column,
    ideal: Column,
) -> Column:
    """Blend of confidence, how close the area is to the ideal one, closeness
    to the image centre (``center`` is that distance) and being uncut."""
    area_score = clamp_unit(F.lit(1.0) - F.abs(area - ideal) / ideal)
    center_score = clamp_unit(F.lit(1.0) - center / 0.75)
    border_score = F.when(border, F.lit(0.75)).otherwise(F.lit(1.0))
    return clamp_unit(
        F.lit(0.45) * clamp_unit(confidence)
        + F.lit(0.30) * area_score
        + F.lit(0.15) * center_score
        + F.lit(0.10) * border_score
    )


def pair_spatial(
    overlap: Column, distance: Column, left_quality: Column, right_quality: Column, related: Column
) -> Column:
    proximity = F.greatest(overlap, F.greatest(F.lit(0.0), F.lit(1.0) - distance))
    score = F.lit(0.65) * proximity + F.lit(0.35) * F.least(left_quality, right_quality)
    return clamp_unit(F.when(related, score + 0.10).otherwise(score))


def visibility(
    has_hand: Column, hand_area: Column, max_overlap: Column, occluded: Column
) -> Column:
    free = F.when(occluded, F.lit(0.85)).otherwise(F.lit(1.0))
    covered = F.lit(1.0) - F.lit(0.75) * max_overlap - F.lit(0.25) * clamp_unit(hand_area / 0.12)
    covered = F.when(occluded, F.least(covered, F.lit(0.35))).otherwise(covered)
    return F.when(has_hand, clamp_unit(covered)).otherwise(free)
