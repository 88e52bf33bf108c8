"""Frame images: reading, and one measuring pass over their pixels."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgraph.functions.vectors import pack64
from reelgraph.operators.ranking import first_row

FEATURES = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("image_width", "image_height")]
    + [
        T.StructField(n, T.DoubleType())
        for n in (
            "blur_score", "mean_brightness", "dark_ratio", "bright_ratio", "center_contrast",
        )
    ]
    + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("histogram", "phash_block")]
)

# --- fixed values -----------------------------------------------------------
DARK_BELOW, BRIGHT_ABOVE = 20, 245
HSV_BINS = (8, 4, 4)
HASH_SIDE, HASH_BLOCK = 32, 8
# --- end of fixed values ----------------------------------------------------

#: Measures that leave Python at once; a batch of an Arrow stream may hold 10 000 images.
MEASURED_ROWS = 256


def read_frame_images(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Images below several roots: object_key and the pixel struct ``image``.

    An object found under several roots is taken from the first of them.
    Undecodable files are dropped by the image reader.
    """
    found = None
    for priority, root in enumerate(roots):
        images = (
            spark.read.format("image")
            .option("dropInvalid", True)
            .option("recursiveFileLookup", True)
            .load(root)
        )
        key = F.regexp_replace("image.origin", "^.*?" + re.escape(root.rstrip("/")) + "/", "")
        part = images.select(key.alias("object_key"), F.lit(priority).alias("_root"), "image")
        found = part if found is None else found.unionByName(part)
    if len(roots) == 1:
        return found.drop("_root")
    # Choose by key first, so pixels are not part of the choice.
    best = first_row(found.select("object_key", "_root"), ["object_key"], F.col("_root"))
    return found.join(best, ["object_key", "_root"], "left_semi").drop("_root")


def _gray(bgr: np.ndarray) -> np.ndarray:
    b, g, r = (bgr[..., i].astype(np.int64) for i in range(3))
    return (r * 4899 + g * 9617 + b * 1868 + 8192) >> 14


def _laplacian_variance(gray: np.ndarray) -> float:
    # Borders mirror without repeating the edge row.
    p = np.pad(gray, 1, mode="reflect")
    around = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]
    return float((around - 4 * gray).var())


def _hsv_histogram(bgr: np.ndarray) -> np.ndarray:
    b, g, r = (bgr[..., i].astype(np.float64) for i in range(3))
    value, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    spread = value - low
    safe = np.where(spread == 0, 1, spread)
    hue = np.where(
        value == r, (g - b) / safe, np.where(value == g, 2 + (b - r) / safe, 4 + (r - g) / safe)
    )
    hue = np.rint(np.where(spread == 0, 0, hue * 30)) % 180
    saturation = np.rint(np.where(value == 0, 0, spread * 255 / np.where(value == 0, 1, value)))
    samples = np.stack([hue.ravel(), saturation.ravel(), value.ravel()], axis=1)
    counts, _ = np.histogramdd(samples, bins=HSV_BINS, range=((0, 180), (0, 256), (0, 256)))
    norm = np.sqrt((counts**2).sum())
    return (counts / norm if norm else counts).ravel()


@lru_cache(maxsize=64)
def _resize_weights(size: int) -> np.ndarray:
    """Antialiased bicubic weights from ``size`` samples to HASH_SIDE."""
    scale = size / HASH_SIDE
    reach = max(scale, 1.0)
    centers = (np.arange(HASH_SIDE) + 0.5) * scale
    x = np.abs((np.arange(size)[None, :] + 0.5 - centers[:, None]) / reach)
    near = 1.5 * x**3 - 2.5 * x**2 + 1
    far = -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2
    weights = np.where(x < 1, near, np.where(x < 2, far, 0.0))
    return weights / weights.sum(axis=1, keepdims=True)


@lru_cache(maxsize=1)
def _dct_rows() -> np.ndarray:
    n = HASH_SIDE
    k, i = np.arange(HASH_BLOCK)[:, None], np.arange(n)[None, :]
    rows = np.cos(np.pi * (2 * i + 1) * k / (2 * n)) * np.sqrt(2 / n)
    rows[0] /= np.sqrt(2)
    return rows


def _hash_block(bgr: np.ndarray) -> np.ndarray:
    b, g, r = (bgr[..., i].astype(np.int64) for i in range(3))
    gray = ((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16).astype(float)
    wide = np.clip(np.rint(gray @ _resize_weights(gray.shape[1]).T), 0, 255)
    small = np.clip(np.rint(_resize_weights(gray.shape[0]) @ wide), 0, 255)
    return (_dct_rows() @ small @ _dct_rows().T).ravel()


def _center_contrast(gray: np.ndarray) -> float:
    h, w = gray.shape
    mh, mw = max(1, h // 4), max(1, w // 4)
    inside = np.zeros(gray.shape, dtype=bool)
    inside[mh : h - mh, mw : w - mw] = True
    center = gray[inside] if inside.any() else gray
    border = gray[~inside] if not inside.all() else gray
    return float(abs(center.mean() - border.mean()) / 255.0)


def _measure(height: int, width: int, channels: int, data: bytes) -> tuple:
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    bgr = np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[..., :3]
    gray = _gray(bgr)
    return (
        width, height, _laplacian_variance(gray), float(gray.mean()),
        float((gray < DARK_BELOW).mean()), float((gray > BRIGHT_ABOVE).mean()),
        _center_contrast(gray), _hsv_histogram(bgr).tolist(), _hash_block(bgr).tolist(),
    )


@F.pandas_udf(FEATURES)
def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = FEATURES.fieldNames()
    for images in batches:
        for first in range(0, len(images), MEASURED_ROWS):
            some = images.iloc[first : first + MEASURED_ROWS]
            rows = [
                _measure(int(h), int(w), int(c), d)
                for h, w, c, d in zip(some["height"], some["width"], some["nChannels"], some["data"])
            ]
            yield pd.DataFrame(rows, columns=names)


def image_features(images: DataFrame, image: str = "image") -> DataFrame:
    """Replace the pixel struct by quality measures, colour histogram and hash
    block, all in one pass. Only features leave this step, never pixels."""
    struct = F.struct(*[F.col(f"{image}.{c}").alias(c) for c in ("height", "width", "nChannels", "data")])
    measured = images.withColumn("_f", _features(struct)).drop(image)
    rest = [c for c in measured.columns if c != "_f"]
    return (
        measured.select(*rest, "_f.*")
        .withColumn("phash", pack64(F.col("phash_block")))
        .drop("phash_block")
    )
