"""IM1 image quality and IM2 blurred regions over image folders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Thresholds of both scans.
MIN_SIDE, BLUR_THRESHOLD = 150, 15.0
GRID, MIN_SCAN_SIDE, MIN_OVERALL = 4, 200, 80.0
MIN_ACTIVE, MIN_MEDIAN, DROP = 6, 150.0, 4.0


def load_images(spark: SparkSession, path: str) -> DataFrame:
    """Every file of the folder; one that cannot be decoded has sides of -1 and no pixels."""
    df = spark.read.format("image").option("dropInvalid", False).load(path)
    return df.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")


def _gray(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).astype(np.float64)
    if channels == 1:
        return pixels[:, :, 0]
    # channel order is blue, green, red; weights of the usual luma
    return np.rint(pixels[:, :, 2] * 0.299 + pixels[:, :, 1] * 0.587 + pixels[:, :, 0] * 0.114)


def _decoded() -> Column:
    return F.col("height") > 0


def laplacian_variance(gray: np.ndarray) -> float:
    if gray.shape[0] < 3 or gray.shape[1] < 3:
        return 0.0
    lap = gray[:-2, 1:-1] + gray[2:, 1:-1] + gray[1:-1, :-2] + gray[1:-1, 2:] - 4 * gray[1:-1, 1:-1]
    return float(np.var(lap))


@F.pandas_udf(T.DoubleType())
def _blur(h: pd.Series, w: pd.Series, c: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([laplacian_variance(_gray(*row)) if row[0] > 0 else None for row in zip(h, w, c, data)], dtype="float64")


def soft_blocks(gray: np.ndarray) -> int:
    """Active grid blocks far below the median sharpness of the page."""
    h, w = gray.shape
    if h < MIN_SCAN_SIDE or w < MIN_SCAN_SIDE or laplacian_variance(gray) < MIN_OVERALL:
        return 0
    sh, sw = h // GRID, w // GRID
    blocks = [gray[r * sh:(r + 1) * sh, c * sw:(c + 1) * sw] for r in range(GRID) for c in range(GRID)]
    active = [laplacian_variance(b) for b in blocks if b.mean() < 240 and b.std() > 15]
    if len(active) < MIN_ACTIVE:
        return 0
    median = float(np.median(active))
    return sum(v < median / DROP for v in active) if median > MIN_MEDIAN else 0


@F.pandas_udf(T.IntegerType())
def _soft(h: pd.Series, w: pd.Series, c: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([soft_blocks(_gray(*row)) if row[0] > 0 else 0 for row in zip(h, w, c, data)], dtype="int32")


def quality_of(images: DataFrame) -> DataFrame:
    """IM1 verdict per file; one that cannot be decoded is an error with a reason of its own."""
    sides = {c: F.when(_decoded(), F.col(c)) for c in ("width", "height")}
    scored = images.withColumn("blur_score", F.round(_blur("height", "width", "nChannels", "data"), 2)).withColumns(sides)
    small = (F.col("width") < MIN_SIDE) | (F.col("height") < MIN_SIDE)
    soft = F.col("blur_score") < BLUR_THRESHOLD
    issues = F.array_compact(F.array(
        F.when(F.col("height").isNull(), "undecodable"),
        F.when(small, F.format_string(f"low_resolution (got %dx%d, min {MIN_SIDE}x{MIN_SIDE})", "width", "height")),
        F.when(soft, F.concat(F.lit("excessive_blur (score "), F.col("blur_score").cast("string"), F.lit(f" < threshold {BLUR_THRESHOLD})"))),
    ))
    return scored.select("origin", "width", "height", "blur_score", issues.alias("issues")).withColumns({
        "is_acceptable": F.size("issues") == 0,
        "status": F.when(F.size("issues") == 0, "acceptable").when(F.col("height").isNull(), "error").otherwise("low_confidence"),
        "reason": F.when(F.col("height").isNull(), "undecodable").when(F.size("issues") > 0, "image_quality"),
    })


def image_quality(spark: SparkSession, path: str) -> DataFrame:
    return quality_of(load_images(spark, path))


def blurred_of(images: DataFrame) -> DataFrame:
    """IM2 findings of decoded images."""
    hit = images.withColumn("_n", _soft("height", "width", "nChannels", "data")).filter("_n >= 1")
    return hit.select(
        "origin", F.lit("blurred_edited_region").alias("signal"), F.lit("visual").alias("category"),
        F.lit(10).alias("score"), F.lit("Blurred edited region detected.").alias("description"),
    )


def blur_findings(spark: SparkSession, path: str) -> DataFrame:
    return blurred_of(load_images(spark, path))
