"""Image dimensions and pixel statistics over Spark's image struct."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CHANNELS = ("r", "g", "b")
STATS = ["mean", "std"] + [f"{kind}_{c}" for kind in ("mean", "std") for c in _CHANNELS]


def image_dims(df: DataFrame, image: str = "image") -> DataFrame:
    """origin, width, height and the three channels of the RGB form."""
    return df.select(
        F.col(f"{image}.origin").alias("origin"),
        F.col(f"{image}.width").cast("bigint").alias("width"),
        F.col(f"{image}.height").cast("bigint").alias("height"),
        F.lit(3).cast("bigint").alias("channels"),
    )


def _rgb(data: bytes, channels: int) -> np.ndarray:
    """Pixels x (r, g, b) in 0..1; the struct stores blue first, grey counts for all three."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(-1, channels)
    rgb = np.repeat(pixels, 3, axis=1) if channels == 1 else pixels[:, 2::-1]
    return rgb / 255.0


def image_stats(df: DataFrame, image: str = "image") -> DataFrame:
    """origin, mean and standard deviation of all pixels and of every channel."""
    raw = df.select(
        F.col(f"{image}.origin").alias("origin"), F.col(f"{image}.nChannels").alias("channels"),
        F.col(f"{image}.data").alias("data"))

    def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for origin, channels, data in batch.itertuples(index=False, name=None):
                rgb = _rgb(data, channels)
                rows.append((origin, rgb.mean(), rgb.std(), *rgb.mean(axis=0), *rgb.std(axis=0)))
            yield pd.DataFrame(rows, columns=["origin", *STATS])

    return raw.mapInPandas(stats, "origin string, " + ", ".join(f"{s} double" for s in STATS))


def dataset_mean_std(df: DataFrame, k: int = 64, image: str = "image") -> DataFrame:
    """Mean of the per-image channel means and deviations over at most ``k`` drawn images.

    Origins alone are drawn (an origin names one image); the images themselves are picked where they are.
    """
    origin = F.col(f"{image}.origin")
    drawn = df.select(origin.alias("_drawn")).orderBy(F.md5("_drawn"), "_drawn").limit(k)
    picked = df.join(F.broadcast(drawn), origin.eqNullSafe(F.col("_drawn")), "left_semi")  # k short names
    return image_stats(picked, image).agg(
        F.count(F.lit(1)).alias("images"), *[F.avg(s).alias(s) for s in STATS if "_" in s])
