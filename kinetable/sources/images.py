"""Images as pixel rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files decoded by Spark: ``path, height, width, channels, pixels`` with interleaved RGB bytes.

    The decoder gives blue first; the bytes are turned around in Arrow batches.
    """
    rows = spark.read.format("image").option("dropInvalid", "true").load(path)
    flat = rows.select(
        F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))

    def reverse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["pixels"] = [_rgb(p, c) for p, c in zip(pdf["pixels"], pdf["channels"])]
            yield pdf

    return flat.mapInPandas(reverse, flat.schema)


def _rgb(data: bytes, channels: int) -> bytes:
    if channels < 3:
        return bytes(data)
    pixels = np.frombuffer(data, np.uint8).reshape(-1, channels).copy()
    pixels[:, :3] = pixels[:, 2::-1]
    return pixels.tobytes()


def scaled_pixels(images: DataFrame, channel_first: bool = True) -> DataFrame:
    """Pixels as 32-bit floats in [0, 1], channel planes first or interleaved."""
    kept = [c for c in images.columns if c != "pixels"]
    schema = T.StructType([*images.select(*kept).schema.fields, T.StructField("values", T.ArrayType(T.FloatType()))])

    def scale(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = []
            for p, h, w, c in zip(pdf["pixels"], pdf["height"], pdf["width"], pdf["channels"]):
                cube = np.frombuffer(p, np.uint8).reshape(h, w, c).astype(np.float32) / np.float32(255)
                values.append((cube.transpose(2, 0, 1) if channel_first else cube).ravel())
            yield pdf[kept].assign(values=values)

    return images.mapInPandas(scale, schema)
