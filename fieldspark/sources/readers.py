"""Readers and writers of fields: images, text rasters, Parquet."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, path: str, normalise: bool = True) -> DataFrame:
    """(image, i, j, v): mean over the channels, i to the right and j upwards from the lower left corner; with normalise
    each image's values run from 0 to 1 (0 for a flat one)."""
    raw = spark.read.format("image").load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def pixels(batches):
        for pdf in batches:
            for name, h, w, c, data in pdf.itertuples(index=False):
                a = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(float).mean(2)[::-1]
                j, i = np.mgrid[0:h, 0:w]
                yield pd.DataFrame({"image": name, "i": i.ravel(), "j": j.ravel(), "v": a.ravel()})

    grid = raw.mapInPandas(pixels, "image string, i long, j long, v double")
    if not normalise:
        return grid
    box = grid.groupBy("image").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    return grid.join(box, "image").select("image", "i", "j", F.when(F.col("_hi") > F.col("_lo"), (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0).alias("v"))


def write_images(grids: DataFrame, path: str, width: int, height: int) -> None:
    """Grey PNG images of grids (image, i, j, v), v from 0 to 255, one folder image=.. each; gridpoints without a row are 0,
    rows outside the size are left out. An image is one row and so fits a task.

    The bytes go through the text sink, which writes them as they are and ends the file with a line feed that PNG readers
    pass over; so the folder may be anywhere Spark can write.
    """

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((height, width + 1), np.uint8)  # each line starts with its filter, none
        a[height - 1 - pdf["j"].to_numpy(), pdf["i"].to_numpy() + 1] = np.rint(pdf["v"].to_numpy(float)).clip(0, 255)
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(a.tobytes())) + chunk(b"IEND", b"")
        return pd.DataFrame({"image": pdf["image"].iloc[:1], "png": [png]})

    kind = dict(grids.dtypes)["image"]
    inside = grids.where((F.col("i") >= 0) & (F.col("i") < width) & (F.col("j") >= 0) & (F.col("j") < height)).select("image", "i", "j", "v")
    drawn = inside.groupBy("image").applyInPandas(draw, f"image {kind}, png binary")
    drawn.select("image", F.col("png").cast("string").alias("value")).write.partitionBy("image").text(path)


def image_box(width: int, height: int, y_lo: float, y_hi: float) -> tuple[tuple[float, float], tuple[float, float]]:
    """Corners of an image stretched to a y-range, with x scaled by the aspect ratio from 0."""
    return (0.0, y_lo), ((y_hi - y_lo) * width / height, y_hi)


def raster_text(text: DataFrame, column: str, ny: int) -> DataFrame:
    """(.., i, j, v) from rows whose `column` holds white-space separated numbers of an [nx, ny] raster, y descending."""
    keep = [c for c in text.columns if c != column]
    rows = text.select(*keep, F.posexplode(F.split(F.regexp_replace(column, r"^\s+|\s+$", ""), r"\s+")).alias("_n", "_t"))
    return rows.select(*keep, F.floor(F.col("_n") / ny).alias("i"), (F.lit(ny - 1) - F.col("_n") % ny).cast("long").alias("j"), F.col("_t").cast("double").alias("v"))


def read_raster(spark: SparkSession, path: str, ny: int) -> DataFrame:
    """(i, j, v) of a text raster file."""
    return raster_text(spark.read.text(path, wholetext=True), "value", ny)


def write_field(grid: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet sink, partitioned by grid id or cell columns."""
    writer = grid.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)
