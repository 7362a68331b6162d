"""Images as rows scene, epoch, h, w, bands, data (uint8, RGB, row by row)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlane.operators import kernels
from rasterlane.operators.percentiles import percentiles
from rasterlane.sources import georef, jpeg, tiff

#: Names but those of TIFF files, which the image reader must not meet: it fails on damaged ones.
NOT_TIFF = "{*[!fF],*.[gG][iI][fF],*.[jJ][fF][iI][fF]}"


@F.pandas_udf(T.BinaryType())
def _rgb(data: pd.Series, h: pd.Series, w: pd.Series, bands: pd.Series) -> pd.Series:
    """The image reader's bytes (one band, BGR or BGRA) as RGB."""
    def one(d, h, w, n):
        x = np.frombuffer(d, np.uint8).reshape(h, w, n)
        return np.ascontiguousarray(np.repeat(x, 3, 2) if n == 1 else x[:, :, 2::-1]).tobytes()

    return pd.Series([one(*v) for v in zip(data, h, w, bands)])


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, h, w, bands, data of PNG, JPEG and TIFF files; files that are no image are left out."""
    i = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", NOT_TIFF).load(path).select("image.*")
    plain = i.select(F.col("origin").alias("path"), F.col("height").alias("h"), F.col("width").alias("w"), F.lit(3).alias("bands"), _rgb("data", "height", "width", "nChannels").alias("data"))
    return plain.unionByName(tiff.read(spark, path))


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height of PNG, JPEG and TIFF files, by headers and tags; no pixel is decoded. Files that are no image are left out."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kind = F.lower(georef.extension(F.col("path"))).isin("tif", "tiff")
    tagged = files.where(kind).select("path", georef.tiff_tags("content").alias("t")).select("path", "t.width", "t.height")
    other = files.where(~kind).select("path", jpeg.header_size(F.col("content")).alias("s")).select("path", "s.width", "s.height")
    return other.where("width IS NOT NULL").unionByName(tagged)


def resized(images: DataFrame, h: Column, w: Column, how: str) -> DataFrame:
    """images in another size: area, cubic, linear or nearest."""
    @F.pandas_udf(T.BinaryType())
    def run(data: pd.Series, h0: pd.Series, w0: pd.Series, n: pd.Series, h1: pd.Series, w1: pd.Series) -> pd.Series:
        return pd.Series([d if (a, b) == (y, x) else kernels.resized(np.frombuffer(d, np.uint8).reshape(a, b, k), y, x, how).tobytes() for d, a, b, k, y, x in zip(data, h0, w0, n, h1, w1)])

    return images.withColumns({"_h": h.cast("int"), "_w": w.cast("int")}).withColumn("data", run("data", "h", "w", "bands", "_h", "_w")).withColumns({"h": F.col("_h"), "w": F.col("_w")}).drop("_h", "_w")


def same_size(images: DataFrame, classic: bool = False) -> DataFrame:
    """Both dates of a scene in one size: that of the later date, by area; for the pixel-difference engine the larger of each side."""
    by = images.groupBy("scene").agg(*([F.max("h").alias("_y"), F.max("w").alias("_x")] if classic else [F.max_by("h", "epoch").alias("_y"), F.max_by("w", "epoch").alias("_x")]))
    return resized(images.join(by, "scene"), F.col("_y"), F.col("_x"), "linear" if classic else "area").drop("_y", "_x")


def scaled(images: DataFrame, scale: Column) -> DataFrame:
    """images by a factor: area when it shrinks, cubic when it grows."""
    side = lambda c: F.greatest(F.lit(1), F.bround(F.col(c) * scale)).cast("int")
    s = images.withColumn("_s", scale)
    return resized(s.where("_s <= 1"), side("h"), side("w"), "area").unionByName(resized(s.where("_s > 1"), side("h"), side("w"), "cubic")).drop("_s")


def stretched(cells: DataFrame) -> DataFrame:
    """scene, epoch, r, c, band, v (0 to 255) of cells with more than 8 bits: between the 2nd and 98th percentile of their image."""
    lim = percentiles(cells, ["scene", "epoch"], "v", [0.02, 0.98, 1.0]).select("scene", "epoch", "q", F.col("q")[2].alias("top"))
    wide = (F.col("v") - F.col("q")[0]) / F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(1e-6)) * 255
    value = F.when(F.col("top") > 255, wide).otherwise(F.col("v"))
    return cells.join(lim, ["scene", "epoch"]).select("scene", "epoch", "r", "c", "band", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), value))).cast("int").alias("v"))


def overlay(labels: DataFrame, colours: DataFrame) -> DataFrame:
    """scene, r, c, rgba of label cells (scene, r, c, type); colours: type, rgba."""
    return labels.join(F.broadcast(colours), "type").select("scene", "r", "c", "rgba")  # four rows


#: The overlay's colour of each type.
RGBA = {"new": (16, 185, 129, 210), "demolished": (239, 68, 68, 210), "existing": (100, 116, 139, 140), "rebuilt": (245, 158, 11, 210)}


def colours(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, list(v)) for t, v in RGBA.items()], "type string, rgba array<int>")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def heat_rgba(heat: pd.Series) -> pd.Series:
    """Colour and transparency of change heat, 0 to 1."""
    v = heat.to_numpy(float)
    return pd.Series(np.concatenate([kernels.jet(v), (v * 190).astype(np.uint8)[:, None]], 1).astype(int).tolist())


def png(width: int, rgba: bytes) -> bytes:
    """A PNG of RGBA rows."""
    import struct
    import zlib

    rows = [b"\0" + rgba[i : i + 4 * width] for i in range(0, len(rgba), 4 * width)]
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(rows))) + part(b"IEND", b"")


@F.pandas_udf(T.BinaryType())
def png_of(width: pd.Series, rgba: pd.Series) -> pd.Series:
    """PNG files of RGBA bytes."""
    return pd.Series([png(w, d) for w, d in zip(width, rgba)])


@F.pandas_udf(T.BinaryType())
def _opaque(data: pd.Series) -> pd.Series:
    """RGB bytes as RGBA."""
    return pd.Series([np.insert(np.frombuffer(d, np.uint8).reshape(-1, 3), 3, 255, 1).tobytes() for d in data])


def previews(images: DataFrame, most: int = 2048, kind: str = "png") -> DataFrame:
    """images (RGB) with a column preview, a data URI of a PNG or JPEG (quality 90), whose longer side has `most` cells at most."""
    small = scaled(images, F.least(F.lit(1.0), F.lit(most) / F.greatest("h", "w")))
    file = png_of("w", _opaque("data")) if kind == "png" else jpeg.jpeg_of("h", "w", "data")
    return small.withColumn("preview", F.concat(F.lit(f"data:image/{kind};base64,"), F.base64(file)))
