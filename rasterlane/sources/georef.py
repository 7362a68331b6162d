"""Georeferences of images: GeoTIFF tags, world files with their sidecars, and bounds given by hand, as columns."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlane.functions import crs, geo, projection
from rasterlane.sources import wkt
from rasterlane.sources.shared import written

#: Sidecar extensions in order of precedence, tag codes and key numbers.
WORLD_EXTENSIONS = ("jgw", "jpgw", "tfw", "tifw", "pgw", "pngw", "wld")
TAGS = {33550: "scale", 33922: "tie", 34264: "matrix", 34735: "keys"}
RASTER_TYPE, GEOGRAPHIC, PROJECTED, PIXEL_IS_POINT, USER_DEFINED = 1025, 2048, 3072, 2, 32767


def world_file(text: Column) -> Column:
    """The transform by pixel corners of a world file's six numbers; null if they are not six numbers."""
    n = F.transform(F.slice(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), 1, 6), lambda v: v.try_cast("double"))
    a, d, b, e, c, f = (F.try_element_at(n, F.lit(i)) for i in range(1, 7))
    whole = (F.size(n) == 6) & F.forall(n, lambda v: v.isNotNull())
    return F.when(whole, geo.corner_from_centre(geo.affine(a, b, c, d, e, f)))


def geo_keys(flat: Column) -> Column:
    """Map of key number to value of a flat directory: header of four, then key, location, count, value; only values in place."""
    entries = F.transform(F.sequence(F.lit(0), F.element_at(flat, 4) - 1), lambda i: F.slice(flat, 5 + 4 * i, 4))
    here = F.filter(F.when(F.element_at(flat, 4) > 0, entries).otherwise(F.array().cast("array<array<int>>")), lambda x: F.element_at(x, 2) == 0)
    return F.map_from_entries(F.transform(here, lambda x: F.struct(F.element_at(x, 1), F.element_at(x, 4))))


def tiff_transform(scale: Column, tie: Column, matrix: Column, keys: Column) -> Column:
    """A matrix wins over scale and tie point; null without either. Pixel-is-point images move by half a pixel."""
    m, at = (lambda i: F.try_element_at(matrix, F.lit(i))), (lambda a, i: F.try_element_at(a, F.lit(i)))
    sx, sy = at(scale, 1), at(scale, 2)
    plain = geo.affine(sx, F.lit(0.0), at(tie, 4) - at(tie, 1) * sx, F.lit(0.0), -sy, at(tie, 5) + at(tie, 2) * sy)
    t = F.when(matrix.isNotNull(), geo.affine(m(1), m(2), m(4), m(5), m(6), m(8))).when(scale.isNotNull() & tie.isNotNull(), plain)
    return F.when(F.coalesce(F.try_element_at(keys, F.lit(RASTER_TYPE)) == PIXEL_IS_POINT, F.lit(False)), geo.corner_from_centre(t)).otherwise(t)


def tiff_epsg(keys: Column, given: Column) -> Column:
    """The code given, else the projected key's, else the geographic key's; null where that is absent or user-defined."""
    key = lambda k: F.nullif(F.try_element_at(keys, F.lit(k)), F.lit(0))
    code = F.coalesce(key(PROJECTED), key(GEOGRAPHIC))
    return F.coalesce(given, F.nullif(code, F.lit(USER_DEFINED)))


_TAG_TYPE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("scale", "tie", "matrix")], T.StructField("keys", T.ArrayType(T.IntegerType()))])


def _tags(data: bytes) -> dict:
    """The tags of the first directory; nothing for other files."""
    out = dict.fromkeys(("width", "height", "scale", "tie", "matrix", "keys"))
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        return out
    try:
        at = struct.unpack_from(order + "I", data, 4)[0]
        for i in range(struct.unpack_from(order + "H", data, at)[0]):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            name = {256: "width", 257: "height"}.get(tag) or TAGS.get(tag)
            code = {3: "H", 4: "I", 12: "d"}.get(kind)
            if name and code:
                size = count * struct.calcsize(code)
                where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
                values = list(struct.unpack_from(f"{order}{count}{code}", data, where))
                out[name] = values[0] if name in ("width", "height") else [int(v) if name == "keys" else float(v) for v in values]
    except struct.error:
        pass
    return out


@F.pandas_udf(_TAG_TYPE)
def tiff_tags(content: pd.Series) -> pd.DataFrame:
    """Size and georeferencing tags of TIFF files' bytes."""
    return pd.DataFrame([_tags(c or b"") for c in content], columns=_TAG_TYPE.names)


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def sidecars(files: DataFrame) -> DataFrame:
    """stem, world (text of the first world file by precedence, lower case before upper), prj. files: path, content."""
    f = files.select(stem(F.col("path")).alias("stem"), extension(F.col("path")).alias("x"), F.col("content").cast("string").alias("text"))
    names = [n for e in WORLD_EXTENSIONS for n in (e, e.upper())]
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("x"))
    return f.groupBy("stem").agg(F.min_by("text", F.when(rank > 0, rank)).alias("world"), F.max(F.when(F.col("x") == "prj", F.trim("text"))).alias("prj"))


def georeferences(images: DataFrame, files: DataFrame) -> DataFrame:
    """images (path, content, epsg given or null, width, height) with transform, epsg, source, error, bounds, gsd_m.

    TIFF tags come first, then a world file, whose system is that given, that of the .prj (WKT, PROJ string or code), or degrees where
    the numbers can be such. What has no usable system gets an error. `system` is the struct of `functions.crs`."""
    i = images.withColumn("stem", stem(F.col("path"))).withColumn("tags", F.when(F.lower(extension(F.col("path"))).isin("tif", "tiff"), tiff_tags("content")))
    i = i.join(sidecars(files), "stem", "left")
    keys = F.when(F.col("tags.keys").isNotNull(), geo_keys(F.col("tags.keys"))).otherwise(F.create_map().cast("map<int,int>"))
    i = i.withColumn("keys", keys).withColumn("from_tiff", tiff_transform(F.col("tags.scale"), F.col("tags.tie"), F.col("tags.matrix"), F.col("keys"))).withColumn("from_world", world_file(F.col("world")))
    tiff, world = F.col("from_tiff").isNotNull(), F.col("world").isNotNull()
    degrees = (F.abs("from_world.c") <= 180) & (F.abs("from_world.f") <= 90)
    i = i.withColumn("read", F.when(~tiff & F.col("epsg").isNull(), wkt.system_of(F.col("prj"))))
    ending = F.regexp_extract("prj", r'(?i)EPSG["\s:,]+([0-9]{4,5})[^0-9]*$', 1).try_cast("int")  # of a text that is otherwise not understood
    code = F.when(tiff, tiff_epsg(F.col("keys"), F.col("epsg"))).when(world, F.coalesce(F.col("epsg"), F.when(F.col("prj").isNull(), F.when(degrees, 4326)).when(F.col("read").isNull(), ending)))
    i = i.withColumn("transform", F.coalesce("from_tiff", "from_world")).withColumn("code", code)
    i = i.withColumn("system", F.when(F.col("code").isNull(), F.col("read")).otherwise(crs.from_epsg(F.col("code"))))
    error = F.when(F.col("transform").isNull() & world, "world_file").when(F.col("transform").isNotNull() & F.col("system").isNull(), F.when(F.col("code").isNull(), "crs_unknown").otherwise("crs_unsupported"))
    i = i.withColumn("error", error).withColumn("transform", F.when(F.col("error").isNull(), F.col("transform")))
    i = i.withColumn("is_tiff", tiff).drop("stem", "tags", "keys", "from_tiff", "from_world", "world", "prj", "content", "epsg", "read")
    i, _ = written(i, "georef")  # the projections below name the transform many times: it is not worked out anew each time
    source = F.when(F.col("transform").isNotNull(), F.when(F.col("is_tiff"), "geotiff").otherwise("worldfile"))
    place = (F.col("transform"), F.col("width"), F.col("height"), F.col("system"))
    number = F.coalesce("code", "system.epsg")
    name = F.coalesce(F.concat(F.lit("EPSG:"), number.cast("string")), "system.name")
    return i.select(*[c for c in images.columns if c not in ("epsg", "content")], "transform", number.alias("epsg"), source.alias("source"), "error", crs.image_bounds(*place).alias("bounds"), crs.image_gsd(*place).alias("gsd_m"), name.alias("crs_name"), "system")


def pair_reference(pairs: DataFrame, least: float = 0.9) -> DataFrame:
    """pairs: transform1, epsg1, w1, h1 and the same with 2; either transform may be null. Adds transform, epsg and error: the later
    date's reference wins, the earlier one's is resampled to the later image; boxes that overlap too little are an error."""
    t = lambda k: (F.col(f"transform{k}"), F.col(f"w{k}"), F.col(f"h{k}"), F.col(f"epsg{k}"))
    overlap = geo.bounds_overlap(projection.image_bounds(*t(1)), projection.image_bounds(*t(2)))
    both = F.col("transform1").isNotNull() & F.col("transform2").isNotNull()
    own = F.col("transform2").isNotNull()
    resized = geo.resampled(F.col("transform1"), F.col("w1"), F.col("h1"), F.col("w2"), F.col("h2"))
    error = F.when(both & (overlap < least), "different_area")
    ok = lambda v: F.when(error.isNull(), v)
    return pairs.select("*", ok(F.when(own, F.col("transform2")).when(F.col("transform1").isNotNull(), resized)).alias("transform"), ok(F.when(own, F.col("epsg2")).otherwise(F.col("epsg1"))).alias("epsg"), error.alias("error"))


def epsg_code(text: Column) -> Column:
    """struct code, error of a code given as text, with or without its `EPSG:`; null text gives neither."""
    code = F.regexp_extract(text, r"^\s*(?i:EPSG:)?\s*([0-9]{1,6})\s*$", 1).try_cast("int")
    error = F.when(code.isNull(), "epsg_invalid").when(~projection.supported(code), "epsg_unsupported")
    return F.when(text.isNotNull(), F.struct(F.when(error.isNull(), code).alias("code"), error.alias("error")))


def summary(source: Column, epsg: Column, gsd_m: Column, bounds: Column) -> Column:
    """What a georeference is shown as: source, label of its system, gsd and bounds."""
    return F.struct(source.alias("source"), F.concat(F.lit("EPSG:"), epsg.cast("string")).alias("crs"), F.bround(gsd_m, 3).alias("gsd_m"), F.array(*[F.bround(bounds[k], 7) for k in "swne"]).alias("bounds"))
