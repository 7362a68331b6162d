"""When the imagery of a release was taken: metadata answers as JSON columns, and the choice of captures between two dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlane.functions import rules

#: Attributes that are asked for, and the layer of the analysis zoom.
ATTRIBUTES = ("SRC_DATE2", "SRC_DATE", "NICE_DESC", "SRC_DESC", "SAMP_RES")
METADATA_LAYER = 6


def layer_urls(config: DataFrame) -> DataFrame:
    """release_id, layer_url of configuration documents (a column `config` of JSON: release id to an object with its layer's URL)."""
    parsed = F.from_json("config", "map<string,struct<metadataLayerUrl:string>>")
    return config.select(F.explode(parsed).alias("release_id", "v")).select("release_id", F.col("v.metadataLayerUrl").alias("layer_url")).where("layer_url IS NOT NULL").dropDuplicates(["release_id"])


def at_years(points: DataFrame, releases: DataFrame) -> DataFrame:
    """A row per point and yearly release: year, release_id. releases: the catalog's few rows, sent to all tasks as an array."""
    every = F.array(*[F.struct(F.lit(r.year).alias("year"), F.lit(r.release_id).alias("release_id")) for r in releases.select("year", "release_id").orderBy("year").collect()])
    return points.withColumn("_y", F.explode(every)).select(*points.columns, "_y.*")


def query_url(layer_url: Column, lat: Column, lon: Column) -> Column:
    """The request for what covers a point."""
    point = F.url_encode(F.concat(lon.cast("string"), F.lit(","), lat.cast("string")))
    fields = "%2C".join(ATTRIBUTES)
    return F.concat(layer_url, F.lit(f"/{METADATA_LAYER}/query?geometry="), point, F.lit(f"&geometryType=esriGeometryPoint&inSR=4326&spatialRel=esriSpatialRelIntersects&outFields={fields}&returnGeometry=false&f=json"))


def capture(answer: Column) -> Column:
    """struct date, source, resolution_m of the answer's first feature; null without a date. Empty texts and zeros count as absent;
    dates in milliseconds become UTC days, dates in text stay as they are."""
    get = lambda k: F.nullif(F.nullif(F.get_json_object(answer, f"$.features[0].attributes.{k}"), F.lit("")), F.lit("0"))
    raw = F.coalesce(get("SRC_DATE2"), get("SRC_DATE"))
    ms = F.when(F.regexp_like(raw, F.lit(r"^-?[0-9]{9,}(\.[0-9]+)?$")), raw.try_cast("double").cast("long"))
    date = F.coalesce(rules.iso_date(ms), raw)
    return F.when(date.isNotNull(), F.struct(date.alias("date"), F.coalesce(get("NICE_DESC"), get("SRC_DESC")).alias("source"), F.bround(get("SAMP_RES").try_cast("double"), 2).alias("resolution_m")))


def lookup_keys(points: DataFrame) -> DataFrame:
    """One row per release and rounded place: what has to be asked once. points: release_id, lat, lon."""
    return points.select("release_id", F.bround("lat", 3).alias("lat3"), F.bround("lon", 3).alias("lon3"), "lat", "lon").dropDuplicates(["release_id", "lat3", "lon3"])


def captures(points: DataFrame, answers: DataFrame) -> DataFrame:
    """points with capture; answers: release_id, lat3, lon3, answer (null where the service did not answer)."""
    p = points.withColumns({"lat3": F.bround("lat", 3), "lon3": F.bround("lon", 3)})
    return p.join(answers.select("release_id", "lat3", "lon3", capture(F.col("answer")).alias("capture")), ["release_id", "lat3", "lon3"], "left").drop("lat3", "lon3")


def chosen(rows: DataFrame, key: list[str], year_t1: Column, year_t2: Column) -> DataFrame:
    """key, date, year of the captures between two years' own: dated, sharp, strictly between, the earliest year of each date.
    rows: key, year, capture."""
    at = rows.select(*key, "year", F.col("capture.date").alias("date"), F.col("capture.resolution_m").alias("res"), year_t1.alias("y1"), year_t2.alias("y2"))
    ends = at.groupBy(*key).agg(F.max(F.when(F.col("year") == F.col("y1"), F.col("date"))).alias("d1"), F.max(F.when(F.col("year") == F.col("y2"), F.col("date"))).alias("d2"))
    mid = at.join(ends, key).where((F.col("year") > F.col("y1")) & (F.col("year") < F.col("y2")) & rules.good_capture(F.col("date"), F.col("res"), F.col("d1"), F.col("d2")))
    return mid.groupBy(*key, "date").agg(F.min("year").alias("year"))


def same_capture(first: Column, second: Column) -> Column:
    """Whether both dates show one capture."""
    return F.coalesce(first["date"] == second["date"], F.lit(False))


def low_resolution(c: Column) -> Column:
    return F.coalesce(c["resolution_m"] > rules.LOW_RESOLUTION, F.lit(False))
