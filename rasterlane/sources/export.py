"""GeoJSON and CSV of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of the CSV, and those it has after a timeline ran.
CSV_COLUMNS = {"id": "Bina_ID", "type": "Degisim_Turu", "type_tr": "Degisim_Tanimi", "area_m2": "Alan_m2", "perimeter_m": "Cevre_m", "confidence_pct": "Guven_Skoru_Yuzde", "lat": "Enlem", "lon": "Boylam", "px_x": "Piksel_X", "px_y": "Piksel_Y"}
PERIOD_COLUMNS = {"from": "Degisim_Donemi_Baslangic", "to": "Degisim_Donemi_Bitis"}


def features(records: DataFrame, geometry: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """One JSON feature a record, nulls kept; geometry: rings as array<array<array<double>>>."""
    shape = F.struct(F.lit("Polygon").alias("type"), (F.array().cast("array<array<array<double>>>") if geometry is None else geometry).alias("coordinates"))
    return records.select(*keys, "id", F.struct(F.lit("Feature").alias("type"), "id", F.struct(*records.columns).alias("properties"), shape.alias("geometry")).alias("feature"))


def geojson(records: DataFrame, geometry: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """One feature collection a row for each value of `keys`, or one in all: for the records of a patch, which a viewer loads
    whole. Larger results go to write_geojson_lines."""
    all_ = F.transform(F.sort_array(F.collect_list(F.struct("id", "feature"))), lambda x: x["feature"])
    whole = F.struct(F.lit("FeatureCollection").alias("type"), F.lit(geometry is not None).alias("georeferenced"), all_.alias("features"))
    return features(records, geometry, keys).groupBy(*keys).agg(F.to_json(whole, {"ignoreNullFields": "false", "pretty": "true"}).alias("geojson"))


def write_geojson_lines(records: DataFrame, path: str, geometry: Column | None = None) -> None:
    """A feature a line, in as many files as there are partitions."""
    features(records, geometry).select(F.to_json("feature", {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def csv_rows(records: DataFrame) -> DataFrame:
    """The CSV's columns as text; what a record lacks or holds as null is empty."""
    names = CSV_COLUMNS | (PERIOD_COLUMNS if "from" in records.columns else {})
    return records.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in records.columns else F.lit("")).alias(n) for c, n in names.items()])


def write_csv(records: DataFrame, path: str) -> None:
    """CSV files with line ends of CR and LF; the first file holds the header, so that all in order are one document."""
    rows = csv_rows(records)
    header = records.sparkSession.createDataFrame([(",".join(rows.columns),)], "value string")
    header.union(rows.select(F.to_csv(F.struct(*rows.columns), {"emptyValue": ""}).alias("value"))).write.mode("overwrite").option("lineSep", "\r\n").text(path)
