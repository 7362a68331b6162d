"""Catalogs of releases and places, and scans of release lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Yearly releases (id and date) and places with their zoom, grid, years and description.
RELEASES = [
    ("2014", "5844", "2014-12-30", "2014 (Geçmiş Durum)"), ("2016", "18966", "2016-12-20", "2016"), ("2018", "23448", "2018-12-14", "2018"), ("2020", "29260", "2020-12-16", "2020"),
    ("2022", "45134", "2022-12-14", "2022"), ("2024", "16453", "2024-12-12", "2024"), ("2026", "26334", "2026-08-05", "2026 (Güncel Durum)"),
]
HOTSPOTS = [
    ("istanbul_fikirtepe", "İstanbul - Fikirtepe (Kentsel Dönüşüm)", 40.9902, 29.0520, 17, 3, "2014", "2026", "Kadıköy'de az katlı eski konutların yıkılıp yerlerine yüksek blokların yapılması: yeniden yapılan, yıkılan ve korunan binalar bir arada."),
    ("ankara_mamak", "Ankara - Mamak Gülseren (Gecekondu Dönüşümü)", 39.9330, 32.9010, 17, 3, "2014", "2026", "Gecekondu alanlarının yıkılıp toplu konut bloklarına dönüşmesi: yüzlerce yıkılan gecekondu ve yerlerine yapılan bloklar."),
    ("izmir_ornekkoy", "İzmir - Örnekköy (Kentsel Dönüşüm)", 38.4795, 27.1135, 17, 3, "2014", "2026", "Karşıyaka'da tek katlı mahalle dokusunun yerini büyük konut bloklarına bırakması."),
    ("austin_pflugerville", "Austin, Teksas - Pflugerville Yeni Konut Siteleri", 30.4750, -97.6250, 17, None, "2014", "2026", "Austin'in kuzey banliyösünde boş parsellerin tek katlı müstakil konut sokaklarıyla dolması."),
    ("dubai_hills", "Dubai - Dubai Hills Estate (Çölden Villa Kentine)", 25.1030, 55.2480, 17, None, "2014", "2026", "2014'te boş çöl olan alanda yüzlerce villadan oluşan planlı bir yerleşimin kurulması."),
]
FIRST_YEAR, LAST_YEAR = "2014", "2026"


def releases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RELEASES, "year string, release_id string, date string, title string")


def years(spark: SparkSession) -> DataFrame:
    return releases(spark).select("year", "title", "date").orderBy("year")


def hotspots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HOTSPOTS, "id string, title string, lat double, lon double, zoom int, grid_size int, year_t1 string, year_t2 string, desc string")


def with_release(rows: DataFrame, year: str, default: str, out: str) -> DataFrame:
    """rows with the release id of their year; unknown years get the default's."""
    r = releases(rows.sparkSession).select(F.col("year").alias(year), F.col("release_id").alias(out))
    known = dict((y, i) for y, i, _, _ in RELEASES)
    return rows.join(F.broadcast(r), year, "left").withColumn(out, F.coalesce(out, F.lit(known[default])))  # seven rows


def release_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ident string, title string, release_id string").option("multiLine", True).json(path)


def write_release_list(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def layers(spark: SparkSession, path: str) -> DataFrame:
    """ident, title, release_id of the layers of capabilities documents: those with an identifier and a tile template; a layer
    without title goes by its identifier."""
    docs = spark.read.option("wholetext", True).text(path)
    block = docs.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<Layer>(.*?)</Layer>"), F.lit(1))).alias("b"))
    get = lambda p: F.nullif(F.regexp_extract("b", p, 1), F.lit(""))
    found = block.select(get(r"<ows:Identifier>(.*?)</ows:Identifier>").alias("ident"), get(r"<ows:Title>(.*?)</ows:Title>").alias("title"), get(r'template="([^"]*)"').alias("template"))
    found = found.where("ident IS NOT NULL AND template IS NOT NULL")
    return found.select("ident", F.coalesce("title", "ident").alias("title"), F.regexp_extract("template", r"/tile/([0-9]+)/", 1).alias("release_id"))


def templates(spark: SparkSession, path: str, first: int = 5) -> DataFrame:
    """Number of tile templates of a document and the first of them."""
    docs = spark.read.option("wholetext", True).text(path)
    all_ = F.regexp_extract_all("value", F.lit(r'template="([^"]*)"'), F.lit(1))
    return docs.select(F.size(all_).alias("count"), F.slice(all_, 1, first).alias("first"))


def first_of_year(rows: DataFrame, position: Column, wanted: tuple[str, ...]) -> DataFrame:
    """The first release of each wanted year by position; the year is looked for in the identifier."""
    year = F.array(*[F.lit(y) for y in wanted])
    hit = rows.select("*", position.alias("_at"), F.explode(F.filter(year, lambda y: F.col("ident").contains(y))).alias("year"))
    return hit.groupBy("year").agg(F.min_by(F.struct("ident", "title", "release_id"), "_at").alias("r")).select("year", "r.*")
