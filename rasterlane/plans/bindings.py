"""How the driver's tables stand in for imagery: rules of this project, by whole-number arithmetic on keys.

Points: customers. Objects: order lines, with a type by their flags. Captures: events. Scenes: two neighbouring vectors, read as the
8 x 8 cells of the earlier and the later date. Projects: orders and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlane.sources.shared import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), ((k * 37 % 16000) / 100.0 - 80.0).alias("lat"), ((k * 91 % 35900) / 100.0 - 179.5).alias("lon"), (k % 8 + 10).cast("int").alias("zoom"), (k % 8 + 1).cast("int").alias("size"))


POINTS = "(SELECT c_custkey AS id, (c_custkey * 37 % 16000) / 100.0 - 80.0 AS lat, (c_custkey * 91 % 35900) / 100.0 - 179.5 AS lon, CAST(c_custkey % 8 + 10 AS INTEGER) AS zoom, CAST(c_custkey % 8 + 1 AS INTEGER) AS size FROM customer)"


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patch (a supplier), type, area_px, gsd and what tells equal objects apart."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    type_ = F.when((flag == "A") & (status == "O"), "new").when(flag == "A", "demolished").when((flag == "N") & (status == "O"), "rebuilt").otherwise("existing")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("patch"), type_.alias("type"), F.col("l_quantity").cast("long").alias("area_px"), F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.col("l_partkey").alias("c"), F.col("l_discount").alias("same"), F.col("l_tax").alias("other"), F.col("l_extendedprice").alias("d"))


OBJECTS = """(SELECT l_suppkey AS patch, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'new' WHEN l_returnflag = 'A' THEN 'demolished'
 WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'rebuilt' ELSE 'existing' END AS type, CAST(trunc(l_quantity) AS BIGINT) AS area_px,
 l_orderkey AS a, l_linenumber AS b, l_partkey AS c, l_discount AS same, l_tax AS other, l_extendedprice AS d FROM lineitem)"""


def _vectors(spark: SparkSession, sf_dir: str, per_scene: int) -> DataFrame:
    """Vectors dealt out by scene: a file of them is few bytes, its cells are many rows."""
    return dealt(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 8192, F.expr(f"vec_id div {per_scene}"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    side = lambda n: F.lit(n).cast("int")
    return _vectors(spark, sf_dir, 2).where(F.size("embedding") == 64).select(F.expr("vec_id div 2").alias("scene"), (v % 2).cast("int").alias("epoch"), side(0).alias("y0"), side(0).alias("x0"), side(8).alias("bw"), side(8).alias("h"), side(8).alias("w"), F.col("embedding").alias("p"))


def tall_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen vectors one over the other as a date of a scene of 128 x 8 cells, in blocks of 8 x 8: the borders of blocks matter."""
    v = F.col("vec_id")
    side = lambda n: F.lit(n).cast("int")
    return _vectors(spark, sf_dir, 32).where(F.size("embedding") == 64).select(F.expr("vec_id div 32").alias("scene"), F.expr("vec_id div 16 % 2").cast("int").alias("epoch"), (v % 16 * 8).cast("int").alias("y0"), side(0).alias("x0"), side(8).alias("bw"), side(128).alias("h"), side(8).alias("w"), F.col("embedding").alias("p"))


TALL_CELLS = """(SELECT vec_id // 32 AS scene, CAST(vec_id // 16 % 2 AS INTEGER) AS epoch, CAST(vec_id % 16 * 8 + (i - 1) // 8 AS INTEGER) AS r, CAST((i - 1) % 8 AS INTEGER) AS c, p FROM
 (SELECT vec_id, unnest(embedding) AS p, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE len(embedding) = 64))"""


CELLS = """(SELECT scene, epoch, CAST((i - 1) // 8 AS INTEGER) AS r, CAST((i - 1) % 8 AS INTEGER) AS c, p FROM
 (SELECT vec_id // 2 AS scene, CAST(vec_id % 2 AS INTEGER) AS epoch, unnest(embedding) AS p, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE len(embedding) = 64))"""


def types(spark: SparkSession) -> DataFrame:
    """The four object types. Names, colours, label numbers."""
    rows = [("new", "Yeni Eklenen Bina", "#10b981", 1), ("demolished", "Yıkılan / Kaldırılan Bina", "#ef4444", 2), ("existing", "Mevcut / Korunan Bina", "#64748b", 3), ("rebuilt", "Yeniden Yapılan Bina", "#f59e0b", 4)]
    return spark.createDataFrame(rows, "type string, type_tr string, color string, mask_value int")


TYPES = "(VALUES ('new', 'Yeni Eklenen Bina', '#10b981', 1), ('demolished', 'Yıkılan / Kaldırılan Bina', '#ef4444', 2), ('existing', 'Mevcut / Korunan Bina', '#64748b', 3), ('rebuilt', 'Yeniden Yapılan Bina', '#f59e0b', 4)) t(type, type_tr, color, mask_value)"
