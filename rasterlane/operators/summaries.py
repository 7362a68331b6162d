"""Records, statistics and listings of classified objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlane.functions import rules

TYPES = ("new", "demolished", "existing", "rebuilt")


def type_stats(objects: DataFrame, key: list[str], gsd: Column) -> DataFrame:
    """One row a patch: counts and areas by type, changed area in cells, m² and hectares. objects: key, type, area_px."""
    is_ = lambda t: F.col("type") == t
    n = [F.count_if(is_(t)).alias(f"n_{t}") for t in TYPES]
    px = [F.coalesce(F.sum(F.when(is_(t), F.col("area_px"))), F.lit(0)).alias(f"px_{t}") for t in TYPES]
    out = objects.groupBy(*key).agg(F.count("*").alias("total"), *n, *px)
    out = out.withColumn("changed_px", F.col("px_new") + F.col("px_demolished") + F.col("px_rebuilt"))
    more = {"changed_m2": rules.square_metres(F.col("changed_px"), gsd), "changed_ha": rules.hectares(F.col("changed_px"), gsd)}
    return out.withColumns(more | {f"m2_{t}": rules.square_metres(F.col(f"px_{t}"), gsd) for t in TYPES})


def classic_stats(objects: DataFrame, key: list[str]) -> DataFrame:
    """The pixel-difference engine's statistics: only new and demolished count as changed; areas come in m²."""
    is_ = lambda *t: F.col("type").isin(*t)
    area = lambda *t: F.bround(F.coalesce(F.sum(F.when(is_(*t), F.col("area_m2"))), F.lit(0.0)), 1)
    changed = F.coalesce(F.sum(F.when(is_("new", "demolished"), F.col("area_m2"))), F.lit(0.0))
    return objects.groupBy(*key).agg(F.count("*").alias("total"), F.count_if(is_("new")).alias("n_new"), F.count_if(is_("demolished")).alias("n_demolished"), F.count_if(is_("existing")).alias("n_existing"), area("new", "demolished").alias("changed_m2"), F.bround(changed / 10000.0, 3).alias("changed_ha"), area("new").alias("new_m2"), area("demolished").alias("demolished_m2"))


def ordered_records(objects: DataFrame, types: DataFrame, key: list[str], ties: list[str]) -> DataFrame:
    """objects with the type's names and colours and an id, 1-based in the order of type, then falling area; ties name the rest."""
    at = Window.partitionBy(*key).orderBy(rules.type_rank(F.col("type")), F.col("area_px").desc(), *ties)
    return objects.withColumn("id", F.row_number().over(at)).join(F.broadcast(types), "type", "left")  # four rows


def shown_cards(records: DataFrame, key: list[str], most_existing: int = 200) -> DataFrame:
    """All changed objects, and of the existing ones the first of each patch."""
    existing = F.col("type") == "existing"
    at = Window.partitionBy(*key, existing).orderBy("id")
    return records.withColumn("_n", F.row_number().over(at)).where(~existing | (F.col("_n") <= most_existing)).drop("_n")


def shown_labels(records: DataFrame, key: list[str], busy: int = 300) -> DataFrame:
    """Objects that get a label on a map: without the existing ones where a patch holds more than `busy`."""
    n = F.count("*").over(Window.partitionBy(*key))
    return records.withColumn("_n", n).where((F.col("type") != "existing") | (F.col("_n") <= busy)).drop("_n")
