"""Exact percentiles of groups of any size by radix refinement: counts by the leading bits of a value, then by the next ones, only among
the values that share the bits found so far. No task ever holds a group's values or its distinct values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGIT = 16


@F.pandas_udf(T.LongType())
def _from_float(v: pd.Series) -> pd.Series:
    """A whole number of 32 bits in the order of the values; -0 as 0, not-a-number above all."""
    x = v.to_numpy(np.float32) + np.float32(0)
    x[np.isnan(x)] = np.nan
    b = x.view(np.int32)
    return pd.Series((b ^ ((b >> 31) & np.int32(2**31 - 1))).astype(np.int64))


@F.pandas_udf(T.LongType())
def _from_double(v: pd.Series) -> pd.Series:
    x = v.to_numpy(np.float64) + 0.0
    x[np.isnan(x)] = np.nan
    b = x.view(np.int64)
    return pd.Series(b ^ ((b >> 63) & np.int64(2**63 - 1)))


@F.pandas_udf(T.DoubleType())
def _to_float(k: pd.Series) -> pd.Series:
    b = k.to_numpy(np.int64).astype(np.int32)
    return pd.Series((b ^ ((b >> 31) & np.int32(2**31 - 1))).view(np.float32).astype(np.float64))


@F.pandas_udf(T.DoubleType())
def _to_double(k: pd.Series) -> pd.Series:
    b = k.to_numpy(np.int64)
    return pd.Series((b ^ ((b >> 63) & np.int64(2**63 - 1))).view(np.float64))


def _coded(value: Column, kind: T.DataType) -> tuple[Column, int, object]:
    """The value as a whole number that keeps its order, its bits, and the way back."""
    if isinstance(kind, (T.ByteType, T.ShortType)):
        return value.cast("long"), 16, lambda k: k.cast("double")
    if isinstance(kind, T.IntegerType):
        return value.cast("long"), 32, lambda k: k.cast("double")
    if isinstance(kind, T.LongType):
        return value, 64, lambda k: k.cast("double")
    if isinstance(kind, T.FloatType):
        return _from_float(value), 32, lambda k: F.coalesce(_to_float(k), F.lit(float("nan")))  # pandas takes it for null
    if isinstance(kind, T.DoubleType):
        return _from_double(value), 64, lambda k: F.coalesce(_to_double(k), F.lit(float("nan")))
    raise TypeError(f"percentiles of {kind.simpleString()}")


def percentiles(values: DataFrame, key: list[str], value: str, shares: list[float], weight: str | None = None) -> DataFrame:
    """key, n (values counted), q: for each share the value at place share * (n - 1) of the sorted values, between two by distance.

    value: whole numbers, floats or doubles; weight: how often a row counts (null or below 1: not at all). Null values do not count, and a key of none
    but nulls is left out; not-a-number is above all others. A null key is a group like others. Repeated values are places of their own.

    Floats and ints take two readings of the values, doubles and longs four, 16 bits each. A reading counts before it shuffles: 65,536 rows for each
    group and prefix at most, then one window over them; prefixes sought are two a share at most. From the second on only values under
    a sought prefix are counted."""
    code, bits, back = _coded(F.col(value), values.schema[value].dataType)
    names = [f"_k{i}" for i in range(len(key))]
    keys = [F.struct(F.col(k).alias("v")).alias(n) for k, n in zip(key, names)]  # in a struct null equals null
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    rows = values.where(F.col(value).isNotNull() & (w >= 1)).select(*keys, w.alias("_w"), code.alias("_v"))
    place = lambda share: (F.col("_all") - 1) * F.lit(float(share))
    shift = bits - DIGIT
    count = rows.groupBy(*names, F.shiftright("_v", shift).alias("_p")).agg(F.sum("_w").alias("_n"))
    places = [f(place(s)) for s in shares for f in (F.floor, F.ceil)]
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), x.cast("long").alias("rest")) for i, x in enumerate(places)])
    sought = _narrowed(count.withColumn("_all", F.sum("_n").over(Window.partitionBy(*names))).withColumn("_ranks", ranks), names)
    while shift > 0:
        under = rows.withColumn("_up", F.shiftright("_v", shift)).join(sought.withColumnRenamed("_p", "_up"), [*names, "_up"])
        shift -= DIGIT
        count = under.groupBy(*names, "_up", "_all", "_ranks", F.shiftright("_v", shift).alias("_p")).agg(F.sum("_w").alias("_n"))
        sought = _narrowed(count, [*names, "_up"]).drop("_up")
    found = sought.select(*names, "_all", back(F.col("_p")).alias("_x"), F.explode("_ranks.i").alias("_i"))
    found = found.groupBy(*names, "_all").agg(F.map_from_entries(F.collect_list(F.struct("_i", "_x"))).alias("_at"))

    def between(j: int, share: float) -> Column:
        low, high = F.element_at("_at", F.lit(2 * j)), F.element_at("_at", F.lit(2 * j + 1))
        return F.when(low == high, low).otherwise((F.ceil(place(share)) - place(share)) * low + (place(share) - F.floor(place(share))) * high)

    return found.select(*[F.col(n)["v"].alias(k) for n, k in zip(names, key)], F.col("_all").alias("n"), F.array(*[between(j, s) for j, s in enumerate(shares)]).alias("q"))


def _narrowed(count: DataFrame, by: list[str]) -> DataFrame:
    """The prefixes that hold a sought place, with those places counted from the prefix's first value."""
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    here = count.withColumn("_before", before)
    inside = F.filter("_ranks", lambda x: (x["rest"] >= F.col("_before")) & (x["rest"] < F.col("_before") + F.col("_n")))
    own = F.transform(inside, lambda x: F.struct(x["i"].alias("i"), (x["rest"] - F.col("_before")).alias("rest")))
    return here.withColumn("_ranks", own).where(F.size("_ranks") > 0).drop("_before", "_n")
