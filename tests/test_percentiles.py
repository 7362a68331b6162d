"""Percentiles by radix refinement against percentiles of sorted values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlane.operators.percentiles import percentiles

SHARES = [0.0, 0.02, 0.25, 0.5, 0.98, 1.0]


def same(a, b):
    return all(x == y or math.isnan(x) and math.isnan(y) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("kind", ["float", "double", "int", "long", "short"])
def test_equal_to_sorted_values(spark, kind):
    rnd = np.random.default_rng(5)
    whole = kind not in ("float", "double")
    groups = {"a": rnd.normal(0, 1000, 4000), "b": rnd.normal(0, 3, 7), None: np.repeat([5.0, -7.0], 50), "one": np.array([-3.0]), "even": np.arange(-10.0, 10)}
    if not whole:
        groups["wide"] = np.concatenate([rnd.normal(0, 1, 300) * 10.0 ** rnd.integers(-30, 30, 300), [0.0, -0.0, math.inf, -math.inf]])
    rows = [(k, int(v) if whole else float(v)) for k, vs in groups.items() for v in vs] + [("none", None), ("a", None)]
    d = spark.createDataFrame(rows, f"k string, v {kind}")
    got = {r.k: r for r in percentiles(d, ["k"], "v", SHARES).collect()}
    assert set(got) == set(groups)
    for r in d.where("v IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.percentile("v", SHARES).alias("q")).collect():
        assert got[r.k].n == r.n and same(got[r.k].q, r.q)


def test_weights_count_as_repeats(spark):
    rnd = np.random.default_rng(6)
    rows = [(int(k), float(v), int(w)) for k, v, w in zip(rnd.integers(0, 3, 500), rnd.integers(-40, 40, 500) / 4, rnd.integers(0, 9, 500))] + [(0, 99.0, None)]
    d = spark.createDataFrame(rows, "k int, v double, w long")
    got = {r.k: (r.n, r.q) for r in percentiles(d, ["k"], "v", SHARES, "w").collect()}
    for k in range(3):
        all_ = np.concatenate([np.repeat(v, w or 0) for g, v, w in rows if g == k])
        assert got[k][0] == len(all_) and np.allclose(got[k][1], np.quantile(all_, SHARES), rtol=0, atol=1e-12)


def test_no_key_no_rows_and_not_a_number(spark):
    d = spark.createDataFrame([(1.5,), (math.nan,), (-2.0,)], "v double")
    r = percentiles(d, [], "v", [0.0, 0.5, 1.0]).first()
    assert r.n == 3 and r.q[:2] == [-2.0, 1.5] and math.isnan(r.q[2])
    assert percentiles(d.where("v > 1e9 AND v < 0"), [], "v", [0.5]).count() == 0
    assert percentiles(d.withColumn("k", F.lit("x")).where("v = 0"), ["k"], "v", [0.5]).count() == 0
    with pytest.raises(TypeError):
        percentiles(spark.createDataFrame([("x",)], "v string"), [], "v", [0.5])


def test_key_named_like_a_work_column(spark):
    d = spark.createDataFrame([(1, 2, 4.0), (1, 2, 6.0), (3, 2, 1.0)], "_w int, n int, v double")
    assert sorted((r._w, r.q) for r in percentiles(d, ["_w"], "v", [0.5]).collect()) == [(1, [5.0]), (3, [1.0])]
