"""What came to light on larger tables: keys, and with them dates, that small tables do not reach, and work that one task must not hold."""

import numpy as np
from pyspark.sql import functions as F

from rasterlane.functions import rules
from rasterlane.operators import graph, kernels, pixels, polygons
from rasterlane.plans import bindings, imagery_queries
from rasterlane.sources import captures, tiles
from rasterlane.sources.shared import dealt, written

DIR = "/root/testdata/sf0.001"


def test_dates_after_the_year_9999(spark):
    ms = spark.createDataFrame([(0,), (253_402_300_799_999,), (253_402_300_800_000,), (777_000_000_000_000,), (None,)], "ms long")
    assert [r[0] for r in ms.select(rules.iso_date(F.col("ms"))).collect()] == ["1970-01-01", "9999-12-31", "10000-01-01", "26592-02-24", None]


def test_captures_after_the_year_9999(spark):
    answers = spark.createDataFrame([('{"features":[{"attributes":{"SRC_DATE2":253402300800000}}]}',), ('{"features":[{"attributes":{"SRC_DATE2":"+5"}}]}',)], "answer string")
    assert [r[0] for r in answers.select(captures.capture(F.col("answer"))["date"]).collect()] == ["10000-01-01", "+5"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filling_polygons_sends_no_cell(spark):
    rng = np.random.default_rng(4)
    rings = [[{"x": int(x), "y": int(y)} for x, y in rng.integers(-40, 900, (n, 2))] for n in rng.integers(1, 9, 150)]
    d = spark.createDataFrame([({"a": k}, 700, 800, r) for k, r in enumerate(rings)] + [({"a": 77}, 5, 5, [{"x": 1, "y": None}])], "k struct<a:int>, h int, w int, ring array<struct<x:int,y:int>>").coalesce(1)
    assert "Exchange" not in plan(polygons.filled(d, ["k"]))
    runs = polygons.filled_runs(d, ["k"]).toPandas()
    runs["k"] = [k["a"] for k in runs.k]
    for k, ring in enumerate(rings):
        on = np.zeros((700, 800), int)
        for r in runs[runs.k == k].itertuples():
            on[r.r, r.a : r.b + 1] += 1
        assert (on == kernels.filled([(p["x"], p["y"]) for p in ring], 700, 800)).all()


def test_rows_that_make_many_are_dealt_out(spark, tmp_path):
    one = spark.range(1000).coalesce(1)
    assert dealt(one, 100, "id").rdd.getNumPartitions() == 10 and dealt(one, 10_000, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    for query in (imagery_queries.tile_scan, imagery_queries.usable_pairs):
        assert plan(query(spark, DIR)).count("REPARTITION_BY_NUM") >= 3


def test_requests_are_not_joined_by_their_few_layers(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan(imagery_queries.metadata_requests(spark, DIR))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_blocks_are_worked_on_in_stacks(spark):
    on = spark.range(40).selectExpr("id div 2 AS scene", "0 AS epoch", "cast(id % 7 AS int) AS r", "cast(id % 5 AS int) AS c", "20 AS h", "9 AS w", "struct(id % 2 AS part) AS part")
    grown = pixels.morphed(on, [(pixels.rectangle(3), True)], ["part"], 4)
    assert "MapInArrow" in plan(grown) and "FlatMapGroups" not in plan(grown)
    want = pixels.dilate(on, pixels.rectangle(3), ["part"])
    assert sorted(map(str, grown.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_scenes_are_dealt_out(spark):
    assert "REPARTITION_BY_NUM" in plan(bindings.blocks(spark, DIR)) and "REPARTITION_BY_NUM" in plan(bindings.tall_blocks(spark, DIR))


def test_equal_tiles_are_read_once(monkeypatch):
    calls = []
    x = np.full((300, 200, 3), 200, np.uint8)
    monkeypatch.setattr(tiles.jpeg, "pixels_or_none", lambda c: calls.append(c) or (x if c else None))
    read = tiles.tile_reader()
    for _ in range(3):
        block, grey = read(b"a")
        assert block.shape == (256, 256, 3) and (block[:, :200] == 200).all() and not block[:, 200:].any() and grey == 200 / 256
        assert read(None)[1] == 1
    assert calls == [b"a", None]


def test_links_are_not_broadcast(spark, monkeypatch):
    """With Spark's own bound on broadcasts, under which small files of many numbers fall."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    plans = []
    monkeypatch.setattr(graph, "written", lambda df, name: plans.append(plan(df)) or written(df, name))
    graph.components(spark.range(9).selectExpr("id AS u", "id + 1 AS v")).collect()
    assert len(plans) > 1 and not any("Broadcast" in p for p in plans)
