"""Queries of records, statistics, captures and periods, over order lines and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rasterlane.functions import rules
from rasterlane.operators import summaries, timeline
from rasterlane.plans.bindings import OBJECTS, TYPES, objects, table, types
from rasterlane.sources.export import csv_rows, geojson

C = F.col
GSD = 0.5


def building_records(spark, d):
    return summaries.ordered_records(objects(spark, d), types(spark), ["patch"], ["a", "b", "c", "d"]).select("patch", C("id").cast("long").alias("id"), "type", "type_tr", "color", "area_px", rules.square_metres(C("area_px"), F.lit(GSD)).alias("area_m2"), "a", "b", "c")


def type_stats(spark, d):
    return summaries.type_stats(objects(spark, d), ["patch"], F.lit(GSD))


def classic_stats(spark, d):
    o = objects(spark, d).where("type <> 'rebuilt'").select("patch", "type", (C("area_px") * 1.0).alias("area_m2"))
    return summaries.classic_stats(o, ["patch"])


def confidence_pct(spark, d):
    return objects(spark, d).select("a", "b", "c", "patch", "type", rules.confidence_pct(C("type"), C("same"), C("other")).alias("confidence"))


def change_heat(spark, d):
    return objects(spark, d).select("a", "b", "c", "patch", F.bround(rules.change_heat(C("same"), C("other")), 6).alias("heat"))


def shown_cards(spark, d):
    r = summaries.ordered_records(objects(spark, d), types(spark), ["patch"], ["a", "b", "c", "d"])
    return summaries.shown_cards(r, ["patch"]).groupBy("patch").agg(F.count("*").alias("cards"), F.sum("area_px").alias("area"))


def shown_labels(spark, d):
    r = summaries.ordered_records(objects(spark, d), types(spark), ["patch"], ["a", "b", "c", "d"])
    return summaries.shown_labels(r, ["patch"]).groupBy("patch").agg(F.count("*").alias("labels"))


def _captures(spark, d):
    e = table(spark, d, "events")
    return e.select("user_id", "event_id", "ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"), F.when(C("value") < 20, False).when(C("value") > 60, True).alias("state"))


def change_period_per_user(spark, d):
    """Between which two captures each user's state changed."""
    c = _captures(spark, d)
    users = c.select("user_id").distinct()
    end = lambda g, date, v: users.select("user_id", F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(date).alias("date"), F.lit(v).alias("state"), F.lit(g).alias("g"))
    rows = c.withColumns({"ts": C("ts").cast("timestamp_ntz"), "g": F.lit(1)}).unionByName(end(0, "T1", False)).unionByName(end(2, "T2", True))
    return timeline.change_periods(rows, ["user_id"], ["g", "ts", "event_id"])


def _months(spark, d):
    e = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM").alias("date"), "value")
    m = e.groupBy("user_id", "date").agg(F.avg("value").alias("v"))
    return m.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("date")).alias("seq"), "date", F.when(C("v") < 45, False).when(C("v") > 55, True).alias("state"))


def period_type_summary(spark, d):
    months = _months(spark, d)
    p = timeline.change_periods(timeline.with_ends(months, ["user_id"], "0000-00", "9999-99"), ["user_id"], ["g", "seq"])
    p = p.withColumn("type", F.element_at(F.array(*[F.lit(t) for t in rules.CHANGE_TYPES]), (C("user_id") % 3 + 1).cast("int")))
    dates = months.select("date").distinct().unionByName(spark.sql("SELECT explode(array('0000-00', '9999-99')) AS date"))
    return timeline.period_summary(p, dates)


def distinct_captures(spark, d):
    """The earliest month number of every date with a sharp capture."""
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.month("ts").alias("year"), (C("value") / 50).alias("resolution"))
    return e.where(rules.good_capture(C("date"), C("resolution"), F.lit("2024-01-02"), F.lit("2024-12-30"))).groupBy("date").agg(F.min("year").cast("long").alias("year"))


def duplicate_captures(spark, d):
    """For every capture the first earlier one of the same user and date."""
    e = table(spark, d, "events").select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd").alias("date"))
    first = F.min("event_id").over(Window.partitionBy("user_id", "date"))
    return e.select("event_id", F.when(first < C("event_id"), first).alias("same_as"))


def geojson_export(spark, d):
    return geojson(building_records(spark, d), keys=("patch",))


def csv_export(spark, d):
    return csv_rows(building_records(spark, d))


_RECORDS = f"(SELECT *, row_number() OVER (PARTITION BY patch ORDER BY CASE type WHEN 'new' THEN 0 WHEN 'demolished' THEN 1 WHEN 'rebuilt' THEN 2 ELSE 3 END, area_px DESC, a, b, c, d) AS id FROM {OBJECTS} JOIN {TYPES} USING (type))"
_N = ", ".join(f"count(*) FILTER (type = '{t}') AS n_{t}, CAST(coalesce(sum(area_px) FILTER (type = '{t}'), 0) AS BIGINT) AS px_{t}" for t in summaries.TYPES)
_M2 = ", ".join(f"round_even(px_{t} * 0.5::DOUBLE * 0.5::DOUBLE, 1) AS m2_{t}" for t in summaries.TYPES)
_M = "CAST(round_even(area_px * 0.5::DOUBLE * 0.5::DOUBLE, 1) AS VARCHAR)"
_FEATURE = " || ".join([f"""'{{\n    "type" : "Feature",\n    "id" : ' || id || ',\n    "properties" : {{'"""] + [f"""'{"," if i else ""}\n      "{c}" : ' || {v}""" for i, (c, v) in enumerate(
    {c: {"type": """'"' || type || '"'""", "type_tr": """'"' || type_tr || '"'""", "color": """'"' || color || '"'""", "area_m2": _M}.get(c, c) for c in "patch id type type_tr color area_px area_m2 a b c".split()}.items())]
    + [f"""'\n    }},\n    "geometry" : {{\n      "type" : "Polygon",\n      "coordinates" : [ ]\n    }}\n  }}'"""])
_SPLIT = """SELECT {key}, d AS "from", lead(d) OVER w AS "to", sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) + coalesce(sum(CASE WHEN st THEN 0 ELSE 1 END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS cost,
    row_number() OVER w AS seq, lead(1) OVER w AS more FROM {rows} WHERE st IS NOT NULL WINDOW w AS (PARTITION BY {key} ORDER BY {order})"""
_BEST = 'SELECT {key}, "from", "to" FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY cost, seq DESC) AS best FROM ({split}) WHERE more = 1) WHERE best = 1'

QUERIES = {
    "building_records": (building_records, f"SELECT patch, id, type, type_tr, color, area_px, round_even(area_px * 0.5::DOUBLE * 0.5::DOUBLE, 1) AS area_m2, a, b, c FROM {_RECORDS}"),
    "type_stats": (type_stats, f"WITH s AS (SELECT patch, count(*) AS total, {_N} FROM {OBJECTS} GROUP BY patch), t AS (SELECT *, px_new + px_demolished + px_rebuilt AS changed_px FROM s) SELECT *, round_even(changed_px * 0.5::DOUBLE * 0.5::DOUBLE, 1) AS changed_m2, round_even(changed_px * 0.5::DOUBLE * 0.5::DOUBLE / 10000, 3) AS changed_ha, {_M2} FROM t"),
    "classic_stats": (classic_stats, f"""WITH o AS (SELECT patch, type, CAST(area_px AS DOUBLE) AS m FROM {OBJECTS} WHERE type <> 'rebuilt')
        SELECT patch, count(*) AS total, count(*) FILTER (type = 'new') AS n_new, count(*) FILTER (type = 'demolished') AS n_demolished, count(*) FILTER (type = 'existing') AS n_existing,
        round_even(coalesce(sum(m) FILTER (type <> 'existing'), 0), 1) AS changed_m2, round_even(coalesce(sum(m) FILTER (type <> 'existing'), 0) / 10000, 3) AS changed_ha, round_even(coalesce(sum(m) FILTER (type = 'new'), 0), 1) AS new_m2, round_even(coalesce(sum(m) FILTER (type = 'demolished'), 0), 1) AS demolished_m2 FROM o GROUP BY patch"""),
    "confidence_pct": (confidence_pct, f"SELECT a, b, c, patch, type, round_even(CASE type WHEN 'existing' THEN same * other WHEN 'rebuilt' THEN same ELSE same * (1 - other) END * 100, 1) AS confidence FROM {OBJECTS}"),
    "change_heat": (change_heat, f"SELECT a, b, c, patch, round_even(greatest(other * (1 - same), same * (1 - other)), 6) AS heat FROM {OBJECTS}"),
    "shown_cards": (shown_cards, f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY patch, type = 'existing' ORDER BY id) AS n FROM {_RECORDS}) SELECT patch, count(*) AS cards, CAST(sum(area_px) AS BIGINT) AS area FROM r WHERE type <> 'existing' OR n <= 200 GROUP BY patch"),
    "shown_labels": (shown_labels, f"WITH r AS (SELECT *, count(*) OVER (PARTITION BY patch) AS n FROM {OBJECTS}) SELECT patch, count(*) AS labels FROM r WHERE type <> 'existing' OR n <= 300 GROUP BY patch"),
    "change_period_per_user": (change_period_per_user, "WITH r AS (SELECT user_id, 1 AS g, ts, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS d, CASE WHEN value < 20 THEN false WHEN value > 60 THEN true END AS st FROM events UNION ALL SELECT DISTINCT user_id, 0, NULL, NULL, 'T1', false FROM events UNION ALL SELECT DISTINCT user_id, 2, NULL, NULL, 'T2', true FROM events) " + _BEST.format(key="user_id", split=_SPLIT.format(key="user_id", rows="r", order="g, ts, event_id"))),
    "period_type_summary": (period_type_summary, """WITH m AS (SELECT user_id, strftime(ts, '%Y-%m') AS d, avg(value) AS v FROM events GROUP BY ALL),
        r AS (SELECT user_id, d, CASE WHEN v < 45 THEN false WHEN v > 55 THEN true END AS st FROM m UNION ALL SELECT DISTINCT user_id, '0000-00', false FROM m UNION ALL SELECT DISTINCT user_id, '9999-99', true FROM m),
        p AS (""" + _BEST.format(key="user_id", split=_SPLIT.format(key="user_id", rows="r", order="d")) + """),
        s AS (SELECT d AS f, lead(d) OVER (ORDER BY d) AS t FROM (SELECT DISTINCT d FROM r)),
        k AS (SELECT s.f AS "from", s.t AS "to", p.user_id % 3 AS type FROM p LEFT JOIN s ON s.f = p."from" AND s.t = p."to")
        SELECT "from", "to", count(*) FILTER (type = 0) AS "new", count(*) FILTER (type = 1) AS demolished, count(*) FILTER (type = 2) AS rebuilt FROM k GROUP BY "from", "to" """),
    "distinct_captures": (distinct_captures, "SELECT strftime(ts, '%Y-%m-%d') AS date, min(CAST(month(ts) AS BIGINT)) AS year FROM events WHERE strftime(ts, '%Y-%m-%d') > '2024-01-02' AND strftime(ts, '%Y-%m-%d') < '2024-12-30' AND coalesce(value / 50, 0) <= 1.0 GROUP BY 1"),
    "duplicate_captures": (duplicate_captures, "SELECT event_id, CASE WHEN f < event_id THEN f END AS same_as FROM (SELECT event_id, min(event_id) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d')) AS f FROM events)"),
    "geojson_export": (geojson_export, f"""SELECT patch, '{{\n  "type" : "FeatureCollection",\n  "georeferenced" : false,\n  "features" : [ ' || string_agg({_FEATURE}, ', ' ORDER BY id) || ' ]\n}}' AS geojson FROM {_RECORDS} GROUP BY patch"""),
    "csv_export": (csv_export, f"SELECT CAST(id AS VARCHAR) AS Bina_ID, type AS Degisim_Turu, type_tr AS Degisim_Tanimi, {_M} AS Alan_m2, " + ", ".join(f"'' AS {c}" for c in "Cevre_m Guven_Skoru_Yuzde Enlem Boylam Piksel_X Piksel_Y".split()) + f" FROM {_RECORDS}"),
}
