"""Queries of the scalar geography and sizing rules, over customers, suppliers, parts and order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlane.functions import geo, projection, rules
from rasterlane.plans.bindings import POINTS, points, table

C = F.col


def _r(x, digits=6):
    return F.bround(x, digits)


def tile_address(spark, d):
    t = points(spark, d).select("id", geo.tile_of(C("lat"), C("lon"), C("zoom")).alias("t"))
    return t.select("id", "t.x", "t.y")


def grid_origin(spark, d):
    return points(spark, d).select("id", geo.grid_origin(C("lat"), C("lon"), C("zoom"), C("size")).alias("o")).select("id", "o.x", "o.y")


def tile_bounds(spark, d):
    p = points(spark, d).select("id", "zoom", "size", geo.grid_origin(C("lat"), C("lon"), C("zoom"), C("size")).alias("o"))
    b = p.select("id", geo.grid_bounds(C("o.x"), C("o.y"), C("size"), C("zoom")).alias("b"))
    return b.select("id", *[_r(C(f"b.{k}")).alias(k) for k in ("s", "w", "n", "e")])


def grid_lines(spark, d):
    p = points(spark, d).select("id", "zoom", "size", geo.tile_of(C("lat"), C("lon"), C("zoom")).alias("t"))
    lines = p.select("id", F.explode(geo.grid_lines(C("t.x"), C("t.y"), C("size"), C("zoom"))).alias("l"))
    return lines.select("id", "l.kind", _r(C("l.degrees")).alias("degrees"))


def ground_resolution(spark, d):
    return points(spark, d).select("id", _r(geo.ground_resolution(C("lat"), C("zoom"))).alias("gsd"))


def bounds_from_center(spark, d):
    b = points(spark, d).select("id", geo.bounds_from_center(C("lat"), C("lon"), F.lit(512), F.lit(256), C("size") / 2).alias("b"))
    return b.select("id", *[_r(C(f"b.{k}")).alias(k) for k in ("s", "w", "n", "e")], geo.valid_bounds(C("b")).alias("valid"))


def pixel_to_lonlat(spark, d):
    b = F.struct(F.lit(40.0).alias("s"), F.lit(28.0).alias("w"), F.lit(41.0).alias("n"), F.lit(29.5).alias("e"))
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", geo.pixel_to_lonlat(C("l_partkey") % 512, C("l_suppkey") % 256, F.lit(512), F.lit(256), b).alias("p"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C("p")[0].alias("lon"), C("p")[1].alias("lat"))


def close_ring(spark, d):
    pt = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    k = C("s_suppkey")
    ring = F.when(k % 3 == 0, F.array(pt(k % 7, k % 5), pt(k % 7 + 3, k % 5), pt(k % 7 + 3, k % 5 + 2), pt(k % 7, k % 5))).otherwise(F.array(pt(k % 7, k % 5), pt(k % 7 + 3, k % 5), pt(k % 7 + 3, k % 5 + 2)))
    r = table(spark, d, "supplier").select("s_suppkey", geo.closed_ring(ring).alias("ring"))
    return r.select("s_suppkey", F.size("ring").cast("long").alias("points"), (rules.polygon_area2(C("ring")) / 2).alias("area"), _r(rules.polygon_perimeter(C("ring"))).alias("perimeter"), _r(rules.polygon_centroid(C("ring"))["x"], 3).alias("cx"), _r(rules.polygon_centroid(C("ring"))["y"], 3).alias("cy"))


def affine_bounds(spark, d):
    """Points as Mercator metres and back, and the overlap of two neighbouring boxes."""
    lat_m = lambda lat: projection.SEMI_MAJOR * F.asinh(F.tan(F.radians(lat)))
    p = points(spark, d).select("id", F.radians("lon").alias("x"), C("lat"), C("size"))
    t = geo.affine(F.lit(0.5), F.lit(0.0), C("x") * projection.SEMI_MAJOR, F.lit(0.0), F.lit(-0.5), lat_m(C("lat")))
    p = p.select("id", "size", t.alias("t")).select("id", "size", projection.image_bounds(C("t"), F.lit(200), F.lit(100), F.lit(3857)).alias("b"))
    moved = F.struct(C("b.s").alias("s"), (C("b.w") + (C("b.e") - C("b.w")) * C("size") / 10).alias("w"), C("b.n").alias("n"), (C("b.e") + (C("b.e") - C("b.w")) * C("size") / 10).alias("e"))
    return p.select("id", *[_r(C(f"b.{k}")).alias(k) for k in ("s", "w", "n", "e")], _r(geo.bounds_overlap(C("b"), moved)).alias("overlap"))


def grid_size_from_metres(spark, d):
    k = C("p_size") * 40
    return table(spark, d, "part").select("p_partkey", geo.metres_to_grid(k, F.lit(41.0), F.lit(17)).alias("grid"))


def grid_size_validation(spark, d):
    text = F.when(C("p_partkey") % 5 == 0, F.lit(None).cast("string")).when(C("p_partkey") % 5 == 1, C("p_brand")).when(C("p_partkey") % 5 == 2, F.lit("true")).otherwise((C("p_size") % 11).cast("string"))
    return table(spark, d, "part").select("p_partkey", rules.grid_size(text).alias("g")).select("p_partkey", C("g.size").alias("size"), C("g.error").alias("error"))


def analysis_scale_rule(spark, d):
    gsd = F.when(C("p_partkey") % 7 == 0, F.lit(None).cast("double")).otherwise((C("p_size") % 30) / 10.0 + 0.1)
    return table(spark, d, "part").select("p_partkey", rules.analysis_scale(C("p_size") * 100, F.lit(1024), gsd, F.when(C("p_partkey") % 2 == 0, "fast").otherwise("deep")).alias("scale"))


def tile_origins_explode(spark, d):
    t = table(spark, d, "part").select("p_partkey", rules.tile_starts(C("p_size") * 100).alias("starts"))
    return t.select("p_partkey", F.size("starts").cast("long").alias("tiles"), F.explode(F.transform("starts", lambda x: x.cast("long"))).alias("start"))


def min_pixels(spark, d):
    g = (C("l_linenumber") % 5 + 1) / 5.0
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rules.min_pixels(C("l_quantity"), g).cast("long").alias("matched"), rules.min_pixels(C("l_quantity"), g, 4).cast("long").alias("classic"))


def tolerance_px(spark, d):
    g = (C("l_linenumber") % 5 + 1) / 5.0
    measured = F.when(C("l_partkey") % 3 > 0, C("l_quantity"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _r(rules.tolerance_px(measured, g)).alias("tolerance"), rules.search_radius(g).cast("long").alias("radius"))


def display_labels(spark, d):
    k = C("p_partkey")
    a2, px = F.when(k % 3 == 0, C("p_size") / 4.0), F.when(k % 3 < 2, C("p_size"))
    return table(spark, d, "part").select("p_partkey", rules.area_label(a2, px).alias("area"), rules.patch_dimensions(C("p_size"), C("p_size") + 1, F.when(k % 2 == 0, 0.5)).alias("patch"), rules.missing_text(k % 4, F.lit(9)).alias("missing"),
                                            rules.location_title(F.when(k % 3 == 0, F.concat(C("p_name"), F.lit(" (x)"))), F.when(k % 3 == 1, C("p_size") / 4.0), F.lit(1.5)).alias("title"), rules.progress((C("p_size") - 10) / 32.0).alias("progress"), rules.period_label(F.lit("2014-12-30"), F.lit("2026-08-05")).alias("period"))


def epoch_dates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", rules.iso_date(C("o_orderkey") * 86_399_000 + 1_000_000_000_000).alias("date"))


_BOUNDS = "SELECT id, round_even(s, 6) AS s, round_even(w, 6) AS w, round_even(n, 6) AS n, round_even(e, 6) AS e"
_TX, _TY = "(lon + 180.0) / 360.0 * pow(2.0, zoom)", "(1.0 - asinh(tan(radians(lat))) / pi()) / 2.0 * pow(2.0, zoom)"
_ORIGIN = f"(SELECT id, zoom, size, CAST(floor({_TX} - size / 2 + 0.5) AS INTEGER) AS x, CAST(floor({_TY} - size / 2 + 0.5) AS INTEGER) AS y FROM {POINTS})"
_NORTH = "degrees(atan(sinh(pi() * (1.0 - ({y}) * 2.0 / pow(2.0, zoom)))))"
_WEST = "(({x}) / pow(2.0, zoom) * 360.0 - 180.0)"
_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_G = "((l_linenumber % 5 + 1) / 5.0)"

QUERIES = {
    "tile_address": (tile_address, f"SELECT id, CAST(trunc({_TX}) AS INTEGER) AS x, CAST(trunc({_TY}) AS INTEGER) AS y FROM {POINTS}"),
    "grid_origin": (grid_origin, f"SELECT id, x, y FROM {_ORIGIN}"),
    "tile_bounds": (tile_bounds, f"{_BOUNDS} FROM (SELECT id, {_NORTH.format(y='y + size')} AS s, {_WEST.format(x='x')} AS w, {_NORTH.format(y='y')} AS n, {_WEST.format(x='x + size')} AS e FROM {_ORIGIN})"),
    "grid_lines": (grid_lines, f"""WITH t AS (SELECT id, zoom, size, CAST(trunc({_TX}) AS INTEGER) AS x, CAST(trunc({_TY}) AS INTEGER) AS y, unnest(range(1, size)) AS k FROM {POINTS})
        SELECT id, 'meridian' AS kind, round_even({_WEST.format(x='x + k')}, 6) AS degrees FROM t UNION ALL SELECT id, 'parallel', round_even({_NORTH.format(y='y + k')}, 6) FROM t"""),
    "ground_resolution": (ground_resolution, f"SELECT id, round_even(156543.03392::DOUBLE * cos(radians(lat)) / pow(2.0, zoom), 6) AS gsd FROM {POINTS}"),
    "bounds_from_center": (bounds_from_center, f"""SELECT *, s >= -90 AND s < n AND n <= 90 AND w >= -180 AND w < e AND e <= 180 AS valid FROM ({_BOUNDS} FROM (SELECT id, lat - 256 * (size / 2) / 111320.0 / 2 AS s, lon - 512 * (size / 2) / (111320.0 * cos(radians(lat))) / 2 AS w,
        lat + 256 * (size / 2) / 111320.0 / 2 AS n, lon + 512 * (size / 2) / (111320.0 * cos(radians(lat))) / 2 AS e FROM {POINTS}))"""),
    "pixel_to_lonlat": (pixel_to_lonlat, f"SELECT {_KEY}, round_even(28.0::DOUBLE + (l_partkey % 512) / 512 * 1.5::DOUBLE, 6) AS lon, round_even(41.0::DOUBLE - (l_suppkey % 256) / 256 * 1.0::DOUBLE, 6) AS lat FROM lineitem"),
    "close_ring": (close_ring, """WITH s AS (SELECT s_suppkey, s_suppkey % 7 AS x, s_suppkey % 5 AS y FROM supplier)
        SELECT s_suppkey, CAST(4 AS BIGINT) AS points, 3.0::DOUBLE AS area, round_even(5.0::DOUBLE + sqrt(13), 6) AS perimeter, round_even((9 * x + 18) / 3.0::DOUBLE / (3 + 1e-5), 3) AS cx, round_even((9 * y + 6) / 3.0::DOUBLE / (3 + 1e-5), 3) AS cy FROM s"""),
    "affine_bounds": (affine_bounds, f"""WITH m AS (SELECT id, size, radians(lon) * 6378137.0 AS x, 6378137.0 * asinh(tan(radians(lat))) AS y FROM {POINTS}),
        b AS (SELECT id, size, degrees(atan(sinh((y - 50) / 6378137.0))) AS s, degrees(x / 6378137.0) AS w, degrees(atan(sinh(y / 6378137.0))) AS n, degrees((x + 100) / 6378137.0) AS e FROM m)
        SELECT id, round_even(s, 6) AS s, round_even(w, 6) AS w, round_even(n, 6) AS n, round_even(e, 6) AS e, round_even(CAST((1 - size / 10) / (1 + size / 10) AS DOUBLE), 6) AS overlap FROM b"""),
    "grid_size_from_metres": (grid_size_from_metres, "SELECT p_partkey, CAST(greatest(1, least(8, floor(p_size * 40 / (156543.03392 * cos(radians(41.0)) / pow(2.0, 17) * 256) + 0.5))) AS INTEGER) AS grid FROM part"),
    "grid_size_validation": (grid_size_validation, """WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN p_brand WHEN 2 THEN 'true' ELSE CAST(p_size % 11 AS VARCHAR) END AS v FROM part),
        n AS (SELECT p_partkey, v, CASE WHEN regexp_matches(v, '^[0-9]{1,6}$') THEN CAST(v AS INTEGER) END AS n FROM t)
        SELECT p_partkey, CASE WHEN v IS NULL THEN 2 WHEN n BETWEEN 1 AND 8 THEN n END AS size, CASE WHEN v IS NOT NULL AND NOT coalesce(n BETWEEN 1 AND 8, false) THEN 'grid_size' END AS error FROM n"""),
    "analysis_scale_rule": (analysis_scale_rule, """WITH t AS (SELECT p_partkey, p_size * 100 AS w, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST((p_size % 30) / 10.0 + 0.1 AS DOUBLE) END AS g, p_partkey % 2 = 0 AS fast FROM part)
        SELECT p_partkey, CAST(CASE WHEN fast AND greatest(w, 1024) > 2048 THEN CASE WHEN coalesce(g >= 0.75, false) OR coalesce(g * 2 > 1.2, false) THEN 1.0 ELSE 0.5 END WHEN coalesce(g >= 0.75, false) THEN least(2.0, g / 0.5) ELSE 1.0 END AS DOUBLE) AS scale FROM t"""),
    "tile_origins_explode": (tile_origins_explode, """WITH t AS (SELECT p_partkey, CAST(p_size * 100 AS BIGINT) AS n FROM part),
        s AS (SELECT p_partkey, CASE WHEN n <= 1024 THEN [0] ELSE list_append(range(0, n - 1024, 960), n - 1024) END AS l FROM t)
        SELECT p_partkey, CAST(len(l) AS BIGINT) AS tiles, unnest(l) AS start FROM s"""),
    "min_pixels": (min_pixels, f"SELECT {_KEY}, CAST(greatest(12, trunc(l_quantity / ({_G} * {_G}))) AS BIGINT) AS matched, CAST(greatest(4, trunc(l_quantity / ({_G} * {_G}))) AS BIGINT) AS classic FROM lineitem"),
    "tolerance_px": (tolerance_px, f"SELECT {_KEY}, round_even(least(coalesce(CASE WHEN l_partkey % 3 > 0 THEN l_quantity END, 2.0 / {_G}), 15.0 / {_G}), 6) AS tolerance, CAST(round_even(least(15.0 / {_G}, 48), 0) AS BIGINT) AS radius FROM lineitem"),
    "display_labels": (display_labels, """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN printf('%.1f m²', round_even(CAST(p_size / 4.0 AS DOUBLE), 1)) WHEN 1 THEN p_size || ' px' ELSE '—' END AS area,
        CASE WHEN p_partkey % 2 = 0 THEN printf('%dx%d px (%dm x %dm)', p_size, p_size + 1, CAST(trunc(p_size * 0.5) AS INTEGER), CAST(trunc((p_size + 1) * 0.5) AS INTEGER)) ELSE printf('%dx%d px (ölçeksiz)', p_size, p_size + 1) END AS patch,
        CASE WHEN p_partkey % 4 > 0 THEN (p_partkey % 4) || '/9' END AS missing,
        CASE p_partkey % 3 WHEN 0 THEN trim(split_part(p_name || ' (x)', '(', 1)) WHEN 1 THEN printf('Harita [%.2f, %.2f]', CAST(p_size / 4.0 AS DOUBLE), 1.5::DOUBLE) ELSE 'Özel Yükleme' END AS title,
        round_even(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (p_size - 10) / 32.0::DOUBLE)), 3) AS progress, '2014-12 – 2026-08' AS period FROM part"""),
    "epoch_dates": (epoch_dates, "SELECT o_orderkey, strftime(make_timestamp((o_orderkey * 86399000 + 1000000000000) * 1000), '%Y-%m-%d') AS date FROM orders"),
}
