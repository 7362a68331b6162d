"""Queries of imagery sources: tile caches, capture metadata, georeferences and requests, over customers, events and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlane.functions import crs, geo, rules
from rasterlane.operators import timeline
from rasterlane.plans import object_queries
from rasterlane.plans.bindings import POINTS, points, table
from rasterlane.plans.point_queries import _TX, _TY
from rasterlane.sources import captures, catalogs, georef, jpeg, tiles, wkt
from rasterlane.sources.shared import dealt

C = F.col


def _pairs(spark, d):
    k = C("id")
    year = F.when(k % 3 == 0, "2014").when(k % 3 == 1, "2016").otherwise("1999")
    return points(spark, d).select("id", "lat", "lon", F.when(k % 4 > 0, (k % 3 + 1).cast("int")).alias("grid_size"), year.alias("year_t1"), F.when(k % 2 == 0, "2024").otherwise("2030").alias("year_t2"))


def _scanned(spark, d):
    """Tiles of both dates of every point; the cache lacks every seventh tile by the sum of its numbers, and all of one release's far north."""
    want = tiles.pair(dealt(_pairs(spark, d), 20_000, "id"))  # a point has up to 18 tiles
    number = C("ty") + C("tx") + C("release_id").cast("int")
    cache = want.select(*tiles.KEY).distinct().where((number % 7 != 0) & ~((C("release_id") == "16453") & (C("ty") < 40000))).withColumn("content", F.lit("x").cast("binary"))
    return tiles.scan(want, cache)[0]


def tile_scan(spark, d):
    """Missing tiles of each pair, whether a date has none at all, and the note."""
    s = tiles.missing_summary(_scanned(spark, d), ["id"])
    return s.select("id", C("missing").cast("long").alias("missing"), "total", "no_imagery", "note")


def usable_pairs(spark, d):
    """Places to zero of the pairs that can be analysed, and the pairs that cannot."""
    good, bad = tiles.usable(_scanned(spark, d), ["id"])
    zero = tiles.invalid_cells(good, ["id"]).groupBy("id").agg(F.count("*").alias("zeroed"))
    return zero.select("id", "zeroed", F.lit(None).cast("string").alias("error")).unionByName(bad.select("id", F.lit(None).cast("long").alias("zeroed"), "error"))


def release_lookup(spark, d):
    p = catalogs.with_release(_pairs(spark, d), "year_t1", catalogs.FIRST_YEAR, "r1")
    return catalogs.with_release(p, "year_t2", catalogs.LAST_YEAR, "r2").select("id", "r1", "r2")


def metadata_requests(spark, d):
    """What is asked for each point and year, by the layers that the configuration names."""
    entries = ",".join(f'"{i}":{{"metadataLayerUrl":"http://m/{y}"}}' for y, i, _, _ in catalogs.RELEASES if y != "2020")
    config = spark.createDataFrame([("{" + entries + "}",)], "config string")
    asked = captures.at_years(dealt(points(spark, d).select("id", "lat", "lon"), 50_000, "id"), catalogs.releases(spark))
    return asked.join(F.broadcast(captures.layer_urls(config)), "release_id").select("id", "year", captures.query_url(C("layer_url"), C("lat"), C("lon")).alias("url"))  # six layers: a join by their keys would be six tasks' work


def capture_lookup(spark, d):
    """The capture that each event's answer tells of; equal places are asked once."""
    k = C("event_id")
    e = table(spark, d, "events").select("event_id", "event_type", (k % 7).cast("string").alias("release_id"), ((k % 90000) / 1000.0 - 45).alias("lat"), (F.expr("event_id div 90000") / 1000.0).alias("lon"))
    head, tail = '{"features":[{"attributes":{', "}}]}"
    ms, res = (k * 86_400_000 + 1_000_000_000_000).cast("string"), F.concat(F.lit(',"SAMP_RES":'), ((k % 100 + 1) / 100.0).cast("string"))
    answer = (F.when(k % 5 == 0, '{"features":[]}').when(k % 5 == 1, F.concat(F.lit(head + '"SRC_DATE2":'), ms, F.lit(',"SRC_DATE":1,"NICE_DESC":"","SRC_DESC":"'), "event_type", F.lit('"'), res, F.lit(tail)))
              .when(k % 5 == 2, F.concat(F.lit(head + '"SRC_DATE2":null,"SRC_DATE":"2011-05-06","NICE_DESC":"Maxar"'), res, F.lit(tail))).when(k % 5 == 4, head + '"SRC_DATE2":0,"NICE_DESC":"Maxar"' + tail))
    asked = captures.lookup_keys(e)
    answers = asked.join(e.select("release_id", "lat", "lon", answer.alias("answer")), ["release_id", "lat", "lon"])
    return captures.captures(e, answers).select("event_id", "capture.date", "capture.source", "capture.resolution_m", captures.low_resolution(C("capture")).alias("low"))


def tiff_georeference(spark, d):
    """Transforms and systems out of tags and key directories that the parts' numbers make."""
    k = C("p_partkey").cast("int")
    entry = lambda key, where, value: [F.lit(key), where, F.lit(1), value]
    zero = F.lit(0)
    keys = F.array(F.lit(1), F.lit(1), F.lit(0), F.lit(3), *entry(1025, zero, k % 2 + 1), *entry(3072, F.when(k % 3 == 0, 34737).otherwise(0), 32601 + k % 60), *entry(2048, zero, F.when(k % 2 == 0, 4326).otherwise(32767)))
    side = ((k % 5 + 1) / 2.0).cast("double")
    n = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    t = table(spark, d, "part").select("p_partkey", F.when(k % 7 > 0, F.array(side, side, F.lit(0.0))).alias("scale"), F.array(*[F.lit(0.0)] * 3, 500000.0 + k, F.lit(4e6), F.lit(0.0)).alias("tie"),
                                       F.when(k % 7 == 0, n(0.5, 0, 0, 300000, 0, -0.25, 0, 5000000, 0, 0, 0, 0, 0, 0, 0, 1)).alias("matrix"), georef.geo_keys(keys).alias("keys"))
    t = t.select("p_partkey", georef.tiff_transform(C("scale"), C("tie"), C("matrix"), C("keys")).alias("t"), georef.tiff_epsg(C("keys"), F.lit(None).cast("int")).alias("epsg"))
    return t.select("p_partkey", "t.a", "t.b", "t.c", "t.d", "t.e", "t.f", "epsg")


def sidecar_choice(spark, d):
    """The sidecar text that counts for each image."""
    k = C("p_partkey")
    some = F.filter(F.array(F.when(k % 2 == 0, "tfw"), F.when(k % 3 == 0, "JGW"), F.when(k % 5 == 0, "pgw"), F.when(k % 7 == 0, "prj"), F.lit("txt")), lambda x: x.isNotNull())
    files = table(spark, d, "part").select(k.alias("k"), F.explode(some).alias("x")).select(F.concat(F.lit("img/"), C("k").cast("string"), F.lit("."), "x").alias("path"), F.concat(F.lit(" text "), "x", F.lit(" ")).cast("binary").alias("content"))
    return georef.sidecars(files)


def manual_georeference(spark, d):
    """Bounds given by hand as a transform, resampled to another size, and their summary."""
    b = F.struct((C("lat") - 1).alias("s"), (C("lon") - 1).alias("w"), (C("lat") + 1).alias("n"), (C("lon") + 1).alias("e"))
    p = points(spark, d).select("id", b.alias("b"), geo.valid_bounds(b).alias("valid"))
    t = geo.resampled(geo.bounds_transform(C("b"), F.lit(256), F.lit(512)), F.lit(256), F.lit(512), F.lit(128), F.lit(128))
    p = p.select("id", "valid", t.alias("t"), georef.summary(F.lit("manual"), F.lit(4326), F.lit(1.23456), C("b")).alias("s"))
    return p.select("id", "valid", F.bround("t.a", 6).alias("a"), F.bround("t.c", 6).alias("c"), F.bround("t.e", 6).alias("e"), F.bround("t.f", 6).alias("f"), C("s.crs").alias("crs"), C("s.gsd_m").alias("gsd_m"), F.element_at("s.bounds", 1).alias("south"))


def national_grid(spark, d):
    """Customers as points of the 3-degree grids of Türkiye, with and without zone numbers, in degrees."""
    k = C("c_custkey")
    zone, numbered = (k % 7).cast("int"), k % 2 == 1
    x = C("c_acctbal").cast("double") * 10 + 500000 + F.when(numbered, (zone + 9) * 1000000.0).otherwise(0.0)
    c = table(spark, d, "customer").select(k, x.alias("x"), (k % 600 * 1000 + 3980000).cast("double").alias("y"), F.when(numbered, 5269 + zone).otherwise(5253 + zone).cast("int").alias("epsg"))
    c = c.select("c_custkey", "epsg", crs.to_lonlat(C("x"), C("y"), crs.from_epsg(C("epsg"))).alias("p"))
    return c.select("c_custkey", "epsg", F.bround("p.lon", 8).alias("lon"), F.bround("p.lat", 8).alias("lat"))


def conic_grid(spark, d):
    """Customers as points of the European conic grid, in degrees."""
    c = table(spark, d, "customer").select("c_custkey", (C("c_acctbal").cast("double") * 100 + 4000000).alias("x"), (C("c_custkey") % 2000 * 1000 + 2000000).cast("double").alias("y"))
    c = c.select("c_custkey", crs.to_lonlat(C("x"), C("y"), crs.from_epsg(F.lit(3034))).alias("p"))
    return c.select("c_custkey", F.bround("p.lon", 8).alias("lon"), F.bround("p.lat", 8).alias("lat"))


def prj_systems(spark, d):
    """Texts of .prj files of both WKT dialects that parts stand for, and what is read of them."""
    k = C("p_partkey")
    middle, east = (k % 40 * 3 - 60).cast("string"), (k % 9 * 100000 + 500000).cast("string")
    start = lambda name, sphere: F.concat(F.lit('PROJCS["'), C("p_name"), F.lit(f'",GEOGCS["g",DATUM["{name}",SPHEROID["s",{sphere}]],PRIMEM["Greenwich",0],UNIT["Degree",0.0174532925199433]],PROJECTION["'))
    rest = F.concat(F.lit('"],PARAMETER["Central_Meridian",'), middle, F.lit('],PARAMETER["False_Easting",'), east, F.lit('],PARAMETER["Scale_Factor",0.9996],UNIT["Meter",1]'))
    esri = F.concat(start("D_WGS_1984", "6378137,298.257223563"), F.lit("Transverse_Mercator"), rest, F.lit("]"))
    ogc = F.concat(start("European_Datum_1950", "6378388,297"), F.lit("Transverse_Mercator"), rest, F.lit(',AUTHORITY["EPSG","'), (k % 5000 + 2000).cast("string"), F.lit('"]]'))
    text = F.when(k % 5 == 0, F.concat(start("D_WGS_1984", "6378137,298.257223563"), F.lit("Albers"), rest, F.lit("]"))).when(k % 5 == 1, ogc).when(k % 5 == 2, F.concat(F.lit("EPSG:"), (k % 7 + 5253).cast("string"))).when(k % 5 == 3, esri).otherwise(F.substring(esri, 1, 90))
    c = wkt.system_of(text)
    t = table(spark, d, "part").select("p_partkey", c.alias("c"))
    return t.select("p_partkey", C("c.kind").alias("kind"), C("c.a").alias("a"), F.bround("c.lon0", 6).alias("lon0"), C("c.k0").alias("k0"), C("c.fe").alias("fe"), C("c.epsg").alias("epsg"), C("c.name").alias("name"), F.element_at("c.shift", 1).alias("shift_x"))



def _supplier_tiles(spark, d):
    """Tiles of both dates of every supplier's place, each a flat JPEG of a grey that its key tells; every seventh is missing and
    every eleventh is not readable."""
    k = C("s_suppkey")
    p = table(spark, d, "supplier").select(k.alias("id"), (k % 120 - 60).cast("double").alias("lat"), (k % 340 - 170).cast("double").alias("lon"), (k % 3 + 1).cast("int").alias("grid_size"), F.lit("2014").alias("year_t1"), F.lit("2024").alias("year_t2"))
    t = tiles.pair(p).withColumns({"number": C("ty") + C("tx") + C("epoch"), "grey": ((C("ty") + C("tx") + C("epoch")) % 97 + 60).cast("int")})
    files = spark.range(60, 157).select(C("id").cast("int").alias("grey"), jpeg.jpeg_of(F.lit(256), F.lit(256), F.unhex(F.repeat(F.format_string("%02x", C("id").cast("int")), 3 * 256 * 256))).alias("file"))
    file = F.when(C("number") % 11 == 0, F.lit("no image").cast("binary")).otherwise(C("file"))
    return t.join(F.broadcast(files), "grey").select(C("id").alias("scene"), "epoch", "grid_size", "row", "col", "number", "grey", F.when(C("number") % 7 != 0, file).alias("content"))  # 97 files


def tile_mosaic(spark, d):
    """Images of both dates put together from tiles: size, grey at the middle of each tile in order, and how many are placeholders."""
    b = tiles.mosaic(_supplier_tiles(spark, d).repartition(spark.sparkContext.defaultParallelism, "scene", "epoch", "row", "col"))  # few rows, much work
    byte = lambda i: F.conv(F.hex(F.substring("data", 3 * 4 * (128 * 256 + 128) + i, 1)), 16, 10).cast("int")
    sign, rest = byte(4), byte(3)  # of a float, the last byte first: exponent, and the leading bits of a whole number up to 255
    level = F.when(sign == 0, 0).otherwise(F.floor((rest.bitwiseAND(127) + 128) / F.pow(F.lit(2.0), 134 - (sign * 2 + F.shiftright(rest, 7)))))
    t = b.select("scene", "epoch", "h", "w", "is_placeholder", F.struct("y0", "x0", level.cast("int").alias("v")).alias("at"))
    t = t.groupBy("scene", "epoch").agg(F.max("h").alias("h"), F.max("w").alias("w"), F.count_if("is_placeholder").alias("placeholders"), F.sort_array(F.collect_list("at")).alias("all"))
    return t.select("scene", "epoch", "h", "w", "placeholders", F.array_join(F.transform("all", lambda x: x["v"]), ",").alias("greys"))



def epsg_codes(spark, d):
    k = C("p_partkey")
    text = F.when(k % 6 == 0, F.concat(F.lit("EPSG:"), (32600 + k % 80).cast("string"))).when(k % 6 == 1, "4326").when(k % 6 == 2, C("p_brand")).when(k % 6 == 3, " epsg: 3857 ").when(k % 6 == 4, F.lit("2154"))
    return table(spark, d, "part").select("p_partkey", georef.epsg_code(text).alias("e")).select("p_partkey", "e.code", "e.error")


def request_checks(spark, d):
    """Requests with their defaults, and what is wrong with them."""
    k = C("p_partkey")
    asked = table(spark, d, "part").select("p_partkey", F.when(k % 3 == 0, (k % 97) / 8.0).alias("lat"), F.when(k % 4 == 0, "ml").alias("engine"), F.when(k % 5 > 0, (k % 1200) / 10.0).alias("gsd"), F.when(k % 7 == 0, "deep").when(k % 7 == 1, "slow").alias("mode"))
    checked = asked.withColumns({"gsd_error": rules.gsd_error(C("gsd")), "mode_error": rules.mode_error(C("mode"))})
    return rules.with_defaults(checked, live=True).select("p_partkey", "lat", "lon", "engine", "gsd", "year_t2", "min_area_m2", "gsd_error", "mode_error")


def period_bars(spark, d):
    return timeline.bars(object_queries.period_type_summary(spark, d)).select("from", "to", "total", "uncertain", F.bround("share", 6).alias("share"))


_G = "coalesce(CASE WHEN id % 4 > 0 THEN CAST(id % 3 + 1 AS INTEGER) END, 2)"
_Y = {y: i for y, i, _, _ in catalogs.RELEASES}
_R1 = f"CASE id % 3 WHEN 1 THEN '{_Y['2016']}' ELSE '{_Y['2014']}' END"
_R2 = f"CASE WHEN id % 2 = 0 THEN '{_Y['2024']}' ELSE '{_Y['2026']}' END"
_TILES = f"""p AS (SELECT id, lat, lon, 17 AS zoom, {_G} AS g, {_R1} AS r1, {_R2} AS r2 FROM {POINTS}),
    o AS (SELECT *, CAST(floor({_TX} - g / 2 + 0.5) AS INTEGER) AS x, CAST(floor({_TY} - g / 2 + 0.5) AS INTEGER) AS y FROM p),
    e AS (SELECT id, g, x, y, r1 AS rel, 0 AS epoch FROM o UNION ALL SELECT id, g, x, y, r2, 1 FROM o),
    w AS (SELECT id, epoch, rel, a.i AS tr, b.j AS tc, y + a.i AS ty, x + b.j AS tx FROM e, range(0, 3) a(i), range(0, 3) b(j) WHERE a.i < g AND b.j < g),
    t AS (SELECT id, epoch, tr, tc, (ty + tx + CAST(rel AS INTEGER)) % 7 = 0 OR rel = '16453' AND ty < 40000 AS gone FROM w),
    m AS (SELECT id, count(*) FILTER (gone) AS missing, count(*) AS total FROM (SELECT id, tr, tc, bool_or(gone) AS gone FROM t GROUP BY ALL) GROUP BY id),
    n AS (SELECT id, bool_or(none) AS no_imagery FROM (SELECT id, epoch, bool_and(gone) AS none FROM t GROUP BY ALL) GROUP BY id)"""

#: The usual series with the third flattening of GRS 80 put in, to the fourth order.
_N = "(1 / 298.257222101 / (2 - 1 / 298.257222101))::DOUBLE"
_GEODETIC_SQL = "degrees(chi + (2 * n - 2 * n^2 / 3 - 2 * n^3 + 116 * n^4 / 45) * sin(2 * chi) + (7 * n^2 / 3 - 8 * n^3 / 5 - 227 * n^4 / 45) * sin(4 * chi) + (56 * n^3 / 15 - 136 * n^4 / 35) * sin(6 * chi) + 4279 * n^4 / 630 * sin(8 * chi))"
_TMERC_SQL = f"""WITH t AS (SELECT c_custkey, CAST(c_custkey % 7 AS INTEGER) AS zone, c_custkey % 2 = 1 AS numbered, CAST(c_acctbal AS DOUBLE) * 10 AS east, CAST(c_custkey % 600 * 1000 + 3980000 AS DOUBLE) AS y, {_N} AS n FROM customer),
    s AS (SELECT *, y / r AS xi, east / r AS eta FROM (SELECT *, 6378137.0::DOUBLE / (1 + n) * (1 + n^2 / 4 + n^4 / 64) AS r FROM t)),
    u AS (SELECT *, xi - b1 * sin(2 * xi) * cosh(2 * eta) - b2 * sin(4 * xi) * cosh(4 * eta) - b3 * sin(6 * xi) * cosh(6 * eta) - b4 * sin(8 * xi) * cosh(8 * eta) AS xi2,
                 eta - b1 * cos(2 * xi) * sinh(2 * eta) - b2 * cos(4 * xi) * sinh(4 * eta) - b3 * cos(6 * xi) * sinh(6 * eta) - b4 * cos(8 * xi) * sinh(8 * eta) AS eta2
          FROM (SELECT *, n / 2 - 2 * n^2 / 3 + 37 * n^3 / 96 - n^4 / 360 AS b1, n^2 / 48 + n^3 / 15 - 437 * n^4 / 1440 AS b2, 17 * n^3 / 480 - 37 * n^4 / 840 AS b3, 4397 * n^4 / 161280 AS b4 FROM s))
    SELECT c_custkey, CAST(CASE WHEN numbered THEN 5269 ELSE 5253 END + zone AS INTEGER) AS epsg, round_even(degrees(atan2(sinh(eta2), cos(xi2))) + 27 + 3 * zone, 8) AS lon, round_even({_GEODETIC_SQL}, 8) AS lat FROM (SELECT *, asin(sin(xi2) / cosh(eta2)) AS chi FROM u)"""
_CONIC_SQL = f"""WITH e AS (SELECT {_N} AS n, sqrt(1 / 298.257222101 * (2 - 1 / 298.257222101))::DOUBLE AS e),
    p AS (SELECT *, cos(radians(35)) / sqrt(1 - (e * sin(radians(35)))^2) AS m1, cos(radians(65)) / sqrt(1 - (e * sin(radians(65)))^2) AS m2,
                 asinh(tan(radians(35))) - e * atanh(e * sin(radians(35))) AS q1, asinh(tan(radians(65))) - e * atanh(e * sin(radians(65))) AS q2, asinh(tan(radians(52))) - e * atanh(e * sin(radians(52))) AS q0 FROM e),
    c AS (SELECT *, 6378137.0::DOUBLE * m1 / k * exp(k * q1) AS size FROM (SELECT *, (ln(m1) - ln(m2)) / (q2 - q1) AS k FROM p)),
    t AS (SELECT c_custkey, n, k, size, CAST(c_acctbal AS DOUBLE) * 100 AS east, size * exp(-k * q0) - (CAST(c_custkey % 2000 * 1000 + 2000000 AS DOUBLE) - 2800000) AS north FROM customer, c)
    SELECT c_custkey, round_even(degrees(atan2(east, north) / k) + 10, 8) AS lon, round_even({_GEODETIC_SQL}, 8) AS lat FROM (SELECT *, pi() / 2 - 2 * atan(exp(-ln(size / sqrt(east^2 + north^2)) / k)) AS chi FROM t)"""

QUERIES = {
    "tile_scan": (tile_scan, f"WITH {_TILES} SELECT id, missing, total, no_imagery, CASE WHEN missing > 0 THEN missing || '/' || total END AS note FROM m JOIN n USING (id)"),
    "usable_pairs": (usable_pairs, f"WITH {_TILES} SELECT id, CASE WHEN NOT no_imagery THEN missing END AS zeroed, CASE WHEN no_imagery THEN 'no_imagery' END AS error FROM m JOIN n USING (id) WHERE no_imagery OR missing > 0"),
    "release_lookup": (release_lookup, f"SELECT id, {_R1} AS r1, {_R2} AS r2 FROM {POINTS}"),
    "metadata_requests": (metadata_requests, f"""SELECT id, year, 'http://m/' || year || '/6/query?geometry=' || url_encode(CAST(lon AS VARCHAR) || ',' || CAST(lat AS VARCHAR)) || '&geometryType=esriGeometryPoint&inSR=4326&spatialRel=esriSpatialRelIntersects&outFields={"%2C".join(captures.ATTRIBUTES)}&returnGeometry=false&f=json' AS url
        FROM {POINTS}, (VALUES {", ".join(f"('{y}')" for y in _Y if y != "2020")}) y(year)"""),
    "capture_lookup": (capture_lookup, """WITH c AS (SELECT event_id, event_id % 5 AS k, event_type, (event_id % 100 + 1) / 100.0::DOUBLE AS res FROM events)
        SELECT event_id, CASE k WHEN 1 THEN strftime(make_timestamp((event_id * 86400000 + 1000000000000) * 1000), '%Y-%m-%d') WHEN 2 THEN '2011-05-06' END AS date, CASE k WHEN 1 THEN event_type WHEN 2 THEN 'Maxar' END AS source,
               CASE WHEN k IN (1, 2) THEN round_even(res, 2) END AS resolution_m, k IN (1, 2) AND round_even(res, 2) > 0.6 AS low FROM c"""),
    "tiff_georeference": (tiff_georeference, """WITH t AS (SELECT p_partkey AS k, p_partkey % 7 = 0 AS m, p_partkey % 2 = 1 AS pt, CAST((p_partkey % 5 + 1) / 2.0 AS DOUBLE) AS s FROM part),
        v AS (SELECT k, pt, CASE WHEN m THEN 0.5::DOUBLE ELSE s END AS a, CASE WHEN m THEN 300000.0::DOUBLE ELSE 500000.0::DOUBLE + k END AS c, CASE WHEN m THEN -0.25::DOUBLE ELSE -s END AS e, CASE WHEN m THEN 5e6 ELSE 4e6 END AS f FROM t)
        SELECT k AS p_partkey, a, 0.0::DOUBLE AS b, c - CASE WHEN pt THEN a / 2 ELSE 0 END AS c, 0.0::DOUBLE AS d, e, f - CASE WHEN pt THEN e / 2 ELSE 0 END AS f,
               CAST(CASE WHEN k % 3 > 0 THEN 32601 + k % 60 WHEN k % 2 = 0 THEN 4326 END AS INTEGER) AS epsg FROM v"""),
    "sidecar_choice": (sidecar_choice, "SELECT 'img/' || p_partkey AS stem, ' text ' || CASE WHEN p_partkey % 3 = 0 THEN 'JGW' WHEN p_partkey % 2 = 0 THEN 'tfw' WHEN p_partkey % 5 = 0 THEN 'pgw' END || ' ' AS world, CASE WHEN p_partkey % 7 = 0 THEN 'text prj' END AS prj FROM part"),
    "manual_georeference": (manual_georeference, f"SELECT id, lon - 1 >= -180 AND lon + 1 <= 180 AS valid, 0.015625::DOUBLE AS a, round_even(CAST(lon - 1 AS DOUBLE), 6) AS c, -0.015625::DOUBLE AS e, round_even(CAST(lat + 1 AS DOUBLE), 6) AS f, 'EPSG:4326' AS crs, 1.235::DOUBLE AS gsd_m, round_even(CAST(lat - 1 AS DOUBLE), 7) AS south FROM {POINTS}"),
    "tile_mosaic": (tile_mosaic, f"""WITH p AS (SELECT s_suppkey AS scene, CAST(s_suppkey % 120 - 60 AS DOUBLE) AS lat, CAST(s_suppkey % 340 - 170 AS DOUBLE) AS lon, CAST(s_suppkey % 3 + 1 AS INTEGER) AS n FROM supplier),
        o AS (SELECT *, CAST(floor((lon + 180) / 360 * 131072 - n / 2.0 + 0.5) AS BIGINT) AS x, CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 131072 - n / 2.0 + 0.5) AS BIGINT) AS y FROM p),
        t AS (SELECT scene, n, epoch, r.i AS r, c.i AS c, y + r.i + x + c.i + epoch AS number FROM o, (SELECT unnest(range(3)) AS i) r, (SELECT unnest(range(3)) AS i) c, (SELECT unnest(range(2)) AS epoch) WHERE r.i < n AND c.i < n)
        SELECT scene, CAST(epoch AS INTEGER) AS epoch, CAST(max(n) * 256 AS INTEGER) AS h, CAST(max(n) * 256 AS INTEGER) AS w, count(*) FILTER (number % 7 = 0 OR number % 11 = 0) AS placeholders,
               string_agg(CASE WHEN number % 7 = 0 OR number % 11 = 0 THEN 200 ELSE number % 97 + 60 END, ',' ORDER BY r, c) AS greys FROM t GROUP BY scene, epoch"""),
    "national_grid": (national_grid, _TMERC_SQL),
    "conic_grid": (conic_grid, _CONIC_SQL),
    "prj_systems": (prj_systems, """WITH t AS (SELECT p_partkey, p_name, p_partkey % 5 AS k, p_partkey % 40 * 3 - 60 AS lon0, p_partkey % 9 * 100000 + 500000 AS fe FROM part)
        SELECT p_partkey, CASE WHEN k IN (1, 2, 3) THEN 'tmerc' END AS kind, CASE k WHEN 1 THEN 6378388.0 WHEN 2 THEN 6378137.0 WHEN 3 THEN 6378137.0 END::DOUBLE AS a, CAST(CASE k WHEN 1 THEN lon0 WHEN 2 THEN p_partkey % 7 * 3 + 27 WHEN 3 THEN lon0 END AS DOUBLE) AS lon0,
               CAST(CASE k WHEN 1 THEN 0.9996 WHEN 2 THEN 1 WHEN 3 THEN 0.9996 END AS DOUBLE) AS k0, CAST(CASE k WHEN 1 THEN fe WHEN 2 THEN 500000 WHEN 3 THEN fe END AS DOUBLE) AS fe, CAST(CASE k WHEN 1 THEN p_partkey % 5000 + 2000 WHEN 2 THEN p_partkey % 7 + 5253 END AS INTEGER) AS epsg,
               CASE WHEN k IN (1, 3) THEN p_name END AS name, CAST(CASE WHEN k = 1 THEN -84.1 END AS DOUBLE) AS shift_x FROM t"""),
    "epsg_codes": (epsg_codes, """WITH t AS (SELECT p_partkey, p_partkey % 6 AS k, 32600 + p_partkey % 80 AS utm FROM part)
        SELECT p_partkey, CAST(CASE k WHEN 0 THEN CASE WHEN utm BETWEEN 32601 AND 32660 THEN utm END WHEN 1 THEN 4326 WHEN 3 THEN 3857 END AS INTEGER) AS code,
               CASE k WHEN 0 THEN CASE WHEN utm NOT BETWEEN 32601 AND 32660 THEN 'epsg_unsupported' END WHEN 2 THEN 'epsg_invalid' WHEN 4 THEN 'epsg_unsupported' END AS error FROM t"""),
    "request_checks": (request_checks, """WITH t AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 > 0 THEN CAST((p_partkey % 1200) / 10.0 AS DOUBLE) END AS g FROM part)
        SELECT k AS p_partkey, coalesce(CASE WHEN k % 3 = 0 THEN CAST((k % 97) / 8.0 AS DOUBLE) END, 41.107::DOUBLE) AS lat, 28.79::DOUBLE AS lon, CASE WHEN k % 4 = 0 THEN 'ml' ELSE 'classic' END AS engine, coalesce(g, 0.5::DOUBLE) AS gsd, '2026' AS year_t2, 40.0::DOUBLE AS min_area_m2,
               CASE WHEN g IS NOT NULL AND NOT g BETWEEN 0.01 AND 100 THEN 'gsd' END AS gsd_error, CASE WHEN k % 7 = 1 THEN 'analysis_mode' END AS mode_error FROM t"""),
    "period_bars": (period_bars, f"""WITH s AS ({object_queries.QUERIES["period_type_summary"][1]}), t AS (SELECT "from", "to", CAST(new + demolished + rebuilt AS BIGINT) AS total FROM s)
        SELECT "from", "to", total, "from" IS NULL AS uncertain, round_even(total / max(total) OVER (), 6) AS share FROM t WHERE total > 0"""),
}
