"""Projections against the worked examples of the public guidance note on coordinate conversions, and texts of .prj files."""

import pytest
from pyspark.sql import functions as F

from rasterlane.functions import crs, geo, projection
from rasterlane.sources import georef, wkt

AIRY, CLARKE, BESSEL = (6377563.396, 299.32496), (6378206.4, 294.978698214), (6377397.155, 299.15281)
FOOT = 0.304800609601219
dms = lambda d, m=0, s=0.0: (abs(d) + m / 60 + s / 3600) * (1 if d >= 0 else -1)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("system,x,y,lon,lat", [
    (lambda: crs.system("tmerc", AIRY, -2.0, 49.0, 0.9996012717, 400_000.0, -100_000.0), 577274.99, 69740.50, 0.5, 50.5),
    (lambda: crs.system("lcc", CLARKE, -99.0, dms(27, 50), 1.0, 2_000_000 * FOOT, 0.0, dms(28, 23), dms(30, 17), FOOT), 2963503.91, 254759.80, -96.0, 28.5),
    (lambda: crs.system("lcc", CLARKE, -77.0, 18.0, 1.0, 250_000.0, 150_000.0), 255966.58, 142493.51, dms(-76, 56, 37.26), dms(17, 55, 55.80)),
    (lambda: crs.system("merc", BESSEL, 110.0, 0.0, 0.997, 3_900_000.0, 900_000.0), 5009726.58, 569150.82, 120.0, -3.0),
    (lambda: crs.system("longlat", lon0=2.5), 1.0, 2.0, 3.5, 2.0),
])
def test_published_points(spark, system, x, y, lon, lat):
    p = one(spark, p=crs.to_lonlat(F.lit(x), F.lit(y), system())).p
    assert abs(p.lon - lon) < 2e-7 and abs(p.lat - lat) < 2e-7  # the examples are given to a centimetre


def test_helmert(spark):
    point = F.struct(F.lit(3657660.66).alias("x"), F.lit(255768.55).alias("y"), F.lit(5201382.11).alias("z"))
    p = one(spark, p=crs.helmert(point, F.array(*[F.lit(v) for v in (0.0, 0.0, 4.5, 0.0, 0.0, 0.554, 0.219)]))).p
    assert all(abs(a - b) < 0.011 for a, b in zip(p, (3657660.78, 255778.43, 5201387.75)))  # given to a centimetre
    back = one(spark, p=crs._on_wgs84(crs.geocentric(F.lit(29.0), F.lit(41.0), F.lit(crs.WGS84[0]), F.lit(1 / crs.WGS84[1])))).p
    assert abs(back.lon - 29) < 1e-11 and abs(back.lat - 41) < 1e-11


def points(spark, rows):
    """What becomes of (epsg, x, y): the engine's point and that of the fixed grids, by code."""
    t = spark.createDataFrame(rows, "epsg int, x double, y double")
    return {r.epsg: r for r in t.select("epsg", crs.to_lonlat(F.col("x"), F.col("y"), crs.from_epsg(F.col("epsg"))).alias("p"), projection.to_lonlat(F.col("x"), F.col("y"), F.col("epsg")).alias("q")).collect()}


def test_codes(spark):
    """The fixed grids agree; a point on a middle meridian keeps its longitude; zones only add their number; ED50 lies some 50 m west
    and 150 m south; other codes are null."""
    fixed = [(c, *((28.5, 41.0) if c == 4326 else (650000.0, 4550000.0))) for c in (4326, 3857, 32635, 32735, 32601, 32760)]
    grids = [(first + i, 500_000.0 + (zone + i) * 1_000_000 * (zone > 0), 4_500_000.0) for first, zone in ((5253, 0), (5269, 9)) for i in range(7)]
    got = points(spark, fixed + grids + [(2320, 500_000.0, 4_500_000.0), (9999, 1.0, 1.0)])
    for c, *_ in fixed:
        p, q = got[c].p, got[c].q
        assert abs(p.lon - q.lon) < 1e-8 and abs(p.lat - q.lat) < 1e-8  # series of other orders: a millimetre
    for c, *_ in grids:
        assert abs(got[c].p.lon - (27 + 3 * ((c - 5253) % 16))) < 1e-12 and 40.6 < got[c].p.lat < 40.7
    a, b = got[5254].p, got[2320].p
    assert 2e-4 < a.lon - b.lon < 1e-3 and 1e-3 < a.lat - b.lat < 3e-3
    assert got[9999].p is None and got[5254].q is None


ESRI = 'PROJCS["WGS_1984_UTM_Zone_35N",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",27.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'
WKT2 = '''PROJCRS["WGS 84 / UTM zone 35N",BASEGEOGCRS["WGS 84",ENSEMBLE["World Geodetic System 1984 ensemble",MEMBER["World Geodetic System 1984 (Transit)"],ELLIPSOID["WGS 84",6378137,298.257223563,LENGTHUNIT["metre",1]],ENSEMBLEACCURACY[2.0]],PRIMEM["Greenwich",0,ANGLEUNIT["degree",0.0174532925199433]],ID["EPSG",4326]],
 CONVERSION["UTM zone 35N",METHOD["Transverse Mercator",ID["EPSG",9807]],PARAMETER["Latitude of natural origin",0,ANGLEUNIT["degree",0.0174532925199433],ID["EPSG",8801]],PARAMETER["Longitude of natural origin",27,ANGLEUNIT["degree",0.0174532925199433]],PARAMETER["Scale factor at natural origin",0.9996,SCALEUNIT["unity",1]],PARAMETER["False easting",500000,LENGTHUNIT["metre",1]],PARAMETER["False northing",0,LENGTHUNIT["metre",1]]],
 CS[Cartesian,2],AXIS["(E)",east,ORDER[1],LENGTHUNIT["metre",1]],AXIS["(N)",north,ORDER[2],LENGTHUNIT["metre",1]],USAGE[SCOPE["x"],AREA["y"],BBOX[0,24,84,30]],ID["EPSG",32635]]'''
FEET = f'PROJCS["ft",GEOGCS["g",DATUM["d",SPHEROID["Clarke 1866",6378206.4,294.978698214]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["Lambert_Conformal_Conic_2SP"],PARAMETER["standard_parallel_1",{dms(28, 23)}],PARAMETER["standard_parallel_2",{dms(30, 17)}],PARAMETER["latitude_of_origin",{dms(27, 50)}],PARAMETER["central_meridian",-99],PARAMETER["false_easting",2000000],PARAMETER["false_northing",0],UNIT["US survey foot",{FOOT}]]'
GRADS = 'GEOGCS["NTF (Paris)",DATUM["NTF",SPHEROID["Clarke 1880 (IGN)",6378249.2,293.4660212936269],TOWGS84[-168,-60,320]],PRIMEM["Paris",2.5969213],UNIT["grad",0.01570796326794897]]'
BOUND = f'BOUNDCRS[SOURCECRS[{WKT2}],TARGETCRS[GEOGCRS["WGS 84"]],ABRIDGEDTRANSFORMATION["t",METHOD["Position Vector transformation (geog2D domain)"],PARAMETER["X-axis translation",1],PARAMETER["Y-axis translation",2],PARAMETER["Z-axis translation",3],PARAMETER["Z-axis rotation",0.5],PARAMETER["Scale difference",1.000001]]]'


def test_texts(spark):
    for text, code in ((ESRI, None), (WKT2, 32635), (ESRI.replace("[", "(").replace("]", ")"), None)):
        f = wkt.fields(text)
        assert (f["kind"], f["lon0"], f["k0"], f["fe"], f["unit"], f["epsg"], f["shift"]) == ("tmerc", 27.0, 0.9996, 500000.0, 1.0, code, None)
    paris = wkt.fields(GRADS)
    assert paris["kind"] == "longlat" and abs(paris["unit"] - 0.9) < 1e-12 and abs(paris["lon0"] - 2.33722917) < 1e-8 and paris["shift"] == [-168, -60, 320, 0, 0, 0, 0]
    assert [round(v, 6) for v in wkt.fields(BOUND)["shift"]] == [1, 2, 3, 0, 0, 0.5, 1]
    assert wkt.fields("+proj=utm +zone=35 +south +datum=WGS84")["fn"] == 10_000_000 and wkt.fields("+proj=aea +lat_1=1") is None
    assert wkt.fields(ESRI.replace("D_WGS_1984", "D_European_1950"))["shift"] == list(crs.ED50_SHIFT)
    for bad in ("", "x", "[", "]", 'PROJCS["a"', ESRI[:-1], ESRI + "]", ESRI.replace("Transverse_Mercator", "Albers"), 'GEOGCS["g"]', '"x"', "A[" * 500, 'LOCAL_CS["x",UNIT["m",1]]'):
        assert wkt.fields(bad) is None
    rows = spark.createDataFrame([(1, FEET), (2, None), (3, "junk"), (4, "EPSG:5254"), (5, "EPSG:1")], "id int, t string")
    got = {r.id: r.p for r in rows.select("id", crs.to_lonlat(F.lit(2963503.91), F.lit(254759.80), wkt.system_of(F.col("t"))).alias("p")).collect()}
    assert abs(got[1].lon + 96) < 2e-7 and abs(got[1].lat - 28.5) < 2e-7 and got[2] is None and got[3] is None and got[5] is None and got[4] is not None


def test_georeferences_read_prj_texts(spark):
    i = spark.createDataFrame([(f"/a/{n}.jpg", bytearray(b""), e, 60, 40) for n, e in (("esri", None), ("tm", 5254), ("bad", None), ("aea", None), ("code", None))], "path string, content binary, epsg int, width int, height int")
    world = b"0.5\n0\n0\n-0.5\n500000\n4550000\n"
    files = [(f"/a/{n}.jgw", bytearray(world)) for n in ("esri", "tm", "bad", "aea", "code")]
    files += [("/a/esri.prj", bytearray(ESRI.encode())), ("/a/tm.prj", bytearray(b"junk")), ("/a/bad.prj", bytearray(b"junk")), ("/a/aea.prj", bytearray(ESRI.replace("Transverse_Mercator", "Albers").encode())), ("/a/code.prj", bytearray(WKT2.encode()))]
    got = {r.path[3:-4]: r for r in georef.georeferences(i, spark.createDataFrame(files, "path string, content binary")).collect()}
    for n in ("esri", "code"):
        g = got[n]
        assert g.error is None and g.source == "worldfile" and abs(g.gsd_m - 0.5) < 0.005
        assert 41.0 < g.bounds.s < g.bounds.n < 41.2 and 26.9 < g.bounds.w < g.bounds.e < 27.1
    assert got["code"].epsg == 32635 and got["esri"].epsg is None and got["esri"].crs_name == "WGS_1984_UTM_Zone_35N"
    assert got["tm"].epsg == 5254 and 29.9 < got["tm"].bounds.w < 30.1
    assert got["bad"].error == got["aea"].error == "crs_unknown"


def test_gsd_of_a_national_grid(spark):
    t = geo.affine(*[F.lit(v) for v in (0.5, 0.0, 520000.0, 0.0, -0.5, 4550000.0)])
    r = one(spark, g=crs.image_gsd(t, F.lit(200), F.lit(100), crs.from_epsg(F.lit(5254))), b=crs.image_bounds(t, F.lit(200), F.lit(100), crs.from_epsg(F.lit(5254))))
    assert abs(r.g - 0.5) < 0.002 and 30.2 < r.b.w < r.b.e < 30.3
