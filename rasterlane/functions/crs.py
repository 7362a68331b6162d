"""Coordinate systems with free parameters, and their points as WGS 84 degrees, as Column expressions.

A system is a struct: kind (longlat, tmerc, lcc, merc, webmerc), semi-major axis a and flattening f of its ellipsoid, lon0 and lat0,
k0, false easting and northing fe and fn (in metres), standard parallels sp1 and sp2, unit (metres or degrees a unit), shift (seven
numbers to WGS 84 as a position vector: metres, arc seconds, parts per million; null for none), epsg and name. It comes from a code
(`from_epsg`) or from the text of a .prj file (`rasterlane.sources.wkt`). Systems of other kinds are null.

Conformal latitudes and the transverse Mercator use the usual series in the third flattening to the fourth order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlane.functions import projection
from rasterlane.functions.geo import let

_KINDS = {"kind": T.StringType(), "shift": T.ArrayType(T.DoubleType()), "epsg": T.IntegerType(), "name": T.StringType()}
SCHEMA = T.StructType([T.StructField(n, _KINDS.get(n, T.DoubleType())) for n in ("kind", "a", "f", "lon0", "lat0", "k0", "fe", "fn", "sp1", "sp2", "unit", "shift", "epsg", "name")])
#: Ellipsoids (semi-major axis, inverse flattening) and the shift of ED50 in Türkiye.
WGS84, GRS80, INTERNATIONAL = (6378137.0, 298.257223563), (6378137.0, 298.257222101), (6378388.0, 297.0)
ED50_SHIFT = (-84.1, -101.8, -129.7, 0.0, 0.0, 0.468, 1.05)
SECOND = 4.84813681109536e-06  # radians


def system(kind: str, ellipsoid: tuple[float, float] = WGS84, lon0=0.0, lat0=0.0, k0=1.0, fe=0.0, fn=0.0, sp1=None, sp2=None, unit=1.0, shift=None, epsg=None, name: str | None = None) -> Column:
    """A system of numbers or columns."""
    number = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    moved = F.array(*[F.lit(float(v)) for v in shift]) if shift else F.lit(None)
    values = {"kind": F.lit(kind), "a": number(ellipsoid[0]), "f": number(1 / ellipsoid[1] if ellipsoid[1] else 0.0), "lon0": number(lon0), "lat0": number(lat0), "k0": number(k0), "fe": number(fe), "fn": number(fn),
              "sp1": number(sp1), "sp2": number(sp2), "unit": number(unit), "shift": moved.cast("array<double>"), "epsg": (epsg if isinstance(epsg, Column) else F.lit(epsg)).cast("int"), "name": F.lit(name)}
    return F.struct(*[v.alias(k) for k, v in values.items()]).cast(SCHEMA)


#: Fixed values of the codes: first and last code, kind, ellipsoid, lon0 of the first and step a code, false easting of the first and
#: step a code, k0, false northing, shift; then the conic's lat0 and parallels.
_CODES = [
    (4326, 4326, "longlat", WGS84, 0, 0, 0, 0, 1, 0, None),
    (4258, 4258, "longlat", GRS80, 0, 0, 0, 0, 1, 0, None),
    (5252, 5252, "longlat", GRS80, 0, 0, 0, 0, 1, 0, None),
    (4230, 4230, "longlat", INTERNATIONAL, 0, 0, 0, 0, 1, 0, ED50_SHIFT),
    (3857, 3857, "webmerc", WGS84, 0, 0, 0, 0, 1, 0, None),
    (3395, 3395, "merc", WGS84, 0, 0, 0, 0, 1, 0, None),
    (32601, 32660, "tmerc", WGS84, -177, 6, 500_000, 0, 0.9996, 0, None),
    (32701, 32760, "tmerc", WGS84, -177, 6, 500_000, 0, 0.9996, 10_000_000, None),
    (25828, 25838, "tmerc", GRS80, -15, 6, 500_000, 0, 0.9996, 0, None),
    (23028, 23038, "tmerc", INTERNATIONAL, -15, 6, 500_000, 0, 0.9996, 0, ED50_SHIFT),
    (5253, 5259, "tmerc", GRS80, 27, 3, 500_000, 0, 1, 0, None),
    (2319, 2325, "tmerc", INTERNATIONAL, 27, 3, 500_000, 0, 1, 0, ED50_SHIFT),
    (5269, 5275, "tmerc", GRS80, 27, 3, 9_500_000, 1_000_000, 1, 0, None),
    (2206, 2212, "tmerc", INTERNATIONAL, 27, 3, 9_500_000, 1_000_000, 1, 0, ED50_SHIFT),
    (3034, 3034, "lcc", GRS80, 10, 0, 4_000_000, 0, 1, 2_800_000, None),
]
_CONIC = (52.0, 35.0, 65.0)


def from_epsg(code: Column) -> Column:
    """The system of a code: degrees of WGS 84, TUREF, ETRS89 and ED50; 3857 and 3395; UTM on WGS 84, ETRS89 and ED50; the 3-degree
    grids of Türkiye with and without zone numbers on TUREF and ED50; the European conic grid. Null for others."""
    names = ("first", "last", "kind", "a", "f", "lon0", "step", "fe", "fe_step", "k0", "fn", "shift")
    known = F.array(*[F.struct(*[(F.lit(v) if isinstance(v, str) else F.lit(v).cast("array<double>") if n == "shift" and v is None else F.array(*[F.lit(x) for x in v]) if n == "shift" else F.lit(float(v))).alias(n) for n, v in zip(names, (*r[:3], r[3][0], 1 / r[3][1], *r[4:]))]) for r in _CODES])

    def of(v: Column) -> Column:
        r, number = v["r"], v["code"] - v["r"]["first"]
        conic = lambda i: F.when(r["kind"] == "lcc", _CONIC[i])
        values = {"kind": r["kind"], "a": r["a"], "f": r["f"], "lon0": r["lon0"] + r["step"] * number, "lat0": F.coalesce(conic(0), F.lit(0.0)), "k0": r["k0"], "fe": r["fe"] + r["fe_step"] * number, "fn": r["fn"],
                  "sp1": conic(1), "sp2": conic(2), "unit": F.lit(1.0), "shift": r["shift"], "epsg": v["code"].cast("int"), "name": F.lit(None).cast("string")}
        return F.when(r.isNotNull(), F.struct(*[x.alias(n) for n, x in values.items()]))

    row = F.try_element_at(F.filter(known, lambda r: code.between(r["first"], r["last"])), F.lit(1))
    return let(F.struct(code.alias("code"), row.alias("r")), of)


def _polynomial(n: Column, *coefficients: float) -> Column:
    """c1 n + c2 n^2 + ..."""
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = (out + c) * n
    return out


_TO_GEODETIC = ((2, -2 / 3, -2, 116 / 45), (0, 7 / 3, -8 / 5, -227 / 45), (0, 0, 56 / 15, -136 / 35), (0, 0, 0, 4279 / 630))
_TO_SPHERE = ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280))
_FROM_SPHERE = ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280))


def _third(f: Column) -> Column:
    return f / (2 - f)


def _eccentricity(f: Column) -> Column:
    return F.sqrt(f * (2 - f))


def _isometric(lat: Column, f: Column) -> Column:
    """Isometric latitude of a geodetic one, both in radians."""
    e = _eccentricity(f)
    return F.asinh(F.tan(lat)) - e * F.atanh(e * F.sin(lat))


def _geodetic(chi: Column, f: Column) -> Column:
    """Geodetic latitude of a conformal one, in radians."""
    return let(F.struct(chi.alias("chi"), _third(f).alias("n")), lambda v: sum((_polynomial(v["n"], *c) * F.sin(2 * j * v["chi"]) for j, c in enumerate(_TO_GEODETIC, 1)), v["chi"]))


def _lonlat(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def _tmerc(x: Column, y: Column, c: Column) -> Column:
    """lon, lat in degrees on the system's ellipsoid; so are those of the other kinds."""

    def start(v: Column) -> Column:  # the northing of lat0 on the sphere
        chi = F.atan(F.sinh(_isometric(F.radians(v["c"]["lat0"]), v["c"]["f"])))
        return let(F.struct(chi.alias("chi"), v["n"].alias("n")), lambda w: sum((_polynomial(w["n"], *a) * F.sin(2 * j * w["chi"]) for j, a in enumerate(_FROM_SPHERE, 1)), w["chi"]))

    def flat(v: Column) -> Column:
        radius = v["c"]["k0"] * v["c"]["a"] / (1 + v["n"]) * (1 + v["n"] ** 2 / 4 + v["n"] ** 4 / 64)
        return F.struct(((v["y"] - v["c"]["fn"]) / radius + F.when(v["c"]["lat0"] == 0, 0.0).otherwise(start(v))).alias("xi"), ((v["x"] - v["c"]["fe"]) / radius).alias("eta"), v["n"].alias("n"), v["c"].alias("c"))

    def sphere(v: Column) -> Column:
        xi, eta = v["xi"], v["eta"]
        for j, b in enumerate(_TO_SPHERE, 1):
            xi = xi - _polynomial(v["n"], *b) * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
            eta = eta - _polynomial(v["n"], *b) * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])
        return F.struct(xi.alias("xi"), eta.alias("eta"), v["c"].alias("c"))

    def angles(v: Column) -> Column:
        return _lonlat(F.degrees(F.atan2(F.sinh(v["eta"]), F.cos(v["xi"]))) + v["c"]["lon0"], F.degrees(_geodetic(F.asin(F.sin(v["xi"]) / F.cosh(v["eta"])), v["c"]["f"])))

    return let(let(let(F.struct(x.alias("x"), y.alias("y"), c.alias("c"), _third(c["f"]).alias("n")), flat), sphere), angles)


def _lcc(x: Column, y: Column, c: Column) -> Column:
    """One parallel is two that are equal: lat0 where sp1 is null."""
    half_turn = F.pi() / 2

    def m(lat: Column, f: Column) -> Column:
        return F.cos(lat) / F.sqrt(1 - F.pow(_eccentricity(f) * F.sin(lat), 2))

    def cone(v: Column) -> Column:
        c = v["c"]
        first, second = F.radians(F.coalesce(c["sp1"], c["lat0"])), F.radians(F.coalesce(c["sp2"], c["sp1"], c["lat0"]))
        n = F.when(F.abs(first - second) < 1e-10, F.sin(first)).otherwise((F.log(m(first, c["f"])) - F.log(m(second, c["f"]))) / (_isometric(second, c["f"]) - _isometric(first, c["f"])))
        return F.struct(v["x"].alias("x"), v["y"].alias("y"), c.alias("c"), n.alias("n"), first.alias("first"))

    def scale(v: Column) -> Column:  # radius of the isometric latitude 0
        size = v["c"]["a"] * v["c"]["k0"] * m(v["first"], v["c"]["f"]) / v["n"] * F.exp(v["n"] * _isometric(v["first"], v["c"]["f"]))
        pole = F.abs(v["c"]["lat0"]) >= 90 - 1e-12
        return F.struct(v["x"].alias("x"), v["y"].alias("y"), v["c"].alias("c"), v["n"].alias("n"), size.alias("size"), F.when(pole, 0.0).otherwise(size * F.exp(-v["n"] * _isometric(F.radians(v["c"]["lat0"]), v["c"]["f"]))).alias("r0"))

    def polar(v: Column) -> Column:
        east, north = v["x"] - v["c"]["fe"], v["r0"] - (v["y"] - v["c"]["fn"])
        sign = F.signum(v["n"])
        return F.struct(F.atan2(sign * east, sign * north).alias("theta"), (F.log(F.abs(v["size"]) / F.hypot(east, north)) / v["n"]).alias("psi"), v["n"].alias("n"), v["c"].alias("c"))

    def angles(v: Column) -> Column:
        return _lonlat(F.degrees(v["theta"] / v["n"]) + v["c"]["lon0"], F.degrees(_geodetic(half_turn - 2 * F.atan(F.exp(-v["psi"])), v["c"]["f"])))

    return let(let(let(let(F.struct(x.alias("x"), y.alias("y"), c.alias("c")), cone), scale), polar), angles)


def _merc(x: Column, y: Column, c: Column) -> Column:
    """A standard parallel takes the place of k0."""
    lat = F.radians(c["sp1"])
    k0 = F.when(c["sp1"].isNull(), c["k0"]).otherwise(F.cos(lat) / F.sqrt(1 - F.pow(_eccentricity(c["f"]) * F.sin(lat), 2)))
    radius = c["a"] * k0
    north = (y - c["fn"]) / radius + F.when(c["lat0"] == 0, 0.0).otherwise(_isometric(F.radians(c["lat0"]), c["f"]))
    return _lonlat(F.degrees((x - c["fe"]) / radius) + c["lon0"], F.degrees(_geodetic(F.atan(F.sinh(north)), c["f"])))


def _webmerc(x: Column, y: Column, c: Column) -> Column:
    return _lonlat(F.degrees((x - c["fe"]) / c["a"]) + c["lon0"], F.degrees(F.atan(F.sinh((y - c["fn"]) / c["a"]))))


def geocentric(lon: Column, lat: Column, a: Column, f: Column) -> Column:
    """struct x, y, z in metres of a point at height 0 on an ellipsoid."""
    e2 = f * (2 - f)
    normal = a / F.sqrt(1 - e2 * F.pow(F.sin(F.radians(lat)), 2))
    return F.struct((normal * F.cos(F.radians(lat)) * F.cos(F.radians(lon))).alias("x"), (normal * F.cos(F.radians(lat)) * F.sin(F.radians(lon))).alias("y"), (normal * (1 - e2) * F.sin(F.radians(lat))).alias("z"))


def helmert(p: Column, shift: Column) -> Column:
    """A geocentric point moved by seven numbers, rotations as of a position vector."""
    s = lambda i: F.element_at(shift, i)
    rx, ry, rz = (s(i) * SECOND for i in (4, 5, 6))
    k = 1 + s(7) * 1e-6
    return F.struct((s(1) + k * (p["x"] - rz * p["y"] + ry * p["z"])).alias("x"), (s(2) + k * (rz * p["x"] + p["y"] - rx * p["z"])).alias("y"), (s(3) + k * (rx * p["y"] - ry * p["x"] + p["z"])).alias("z"))


def _on_wgs84(p: Column) -> Column:
    """Degrees of a geocentric point, whatever its height, by Bowring's formula."""
    f = 1 / WGS84[1]
    a, b, e2 = WGS84[0], WGS84[0] * (1 - f), f * (2 - f)

    def of(v: Column) -> Column:
        t = F.atan2(v["p"]["z"] * a, v["r"] * b)
        lat = F.atan2(v["p"]["z"] + e2 / (1 - e2) * b * F.pow(F.sin(t), 3), v["r"] - e2 * a * F.pow(F.cos(t), 3))
        return _lonlat(F.degrees(F.atan2(v["p"]["y"], v["p"]["x"])), F.degrees(lat))

    return let(F.struct(p.alias("p"), F.hypot(p["x"], p["y"]).alias("r")), of)


def to_lonlat(x: Column, y: Column, c: Column) -> Column:
    """struct lon, lat in degrees of WGS 84; null where the system is."""

    def metres(v: Column) -> Column:
        return F.struct((v["x"] * v["c"]["unit"]).alias("x"), (v["y"] * v["c"]["unit"]).alias("y"), v["c"].alias("c"))

    def own(v: Column) -> Column:
        kind, args = v["c"]["kind"], (v["x"], v["y"], v["c"])
        plain = _lonlat(v["x"] + v["c"]["lon0"], v["y"])
        return F.struct(F.when(kind == "longlat", plain).when(kind == "tmerc", _tmerc(*args)).when(kind == "lcc", _lcc(*args)).when(kind == "merc", _merc(*args)).when(kind == "webmerc", _webmerc(*args)).alias("p"), v["c"].alias("c"))

    def shifted(v: Column) -> Column:
        moved = let(geocentric(v["p"]["lon"], v["p"]["lat"], v["c"]["a"], v["c"]["f"]), lambda p: _on_wgs84(helmert(p, v["c"]["shift"])))
        return F.when(v["c"]["shift"].isNull(), v["p"]).otherwise(moved)

    at = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), c.alias("c"))
    return F.when(c.isNotNull(), let(let(let(at, metres), own), shifted))


def image_bounds(t: Column, width: Column, height: Column, c: Column) -> Column:
    """Bounds of an image's corners; null without a system or transform."""
    return projection.image_bounds(t, width, height, c, to_lonlat, Column.isNotNull)


def image_gsd(t: Column, width: Column, height: Column, c: Column) -> Column:
    """Metres a pixel at the image's centre."""
    return projection.image_gsd(t, width, height, c, to_lonlat, Column.isNotNull)
