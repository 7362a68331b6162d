"""Coordinates of EPSG:4326, 3857 and the UTM zones (326xx, 327xx) to degrees, and ground distances, as Column expressions.

Other codes are unsupported and give null, which callers report. UTM uses the usual series in the third flattening."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterlane.functions.geo import apply_affine, let

#: Fixed values of WGS 84 and of the UTM grid.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EAST, FALSE_NORTH_SOUTH = 0.9996, 500_000.0, 10_000_000.0

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def supported(epsg: Column) -> Column:
    return F.coalesce(epsg.isin(4326, 3857) | epsg.between(32601, 32660) | epsg.between(32701, 32760), F.lit(False))


def _utm(x: Column, y: Column, epsg: Column) -> Column:
    """struct lon, lat of a UTM point."""
    south = epsg >= 32701
    flat = F.struct(((y - F.when(south, FALSE_NORTH_SOUTH).otherwise(0.0)) / (SCALE * _RADIUS)).alias("xi"), ((x - FALSE_EAST) / (SCALE * _RADIUS)).alias("eta"), (epsg % 100 * 6 - 183).alias("middle"))

    def sphere(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        for j, b in enumerate(_BETA, 1):
            xi = xi - b * F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"])
            eta = eta - b * F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"])
        return F.struct(xi.alias("xi"), eta.alias("eta"), p["middle"].alias("middle"))

    def angles(p: Column) -> Column:
        return F.struct((F.degrees(F.atan2(F.sinh(p["eta"]), F.cos(p["xi"]))) + p["middle"]).alias("lon"), F.asin(F.sin(p["xi"]) / F.cosh(p["eta"])).alias("chi"))

    def ellipsoid(p: Column) -> Column:
        lat = p["chi"]
        for j, d in enumerate(_DELTA, 1):
            lat = lat + d * F.sin(2 * j * p["chi"])
        return F.struct(p["lon"].alias("lon"), F.degrees(lat).alias("lat"))

    return let(let(let(flat, sphere), angles), ellipsoid)


def to_lonlat(x: Column, y: Column, epsg: Column) -> Column:
    """struct lon, lat; null for an unsupported code."""
    plain = F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))
    mercator = F.struct(F.degrees(x / SEMI_MAJOR).alias("lon"), F.degrees(F.atan(F.sinh(y / SEMI_MAJOR))).alias("lat"))
    return F.when(epsg == 4326, plain).when(epsg == 3857, mercator).when(supported(epsg), _utm(x, y, epsg))


def ground_distance(first: Column, second: Column) -> Column:
    """Metres between two near points (structs lon, lat) of the ellipsoid: meridian and parallel radii at the middle."""
    e2 = FLATTENING * (2 - FLATTENING)

    def of(v: Column) -> Column:
        p, q = v["p"], v["q"]
        mid = F.radians((p["lat"] + q["lat"]) / 2)
        w = 1 - F.pow(F.sin(mid), 2) * e2
        north = F.radians(q["lat"] - p["lat"]) * (SEMI_MAJOR * (1 - e2)) / F.pow(w, 1.5)
        east = F.radians(q["lon"] - p["lon"]) * SEMI_MAJOR * F.cos(mid) / F.sqrt(w)
        return F.hypot(north, east)

    return let(F.struct(first.alias("p"), second.alias("q")), of)


def _points(t: Column, system: Column, convert: Callable, *at: tuple[Column, Column]) -> Column:
    """Array of lon, lat at places (column, row) of an image."""
    return let(F.struct(t.alias("t"), system.alias("system")), lambda v: F.transform(F.array(*[apply_affine(v["t"], c, r) for c, r in at]), lambda p: convert(p["x"], p["y"], v["system"])))


def image_bounds(t: Column, width: Column, height: Column, system: Column, convert: Callable = to_lonlat, known: Callable = supported) -> Column:
    """Bounds of an image's corners. The system is a code, or what else `convert` takes; `known` says whether it can be used."""
    zero = F.lit(0)

    def of(corners: Column) -> Column:
        lats, lons = F.transform(corners, lambda p: p["lat"]), F.transform(corners, lambda p: p["lon"])
        return F.struct(F.array_min(lats).alias("s"), F.array_min(lons).alias("w"), F.array_max(lats).alias("n"), F.array_max(lons).alias("e"))

    return F.when(known(system) & t.isNotNull(), let(_points(t, system, convert, (zero, zero), (width, zero), (width, height), (zero, height)), of))


def image_gsd(t: Column, width: Column, height: Column, system: Column, convert: Callable = to_lonlat, known: Callable = supported) -> Column:
    """Metres a pixel at the image's centre: the mean, by product, of a step right and a step down."""
    x, y = width / 2, height / 2
    step = lambda p, i: ground_distance(F.element_at(p, 1), F.element_at(p, i))
    return F.when(known(system) & t.isNotNull(), let(_points(t, system, convert, (x, y), (x + 1, y), (x, y + 1)), lambda p: F.sqrt(step(p, 2) * step(p, 3))))
