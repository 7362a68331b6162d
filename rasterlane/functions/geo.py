"""Web-mercator, affine and ground-distance arithmetic as Column expressions. Bounds are structs s, w, n, e in degrees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the formulas: metres of a degree of latitude; metres a pixel at zoom 0 on the equator.
METRES_PER_DEGREE = 111320.0
ZOOM0_METRES_PER_PIXEL = 156543.03392


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tiles_across(zoom: Column) -> Column:
    return F.pow(F.lit(2.0), zoom)


def tile_x(lon: Column, zoom: Column) -> Column:
    """Fractional tile column."""
    return (lon + 180.0) / 360.0 * tiles_across(zoom)


def tile_y(lat: Column, zoom: Column) -> Column:
    """Fractional tile row."""
    return (1.0 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2.0 * tiles_across(zoom)


def tile_of(lat: Column, lon: Column, zoom: Column) -> Column:
    """The tile that holds a point: struct x, y; fractions are cut off towards zero."""
    return F.struct(tile_x(lon, zoom).cast("int").alias("x"), tile_y(lat, zoom).cast("int").alias("y"))


def grid_origin(lat: Column, lon: Column, zoom: Column, size: Column) -> Column:
    """Top-left tile of a size x size grid whose centre is the tile corner next to the point."""
    start = lambda at: F.floor(at - size / 2 + 0.5).cast("int")
    return F.struct(start(tile_x(lon, zoom)).alias("x"), start(tile_y(lat, zoom)).alias("y"))


def tile_west(x: Column, zoom: Column) -> Column:
    return x / tiles_across(zoom) * 360.0 - 180.0


def tile_north(y: Column, zoom: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (1.0 - y * 2.0 / tiles_across(zoom)))))


def grid_bounds(x: Column, y: Column, size: Column, zoom: Column) -> Column:
    return F.struct(tile_north(y + size, zoom).alias("s"), tile_west(x, zoom).alias("w"), tile_north(y, zoom).alias("n"), tile_west(x + size, zoom).alias("e"))


def grid_lines(x: Column, y: Column, size: Column, zoom: Column) -> Column:
    """Inner lines of a tile grid: array of struct kind (meridian or parallel), degrees."""
    inner = F.when(size > 1, F.sequence(F.lit(1), (size - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    line = lambda kind, of: F.transform(inner, lambda k: F.struct(F.lit(kind).alias("kind"), of(k).alias("degrees")))
    return F.concat(line("meridian", lambda k: tile_west(x + k, zoom)), line("parallel", lambda k: tile_north(y + k, zoom)))


def ground_resolution(lat: Column, zoom: Column) -> Column:
    """Metres a pixel."""
    return F.lit(ZOOM0_METRES_PER_PIXEL) * F.cos(F.radians(lat)) / tiles_across(zoom)


def bounds_from_center(lat: Column, lon: Column, width: Column, height: Column, gsd: Column) -> Column:
    """Flat-earth bounds of an image around its centre."""
    half_lat = height * gsd / METRES_PER_DEGREE / 2
    half_lon = width * gsd / (F.lit(METRES_PER_DEGREE) * F.cos(F.radians(lat))) / 2
    return F.struct((lat - half_lat).alias("s"), (lon - half_lon).alias("w"), (lat + half_lat).alias("n"), (lon + half_lon).alias("e"))


def pixel_to_lonlat(x: Column, y: Column, width: Column, height: Column, bounds: Column, digits: int = 6) -> Column:
    """Array lon, lat inside the bounds, rounded half to even."""
    lon = bounds["w"] + x / width * (bounds["e"] - bounds["w"])
    lat = bounds["n"] - y / height * (bounds["n"] - bounds["s"])
    return F.array(F.bround(lon, digits), F.bround(lat, digits))


def closed_ring(ring: Column) -> Column:
    """A ring whose last point is its first; an empty one stays empty."""
    open_ = (F.size(ring) > 0) & (F.try_element_at(ring, F.lit(1)) != F.try_element_at(ring, F.lit(-1)))
    return F.when(open_, F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def ring_to_lonlat(points: Column, width: Column, height: Column, bounds: Column) -> Column:
    """Points (structs x, y) as a closed ring of lon, lat."""
    return closed_ring(F.transform(points, lambda p: pixel_to_lonlat(p["x"], p["y"], width, height, bounds)))


def valid_bounds(b: Column) -> Column:
    return (b["s"] >= -90) & (b["s"] < b["n"]) & (b["n"] <= 90) & (b["w"] >= -180) & (b["w"] < b["e"]) & (b["e"] <= 180)


def bounds_transform(b: Column, width: Column, height: Column) -> Column:
    """Affine coefficients of a north-up image over the bounds: X = c + a col + b row, Y = f + d col + e row."""
    zero = F.lit(0.0)
    return affine((b["e"] - b["w"]) / width, zero, b["w"], zero, -(b["n"] - b["s"]) / height, b["n"])


def affine(*six: Column) -> Column:
    return F.struct(*[v.cast("double").alias(n) for n, v in zip("abcdef", six)])


def apply_affine(t: Column, col: Column, row: Column) -> Column:
    return F.struct((t["c"] + t["a"] * col + t["b"] * row).alias("x"), (t["f"] + t["d"] * col + t["e"] * row).alias("y"))


def resampled(t: Column, old_w: Column, old_h: Column, new_w: Column, new_h: Column) -> Column:
    """The transform of the image resized from old to new size."""
    fx, fy = old_w / new_w, old_h / new_h
    return affine(t["a"] * fx, t["b"] * fy, t["c"], t["d"] * fx, t["e"] * fy, t["f"])


def corner_from_centre(t: Column) -> Column:
    """Shifts a transform that names pixel centres to pixel corners."""
    return affine(t["a"], t["b"], t["c"] - t["a"] / 2 - t["b"] / 2, t["d"], t["e"], t["f"] - t["d"] / 2 - t["e"] / 2)


def bounds_overlap(first: Column, second: Column) -> Column:
    """Intersection over union of two boxes; 0 for boxes without area."""
    def of(pair: Column) -> Column:
        p, q = pair["p"], pair["q"]
        side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(p[hi], q[hi]) - F.greatest(p[lo], q[lo]))
        area = lambda b: (b["n"] - b["s"]) * (b["e"] - b["w"])
        both = side("s", "n") * side("w", "e")
        return let(F.struct(both.alias("both"), (area(p) + area(q) - both).alias("union")), lambda v: F.when(v["union"] > 0, v["both"] / F.when(v["union"] > 0, v["union"])).otherwise(0.0))

    return let(F.struct(first.alias("p"), second.alias("q")), of)


def metres_to_grid(side: Column, lat: Column, zoom: Column, most: int = 8, tile: int = 256) -> Column:
    """Tiles a side that a square of so many metres needs, 1 to most; halves round up."""
    n = F.floor(side / (ground_resolution(lat, zoom) * tile) + 0.5)
    return F.greatest(F.lit(1), F.least(F.lit(most), n)).cast("int")
