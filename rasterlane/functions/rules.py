"""Decision rules, thresholds and labels as Column expressions, one function a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the rules.
SUPPORT_PROB, NO_SUPPORT, REBUILT_OVERLAP, REBUILT_INSIDE = 0.25, 0.10, 0.45, 0.7
DECISION_MARGIN, PLACEHOLDER_SHARE, MIN_MATCH = 0.1, 0.9, 0.75
MODEL_GSD, COARSE_GSD, FAST_MAX_GSD, FAST_MIN_SIDE = 0.5, 0.75, 1.2, 2048
DEFAULT_SHIFT_M, MAX_SHIFT_M, MAX_SEARCH_PX = 2.0, 15.0, 48
MAX_GRID, MAX_CAPTURE_GSD, LOW_RESOLUTION = 8, 1.0, 0.6
TYPE_ORDER = {"new": 0, "demolished": 1, "rebuilt": 2, "existing": 3}
CHANGE_TYPES = ("new", "demolished", "rebuilt")


def grid_size(value: Column) -> Column:
    """struct size, error of a requested grid size given as text: null means 2; only whole digits 1 to 8 are good."""
    n = F.try_to_number(F.when(F.regexp_like(value, F.lit(r"^[0-9]{1,6}$")), value), F.lit("999999")).cast("int")
    good = value.isNull() | n.between(1, MAX_GRID)
    return F.struct(F.when(value.isNull(), 2).when(good, n).alias("size"), F.when(~F.coalesce(good, F.lit(False)), F.lit("grid_size")).alias("error"))


def analysis_scale(width: Column, height: Column, gsd: Column, mode: Column) -> Column:
    """Resize factor before the analysis."""
    coarse = F.coalesce(gsd >= COARSE_GSD, F.lit(False))
    large = (mode == "fast") & (F.greatest(width, height) > FAST_MIN_SIDE)
    keep = coarse | F.coalesce(gsd * 2 > FAST_MAX_GSD, F.lit(False))
    return F.when(large, F.when(keep, 1.0).otherwise(0.5)).when(coarse, F.least(F.lit(2.0), gsd / MODEL_GSD)).otherwise(1.0)


def min_pixels(min_area: Column, gsd: Column, least: int = 12) -> Column:
    """Pixels of the smallest object: 12 at least for matched objects, 4 for the pixel-difference engine."""
    return F.greatest(F.lit(least), (min_area / (gsd * gsd)).cast("int"))


def tolerance_px(measured: Column, gsd: Column) -> Column:
    most = F.lit(MAX_SHIFT_M) / gsd
    return F.least(F.coalesce(measured, F.lit(DEFAULT_SHIFT_M) / gsd), most)


def search_radius(gsd: Column) -> Column:
    return F.bround(F.least(F.lit(MAX_SHIFT_M) / gsd, F.lit(float(MAX_SEARCH_PX)))).cast("int")


def gsd_error(gsd: Column) -> Column:
    """What is wrong with a ground resolution given by hand; null where it is absent or in range."""
    return F.when(gsd.isNotNull() & ~gsd.between(0.01, 100), "gsd")


def mode_error(mode: Column) -> Column:
    return F.when(~F.coalesce(mode, F.lit("fast")).isin("fast", "deep"), "analysis_mode")


def with_defaults(requests: DataFrame, live: bool) -> DataFrame:
    """Requests with what they leave out. The defaults of live and of uploaded pairs."""
    values = {"lat": 41.1070, "lon": 28.79, "year_t1": "2014", "year_t2": "2026", "threshold": 0.45, "min_area_m2": 40.0 if live else 30.0, "gsd": 0.5, "engine": "classic"}
    have = dict(requests.dtypes)
    return requests.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v) for c, v in values.items()})


def type_rank(type_: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, k in TYPE_ORDER.items():
        out = F.when(type_ == name, k).otherwise(out)
    return out


def confidence_pct(type_: Column, same: Column, other: Column) -> Column:
    """same: mean probability of the object's own date; other: of the other date."""
    share = F.when(type_ == "existing", same * other).when(type_ == "rebuilt", same).otherwise(same * (1 - other))
    return F.bround(share * 100, 1)


def is_rebuilt(overlap: Column, n_before: Column, contained: Column) -> Column:
    return (overlap < REBUILT_OVERLAP) & ((n_before >= 2) | (contained < REBUILT_INSIDE))


def change_heat(p1: Column, p2: Column) -> Column:
    return F.greatest(p2 * (1 - p1), p1 * (1 - p2))


def share(part: Column, whole: Column) -> Column:
    """part / whole where a whole below 1 counts as 1."""
    return part / F.greatest(F.lit(1), whole)


def iou(both: Column, either: Column) -> Column:
    """Of cell counts; two empty masks agree."""
    return F.when(either == 0, 1.0).otherwise(both / F.when(either != 0, either))


def decision(iou_after: Column, iou_before: Column) -> Column:
    """True: looks like after; false: like before; null: undecided."""
    diff = iou_after - iou_before
    return F.when(F.abs(diff) >= DECISION_MARGIN, diff > 0)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / F.when(whole != 0, whole))


def metrics(tp: Column, fp: Column, fn: Column) -> Column:
    """precision, recall, f1, iou of three counts, rounded; all 1 where there is nothing to find and nothing found."""
    none = tp + fp + fn == 0
    r = lambda x, name: F.when(none, 1.0).otherwise(F.bround(x, 3)).alias(name)
    return F.struct(r(ratio(tp, tp + fp), "precision"), r(ratio(tp, tp + fn), "recall"), r(ratio(tp * 2, tp * 2 + fp + fn), "f1"), r(ratio(tp, tp + fp + fn), "iou"))


def square_metres(px: Column, gsd: Column, digits: int = 1) -> Column:
    """Null where the pixel size is unknown; 0 counts as unknown."""
    return F.when(gsd != 0, F.bround(px * gsd * gsd, digits))


def hectares(px: Column, gsd: Column) -> Column:
    return F.when(gsd != 0, F.bround(px * gsd * gsd / 10000.0, 3))


def patch_dimensions(w: Column, h: Column, gsd: Column) -> Column:
    whole = lambda x: (x * gsd).cast("int")
    return F.when(gsd != 0, F.format_string("%dx%d px (%dm x %dm)", w, h, whole(w), whole(h))).otherwise(F.format_string("%dx%d px (ölçeksiz)", w, h))


def tile_starts(length: Column, tile: int = 1024, overlap: int = 64) -> Column:
    """Starts of overlapping tiles; the last one ends with the image."""
    step = tile - overlap
    more = F.when(length > tile, F.concat(F.sequence(F.lit(0), F.greatest(F.lit(0), length - tile - 1), F.lit(step)), F.array(length - tile)))
    return F.when(length <= tile, F.array(F.lit(0))).otherwise(more)


def feather(at: Column, tile: int, overlap: int) -> Column:
    """Weight of a tile's row or column: a line from 0.05 to 1 over the overlap at both ends."""
    ramp = lambda k: F.lit(0.05) + k * (0.95 / max(1, overlap - 1))
    return F.least(F.lit(1.0), F.when(at < overlap, ramp(at)).otherwise(1.0), F.when(at >= tile - overlap, ramp(F.lit(tile - 1) - at)).otherwise(1.0))


def good_capture(date: Column, resolution: Column, first: Column, last: Column) -> Column:
    """A dated capture between two dates that is sharp enough; an unknown resolution passes."""
    return date.isNotNull() & (date > first) & (date < last) & (F.coalesce(resolution, F.lit(0.0)) <= MAX_CAPTURE_GSD)


def missing_text(missing: Column, total: Column) -> Column:
    return F.when(missing > 0, F.format_string("%d/%d", missing, total))


def area_label(area_m2: Column, area_px: Column) -> Column:
    return F.when(area_m2.isNotNull(), F.format_string("%.1f m²", F.bround(area_m2, 1))).when(area_px.isNotNull(), F.format_string("%d px", area_px)).otherwise("—")


def month(date: Column) -> Column:
    return F.substring(date, 1, 7)


def period_label(start: Column, end: Column) -> Column:
    return F.concat(month(start), F.lit(" – "), month(end))


def location_title(hotspot_title: Column, lat: Column, lon: Column) -> Column:
    named = F.trim(F.substring_index(hotspot_title, "(", 1))
    return F.coalesce(named, F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("Harita [%.2f, %.2f]", F.bround(lat, 2), F.bround(lon, 2))), F.lit("Özel Yükleme"))


def progress(fraction: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction)), 3)


def iso_date(epoch_ms: Column) -> Column:
    """UTC date of milliseconds since 1970. Years after 9999 have more digits and, unlike in date_format, no plus sign."""
    return F.ltrim(F.date_format(F.timestamp_millis(epoch_ms), "yyyy-MM-dd"), F.lit("+"))


def data_uri(content: Column, mime: str) -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(content))


def polygon_area2(ring: Column) -> Column:
    """Twice the signed area of points (structs x, y), closed or not."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, after, lambda p, q: (p["x"] * q["y"] - q["x"] * p["y"]).cast("double")), F.lit(0.0), lambda s, v: s + v)


def polygon_perimeter(ring: Column) -> Column:
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, after, lambda p, q: F.hypot((q["x"] - p["x"]).cast("double"), (q["y"] - p["y"]).cast("double"))), F.lit(0.0), lambda s, v: s + v)


def polygon_centroid(ring: Column) -> Column:
    """Moments over area + 1e-5, for rings of positive orientation; (0, 0) without area."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    cross = lambda p, q: (p["x"] * q["y"] - q["x"] * p["y"]).cast("double")
    moment = lambda k: F.aggregate(F.zip_with(ring, after, lambda p, q: (p[k] + q[k]) * cross(p, q)), F.lit(0.0), lambda s, v: s + v) / 6
    sign = F.when(polygon_area2(ring) < 0, -1.0).otherwise(1.0)
    m00 = F.abs(polygon_area2(ring)) / 2
    return F.struct((moment("x") * sign / (m00 + 1e-5)).alias("x"), (moment("y") * sign / (m00 + 1e-5)).alias("y"))
