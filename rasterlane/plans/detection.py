"""The whole analysis of image pairs: sizes, segmentation, parallax, classification, periods, records and statistics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlane.functions import rules
from rasterlane.operators import blocks, objects, parallax, pixels, polygons, timeline
from rasterlane.sources import images as im
from rasterlane.sources.shared import written


def probabilities(images: DataFrame, model: Callable = blocks.bright, tile: int = 1024, overlap: int = 64, block: int = 256, invalid: DataFrame | None = None) -> DataFrame:
    """Cells with probabilities; cells without imagery (scene, r, c) count as 0 on both dates."""
    p = blocks.cells(blocks.predicted(blocks.tiles(images, tile, overlap), model, tile, overlap, block))
    if invalid is not None:
        p = p.join(invalid.select("scene", "r", "c").distinct().withColumn("bad", F.lit(True)), ["scene", "r", "c"], "left").withColumn("p", F.when(F.col("bad"), F.lit(0.0)).otherwise(F.col("p")).cast("float")).drop("bad")
    return written(p, "cells")[0]


def tolerance(cells: DataFrame, gsd: float, block: int = 256, most: int = 300, least_px: int = 200) -> DataFrame:
    """scene, tolerance_px: the shift that each pair of images needs, in cells, measured on a bounded sample of its objects, or the
    default. Objects near the border are left out before the sample is drawn."""
    radius = int(min(round(rules.MAX_SHIFT_M / gsd), rules.MAX_SEARCH_PX))
    later = cells.where("epoch = 1 AND p >= 0.5").select(*pixels.KEY, "r", "c", "h", "w")
    large = parallax.sampled(parallax.inside(objects.large_objects(objects.label(later, block), least_px), radius), most)
    shifts = parallax.best_shifts(large, cells.where("epoch = 0").select("scene", "r", "c", F.col("p").cast("double").alias("p")), radius)
    found = parallax.measured_shift(shifts, ["scene"]).select("scene", "shift_px")
    return cells.select("scene").distinct().join(found, "scene", "left").select("scene", rules.tolerance_px(F.col("shift_px"), F.lit(float(gsd))).alias("tolerance_px"))


def _by_tolerance(tolerances: DataFrame) -> list[tuple[float, DataFrame]]:
    """Scenes in groups of one kernel width: a tolerance that stands for the group, and its scenes. The widths are whole numbers of
    cells, MAX_SHIFT_M / gsd at most."""
    kind = tolerances.withColumns({"pad": F.bround("tolerance_px").cast("int"), "wide": F.col("tolerance_px") >= 1})
    groups = kind.groupBy("pad", "wide").agg(F.min("tolerance_px").alias("t")).collect()
    return [(g.t, kind.where((F.col("pad") == g.pad) & (F.col("wide") == g.wide)).select("scene")) for g in groups]


def detect(images: DataFrame, gsd: float | None = None, model: Callable = blocks.bright, threshold: float = 0.5, min_area_m2: float = 30.0, tolerance_px: float | None = None, captures: DataFrame | None = None, dates: list[str] | None = None,
           tile: int = 1024, overlap: int = 64, block: int = 256, invalid: DataFrame | None = None) -> DataFrame:
    """A row per classified object: scene, id, type, area_px, area_m2, perimeter_m, confidence_pct, ring, centroid_px, from, to.

    images: two dates a scene in one size; captures: further images with epoch as their place between, 1, 2, ..., for the periods.
    Each scene has its own tolerance, so that scenes together get what each gets alone."""
    px_gsd = gsd or rules.MODEL_GSD
    cells = probabilities(images, model, tile, overlap, block, invalid)
    if tolerance_px is None:
        groups = _by_tolerance(written(tolerance(cells, px_gsd, block), "tolerance")[0])
    else:
        groups = [(tolerance_px, cells.select("scene").distinct())]
    min_px = max(12, int(min_area_m2 / px_gsd**2))
    classified = [objects.classify(cells.join(scenes, "scene", "left_semi"), threshold, min_px, tol, block=block) for tol, scenes in groups]
    if not classified:  # no scene at all
        classified = [objects.classify(cells, threshold, min_px, 0.0, block=block)]
    found, _ = written(reduce(DataFrame.unionByName, classified), "objects")
    key = ["scene", "type", "part"]
    rings = polygons.outlines(found, key).withColumn("ring", polygons.simplified(F.col("ring"), 0.01))
    rows = objects.measure(found, cells).join(rings, key)
    if captures is not None:
        shots = written(blocks.cells(blocks.predicted(blocks.tiles(captures, tile, overlap), model, tile, overlap, block)), "captures")[0]
        size = cells.groupBy("scene").agg(F.max("h").alias("h"), F.max("w").alias("w"))
        region = polygons.filled(rings.where(F.col("type").isin(*rules.CHANGE_TYPES)).join(size, "scene"), key).withColumn("epoch", F.lit(0))
        grown = [pixels.dilate(region.join(scenes, "scene", "left_semi"), pixels.ellipse(2 * max(1, round(tol)) + 1), ["type", "part"]) for tol, scenes in groups] or [region]
        region = reduce(DataFrame.unionByName, grown).select("scene", F.struct("type", "part").alias("object"), "r", "c")
        on = F.col("p") >= threshold
        states = timeline.capture_states(region, cells.where((F.col("epoch") == 0) & on), cells.where((F.col("epoch") == 1) & on), shots.select("scene", F.col("epoch").alias("seq"), F.when(on, F.col("r")).alias("r"), F.when(on, F.col("c")).alias("c")))
        named = states.withColumn("date", F.element_at(F.array(*[F.lit(x) for x in dates]), F.col("seq") + 1))
        p = timeline.change_periods(timeline.with_ends(named, ["scene", "object"], dates[0], dates[-1]), ["scene", "object"], ["g", "seq"])
        rows = rows.join(p.select("scene", "object.*", "from", "to"), key, "left")
    order = Window.partitionBy("scene").orderBy(rules.type_rank(F.col("type")), F.col("area_px").desc(), "part")
    g = F.lit(gsd).cast("double")
    more = ["from", "to"] if captures is not None else []
    return rows.select("scene", F.row_number().over(order).alias("id"), "type", "area_px", rules.square_metres(F.col("area_px"), g).alias("area_m2"), F.when(g != 0, F.bround(rules.polygon_perimeter(F.col("ring")) * g, 1)).alias("perimeter_m"), "confidence_pct", "ring", rules.polygon_centroid(F.col("ring")).alias("centroid_px"), *more)


def resized_for_analysis(images: DataFrame, gsd: float | None, mode: str = "fast") -> DataFrame:
    """Both dates in the later one's size, then by the analysis scale."""
    s = im.same_size(images)
    return im.scaled(s, rules.analysis_scale(F.col("w"), F.col("h"), F.lit(gsd).cast("double"), F.lit(mode)))
