"""The pixel-difference engine: regions that differ between two aligned images, typed by edges and brightness, and unchanged
structures of the later image. Blocks carry the pixel work, relations the regions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlane.operators import blocks as bl
from rasterlane.operators import kernels, objects, pixels, polygons

KEY = pixels.KEY
MOST_EXISTING, MOST_ASPECT, MOST_SHARE, OVERLAP = 25, 4.0, 0.15, 0.3
LOW, HIGH, CLIP, GRID = 50, 150, 2.0, 8


def _pair(blocks: DataFrame) -> DataFrame:
    """Blocks of both dates as one block of six bands."""
    side = lambda e: blocks.where(F.col("epoch") == e)
    at = ["scene", "y0", "x0", "bh", "bw", "h", "w"]
    both = side(0).select(*at, F.col("data").alias("a")).join(side(1).select(*at, F.col("data").alias("b")), at)
    out = both.select("scene", F.lit(0).alias("epoch"), *at[1:], F.lit(6).alias("bands"), "a", "b")

    def stack(frames):
        for f in frames:
            data = [np.concatenate([np.frombuffer(x, np.float32).reshape(h, w, 3) for x in (a, b)], 2).tobytes() for a, b, h, w in zip(f.a, f.b, f.bh, f.bw)]
            yield f.drop(columns=["a", "b"]).assign(data=data)

    return out.mapInPandas(stack, bl.SCHEMA)


def difference(blocks: DataFrame, size: int = 256, truth: DataFrame | None = None) -> DataFrame:
    """scene, r, c, diff, h, w of both dates' RGB blocks; a ground-truth mask (scene, r, c) takes four fifths of the value."""
    pair = bl.with_halo(_pair(blocks), 2, size)
    d = bl.cells(bl.mapped(pair, lambda x: kernels.difference(x[..., :3], x[..., 3:]), 2)).select("scene", "epoch", "r", "c", F.col("p").cast("double").alias("p"), "h", "w")
    if truth is not None:
        d = d.join(truth.select("scene", "r", "c").distinct().withColumn("t", F.lit(0.8)), ["scene", "r", "c"], "left")
        d = d.withColumn("p", F.least(F.lit(1.0), F.coalesce("t", F.lit(0.0)) + 0.2 * F.col("p"))).drop("t")
    return d


def equalised(grays: DataFrame) -> DataFrame:
    """Contrast-limited equalisation of gray cells (scene, epoch, r, c, p, h, w): an 8 x 8 grid of histograms, clipped, their excess
    shared out, and values looked up in the four nearest grid cells, weighted by distance."""
    th, tw = F.ceil(F.col("h") / GRID), F.ceil(F.col("w") / GRID)
    g = grays.withColumns({"th": th.cast("int"), "tw": tw.cast("int"), "v": F.col("p").cast("int")})
    n = g.groupBy(*KEY, "th", "tw", F.floor(F.col("r") / F.col("th")).cast("int").alias("ty"), F.floor(F.col("c") / F.col("tw")).cast("int").alias("tx"), "v").agg(F.count("*").alias("n"))
    tile = [*KEY, "ty", "tx"]
    every = n.select(*tile, "th", "tw").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("v")).join(n.select(*tile, "v", "n"), [*tile, "v"], "left").na.fill(0, ["n"])
    area = F.col("th") * F.col("tw")
    limit = F.greatest(F.lit(1), F.floor(CLIP * area / 256))
    every = every.withColumn("cut", F.least("n", limit)).withColumn("more", F.sum(F.col("n") - F.col("cut")).over(Window.partitionBy(*tile)))
    every = every.withColumn("cut", F.col("cut") + F.col("more") / 256)
    run = Window.partitionBy(*tile).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("to", F.least(F.lit(255.0), F.bround(F.sum("cut").over(run) * 255 / area)))
    lut = every.groupBy(*tile).agg(F.transform(F.array_sort(F.collect_list(F.struct("v", "to"))), lambda x: x["to"]).alias("lut"))
    y, x = F.col("r") / F.col("th") - 0.5, F.col("c") / F.col("tw") - 0.5
    last = lambda side, t: F.ceil(F.col(side) / F.col(t)).cast("int") - 1
    clamp = lambda v, side, t: F.greatest(F.lit(0), F.least(v, last(side, t))).cast("int")
    near = F.array(*[F.struct(clamp(F.floor(y) + i, "h", "th").alias("ty"), clamp(F.floor(x) + j, "w", "tw").alias("tx"), ((1 - F.abs(y - F.floor(y) - i)) * (1 - F.abs(x - F.floor(x) - j))).alias("k")) for i in (0, 1) for j in (0, 1)])
    wide = g.select(*KEY, "r", "c", "v", "h", "w", F.explode(near).alias("q")).select(*KEY, "r", "c", "v", "h", "w", "q.*")
    return wide.join(lut, tile).groupBy(*KEY, "r", "c", "h", "w").agg(F.bround(F.sum(F.element_at("lut", F.col("v") + 1) * F.col("k"))).alias("p"))


def edges(blocks: DataFrame, size: int = 256) -> DataFrame:
    """Edge cells of gray blocks: along-gradient maxima over the lower bound that hang together with one over the upper."""
    halo = bl.with_halo(blocks, 4, size)
    strength = bl.cells(bl.mapped(halo, lambda x: kernels.edge_strength(np.rint(kernels.gaussian(x[..., 0], 5, 0))), 4)).where(F.col("p") > LOW)
    lab = objects.label(strength.select(*KEY, "r", "c", "h", "w"), size)
    strong = lab.join(strength.where(F.col("p") > HIGH).select(*KEY, "r", "c"), [*KEY, "r", "c"]).select(*KEY, "label").distinct()
    return lab.join(strong, [*KEY, "label"], "left_semi").select(*KEY, "r", "c", "h", "w")


def gray_blocks(blocks: DataFrame) -> DataFrame:
    return bl.mapped(blocks, lambda x: kernels.gray(x[..., :3]))


def as_blocks(cells: DataFrame, size: int = 256) -> DataFrame:
    """One-band blocks of cells that cover their images."""
    by = lambda c: (F.floor(F.col(c) / size) * size).cast("int")
    n = cells.groupBy(*KEY, by("r").alias("y0"), by("c").alias("x0"), "h", "w").agg(F.array_sort(F.collect_list(F.struct("r", "c", F.col("p").cast("float").alias("p")))).alias("all"))
    n = n.select("scene", "epoch", "y0", "x0", F.least(F.lit(size), F.col("h") - F.col("y0")).alias("bh"), F.least(F.lit(size), F.col("w") - F.col("x0")).alias("bw"), "h", "w", F.lit(1).alias("bands"), F.transform("all", lambda v: v["p"]).alias("all"))

    def pack(frames):
        for f in frames:
            yield f.drop(columns="all").assign(data=[np.asarray(v, np.float32).tobytes() for v in f["all"]])

    return n.mapInPandas(pack, bl.SCHEMA)


def changed_regions(diff: DataFrame, threshold: float, size: int = 256) -> DataFrame:
    """Labelled cells of regions that differ: closed and opened by a 5 x 5 square."""
    on = diff.where(F.col("p") >= threshold).select(*KEY, "r", "c", "h", "w")
    five = pixels.rectangle(5)
    return objects.label(pixels.morphed(on, [(five, True), (five, False), (five, False), (five, True)], block=size), size)


def changed(regions: DataFrame, diff: DataFrame, edge: DataFrame, grays: DataFrame, min_px: int, gsd: float) -> DataFrame:
    """scene, label, type, ring, outline, area_px, area_m2, perimeter_m, confidence_pct of the regions that are large enough."""
    from rasterlane.functions import rules

    g = grays.groupBy("scene", "r", "c").agg(*[F.max(F.when(F.col("epoch") == e, F.col("p"))).alias(f"g{e}") for e in (0, 1)])
    e = edge.groupBy("scene", "r", "c").agg(*[F.max(F.when(F.col("epoch") == k, 255)).alias(f"e{k}") for k in (0, 1)])
    at = ["scene", "r", "c"]
    m = regions.join(diff.select(*at, "p"), at).join(g, at).join(e, at, "left").na.fill(0, ["e0", "e1"])
    m = m.groupBy("scene", "label").agg(F.avg("p").alias("diff"), *[F.avg(c).alias(c) for c in ("e0", "e1", "g0", "g1")])
    r = polygons.outlines(regions, ["scene", "label"]).withColumn("area_px", F.abs(rules.polygon_area2(F.col("ring"))) / 2).where(F.col("area_px") >= min_px)
    r = r.select("scene", "label", F.col("ring").alias("outline"), "area_px", polygons.simplified(F.col("ring"), 0.02).alias("ring")).where(F.size("ring") >= 3)
    grew = (F.col("e1") >= F.col("e0") * 0.9) & (F.col("g1") >= F.col("g0") * 0.85)
    return r.join(m, ["scene", "label"]).select("scene", "label", F.when(grew, "new").otherwise("demolished").alias("type"), "ring", "outline", "area_px", (F.col("area_px") * gsd * gsd).alias("area_m2"), (rules.polygon_perimeter(F.col("ring")) * gsd).alias("perimeter_m"), F.bround(F.col("diff") * 100, 1).alias("confidence_pct"))


def candidates(edge: DataFrame, min_px: int, size: int = 256) -> DataFrame:
    """scene, label, ring (the least rectangle), area_px, h, w of structures of the later image that pass the filters."""
    from rasterlane.functions import rules

    on, five = edge.where("epoch = 1"), pixels.rectangle(5)
    regions = objects.label(pixels.morphed(on, [(five, True), (five, True), (five, False), (five, False)], block=size), size)
    box = objects.object_stats(regions)
    shape = regions.select("scene", "h", "w").distinct()
    r = polygons.outlines(regions, ["scene", "label"]).withColumn("area_px", F.abs(rules.polygon_area2(F.col("ring"))) / 2).join(box.drop("area_px", "epoch"), ["scene", "label"]).join(shape, "scene")
    good = F.col("area_px").between(min_px, F.col("h") * F.col("w") * MOST_SHARE) & (F.col("x") > 2) & (F.col("y") > 2) & (F.col("x") + F.col("width") < F.col("w") - 3) & (F.col("y") + F.col("height") < F.col("h") - 3)
    slim = F.greatest("width", "height") / (F.least("width", "height") + 1e-5) <= MOST_ASPECT
    return r.where(good & slim).select("scene", "label", polygons.smallest_rectangle("ring").alias("ring"), "area_px", "h", "w")


def existing(found: DataFrame, painted: DataFrame, gsd: float) -> DataFrame:
    """The first candidates of each scene that do not lie on painted cells or on one another: each that stays is painted before the next
    is looked at, so a scene's candidates (25 at most, the engine's own limit) are folded in order. painted: scene, r, c."""
    from rasterlane.functions import rules

    order = Window.partitionBy("scene").orderBy(F.col("label").desc())
    first = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= MOST_EXISTING)
    cells = polygons.filled(first, ["scene", "label", "n", "area_px"])
    on = cells.join(painted.select("scene", "r", "c").distinct().withColumn("hit", F.lit(1)), ["scene", "r", "c"], "left")
    packed = on.groupBy("scene", "label", "n", "area_px").agg(F.collect_list((F.col("r").cast("long") * objects.ROW + F.col("c"))).alias("cells"), F.count("hit").alias("hits"))

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        taken: set[int] = set()
        keep = []
        for r in f.sort_values("n").itertuples():
            mine = set(r.cells.tolist())
            if r.hits + len(mine & taken) <= r.area_px * OVERLAP:  # painted changes are not among the taken
                taken |= mine
                keep.append((r.scene, r.label))
        return pd.DataFrame(keep, columns=["scene", "label"])

    stay = packed.groupBy("scene").applyInPandas(fold, "scene long, label long")
    return first.join(stay, ["scene", "label"]).select("scene", "label", F.lit("existing").alias("type"), "ring", F.col("ring").alias("outline"), "area_px", (F.col("area_px") * gsd * gsd).alias("area_m2"), (rules.polygon_perimeter(F.col("ring")) * gsd).alias("perimeter_m"), F.lit(95.0).alias("confidence_pct"))


def detect(blocks: DataFrame, threshold: float = 0.45, min_area_m2: float = 35.0, gsd: float = 0.5, truth: DataFrame | None = None, size: int = 256) -> DataFrame:
    """Classified regions of RGB blocks of two dates, changed ones first."""
    from rasterlane.sources.shared import written

    min_px = max(4, int(min_area_m2 / (gsd * gsd)))
    diff, _ = written(difference(blocks, size, truth), "diff")
    grays, _ = written(equalised(bl.cells(gray_blocks(blocks))), "gray")
    edge, _ = written(edges(as_blocks(grays, size), size), "edges")
    regions, _ = written(changed_regions(diff, threshold, size), "regions")
    plain = bl.cells(gray_blocks(blocks))
    change, _ = written(changed(regions, diff, edge, plain, min_px, gsd), "changed")
    painted = regions.join(change.select("scene", "label"), ["scene", "label"], "left_semi")
    return change.unionByName(existing(candidates(edge, min_px, size), painted, gsd))
