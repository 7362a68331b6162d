"""Masks as relations of cells: a row per set cell, keyed by scene, epoch, r, c.

Dilation explodes every cell by the kernel's offsets, erosion counts hits; both are equi-joins and sums that Spark spreads by key.
That suits small kernels; wide ones run on blocks (blocks.py). As in image libraries, cells outside the image do not erode its border.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlane.sources.shared import bound_batches

from .kernels import morph

KEY = ["scene", "epoch"]
WIDE = 64  # offsets over which a dilation runs on blocks
MOST_CELLS = 500_000  # of blocks that are worked on at once


def rectangle(k: int) -> list[tuple[int, int]]:
    """Offsets (dr, dc) of a k x k square."""
    r = k // 2
    return [(i, j) for i in range(-r, k - r) for j in range(-r, k - r)]


def ellipse(k: int) -> list[tuple[int, int]]:
    """Offsets of the ellipse inscribed in a k x k square: a row dy is as wide as the circle there, rounded half to even."""
    r = k // 2
    wide = lambda dy: round(r * math.sqrt((r * r - dy * dy) / (r * r))) if r else 0
    return [(i, j) for i in range(-r, r + 1) for j in range(-wide(i), wide(i) + 1)]


def pixels(blocks: DataFrame, values: str = "p") -> DataFrame:
    """Cells (scene, epoch, r, c, p, h, w) of blocks (scene, epoch, y0, x0, bw, h, w, array of values); h, w: the image's size."""
    at = F.posexplode(values).alias("i", "p")
    cells = blocks.select(*KEY, "y0", "x0", "bw", "h", "w", at)
    return cells.select(*KEY, (F.col("y0") + F.floor(F.col("i") / F.col("bw"))).cast("int").alias("r"), (F.col("x0") + F.col("i") % F.col("bw")).cast("int").alias("c"), "p", "h", "w")


def mask(cells: DataFrame, least: float) -> DataFrame:
    """Cells of objects: p >= least."""
    return cells.where(F.col("p") >= least).select(*KEY, "r", "c", "h", "w")


def support(cells: DataFrame, over: float) -> DataFrame:
    """Cells that support an object of the other date: p > over."""
    return cells.where(F.col("p") > over).select(*KEY, "r", "c", "h", "w")


def _moved(cells: DataFrame, kernel: list[tuple[int, int]], sign: int) -> DataFrame:
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in kernel])
    out = cells.select("*", F.explode(offsets).alias("o"))
    out = out.withColumns({"r": F.col("r") + sign * F.col("o.i"), "c": F.col("c") + sign * F.col("o.j")}).drop("o")
    return out.where("r >= 0 AND c >= 0 AND r < h AND c < w")


def dilate(cells: DataFrame, kernel: list[tuple[int, int]], keep: list[str] = []) -> DataFrame:
    """Union of the kernel over all cells; kernels are symmetric. keep: further columns that tell masks apart (labels)."""
    if len(kernel) > WIDE:
        return dilate_blocks(cells, kernel, keep)
    return _moved(cells, kernel, 1).select(*KEY, *keep, "r", "c", "h", "w").distinct()


def dilate_blocks(cells: DataFrame, kernel: list[tuple[int, int]], keep: list[str] = [], block: int = 256) -> DataFrame:
    """The same for wide kernels, on blocks."""
    return morphed(cells, [(kernel, True)], keep, block)


def morphed(cells: DataFrame, steps: list[tuple[list[tuple[int, int]], bool]], keep: list[str] = [], block: int = 256) -> DataFrame:
    """Dilations (kernel, True) and erosions (kernel, False), one after the other, in one shuffle: cells are sent to the blocks that all
    steps together reach from them, four at most where that is less than a block, and a task works on stacks of blocks, of MOST_CELLS cells
    or of one block. What lies
    outside the image is not set for a dilation and set for an erosion; kernels are symmetric and hold their centre."""
    reach = sum(max(max(abs(i), abs(j)) for i, j in kernel) for kernel, _ in steps)
    to = lambda v, n: F.explode(F.sequence((F.greatest(F.lit(0), F.col(v) - reach) / block).cast("int"), (F.least(F.col(n) - 1, F.col(v) + reach) / block).cast("int")))
    sent = cells.select(*KEY, *keep, "r", "c", "h", "w", to("r", "h").alias("by")).withColumn("bx", to("c", "w"))
    side = block + 2 * reach
    at = ((F.col("r") - F.col("by") * block + reach) * side + F.col("c") - F.col("bx") * block + reach).cast("int")
    packed = sent.groupBy(*KEY, *keep, "h", "w", "by", "bx").agg(F.collect_list(at).alias("at"))
    bound_batches(cells.sparkSession)

    def stack(part: pa.RecordBatch) -> pa.RecordBatch:
        h, w, by, bx = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("h", "w", "by", "bx"))
        n, at = len(h), part.column("at")
        on = np.zeros(n * side * side, bool)
        on[np.repeat(np.arange(n), at.value_lengths().to_numpy()) * side * side + at.flatten().to_numpy()] = True
        on = on.reshape(n, side, side)
        y, x = ((b * block - reach)[:, None] + np.arange(side) for b in (by, bx))
        outside = ~(((y >= 0) & (y < h[:, None]))[:, :, None] & ((x >= 0) & (x < w[:, None]))[:, None, :])
        for kernel, grow in steps:
            on[outside] = not grow
            on = morph(on, kernel, grow)
        on[outside] = False
        i, r, c = np.nonzero(on[:, reach : reach + block, reach : reach + block])
        own = {k: part.column(k).take(pa.array(i)) for k in (*KEY, *keep, "h", "w")}
        own |= {"r": pa.array((r + by[i] * block).astype(np.int32)), "c": pa.array((c + bx[i] * block).astype(np.int32))}
        return pa.RecordBatch.from_arrays([own[k] for k in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = max(1, MOST_CELLS // side**2)
        for batch in batches:
            for s in range(0, batch.num_rows, few):
                yield stack(batch.slice(s, few))

    names = [*KEY, *keep, "r", "c", "h", "w"]
    schema = cells.select(*KEY, *keep, F.col("r").cast("int"), F.col("c").cast("int"), "h", "w").schema
    return packed.mapInArrow(run, schema)


def erode(cells: DataFrame, kernel: list[tuple[int, int]], keep: list[str] = []) -> DataFrame:
    """Cells whose kernel lies in the mask, as far as it is inside the image."""
    inside = lambda at, size, d: (at + d >= 0) & (at + d < size)
    whole = sum((F.when(inside(F.col("r"), F.col("h"), i) & inside(F.col("c"), F.col("w"), j), 1).otherwise(0) for i, j in kernel), F.lit(0))
    hits = _moved(cells, kernel, -1).groupBy(*KEY, *keep, "r", "c", "h", "w").agg(F.count("*").alias("hits"))
    return hits.where(F.col("hits") == whole).drop("hits")


def opened(cells: DataFrame, kernel: list[tuple[int, int]], keep: list[str] = []) -> DataFrame:
    return dilate(erode(cells, kernel, keep), kernel, keep)


def closed(cells: DataFrame, kernel: list[tuple[int, int]], keep: list[str] = []) -> DataFrame:
    return erode(dilate(cells, kernel, keep), kernel, keep)


def mask_iou(a: DataFrame, b: DataFrame, scenes: DataFrame) -> DataFrame:
    """scene, both, either, iou of two masks (epochs do not count) for every scene."""
    from rasterlane.functions.rules import iou

    cells = a.select("scene", "r", "c", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select("scene", "r", "c", F.lit(0).alias("x"), F.lit(1).alias("y")))
    cells = cells.groupBy("scene", "r", "c").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    n = cells.groupBy("scene").agg(F.sum(F.col("x") * F.col("y")).alias("both"), F.count("*").alias("either"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = scenes.select("scene").distinct().join(n, "scene", "left").select("scene", zero("both"), zero("either"))
    return out.withColumn("iou", iou(F.col("both"), F.col("either")))


def confusion(pred: DataFrame, truth: DataFrame, scenes: DataFrame) -> DataFrame:
    """scene, tp, fp, fn and the rounded metrics of a predicted against a true mask."""
    from rasterlane.functions.rules import metrics

    cells = pred.select("scene", "r", "c", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(truth.select("scene", "r", "c", F.lit(0).alias("x"), F.lit(1).alias("y")))
    cells = cells.groupBy("scene", "r", "c").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    count = lambda when, name: F.count_if(when).alias(name)
    n = cells.groupBy("scene").agg(count((F.col("x") == 1) & (F.col("y") == 1), "tp"), count((F.col("x") == 1) & (F.col("y") == 0), "fp"), count((F.col("x") == 0) & (F.col("y") == 1), "fn"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = scenes.select("scene").distinct().join(n, "scene", "left").select("scene", zero("tp"), zero("fp"), zero("fn"))
    return out.select("*", metrics(F.col("tp"), F.col("fp"), F.col("fn")).alias("m")).select("scene", "tp", "fp", "fn", "m.*")


def blend(tiles: DataFrame) -> DataFrame:
    """scene, r, c, p of overlapping predictions (scene, r, c, p, weight): their weighted mean."""
    return tiles.groupBy("scene", "r", "c").agg((F.sum(F.col("p") * F.col("weight")) / F.greatest(F.sum("weight"), F.lit(1e-6))).alias("p"))


def paint(cells: DataFrame, order: Column) -> DataFrame:
    """scene, r, c, label where the object painted last wins. cells: scene, r, c, label."""
    return cells.groupBy("scene", "r", "c").agg(F.max_by("label", order).alias("label"))
