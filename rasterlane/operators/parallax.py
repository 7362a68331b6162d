"""How far objects moved between two dates: the best shift of each object over the earlier date, and a percentile of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlane.functions import rules

BLOCK = 64


def _boxes(objects: DataFrame) -> DataFrame:
    return objects.groupBy("scene", "label").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n"), F.first("h").alias("h"), F.first("w").alias("w"))


def _inside(radius: int) -> Column:
    """Of boxes: still in the image after a move by the radius."""
    return (F.col("r0") >= radius) & (F.col("c0") >= radius) & (F.col("r1") + radius < F.col("h")) & (F.col("c1") + radius < F.col("w"))


def _unit(x: np.ndarray) -> float:
    """The power of two that takes values up to the largest of x to whole numbers of about 20 bits."""
    return 2.0 ** (20 - max(0, int(np.ceil(np.log2(max(1.0, np.abs(x).max()))))))


def _correlated(field: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sums of the field over the set cells of own at each place where own fits into it, by Fourier transforms.

    Values are taken to 2^-40 (of the largest, if that is over 1) as two whole numbers, the real and the imaginary part of one transform;
    their sums are far below 2^53, so rounding gives them exactly, and equal shifts get equal sums."""
    unit = _unit(field)
    high = np.rint(field * unit)
    low = np.rint((field * unit - high) * 2.0**20)
    got = np.fft.ifft2(np.fft.fft2(high + 1j * low) * np.conj(np.fft.fft2(own, field.shape)))
    got = got[: field.shape[0] - own.shape[0] + 1, : field.shape[1] - own.shape[1] + 1]
    return (np.rint(got.real) + np.rint(got.imag) / 2.0**20) / unit


def _windowed(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Sums of x over every window of h x w cells from a summed-area table of whole numbers (x to 2^-40 of its largest, if over 1)."""
    unit = _unit(x) * 2.0**20
    area = np.zeros((x.shape[0] + 1, x.shape[1] + 1), np.int64)
    area[1:, 1:] = np.rint(x * unit).astype(np.int64).cumsum(0).cumsum(1)
    return (area[h:, w:] - area[:-h, w:] - area[h:, :-w] + area[:-h, :-w]) / unit


def best_shifts(objects: DataFrame, before: DataFrame, radius: int) -> DataFrame:
    """scene, label, dr, dc, quality of the shift within the radius at which the object's cells correlate best with the earlier
    probabilities inside its box: sum(p) / sqrt(n * sum of p² in the box). Ties: the first shift by rows, then columns.

    objects: scene, label, r, c; before: scene, r, c, p. Only objects that are inside the image by the radius take part: h, w.
    The box is cut into pieces of BLOCK cells a side at most. A piece meets the earlier cells in its reach once; `_correlated` and
    `_windowed` give the sums of all (2 radius + 1)² shifts at once, and the pieces' sums are added per object. So a task holds
    (BLOCK + 2 radius)² cells of a piece, whatever the object's size."""
    box = _boxes(objects).where(_inside(radius))
    part = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
    span = lambda a, b: F.sequence(F.floor(F.col(a) / BLOCK).cast("int"), F.floor(F.col(b) / BLOCK).cast("int"))
    piece = box.select("scene", "label", "r0", "r1", "c0", "c1", F.explode(span("r0", "r1")).alias("y")).select("*", F.explode(span("c0", "c1")).alias("x"))
    top, left = F.col("y") * BLOCK, F.col("x") * BLOCK
    piece = piece.select("scene", "label", "y", "x", *[e.cast("int").alias(n) for e, n in ((F.greatest("r0", top), "a0"), (F.least("r1", top + BLOCK - 1), "a1"), (F.greatest("c0", left), "b0"), (F.least("c1", left + BLOCK - 1), "b1"))])
    reach = piece.withColumns({"u0": F.col("a0") - radius, "u1": F.col("a1") + radius, "v0": F.col("b0") - radius, "v1": F.col("b1") + radius})
    reach = reach.select("*", F.explode(span("u0", "u1")).alias("by")).select("*", F.explode(span("v0", "v1")).alias("bx"))
    near = reach.join(before.where("p IS NOT NULL").select("scene", part("r").alias("by"), part("c").alias("bx"), "r", "c", "p"), ["scene", "by", "bx"])
    near = near.where(F.col("r").between(F.col("u0"), F.col("u1")) & F.col("c").between(F.col("v0"), F.col("v1")))
    cols = ["scene", "label", "y", "x", "a0", "a1", "b0", "b1", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")]
    own = objects.select("scene", "label", part("r").alias("y"), part("c").alias("x"), "r", "c").join(piece, ["scene", "label", "y", "x"])
    rows = near.select(*cols, F.col("p").cast("double").alias("p")).unionByName(own.select(*cols, F.lit(None).cast("double").alias("p")))
    n = 2 * radius + 1

    def run(t: pa.Table) -> pa.Table:
        a0, a1, b0, b1 = (t.column(k)[0].as_py() for k in ("a0", "a1", "b0", "b1"))
        mine = np.array(t.column("p").is_null())
        r, c, p = t.column("r").to_numpy() - a0, t.column("c").to_numpy() - b0, t.column("p").to_numpy(zero_copy_only=False)
        field, there, own = np.zeros((a1 - a0 + n, b1 - b0 + n)), np.zeros((a1 - a0 + n, b1 - b0 + n)), np.zeros((a1 - a0 + 1, b1 - b0 + 1))
        field[r[~mine] + radius, c[~mine] + radius], there[r[~mine] + radius, c[~mine] + radius], own[r[mine], c[mine]] = p[~mine], 1, 1
        num, sq, seen = _correlated(field, own), _windowed(field**2, *own.shape), _windowed(there, *own.shape)
        dr, dc = (v.ravel() for v in np.indices((n, n), np.int32) - radius)
        some = seen.ravel() > 0
        keys = {k: pa.repeat(t.column(k)[0], int(some.sum())) for k in ("scene", "label")}
        return pa.table({**keys, "dr": dr[some], "dc": dc[some], "num": num.ravel()[some], "sq": sq.ravel()[some]})

    kinds = {f.name: f.dataType.simpleString() for f in objects.schema}
    sums = rows.groupBy("scene", "label", "y", "x").applyInArrow(run, f"scene {kinds['scene']}, label {kinds['label']}, dr int, dc int, num double, sq double")
    q = sums.groupBy("scene", "label", "dr", "dc").agg(F.sum("num").alias("num"), F.sum("sq").alias("sq")).join(box.select("scene", "label", "n"), ["scene", "label"])
    quality = F.when(F.col("sq") > 0, F.col("num") / F.sqrt(F.col("n") * F.when(F.col("sq") > 0, F.col("sq")))).otherwise(0.0)
    q = q.withColumn("quality", F.bround(quality, 9))
    best = F.max_by(F.struct("dr", "dc", "quality"), F.struct("quality", (-F.col("dr")).alias("a"), (-F.col("dc")).alias("b")))
    return q.groupBy("scene", "label").agg(best.alias("b")).select("scene", "label", "b.*")


def inside(objects: DataFrame, radius: int) -> DataFrame:
    """The objects that stay in the image when they move by the radius."""
    return objects.join(_boxes(objects).where(_inside(radius)).select("scene", "label"), ["scene", "label"], "left_semi")


def sampled(objects: DataFrame, most: int) -> DataFrame:
    """The objects of each scene if they are `most` at most, else as many by a hash order of their labels."""
    from pyspark.sql import Window

    order = Window.partitionBy("scene").orderBy(F.xxhash64("label"), "label")
    picked = objects.select("scene", "label").distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
    return objects.join(picked, ["scene", "label"], "left_semi")


def measured_shift(shifts: DataFrame, key: list[str], least: int = 20, margin: float = 2.0) -> DataFrame:
    """Per key: matches and the 75th percentile of the good matches' lengths plus a margin; null with fewer than `least`."""
    length = F.sqrt((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).cast("double"))
    good = shifts.where(F.col("quality") > rules.MIN_MATCH).groupBy(*key).agg(F.count("*").alias("matches"), F.percentile(length, 0.75).alias("p75"))
    return good.select(*key, "matches", F.when(F.col("matches") >= least, F.col("p75") + margin).alias("shift_px"))
