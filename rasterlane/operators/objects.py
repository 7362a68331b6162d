"""Connected objects of masks and the classification of the objects of two dates.

Labelling has two levels. A block's cells are labelled inside the block, many blocks at once, in a pandas function; labels that
meet across the seams of blocks become links, and a distributed star contraction gives them one name. A mask on one block,
or without contact across seams, needs no second level. Labels are the smallest cell number of the object (row * 2^31 + column).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlane.functions import rules
from rasterlane.operators.graph import components
from rasterlane.operators.pixels import KEY, MOST_CELLS, dilate, ellipse, morphed, opened
from rasterlane.sources.shared import bound_batches, written

EIGHT = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
ROW = 1 << 31


def label_stack(on: np.ndarray) -> np.ndarray:
    """Labels of n masks (n, h, w) at once, 8-connected: 1 + the smallest position of the object in its mask; 0 outside."""
    n, h, w = on.shape
    big = h * w + 1
    lab = np.where(on, np.arange(1, h * w + 1, dtype=np.int64).reshape(h, w), big)
    base = np.arange(n)[:, None] * (big + 1)
    while True:
        pad = np.pad(lab, ((0, 0), (1, 1), (1, 1)), constant_values=big)
        low = lab
        for i, j in EIGHT:
            low = np.minimum(low, pad[:, 1 + i : 1 + i + h, 1 + j : 1 + j + w])
        low = np.where(on, low, big)
        # the whole object follows its cells: a label's own label replaces it
        flat = np.full((n, big + 1), big, np.int64)
        flat[:, 1:big] = low.reshape(n, -1)
        jump = flat.ravel()[(base + low.reshape(n, -1))].reshape(n, h, w)
        low = np.where(on, np.minimum(low, jump), big)
        if (low == lab).all():
            return np.where(on, lab, 0)
        lab = low


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def block_labels(bits: pd.Series, bh: pd.Series, bw: pd.Series) -> pd.Series:
    """Labels of masks given as binaries of 0 and 1 bytes, row by row; masks of a size are labelled together."""
    out = [None] * len(bits)
    sizes = pd.MultiIndex.from_arrays([bh, bw])
    for (h, w), rows in pd.Series(np.arange(len(bits)), index=sizes).groupby(level=[0, 1]):
        rows = rows.to_numpy()
        step = max(1, MOST_CELLS // max(1, h * w))
        for s in range(0, len(rows), step):
            some = rows[s : s + step]
            stack = np.frombuffer(b"".join(bits.iloc[i] for i in some), np.uint8).reshape(len(some), h, w) > 0
            for i, lab in zip(some, label_stack(stack)):
                out[i] = lab.ravel().astype(np.int32)
    return pd.Series(out)


def label(cells: DataFrame, block: int = 256, keep: list[str] = []) -> DataFrame:
    """cells (scene, epoch, r, c, h, w) with a column label. keep: further columns that tell masks apart."""
    key = [*KEY, *keep]
    bound_batches(cells.sparkSession)
    cells = cells.select(*key, "r", "c", "h", "w", (F.col("r") / block).cast("int").alias("by"), (F.col("c") / block).cast("int").alias("bx"))
    side = lambda b, n: F.least(F.lit(block), F.col(n) - F.col(b) * block)
    at = (F.col("r") % block * side("bx", "w") + F.col("c") % block).cast("int")
    blocks = cells.groupBy(*key, "by", "bx", "h", "w").agg(F.array_sort(F.collect_list(at)).alias("at"))
    size = (side("by", "h") * side("bx", "w")).cast("int")
    # runs of zero bytes between the set cells
    starts = F.concat(F.array(F.lit(-1)), F.slice("at", F.lit(1), F.size("at") - 1))
    text = F.concat(F.array_join(F.zip_with(starts, F.col("at"), lambda a, b: F.concat(F.repeat(F.lit("\0"), b - a - 1), F.lit("\1"))), ""), F.repeat(F.lit("\0"), size - F.element_at("at", -1) - 1))
    lab = blocks.select(*key, "by", "bx", "h", "w", side("bx", "w").alias("bw"), block_labels(text.cast("binary"), side("by", "h").cast("int"), side("bx", "w").cast("int")).alias("labels"))
    put = lambda i: (F.col("by") * block + F.floor(i / F.col("bw"))).cast("long") * ROW + F.col("bx") * block + i % F.col("bw")
    flat = lab.select("*", F.posexplode("labels").alias("i", "l")).where("l > 0")
    own = flat.select(*key, "h", "w", (F.col("by") * block + F.floor(F.col("i") / F.col("bw"))).cast("int").alias("r"), (F.col("bx") * block + F.col("i") % F.col("bw")).cast("int").alias("c"), put(F.col("l") - 1).alias("label"))
    return _join_seams(own, block, key)


def _join_seams(cells: DataFrame, block: int, key: list[str]) -> DataFrame:
    """One name for labels that touch across the borders of blocks. Images of one block have none and pass through."""
    large = cells.where((F.col("h") > block) | (F.col("w") > block))
    if large.isEmpty():
        return cells
    cells, _ = written(cells, "labels")
    edge = cells.where((F.col("r") % block).isin(0, block - 1) | (F.col("c") % block).isin(0, block - 1))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in EIGHT])
    moved = edge.select(*key, F.col("label").alias("other"), "r", "c", F.explode(near).alias("o"))
    moved = moved.select(*key, "other", (F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"))
    touch = edge.join(moved.hint("merge"), [*key, "r", "c"]).where("label > other").select(*key, "label", "other").distinct()
    # a name that is one number over all masks, for the contraction
    name = lambda c: F.xxhash64(*key, c)
    links = touch.select(name("label").alias("u"), name("other").alias("v"))
    if links.isEmpty():
        return cells
    found = components(links)
    named = touch.select(*key, F.explode(F.array("label", "other")).alias("label")).distinct().withColumn("node", name("label")).join(found.select("node", F.col("label").alias("hub")).hint("merge"), "node")
    least = named.groupBy(*key, "hub").agg(F.min("label").alias("new")).join(named.hint("merge"), [*key, "hub"]).select(*key, "label", "new")
    return cells.join(least.hint("merge"), [*key, "label"], "left").withColumn("label", F.coalesce("new", "label")).drop("new")


def object_stats(cells: DataFrame, keep: list[str] = []) -> DataFrame:
    """A row per object: area, x, y, width, height. cells: scene, epoch, label, r, c."""
    return cells.groupBy(*KEY, *keep, "label").agg(F.count("*").alias("area_px"), F.min("c").alias("x"), F.min("r").alias("y"), (F.max("c") - F.min("c") + 1).alias("width"), (F.max("r") - F.min("r") + 1).alias("height"))


def large_objects(cells: DataFrame, min_px: int, keep: list[str] = []) -> DataFrame:
    """The cells of objects of min_px cells at least."""
    big = cells.groupBy(*KEY, *keep, "label").agg(F.count("*").alias("n")).where(F.col("n") >= min_px).drop("n")
    return cells.join(big, [*KEY, *keep, "label"], "left_semi")


def objects_of(cells: DataFrame, threshold: float, min_px: int, open_size: int = 5, block: int = 256) -> DataFrame:
    """Cells with labels of the objects of a date: threshold, opening, 8-connected components of min_px cells at least."""
    on = cells.where(F.col("p") >= threshold).select(*KEY, "r", "c", "h", "w")
    if open_size > 1:
        on = morphed(on, [(ellipse(open_size), False), (ellipse(open_size), True)], block=block)
    return large_objects(label(on, block), min_px)


def supported_share(objects: DataFrame, support: DataFrame) -> DataFrame:
    """Per object, the share of its cells that the other date supports. support: scene, r, c."""
    hit = support.select("scene", "r", "c").distinct().withColumn("hit", F.lit(1))
    return objects.join(hit, ["scene", "r", "c"], "left").groupBy("scene", "label").agg(F.count("*").alias("area_px"), F.avg(F.coalesce("hit", F.lit(0))).alias("support"))


def footprint_match(objects: DataFrame, before: DataFrame, tolerant: DataFrame, pad: int = 0) -> DataFrame:
    """How each object of the later date fits the earlier objects that it touches: overlap, n_before, contained.

    before: labelled raw cells of the earlier date; tolerant: its cells dilated by the tolerance. Earlier objects count
    inside the object's box grown by pad."""
    o = objects.select("scene", "label", "r", "c")
    b = before.select("scene", F.col("label").alias("was"), "r", "c")
    under = o.join(b, ["scene", "r", "c"])
    touching = under.select("scene", "label", "was").distinct()
    box = o.groupBy("scene", "label").agg((F.min("r") - pad).alias("r0"), (F.max("r") + pad).alias("r1"), (F.min("c") - pad).alias("c0"), (F.max("c") + pad).alias("c1"), F.count("*").alias("n"))
    inside = touching.join(box, ["scene", "label"]).join(b, ["scene", "was"]).where("r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1")
    n_touch = inside.groupBy("scene", "label").agg(F.count("*").alias("n_touch"))
    n_both = under.groupBy("scene", "label").agg(F.count("*").alias("n_both"), F.count_distinct("was").alias("n_before"))
    n_tol = o.join(tolerant.select("scene", "r", "c").distinct(), ["scene", "r", "c"]).groupBy("scene", "label").agg(F.count("*").alias("n_tol"))
    out = box.select("scene", "label", "n").join(n_touch, ["scene", "label"], "left").join(n_both, ["scene", "label"], "left").join(n_tol, ["scene", "label"], "left").na.fill(0)
    none = F.col("n_before") == 0
    overlap = rules.share(F.col("n_tol"), F.col("n") + F.col("n_touch") - F.col("n_both"))
    return out.select("scene", "label", F.when(none, 0.0).otherwise(overlap).alias("overlap"), "n_before", F.when(none, 0.0).otherwise(rules.share(F.col("n_both"), F.col("n_touch"))).alias("contained"))


def classify(cells: DataFrame, threshold: float = 0.5, min_px: int = 40, tolerance: float = 0.0, support_over: float = rules.SUPPORT_PROB, open_size: int = 5, sliver: int = 7, block: int = 256, split: bool = True) -> DataFrame:
    """Cells of classified objects: scene, seq (painting order), type, part (the object's name), r, c.

    cells: scene, epoch (0 earlier, 1 later), r, c, p, h, w. An object of the later date is new without support, rebuilt where its
    footprint fits the earlier ones badly, else existing; what is left without support of a partly supported object, slivers removed, is
    new, and the rest existing. Objects of the earlier date without support are demolished, in whole or in parts."""
    pad = int(np.rint(tolerance))
    t1, t2 = cells.where("epoch = 0"), cells.where("epoch = 1")

    def supports(t: DataFrame) -> DataFrame:
        s = t.where(F.col("p") > support_over).select(*KEY, "r", "c", "h", "w")
        return dilate(s, ellipse(2 * pad + 1)) if tolerance >= 1 else s

    s1, s2 = supports(t1), supports(t2)
    raw1 = t1.where(F.col("p") >= threshold).select(*KEY, "r", "c", "h", "w")
    tolerant = dilate(raw1, ellipse(2 * pad + 1)) if pad else raw1
    objects2, _ = written(objects_of(t2, threshold, min_px, open_size, block), "later")
    objects1, _ = written(objects_of(t1, threshold, min_px, open_size, block), "earlier")
    match = footprint_match(objects2, label(raw1, block), tolerant, pad)
    kind = supported_share(objects2, s1).join(match, ["scene", "label"]).select("scene", "label", F.when(F.col("support") < rules.NO_SUPPORT, "new").when(rules.is_rebuilt(F.col("overlap"), F.col("n_before"), F.col("contained")), "rebuilt").otherwise("existing").alias("type"))
    later = objects2.join(kind, ["scene", "label"])
    gone = supported_share(objects1, s2).select("scene", "label", F.when(F.col("support") < rules.NO_SUPPORT, "demolished").otherwise("matched").alias("type"))
    earlier = objects1.join(gone, ["scene", "label"])
    whole = lambda d, seq: d.select("scene", F.lit(seq).alias("seq"), "type", F.struct(F.lit(seq).alias("seq"), "label", F.lit(0).cast("long").alias("part")).alias("part"), "r", "c")
    if not split:
        return whole(later, 1).unionByName(whole(earlier.where("type = 'demolished'"), 2))

    def parts(d: DataFrame, support: DataFrame, how: str) -> DataFrame:
        cut = d.join(support.select("scene", "r", "c").distinct(), ["scene", "r", "c"], how).select(*KEY, F.col("label").alias("object"), "r", "c", "h", "w")
        return large_objects(label(opened(cut, ellipse(sliver), ["object"]), block, ["object"]), min_px, ["object"])

    partly = later.where("type = 'existing'")
    fresh, _ = written(parts(partly, s1, "left_anti"), "fresh")
    cut_up = fresh.select("scene", F.col("object").alias("label")).distinct()
    kept = parts(partly.join(cut_up, ["scene", "label"], "left_semi"), s1, "left_semi")
    lost = parts(earlier.where("type = 'matched'"), s2, "left_anti")
    part = lambda d, seq, type_: d.select("scene", F.lit(seq).alias("seq"), F.lit(type_).alias("type"), F.struct(F.lit(seq).alias("seq"), F.col("object").alias("label"), F.col("label").alias("part")).alias("part"), "r", "c")
    out = whole(later.where("type <> 'existing'").unionByName(partly.join(cut_up, ["scene", "label"], "left_anti")), 1)
    for more in (part(kept, 2, "existing"), part(fresh, 3, "new"), whole(earlier.where("type = 'demolished'"), 4), part(lost, 5, "demolished")):
        out = out.unionByName(more)
    return out


def measure(classified: DataFrame, cells: DataFrame) -> DataFrame:
    """A row per classified object: scene, type, part, area_px, confidence_pct, from the probabilities of both dates."""
    p = cells.groupBy("scene", "r", "c").agg(F.max(F.when(F.col("epoch") == 0, F.col("p"))).alias("p1"), F.max(F.when(F.col("epoch") == 1, F.col("p"))).alias("p2"))
    got = classified.join(p, ["scene", "r", "c"]).groupBy("scene", "type", "part").agg(F.count("*").alias("area_px"), F.avg("p1").alias("m1"), F.avg("p2").alias("m2"))
    old = F.col("type") == "demolished"
    return got.select("scene", "type", "part", "area_px", rules.confidence_pct(F.col("type"), F.when(old, F.col("m1")).otherwise(F.col("m2")), F.when(old, F.col("m2")).otherwise(F.col("m1"))).alias("confidence_pct"))


def label_mask(classified: DataFrame) -> DataFrame:
    """scene, r, c, type: the object painted last wins."""
    order = F.struct("seq", "part")
    return classified.groupBy("scene", "r", "c").agg(F.max_by("type", order).alias("type"))
