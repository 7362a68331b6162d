"""Outlines of objects, and cells of polygons.

`outline_points` numbers the corners of an object of any size: pieces of its border are traced inside blocks and put in order by
list ranking. `outlines` gives rings as arrays, for objects whose cells fit a row. Polygons are filled by runs of cells, each ring where it lies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlane.operators import kernels
from rasterlane.sources.shared import drop_path, written

POINT = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])
RING = T.ArrayType(POINT)


def _points(ring: list[tuple]) -> list[dict]:
    return [{"x": int(x), "y": int(y)} for x, y in ring]


def _ring(points) -> list[tuple[int, int]]:
    return [(p["x"], p["y"]) for p in points]


@F.pandas_udf(RING)
def _outlines(rs: pd.Series, cs: pd.Series) -> pd.Series:
    def one(r, c):
        r, c = np.asarray(r), np.asarray(c)
        y, x = r.min(), c.min()
        on = np.zeros((r.max() - y + 1, c.max() - x + 1), bool)
        on[r - y, c - x] = True
        return _points([(int(a + x), int(b + y)) for a, b in kernels.outline(on)])

    return pd.Series([one(r, c) for r, c in zip(rs, cs)])


def outlines(cells: DataFrame, key: list[str]) -> DataFrame:
    """key and ring: the outer border of each object. cells: key, r, c."""
    all_ = cells.groupBy(*key).agg(F.collect_list(F.struct("r", "c")).alias("p"))
    return all_.select(*key, _outlines(F.col("p.r"), F.col("p.c")).alias("ring"))


def simplified(ring: Column, share: float) -> Column:
    """The ring within `share` of its length; the ring itself where fewer than three points are left."""
    @F.pandas_udf(RING)
    def run(rings: pd.Series) -> pd.Series:
        def one(points):
            r = _ring(points)
            s = kernels.simplified(r, share * kernels.perimeter(r))
            return _points(s if len(s) >= 3 else r)

        return pd.Series([one(p) for p in rings])

    return run(ring)


@F.pandas_udf(RING)
def smallest_rectangle(rings: pd.Series) -> pd.Series:
    return pd.Series([_points(kernels.smallest_rectangle(_ring(p))) if len(p) else [] for p in rings])


@F.pandas_udf(RING)
def _hull(points: pd.Series) -> pd.Series:
    return pd.Series([_points(kernels.hull(_ring(p))) for p in points])


@F.pandas_udf(T.StructType([T.StructField("area", T.DoubleType()), T.StructField("ring", RING)]))
def _least(hulls: pd.Series) -> pd.DataFrame:
    found = [kernels.least_rectangle(_ring(p)) for p in hulls]
    return pd.DataFrame({"area": [a for a, _ in found], "ring": [_points(r) for _, r in found]})


def hulls(cells: DataFrame, key: list[str], rows: int = 256) -> DataFrame:
    """key and hull: the corners of the convex hull of each object's cells. cells: key, r, c; cells may repeat.

    A row of cells counts by its two ends, which are found before the shuffle. Hulls of `rows` rows are built first, then those of
    `rows` squared, then the whole: a hull of whole-number points has few corners (about the 2/3 power of its side), so no step holds an object's cells."""
    ends = cells.groupBy(*key, F.col("r").cast("int").alias("r")).agg(F.min("c").alias("a"), F.max("c").alias("b"))
    part = ends.withColumn("_p", F.explode(F.array_distinct(F.array(*[F.struct(F.col(x).cast("int").alias("x"), F.col("r").alias("y")) for x in "ab"]))))
    for step in (rows, rows * rows):
        block = F.floor(F.col("_p.y") / step).alias("_b")
        part = part.groupBy(*key, block).agg(F.collect_list("_p").alias("_p")).select(*key, F.explode(_hull("_p")).alias("_p"))
    return part.groupBy(*key).agg(F.collect_list("_p").alias("_p")).select(*key, _hull("_p").alias("hull"))


def least_rectangles(cells: DataFrame, key: list[str], rows: int = 256) -> DataFrame:
    """key, hull, area and ring of the least rectangle around each object's cells, whatever its size; objects in a line have an area of 0."""
    return hulls(cells, key, rows).withColumn("_l", _least("hull")).select(*key, "hull", F.col("_l.area").alias("area"), F.col("_l.ring").alias("ring"))


#: Crossings and border cells that are worked on at once, unless one ring has more.
MOST_ITEMS = 500_000


def _runs(x: np.ndarray, y: np.ndarray, ends: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ring, row, first and last column of the runs of cells of rings; x, y: points of all rings, ends: where each ring's points end."""
    n = np.diff(ends, prepend=0)
    ring = np.repeat(np.arange(len(n)), n)
    after = np.arange(1, len(x) + 1)
    after[ends - 1] = ends - n
    x0, y0, x1, y1, rows, cols = x, y, x[after], y[after], h[ring], w[ring]
    tall, wide = int(h.max()), int(w.max()) + 1  # a place in all rings: (ring * tall + row) * wide + column

    def counted(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The side and the number of each of `count` numbers from `first` on."""
        side = np.repeat(np.arange(len(count)), count)
        return side, first[side] + np.arange(len(side)) - np.repeat(np.cumsum(count) - count, count)

    top = np.maximum(np.minimum(y0, y1), 0)
    s, r = counted(top, np.maximum(np.minimum(np.maximum(y0, y1), rows) - top, 0))
    at = np.ceil(x0[s] + (r - y0[s]) * (x1[s] - x0[s]) / (y1[s] - y0[s])).astype(np.int64)
    cross = np.sort((ring[s] * tall + r) * wide + np.clip(at, 0, cols[s]))  # an even number in each row
    steps = np.maximum(np.maximum(np.abs(x1 - x0), np.abs(y1 - y0)), 1)
    s, i = counted(np.zeros_like(steps), steps + 1)
    t = np.where(i == steps[s], 1.0, i * (1.0 / steps[s]))
    r, c = (np.rint(a[s] + (b[s] - a[s]) * t).astype(np.int64) for a, b in ((y0, y1), (x0, x1)))
    inside = (r >= 0) & (c >= 0) & (r < rows[s]) & (c < cols[s])
    border = ((ring[s] * tall + r) * wide + c)[inside]
    some = cross[1::2] > cross[::2]
    # the first i runs by their start are all over before the next one where the i-th end lies before its start
    start, end = np.sort(np.concatenate([cross[::2][some], border])), np.sort(np.concatenate([cross[1::2][some] - 1, border]))
    gap = start[1:] > end[:-1] + 1
    start, end = start[np.append(True, gap)] if len(start) else start, end[np.append(gap, True)] if len(end) else end
    line = start // wide
    return line // tall, line % tall, start % wide, end - line * wide


def filled_runs(rings: DataFrame, key: list[str]) -> DataFrame:
    """key, h, w, r, a, b: the cells of each ring (column ring) inside the image (h, w) as runs of columns a to b of row r, none of which
    meet: centres inside by the even-odd rule, and the border. The key tells rings apart.

    Every side of a ring gives its crossing with each row of cells, half open; crossings of a row are sorted, and each odd one opens a
    run that the next one closes. A ring is a row and is filled where it lies, MOST_ITEMS crossings and border cells at once or one ring's.
    A ring that is null or empty, or holds a null, has no cells."""
    schema = T.StructType([*rings.select(*key, "h", "w").schema.fields, *T._parse_datatype_string("r int, a int, b int").fields])
    part = lambda f: F.transform("ring", lambda p: p[f].cast("long")).alias(f"_{f}")
    whole = rings.where((F.size("ring") > 0) & F.forall("ring", lambda p: p["x"].isNotNull() & p["y"].isNotNull()) & (F.col("h") > 0) & (F.col("w") > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("h", "w"))
            x, y = batch.column("_x"), batch.column("_y")
            n = x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            x, y = x.flatten().to_numpy(zero_copy_only=False), y.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(n)
            first = ends - n
            # at most two numbers for each cell that a side passes
            far = np.maximum(np.abs(np.diff(x, append=x[:1])), np.abs(np.diff(y, append=y[:1]))) + 2
            size = np.add.reduceat(far, first) * 2 if len(n) else n
            s = 0
            while s < len(n):
                e = max(s + 1, s + int(np.searchsorted(np.cumsum(size[s:]), MOST_ITEMS, "right")))
                while e > s + 1 and (e - s) * int(h[s:e].max()) * (int(w[s:e].max()) + 1) >= 1 << 62:
                    e = (s + e) // 2
                points = slice(first[s], ends[e - 1])
                ring, *out = _runs(x[points], y[points], ends[s:e] - first[s], h[s:e], w[s:e])
                own = [batch.column(k).take(pa.array(ring + s)) for k in range(batch.num_columns - 2)]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(v.astype(np.int32)) for v in out]], schema.names)
                s = e

    return whole.select(*key, "h", "w", part("x"), part("y")).mapInArrow(run, schema)


def filled(rings: DataFrame, key: list[str]) -> DataFrame:
    """key, h, w, r, c: the same cells, a row each."""
    return filled_runs(rings, key).select(*key, "h", "w", "r", F.explode(F.sequence("a", "b")).alias("c"))


#: Directions of the eight neighbours as (row, column), clockwise from the right.
AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def _edge(r, c, d):
    """The number of the step that reaches cell (r, c) in direction d; r below 2^31, c below 2^28."""
    return (r << 31) | (c << 3) | d


def border_pieces(r: np.ndarray, c: np.ndarray, by: int, bx: int, size: int) -> list[dict]:
    """Pieces of borders in a block, from the set cells within two cells of it.

    The step from a set cell to a set neighbour is followed by that to the first set cell clockwise from where it came. This pairs
    steps one to one, so they fall into cycles; those inside four set cells in a square are left out. A step belongs to the block of
    the cell it reaches. A piece begins at a step from outside, or at one that an outline may start with: from a cell that has no
    set cell before it, to its first neighbour. It has the number of its first step (node), of the step after its last (next), its corners
    in order (the cells left by a turning step), and where an outline may start, that cell (row, column)."""
    y0, x0 = by * size, bx * size
    on = np.zeros((size + 6, size + 6), bool)  # three cells around the block: set ones reach two
    on[r - y0 + 3, c - x0 + 3] = True
    roll = lambda y, x, d: on[y + AROUND[d][0], x + AROUND[d][1]]
    qs, ds = [], []
    for d, (i, j) in enumerate(AROUND):
        y, x = np.nonzero(on[3:-3, 3:-3] & on[3 - i : size + 3 - i, 3 - j : size + 3 - j])
        y, x = y + 3, x + 3
        py, px = y - i, x - j
        square = roll(py, px, (d - 1) % 8) & roll(py, px, (d + 1) % 8) if d % 2 else roll(py, px, (d - 2) % 8) & roll(y, x, (d - 2) % 8)
        keep = ~square
        qs.append(np.stack([y[keep], x[keep]], 1))
        ds.append(np.full(int(keep.sum()), d))
    q, d = np.concatenate(qs), np.concatenate(ds)
    if not len(q):
        return []
    step = np.array(AROUND)
    p = q - step[d]
    near = lambda at, way: on[at[:, 0] + step[way, 0], at[:, 1] + step[way, 1]]
    ahead, behind = np.full(len(q), -1), np.full(len(q), -1)
    for k in range(1, 9):
        way = (d + 4 + k) % 8
        ahead = np.where((ahead < 0) & near(q, way), way, ahead)
        way = (d - k) % 8
        behind = np.where((behind < 0) & near(p, way), way, behind)
    turns = (behind + 4) % 8 != d
    first = np.full(len(q), 8)
    for way in range(3, -1, -1):
        first = np.where(near(p, np.full(len(q), way)), way, first)
    free = ~np.any([near(p, np.full(len(q), way)) for way in (4, 5, 6, 7)], 0)
    may_start = free & (first == d)
    foreign = (p < 3).any(1) | (p >= size + 3).any(1)
    head = may_start | foreign
    n = q + step[ahead]
    place = lambda at: (at[:, 0].astype(np.int64) + y0 - 3, at[:, 1].astype(np.int64) + x0 - 3)
    number, after = _edge(*place(q), d), _edge(*place(n), ahead)
    order = np.argsort(number)
    to = order[np.minimum(np.searchsorted(number, after, sorter=order), len(order) - 1)]
    inner = number[to] == after
    pr, pc = place(p)
    out = []
    for h in np.flatnonzero(head).tolist():
        e, corners = h, []
        while True:
            if turns[e]:
                corners.append({"x": int(pc[e]), "y": int(pr[e])})
            if not inner[e] or head[to[e]]:
                break
            e = int(to[e])
        out.append({"node": int(number[h]), "next": int(after[e]), "corners": corners, "start": {"r": int(pr[h]), "c": int(pc[h])} if may_start[h] else None})
    return out


def outline_points(cells: DataFrame, key: list[str], size: int = 256) -> DataFrame:
    """key, n (long, from 0), x, y: the corners of the outer border of each object, in the order of `kernels.outline`. cells: key, r, c;
    the key is not null, places are not negative, rows may repeat. Of an object in several parts that with the first cell is outlined.

    No object meets in one group: a block has its own cells and those within two of it. Pieces of borders are then ranked by pointer
    doubling: each knows how many corners lie between itself and a piece further back, and takes over what that one knows, until
    all that lie on an outer border have come to its start. Every round is written to the shared folder. Its joins are never turned into
    broadcasts: numbers are far smaller in files than in memory, and what is sent would grow with the input."""
    spark = cells.sparkSession
    at = cells.select(*key, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))
    blocks = lambda x: F.array_distinct(F.array(*[F.floor((F.col(x) + i) / size) for i in (-2, 2)]))
    spread = at.withColumn("_by", F.explode(blocks("r"))).withColumn("_bx", F.explode(blocks("c"))).where("_by >= 0 AND _bx >= 0")
    kinds = {f.name: f.dataType for f in at.schema.fields}
    piece = T.StructType([T.StructField(k, kinds[k]) for k in key] + T._parse_datatype_string("node long, next long, corners array<struct<x:int,y:int>>, start struct<r:long,c:long>").fields)

    group = [*key, "_by", "_bx"]

    def trace(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks follow each other in order, so that many small ones share a batch; the last of a batch may go on in the next."""

        def pieces_of(frame: pd.DataFrame, bounds: list[int]) -> pd.DataFrame:
            heads, by, bx = frame[key].to_numpy(object), frame["_by"].to_numpy(), frame["_bx"].to_numpy()
            r, c, out = frame["r"].to_numpy(), frame["c"].to_numpy(), []
            own = (r // size == by) & (c // size == bx)
            for a, b in zip(bounds, bounds[1:]):
                if own[a:b].any():
                    name = dict(zip(key, heads[a]))
                    out += [{**name, **f} for f in border_pieces(r[a:b], c[a:b], int(by[a]), int(bx[a]), size)]
            return pd.DataFrame(out, columns=piece.names)

        left = None
        for frame in frames:
            frame = frame if left is None else pd.concat([left, frame], ignore_index=True)
            if len(frame):
                at = np.flatnonzero((frame[group] != frame[group].shift()).any(axis=1)).tolist()
                left = frame.iloc[at[-1] :].drop_duplicates()
                yield pieces_of(frame, at)
        if left is not None:
            yield pieces_of(left, [0, len(left)])

    pieces, pieces_path = written(spread.repartition(*group).sortWithinPartitions(*group).mapInPandas(trace, piece), "pieces")
    firsts = at.groupBy(*key).agg(F.min(F.struct("r", "c")).alias("_first"))
    starts = pieces.where("start IS NOT NULL").groupBy(*key).agg(F.min(F.struct("start.r", "start.c", "node")).alias("_s"))
    starts = firsts.join(starts.hint("merge"), key, "left").withColumn("_node", F.when((F.col("_s.r") == F.col("_first.r")) & (F.col("_s.c") == F.col("_first.c")), F.col("_s.node")))
    starts, starts_path = written(starts.select(*key, "_first", "_node"), "starts")
    count = F.size("corners").cast("long")
    back = pieces.select(*key, F.col("next").alias("node"), F.col("node").alias("back"), count.alias("_k"))
    heads = starts.where("_node IS NOT NULL").select(*key, F.col("_node").alias("node"), F.lit(True).alias("_is_start"))
    chain = back.join(heads.hint("merge"), [*key, "node"], "left").select(*key, "node", F.when(F.col("_is_start").isNull(), F.col("back")).alias("back"), F.when(F.col("_is_start").isNull(), F.col("_k")).otherwise(0).alias("_k"))
    chain, path = written(chain, "chain")
    done = chain.where("back IS NULL").count()
    while done:
        far = chain.select(*key, F.col("node").alias("back"), F.col("back").alias("_back"), F.col("_k").alias("_far"))
        step = chain.join(far.hint("merge"), [*key, "back"], "left").select(*key, "node", F.col("_back").alias("back"), (F.col("_k") + F.coalesce("_far", F.lit(0))).alias("_k"))
        new, new_path = written(step, "chain")
        now = new.where("back IS NULL").count()
        drop_path(spark, path)
        chain, path, before, done = new, new_path, done, now
        if now == before:  # what is left lies around holes and never comes to a start
            break
    ranked = chain.where("back IS NULL").select(*key, "node", "_k").join(pieces.select(*key, "node", "corners").hint("merge"), [*key, "node"])
    ring = ranked.select(*key, "_k", F.posexplode("corners").alias("_i", "_p")).select(*key, (F.col("_k") + F.col("_i")).alias("n"), "_p.x", "_p.y")
    alone = starts.where("_node IS NULL").select(*key, F.lit(0).cast("long").alias("n"), F.col("_first.c").cast("int").alias("x"), F.col("_first.r").cast("int").alias("y"))
    out, _ = written(ring.unionByName(alone), "outline")
    for p in (path, pieces_path, starts_path):
        drop_path(spark, p)
    return out
