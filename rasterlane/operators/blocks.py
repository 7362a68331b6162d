"""Rasters as block rows: scene, epoch, y0, x0, bh, bw, h, w, bands, data (float32, band by band within a cell).

Neighbourhood operators see a block with a halo: every block sends the strips that its neighbours need, a target's pieces (nine at
most) meet by key, and the halo beyond the image is mirrored. So an image of any size is worked on block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlane.functions import rules

SCHEMA = "scene long, epoch int, y0 int, x0 int, bh int, bw int, h int, w int, bands int, data binary"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _array(row) -> np.ndarray:
    return np.frombuffer(row.data, np.float32).reshape(row.bh, row.bw, row.bands)


def split(images: DataFrame, size: int = 256) -> DataFrame:
    """images: scene, epoch, h, w, bands, data (uint8, row by row), as blocks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                x = np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, r.bands)
                rows = [(r.scene, r.epoch, y, c, b.shape[0], b.shape[1], r.h, r.w, r.bands, b.astype(np.float32).tobytes()) for y in range(0, r.h, size) for c in range(0, r.w, size) for b in [x[y : y + size, c : c + size]]]
                yield pd.DataFrame(rows, columns=_NAMES)

    return images.select("scene", "epoch", "h", "w", "bands", "data").mapInPandas(run, SCHEMA)


def with_halo(blocks: DataFrame, halo: int, size: int = 256) -> DataFrame:
    """Blocks whose data reaches halo cells further on each side; halo <= size. y0, x0, bh, bw still name the block."""

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                x = _array(r)
                for ty in range(r.y0 - size, r.y0 + size + 1, size):
                    for tx in range(r.x0 - size, r.x0 + size + 1, size):
                        if 0 <= ty < r.h and 0 <= tx < r.w:
                            bh, bw = min(size, r.h - ty), min(size, r.w - tx)
                            a, b = max(r.y0, ty - halo), min(r.y0 + r.bh, ty + bh + halo)
                            c, d = max(r.x0, tx - halo), min(r.x0 + r.bw, tx + bw + halo)
                            if a < b and c < d:
                                out.append((r.scene, r.epoch, ty, tx, bh, bw, r.h, r.w, r.bands, np.ascontiguousarray(x[a - r.y0 : b - r.y0, c - r.x0 : d - r.x0]).tobytes(), a, c, b - a, d - c))
            yield pd.DataFrame(out, columns=[*_NAMES, "py", "px", "ph", "pw"])

    pieces = blocks.mapInPandas(send, SCHEMA + ", py int, px int, ph int, pw int")
    key = [c for c in _NAMES if c != "data"]

    def meet(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        r = rows[0]
        y0, x0 = max(0, r["y0"] - halo), max(0, r["x0"] - halo)
        y1, x1 = min(r["h"], r["y0"] + r["bh"] + halo), min(r["w"], r["x0"] + r["bw"] + halo)
        whole = np.zeros((y1 - y0, x1 - x0, r["bands"]), np.float32)
        for p in rows:
            whole[p["py"] - y0 : p["py"] - y0 + p["ph"], p["px"] - x0 : p["px"] - x0 + p["pw"]] = np.frombuffer(p["data"], np.float32).reshape(p["ph"], p["pw"], -1)
        pad = ((halo - (r["y0"] - y0), halo - (y1 - r["y0"] - r["bh"])), (halo - (r["x0"] - x0), halo - (x1 - r["x0"] - r["bw"])), (0, 0))
        mode = "reflect" if min(whole.shape[:2]) > halo else "symmetric"
        return pa.table({**{c: [r[c]] for c in key}, "data": [np.pad(whole, pad, mode=mode).tobytes()]}, pa.schema([(c, {"scene": pa.int64()}.get(c, pa.int32())) for c in key] + [("data", pa.binary())]))

    return pieces.groupBy(*key).applyInArrow(meet, ", ".join(c for c in SCHEMA.split(", ")))


def mapped(blocks: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], halo: int = 0) -> DataFrame:
    """kernel on each block's array (rows, columns, bands), with its halo if there is one; it gives back the block itself, without the halo."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                x = np.frombuffer(r.data, np.float32).reshape(r.bh + 2 * halo, r.bw + 2 * halo, r.bands)
                y = np.asarray(kernel(x), np.float32).reshape(r.bh, r.bw, -1)
                out.append((*r[:8], y.shape[2], y.tobytes()))
            yield pd.DataFrame(out, columns=_NAMES)

    return blocks.select(*_NAMES).mapInPandas(run, SCHEMA)


def cells(blocks: DataFrame) -> DataFrame:
    """scene, epoch, r, c, p, h, w of one-band blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["scene", "epoch", "r", "c", "p", "h", "w"]
        for batch in batches:
            for r in batch.to_pylist():
                n = r["bh"] * r["bw"]
                i = np.arange(n)
                fill = lambda v, kind: pa.array(np.full(n, v), kind)
                yield pa.RecordBatch.from_arrays([fill(r["scene"], pa.int64()), fill(r["epoch"], pa.int32()), pa.array(r["y0"] + i // r["bw"], pa.int32()), pa.array(r["x0"] + i % r["bw"], pa.int32()), pa.array(np.frombuffer(r["data"], np.float32)), fill(r["h"], pa.int32()), fill(r["w"], pa.int32())], names)

    return blocks.select(*_NAMES).mapInArrow(run, "scene long, epoch int, r int, c int, p float, h int, w int")


def tiles(images: DataFrame, tile: int = 1024, overlap: int = 64) -> DataFrame:
    """Overlapping tiles of images, for a model: y0, x0 by the rule of starts; smaller images give one tile of their size. An image
    goes to its task once, and its tiles leave it one by one."""
    starts = images.select("scene", "epoch", "h", "w", "bands", "data", rules.tile_starts(F.col("h"), tile, overlap).alias("ys"), rules.tile_starts(F.col("w"), tile, overlap).alias("xs"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                whole = np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, r.bands)
                for y0 in r.ys:
                    for x0 in r.xs:
                        x = whole[y0 : y0 + tile, x0 : x0 + tile]
                        yield pd.DataFrame([(r.scene, r.epoch, y0, x0, x.shape[0], x.shape[1], r.h, r.w, r.bands, x.astype(np.float32).tobytes())], columns=_NAMES)

    return starts.mapInPandas(run, SCHEMA)


#: Mean and deviation of each band that the segmenter was trained with.
BAND_MEAN, BAND_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def normalised(rgb: np.ndarray) -> np.ndarray:
    """Bands of 0 to 255 as the segmenter takes them."""
    return ((np.asarray(rgb, np.float32) / 255 - np.array(BAND_MEAN, np.float32)) / np.array(BAND_STD, np.float32)).astype(np.float32)


def full_tiles(model: Callable[[np.ndarray], np.ndarray], tile: int = 1024) -> Callable[[np.ndarray], np.ndarray]:
    """A model of whole normalised tiles as one of tiles of any size: rows below and columns to the right are mirrored up to a full
    tile, and what it says of them is cut off again."""

    def run(rgb: np.ndarray) -> np.ndarray:
        h, w = rgb.shape[:2]
        padded = np.pad(rgb, ((0, max(0, tile - h)), (0, max(0, tile - w)), (0, 0)), mode="reflect")
        return np.asarray(model(normalised(padded)))[:h, :w]

    return run


def bright(rgb: np.ndarray) -> np.ndarray:
    """The stand-in for a model: cells whose mean is over 200."""
    return (rgb.mean(-1) > 200).astype(np.float32)


def predicted(tile_rows: DataFrame, model: Callable[[np.ndarray], np.ndarray] = bright, tile: int = 1024, overlap: int = 64, size: int = 256) -> DataFrame:
    """Probabilities as blocks: the model on every tile, feathered, cut along the blocks' grid and blended where tiles overlap (four
    pieces a block, or parts of them, at most). A model that needs full normalised tiles comes wrapped in full_tiles; a lost worker's tiles run again."""
    ramp = np.minimum(1.0, np.minimum(*(np.concatenate([np.linspace(0.05, 1, overlap), np.ones(tile - overlap)])[::s] for s in (1, -1))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                p = np.asarray(model(_array(r)), np.float32)
                wt = np.outer(ramp[: r.bh], ramp[: r.bw]).astype(np.float32)
                both = np.stack([p * wt, wt], -1)
                out = []
                for y in range(r.y0 // size * size, r.y0 + r.bh, size):
                    for x in range(r.x0 // size * size, r.x0 + r.bw, size):
                        a, b, c, d = max(y, r.y0), min(y + size, r.y0 + r.bh), max(x, r.x0), min(x + size, r.x0 + r.bw)
                        out.append((r.scene, r.epoch, y, x, min(size, r.h - y), min(size, r.w - x), r.h, r.w, 1, np.ascontiguousarray(both[a - r.y0 : b - r.y0, c - r.x0 : d - r.x0]).tobytes(), a, c, b - a, d - c))
                yield pd.DataFrame(out, columns=[*_NAMES, "py", "px", "ph", "pw"])

    pieces = tile_rows.mapInPandas(run, SCHEMA + ", py int, px int, ph int, pw int")
    key = [c for c in _NAMES if c != "data"]

    def blend(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        r = rows[0]
        total = np.zeros((r["bh"], r["bw"], 2), np.float32)
        for p in rows:
            a, c = p["py"] - r["y0"], p["px"] - r["x0"]
            total[a : a + p["ph"], c : c + p["pw"]] += np.frombuffer(p["data"], np.float32).reshape(p["ph"], p["pw"], 2)
        data = total[..., 0] / np.maximum(total[..., 1], 1e-6)
        return pa.table({**{c: [r[c]] for c in key}, "data": [data.tobytes()]}, pa.schema([(c, {"scene": pa.int64()}.get(c, pa.int32())) for c in key] + [("data", pa.binary())]))

    return pieces.groupBy(*key).applyInArrow(blend, SCHEMA)
