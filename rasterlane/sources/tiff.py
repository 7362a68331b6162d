"""Pixels of TIFF files: a file's strips or tiles leave its task one by one as rows, are stretched to eight bits by the levels of
the whole file, and meet again as RGB.

Read are gray, RGB and palette images of 8, 16 or 32 bits a sample (whole numbers or floats), interleaved or in planes, as strips or tiles,
plain or packed by LZW, deflate or PackBits, with or without differences along rows. Other files, and damaged ones, are left out.
Of one or two bands the first is taken three times, of more the first three; cells that are no finite number count as 0."""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlane.operators.percentiles import percentiles

#: Fixed values of the format: tags, sizes of field kinds, compressions, sample formats.
WIDTH, HEIGHT, BITS, COMPRESSION, MEANING, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, PALETTE = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 320
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 322, 323, 324, 325, 339
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WHITE_IS_0, BLACK_IS_0, RGB, BY_PALETTE = 0, 1, 2, 3
KINDS = {1: "B", 3: "H", 4: "I"}
FORMATS = {1: "u", 2: "i", 3: "f"}

NAMES = "*.{tif,tiff,TIF,TIFF}"
PIECE = "path string, y0 int, x0 int, bh int, bw int, h int, w int, band int, n int, bands int, data binary"
_PIECE = [c.split()[0] for c in PIECE.split(", ")]
AT_ONCE = 4_000_000  # bytes of pieces that leave a task together


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears the table, 257 ends; codes widen one code early."""
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    words, width, last, out = list(start), 9, None, []
    held = bits = 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            words, width, last = list(start), 9, None
            continue
        if last is None:
            word = words[code]
        else:
            word = words[code] if code < len(words) else last + last[:1]
            words.append(last + word[:1])
        out.append(word)
        last = word
        width = min(12, max(9, (len(words) + 1).bit_length()))
    return b"".join(out)


def unpack_bits(data: bytes) -> bytes:
    """Runs: a count below 128 precedes bytes as they are, one above 128 a byte to be repeated."""
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            out.append(data[at + 1 : at + 2] * (257 - n) if n > 128 else b"")
            at += 2 if n > 128 else 1
    return b"".join(out)


UNPACK = {PLAIN: bytes, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_bits}


def _directory(data: bytes, order: str) -> dict[int, tuple]:
    """Whole-number fields of the first directory."""
    at = struct.unpack_from(order + "I", data, 4)[0]
    out = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        entry = at + 2 + 12 * i
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        if kind in KINDS:
            form = f"{order}{count}{KINDS[kind]}"
            where = entry + 8 if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            out[tag] = struct.unpack_from(form, data, where)
    return out


def pieces_of(path: str, data: bytes) -> Iterator[tuple]:
    """The file's strips or tiles as PIECE rows, cells as float32; nothing after what cannot be read."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        return
    d = _directory(data, order)
    one = lambda tag, default: d.get(tag, (default,))[0]
    w, h, bands, planes = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(PLANAR, 1) == 2
    kind = np.dtype(f"{order}{FORMATS[one(FORMAT, 1)]}{one(BITS, 1) // 8}")
    unpack, predictor, meaning = UNPACK[one(COMPRESSION, PLAIN)], one(PREDICTOR, 1), one(MEANING, BLACK_IS_0)
    lut = np.array(d[PALETTE]).reshape(3, -1).T >> 8 if meaning == BY_PALETTE else None
    if predictor > 2 or len(set(d[BITS])) > 1 or meaning not in (WHITE_IS_0, BLACK_IS_0, RGB, BY_PALETTE):
        raise ValueError("samples of a kind that is not read")
    tiled = TILE_OFFSETS in d
    th, tw = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(h, one(ROWS, h)), w)
    n = 1 if planes else bands
    places = itertools.product(range(bands if planes else 1), range(0, h, th), range(0, w, tw))
    for (band, y, x), at, size in zip(places, d[TILE_OFFSETS if tiled else OFFSETS], d[TILE_COUNTS if tiled else COUNTS], strict=True):
        bh, bw = min(th, h - y), min(tw, w - x)
        rows = th if tiled else bh
        a = np.frombuffer(unpack(data[at : at + size]), kind, rows * tw * n).reshape(rows, tw, n)
        if predictor == 2:
            a = np.cumsum(a, 1, dtype=kind.newbyteorder("="))
        if meaning == WHITE_IS_0 and kind.itemsize == 1:
            a = 255 - a
        if lut is not None:
            a = lut[a[:, :, 0]]
        with np.errstate(over="ignore"):
            cells = np.nan_to_num(a[:bh, :bw].astype(np.float32), nan=0.0, posinf=0.0, neginf=0.0)
        yield path, y, x, bh, bw, h, w, band, *((n, bands) if lut is None else (3, 3)), cells.tobytes()


def pieces(files: DataFrame) -> DataFrame:
    """files: path, content. PIECE rows of the files that can be read as a whole."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame.path, frame.content):
                try:
                    for _ in pieces_of(path, content):  # a damaged file gives no part of itself
                        pass
                except (ValueError, KeyError, TypeError, IndexError, struct.error, zlib.error):
                    continue
                some, size = [], 0
                for p in pieces_of(path, content):
                    some.append(p)
                    size += len(p[-1])
                    if size >= AT_ONCE:
                        yield pd.DataFrame(some, columns=_PIECE)
                        some, size = [], 0
                yield pd.DataFrame(some, columns=_PIECE)

    return files.select("path", "content").where(F.col("content").isNotNull()).mapInPandas(run, PIECE)


def levels(parts: DataFrame) -> DataFrame:
    """path, top, low, high: the greatest value of the first three bands, and their 2nd and 98th percentile."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                v, n = np.unique(np.frombuffer(r.data, np.float32).reshape(-1, r.n)[:, :3], return_counts=True)
                yield pd.DataFrame({"path": r.path, "v": v, "k": n})

    counted = parts.where("band < 3").select("path", "n", "data").mapInPandas(run, "path string, v float, k long")
    q = percentiles(counted, ["path"], "v", [0.02, 0.98, 1.0], "k")
    return q.select("path", F.col("q")[2].alias("top"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, h, w, bands, data (RGB, uint8) of TIFF files; images with values over 255 are stretched between their percentiles."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", NAMES).load(path).select("path", "content")
    parts = pieces(files)

    def whole(f: pd.DataFrame) -> pd.DataFrame:
        r = f.iloc[0]
        out = np.zeros((r.h, r.w, 3), np.uint8)
        for p in f.itertuples():
            x = np.frombuffer(p.data, np.float32).reshape(p.bh, p.bw, p.n)
            if p.top > 255:
                x = (x - np.float32(p.low)) / np.float32(max(p.high - p.low, 1e-6)) * np.float32(255)
            x = np.clip(x, 0, 255).astype(np.uint8)
            here = out[p.y0 : p.y0 + p.bh, p.x0 : p.x0 + p.bw]
            if p.bands < 3:
                if p.band == 0:
                    here[:] = x[:, :, :1]
            elif p.n > 1:
                here[:] = x[:, :, :3]
            elif p.band < 3:
                here[:, :, p.band] = x[:, :, 0]
        return pd.DataFrame([(r.path, r.h, r.w, 3, out.tobytes())], columns=["path", "h", "w", "bands", "data"])

    return parts.join(levels(parts), "path").groupBy("path").applyInPandas(whole, "path string, h int, w int, bands int, data binary")
