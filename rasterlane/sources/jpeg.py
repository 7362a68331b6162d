"""JPEG files as bytes in a column: pixels of baseline files, baseline files of pixels, and sizes from headers alone.

Decoding reads Huffman symbols through tables of 16 bits, then works on all blocks of a component at once: dequantisation, inverse
cosine transform, and upsampling of halved colour planes with weights 3 and 1. Encoding keeps colour at full size, transforms all
blocks at once, and writes Huffman tables that fit the image (canonical codes of 16 bits at most). Files that are damaged,
progressive, arithmetic, lossless, of 12 bits or of four components give null."""

from __future__ import annotations

import heapq
import struct
from array import array
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the standard: quantisation of brightness and of colour at quality 50, row by row.
BRIGHTNESS = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
COLOUR = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32
#: Places of a block in the order of the file: diagonals in turn.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
_COSINES = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
HEADER_BYTES = 65_536  # of a file, that its size is looked for in first


class NotReadable(ValueError):
    """Not a JPEG file, or of a kind that is left out."""


def _segments(data: bytes):
    """(marker, content) up to and with the start of a scan; last (0, place of the coded data)."""
    if data[:2] != b"\xff\xd8":
        raise NotReadable("no JPEG")
    at = 2
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if len(data) < at + 4 or data[at] != 0xFF:
            raise NotReadable("a marker is missing")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDA:
            yield 0, at
            return


def size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of a PNG's or JPEG's first bytes; None if they do not tell."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    try:
        for marker, content in _segments(data):
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(content) >= 5:
                h, w = struct.unpack(">HH", content[1:5])
                return (w, h)
    except NotReadable:
        pass
    return None


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For the next 16 bits: length of the code in front, times 256, and its symbol; 0 for no code."""
    out, code, at = np.zeros(65536, np.int32), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            first = code << (16 - length)
            if first + (1 << (16 - length)) > 65536 or at >= len(symbols):
                raise NotReadable("Huffman table")
            out[first : first + (1 << (16 - length))] = length << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out.tolist()


def _coefficients(coded: bytes, n_blocks: int, tables: list) -> array:
    """Values at block * 64 + place in file order. tables: (dc, ac, component) of each block of a unit in turn; the
    caller gives a stretch between restarts."""
    coded = coded.replace(b"\xff\x00", b"\xff")
    raw = np.frombuffer(coded + b"\xff" * 8, np.uint8).astype(np.int64)
    window = (raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]).tolist()
    end, at, out = len(coded) * 8 + 16, 0, array("i", bytes(256 * n_blocks))
    before = [0] * (1 + max(t[2] for t in tables))
    unit = len(tables)
    for b in range(n_blocks):
        dc, ac, component = tables[b % unit]
        k, base = 0, b * 64
        while k < 64:
            if at > end:
                raise NotReadable("the data end early")
            got = (ac if k else dc)[(window[at >> 3] >> (16 - (at & 7))) & 0xFFFF]
            if not got:
                raise NotReadable("no such code")
            at += got >> 8
            run, bits = (got >> 4) & 15, got & 15
            if k == 0:
                run, bits = 0, got & 0xFF
                if bits > 11:
                    raise NotReadable("a difference is too long")
            elif bits == 0:
                if run < 15:
                    break
                k += 16
                continue
            k += run
            value = 0
            if bits:
                if at > end:
                    raise NotReadable("the data end early")
                value = (window[at >> 3] >> (32 - bits - (at & 7))) & ((1 << bits) - 1)
                at += bits
                if value < 1 << (bits - 1):
                    value -= (1 << bits) - 1
            if k == 0:
                before[component] = value = before[component] + value
            elif k > 63:
                raise NotReadable("a run is too long")
            out[base + k] = value
            k += 1
    return out


def _plane(values: np.ndarray, quantisers: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Samples (rows * 8, columns * 8) of blocks in file order of coefficients."""
    block = np.zeros((len(values), 64))
    block[:, ZIGZAG] = values * quantisers
    block = _COSINES.T @ block.reshape(-1, 8, 8) @ _COSINES
    return np.clip(np.rint(block) + 128, 0, 255).astype(np.int32).reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, columns * 8)


def _doubled(x: np.ndarray, axis: int, near: int, far: int, add: tuple[int, int], shift: int) -> np.ndarray:
    """Twice as many samples along an axis, each of the nearest and the one beyond it."""
    x = np.moveaxis(x, axis, 0)
    edge = np.concatenate([x[:1], x, x[-1:]])
    out = np.empty((2 * len(x), *x.shape[1:]), np.int32)
    out[::2], out[1::2] = (near * x + far * edge[:-2] + add[0]) >> shift, (near * x + far * edge[2:] + add[1]) >> shift
    return np.moveaxis(out, 0, axis)


def _upsampled(x: np.ndarray, ry: int, rx: int) -> np.ndarray:
    if (ry, rx) == (2, 2):
        return _doubled(_doubled(x, 0, 3, 1, (0, 0), 0), 1, 3, 1, (8, 7), 4)
    if (ry, rx) == (1, 2):
        return _doubled(x, 1, 3, 1, (1, 2), 2)
    return x.repeat(ry, 0).repeat(rx, 1)


def decoded(data: bytes) -> np.ndarray:
    """RGB (h, w, 3) uint8 of a baseline file. Raises NotReadable."""
    quantisers, huffman, frame, interval, colours, at = {}, {}, None, 0, None, 0
    for marker, content in _segments(data):
        if marker == 0xDB:
            while content:
                wide, k = content[0] >> 4, content[0] & 15
                quantisers[k] = np.frombuffer(content[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                content = content[65 + 64 * wide :]
        elif marker == 0xC4:
            while content:
                n = sum(content[1:17])
                huffman[content[0]] = _lookup(content[1:17], content[17 : 17 + n])
                content = content[17 + n :]
        elif marker in (0xC0, 0xC1):
            bits, h, w, n = struct.unpack(">BHHB", content[:6])
            frame = [(content[6 + 3 * i], content[7 + 3 * i] >> 4, content[7 + 3 * i] & 15, content[8 + 3 * i]) for i in range(n)]
            if bits != 8 or n not in (1, 3) or not h or not w:
                raise NotReadable("bits or components")
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise NotReadable("not baseline")
        elif marker == 0xDD:
            interval = int.from_bytes(content[:2], "big")
        elif marker == 0xEE and content[:5] == b"Adobe":
            colours = content[11]
        elif marker == 0xDA:
            scan = {content[1 + 2 * i]: content[2 + 2 * i] for i in range(content[0])}
        elif marker == 0:
            at = content
    if frame is None or set(scan) != {f[0] for f in frame}:
        raise NotReadable("several scans")
    if len(frame) == 1:
        frame = [(frame[0][0], 1, 1, frame[0][3])]
    my, mx = max(f[2] for f in frame), max(f[1] for f in frame)
    if any(my % f[2] or mx % f[1] for f in frame):
        raise NotReadable("sampling")
    units_y, units_x = -(-h // (8 * my)), -(-w // (8 * mx))
    tables = [(huffman[scan[f[0]] >> 4], huffman[16 + (scan[f[0]] & 15)], i) for i, f in enumerate(frame) for _ in range(f[1] * f[2])]
    unit, units = len(tables), units_y * units_x
    body, stop = [], len(data)
    start = look = at
    while (m := data.find(b"\xff", look)) >= 0 and m + 1 < len(data):  # restarts cut the data
        if 0xD0 <= data[m + 1] <= 0xD7:
            body.append(data[start:m])
            start = m + 2
        elif data[m + 1] != 0 and data[m + 1] != 0xFF:
            stop = m
            break
        look = m + (1 if data[m + 1] == 0xFF else 2)
    body.append(data[start:stop])
    step = interval or units
    if len(body) < -(-units // step):
        raise NotReadable("a restart is missing")
    values = [np.frombuffer(_coefficients(body[i], min(step, units - i * step) * unit, tables), np.int32) for i in range(-(-units // step))]
    blocks = np.concatenate(values).astype(np.int64).reshape(units_y, units_x, unit, 64)
    planes, first = [], 0
    for _, fx, fy, q in frame:
        own = blocks[:, :, first : first + fx * fy].reshape(units_y, units_x, fy, fx, 64).swapaxes(1, 2).reshape(-1, 64)
        first += fx * fy
        x = _plane(own, quantisers[q], units_y * fy, units_x * fx)[: -(-h * fy // my), : -(-w * fx // mx)]
        planes.append(_upsampled(x, my // fy, mx // fx)[:h, :w])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
    if colours == 0:
        return np.stack(planes, 2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    fixed = lambda v: int(v * 65536 + 0.5)
    red, blue = y + ((fixed(1.402) * cr + 32768) >> 16), y + ((fixed(1.772) * cb + 32768) >> 16)
    green = y + ((-fixed(0.344136) * cb - fixed(0.714136) * cr + 32768) >> 16)
    return np.clip(np.stack([red, green, blue], 2), 0, 255).astype(np.uint8)


def _code_lengths(frequencies: Counter) -> tuple[list[int], list[int]]:
    """How many codes have each length from 1 to 16, and the symbols from the most frequent on. No code is all ones."""
    heap = [(n, i, (s,)) for i, (s, n) in enumerate(sorted(frequencies.items()))] + [(0, -1, (256,))]  # 256 takes the code of all ones
    heapq.heapify(heap)
    depth, serial = Counter(), len(heap)
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        depth.update(a + b)
        heapq.heappush(heap, (n + m, serial, a + b))
        serial += 1
    counts = [0] * (max(depth.values()) + 2)
    for d in depth.values():
        counts[d] += 1
    for i in range(len(counts) - 1, 16, -1):  # too long codes go in pairs: one up, one beside a shorter
        while counts[i] > 0:
            j = max(k for k in range(1, i - 1) if counts[k])
            counts[i] -= 2
            counts[i - 1] += 1
            counts[j + 1] += 2
            counts[j] -= 1
    counts = (counts + [0] * 17)[:17]
    counts[max(k for k in range(17) if counts[k])] -= 1
    return counts[1:], sorted(frequencies, key=lambda s: (depth[s], s))


def _bits(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Values of some bits each, one after the other, filled up with ones."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    place = np.repeat(ends, lengths) - 1 - np.arange(total)
    bits = (np.repeat(values, lengths) >> place) & 1
    return np.packbits(np.concatenate([bits, np.ones(-total % 8, np.int64)]).astype(np.uint8)).tobytes()


def encoded(rgb: np.ndarray, quality: int = 90) -> bytes:
    """A baseline file of RGB (h, w, 3) uint8."""
    h, w = rgb.shape[:2]
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    quantisers = [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (BRIGHTNESS, COLOUR)]
    x = np.pad(rgb.astype(np.float64), ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    y = x @ [0.299, 0.587, 0.114]
    planes = [y - 128, (x[:, :, 2] - y) / 1.772, (x[:, :, 0] - y) / 1.402]
    blocks = []
    for i, p in enumerate(planes):
        b = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        blocks.append(np.rint((_COSINES @ b @ _COSINES.T).reshape(-1, 64) / quantisers[min(i, 1)]).astype(np.int64)[:, ZIGZAG])
    values = np.stack(blocks, 1)  # block, component, place
    values[:, :, 0] -= np.concatenate([np.zeros((1, 3), np.int64), values[:-1, :, 0]])
    flat = values.reshape(-1, 64)
    at, place = np.nonzero(np.concatenate([np.ones((len(flat), 1), bool), flat[:, 1:] != 0], 1))  # the first of a block always
    number = flat[at, place]
    bits = np.where(number == 0, 0, np.floor(np.log2(np.maximum(1, np.abs(number)))).astype(np.int64) + 1)
    first = place == 0
    run = np.where(first, 0, place - np.concatenate([[0], place[:-1]]) - 1)
    last = np.concatenate([at[1:] != at[:-1], [True]]) & (place < 63)  # an end of block follows
    # symbols in order: as many runs of 16 as needed, the symbol with its bits, the end of the block
    many = run // 16
    n = many + 1 + last
    ends = np.cumsum(n)
    symbol, extra, length = np.full(ends[-1], 0xF0, np.int64), np.zeros(ends[-1], np.int64), np.zeros(ends[-1], np.int64)
    own = ends - 1 - last
    symbol[own], extra[own], length[own] = np.where(first, bits, run % 16 << 4 | bits), np.where(number < 0, number + (1 << bits) - 1, number), bits
    symbol[ends[last] - 1] = 0
    is_dc = np.zeros(ends[-1], bool)
    is_dc[own[first]] = True
    kind = np.repeat(np.minimum(at % 3, 1), n) + np.where(is_dc, 0, 2)
    code, code_length, tables = np.zeros(ends[-1], np.int64), np.zeros(ends[-1], np.int64), b""
    for k in range(4):
        mine = kind == k
        counts, symbols = _code_lengths(Counter(dict(zip(*(v.tolist() for v in np.unique(symbol[mine], return_counts=True))))))
        table, value, i = np.zeros((256, 2), np.int64), 0, 0
        for size_, c in enumerate(counts, 1):
            for _ in range(c):
                table[symbols[i]] = value, size_
                value, i = value + 1, i + 1
            value <<= 1
        code[mine], code_length[mine] = table[symbol[mine]].T
        tables += bytes([(k >> 1) << 4 | k & 1, *counts, *symbols])
    coded = _bits(code << length | extra, code_length + length).replace(b"\xff", b"\xff\x00")
    part = lambda marker, content: bytes([0xFF, marker]) + struct.pack(">H", len(content) + 2) + content
    frame = struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1])
    return (b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + b"".join(part(0xDB, bytes([i, *q[ZIGZAG].tolist()])) for i, q in enumerate(quantisers))
            + part(0xC0, frame) + part(0xC4, tables) + part(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0])) + coded + b"\xff\xd9")


def pixels_or_none(data: bytes | None) -> np.ndarray | None:
    try:
        return decoded(data) if data else None
    except (NotReadable, IndexError, KeyError, ValueError, UnboundLocalError):
        return None


@F.pandas_udf(T.StructType([T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("data", T.BinaryType())]))
def jpeg_pixels(content: pd.Series) -> pd.DataFrame:
    """Height, width and RGB bytes, row by row, of JPEG files; nulls where a file is not readable."""
    got = [pixels_or_none(c) for c in content]
    return pd.DataFrame([(None, None, None) if x is None else (x.shape[0], x.shape[1], x.tobytes()) for x in got], columns=["h", "w", "data"]).astype({"h": "Int32", "w": "Int32"})


@F.pandas_udf(T.BinaryType())
def jpeg_of(h: pd.Series, w: pd.Series, rgb: pd.Series) -> pd.Series:
    """JPEG files (quality 90) of RGB bytes, row by row."""
    return pd.Series([encoded(np.frombuffer(d, np.uint8).reshape(y, x, 3)) if d is not None else None for y, x, d in zip(h, w, rgb)])


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def _size(head: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(size(c) if c is not None else None) or (None, None) for c in head], columns=["width", "height"]).astype("Int32")


def header_size(content: Column) -> Column:
    """struct width, height of a PNG or JPEG file by its first bytes, of the whole file only where they do not tell; no pixel is decoded."""
    head = _size(F.substring(content, 1, HEADER_BYTES))
    return F.when(head["width"].isNotNull(), head).otherwise(_size(F.when(F.length(content) > HEADER_BYTES, content)))
