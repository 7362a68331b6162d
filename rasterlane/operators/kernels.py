"""Small array kernels that run inside tasks, on one block with its halo or on one object at a time."""

from __future__ import annotations

import numpy as np

#: Weights of luma, the sRGB to XYZ matrix, the white point.
LUMA = np.array([0.299, 0.587, 0.114], np.float32)
RGB_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
WHITE = np.array([0.950456, 1.0, 1.088754])


def gray(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb.astype(np.float32) @ LUMA)


def lab(rgb: np.ndarray) -> np.ndarray:
    """8-bit CIE Lab: L over 255, a and b moved by 128."""
    v = rgb.astype(np.float64) / 255
    v = np.where(v > 0.04045, ((v + 0.055) / 1.055) ** 2.4, v / 12.92) @ RGB_XYZ.T / WHITE
    f = np.where(v > 0.008856, np.cbrt(v), 7.787 * v + 16 / 116)
    light = np.where(v[..., 1] > 0.008856, 116 * np.cbrt(v[..., 1]) - 16, 903.3 * v[..., 1])
    return np.rint(np.stack([light * 2.55, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], -1)).astype(np.float32)


def gaussian(x: np.ndarray, size: int, sigma: float) -> np.ndarray:
    """Separable blur without the border: the result is smaller by size // 2 on each side. sigma 0: by the size."""
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    t = np.arange(size) - size // 2
    k = np.exp(-(t**2) / (2 * sigma**2))
    k /= k.sum()
    view = np.lib.stride_tricks.sliding_window_view
    return view(view(x, size, axis=0) @ k, size, axis=1) @ k


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pixel difference of two RGB arrays with a border of 2: 0.6 of blurred luma and 0.4 of Lab distance, 0 to 1."""
    light = np.abs(np.rint(gaussian(gray(a), 5, 1.0)) - np.rint(gaussian(gray(b), 5, 1.0))) / 255
    colour = np.linalg.norm(lab(a) - lab(b), axis=-1)[2:-2, 2:-2] / 255
    return np.clip(0.6 * light + 0.4 * colour, 0, 1)


def edge_strength(x: np.ndarray) -> np.ndarray:
    """Gradient strength that is largest along its direction, else 0; a border of 2 is used up."""
    view = np.lib.stride_tricks.sliding_window_view(x, (3, 3))
    gx = view @ np.array([-1, 0, 1]) @ np.array([1, 2, 1])
    gy = np.einsum("ijkl,l,k->ij", view, np.array([1, 2, 1]), np.array([-1, 0, 1]))
    mag = np.abs(gx) + np.abs(gy)
    m, dx, dy = mag[1:-1, 1:-1], gx[1:-1, 1:-1], gy[1:-1, 1:-1]
    at = lambda i, j: mag[1 + i : mag.shape[0] - 1 + i, 1 + j : mag.shape[1] - 1 + j]
    flat, steep = np.abs(dy) < 0.4142 * np.abs(dx), np.abs(dy) > 2.4142 * np.abs(dx)
    down = (dx * dy) > 0
    first = np.select([flat, steep, down], [at(0, -1), at(-1, 0), at(-1, -1)], at(-1, 1))
    second = np.select([flat, steep, down], [at(0, 1), at(1, 0), at(1, 1)], at(1, -1))
    return np.where((m > first) & (m >= second), m, 0)


def morph(on: np.ndarray, kernel: list[tuple[int, int]], grow: bool) -> np.ndarray:
    """Dilation or erosion by a symmetric kernel; what lies outside the array does not count. Rows of the kernel are runs.
    on: a mask, or a stack of masks of a size."""
    x = on if grow else ~on
    h, w = x.shape[-2:]
    out = np.zeros_like(x)
    wide: dict[int, int] = {}
    for dy, dx in kernel:
        wide[dy] = max(wide.get(dy, 0), dx)
    for dy, r in wide.items():
        run = np.zeros((*x.shape[:-1], w + 1), np.int32)
        run[..., 1:] = np.cumsum(x, -1)
        hi, lo = np.minimum(np.arange(w) + r + 1, w), np.maximum(np.arange(w) - r, 0)
        line = run[..., hi] - run[..., lo] > 0
        a, b = max(0, dy), min(h, h + dy)
        out[..., a:b, :] |= line[..., a - dy : b - dy, :]
    return out if grow else ~out


def outline(on: np.ndarray) -> list[tuple[int, int]]:
    """The outer border of the object that holds the first set cell, as (x, y), traced once around; straight runs keep only their ends."""
    rows, cols = np.nonzero(on)
    if not len(rows):
        return []
    ring = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    pad = np.pad(on, 1)
    start = (int(rows[0]) + 1, int(cols[0]) + 1)
    at, came, path = start, 4, [start]
    second = None
    while True:
        for k in range(1, 9):
            d = (came + k) % 8
            to = (at[0] + ring[d][0], at[1] + ring[d][1])
            if pad[to]:
                break
        else:
            break
        if at == start and to == second:
            break
        second = second or to
        path.append(to)
        at, came = to, (d + 4) % 8
    if len(path) > 1 and path[-1] == start:
        path.pop()
    n = len(path)
    step = lambda p, q: (q[0] - p[0], q[1] - p[1])
    corners = [p for i, p in enumerate(path) if n < 3 or step(path[i - 1], p) != step(p, path[(i + 1) % n])]
    return [(x - 1, y - 1) for y, x in corners]


def perimeter(ring: list[tuple]) -> float:
    p = np.array(ring, float)
    return float(np.hypot(*(np.roll(p, -1, 0) - p).T).sum()) if len(p) else 0.0


def area(ring: list[tuple]) -> float:
    p = np.array(ring, float)
    q = np.roll(p, -1, 0)
    return abs(float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum())) / 2 if len(p) else 0.0


def simplified(ring: list[tuple], slack: float) -> list[tuple]:
    """A ring with the points left out that are within the slack of the line between those kept."""
    if len(ring) < 4:
        return list(ring)
    p = np.array(ring, float)
    a = 0
    for _ in range(3):  # two far ends
        a, b = int(np.hypot(*(p - p[a]).T).argmax()), a
    keep, todo = {a, b}, [(a, b), (b, a)]
    while todo:
        s, e = todo.pop()
        inner = [i % len(p) for i in range(s + 1, e if e > s else e + len(p))]
        if not inner:
            continue
        d = p[e] - p[s]
        n = np.hypot(*d)
        v = p[inner] - p[s]
        off = np.abs(v[:, 0] * d[1] - v[:, 1] * d[0]) / n if n else np.hypot(*v.T)
        if off.max() > slack:
            m = inner[int(off.argmax())]
            keep.add(m)
            todo += [(s, m), (m, e)]
    return [ring[i] for i in sorted(keep)]


def hull(points: list[tuple]) -> list[tuple]:
    """Corners of the convex hull of whole-number points (x, y), in the order of a rising angle of its sides, from the least point."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    out: list = []
    for run in (pts, pts[::-1]):
        base = len(out)
        for q in run:
            while len(out) > base + 1 and turn(out[-2], out[-1], q) <= 0:
                out.pop()
            out.append(q)
        out.pop()
    return out


def calipers(corners: list[tuple]) -> np.ndarray:
    """Of each side of a hull: how far the corners reach along it (least, most) and away from it, in whole numbers times its length.

    The corner that is farthest in a direction lies where the sides' angles pass it, so each is found by bisection; its neighbours
    are compared too, so that rounded angles do no harm."""
    h = np.array(corners, np.int64)
    e = np.roll(h, -1, 0) - h
    angle = np.unwrap(np.arctan2(e[:, 1], e[:, 0]))
    across = np.stack([-e[:, 1], e[:, 0]], 1)
    out = []
    for d, turn in ((-e, 1.5), (e, 0.5), (across, 1.0)):  # sides turn by so much, in half turns, until they pass the farthest corner
        at = np.searchsorted(angle, angle[0] + np.mod(angle + turn * np.pi - angle[0], 2 * np.pi))
        near = h[(at[:, None] + np.arange(-1, 2)) % len(h)]
        out.append((near * d[:, None, :]).sum(2).max(1))
    return np.stack([-out[0], out[1], out[2] - (h * across).sum(1)], 1)


def least_rectangle(corners: list[tuple]) -> tuple[float, list[tuple[int, int]]]:
    """Area and corners, cut to whole numbers, of the least rectangle around a hull: one side lies on a side of the hull."""
    if len(corners) < 3:
        return 0.0, [tuple(corners[0]), tuple(corners[0]), tuple(corners[-1]), tuple(corners[-1])]
    h = np.array(corners, np.int64)
    e = np.roll(h, -1, 0) - h
    lo, hi, away = calipers(corners).T
    size = (hi - lo).astype(float) * away / (e**2).sum(1)
    best = 0
    for i in range(1, len(size)):
        if size[i] < size[best] - 1e-9:
            best = i
    n = np.hypot(*e[best])
    u = e[best] / n
    axes = np.array([u, [-u[1], u[0]]])
    base = float(h[best] @ axes[1])
    box = np.array([[lo[best] / n, base], [hi[best] / n, base], [hi[best] / n, base + away[best] / n], [lo[best] / n, base + away[best] / n]]) @ axes
    return float(size[best]), [(int(x), int(y)) for x, y in np.round(box, 9)]


def smallest_rectangle(ring: list[tuple]) -> list[tuple[int, int]]:
    """Corners of the least rectangle around the points of a ring."""
    return least_rectangle(hull(ring))[1]


def filled(ring: list[tuple], h: int, w: int) -> np.ndarray:
    """Cells whose centre is inside the ring or on its border."""
    p = np.array(ring, float)
    y, x = np.mgrid[0:h, 0:w]
    inside, border = np.zeros((h, w), bool), np.zeros((h, w), bool)
    for (x0, y0), (x1, y1) in zip(p, np.roll(p, -1, 0)):
        if y0 != y1:
            inside ^= ((y0 <= y) != (y1 <= y)) & (x < x0 + (y - y0) * (x1 - x0) / (y1 - y0))
        n = int(max(abs(x1 - x0), abs(y1 - y0), 1))
        t = np.linspace(0, 1, n + 1)
        bx, by = np.rint(x0 + (x1 - x0) * t).astype(int), np.rint(y0 + (y1 - y0) * t).astype(int)
        ok = (bx >= 0) & (by >= 0) & (bx < w) & (by < h)
        border[by[ok], bx[ok]] = True
    return inside | border


def resized(x: np.ndarray, h: int, w: int, how: str) -> np.ndarray:
    """An image (rows, columns, ...) in another size: area, nearest, linear or cubic."""
    def weights(n: int, m: int) -> np.ndarray:
        s, out = n / m, np.zeros((m, n))
        for i in range(m):
            if how == "area":
                lo, hi = i * s, (i + 1) * s
                for j in range(int(lo), min(n, int(np.ceil(hi)))):
                    out[i, j] = max(0.0, min(hi, j + 1) - max(lo, j)) / s
            elif how == "nearest":
                out[i, min(n - 1, int(i * s))] = 1
            else:
                at = (i + 0.5) * s - 0.5
                j, f = int(np.floor(at)), at - np.floor(at)
                a = -0.75
                taps = {0: 1 - f, 1: f} if how == "linear" else {-1: ((a * (f + 1) - 5 * a) * (f + 1) + 8 * a) * (f + 1) - 4 * a, 0: ((a + 2) * f - (a + 3)) * f * f + 1, 1: ((a + 2) * (1 - f) - (a + 3)) * (1 - f) ** 2 + 1, 2: ((a * (2 - f) - 5 * a) * (2 - f) + 8 * a) * (2 - f) - 4 * a}
                for k, v in taps.items():
                    out[i, min(n - 1, max(0, j + k))] += v
        return out

    y = np.tensordot(weights(x.shape[0], h), x.astype(np.float64), (1, 0))
    y = np.moveaxis(np.tensordot(weights(x.shape[1], w), y, (1, 1)), 0, 1)
    return np.clip(np.rint(y), 0, 255).astype(np.uint8) if x.dtype == np.uint8 else y.astype(x.dtype)


def jet(v: np.ndarray) -> np.ndarray:
    """Blue, cyan, yellow, red of values 0 to 1."""
    ramp = lambda c: np.clip(1.5 - np.abs(4 * v - c), 0, 1)
    return np.rint(255 * np.stack([ramp(3), ramp(2), ramp(1)], -1)).astype(np.uint8)


#: Means and deviations of the bands that segmentation models expect.
BAND_MEAN, BAND_STD = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])


def normalised(rgb: np.ndarray) -> np.ndarray:
    """Bands of 0 to 255 as a model's input."""
    return ((rgb / 255 - BAND_MEAN) / BAND_STD).astype(np.float32)
