"""Classification of rectangles on two dates, morphology and labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlane.operators import blocks, kernels, objects, parallax, pixels, polygons
from rasterlane.sources.shared import written

SQUARES = [(20 + 25 * r, 20 + 25 * c) for r in range(5) for c in range(5)]


def cells(spark, n, *scenes, p=0.95):
    """Cells of n x n scenes 0, 1, ...: each two lists of rectangles y0, x0, y1, x1 of a probability, one a date."""
    rows = []
    for k, dates in enumerate(scenes):
        for epoch, boxes in enumerate(dates):
            on = {(r, c) for y0, x0, y1, x1 in boxes for r in range(y0, y1) for c in range(x0, x1)}
            rows += [(k, epoch, r, c, p, n, n) for r, c in on]
    return spark.createDataFrame(rows, "scene long, epoch int, r int, c int, p float, h int, w int")


def kinds(spark, n, *scenes, block=64, **more):
    c = cells(spark, n, *scenes)
    found = written(objects.classify(c, block=block, **more), "found")[0]
    got = {}
    for r in objects.measure(found, c).collect():
        got.setdefault(r.scene, []).append((r.type, r.area_px))
    return found, {k: sorted(v) for k, v in got.items()}


SHIFTED = ([(20, 20, 45, 45)], [(20, 32, 45, 57)])


def test_classes_across_blocks(spark):
    three = ([(5, 5, 35, 35), (50, 50, 80, 80)], [(7, 6, 37, 36), (90, 20, 120, 60)])
    extension = ([(20, 20, 50, 50)], [(20, 20, 50, 100)])
    found, got = kinds(spark, 128, three, extension, ([], []), SHIFTED)
    assert [t for t, _ in got[0]] == ["demolished", "existing", "new"] and 1100 <= dict(got[0])["new"] <= 1200
    assert [t for t, _ in got[1]] == ["existing", "new"] and 2 not in got and "new" in dict(got[3])
    at = {(r.r, r.c): r.type for r in objects.label_mask(found).where("scene = 0 AND (r, c) IN ((100, 40), (60, 60), (20, 20))").collect()}
    assert at == {(100, 40): "new", (60, 60): "demolished", (20, 20): "existing"}


def test_tolerance_takes_up_parallax(spark):
    assert [t for t, _ in kinds(spark, 80, SHIFTED, tolerance=16)[1][0]] == ["existing"]


def test_block_replaces_houses(spark):
    houses = [(20, 20, 32, 32), (20, 45, 32, 57), (45, 20, 57, 32), (45, 45, 57, 57)]
    assert [t for t, _ in kinds(spark, 90, (houses, [(15, 15, 70, 70)]), tolerance=2)[1][0]] == ["rebuilt"]


@pytest.mark.parametrize("shift,least,most", [(4, 4, 8), (0, 0, 3)])
def test_shift_of_a_city(spark, shift, least, most):
    c = cells(spark, 160, ([(y, x, y + 9, x + 9) for y, x in SQUARES], [(y, x + shift, y + 9, x + shift + 9) for y, x in SQUARES]))
    later = objects.label(c.where("epoch = 1").select("scene", "epoch", "r", "c", "h", "w"), 512)
    s = parallax.best_shifts(later, c.where("epoch = 0").select("scene", "r", "c", F.col("p").cast("double").alias("p")), 5)
    got = parallax.measured_shift(s, ["scene"]).first()
    assert got.matches == 25 and least <= got.shift_px <= most
    assert parallax.measured_shift(s.limit(8), ["scene"]).first().shift_px is None


def test_labels_across_seams(spark):
    rng = np.random.default_rng(3)
    on = rng.random((50, 60)) < 0.5
    rows = [(1, 0, int(r), int(c), 50, 60) for r, c in np.argwhere(on)]
    got = objects.label(spark.createDataFrame(rows, "scene long, epoch int, r int, c int, h int, w int"), 16).toPandas()
    want = objects.label_stack(on[None])[0]
    mine = np.zeros((50, 60), np.int64)
    mine[got.r, got.c] = got.label
    pairs = set(zip(want[on].tolist(), mine[on].tolist()))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_relational_and_block_morphology_agree(spark):
    rng = np.random.default_rng(1)
    on = rng.random((20, 24)) < 0.4
    d = spark.createDataFrame([(1, 0, int(r), int(c), 20, 24) for r, c in np.argwhere(on)], "scene long, epoch int, r int, c int, h int, w int")
    for kernel in (pixels.rectangle(3), pixels.ellipse(5)):
        for f, grow in ((pixels.dilate, True), (pixels.erode, False)):
            assert {(r.r, r.c) for r in f(d, kernel).collect()} == {(int(r), int(c)) for r, c in np.argwhere(kernels.morph(on, kernel, grow))}


def test_steps_on_blocks_equal_steps_on_cells(spark):
    """Closing and opening, two dates, over blocks of 7 cells and at the image's border; repeated cells."""
    rng = np.random.default_rng(12)
    rows = [(1, e, int(r), int(c), 23, 31) for e in (0, 1) for r, c in np.argwhere(rng.random((23, 31)) < 0.3 + 0.2 * e)]
    d = spark.createDataFrame(rows + rows[:9], "scene long, epoch int, r int, c int, h int, w int")
    plain = lambda x: sorted((r.epoch, r.r, r.c, r.h, r.w) for r in x.collect())
    for k in (pixels.rectangle(3), pixels.ellipse(5)):
        assert plain(pixels.morphed(d, [(k, True), (k, False), (k, False), (k, True)], block=7)) == plain(pixels.opened(pixels.closed(d, k), k))
        assert plain(pixels.morphed(d, [(k, False), (k, True)], block=256)) == plain(pixels.opened(d.distinct(), k))
    assert pixels.morphed(d.where("r < 0"), [(pixels.rectangle(3), False)]).count() == 0


def test_ellipse_five():
    assert len(pixels.ellipse(5)) == 17 and len(pixels.ellipse(1)) == 1


def test_halo_and_blend(spark):
    x = np.arange(30 * 34 * 3, dtype=np.int64).reshape(30, 34, 3).astype(np.uint8)
    i = spark.createDataFrame([(1, 0, 30, 34, 3, bytearray(x.tobytes()))], "scene long, epoch int, h int, w int, bands int, data binary")
    for r in blocks.with_halo(blocks.split(i, 16), 2, 16).collect():
        got = np.frombuffer(bytes(r.data), np.float32).reshape(r.bh + 4, r.bw + 4, 3)
        assert (got == np.pad(x, ((2, 2), (2, 2), (0, 0)), mode="reflect")[r.y0 : r.y0 + r.bh + 4, r.x0 : r.x0 + r.bw + 4]).all()
    p = blocks.cells(blocks.predicted(blocks.tiles(i, 16, 4), lambda v: v[..., 0] / 255, 16, 4, 16)).toPandas()
    got = np.zeros((30, 34))
    got[p.r, p.c] = p.p
    assert len(p) == 30 * 34 and np.allclose(got, x[..., 0] / 255, atol=1e-5)


def test_outline_fill_and_rectangle(spark):
    on = np.zeros((12, 12), bool)
    on[3:8, 2:10] = True
    ring = kernels.outline(on)
    assert sorted(ring) == [(2, 3), (2, 7), (9, 3), (9, 7)] and kernels.area(ring) == 28 and kernels.perimeter(ring) == 22
    assert (kernels.filled(ring, 12, 12) == on).all()
    assert sorted(kernels.smallest_rectangle(ring)) == sorted(ring)
    assert kernels.outline(np.ones((1, 1), bool)) == [(0, 0)]
    c = spark.createDataFrame([(1, int(r), int(q)) for r, q in np.argwhere(on)], "k int, r int, c int")
    r = polygons.outlines(c, ["k"]).withColumns({"ring": polygons.simplified(F.col("ring"), 0.01), "h": F.lit(12), "w": F.lit(12)})
    assert polygons.filled(r, ["k"]).count() == on.sum()


def test_resize_kernels():
    x = np.arange(16, dtype=np.uint8).reshape(4, 4)
    assert kernels.resized(x, 2, 2, "area").tolist() == [[2, 4], [10, 12]]
    assert kernels.resized(x, 2, 2, "nearest").tolist() == [[0, 2], [8, 10]]
    assert (kernels.resized(np.full((3, 3), 7, np.uint8), 6, 5, "cubic") == 7).all()


def test_best_shifts_equal_every_shift_tried(spark):
    """Objects over several pieces, with holes and missing cells, against sums over whole windows."""
    radius, side = 3, 170
    rnd = np.random.default_rng(4)
    p = np.where(rnd.random((side, side)) < 0.9, rnd.random((side, side)).round(3), np.nan)
    rows, want = [], {}
    for label, (r0, c0, h, w) in enumerate([(60, 58, 80, 75), (5, 5, 4, 9), (3, 100, 1, 1), (0, 0, 5, 5)]):
        own = rnd.random((h, w)) < 0.7
        own[0, 0] = own[-1, -1] = True
        rows += [(1, label, int(r) + r0, int(c) + c0, side, side) for r, c in np.argwhere(own)]
        if r0 < radius:
            continue
        tried = []
        for dr in range(-radius, radius + 1):
            for dc in range(-radius, radius + 1):
                box = np.nan_to_num(p[r0 + dr : r0 + dr + h, c0 + dc : c0 + dc + w])
                sq = (box**2).sum()
                tried.append((-round(float(box[own].sum() / np.sqrt(own.sum() * sq)) if sq else 0.0, 9), dr, dc))
        want[label] = min(tried)
    before = spark.createDataFrame([(1, r, c, None if np.isnan(p[r, c]) else float(p[r, c])) for r in range(side) for c in range(side)], "scene long, r int, c int, p double")
    got = parallax.best_shifts(spark.createDataFrame(rows, "scene long, label long, r int, c int, h int, w int"), before, radius).collect()
    assert {r.label: (r.dr, r.dc) for r in got} == {k: v[1:] for k, v in want.items()}
    assert all(abs(r.quality + want[r.label][0]) < 2e-9 for r in got)


def test_full_tiles_of_small_images(spark):
    """Every tile reaches the model whole and normalised; its mirrored part does not come back."""
    rnd = np.random.default_rng(5)
    shapes, seen = [(20, 30), (70, 41), (32, 32)], []
    images = spark.createDataFrame([(k, 0, h, w, 3, bytearray(rnd.integers(0, 256, (h, w, 3), np.uint8).tobytes())) for k, (h, w) in enumerate(shapes)], "scene long, epoch int, h int, w int, bands int, data binary")

    def model(x):
        if x.shape != (32, 32, 3):
            raise ValueError(x.shape)
        return x[..., 0] * 0.229 + 0.485

    t = blocks.tiles(images, 32, 8)
    assert t.count() == 1 + 3 * 2 + 1 and t.where("bh > 32 OR bw > 32").count() == 0
    for r in blocks.predicted(t, blocks.full_tiles(model, 32), 32, 8, 16).collect():
        whole = np.frombuffer(next(i.data for i in images.collect() if i.scene == r.scene), np.uint8).reshape(*shapes[r.scene], 3)[..., 0] / 255
        part = whole[r.y0 : r.y0 + r.bh, r.x0 : r.x0 + r.bw]
        seen.append(part.size)
        assert np.allclose(np.frombuffer(r.data, np.float32).reshape(r.bh, r.bw), part, atol=1e-5)
    assert sum(seen) == sum(h * w for h, w in shapes)
    x = blocks.full_tiles(lambda v: v[..., 1], 8)(np.full((5, 6, 3), 255.0))
    assert x.shape == (5, 6) and np.allclose(x, (1 - 0.456) / 0.224)


def test_outlines_by_list_ranking_equal_the_traced_ones(spark):
    rng = np.random.default_rng(12)
    snake = np.zeros((40, 40), bool)
    for i in range(0, 40, 4):
        snake[i] = True
        snake[i : i + 5, 39 if i % 8 == 0 else 0] = True
    hole = np.ones((33, 27), bool)
    hole[5:25, 4:22] = False
    masks = [snake, hole, np.ones((1, 1), bool), np.ones((1, 19), bool), np.eye(23, dtype=bool), np.eye(9, dtype=bool)[::-1], np.ones((2, 1), bool)]
    masks += [rng.random((30, 30)) < p for p in (0.3, 0.5, 0.6, 0.8)]
    rows = [(k, "a" if k % 2 else "b", int(r), int(c)) for k, on in enumerate(masks) for r, c in np.argwhere(on)]
    cells = spark.createDataFrame(rows + rows[:50], "k int, kind string, r int, c int")
    for size in (5, 64):
        got = {}
        for p in polygons.outline_points(cells, ["k", "kind"], size).orderBy("k", "n").collect():
            got.setdefault(p.k, []).append((p.n, p.x, p.y))
        for k, on in enumerate(masks):
            assert got[k] == [(i, x, y) for i, (x, y) in enumerate(kernels.outline(on))], (size, k)
    assert polygons.outline_points(cells.where("k < 0"), ["k"]).count() == 0


def test_rows_fill_polygons_as_the_plain_rule(spark):
    rng = np.random.default_rng(2)
    rings = [[(int(x), int(y)) for x, y in rng.integers(-6, 26, (n, 2))] for n in (1, 2, 3, 3, 4, 5, 7, 9, 12, 30)] + [[(0, 0), (9, 0), (9, 9), (0, 9)], [(30, 30), (40, 30), (40, 40)], []]
    d = spark.createDataFrame([(k, 17, 21, [{"x": x, "y": y} for x, y in r]) for k, r in enumerate(rings)] + [(99, 5, 5, None)], "k int, h int, w int, ring array<struct<x:int,y:int>>")
    got = {(p.k, p.r, p.c) for p in polygons.filled(d, ["k"]).collect()}
    assert got == {(k, int(y), int(x)) for k, r in enumerate(rings) if r for y, x in np.argwhere(kernels.filled(r, 17, 21))}


def test_sums_of_all_shifts():
    """Transforms and area tables give the sums that windows give, also for values over 1 and below 0."""
    rnd = np.random.default_rng(8)
    for h, w, n, top in ((5, 7, 3, 1.0), (1, 1, 9, 1.0), (64, 40, 21, 1.0), (6, 6, 5, 900.0)):
        own = (rnd.random((h, w)) < 0.6).astype(float)
        field = (rnd.random((h + n - 1, w + n - 1)) - 0.1).astype(np.float32).astype(float) * top
        view = np.lib.stride_tricks.sliding_window_view(field, (h, w))
        assert np.allclose(parallax._correlated(field, own), (view * own).sum((2, 3)), rtol=0, atol=1e-9 * top)
        assert np.allclose(parallax._windowed(field, h, w), view.sum((2, 3)), rtol=0, atol=1e-9 * top)
    assert not parallax._correlated(np.zeros((9, 9)), np.ones((3, 3))).any()


def test_shift_of_radius_48(spark):
    """One object over several pieces moved by 41 and -37 is found there."""
    side, (dr, dc) = 300, (41, -37)
    rnd = np.random.default_rng(9)
    own = rnd.random((80, 90)) < 0.5
    own[0, 0] = own[-1, -1] = True
    at = np.argwhere(own) + 100
    later = spark.createDataFrame([(1, 7, int(r), int(c), side, side) for r, c in at], "scene long, label long, r int, c int, h int, w int")
    before = spark.createDataFrame([(1, int(r) + dr, int(c) + dc, 0.9) for r, c in at], "scene long, r int, c int, p double")
    got = parallax.best_shifts(later, before, 48).collect()
    assert [(r.label, r.dr, r.dc, r.quality) for r in got] == [(7, dr, dc, 1.0)]


def test_calipers_equal_all_corners():
    rnd = np.random.default_rng(10)
    for _ in range(1500):
        m = int(rnd.integers(1, 40))
        h = kernels.hull([tuple(map(int, p)) for p in rnd.integers(-m, m + 1, (int(rnd.integers(1, 30)), 2))])
        if len(h) >= 3:
            e = np.roll(h, -1, 0) - np.array(h)
            along, across = np.array(h) @ e.T, np.array(h) @ np.stack([-e[:, 1], e[:, 0]])
            assert (kernels.calipers(h) == np.stack([along.min(0), along.max(0), across.max(0) - across.min(0)], 1)).all()
    assert kernels.hull([(3, 4), (3, 4)]) == [(3, 4)] and kernels.hull([(0, 0), (2, 2), (1, 1)]) == [(0, 0), (2, 2)]


def test_hulls_merged_over_blocks(spark):
    """A disc, a tilted bar, a line, one cell and a repeated cell, in blocks of 3 rows and in one."""
    y, x = np.mgrid[0:60, 0:60]
    shapes = [(y - 30) ** 2 + (x - 25) ** 2 <= 20**2, (abs(y - 2 * x + 20) <= 6) & (x < 38), y == x, (y == 5) & (x == 9)]
    rows = [(k, int(r), int(c)) for k, s in enumerate(shapes) for r, c in np.argwhere(s)]
    d = spark.createDataFrame(rows + [(3, 5, 9), (None, 1, 1)], "k int, r int, c int")
    for step in (3, 256):
        got = {r.k: r for r in polygons.least_rectangles(d, ["k"], step).collect()}
        assert set(got) == {0, 1, 2, 3, None}
        for k, s in enumerate(shapes):
            want = kernels.hull([(int(c), int(r)) for r, c in np.argwhere(s)])
            assert [(p.x, p.y) for p in got[k].hull] == want
            assert (got[k].area, [(p.x, p.y) for p in got[k].ring]) == kernels.least_rectangle(want)
        assert got[2].area == got[3].area == 0 and len(got[3].hull) == 1
    assert polygons.least_rectangles(d.where("k > 9"), ["k"]).count() == 0
