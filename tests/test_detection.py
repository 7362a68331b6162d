import numpy as np

from rasterlane.operators import blocks, classic
from rasterlane.plans import detection

H, W = 120, 160
OLD, NEW = [(8, 8, 32, 32), (60, 12, 84, 40)], [(8, 8, 32, 32), (60, 100, 88, 140)]


def picture(boxes):
    x = np.zeros((H, W, 3), np.uint8)
    for y0, x0, y1, x1 in boxes:
        x[y0:y1, x0:x1] = 255
    return bytearray(x.tobytes())


def frames(spark, *pictures):
    return spark.createDataFrame([(1, e, H, W, 3, p) for e, p in pictures], "scene long, epoch int, h int, w int, bands int, data binary")


def test_matched_objects_with_periods(spark):
    got = detection.detect(frames(spark, (0, picture(OLD)), (1, picture(NEW))), gsd=0.5, tolerance_px=2.0, captures=frames(spark, (1, picture(OLD)), (2, picture(NEW))), dates=["2014-01-01", "2016-01-01", "2018-01-01", "2020-01-01"], tile=128, overlap=16, block=128).orderBy("id").collect()
    assert [r.type for r in got] == ["new", "demolished", "existing"]
    assert [(r["from"], r["to"]) for r in got] == [("2016-01-01", "2018-01-01")] * 2 + [(None, None)]
    assert got[0].area_m2 == round(got[0].area_px * 0.25, 1) and len(got[0].ring) >= 4


def test_pixel_difference(spark):
    b = blocks.split(frames(spark, (0, picture(OLD)), (1, picture(NEW))), 128)
    got = sorted(classic.detect(b, size=128).collect(), key=lambda r: r.type)
    assert [r.type for r in got] == ["demolished", "existing", "new"] and got[1].confidence_pct == 95.0


def city(spark, scene, shift):
    """36 squares of 15 x 15 cells on both dates, the later ones moved."""
    rows = [(scene, e, 8 + 24 * i + y, 8 + 24 * j + x + e * shift, 1.0, 160, 160) for e in (0, 1) for i in range(6) for j in range(6) for y in range(15) for x in range(15)]
    return spark.createDataFrame(rows, "scene long, epoch int, r int, c int, p float, h int, w int")


def test_each_scene_has_its_own_tolerance(spark):
    both = city(spark, 1, 1).unionByName(city(spark, 2, 0))
    got = {r.scene: r.tolerance_px for r in detection.tolerance(both, 6.0).collect()}
    assert got == {1: 2.5, 2: 2.0}
    alone = {r.scene: r.tolerance_px for s in (1, 2) for r in detection.tolerance(both.where(f"scene = {s}"), 6.0).collect()}
    assert got == alone


def test_wide_dilation_keeps_labels(spark):
    from rasterlane.operators import pixels

    cells = spark.createDataFrame([(1, 0, 3, 3, 40, 40, "a"), (1, 0, 39, 39, 40, 40, "b"), (1, 0, 16, 15, 40, 40, "a")], "scene long, epoch int, r int, c int, h int, w int, label string")
    kernel = pixels.ellipse(11)
    want = pixels._moved(cells, kernel, 1).select("scene", "epoch", "label", "r", "c", "h", "w").distinct()
    got = pixels.dilate_blocks(cells, kernel, ["label"], block=8)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
