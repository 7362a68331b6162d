"""JPEG files against Java's reader and writer, sizes of headers, tiles put together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlane.sources import images, jpeg, tiles


def picture(h, w, seed=1, noise=2):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    base = np.stack([128 + 100 * np.sin(x / 9 + y / 15), 128 + 90 * np.cos(y / 11), 40 + x * 160 / max(64, w)], 2)
    base[h // 4 : h // 2, w // 3 : w // 2] = (220, 30, 40)
    return np.clip(base + rng.normal(0, noise, base.shape), 0, 255).astype(np.uint8)


def java_pixels(spark, data):
    """Pixels as Java reads them."""
    jvm = spark._jvm
    i = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    if i.getRaster().getNumBands() == 1:  # getRGB would take grey for linear light
        grey = np.array(list(i.getRaster().getSamples(0, 0, i.getWidth(), i.getHeight(), 0, spark._sc._gateway.new_array(jvm.int, i.getWidth() * i.getHeight()))))
        return grey.reshape(i.getHeight(), i.getWidth(), 1).repeat(3, 2).astype(np.uint8)
    packed = i.getRGB(0, 0, i.getWidth(), i.getHeight(), None, 0, i.getWidth())
    v = np.array(list(packed), np.int64) & 0xFFFFFF
    return np.stack([v >> 16, v >> 8 & 255, v & 255], 1).reshape(i.getHeight(), i.getWidth(), 3).astype(np.uint8)


def java_file(spark, rgb, kind=5):
    """A file as Java writes it, with halved colour; kind 10 is grey."""
    jvm = spark._jvm
    h, w = rgb.shape[:2]
    i = jvm.java.awt.image.BufferedImage(w, h, kind)
    v = rgb.astype(np.int64)
    for y in range(h):
        for x in range(w):
            i.setRGB(x, y, int(v[y, x, 0] << 16 | v[y, x, 1] << 8 | v[y, x, 2]))
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(i, "jpg", out)
    return bytes(out.toByteArray())


@pytest.mark.parametrize("h,w", [(1, 1), (8, 8), (17, 33), (64, 40)])
def test_java_reads_what_is_written(spark, h, w):
    rgb = picture(h, w)
    data = jpeg.encoded(rgb)
    mine, java = jpeg.decoded(data).astype(int), java_pixels(spark, data).astype(int)
    assert mine.shape == java.shape == rgb.shape and np.abs(mine - java).max() <= 2
    assert np.abs(java - rgb).mean() < (3 if h > 8 else 6) and jpeg.size(data) == (w, h)
    smooth = picture(h, w, noise=0)
    smooth[:] = smooth[0, 0]
    assert np.abs(java_pixels(spark, jpeg.encoded(smooth)).astype(int) - smooth).max() <= 3


@pytest.mark.parametrize("h,w,kind", [(16, 16, 5), (21, 35, 5), (9, 50, 5), (21, 35, 10)])
def test_files_of_java_are_read(spark, h, w, kind):
    data = java_file(spark, picture(h, w), kind)
    assert np.abs(jpeg.decoded(data).astype(int) - java_pixels(spark, data).astype(int)).max() <= 2
    assert jpeg.size(data[:700]) == (w, h)


def test_extremes():
    rng = np.random.default_rng(2)
    for rgb in (rng.integers(0, 256, (40, 48, 3)).astype(np.uint8), np.zeros((24, 24, 3), np.uint8), np.full((9, 9, 3), 255, np.uint8), np.indices((32, 32)).sum(0)[:, :, None].repeat(3, 2).astype(np.uint8) % 2 * 255):
        for quality in (10, 90, 100):
            assert jpeg.decoded(jpeg.encoded(rgb, quality)).shape == rgb.shape
    assert np.abs(jpeg.decoded(jpeg.encoded(picture(32, 32), 100)).astype(int) - picture(32, 32)).max() <= 6


def test_unreadable_files():
    good = jpeg.encoded(picture(24, 24))
    for bad in (None, b"", b"x", b"\xff\xd8", good[:40], good[:200], good[: len(good) // 2], good.replace(b"\xff\xc0", b"\xff\xc2"), b"\x89PNG\r\n\x1a\n"):
        assert jpeg.pixels_or_none(bad) is None
    rng = np.random.default_rng(1)
    for _ in range(60):  # damaged at random: pixels or nothing, never an error
        b = bytearray(good)
        for i in rng.integers(2, len(b), 4):
            b[i] = rng.integers(0, 256)
        jpeg.pixels_or_none(bytes(b))


def test_columns(spark):
    rgb = picture(20, 30)
    t = spark.createDataFrame([(1, 20, 30, bytearray(rgb.tobytes())), (2, 1, 1, None)], "id int, h int, w int, data binary").withColumn("file", jpeg.jpeg_of("h", "w", "data"))
    got = {r.id: r for r in t.select("id", jpeg.jpeg_pixels("file").alias("p"), jpeg.header_size(F.col("file")).alias("s")).collect()}
    assert (got[1].p.h, got[1].p.w, tuple(got[1].s)) == (20, 30, (30, 20)) and got[2].p.data is None and got[2].s.width is None
    assert np.abs(np.frombuffer(got[1].p.data, np.uint8).reshape(20, 30, 3).astype(int) - rgb).mean() < 4
    png = bytearray(images.png(3, b"\0" * 24))
    far = bytearray(b"\xff\xd8" + (b"\xff\xe1\xff\xff" + b"x" * 65533) * 2 + jpeg.encoded(rgb)[2:])  # the size comes after two long segments
    heads = spark.createDataFrame([(1, png), (2, far), (3, bytearray(b"none"))], "id int, c binary").select("id", jpeg.header_size(F.col("c")).alias("s")).collect()
    assert {r.id: tuple(r.s) if r.s else None for r in heads} == {1: (3, 2), 2: (30, 20), 3: (None, None)}


def test_sizes_of_files(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(jpeg.encoded(picture(12, 20)))
    (tmp_path / "b.PNG").write_bytes(images.png(5, b"\0" * 40))
    (tmp_path / "c.txt").write_bytes(b"no image")
    got = images.sizes(spark, str(tmp_path))
    assert "FileScan image" not in got._jdf.queryExecution().toString()  # no pixel is decoded
    assert {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in got.collect()} == {"a.jpg": (20, 12), "b.PNG": (5, 2)}


def test_mosaic(spark):
    a, b = picture(256, 256), picture(100, 300, 2)
    rows = [(7, 0, 0, 0, bytearray(jpeg.encoded(a))), (7, 0, 0, 1, None), (7, 0, 1, 0, bytearray(jpeg.encoded(b))), (7, 0, 1, 1, bytearray(b"damaged"))]
    t = spark.createDataFrame(rows, "scene long, epoch int, row int, col int, content binary").withColumn("grid_size", F.lit(2))
    got = {(r.y0, r.x0): r for r in tiles.mosaic(t).collect()}
    x = {k: np.frombuffer(r.data, np.float32).reshape(256, 256, 3) for k, r in got.items()}
    assert len(got) == 4 and all((r.h, r.w, r.bh, r.bw, r.bands) == (512, 512, 256, 256, 3) for r in got.values())
    assert (x[0, 0] == jpeg.decoded(jpeg.encoded(a))).all() and (x[0, 256] == 200).all() and (x[256, 256] == 200).all()
    assert (x[256, 0][:100] == jpeg.decoded(jpeg.encoded(b))[:, :256]).all() and (x[256, 0][100:] == 0).all()
    assert {(r.y0, r.x0) for r in tiles.mosaic(t).where("is_placeholder").collect()} == {(0, 256), (256, 256)}
    [whole] = tiles.stitched(t).collect()
    assert (whole.h, whole.w, whole.bands) == (512, 512, 3)
    image = np.frombuffer(whole.data, np.uint8).reshape(512, 512, 3)
    assert all((image[y : y + 256, c : c + 256] == v).all() for (y, c), v in x.items())


def test_previews_are_jpeg(spark):
    import base64

    rgb = picture(40, 60)
    i = spark.createDataFrame([(1, 0, 40, 60, 3, bytearray(rgb.tobytes()))], "scene long, epoch int, h int, w int, bands int, data binary")
    [r] = images.previews(i, 30, "jpeg").collect()
    head, data = r.preview.split(",")
    assert head == "data:image/jpeg;base64" and java_pixels(spark, base64.b64decode(data)).shape == (20, 30, 3)
