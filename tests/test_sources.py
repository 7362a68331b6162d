"""Sources, project store, exports and functions over small inputs."""

import base64
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlane.functions import geo, projection, rules
from rasterlane.sources import captures, catalogs, export, georef, images, projects, tiff, tiles


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


def test_tile_of_the_example(spark):
    r = one(spark, t=geo.tile_of(F.lit(41.107), F.lit(28.79), F.lit(17)), g=geo.ground_resolution(F.lit(41.107), F.lit(17)))
    assert (r.t.x, r.t.y) == (76018, 49090) and abs(r.g - 0.8999063589233921) < 1e-12


def test_utm_and_mercator(spark):
    r = one(spark, u=projection.to_lonlat(F.lit(500000.0), F.lit(4649776.22482), F.lit(32635)), m=projection.to_lonlat(F.lit(20037508.342789244), F.lit(0.0), F.lit(3857)), x=projection.to_lonlat(F.lit(0.0), F.lit(0.0), F.lit(5254)))
    assert abs(r.u.lon - 27) < 1e-9 and abs(r.u.lat - 42) < 1e-6 and abs(r.m.lon - 180) < 1e-9 and r.x is None


def test_gsd_of_a_utm_image(spark):
    t = geo.affine(*[F.lit(v) for v in (0.5, 0.0, 650000.0, 0.0, -0.5, 4550000.0)])
    assert abs(one(spark, g=projection.image_gsd(t, F.lit(200), F.lit(100), F.lit(32635))).g - 0.5) < 0.005


def test_rules(spark):
    r = one(spark, a=rules.analysis_scale(F.lit(4000), F.lit(2000), F.lit(0.5), F.lit("fast")), b=rules.analysis_scale(F.lit(512), F.lit(512), F.lit(0.9), F.lit("fast")), c=rules.tile_starts(F.lit(2500)), d=rules.iso_date(F.lit(1296950400000)), e=rules.metrics(F.lit(0), F.lit(0), F.lit(0)), f=rules.square_metres(F.lit(5), F.lit(0.0)))
    assert (r.a, r.b, r.c, r.d) == (0.5, 1.8, [0, 960, 1476], "2011-02-06") and r.e.f1 == 1 and r.f is None


def tiff(keys, scale=None, tie=None, matrix=None):
    """A little-endian TIFF of tags alone."""
    data, at, entries = b"", 8 + 2 + 12 * 6 + 4, []
    for tag, kind, values in ((256, "I", [20]), (257, "I", [10]), (33550, "d", scale), (33922, "d", tie), (34264, "d", matrix), (34735, "H", keys)):
        if values is None:
            continue
        blob = struct.pack(f"<{len(values)}{kind}", *values)
        code = {"H": 3, "I": 4, "d": 12}[kind]
        if len(blob) > 4:
            entries.append(struct.pack("<HHII", tag, code, len(values), at + len(data)))
            data += blob
        else:
            entries.append(struct.pack("<HHI", tag, code, len(values)) + blob.ljust(4, b"\0"))
    head = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0"
    return head.ljust(at, b"\0") + data


def test_georeferences(spark):
    scale, tie = [0.5, 0.5, 0.0], [0, 0, 0, 650000.0, 4550000.0, 0]
    rows = [("/a/t.tif", bytearray(tiff([1, 1, 0, 2, 1025, 0, 1, 2, 3072, 0, 1, 32635], scale, tie)), None, 20, 10), ("/a/u.tif", bytearray(tiff([1, 1, 0, 1, 3072, 0, 1, 32767], scale, tie)), None, 20, 10),
            ("/a/w.png", bytearray(b""), None, 20, 10), ("/a/bad.png", bytearray(b""), None, 20, 10), ("/a/none.png", bytearray(b""), None, 20, 10)]
    i = spark.createDataFrame(rows, "path string, content binary, epsg int, width int, height int")
    files = spark.createDataFrame([("/a/w.wld", bytearray(b"9\n0\n0\n-9\n1\n1")), ("/a/w.pgw", bytearray(b"0.001\n0\n0\n-0.001\n28.5\n41.5\n")), ("/a/bad.pgw", bytearray(b"a b c"))], "path string, content binary")
    got = {r.path: r for r in georef.georeferences(i, files).collect()}
    assert got["/a/t.tif"].source == "geotiff" and got["/a/t.tif"].epsg == 32635 and abs(got["/a/t.tif"].gsd_m - 0.5) < 0.01
    assert got["/a/u.tif"].error == "crs_unknown" and got["/a/bad.png"].error == "world_file" and got["/a/none.png"].source is None
    assert got["/a/w.png"].epsg == 4326 and abs(got["/a/w.png"].bounds.w - 28.4995) < 1e-9


def test_pair_reference(spark):
    box = lambda w: geo.bounds_transform(F.struct(F.lit(40.0).alias("s"), F.lit(w).alias("w"), F.lit(41.0).alias("n"), F.lit(w + 1).alias("e")), F.lit(10), F.lit(10))
    p = spark.range(3).select("id", F.when(F.col("id") < 2, box(28.0)).alias("transform1"), F.lit(4326).alias("epsg1"), F.lit(10).alias("w1"), F.lit(10).alias("h1"), F.when(F.col("id") != 1, box(28.5)).alias("transform2"), F.lit(4326).alias("epsg2"), F.lit(20).alias("w2"), F.lit(20).alias("h2"))
    got = georef.pair_reference(p).orderBy("id").collect()
    assert [r.error for r in got] == ["different_area", None, None] and got[1].transform.a == pytest.approx(0.05) and got[2].transform.a == pytest.approx(0.1)


def test_tile_cache(spark, tmp_path):
    pts = spark.createDataFrame([(1, 40.99, 29.05, 2, "2014", "1900")], "id int, lat double, lon double, grid_size int, year_t1 string, year_t2 string")
    want = tiles.pair(pts)
    assert want.count() == 8 and {r.release_id for r in want.collect()} == {"5844", "26334"}
    k = want.orderBy("epoch", "row", "col").first()
    (tmp_path / f"{k.release_id}_{k.zoom}_{k.ty}_{k.tx}.jpg").write_bytes(b"tile")
    got, fetched = tiles.scan(want, tiles.cached(spark, str(tmp_path)), lambda r, z, y, x: b"new" if r == "26334" and y == k.ty else None)
    assert {r.content and bytes(r.content) for r in got.collect()} == {b"tile", b"new", None} and fetched.count() == 2
    s = tiles.missing_summary(got, ["id"]).first()
    assert (s.missing, s.total, s.no_imagery, s.note) == (3, 4, False, "3/4")


def test_captures(spark):
    attr = lambda **a: json.dumps({"features": [{"attributes": a}]})
    rows = [("2014", attr(SRC_DATE2=1296950400000, NICE_DESC="", SRC_DESC="x", SAMP_RES=0.504)), ("2016", attr(SRC_DATE=1420070400000)), ("2018", attr(SRC_DATE2="2015-01-01")), ("2020", '{"features": []}'), ("2022", attr(SRC_DATE2="2017-01-01", SAMP_RES=1.5)), ("2026", attr(SRC_DATE2="2025-01-01"))]
    c = spark.createDataFrame(rows, "year string, answer string").select(F.lit(1).alias("id"), "year", captures.capture(F.col("answer")).alias("capture"))
    first = c.where("year = '2014'").first().capture
    assert (first.date, first.source, first.resolution_m) == ("2011-02-06", "x", 0.5)
    assert [(r.date, r.year) for r in captures.chosen(c, ["id"], F.lit("2014"), F.lit("2026")).collect()] == [("2015-01-01", "2016")]


def test_layers(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<Layer><ows:Title>T</ows:Title><ows:Identifier>WB_2014_R01</ows:Identifier><ResourceURL template="https://x/tile/5844/{z}"/></Layer><Layer><ows:Identifier>B</ows:Identifier><ResourceURL template="https://x/tile/7/{z}"/></Layer><Layer><ows:Title>no</ows:Title></Layer>')
    got = catalogs.layers(spark, str(tmp_path / "c.xml"))
    assert [tuple(r) for r in got.orderBy("ident").collect()] == [("B", "B", "7"), ("WB_2014_R01", "T", "5844")]
    assert catalogs.templates(spark, str(tmp_path / "c.xml")).first()["count"] == 2
    assert [r.year for r in catalogs.first_of_year(got, F.col("release_id").cast("int"), ("2014", "2016")).collect()] == ["2014"]


def test_project_store(spark, tmp_path):
    s = projects.ProjectStore(spark, f"file://{tmp_path}/p")
    s.save(spark.createDataFrame([("a", "Bahçe", "eski"), (None, "Çarşı", None)], "id string, name string, description string"))
    old = s.get("a").first()
    s.save(spark.createDataFrame([("a", "Bahçe 2")], "id string, name string"))
    new = s.get("a").first()
    assert s.all().count() == 2 and new.name == "Bahçe 2" and new.created_at == old.created_at and new.zoom == 17
    assert [r.name for r in s.list("çarş").collect()] == ["Çarşı"] and "results_data" not in s.list().columns
    assert [r.name for r in projects.sorted_by(s.all(), "name").collect()] == ["Bahçe 2", "Çarşı"]
    assert s.delete("a") and not s.delete("a")
    s.clear()
    assert s.all().count() == 0


def test_project_store_commits(spark, tmp_path, monkeypatch):
    """A write that breaks off, a commit file without its end, and a writer who comes in between."""
    path = f"file://{tmp_path}/p"
    s = projects.ProjectStore(spark, path)
    one = lambda i, name: spark.createDataFrame([(i, name, "{bad", '{"k": 1}')], "id string, name string, stats string, coords string")
    s.save(one("a", "A"))
    (tmp_path / "p" / "data-broken").mkdir()
    (tmp_path / "p" / "_commits" / "000000000002").write_text("data-bro")  # never finished
    assert [r.name for r in s.all().collect()] == ["A"]
    (tmp_path / "p" / "_commits" / "000000000002").unlink()
    r = s.get("a").first()
    assert r.stats is None and r.coords == '{"k": 1}' and s.all().first().stats == "{bad"

    other, real, calls = projects.ProjectStore(spark, path), s._committed, []

    def late(version, name):
        if not calls:
            calls.append(version)
            other.save(one("b", "B"))  # commits the same version first
        return real(version, name)

    monkeypatch.setattr(s, "_committed", late)
    s.save(one("c", "C"))
    assert calls == [2] and sorted(r.id for r in s.all().collect()) == ["a", "b", "c"] and max(s._commits()) == 3
    monkeypatch.setattr(s, "_committed", lambda *a: False)
    with pytest.raises(projects.Conflict):
        s.clear()
    assert s.all().count() == 3
    monkeypatch.undo()
    s.clean(keep=1)
    assert [*s._commits()] == [3] and len([*(tmp_path / "p").glob("data-*")]) == 1 and s.all().count() == 3


def test_project_store_reads_older_folders(spark, tmp_path):
    s = projects.ProjectStore(spark, f"file://{tmp_path}/p")
    projects.prepared(spark.createDataFrame([("a", "A")], "id string, name string")).write.parquet(f"file://{tmp_path}/p/v4")
    (tmp_path / "p" / "v5").mkdir()  # broke off
    s.save(spark.createDataFrame([("b", "B")], "id string, name string"))
    assert sorted(r.id for r in s.all().collect()) == ["a", "b"] and max(s._commits()) == 5


def test_exports(spark, tmp_path):
    r = spark.createDataFrame([(1, "new", None, 2.5)], "id int, type string, area_m2 double, confidence_pct double")
    doc = json.loads(export.geojson(r).first().geojson)
    assert doc["features"][0]["properties"]["area_m2"] is None and doc["type"] == "FeatureCollection"
    export.write_csv(r, str(tmp_path / "csv"))
    lines = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*"))).split(b"\r\n")
    assert lines[0].startswith(b"Bina_ID,Degisim_Turu") and lines[1].startswith(b"1,new,,,,2.5")


def test_images(spark, tmp_path):
    rgba = np.zeros((4, 5, 4), np.uint8)
    rgba[..., 0], rgba[..., 3] = 200, 255
    (tmp_path / "a.png").write_bytes(images.png(5, rgba.tobytes()))
    i = images.read(spark, str(tmp_path)).first()
    assert (i.h, i.w) == (4, 5) and bytes(i.data)[:3] == b"\xc8\0\0"
    d = images.read(spark, str(tmp_path)).withColumns({"scene": F.lit(1), "epoch": F.lit(0)})
    assert len(images.resized(d, F.lit(8), F.lit(10), "cubic").first().data) == 240
    assert images.sizes(spark, str(tmp_path)).first().width == 5


def test_stretch(spark):
    c = spark.range(101).select(F.lit(1).alias("scene"), F.lit(0).alias("epoch"), F.lit(0).alias("r"), F.col("id").cast("int").alias("c"), F.lit(0).alias("band"), (F.col("id") * 10.0).alias("v"))
    v = [r.v for r in images.stretched(c).orderBy("c").collect()]
    assert v[0] == 0 and v[100] == 255 and v[50] == 127


def tiff_bytes(x, order="<", planes=False, pack=bytes, code=1, rows=2, tile=0, predictor=1, meaning=1, palette=()):
    """A TIFF of x (h, w, bands) in strips of some rows, or in square tiles."""
    h, w, n = x.shape
    parts = []
    for p in [x[:, :, b : b + 1] for b in range(n)] if planes else [x]:
        for y in range(0, h, tile or rows):
            for c in range(0, w, tile or w):
                q = p[y : y + (tile or rows), c : c + (tile or w)]
                if tile:
                    q = np.pad(q, ((0, tile - q.shape[0]), (0, tile - q.shape[1]), (0, 0)))
                if predictor == 2:
                    q = np.diff(q, axis=1, prepend=np.zeros_like(q[:, :1]))
                parts.append(pack(q.astype(x.dtype.newbyteorder(order)).tobytes()))
    body = b"".join(parts)
    at = 8 + np.cumsum([0] + [len(p) for p in parts])[:-1]
    many = [(258, 3, [x.dtype.itemsize * 8] * n), (324 if tile else 273, 4, at.tolist()), (325 if tile else 279, 4, [len(p) for p in parts])]
    many += [(320, 3, palette)] if palette else []
    single = {256: w, 257: h, 259: code, 262: meaning, 277: n, 284: 1 + planes, 317: predictor, 339: {"u": 1, "i": 2, "f": 3}[x.dtype.kind]} | ({322: tile, 323: tile} if tile else {278: rows})
    entries = sorted([*many, *[(t, 3, [v]) for t, v in single.items()]])
    start = 8 + len(body)
    extra, out = start + 2 + 12 * len(entries) + 4, b""
    table = struct.pack(order + "H", len(entries))
    for t, kind, v in entries:
        raw = struct.pack(f"{order}{len(v)}{'H' if kind == 3 else 'I'}", *v)
        if len(raw) > 4:
            out, raw = out + raw, struct.pack(order + "I", extra + len(out))
        table += struct.pack(order + "HHI", t, kind, len(v)) + raw.ljust(4, b"\0")
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", start) + body + table + b"\0" * 4 + out


def lzw(data):
    """Greedy codes as the format wants them, without a full table."""
    table, bits, width, word = {bytes([i]): i for i in range(256)}, "", 9, b""
    bits += format(256, "09b")
    n = 258
    for i in range(len(data)):
        nxt = word + data[i : i + 1]
        if nxt in table:
            word = nxt
            continue
        bits += format(table[word], f"0{width}b")
        table[nxt], n = n, n + 1
        width = max(width, n.bit_length())
        word = data[i : i + 1]
    bits += format(table[word], f"0{width}b")
    n += 1
    bits += format(257, f"0{max(width, n.bit_length())}b")
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def plain_rgb(x):
    x = np.repeat(x[:, :, :1], 3, 2) if x.shape[2] < 3 else x[:, :, :3]
    x = x.astype(np.float32)
    if x.max() > 255:
        low, high = np.percentile(x, (2, 98))
        x = (x - np.float32(low)) / np.float32(max(high - low, 1e-6)) * np.float32(255)
    return np.clip(x, 0, 255).astype(np.uint8)


def test_tiff_pixels(spark, tmp_path):
    rng = np.random.default_rng(4)
    eight, sixteen = rng.integers(0, 256, (7, 9, 4), np.uint8), rng.integers(0, 4000, (7, 9, 3), np.uint16)
    smooth = (np.arange(40 * 50 * 3).reshape(40, 50, 3) // 7 % 251).astype(np.uint8)
    cases = {
        "four": (eight, {}), "gray": (eight[:, :, :1], {"order": ">"}), "two": (eight[:, :, :2], {}), "planes": (sixteen, {"planes": True}), "big": (sixteen, {"order": ">", "pack": zlib.compress, "code": 8, "predictor": 2}),
        "tiles": (sixteen, {"tile": 16, "pack": zlib.compress, "code": 32946}), "float": ((sixteen / 20).astype(np.float32), {}), "bits": (eight, {"code": 32773, "pack": lambda b: b"".join(bytes([0, v]) for v in b)}),
        "lzw": (smooth, {"code": 5, "pack": lzw, "rows": 40, "predictor": 2}), "lzw2": (smooth, {"code": 5, "pack": lzw, "rows": 20}),
    }
    for name, (x, how) in cases.items():
        (tmp_path / f"{name}.tif").write_bytes(tiff_bytes(x, **how))
    palette = [(i * (k + 1) % 256) * 257 for k in range(3) for i in range(256)]
    for name, x, how in (("inverse", 255 - eight[:, :, :1], {"meaning": 0}), ("palette", eight[:, :, :1], {"meaning": 3, "palette": palette})):
        (tmp_path / f"{name}.tif").write_bytes(tiff_bytes(x, **how))
    cases["inverse"] = (eight[:, :, :1], {})
    cases["palette"] = (np.concatenate([eight[:, :, :1].astype(int) * (k + 1) % 256 for k in range(3)], 2).astype(np.uint8), {})
    (tmp_path / "cut.tif").write_bytes(tiff_bytes(eight)[:60])
    (tmp_path / "none.tiff").write_bytes(b"")
    (tmp_path / "odd.tif").write_bytes(tiff_bytes(eight, code=7))
    got = {r.path.split("/")[-1][:-4]: r for r in images.read(spark, str(tmp_path)).collect()}
    assert set(got) == set(cases)
    for name, (x, _) in cases.items():
        r = got[name]
        assert (r.h, r.w, r.bands) == (*x.shape[:2], 3)
        off = np.frombuffer(r.data, np.uint8).reshape(*x.shape[:2], 3).astype(int) - plain_rgb(x)
        assert np.abs(off).max() <= (1 if x.max() > 255 else 0), name
    assert images.sizes(spark, str(tmp_path)).where("path like '%big.tif'").first().width == 9


def test_previews(spark, tmp_path):
    x = np.random.default_rng(1).integers(0, 256, (6, 8, 3), np.uint8)
    (tmp_path / "a.tif").write_bytes(tiff_bytes(x))
    for most, side in ((4, 4), (100, 8)):
        uri = images.previews(images.read(spark, str(tmp_path)), most).first().preview
        (tmp_path / f"{most}").mkdir()
        (tmp_path / f"{most}" / "b.png").write_bytes(base64.b64decode(uri.split(",")[1]))
        back = images.read(spark, str(tmp_path / f"{most}")).first()
        assert uri.startswith("data:image/png;base64,") and back.w == side
    assert bytes(back.data) == x.tobytes()
