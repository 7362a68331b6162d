"""Queries of masks, objects and their classification, over the scenes that neighbouring vectors stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlane.functions import rules
from rasterlane.operators import classic
from rasterlane.operators import objects as ob
from rasterlane.operators import parallax, pixels, polygons, timeline
from rasterlane.operators.percentiles import percentiles
from rasterlane.plans.bindings import CELLS, TALL_CELLS, blocks, table, tall_blocks
from rasterlane.sources import images
from rasterlane.sources.shared import dealt

C = F.col
OBJECT, SUPPORT, MIN_PX = 0.10, 0.05, 2


def _cells(spark, d):
    return pixels.pixels(blocks(spark, d))


def _row(label):
    """Labels as the cell's number in an 8 x 8 scene."""
    return (F.floor(label / ob.ROW) * 8 + label % ob.ROW).cast("long")


def scene_pixels(spark, d):
    p = pixels.mask(_cells(spark, d), 0.15)
    return p.groupBy("scene", "epoch").agg(F.count("*").alias("cells"), F.sum(C("r") * 8 + C("c")).alias("places"))


def scene_support(spark, d):
    p = pixels.support(_cells(spark, d), rules.SUPPORT_PROB)
    return p.select("scene", "epoch", "r", "c")


def dilate_mask(spark, d):
    return pixels.dilate(pixels.mask(_cells(spark, d), 0.2), pixels.rectangle(3)).groupBy("scene", "epoch").agg(F.count("*").alias("cells"), F.sum(C("r") * 8 + C("c")).alias("places"))


def open_mask(spark, d):
    return pixels.opened(pixels.mask(_cells(spark, d), 0.0), pixels.rectangle(3)).select("scene", "epoch", "r", "c")


def components(spark, d):
    lab = ob.label(pixels.mask(_cells(spark, d), 0.15))
    return lab.select("scene", "epoch", "r", "c", _row(C("label")).alias("label"))


def tall_components(spark, d):
    """Components of scenes of sixteen blocks, which run over the blocks' borders."""
    lab = ob.label(pixels.mask(pixels.pixels(tall_blocks(spark, d)), 0.15), 8)
    return lab.select("scene", "epoch", "r", "c", _row(C("label")).alias("label"))


def outline_corners(spark, d):
    """Corners of the outer border of every object of the tall scenes, in order, over the borders of 8 x 8 blocks."""
    lab = ob.label(pixels.mask(pixels.pixels(tall_blocks(spark, d)), 0.15), 8)
    ring = polygons.outline_points(lab.select("scene", "epoch", _row(C("label")).alias("label"), "r", "c"), ["scene", "epoch", "label"], 8)
    return ring.select("scene", "epoch", "label", "n", "x", "y")


def least_rectangles(spark, d):
    """Hull and least rectangle of every object of the tall scenes, merged over blocks of 8 rows."""
    lab = ob.label(pixels.mask(pixels.pixels(tall_blocks(spark, d)), 0.15), 8)
    box = polygons.least_rectangles(lab.select("scene", "epoch", _row(C("label")).alias("label"), "r", "c"), ["scene", "epoch", "label"], 8)
    return box.select("scene", "epoch", "label", F.size("hull").cast("long").alias("corners"), F.abs(rules.polygon_area2(C("hull"))).cast("long").alias("hull_area2"), F.bround("area", 6).alias("area"))


def changed_regions(spark, d):
    """Regions of the tall scenes in which both dates differ, closed and opened by five cells, over the borders of 8 x 8 blocks."""
    v = pixels.pixels(tall_blocks(spark, d))
    at = ["scene", "r", "c", "h", "w"]
    both = v.groupBy(*at).agg(*[F.max(F.when(C("epoch") == e, C("p").cast("double"))).alias(f"p{e}") for e in (0, 1)]).where("p0 IS NOT NULL AND p1 IS NOT NULL")
    diff = both.select("scene", F.lit(0).alias("epoch"), "r", "c", F.abs(C("p1") - C("p0")).alias("p"), "h", "w")
    region = classic.changed_regions(diff, DIFFERENT, 8).select("scene", "r", "c", _row(C("label")).alias("label"))
    stats = region.join(diff.select("scene", "r", "c", "p"), ["scene", "r", "c"]).groupBy("scene", "label")
    return stats.agg(F.count("*").alias("cells"), F.sum((C("r") * 8 + C("c")).cast("long")).alias("places"), F.bround(F.avg("p"), 6).alias("diff"))


def existing_structures(spark, d):
    """Boxes of the later date's objects that lie on few cells of the earlier date and on few of the boxes kept before them."""
    v = pixels.pixels(tall_blocks(spark, d))
    box = ob.object_stats(ob.label(pixels.mask(v.where("epoch = 1"), 0.25), 8)).select("scene", _row(C("label")).alias("label"), *[C(x).cast("int").alias(x) for x in ("x", "y", "width", "height")])
    right, low = C("x") + C("width") - 1, C("y") + C("height") - 1
    ring = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((C("x"), C("y")), (right, C("y")), (right, low), (C("x"), low))])
    found = box.select("scene", "label", ring.alias("ring"), (C("width") * C("height")).cast("double").alias("area_px"), F.lit(128).alias("h"), F.lit(8).alias("w"))
    kept = classic.existing(found, pixels.mask(v.where("epoch = 0"), 0.2), 0.5)
    return kept.select("scene", "label", "area_px", "area_m2", F.bround("perimeter_m", 6).alias("perimeter_m"))


#: From which difference of two cells on a place counts as changed.
DIFFERENT = 0.27


def cell_percentiles(spark, d):
    """Percentiles of all cells of a date of the tall scenes, and the cells that are at least the upper one."""
    v = pixels.pixels(tall_blocks(spark, d)).select("epoch", "p")
    q = percentiles(v, ["epoch"], "p", [0.02, 0.5, 0.98])
    over = v.join(F.broadcast(q.select("epoch", C("q")[2].alias("top"))), "epoch").groupBy("epoch").agg(F.count_if(C("p") >= C("top")).alias("over"))  # two rows
    return q.join(over, "epoch").select("epoch", "n", "over", *[F.bround(C("q")[i], 6).alias(n) for i, n in enumerate(("low", "middle", "high"))])


def band_stretch(spark, d):
    """Cells of two dates as values of 16 bits, a third of the scenes as values of 8, stretched between the percentiles of their date."""
    k = F.when(C("scene") % 3 == 0, 200).otherwise(20000)
    v = pixels.pixels(tall_blocks(spark, d)).select("scene", "epoch", "r", "c", F.lit(0).alias("band"), F.floor(F.abs("p") * k).cast("double").alias("v"))
    return images.stretched(v).groupBy("scene", "epoch").agg(F.sum("v").alias("total"), F.count_if(C("v") == 0).alias("low"), F.count_if(C("v") == 255).alias("high"), F.sum(C("v") * (C("r") * 8 + C("c"))).cast("long").alias("places"))


def polygon_cells(spark, d):
    """Cells of a polygon of five points for each order, some of it outside of its image of 40 x 48 cells: how many, and where they lie."""
    k = C("o_orderkey")
    at = lambda a, n: (k * a % n - 6).cast("int")
    ring = F.array(*[F.struct(at(a, 60).alias("x"), at(b, 52).alias("y")) for a, b in CORNERS])
    orders = dealt(table(spark, d, "orders").select("o_orderkey"), 50_000, "o_orderkey")
    rings = orders.select(k.alias("id"), F.lit(40).alias("h"), F.lit(48).alias("w"), ring.alias("ring"))
    n = C("b") - C("a") + 1
    places = n * C("r") * 48 + F.expr("(a + b) * (b - a + 1) div 2")
    return polygons.filled_runs(rings, ["id"]).groupBy("id").agg(F.sum(n.cast("long")).alias("cells"), F.sum(places.cast("long")).alias("places"))


#: Factors of an order's key, for the x and y of each point.
CORNERS = [(7, 11), (13, 5), (29, 17), (31, 37), (19, 41)]


def wide_dilation(spark, d):
    """A kernel of 13 x 13 over the same scenes, grown in blocks of 16 x 16."""
    grown = pixels.dilate_blocks(pixels.mask(pixels.pixels(tall_blocks(spark, d)), 0.3), pixels.ellipse(13), block=16)
    return grown.groupBy("scene", "epoch").agg(F.count("*").alias("cells"), F.sum((C("r") * 8 + C("c")).cast("long")).alias("places"))


def component_stats(spark, d):
    lab = ob.large_objects(ob.label(pixels.mask(_cells(spark, d), 0.15)), 3)
    return ob.object_stats(lab).select("scene", "epoch", _row(C("label")).alias("label"), "area_px", *[C(x).cast("long").alias(x) for x in ("x", "y", "width", "height")])


def _two(spark, d):
    cells = _cells(spark, d)
    later = ob.large_objects(ob.label(pixels.mask(cells.where("epoch = 1"), OBJECT)), MIN_PX)
    earlier = ob.large_objects(ob.label(pixels.mask(cells.where("epoch = 0"), OBJECT)), MIN_PX)
    s1, s2 = (pixels.support(cells.where(f"epoch = {e}"), SUPPORT) for e in (0, 1))
    return cells, earlier, later, s1, s2


def object_support_fraction(spark, d):
    _, _, later, s1, _ = _two(spark, d)
    return ob.supported_share(later, s1).select("scene", _row(C("label")).alias("label"), "area_px", F.bround("support", 6).alias("support"))


def new_objects(spark, d):
    _, _, later, s1, _ = _two(spark, d)
    return ob.supported_share(later, s1).where(C("support") < rules.NO_SUPPORT).select("scene", _row(C("label")).alias("label"), "area_px")


def demolished_objects(spark, d):
    _, earlier, _, _, s2 = _two(spark, d)
    return ob.supported_share(earlier, s2).where(C("support") < rules.NO_SUPPORT).select("scene", _row(C("label")).alias("label"), "area_px")


def footprint_match(spark, d):
    cells, _, later, _, _ = _two(spark, d)
    raw = pixels.mask(cells.where("epoch = 0"), OBJECT)
    m = ob.footprint_match(later, ob.label(raw), raw)
    return m.select("scene", _row(C("label")).alias("label"), F.bround("overlap", 6).alias("overlap"), "n_before", F.bround("contained", 6).alias("contained"))


def classify_objects(spark, d):
    c = ob.classify(_cells(spark, d), OBJECT, MIN_PX, 0.0, SUPPORT, open_size=1, split=False)
    return c.groupBy("scene", "type", "part").agg(F.count("*").alias("area_px")).select("scene", "type", _row(C("part.label")).alias("label"), "area_px")


def split_objects(spark, d):
    """With parts: openings of one cell, so that the parts are the plain components of what is left."""
    cells = _cells(spark, d)
    c = ob.classify(cells, OBJECT, MIN_PX, 0.0, SUPPORT, open_size=1, sliver=1)
    return ob.measure(c, cells).groupBy("type").agg(F.count("*").alias("objects"), F.sum("area_px").alias("area_px"))


def label_painting(spark, d):
    c = ob.classify(_cells(spark, d), OBJECT, MIN_PX, 0.0, SUPPORT, open_size=1, split=False)
    return ob.label_mask(c).groupBy("scene", "type").agg(F.count("*").alias("cells"))


def scene_iou(spark, d):
    cells = _cells(spark, d)
    m = pixels.mask_iou(pixels.mask(cells.where("epoch = 0"), 0.15), pixels.mask(cells.where("epoch = 1"), 0.15), blocks(spark, d))
    return m.select("scene", "both", "either", F.bround("iou", 6).alias("iou"))


def change_metrics(spark, d):
    cells = _cells(spark, d)
    return pixels.confusion(pixels.mask(cells.where("epoch = 1"), 0.1), pixels.mask(cells.where("epoch = 0"), 0.1), blocks(spark, d))


def parallax_shift(spark, d):
    cells = _cells(spark, d)
    later = ob.large_objects(ob.label(pixels.mask(cells.where("epoch = 1"), 0.15)), MIN_PX)
    before = cells.where("epoch = 0").select("scene", "r", "c", F.greatest(C("p"), F.lit(0.0)).cast("double").alias("p"))
    s = parallax.best_shifts(parallax.sampled(later, 300), before, 1)
    return parallax.measured_shift(s.withColumn("group", C("scene") % 4), ["group"], least=5).select("group", "matches", F.bround("shift_px", 6).alias("shift_px"))


def weighted_blend(spark, d):
    """Both dates of a scene as two tiles that overlap in all cells, feathered by row."""
    t = _cells(spark, d).select("scene", "r", "c", C("p").cast("double").alias("p"), (rules.feather(C("r"), 8, 4) * rules.feather(C("c"), 8, 4) * (C("epoch") + 1)).alias("weight"))
    return pixels.blend(t).select("scene", "r", "c", F.bround("p", 6).alias("p"))


def placeholder_tiles(spark, d):
    """Dates of which over a share of the cells is flat, and the note on missing tiles."""
    flat = _cells(spark, d).groupBy("scene", "epoch").agg(F.avg((F.abs("p") < 0.15).cast("int")).alias("share"))
    t = flat.withColumn("missing", C("share") > rules.PLACEHOLDER_SHARE - 0.1)
    return t.groupBy("scene").agg(F.count_if("missing").alias("missing"), F.every("missing").alias("all_missing")).select("scene", "missing", "all_missing", rules.missing_text(C("missing"), F.lit(2)).alias("note"))


def capture_states(spark, d):
    """What the later date of the next three scenes shows inside the first object of each scene."""
    cells = _cells(spark, d)
    later = ob.large_objects(ob.label(pixels.mask(cells.where("epoch = 1"), 0.15)), MIN_PX)
    o = later.select("scene", C("label").alias("object"), "r", "c")
    seqs = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("seq")
    shots = cells.where("epoch = 1").select((C("scene")).alias("at"), "r", "c", "p", seqs).withColumn("scene", C("at") - C("seq"))
    on = shots.select("scene", "seq", F.when(C("p") >= 0.1, C("r")).alias("r"), F.when(C("p") >= 0.1, C("c")).alias("c"))
    bad = shots.where(C("p") > 0.45).select("scene", "seq", "r", "c")
    before, after = (pixels.mask(cells.where(f"epoch = {e}"), 0.1) for e in (0, 1))
    s = timeline.capture_states(o, before, after, on, bad)
    return s.select("scene", _row(C("object")).alias("label"), C("seq").cast("long").alias("seq"), "state")


def _labels(name: str, where: str) -> str:
    """CTEs name (scene, epoch, r, c, label) of the components of cells."""
    return f"""{name}_m AS (SELECT scene, epoch, r, c FROM {CELLS} WHERE {where}),
    {name}_r AS (SELECT scene, epoch, r, c, r * 8 + c AS label FROM {name}_m UNION SELECT m.scene, m.epoch, m.r, m.c, x.label FROM {name}_r x JOIN {name}_m m ON m.scene = x.scene AND m.epoch = x.epoch AND abs(m.r - x.r) <= 1 AND abs(m.c - x.c) <= 1),
    {name} AS (SELECT scene, epoch, r, c, CAST(min(label) AS BIGINT) AS label FROM {name}_r GROUP BY ALL)"""


def _five(name: str, of: str, grow: bool) -> str:
    """A CTE of the cells of a tall scene (scene, r, c) grown or worn off by 5 x 5; what lies outside counts as set when worn off."""
    n = "(least(r + 2, 127) - greatest(r - 2, 0) + 1) * (least(c + 2, 7) - greatest(c - 2, 0) + 1)"
    return f"""{name} AS MATERIALIZED (SELECT scene, r, c FROM (SELECT scene, r + i AS r, c + j AS c FROM {of}, range(-2, 3) a(i), range(-2, 3) b(j)) WHERE r BETWEEN 0 AND 127 AND c BETWEEN 0 AND 7
        GROUP BY scene, r, c{"" if grow else f" HAVING count(*) = {n}"})"""


def _big(name: str, n: int) -> str:
    return f"(SELECT * FROM {name} JOIN (SELECT scene, epoch, label FROM {name} GROUP BY ALL HAVING count(*) >= {n}) USING (scene, epoch, label))"


_O = f"WITH RECURSIVE {_labels('o', 'p >= 0.10')}, obj AS {_big('o', MIN_PX)}, sup AS (SELECT scene, epoch, r, c FROM {CELLS} WHERE p > 0.05)"
_SHARE = "SELECT o.scene, o.label, count(*) AS area_px, avg(CASE WHEN s.r IS NULL THEN 0 ELSE 1 END) AS support FROM obj o LEFT JOIN sup s ON s.scene = o.scene AND s.epoch = {other} AND s.r = o.r AND s.c = o.c WHERE o.epoch = {own} GROUP BY o.scene, o.label"
_LATER, _EARLIER = _SHARE.format(own=1, other=0), _SHARE.format(own=0, other=1)
_MATCH = """u AS (SELECT o.scene, o.label, w.label AS was FROM obj o JOIN o w ON w.scene = o.scene AND w.epoch = 0 AND w.r = o.r AND w.c = o.c WHERE o.epoch = 1),
    bx AS (SELECT scene, label, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, count(*) AS n FROM obj WHERE epoch = 1 GROUP BY ALL),
    tch AS (SELECT b.scene, b.label, count(*) AS n_touch FROM (SELECT DISTINCT scene, label, was FROM u) t JOIN bx b ON b.scene = t.scene AND b.label = t.label JOIN o w ON w.scene = t.scene AND w.epoch = 0 AND w.label = t.was WHERE w.r BETWEEN r0 AND r1 AND w.c BETWEEN c0 AND c1 GROUP BY ALL),
    k AS (SELECT scene, label, count(*) AS n_both, count(DISTINCT was) AS n_before FROM u GROUP BY ALL),
    fm AS (SELECT bx.scene, bx.label, CASE WHEN n_before IS NULL THEN 0.0 ELSE n_both / greatest(1, n + n_touch - n_both) END AS overlap, coalesce(n_before, 0) AS n_before, CASE WHEN n_before IS NULL THEN 0.0 ELSE n_both / greatest(1, n_touch) END AS contained
           FROM bx LEFT JOIN tch ON tch.scene = bx.scene AND tch.label = bx.label LEFT JOIN k ON k.scene = bx.scene AND k.label = bx.label)"""
_CLASSES = f"""{_O}, {_MATCH}, s2 AS ({_LATER}), s1 AS ({_EARLIER}),
    cl AS (SELECT 1 AS epoch, s2.scene, s2.label, CASE WHEN support < 0.10 THEN 'new' WHEN overlap < 0.45 AND (n_before >= 2 OR contained < 0.7) THEN 'rebuilt' ELSE 'existing' END AS type, area_px FROM s2 JOIN fm ON fm.scene = s2.scene AND fm.label = s2.label
           UNION ALL SELECT 0, scene, label, 'demolished', area_px FROM s1 WHERE support < 0.10)"""
_IOU = "CASE WHEN {u} = 0 THEN 1.0 ELSE {i} / {u} END"
_F = "least(1.0, CASE WHEN {a} < 4 THEN 0.05::DOUBLE + {a} * (0.95::DOUBLE / 3) ELSE 1.0 END, CASE WHEN {a} >= 4 THEN 0.05::DOUBLE + (7 - {a}) * (0.95::DOUBLE / 3) ELSE 1.0 END)"

_KERNEL = ", ".join(str(x) for x in pixels.ellipse(13))

QUERIES = {
    "tall_components": (tall_components, f"WITH RECURSIVE {_labels('o', 'p >= 0.15').replace(CELLS, TALL_CELLS)} SELECT scene, epoch, r, c, label FROM o"),
    "outline_corners": (outline_corners, f"""WITH RECURSIVE {_labels('o', 'p >= 0.15').replace(CELLS, TALL_CELLS)},
        way(d, i, j) AS (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1), (4, 0, -1), (5, -1, -1), (6, -1, 0), (7, -1, 1)),
        e AS MATERIALIZED (SELECT a.scene, a.epoch, a.label, a.r AS pr, a.c AS pc, d, b.r, b.c FROM o a, way JOIN o b ON b.scene = a.scene AND b.epoch = a.epoch AND b.r = a.r + i AND b.c = a.c + j),
        nx AS MATERIALIZED (SELECT e.scene, e.epoch, e.pr, e.pc, e.d, e.r, e.c, arg_min(f.d, (f.d - e.d + 11) % 8) AS d2 FROM e JOIN e f ON f.scene = e.scene AND f.epoch = e.epoch AND f.pr = e.r AND f.pc = e.c GROUP BY ALL),
        st AS MATERIALIZED (SELECT scene, epoch, label, pr, pc, min(d) AS d FROM e WHERE pr * 8 + pc = label GROUP BY ALL),
        walk AS (SELECT *, 0 AS i FROM st UNION ALL SELECT w.scene, w.epoch, w.label, x.r, x.c, x.d2, w.i + 1 FROM walk w JOIN nx x ON x.scene = w.scene AND x.epoch = w.epoch AND x.pr = w.pr AND x.pc = w.pc AND x.d = w.d
          ANTI JOIN st ON st.scene = w.scene AND st.epoch = w.epoch AND st.label = w.label AND st.pr = x.r AND st.pc = x.c AND st.d = x.d2),
        turn AS (SELECT *, lag(d) OVER (PARTITION BY scene, epoch, label ORDER BY i) AS was FROM walk)
        SELECT scene, epoch, label, row_number() OVER (PARTITION BY scene, epoch, label ORDER BY i) - 1 AS n, CAST(pc AS INTEGER) AS x, CAST(pr AS INTEGER) AS y FROM turn WHERE was IS DISTINCT FROM d
        UNION ALL SELECT scene, epoch, label, 0, CAST(c AS INTEGER), CAST(r AS INTEGER) FROM o WHERE (scene, epoch, label) NOT IN (SELECT (scene, epoch, label) FROM st) AND r * 8 + c = label"""),
    "least_rectangles": (least_rectangles, f"""WITH RECURSIVE {_labels('o', 'p >= 0.15').replace(CELLS, TALL_CELLS)},
        ob AS MATERIALIZED (SELECT scene, epoch, label, r AS y, c AS x FROM o), kinds AS (SELECT DISTINCT scene, epoch, label FROM ob),
        pr AS (SELECT a.scene, a.epoch, a.label, a.x, a.y, b.x - a.x AS dx, b.y - a.y AS dy FROM ob a JOIN ob b ON b.scene = a.scene AND b.epoch = a.epoch AND b.label = a.label AND (a.x, a.y) <> (b.x, b.y)),
        side AS MATERIALIZED (SELECT p.scene, p.epoch, p.label, p.x, p.y, dx, dy, max((q.x - p.x) * dx + (q.y - p.y) * dy) - min((q.x - p.x) * dx + (q.y - p.y) * dy) AS along, max((q.y - p.y) * dx - (q.x - p.x) * dy) AS away
            FROM pr p JOIN ob q ON q.scene = p.scene AND q.epoch = p.epoch AND q.label = p.label GROUP BY ALL HAVING min((q.y - p.y) * dx - (q.x - p.x) * dy) >= 0),
        edge AS (SELECT scene, epoch, label, arg_max(x * dy - y * dx, dx * dx + dy * dy) AS twice FROM side GROUP BY scene, epoch, label, dx // gcd(dx, dy), dy // gcd(dx, dy)),
        n AS (SELECT scene, epoch, label, count(*) AS corners, CAST(sum(twice) AS BIGINT) AS hull_area2 FROM edge GROUP BY ALL),
        ar AS (SELECT scene, epoch, label, min(along * away / CAST(dx * dx + dy * dy AS DOUBLE)) AS area FROM side GROUP BY ALL)
        SELECT k.scene, k.epoch, k.label, coalesce(corners, 1) AS corners, coalesce(hull_area2, 0) AS hull_area2, round_even(coalesce(area, 0), 6) AS area FROM kinds k LEFT JOIN n USING (scene, epoch, label) LEFT JOIN ar USING (scene, epoch, label)"""),
    "changed_regions": (changed_regions, f"""WITH RECURSIVE df AS (SELECT a.scene, a.r, a.c, abs(CAST(b.p AS DOUBLE) - CAST(a.p AS DOUBLE)) AS p FROM {TALL_CELLS} a JOIN {TALL_CELLS} b ON a.epoch = 0 AND b.epoch = 1 AND b.scene = a.scene AND b.r = a.r AND b.c = a.c),
        m AS (SELECT scene, r, c FROM df WHERE p >= {DIFFERENT}), {_five('g1', 'm', True)}, {_five('w1', 'g1', False)}, {_five('w2', 'w1', False)}, {_five('g2', 'w2', True)},
        low AS (SELECT * FROM g2 a WHERE NOT EXISTS (SELECT 1 FROM g2 b WHERE b.scene = a.scene AND abs(b.r - a.r) <= 1 AND abs(b.c - a.c) <= 1 AND b.r * 8 + b.c < a.r * 8 + a.c)),
        fl AS (SELECT scene, r, c, r * 8 + c AS label FROM low UNION SELECT g.scene, g.r, g.c, f.label FROM fl f JOIN g2 g ON g.scene = f.scene AND abs(g.r - f.r) <= 1 AND abs(g.c - f.c) <= 1),
        lb AS (SELECT scene, r, c, min(label) AS label FROM fl GROUP BY ALL)
        SELECT scene, CAST(label AS BIGINT) AS label, count(*) AS cells, CAST(sum(r * 8 + c) AS BIGINT) AS places, round_even(avg(p), 6) AS diff FROM lb JOIN df USING (scene, r, c) GROUP BY scene, label"""),
    "existing_structures": (existing_structures, f"""WITH RECURSIVE {_labels('o', 'epoch = 1 AND p >= 0.25').replace(CELLS, TALL_CELLS)},
        bx AS (SELECT scene, label, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM o GROUP BY ALL),
        no AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY label DESC) AS n FROM bx), pt AS (SELECT DISTINCT scene, r, c FROM {TALL_CELLS} WHERE epoch = 0 AND p >= 0.2),
        cd AS MATERIALIZED (SELECT b.scene, b.label, n, r1 - r0 AS dh, c1 - c0 AS dw, list(i * 8 + j) AS own, count(pt.r) AS hits FROM no b JOIN range(0, 128) x(i) ON i BETWEEN r0 AND r1 JOIN range(0, 8) y(j) ON j BETWEEN c0 AND c1 LEFT JOIN pt ON pt.scene = b.scene AND pt.r = i AND pt.c = j WHERE n <= {classic.MOST_EXISTING} GROUP BY ALL),
        gr AS (SELECT scene, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS label FROM cd WHERE n = 1
               UNION ALL SELECT c.scene, c.n, CASE WHEN ok THEN list_concat(taken, own) ELSE taken END, CASE WHEN ok THEN c.label END FROM (SELECT c.*, taken, c.hits + len(list_intersect(own, taken)) <= len(own) * {classic.OVERLAP} AS ok FROM gr g JOIN cd c ON c.scene = g.scene AND c.n = g.n + 1) c)
        SELECT scene, label, CAST((dh + 1) * (dw + 1) AS DOUBLE) AS area_px, (dh + 1) * (dw + 1) * 0.25e0 AS area_m2, (dh + dw) * 1e0 AS perimeter_m FROM cd JOIN gr USING (scene, label)"""),
    "cell_percentiles": (cell_percentiles, f"""WITH v AS (SELECT epoch, CAST(p AS DOUBLE) AS p FROM {TALL_CELLS}), q AS (SELECT epoch, count(*) AS n, quantile_cont(p, 0.02) AS low, quantile_cont(p, 0.5) AS middle, quantile_cont(p, 0.98) AS high FROM v GROUP BY epoch)
        SELECT q.epoch, n, (SELECT count(*) FROM v WHERE v.epoch = q.epoch AND v.p >= q.high) AS "over", round_even(low, 6) AS low, round_even(middle, 6) AS middle, round_even(high, 6) AS high FROM q"""),
    "band_stretch": (band_stretch, f"""WITH v AS (SELECT scene, epoch, r, c, floor(abs(CAST(p AS DOUBLE)) * CASE WHEN scene % 3 = 0 THEN 200 ELSE 20000 END) AS v FROM {TALL_CELLS}),
        q AS (SELECT scene, epoch, quantile_cont(v, 0.02) AS low, quantile_cont(v, 0.98) AS high, max(v) AS top FROM v GROUP BY ALL),
        s AS (SELECT scene, epoch, r, c, CAST(floor(greatest(0, least(255, CASE WHEN top > 255 THEN (v - low) / greatest(high - low, 1e-6) * 255 ELSE v END))) AS BIGINT) AS v FROM v JOIN q USING (scene, epoch))
        SELECT scene, epoch, CAST(sum(v) AS BIGINT) AS total, count(*) FILTER (v = 0) AS low, count(*) FILTER (v = 255) AS high, CAST(sum(v * (r * 8 + c)) AS BIGINT) AS places FROM s GROUP BY scene, epoch"""),
    "polygon_cells": (polygon_cells, f"""WITH v AS (SELECT o_orderkey AS id, i, CAST(o_orderkey * a % 60 - 6 AS BIGINT) AS x, CAST(o_orderkey * b % 52 - 6 AS BIGINT) AS y FROM orders, (VALUES {", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(CORNERS))}) k(i, a, b)),
        s AS (SELECT p.id, p.x AS x0, p.y AS y0, q.x AS x1, q.y AS y1 FROM v p JOIN v q ON q.id = p.id AND q.i = (p.i + 1) % {len(CORNERS)}),
        inner_ AS (SELECT s.id, y, x FROM s JOIN range(0, 40) a(y) ON (y0 <= y) <> (y1 <= y) JOIN range(0, 48) b(x) ON x < x0 + CAST((y - y0) * (x1 - x0) AS DOUBLE) / (y1 - y0) GROUP BY s.id, y, x HAVING count(*) % 2 = 1),
        line AS (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0), 1) AS m FROM s), dot AS (SELECT *, unnest(range(0, m + 1)) AS i FROM line),
        t AS (SELECT id, CAST(round_even(y0 + (y1 - y0) * f, 0) AS BIGINT) AS y, CAST(round_even(x0 + (x1 - x0) * f, 0) AS BIGINT) AS x FROM (SELECT *, CASE WHEN i = m THEN 1e0 ELSE i * (1e0 / m) END AS f FROM dot))
        SELECT id, count(*) AS cells, CAST(sum(y * 48 + x) AS BIGINT) AS places FROM (SELECT * FROM inner_ UNION SELECT id, y, x FROM t WHERE y BETWEEN 0 AND 39 AND x BETWEEN 0 AND 47) GROUP BY id"""),
    "wide_dilation": (wide_dilation, f"""WITH x AS (SELECT DISTINCT scene, epoch, r + dy AS r, c + dx AS c FROM (SELECT * FROM {TALL_CELLS} WHERE p >= 0.3), (VALUES {_KERNEL}) k(dy, dx))
        SELECT scene, epoch, count(*) AS cells, CAST(sum(r * 8 + c) AS BIGINT) AS places FROM x WHERE r BETWEEN 0 AND 127 AND c BETWEEN 0 AND 7 GROUP BY scene, epoch"""),
    "scene_pixels": (scene_pixels, f"SELECT scene, epoch, count(*) AS cells, CAST(sum(r * 8 + c) AS BIGINT) AS places FROM {CELLS} WHERE p >= 0.15 GROUP BY scene, epoch"),
    "scene_support": (scene_support, f"SELECT scene, epoch, r, c FROM {CELLS} WHERE p > 0.25"),
    "dilate_mask": (dilate_mask, f"""WITH x AS (SELECT DISTINCT scene, epoch, CAST(r + i AS INTEGER) AS r, CAST(c + j AS INTEGER) AS c FROM (SELECT * FROM {CELLS} WHERE p >= 0.2), range(-1, 2) a(i), range(-1, 2) b(j))
        SELECT scene, epoch, count(*) AS cells, CAST(sum(r * 8 + c) AS BIGINT) AS places FROM x WHERE r BETWEEN 0 AND 7 AND c BETWEEN 0 AND 7 GROUP BY scene, epoch"""),
    "open_mask": (open_mask, f"""WITH m AS (SELECT scene, epoch, r, c FROM {CELLS} WHERE p >= 0.0), o(i, j) AS (SELECT i, j FROM range(-1, 2) a(i), range(-1, 2) b(j)),
        q AS (SELECT scene, epoch, r + i AS r, c + j AS c FROM m, o), e AS (SELECT scene, epoch, r, c FROM q WHERE r BETWEEN 0 AND 7 AND c BETWEEN 0 AND 7 GROUP BY ALL HAVING count(*) = (CASE WHEN r IN (0, 7) THEN 2 ELSE 3 END) * (CASE WHEN c IN (0, 7) THEN 2 ELSE 3 END))
        SELECT DISTINCT scene, epoch, CAST(r + i AS INTEGER) AS r, CAST(c + j AS INTEGER) AS c FROM e, o WHERE r + i BETWEEN 0 AND 7 AND c + j BETWEEN 0 AND 7"""),
    "components": (components, f"WITH RECURSIVE {_labels('o', 'p >= 0.15')} SELECT scene, epoch, r, c, label FROM o"),
    "component_stats": (component_stats, f"WITH RECURSIVE {_labels('o', 'p >= 0.15')} SELECT scene, epoch, label, count(*) AS area_px, CAST(min(c) AS BIGINT) AS x, CAST(min(r) AS BIGINT) AS y, CAST(max(c) - min(c) + 1 AS BIGINT) AS width, CAST(max(r) - min(r) + 1 AS BIGINT) AS height FROM o GROUP BY scene, epoch, label HAVING count(*) >= 3"),
    "object_support_fraction": (object_support_fraction, f"{_O} SELECT scene, label, area_px, round_even(support, 6) AS support FROM ({_LATER})"),
    "new_objects": (new_objects, f"{_O} SELECT scene, label, area_px FROM ({_LATER}) WHERE support < 0.10"),
    "demolished_objects": (demolished_objects, f"{_O} SELECT scene, label, area_px FROM ({_EARLIER}) WHERE support < 0.10"),
    "footprint_match": (footprint_match, f"{_O}, {_MATCH} SELECT scene, label, round_even(overlap, 6) AS overlap, n_before, round_even(contained, 6) AS contained FROM fm"),
    "classify_objects": (classify_objects, f"{_CLASSES} SELECT scene, type, label, area_px FROM cl"),
    "split_objects": (split_objects, f"""{_CLASSES}, ca AS (SELECT o.*, s.r IS NOT NULL AS held, cl.type FROM obj o LEFT JOIN sup s ON s.scene = o.scene AND s.epoch = 1 - o.epoch AND s.r = o.r AND s.c = o.c LEFT JOIN cl ON cl.scene = o.scene AND cl.epoch = o.epoch AND cl.label = o.label),
        pm AS (SELECT scene, epoch, label AS obj, held, r, c FROM ca WHERE epoch = 1 AND type = 'existing' OR epoch = 0 AND type IS NULL AND NOT held),
        pr AS (SELECT *, r * 8 + c AS part FROM pm UNION SELECT m.scene, m.epoch, m.obj, m.held, m.r, m.c, x.part FROM pr x JOIN pm m ON m.scene = x.scene AND m.epoch = x.epoch AND m.obj = x.obj AND m.held = x.held AND abs(m.r - x.r) <= 1 AND abs(m.c - x.c) <= 1),
        pc AS (SELECT scene, epoch, obj, held, r, c, min(part) AS part FROM pr GROUP BY ALL), pa AS (SELECT scene, epoch, obj, held, part, count(*) AS n FROM pc GROUP BY ALL HAVING count(*) >= {MIN_PX}),
        cut AS (SELECT DISTINCT scene, obj FROM pa WHERE epoch = 1 AND NOT held),
        fin AS (SELECT type, area_px AS n FROM cl WHERE type <> 'existing' UNION ALL SELECT type, area_px FROM cl ANTI JOIN cut ON cut.scene = cl.scene AND cut.obj = cl.label WHERE type = 'existing'
                UNION ALL SELECT CASE WHEN epoch = 0 THEN 'demolished' WHEN held THEN 'existing' ELSE 'new' END, n FROM pa WHERE epoch = 0 OR EXISTS (SELECT 1 FROM cut WHERE cut.scene = pa.scene AND cut.obj = pa.obj))
        SELECT type, count(*) AS objects, CAST(sum(n) AS BIGINT) AS area_px FROM fin GROUP BY type"""),
    "label_painting": (label_painting, f"{_CLASSES}, pt AS (SELECT scene, r, c, max_by(type, CASE WHEN epoch = 0 THEN 2 ELSE 1 END) AS type FROM obj JOIN cl USING (scene, epoch, label) GROUP BY scene, r, c) SELECT scene, type, count(*) AS cells FROM pt GROUP BY scene, type"),
    "scene_iou": (scene_iou, f"""WITH x AS (SELECT scene, count(*) FILTER (n = 2) AS i, count(*) FILTER (n > 0) AS u FROM (SELECT scene, r, c, count(*) FILTER (p >= 0.15) AS n FROM {CELLS} GROUP BY scene, r, c) GROUP BY scene)
        SELECT scene, i AS "both", u AS either, round_even({_IOU.format(u='u', i='i')}, 6) AS iou FROM x"""),
    "change_metrics": (change_metrics, f"""WITH x AS (SELECT scene, r, c, max(CASE WHEN epoch = 1 AND p >= 0.1 THEN 1 ELSE 0 END) AS a, max(CASE WHEN epoch = 0 AND p >= 0.1 THEN 1 ELSE 0 END) AS b FROM {CELLS} GROUP BY scene, r, c),
        n AS (SELECT scene, count(*) FILTER (a = 1 AND b = 1) AS tp, count(*) FILTER (a = 1 AND b = 0) AS fp, count(*) FILTER (a = 0 AND b = 1) AS fn FROM x GROUP BY scene)
        SELECT *, {", ".join(f"CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE round_even(CASE WHEN {u} = 0 THEN 0.0 ELSE {i} / ({u}) END, 3) END AS {k}" for k, i, u in (("precision", "tp", "tp + fp"), ("recall", "tp", "tp + fn"), ("f1", "2 * tp", "2 * tp + fp + fn"), ("iou", "tp", "tp + fp + fn")))} FROM n"""),
    "parallax_shift": (parallax_shift, f"""WITH RECURSIVE {_labels('o', 'epoch = 1 AND p >= 0.15')}, obj AS {_big('o', MIN_PX)}, pb AS (SELECT scene, r, c, CAST(greatest(p, 0) AS DOUBLE) AS p FROM {CELLS} WHERE epoch = 0),
        b AS (SELECT scene, label, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, count(*) AS n FROM obj GROUP BY ALL HAVING min(r) >= 1 AND min(c) >= 1 AND max(r) <= 6 AND max(c) <= 6),
        q AS (SELECT b.scene, b.label, n, dr, dc, sum(CASE WHEN o.r IS NULL THEN 0 ELSE pb.p END) AS num, sum(pb.p * pb.p) AS sq FROM b CROSS JOIN range(-1, 2) x(dr) CROSS JOIN range(-1, 2) y(dc) JOIN pb ON pb.scene = b.scene AND pb.r BETWEEN r0 + dr AND r1 + dr AND pb.c BETWEEN c0 + dc AND c1 + dc
              LEFT JOIN obj o ON o.scene = b.scene AND o.label = b.label AND o.r = pb.r - dr AND o.c = pb.c - dc GROUP BY ALL),
        f AS (SELECT *, row_number() OVER (PARTITION BY scene, label ORDER BY round_even(CASE WHEN sq > 0 THEN num / sqrt(n * sq) ELSE 0 END, 9) DESC, dr, dc) AS best, round_even(CASE WHEN sq > 0 THEN num / sqrt(n * sq) ELSE 0 END, 9) AS quality FROM q),
        g AS (SELECT scene % 4 AS "group", count(*) AS matches, quantile_cont(sqrt(dr * dr + dc * dc), 0.75) AS p75 FROM f WHERE best = 1 AND quality > 0.75 GROUP BY ALL)
        SELECT "group", matches, CASE WHEN matches >= 5 THEN round_even(p75 + 2, 6) END AS shift_px FROM g"""),
    "weighted_blend": (weighted_blend, f"SELECT scene, r, c, round_even(sum(CAST(p AS DOUBLE) * w) / greatest(sum(w), 1e-6), 6) AS p FROM (SELECT *, {_F.format(a='r')} * {_F.format(a='c')} * (epoch + 1) AS w FROM {CELLS}) GROUP BY scene, r, c"),
    "placeholder_tiles": (placeholder_tiles, f"WITH t AS (SELECT scene, epoch, avg(CASE WHEN abs(p) < 0.15 THEN 1 ELSE 0 END) > 0.8 AS missing FROM {CELLS} GROUP BY scene, epoch) SELECT scene, count(*) FILTER (missing) AS missing, bool_and(missing) AS all_missing, CASE WHEN count(*) FILTER (missing) > 0 THEN count(*) FILTER (missing) || '/2' END AS note FROM t GROUP BY scene"),
    "capture_states": (capture_states, f"""WITH RECURSIVE {_labels('o', 'epoch = 1 AND p >= 0.15')}, obj AS {_big('o', MIN_PX)}, v AS (SELECT scene, r, c, max(CASE WHEN epoch = 0 THEN p END) AS p1, max(CASE WHEN epoch = 1 THEN p END) AS p2 FROM {CELLS} GROUP BY scene, r, c),
        n AS (SELECT o.scene, o.label, seq, count(*) FILTER (m AND a) AS ma, count(*) FILTER (m OR a) AS mua, count(*) FILTER (m AND b) AS mb, count(*) FILTER (m OR b) AS mub, bool_or(bad) AS bad
              FROM (SELECT o.scene, o.label, seq, x.p2 >= 0.1 AS m, x.p2 > 0.45 AS bad, w.p2 >= 0.1 AS a, coalesce(w.p1 >= 0.1, false) AS b FROM obj o CROSS JOIN range(1, 4) k(seq) JOIN v x ON x.scene = o.scene + seq AND x.p2 IS NOT NULL AND x.r = o.r AND x.c = o.c JOIN v w ON w.scene = o.scene AND w.r = o.r AND w.c = o.c) o GROUP BY ALL),
        s AS (SELECT *, {_IOU.format(u='mua', i='ma')} - {_IOU.format(u='mub', i='mb')} AS diff FROM n)
        SELECT scene, label, seq, CASE WHEN NOT bad AND abs(diff) >= 0.1 THEN diff > 0 END AS state FROM s"""),
}
