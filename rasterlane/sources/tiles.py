"""Tile grids read through a cache folder of files named {release}_{zoom}_{row}_{column}.jpg.

What a grid needs is a relation of keys; it meets the cached files in a join, what is missing may be fetched by a function in tasks,
spread over the cluster, and what stays missing has a flag and no content; the mosaic makes a flat placeholder of it. Fetched tiles are returned apart, to be added
to the cache; placeholders never are."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlane.functions import geo
from rasterlane.operators import blocks
from rasterlane.sources import catalogs, jpeg

KEY = ["release_id", "zoom", "ty", "tx"]
TILE, PLACEHOLDER = 256, 200
AT_ONCE = 16  # tiles whose pixels a task holds at once, 0.8 MB each
KEPT = 128  # files whose pixels a task keeps, 0.2 MB each
ANALYSIS_ZOOM = 17


def wanted(points: DataFrame) -> DataFrame:
    """points (lat, lon, zoom, grid_size, release_id, ...) with a row per tile: ty, tx, row, col, bounds of the grid, gsd."""
    p = points.withColumn("_o", geo.grid_origin(F.col("lat"), F.col("lon"), F.col("zoom"), F.col("grid_size")))
    p = p.withColumns({"bounds": geo.grid_bounds(F.col("_o.x"), F.col("_o.y"), F.col("grid_size"), F.col("zoom")), "gsd": geo.ground_resolution(F.col("lat"), F.col("zoom"))})
    side = F.sequence(F.lit(0), F.col("grid_size") - 1)
    p = p.select("*", F.explode(side).alias("row")).select("*", F.explode(side).alias("col"))
    return p.withColumns({"ty": F.col("_o.y") + F.col("row"), "tx": F.col("_o.x") + F.col("col")}).drop("_o")


def pair(points: DataFrame) -> DataFrame:
    """Both dates of points (lat, lon, grid_size, year_t1, year_t2): epoch 0 and 1, with the years' releases; zoom is the analysis zoom."""
    p = catalogs.with_release(catalogs.with_release(points, "year_t1", catalogs.FIRST_YEAR, "_r1"), "year_t2", catalogs.LAST_YEAR, "_r2")
    both = F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), F.col(f"_r{e + 1}").alias("release_id")) for e in (0, 1)])).alias("_e")
    p = p.withColumns({"zoom": F.lit(ANALYSIS_ZOOM), "grid_size": F.coalesce("grid_size", F.lit(2))})
    return wanted(p.select("*", both).select(*[c for c in p.columns if c not in ("_r1", "_r2")], "_e.epoch", "_e.release_id"))


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """release_id, zoom, ty, tx, content of the folder's tiles."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*_*_*_*.jpg").load(folder)
    name = F.split(F.regexp_extract("path", r"([^/]*)\.jpg$", 1), "_")
    return f.select(name[0].alias("release_id"), name[1].cast("int").alias("zoom"), name[2].cast("int").alias("ty"), name[3].cast("int").alias("tx"), "content")


def scan(want: DataFrame, cache: DataFrame, fetch: Callable[[str, int, int, int], bytes | None] | None = None) -> tuple[DataFrame, DataFrame]:
    """want with content and is_missing; and the tiles that were fetched (KEY, content). fetch gives a tile's bytes or None."""
    keys = want.select(*KEY).distinct()
    got = keys.join(cache.select(*KEY, "content"), KEY, "left")
    absent = got.where(F.col("content").isNull()).select(*KEY)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(content=[fetch(*k) for k in frame[KEY].itertuples(index=False, name=None)])

    fetched = (absent.mapInPandas(run, want.select(*KEY).withColumn("content", F.lit(None).cast("binary")).schema) if fetch else got.where("false")).where(F.col("content").isNotNull())
    found = got.where(F.col("content").isNotNull()).unionByName(fetched)
    return want.join(found, KEY, "left").withColumn("is_missing", F.col("content").isNull()), fetched


def missing_summary(tiles: DataFrame, key: list[str]) -> DataFrame:
    """Per key: tiles that are missing on either date, their number in the grid, whether a date has none at all, and the note."""
    from rasterlane.functions import rules

    cell = tiles.groupBy(*key, "row", "col").agg(F.bool_or("is_missing").alias("missing"))
    whole = tiles.groupBy(*key, "epoch").agg(F.every("is_missing").alias("none")).groupBy(*key).agg(F.bool_or("none").alias("no_imagery"))
    n = cell.groupBy(*key).agg(F.count_if("missing").alias("missing"), F.count("*").alias("total"))
    return n.join(whole, key).withColumn("note", rules.missing_text(F.col("missing"), F.col("total")))


def placeholder() -> Column:
    """The pixels of the placeholder: grey in all bands, row by row."""
    return F.unhex(F.repeat(F.lit(f"{PLACEHOLDER:02X}"), 3 * TILE * TILE))


def tile_reader() -> Callable[[bytes | None], tuple[np.ndarray, float]]:
    """Gives a file's pixels as a whole tile, and the share of them that have the placeholder's grey. The last KEPT different files are
    read once: services send one file for all places without imagery, and many tiles are one colour."""

    @lru_cache(KEPT)
    def read(content: bytes | None) -> tuple[np.ndarray, float]:
        x = jpeg.pixels_or_none(content)
        block = np.full((TILE, TILE, 3), PLACEHOLDER if x is None else 0, np.uint8)
        if x is not None:
            block[: x.shape[0], : x.shape[1]] = x[:TILE, :TILE]
        return block, float((block == PLACEHOLDER).all(2).mean())

    return read


def mosaic(tiles: DataFrame) -> DataFrame:
    """Tiles (scene, epoch, grid_size, row, col, content) as the blocks of the images that they make up, in the columns of
    operators.blocks, and is_placeholder, whether over nine tenths of a block are the placeholder's grey.

    A tile is one block: no task holds more than a tile. Tiles without content and files that are not readable are the
    placeholder; of tiles in another size the top left part counts, and what they leave open is black."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = tile_reader()
        for frame in (whole.iloc[i : i + AT_ONCE] for whole in frames for i in range(0, len(whole), AT_ONCE)):
            found = [read(content) for content in frame["content"]]
            yield frame.drop(columns="content").assign(data=[x.astype(np.float32).tobytes() for x, _ in found], grey=[grey for _, grey in found])

    side = (F.col("grid_size") * TILE).cast("int")
    place = {"y0": F.col("row") * TILE, "x0": F.col("col") * TILE, "bh": F.lit(TILE), "bw": F.lit(TILE), "h": side, "w": side, "bands": F.lit(3)}
    t = tiles.select(F.col("scene").cast("long").alias("scene"), F.col("epoch").cast("int").alias("epoch"), *[v.cast("int").alias(k) for k, v in place.items()], "content")
    out = t.mapInPandas(run, blocks.SCHEMA + ", grey double")
    return out.withColumn("is_placeholder", is_placeholder(F.col("grey"))).drop("grey")


def stitched(tiles: DataFrame) -> DataFrame:
    """Tiles as whole images: scene, epoch, h, w, bands, data (uint8, row by row). A request has few tiles (rules.valid_grid_size bounds
    a side), so an image's size is bounded; larger areas stay blocks."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        h, w = rows[0]["h"], rows[0]["w"]
        out = np.full((h, w, 3), PLACEHOLDER, np.uint8)
        for r in rows:
            out[r["y0"] : r["y0"] + TILE, r["x0"] : r["x0"] + TILE] = np.frombuffer(r["data"], np.float32).reshape(TILE, TILE, 3)
        return pa.table({"scene": pa.array([rows[0]["scene"]], pa.int64()), **{k: pa.array([v], pa.int32()) for k, v in (("epoch", rows[0]["epoch"]), ("h", h), ("w", w), ("bands", 3))}, "data": pa.array([out.tobytes()], pa.binary())})

    return mosaic(tiles).select("scene", "epoch", "h", "w", "y0", "x0", "data").groupBy("scene", "epoch").applyInArrow(run, "scene long, epoch int, h int, w int, bands int, data binary")


def without_imagery(tiles: DataFrame) -> DataFrame:
    """Cells (scene, r, c) of tiles that are missing on either date."""
    side = F.sequence(F.lit(0), F.lit(TILE - 1))
    bad = invalid_cells(tiles, ["scene"]).select("scene", "row", "col", F.explode(side).alias("dr"))
    return bad.select("scene", (F.col("row") * TILE + F.col("dr")).alias("r"), F.col("col"), F.explode(side).alias("dc")).select("scene", "r", (F.col("col") * TILE + F.col("dc")).alias("c"))


def usable(tiles: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Tiles of the keys whose dates all have some imagery, and the other keys with an error."""
    none = tiles.groupBy(*key, "epoch").agg(F.every("is_missing").alias("none")).where("none").select(*key).distinct()
    return tiles.join(none, key, "left_anti"), none.withColumn("error", F.lit("no_imagery"))


def invalid_cells(tiles: DataFrame, key: list[str]) -> DataFrame:
    """Places in the grid (row, col) that are missing on either date: what both dates' probabilities are zeroed in."""
    return tiles.where("is_missing").select(*key, "row", "col").distinct()


def seen_captures(tiles: DataFrame, key: list[str]) -> DataFrame:
    """Without the captures (epochs) that have no tile at all."""
    seen = tiles.groupBy(*key, "epoch").agg(F.every("is_missing").alias("none")).where("NOT none").select(*key, "epoch")
    return tiles.join(seen, [*key, "epoch"], "left_semi")


def is_placeholder(flat_share: Column) -> Column:
    """Whether a tile is the placeholder, from the share of its cells that have the placeholder's grey in all bands."""
    return flat_share > 0.9


def cache_name(release: Column, zoom: Column, ty: Column, tx: Column) -> Column:
    return F.concat_ws("_", release, zoom.cast("string"), ty.cast("string"), F.concat(tx.cast("string"), F.lit(".jpg")))
