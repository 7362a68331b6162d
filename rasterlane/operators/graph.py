"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlane.sources.shared import drop_path, written


def components(links: DataFrame) -> DataFrame:
    """links: u, v of one ordered type, numbers or structs. node and label (its component's smallest node) of every node that has a link.

    Large-star and small-star steps by turns: every node's larger neighbours, then the node and its smaller ones, are hung on the
    smallest neighbour, until each component is a star. Minima are summed by key before they are joined to the links, so that a
    node with very many links is no single task's work. Every step is written to the shared folder; no join sends minima, which grow with
    the links, to all tasks."""
    links, path = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new, new_path = written(small, "links")
        new_mark = _mark(new)
        drop_path(links.sparkSession, path)
        links, path = new, new_path
        if new_mark == mark:
            break
        mark = new_mark
    hubs = links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(hubs)


def _mark(links: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())
