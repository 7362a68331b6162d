"""Mixing sources to target weights, with DataFrame functions alone.

Each source gets a share of the token budget by its weight, capped at `max_epochs` times what the source holds; what
a cap frees is shared again by weight. Documents of a source stand in the order of a hash-random key; a source's
budget takes whole epochs first and cuts the last one at the exact token. The order's prefix sums are distributed:
the key's leading digits make range buckets (4,096 a source), sums of buckets are gathered per source, and rows add
up inside their bucket only, so a source with a third of all rows is spread over thousands of tasks.

Defined cases: null source is a source of its own (last in order); null or empty text has size 0 and takes 0; rows
repeated in full are tied, each is counted, and the cut between them falls on any of them with the same totals; an
empty table gives no rows; other columns pass through `keep` untouched, and a kept column that is named like a result wins: that
result is left out (`prefix` gives results other names); rows without an id are spread by their text; names starting with `_mx_`
are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table

DIGITS = 3  # hex digits of the key that name a bucket: 16 ** 3 buckets a source


def source_targets(sizes: DataFrame, weights=(5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """sizes: a row per source (_mx_source, _mx_total). Adds _mx_target: weighted shares of the sum of all totals, none
    over max_epochs times its total. One row per source is sorted in one task, after the counts are summed."""
    everywhere = Window.partitionBy()
    named = Window.orderBy(F.col("_mx_source").isNull(), F.col("_mx_source"))
    up, down = Window.unboundedPreceding, Window.unboundedFollowing
    s = sizes.withColumn("_mx_rank", F.row_number().over(named))
    s = s.withColumn("_mx_w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("_mx_rank") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_mx_cap", F.col("_mx_total") * F.lit(max_epochs))
    s = s.withColumn("_mx_ratio", F.col("_mx_cap").cast("double") / F.col("_mx_w"))
    fill = Window.orderBy("_mx_ratio", "_mx_rank")
    s = s.withColumns({
        "_mx_rem": F.sum("_mx_total").over(everywhere) - F.sum("_mx_cap").over(fill.rowsBetween(up, 0)) + F.col("_mx_cap"),
        "_mx_wsum": F.sum("_mx_w").over(fill.rowsBetween(0, down)),
        "_mx_fill": F.row_number().over(fill),
    })
    s = s.withColumn("_mx_open", F.col("_mx_ratio") * F.col("_mx_wsum") >= F.col("_mx_rem"))  # not capped
    first = lambda c: F.min_by(F.col(c), F.when(F.col("_mx_open"), F.col("_mx_fill"))).over(everywhere)
    s = s.withColumns({"_mx_rem1": first("_mx_rem"), "_mx_wsum1": first("_mx_wsum"), "_mx_fill1": F.min(F.when(F.col("_mx_open"), F.col("_mx_fill"))).over(everywhere)})
    share = F.col("_mx_rem1").cast("double") * F.col("_mx_w") / F.col("_mx_wsum1")
    target = F.when(F.col("_mx_fill") >= F.col("_mx_fill1"), share).otherwise(F.col("_mx_cap").cast("double"))
    return s.select("_mx_source", "_mx_total", target.alias("_mx_target"))


def mix_sources(docs: DataFrame, weights=(5, 2, 1), max_epochs: int = 3, seed: str = "mix", keep: list[str] | None = None,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", prefix: str = "") -> DataFrame:
    """Adds to the columns `keep` (id_col if not given), each name after `prefix`: size, source_size long; target double; epochs
    long (whole passes) and taken long (tokens the mix takes, repeats counted) of every row."""
    keep = [id_col] if keep is None else keep
    rows = docs.select(
        *[F.col(c).alias(f"_mx_keep{i}") for i, c in enumerate(keep)],
        F.col(id_col).alias("_mx_id"), F.col(source_col).cast("string").alias("_mx_source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("_mx_size"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("binary")), F.lit("")), F.lit(f"#{seed}")).cast("binary")).alias("_mx_key"),
    ).withColumn("_mx_bucket", F.substring("_mx_key", 1, DIGITS))
    # a null source joins as the empty name with a mark
    named = [F.col("_mx_source").isNull().alias("_mx_none"), F.coalesce("_mx_source", F.lit("")).alias("_mx_name")]
    rows = rows.select("*", *named)
    part = rows.groupBy("_mx_source", "_mx_bucket").agg(F.sum("_mx_size").alias("_mx_sum"))
    sizes = part.groupBy("_mx_source").agg(F.sum("_mx_sum").alias("_mx_total"))
    targets = source_targets(sizes, weights, max_epochs).select("*", *named).drop("_mx_source")
    before = Window.partitionBy("_mx_source").orderBy("_mx_bucket").rowsBetween(Window.unboundedPreceding, 0)
    offsets = (part.withColumn("_mx_offset", F.sum("_mx_sum").over(before) - F.col("_mx_sum")).select("_mx_bucket", "_mx_offset", *named)
               .join(targets, ["_mx_none", "_mx_name"]))
    inside = Window.partitionBy("_mx_none", "_mx_name", "_mx_bucket").orderBy("_mx_key", "_mx_id", "_mx_size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(offsets, ["_mx_none", "_mx_name", "_mx_bucket"])
    rows = rows.withColumn("_mx_before", F.col("_mx_offset") + F.sum("_mx_size").over(inside) - F.col("_mx_size"))
    rows = rows.withColumn("_mx_budget", F.floor("_mx_target"))
    full = F.when(F.col("_mx_total") > 0, F.expr("_mx_budget div _mx_total")).otherwise(0)
    rest = F.when(F.col("_mx_total") > 0, F.col("_mx_budget") % F.col("_mx_total")).otherwise(0)
    cut = F.greatest(F.lit(0), F.least(F.col("_mx_size"), rest - F.col("_mx_before")))
    results = {
        "size": F.col("_mx_size"), "source_size": F.col("_mx_total"), "target": F.col("_mx_target"),
        "epochs": full.cast("long"), "taken": (full * F.col("_mx_size") + cut).cast("long"),
    }
    taken_names = {c.lower() for c in keep}
    return rows.select(*[F.col(f"_mx_keep{i}").alias(c) for i, c in enumerate(keep)], *[c.alias(prefix + x) for x, c in results.items() if (prefix + x).lower() not in taken_names])


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), md5(text), '') || '#mix') AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rk FROM s),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS wt, total * 3 AS cap FROM n),
r AS (SELECT *, CAST(cap AS DOUBLE) / wt AS ratio FROM w),
f AS (SELECT *, CAST(sum(total) OVER () - sum(cap) OVER (ORDER BY ratio, rk ROWS UNBOUNDED PRECEDING) + cap AS BIGINT) AS rem,
             CAST(sum(wt) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS wsum,
             row_number() OVER (ORDER BY ratio, rk) AS fill FROM r),
o AS (SELECT min(fill) AS f1 FROM f WHERE ratio * wsum >= rem),
t AS (SELECT f.source, f.total, CASE WHEN f.fill >= g.fill THEN CAST(g.rem AS DOUBLE) * f.wt / g.wsum ELSE CAST(f.cap AS DOUBLE) END AS target
      FROM f LEFT JOIN (SELECT f.* FROM f JOIN o ON f.fill = o.f1) g ON true),
p AS (SELECT d.doc_id, d.size, t.total AS source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM p
"""
