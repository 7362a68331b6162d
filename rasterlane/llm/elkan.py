"""Centroid clustering with Elkan's bounds over integer vectors.

Every vector carries an upper bound of its distance to its own centroid and a lower bound for each of the k centroids. A table
of vectors with bounds is written to the shared folder each round; a round is one pass of numpy over Arrow batches against k
centroids. A distance is computed only where neither the lower bound nor half the distance between two centroids is above the
upper bound. Bounds are rounded outwards (also where they are kept in single precision) and pruning is strict, so a centroid
at equal distance is never skipped and ties go to the smaller number. Distances themselves are exact integers. Tasks sum their
vectors by cluster before a shuffle of k rows a task; k x dim sums come to the driver.

Defined cases: vectors that are null, of another length, or with null or non-finite components are left out; components
beyond +-2**27 after scaling count as that, so that distances fit a long; fewer vectors than k make as many centroids as
there are vectors; vectors without an id start no centroid unless too few have one; repeated rows are each kept; vectors that
tie for a start are taken in the order of their components; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, table, written

MOST = 1 << 27  # of a component: 64 squared differences fit 62 bits


def above(squared: np.ndarray) -> np.ndarray:
    """A double not below the root of exact squares."""
    return np.nextafter(np.nextafter(np.sqrt(squared.astype(np.float64)), np.inf), np.inf)


def below(squared: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.nextafter(np.nextafter(np.sqrt(squared.astype(np.float64)), -np.inf), -np.inf))


def single_above(x: np.ndarray) -> np.ndarray:
    x = np.nextafter(x, np.inf)
    y = x.astype(np.float32)
    return np.where(y < x, np.nextafter(y, np.float32(np.inf)), y)


def single_below(x: np.ndarray) -> np.ndarray:
    x = np.nextafter(x, -np.inf)
    y = x.astype(np.float32)
    return np.maximum(np.float32(0), np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y))


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of v to c."""
    d = v - c
    return np.einsum("ij,ij->i", d, d)


class Step:
    """What one assignment needs of the centroids: themselves, half their distances, and how far each has moved."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.centroids = centroids
        self.half = np.stack([below(squares(centroids, c)) / 2 for c in centroids])  # halving is exact
        self.moved = above(squares(centroids, before)) if before is not None else np.zeros(len(centroids))

    def assign(self, v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Cluster, exact squared distance or -1 where it was not needed, both bounds, and the number of distances computed."""
        own, rows = own.copy(), np.arange(len(v))
        upper = np.nextafter(upper.astype(np.float64) + self.moved[own], np.inf)
        lower = np.maximum(0, np.nextafter(lower.astype(np.float64) - self.moved, -np.inf))
        squared = np.full(len(v), -1, np.int64)
        other = rows[:, None] * 0 + np.arange(len(self.centroids)) != own[:, None]
        open_ = rows[(other & (lower <= upper[:, None]) & (self.half[own] <= upper[:, None])).any(1)]
        computed = len(open_)
        if computed:  # the bound to the own centroid is made tight first
            squared[open_] = squares(v[open_], self.centroids[own[open_]])
            upper[open_] = above(squared[open_])
            lower[open_, own[open_]] = below(squared[open_])
        for j, c in enumerate(self.centroids):
            at = open_[(own[open_] != j) & (lower[open_, j] <= upper[open_]) & (self.half[own[open_], j] <= upper[open_])]
            if not len(at):
                continue
            computed += len(at)
            d = squares(v[at], c)
            lower[at, j] = below(d)
            nearer = (d < squared[at]) | (d == squared[at]) & (j < own[at])
            won = at[nearer]
            own[won], squared[won] = j, d[nearer]
            upper[won] = above(squared[won])
        return own, squared, upper, lower, computed


def matrix(column: pa.Array, width: int, kind=None) -> np.ndarray:
    out = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out if kind is None else out.astype(kind)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel(), kind), values.shape[1]).cast(pa.list_(kind))


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """id and v array<int> of every vector that counts."""
    x = F.col(vec_col).cast("array<double>")
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), x.alias("x")).where(F.col("x").isNotNull() & (F.size("x") == dim) & whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                v = np.clip(np.floor(matrix(batch.column(1), dim) * scale), -MOST, MOST).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(v, pa.int32())], ["id", "v"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, v array<int>")


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return np.array([r.v for r in rows.select("v", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()], np.int64)


def assigned(rows: DataFrame, step: Step, dim: int, first: bool, last: bool) -> DataFrame:
    """One pass: vectors with their new clusters and bounds, or with exact distances if it is the last."""
    k, id_kind = len(step.centroids), rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, n = matrix(batch.column(1), dim, np.int64), batch.num_rows
            if first:
                own, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, k))
            else:
                own, upper, lower = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy(), matrix(batch.column(4), k)
            own, squared, upper, lower, _ = step.assign(v, own, upper, lower)
            if last:
                kept = np.flatnonzero(squared < 0)
                squared[kept] = squares(v[kept], step.centroids[own[kept]])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32()), pa.array(squared, pa.int64())], ["id", "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array(single_above(upper), pa.float32()), lists(single_below(lower), pa.float32())], ["id", "v", "cluster", "upper", "lower"])

    return rows.mapInArrow(run, f"id {id_kind}, cluster int, distance long" if last else f"id {id_kind}, v array<int>, cluster int, upper float, lower array<float>")


def means(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each cluster; clusters without vectors stay."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            v, own = matrix(batch.column(1), dim, np.int64), batch.column(0).to_numpy()
            for j in np.unique(own):
                mine = v[own == j]
                n[j] += len(mine)
                total[j] += mine.sum(0)
        had = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(had, pa.int32()), pa.array(n[had], pa.int64()), lists(total[had], pa.int64())], ["cluster", "n", "total"])

    parts = rows.select("cluster", "v").mapInArrow(run, "cluster int, n long, total array<long>").select("cluster", "n", F.posexplode("total").alias("at", "x"))
    out = centroids.copy()
    for r in parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        out[r.cluster, r["at"]] = int(r.x) // r.n
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance of every vector that counts; the final centroids)."""
    spark = vectors.sparkSession
    vectors_at, path = written(integer_vectors(vectors, id_col, vec_col, dim, scale), "vectors")
    now = first_centroids(vectors_at, k, seed)
    if not len(now):
        return vectors_at.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), now
    state, step = vectors_at, Step(now)
    for at in range(rounds):
        state, newer = written(assigned(state, step, dim, at == 0, False), "bounds")
        drop_path(spark, path)
        path, new = newer, means(state, now)
        now, step = new, Step(new, now)
    out, _ = written(assigned(state, step, dim, rounds == 0, True), "clusters")
    drop_path(spark, path)
    return out, now


def op11_elkan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(table(spark, sf_dir, "embeddings"))
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    most, whole = 2**63 - 1, sum(sums.values())
    per = [(j, min(most, sums.get(j, 0)), min(most, whole), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    told = spark.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return rows.join(F.broadcast(told), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(rounds: int = 3) -> str:
    parts = ["""kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS row FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             "c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS INTEGER) AS cluster, v FROM kept ORDER BY sha256('1:' || vec_id) NULLS LAST, v LIMIT 16)"]
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS (SELECT kept.row, kept.vec_id, kept.v, c{i}.cluster, CAST(list_sum(list_transform(range(1, 65), lambda i: (kept.v[i] - c{i}.v[i]) * (kept.v[i] - c{i}.v[i]))) AS BIGINT) AS distance FROM kept, c{i})""")
        parts.append(f"a{i} AS (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)")
        if i < rounds:
            parts.append(f"m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, 65)) AS i) GROUP BY cluster, i) GROUP BY cluster)")
            parts.append(f"c{i + 1} AS (SELECT c{i}.cluster, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (cluster))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, a.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster"""


ORACLE = _oracle()
