"""Embedding near-duplicates over hierarchical navigable small-world graphs, one a shard.

Equal vectors are one class first, with their number. Classes are dealt by hash to shards of bounded size; a task builds the
shard's graph in numpy, inserting small batches: a batch searches the layers that stand, is compared with itself, and links
to diverse near nodes, which link back. Every class queries every shard, in blocks: the queries of a block descend the layers in
lock step. The beam starts narrow, at every size of shard; a query whose links fill more than half of its beam gets one of twice the width, and so
does the whole block while an audit of some of its queries against all of the shard finds a link missing. Beams double until both
are content; one that has become as wide as the shard holds all of it, and is scored by matrix products. Candidates are confirmed
by cosine in double precision. A task passes on, for each query, the number of vectors that it links to, and of the links only a
spanning forest, from which components are found; links are folded into both as they are found, so a task never holds them all.
A graph travels as a row a node with its neighbour lists: no row grows with the shard. A class has a number of its own; its smallest id goes with it
and names components.

Defined cases: a vector that is null, empty, zero, or holds a null or non-finite number links with nothing and stays; so does a null
id, whose component is null; vectors of different lengths do not link; repeated rows, and rows that share an id, count as vectors of their own:
equal vectors link, vectors of one id do so only if they are near, and two components can then bear one name; an empty table gives no rows; other columns are left out. Ids are whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlane.operators.graph import components
from rasterlane.sources.shared import drop_path

from .common import table, written

BLOCK = 512  # queries in lock step
COMPONENTS = 2_000_000  # of vectors, or of a matrix of cosines, that are gathered at a time
LONG = 128  # components of a vector: of longer ones, fewer go to a shard or block
FOLD = 500_000  # links that a task holds before it folds them


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Graph:
    """Layers of neighbour lists, -1 where there is none; layer 0 has twice the links."""

    def __init__(self, x: np.ndarray, links: int = 12, beam: int = 48, batch: int = 256, seed: int = 23):
        self.x, self.links, self.beam = x.astype(np.float32), links, beam
        n = len(x)
        level = np.minimum((-np.log(np.random.default_rng(seed).uniform(1e-12, 1, n)) / math.log(links)).astype(int), 6)
        if n:
            level[0] = level.max()  # the entry point is on every layer
        self.layers = [np.full((n, links * (2 if i == 0 else 1)), -1, np.int32) for i in range(int(level.max(initial=0)) + 1)]
        for s in range(0, n, batch):
            new = np.arange(s, min(n, s + batch))
            for layer in range(len(self.layers) - 1, -1, -1):
                here = new[level[new] >= layer]
                if len(here):
                    self._insert(layer, here, s)

    def rows(self) -> tuple[list[bytes], list[bytes]]:
        """Of every node its neighbours on layer 0, and those on the layers above as far up as it has any."""
        top = np.zeros(len(self.x), int)
        for i, lists in enumerate(self.layers[1:], 1):
            top[(lists >= 0).any(1)] = i
        above = np.concatenate(self.layers[1:], 1) if len(self.layers) > 1 else None
        return [y.tobytes() for y in self.layers[0]], [above[i, : k * self.links].tobytes() if k else b"" for i, k in enumerate(top.tolist())]

    @classmethod
    def of_rows(cls, x: np.ndarray, near: list[bytes], above: list[bytes]) -> Graph:
        """The graph to search, of unit rows in the order of its nodes and what rows() gave of them."""
        g = cls.__new__(cls)
        g.x, g.layers = x.astype(np.float32), [np.frombuffer(b"".join(near), np.int32).reshape(len(x), -1)]
        links = g.layers[0].shape[1] // 2
        size = np.array([len(y) for y in above]) // (4 * links)
        for i in range(int(size.max(initial=0))):
            layer = np.full((len(x), links), -1, np.int32)
            has = np.flatnonzero(size > i)
            layer[has] = np.frombuffer(b"".join(above[j][4 * links * i : 4 * links * (i + 1)] for j in has.tolist()), np.int32).reshape(len(has), -1)
            g.layers.append(layer)
        return g

    def _insert(self, layer: int, new: np.ndarray, before: int) -> None:
        """new: nodes of this layer; nodes under `before` are in the graph."""
        q = self.x[new]
        near, sim = self.search(q, self.beam, down_to=layer) if before else (np.zeros((len(new), 0), np.int32), np.zeros((len(new), 0), np.float32))
        own = q @ q.T
        np.fill_diagonal(own, -2)
        k = min(self.beam // 2, len(new) - 1)
        if k > 0:
            at = np.argpartition(-own, k - 1, axis=1)[:, :k]
            near = np.concatenate([near, new[at]], 1)
            sim = np.concatenate([sim, np.take_along_axis(own, at, 1)], 1)
        if not near.shape[1]:
            return
        chosen = self._select(near, sim, self.links)
        self.layers[layer][new, : self.links] = chosen
        a, b = np.repeat(new, self.links), chosen.ravel()
        self._link_back(layer, b[b >= 0], a[b >= 0])

    def _select(self, near: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates those that are nearer to the row than to one chosen before; then the nearest others."""
        order = np.argsort(-np.where(near >= 0, sim, -3), axis=1, kind="stable")
        near, sim = np.take_along_axis(near, order, 1), np.take_along_axis(sim, order, 1)
        rows, c = near.shape
        v = self.x[np.maximum(near, 0)]
        between = v @ v.transpose(0, 2, 1)
        kept = np.zeros((rows, c), bool)
        for j in range(c):
            clash = (np.where(kept, between[:, j], -3).max(1) > sim[:, j]) if j else np.zeros(rows, bool)
            kept[:, j] = ~clash & (near[:, j] >= 0) & (kept.sum(1) < most)
        first = np.argsort(~kept, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(near, first, 1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out

    def _link_back(self, layer: int, to: np.ndarray, new: np.ndarray) -> None:
        lists = self.layers[layer]
        width = lists.shape[1]
        order = np.argsort(to, kind="stable")
        to, new = to[order], new[order]
        nodes, start, count = np.unique(to, return_index=True, return_counts=True)
        extra = np.full((len(nodes), int(count.max(initial=0))), -1, np.int32)
        extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(to)) - np.repeat(start, count)] = new
        for s in range(0, len(nodes), 256):
            some = nodes[s : s + 256]
            near = np.concatenate([lists[some], extra[s : s + 256]], 1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1  # already linked
            sim = np.einsum("qck,qk->qc", self.x[np.maximum(near, 0)], self.x[some])
            top = np.argsort(-np.where(near >= 0, sim, -3), axis=1, kind="stable")[:, : width + 40]
            lists[some] = self._select(np.take_along_axis(near, top, 1), np.take_along_axis(sim, top, 1), width)

    def search(self, q: np.ndarray, beam: int, down_to: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The beams of the queries on layer down_to: nodes (-1: none) and their cosines, best first."""
        q = q.astype(np.float32)
        near, sim = np.zeros((len(q), 1), np.int32), (q @ self.x[0])[:, None]
        for layer in range(len(self.layers) - 1, down_to - 1, -1):
            near, sim = self._walk(q, near, sim, self.layers[layer], beam if layer == down_to else 4)
        return near, sim

    def _walk(self, q, near, sim, lists, beam):
        n, at_once = len(q), max(4, beam // 16)  # nodes of a beam that are opened together
        pad = beam - near.shape[1]
        if pad > 0:
            near = np.pad(near, ((0, 0), (0, pad)), constant_values=-1)
            sim = np.pad(sim, ((0, 0), (0, pad)), constant_values=-3)
        near, sim = near[:, :beam].copy(), sim[:, :beam].copy()
        seen = np.zeros((n, len(self.x)), bool)
        r, c = np.nonzero(near >= 0)
        seen[r, near[r, c]] = True
        open_ = near >= 0
        live = np.arange(n)
        while len(live):
            first = np.argsort(~open_[live], axis=1, kind="stable")[:, :at_once]  # beams are in order: the best open ones
            valid = np.take_along_axis(open_[live], first, 1)
            go = np.where(valid, np.take_along_axis(near[live], first, 1), 0)
            open_[live[:, None], first] = False
            next_ = np.where(valid[:, :, None], lists[go], -1).reshape(len(live), -1)
            at = np.maximum(next_, 0)
            fresh = (next_ >= 0) & ~seen[live[:, None], at]
            r, c = np.nonzero(fresh)
            seen[live[r], at[r, c]] = True
            s = np.where(fresh, np.einsum("qck,qk->qc", self.x[at], q[live]), -3).astype(np.float32)
            # a node can stand in two of the lists at once: only its first place counts
            order = np.argsort(np.where(fresh, next_, -1), axis=1, kind="stable")
            ranked = np.take_along_axis(np.where(fresh, next_, -1), order, 1)
            twice = np.zeros_like(fresh)
            np.put_along_axis(twice, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
            s[twice & fresh] = -3
            all_near, all_sim = np.concatenate([near[live], next_], 1), np.concatenate([sim[live], s], 1)
            all_open = np.concatenate([open_[live], s > -3], 1)
            top = np.argsort(-all_sim, axis=1, kind="stable")[:, :beam]
            near[live], sim[live] = np.take_along_axis(all_near, top, 1), np.take_along_axis(all_sim, top, 1)
            near[live] = np.where(sim[live] > -3, near[live], -1)
            open_[live] = np.take_along_axis(all_open, top, 1) & (near[live] >= 0)
            live = live[open_[live].any(1)]
        return near, sim


def links_of(graph: Graph, exact: np.ndarray, q: np.ndarray, cut: float, beam: int = 32, audited: int = 64, seed: int = 1, own: np.ndarray | None = None, did: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) with cosine >= cut in double precision, some at a time; did: filled with what the search did. exact, q: unit
    rows. Beams widen as the module says. Of the queries of every block, `audited` are held against the whole shard at each width: those that come
    closest to a node, where links are likeliest, and as many by chance. own: the node that a query itself is (-1: none); it is
    found with ease, so audits leave it out. Of rows that need a wider beam no pairs are held."""
    n, rng = len(exact), np.random.default_rng(seed)
    own = np.full(len(q), -1) if own is None else own
    did = {} if did is None else did
    did.update({"searched": 0, "whole": 0, "audited_links": 0, "audit_found": 0, "widest": 0})
    slack = cut - 1e-4  # of cosines in single precision
    at_once, rows_at_once = max(1, COMPONENTS // q.shape[1]), max(1, COMPONENTS // max(n, 1))

    def confirmed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        parts = [np.einsum("ij,ij->i", q[a[i : i + at_once]], exact[b[i : i + at_once]]) >= cut for i in range(0, len(a), at_once)]
        return np.concatenate(parts) if parts else np.zeros(0, bool)

    def search(todo: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places in todo and nodes of the links of rows that are not full; which rows are full; the cosine of each row's nearest other node."""
        few = max(8, BLOCK * 32 // width)  # wide beams go in smaller groups, so that a group's memory stays as it is
        got = []
        for i in range(0, len(todo), few):
            rows = todo[i : i + few]
            near, sim = graph.search(q[rows], width)
            hit = (near >= 0) & (sim >= slack)
            full = hit.sum(1) > width // 2  # in a dense place more may lie beyond what the beam has come to
            a, c = np.nonzero(hit & ~full[:, None])
            b = near[a, c]
            ok = confirmed(rows[a], b)
            got.append(((a[ok] + i).astype(np.int32), b[ok], full, np.where(near == own[rows, None], -3, sim).max(1, initial=-3)))
        return tuple(np.concatenate(x) for x in zip(*got))

    for s in range(0, len(q), BLOCK):
        todo, width = np.arange(s, min(len(q), s + BLOCK)), beam
        while len(todo):
            if width >= n:  # the beam holds the shard
                for i in range(0, len(todo), rows_at_once):
                    a, b = np.nonzero(q[todo[i : i + rows_at_once]] @ exact.T >= cut)
                    yield todo[a + i], b
                did["whole"] += len(todo)
                break
            a, b, full, nearest = search(todo, width)
            did["searched"] += len(todo)
            did["widest"] = max(did["widest"], width)
            rest = np.flatnonzero(~full)
            close = rest[np.argsort(-nearest[rest], kind="stable")[: audited // 2]]
            some = np.union1d(close, rng.choice(rest, min(audited // 2, len(rest)), replace=False)) if len(rest) else rest
            want = np.zeros(len(some), np.int64)
            for i in range(0, len(some), rows_at_once):
                rows = todo[some[i : i + rows_at_once]]
                all_links = q[rows] @ exact.T >= cut
                self_ = np.flatnonzero(own[rows] >= 0)
                all_links[self_, own[rows[self_]]] = False
                want[i : i + rows_at_once] = all_links.sum(1)
            got = np.bincount(a[b != own[todo[a]]], minlength=len(todo))[some]
            did["audited_links"] += int(want.sum())
            did["audit_found"] += int(got.sum())
            width *= 2
            if (got < want).any():
                continue  # the audit failed: all of the block once more, with a wider beam
            yield todo[a], b
            todo = todo[full]


def linked(*args, **more) -> tuple[np.ndarray, np.ndarray, dict]:
    """All pairs of links_of at once, and what the search did."""
    did: dict = {}
    out = list(links_of(*args, **more, did=did))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *[a for a, _ in out]]), np.concatenate([none, *[b for _, b in out]]), did


def folded(pairs: Iterator[tuple[np.ndarray, np.ndarray]], mine: np.ndarray, node: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (place in mine, place in node), but those of a class with itself: the vectors that each of mine links to, and a forest (class, smaller class) of the links."""
    links, u, v = np.zeros(len(mine), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, some = 0, []

    def fold() -> tuple[np.ndarray, np.ndarray]:
        return forest(np.concatenate([u, *[mine[a] for a, _ in some]]), np.concatenate([v, *[node[b] for _, b in some]]))

    for a, b in pairs:
        other = mine[a] != node[b]
        a, b = a[other].astype(np.int32), b[other].astype(np.int32)
        links += np.bincount(a, times[b], minlength=len(mine)).astype(np.int64)
        some.append((a, b))
        held += len(a)
        if held > FOLD:
            u, v = fold()
            held, some = 0, []
    u, v = fold()
    return links, u, v


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length, a row each."""
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks]).reshape(len(column), -1)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, smaller id) that join the same ids as the links (a, b)."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(ids))
    while True:
        m = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, x, m)
        np.minimum.at(new, y, m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    more = low < np.arange(len(ids))
    return ids[more], ids[low[more]]


def near_duplicates(vectors: DataFrame, cut: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", least_shards: int = 6, shard_rows: int = 50_000, block_rows: int = 16_384) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"  # floats travel as they are, and are made double in tasks
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull()
    classes, _ = written(rows.where(fine).groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("times")).withColumns({"dim": F.size("v"), "node": F.monotonically_increasing_id()}), "classes")
    size = classes.agg(F.count("*").alias("n"), F.coalesce(F.sum("dim"), F.lit(0)).alias("components")).first()
    n = max(size.n, size.components // LONG)
    shards, parts = max(least_shards, math.ceil(n / shard_rows)), max(1, math.ceil(n / block_rows))
    members = classes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))

    def build(t: pa.Table) -> pa.Table:
        near, above = Graph(unit(_matrix(t.column("v")))).rows()
        return pa.table({**{k: t.column(k) for k in ("dim", "shard", "id", "node", "times", "v")}, "place": pa.array(np.arange(len(near)), pa.int32()), "near": pa.array(near, pa.binary()), "above": pa.array(above, pa.binary())})

    built, graphs = written(members.groupBy("dim", "shard").applyInArrow(build, f"dim int, shard int, id long, node long, times long, v {kind}, place int, near binary, above binary"), "graphs")
    numbers = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = built.withColumn("part", numbers(parts))
    right = classes.withColumns({"part": F.pmod(F.xxhash64("node", F.lit("part")), F.lit(parts)).cast("int")}).withColumn("shard", numbers(shards))

    def query(shard: pa.Table, part: pa.Table) -> pa.Table:
        kinds = {k: pa.int64() for k in ("node", "id", "links", "v", "v_id")}
        if not shard.num_rows or not part.num_rows:
            return pa.table({k: pa.array([], x) for k, x in kinds.items()})
        places = np.argsort(shard.column("place").to_numpy())
        node, ids, times = (shard.column(k).to_numpy()[places] for k in ("node", "id", "times"))
        exact = unit(_matrix(shard.column("v"))[places])
        near, above = (shard.column(k).to_pylist() for k in ("near", "above"))
        g = Graph.of_rows(exact, [near[i] for i in places], [above[i] for i in places])
        del near, above
        mine = part.column("node").to_numpy()
        order = np.argsort(node)
        at = order[np.minimum(np.searchsorted(node, mine, sorter=order), len(node) - 1)]
        links, u, v = folded(links_of(g, exact, unit(_matrix(part.column("v"))), cut, own=np.where(node[at] == mine, at, -1)), mine, node, times)
        known, first = np.unique(np.concatenate([mine, node]), return_index=True)
        id_of = lambda x: np.concatenate([part.column("id").to_numpy(), ids])[first[np.searchsorted(known, x)]]
        counted = np.flatnonzero(links > 0)
        none, heads = [None] * len(counted), np.concatenate([mine[counted], u])
        cols = {"node": heads, "id": id_of(heads), "links": np.concatenate([links[counted], np.zeros(len(u), np.int64)]), "v": none + v.tolist(), "v_id": none + id_of(v).tolist()}
        return pa.table({k: pa.array(cols[k], x) for k, x in kinds.items()})

    keys = ["dim", "shard", "part"]
    found, _ = written(left.groupBy(*keys).cogroup(right.select(*keys, "node", "id", "v").groupBy(*keys)).applyInArrow(query, "node long, id long, links long, v long, v_id long"), "found")
    drop_path(vectors.sparkSession, graphs)
    counts = found.where(F.col("v").isNull()).groupBy("node").agg(F.sum("links").alias("links"))
    named = components(found.where(F.col("v").isNotNull()).select(F.struct("id", "node").alias("u"), F.struct(F.col("v_id").alias("id"), F.col("v").alias("node")).alias("v")))
    labels = named.select("node.node", F.col("label.id").alias("label"))
    told = classes.join(counts, "node", "left").join(labels, "node", "left").select("v", "times", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "id").alias("label"))
    out = rows.join(told, "v", "left")
    own = F.coalesce("label", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce(F.col("links") + F.col("times") - 1, F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
k AS (SELECT a.vec_id AS u, b.vec_id AS w FROM g a JOIN g b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT r.node, k.w FROM r JOIN k ON r.seen = k.u),
m AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
l AS (SELECT u, count(*) AS n FROM k GROUP BY u)
SELECT v.vec_id, coalesce(l.n, 0) AS n_links, m.component_id, v.vec_id = m.component_id AS kept FROM v JOIN m ON m.node = v.vec_id LEFT JOIN l ON l.u = v.vec_id
"""
