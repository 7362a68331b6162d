"""MinHash near-duplicates with circulant permutations.

A document's set holds its distinct shingles of `k` words (fewer words make one shingle). Circulant MinHash: one permutation scatters
the set, a second, shifted by 0, 1, 2, ... places, gives all coordinates of the signature, each the smallest value over the set.
Bands of the signature deal documents into buckets; links are confirmed on the full sets by exact counts.

No bucket is paired with itself as a whole. Equal sets are one node first. Then each node of a bucket is held against the
bucket's pivot alone, in the first bands and then, where the two are still apart, in all; components are found after each.
Nodes that still share a bucket with another component are gathered around the bucket's largest one and finished pair by pair
across components: small clusters directly, large ones in blocks of bounded size, where only pairs whose set sizes rule a link out
are left uncounted. So banding alone can miss a link, at the threshold itself with a probability of `miss` at most. Pairs of large
clusters are counted on 64-bit hashes of the shingles, all others on the words.

Defined cases: null, empty and wordless texts have no shingles, link with nothing and stay; a null id links with nothing, its
component is null and it stays; rows repeated in full are one node; rows that share an id but not a text are nodes of their own,
which meet under the id; ids are whole numbers; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlane.operators.graph import components

from .common import blocks, bound_batches, drop_path, table, utf8_list, written

UNIVERSE = 1 << 20
FIRST_BANDS = 5
SMALL = 24
BLOCK = 256
REMEMBERED = 100_000  # word hashes a worker remembers
MOST_BYTES = 2_000_000  # of text at once in a task


def banding(threshold: float, miss: float = 1e-5, most_bands: int = 32) -> tuple[int, int]:
    """Bands and rows a band: as many rows as keep the miss at the threshold under `miss`."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(miss) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands <= most_bands:
            return bands, rows
    return most_bands, 1


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


class Circulant:
    """The two permutations and the signatures they give."""

    def __init__(self, bands: int, rows: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.n = bands, rows, bands * rows
        self.scatter = rng.permutation(UNIVERSE).astype(np.int32)
        second = rng.permutation(UNIVERSE).astype(np.uint32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: self.n]]), self.n)
        self.mix = rng.integers(1, 2**63, rows).astype(np.uint64) | np.uint64(1)
        self.words = _Words()

    def shingles(self, text: bytes | None, k: int) -> np.ndarray:
        """Distinct 64-bit hashes of the shingles, in order of value."""
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        of = self.words
        w = np.fromiter([of[x] for x in words], np.uint64, len(words))
        k = min(k, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = (h ^ w[i : len(w) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return np.unique(h)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = self.scatter[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)]
        out = self.shifted[at[:2048]].min(0)
        for i in range(2048, len(at), 2048):
            np.minimum(out, self.shifted[at[i : i + 2048]].min(0), out=out)
        return out

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        h = (signature.reshape(self.bands, self.rows).astype(np.uint64) * self.mix).sum(1, dtype=np.uint64)
        h ^= h >> np.uint64(31)
        return (h * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


@lru_cache(maxsize=2)
def circulant(bands: int, rows: int) -> Circulant:
    return Circulant(bands, rows)


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """docs: id, text. id, n_shingles, set_key (null for an empty set), keys array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = circulant(bands, rows)
        for batch in (part for whole in batches for part in blocks(whole, "text", MOST_BYTES)):
            n, key, keys = [], [], []
            for text in utf8_list(batch.column(1)):
                s = c.shingles(text, k)
                n.append(len(s))
                if len(s):
                    key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    keys.append(c.band_keys(c.signature(s)))
                else:
                    key.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n_shingles", "set_key", "keys"])

    return docs.mapInArrow(run, "id long, n_shingles long, set_key binary, keys array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """pairs: u, v of which den * intersection >= num * union, counted on the full sets. texts: id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shingles(text: bytes) -> frozenset:
            words = text.lower().split()
            return frozenset(zip(*[words[i:] for i in range(min(k, len(words)))]))

        last, mine = None, frozenset()
        for batch in (part for whole in batches for part in blocks(whole, "vt", MOST_BYTES)):
            ok = []
            v_texts = utf8_list(batch.column(3))
            for i, (t, other) in enumerate(zip(utf8_list(batch.column(2)), v_texts)):
                if t != last:
                    last, mine = t, shingles(t or b"")
                o = shingles(other or b"")
                both = len(mine & o)
                if both and den * both >= num * (len(mine) + len(o) - both):
                    ok.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok, pa.int64())), batch.column(1).take(pa.array(ok, pa.int64()))], ["u", "v"])

    first = texts.select(F.col("id").alias("u"), F.col("text").alias("ut"))
    second = texts.select(F.col("id").alias("v"), F.col("text").alias("vt"))
    return pairs.join(first, "u").join(second, "v").select("u", "v", "ut", "vt").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; documents are linked with Jaccard similarity >= num / den."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    bands, per = banding(num / den)
    signed, _ = written(signatures(rows, k, bands, per), "signed")
    usable = signed.where(F.col("set_key").isNotNull() & F.col("id").isNotNull())
    nodes = usable.groupBy("set_key").agg(F.min("id").alias("node"))
    # one row a set: of the rows that have the smallest id, any
    full = usable.join(nodes.select("set_key", F.col("node").alias("id")), ["set_key", "id"]).select("id", "set_key", "keys").dropDuplicates(["set_key"])
    # two orders of nodes, by bands, so that a dense group has several pivots
    order = F.when(F.col("band") % 2 == 0, F.col("node")).otherwise(F.bitwise_not(F.col("node")))
    dealt = full.select(F.col("id").alias("node"), F.posexplode("keys").alias("band", "key")).withColumn("place", order)
    shared = dealt.groupBy("band", "key").agg(F.min("place").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    shared = shared.withColumn("pivot", F.when(F.col("band") % 2 == 0, F.col("pivot")).otherwise(F.bitwise_not("pivot")))
    dealt, dealt_at = written(dealt.join(shared, ["band", "key"]).select("band", "key", "node", "pivot", "size"), "dealt")
    involved = dealt.select("node").distinct()
    texts, texts_at = written(rows.join(involved.select(F.col("node").alias("id")), "id", "left_semi").dropDuplicates(["id", "text"]), "texts")

    def confirm(pairs: DataFrame) -> DataFrame:
        return confirmed(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), texts, k, num, den)

    def labelled(frame: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
        got = frame.join(labels.select(F.col("node").alias(column), F.col("label").alias(name)), column, "left")
        return got.withColumn(name, F.coalesce(name, column))

    links = confirm(dealt.where(F.col("band") < FIRST_BANDS).select(F.col("node").alias("u"), F.col("pivot").alias("v")))
    labels = components(links)
    apart = labelled(labelled(dealt.where(F.col("band") >= FIRST_BANDS).select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct(), labels, "u", "lu"), labels, "v", "lv").where("lu <> lv")
    labels = components(confirm(apart.select("u", "v")).unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v"))))
    # what is left: buckets with several components. Nodes that share one form the cluster of the bucket's largest component
    told = labelled(dealt, labels, "node", "label")
    parts = told.groupBy("band", "key", "label").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("band", "key").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    left = told.join(mixed, ["band", "key"]).select(F.col("top.label").alias("cluster"), "label", "node").distinct()
    left, left_at = written(left, "left")
    # a table of its own, so that both sides of the join are plain exchanges: Spark can then split a large cluster's partition
    sizes, sized_at = written(left.groupBy("cluster").agg(F.count("*").alias("size")), "sizes")
    left = left.join(sizes, "cluster")
    found = confirm(_small_clusters(left).distinct()).unionByName(_large_clusters(left, texts, k, num, den, bands, per))
    labels = components(found.unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v"))))
    for path in (dealt_at, texts_at, left_at, sized_at):  # components() has written what it was given
        drop_path(docs.sparkSession, path)
    groups = labelled(nodes, labels, "node", "component_id").select("set_key", "component_id")
    out = signed.select("id", "n_shingles", "set_key").join(groups, "set_key", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


def _small_clusters(left: DataFrame) -> DataFrame:
    """Pairs across components in clusters of SMALL nodes at most."""
    few = left.where(F.col("size") <= SMALL).groupBy("cluster").agg(F.collect_list(F.struct("node", "label")).alias("all"))
    pair = few.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a.label < b.label")
    return pair.select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))


def _large_clusters(left: DataFrame, texts: DataFrame, k: int, num: int, den: int, bands: int, rows: int) -> DataFrame:
    """Links across components in larger ones, block against block: all pairs whose set sizes allow a link and that are still
    apart are counted on the full sets inside the task, so that only links leave it."""
    many = left.where(F.col("size") > SMALL).withColumn("n", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("i", F.pmod(F.hash("node"), F.col("n")))
    many = many.join(texts.select(F.col("id").alias("node"), "text"), "node")
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o")
    many = many.select("cluster", "node", "label", "text", "i", other).select("cluster", "node", "label", "text", "i", F.least("i", "o").alias("x"), F.greatest("i", "o").alias("y"))

    def run(t: pa.Table) -> pa.Table:
        node, label, i, x, y = (t.column(c).to_numpy() for c in ("node", "label", "i", "x", "y"))
        c = circulant(bands, rows)
        full = [c.shingles(text, k) for text in utf8_list(t.column("text"))]
        n = np.array([len(s) for s in full])
        at = np.concatenate(([0], np.cumsum(n)))
        full = np.concatenate(full)
        distinct = np.unique(full)
        full = np.searchsorted(distinct, full).astype(np.int32)
        has = np.zeros(len(distinct), bool)  # the shingles of the row at hand
        hub = {v: v for v in label.tolist()}

        def find(v: int) -> int:
            while hub[v] != v:
                hub[v] = v = hub[hub[v]]
            return v

        a, b = np.flatnonzero(i == x), np.flatnonzero(i == y)
        us, vs = [], []
        for r in a.tolist():
            some = b[label[b] > label[r]] if x[0] == y[0] else b[label[b] != label[r]]
            some = some[(den * np.minimum(n[some], n[r]) >= num * np.maximum(n[some], n[r]))]
            mine = full[at[r] : at[r + 1]]
            has[mine] = True
            for o in some.tolist():
                p, q = find(int(label[r])), find(int(label[o]))
                if p != q:
                    both = int(np.count_nonzero(has[full[at[o] : at[o + 1]]]))
                    if den * both >= num * (n[r] + n[o] - both):
                        hub[p] = q
                        us.append(int(node[r]))
                        vs.append(int(node[o]))
            has[mine] = False
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return many.groupBy("cluster", "x", "y").applyInArrow(run, "u long, v long")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[i : i + 2], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM w UNION SELECT r.node, e.v FROM r JOIN e ON r.seen = e.u),
m AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept
FROM w JOIN m ON m.node = w.doc_id LEFT JOIN n USING (doc_id)
"""
