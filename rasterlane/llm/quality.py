"""Quality classification by histogram gradient-boosted trees over document statistics.

Statistics of whole texts are counted with numpy on the batch's bytes (classes of bytes, words and lines, repetition). Trees grow
on histograms of binned statistics, depth by depth; the fitted trees are flattened into arrays (feature, threshold, children as
2i+1 and 2i+2, leaf values) and traversed for a whole batch at once.

Training takes at most `most_rows` labelled documents (a bounded, documented sample by a hash of the id, out of all that may be
learned from). Labels join by id; an id with several labels counts once, as good only if all of them say so.

Defined cases: a null or empty text has all statistics 0 and is scored like any; without labelled rows, or with one class alone,
the score is the share of good labels (0.5 without any); null labels teach nothing; repeated rows are each scored; other
columns pass through `keep`; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bound_batches, crc_mod, table, utf8_list

MOST_BYTES = 2_000_000
FEATURES = ["bytes", "words", "lines", "word_len", "longest_word", "upper", "digit", "punct", "symbol", "space", "high", "comma", "period", "pipe", "hash", "sentence_len", "distinct_words", "top_word", "distinct_lines", "dup_line_share", "caps_words", "vowel", "short_words", "long_words", "line_len", "distinct_first", "pair_repeat"]
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~", b" \t\n\r\x0b\x0c", bytes(range(128, 256)), b",", b".!?", b"|", b"#", b"aeiouAEIOU"]
_IS = np.zeros((len(_CLASSES), 256), np.float32)
for _i, _c in enumerate(_CLASSES):
    _IS[_i, list(_c)] = 1


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)), np.float32)
    for row, t in zip(out, texts):
        if not t:
            continue
        n = len(t)
        share = _IS @ np.bincount(np.frombuffer(t, np.uint8), minlength=256).astype(np.float32)
        words = t.lower().split()
        k = max(1, len(words))
        counts = Counter(words)
        sizes = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
        lines = [x for x in t.split(b"\n") if x.strip()]
        once = Counter(lines)
        upper, digit, punct, symbol, space, high, comma, period, pipe, hashes, vowel = (share / n).tolist()
        row[:] = (
            np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), sizes.mean(), np.log1p(sizes.max()), upper, digit, punct, symbol, space, high, comma, period, pipe, hashes,
            min(200.0, k / max(1.0, share[7])), len(counts) / k, max(counts.values(), default=0) / k, len(once) / max(1, len(lines)),
            sum(len(x) * c for x, c in once.items() if c > 1) / n, share[0] / k, vowel, float((sizes <= 3).mean()), float((sizes >= 12).mean()), np.log1p(n / max(1, len(lines))),
            len({w[:2] for w in counts}) / max(1, len(counts)), 1 - len(set(zip(words, words[1:]))) / k if len(words) > 1 else 0.0,
        )
    return out


class BoostedTrees:
    """Binary logistic boosting; every tree has `depth` levels, splits stored level by level."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, least: float = 4.0, ridge: float = 2.0):
        self.n_trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.base = 0.0
        self.feature = np.zeros((0, 2**depth - 1), np.int32)
        self.threshold = np.zeros((0, 2**depth - 1), np.float32)
        self.leaf = np.zeros((0, 2**depth), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = y.mean() if len(y) else 0.5
        self.base = float(np.log(max(p, 1e-4) / max(1 - p, 1e-4)))
        if len(y) < 2 or p in (0, 1):
            return self
        n, f = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1]).astype(np.float32)) for j in range(f)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)  # bin b: over edge b-1
        flat = binned + np.arange(f) * self.bins
        raw = np.full(n, self.base)
        inner = 2**self.depth - 1
        features, thresholds, leaves = [], [], []
        for _ in range(self.n_trees):
            prob = 1 / (1 + np.exp(-raw))
            g, h = prob - y, prob * (1 - prob)
            feature, threshold = np.zeros(inner, np.int32), np.full(inner, np.inf, np.float32)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                nodes = 2**level
                at = ((node - (nodes - 1))[:, None] * (f * self.bins) + flat).ravel()
                hist = [np.bincount(at, np.repeat(v, f), minlength=nodes * f * self.bins).reshape(nodes, f, self.bins) for v in (g, h)]
                gl, hl = (v.cumsum(2)[:, :, :-1] for v in hist)
                gt, ht = (v.sum(2, keepdims=True) for v in hist)
                gr, hr = gt - gl, ht - hl
                gain = gl**2 / (hl + self.ridge) + gr**2 / (hr + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hl < self.least) | (hr < self.least)] = 0
                best = gain.reshape(nodes, -1).argmax(1)
                for i in range(nodes):
                    j, b = divmod(int(best[i]), self.bins - 1)
                    if gain[i, j, b] > 1e-6 and b < len(edges[j]):
                        feature[nodes - 1 + i], threshold[nodes - 1 + i] = j, edges[j][b]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
            leaf_of = node - inner
            value = -self.rate * np.bincount(leaf_of, g, minlength=inner + 1) / (np.bincount(leaf_of, h, minlength=inner + 1) + self.ridge)
            raw += value[leaf_of]
            features.append(feature)
            thresholds.append(threshold)
            leaves.append(value.astype(np.float32))
        self.feature, self.threshold, self.leaf = np.stack(features), np.stack(thresholds), np.stack(leaves)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            raw += leaf[node - inner]
        return 1 / (1 + np.exp(-raw))


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", most_rows: int = 6000) -> BoostedTrees:
    """may_learn: a condition on id_col of the labels."""
    known = labels.where(may_learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_q_id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    known = known.withColumn("_q_h", F.xxhash64(F.col("_q_id"), F.lit("quality"))).orderBy("_q_h", "_q_id").limit(most_rows)  # its bound lets it be broadcast
    rows = docs.select(F.col(id_col).alias("_q_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "_q_id").select("_q_id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blocks(whole, "text", MOST_BYTES)):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(statistics(utf8_list(batch.column(1)))), pa.list_(pa.float32()))], ["_q_id", "y", "x"])

    kind = rows.schema["_q_id"].dataType.simpleString()
    # rows that share an id count once, so most_rows come back at most
    got = rows.mapInArrow(run, f"_q_id {kind}, y int, x array<float>").groupBy("_q_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).orderBy("_q_id").toPandas()
    x = np.array(got["x"].tolist(), np.float32).reshape(-1, len(FEATURES))
    return BoostedTrees().fit(x, got["y"].to_numpy(np.float64))


def predict(docs: DataFrame, trees: BoostedTrees, keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns `keep` and the score (double) under `name`, which must not be among them."""
    bound_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_q_text"))
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blocks(whole, "_q_text", MOST_BYTES)):
            k = batch.num_columns - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(sent.value.score(statistics(utf8_list(batch.column(k)))), pa.float64())], [*batch.schema.names[:k], name])

    return rows.mapInArrow(run, docs.select(*keep).withColumn(name, F.lit(0.0)).schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    trees = train(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = predict(docs.select("doc_id", "text", held_out.alias("held_out")), trees, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
