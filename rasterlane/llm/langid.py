"""Language identification by a byte convolutional network, trained in numpy.

A text becomes windows of a fixed number of bytes; each byte is embedded, filters of several widths slide over the window, the
largest response of each filter is kept, and a softmax layer gives the languages. A document's score is the mean of its
windows' probabilities, weighted by their bytes: every byte of every text is read. For prediction a filter's weights are folded
with the embedding into tables by byte pair, so that a width costs two look-ups a position.

Training takes at most `docs_per_lang` labelled documents of each language (a bounded, documented sample, chosen by a hash of
the id among all that may be learned from) and `windows_per_doc` windows of each.

Defined cases: a text that is null, or holds no letter, is `und` with score 0; without any labelled text all are
`und`; labels that are null teach nothing; repeated rows are each predicted; other columns pass through `keep`; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bound_batches, crc_mod, table, utf8_list

WINDOW = 256  # bytes
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
EMBED = 8
MOST_BYTES = 2_000_000  # of text at once in a task


class ByteCNN:
    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        norm = lambda *shape, fan: (rng.standard_normal(shape) / np.sqrt(fan)).astype(np.float32)
        self.p = {"E": norm(256, EMBED, fan=1), "D": norm(len(WIDTHS) * FILTERS, len(langs), fan=len(WIDTHS) * FILTERS), "d": np.zeros(len(langs), np.float32)}
        for w in WIDTHS:
            self.p[f"W{w}"] = norm(w * EMBED, FILTERS, fan=w * EMBED)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)

    def _forward(self, x: np.ndarray):
        """x: windows of bytes. Pooled responses before the rectifier, their positions, log-free softmax."""
        e = self.p["E"][x]
        pooled, where = [], []
        for w in WIDTHS:
            cols = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, w * EMBED)
            r = cols @ self.p[f"W{w}"] + self.p[f"b{w}"]
            at = r.argmax(1)
            pooled.append(np.take_along_axis(r, at[:, None], 1)[:, 0])
            where.append((cols, at))
        h = np.concatenate(pooled, 1)
        z = np.maximum(h, 0) @ self.p["D"] + self.p["d"]
        z = np.exp(z - z.max(1, keepdims=True))
        return h, where, z / z.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 3e-3, seed: int = 11) -> ByteCNN:
        """Adam on the cross entropy. A gradient passes only where the pooling took its largest response."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(x), batch):
                i = order[s : s + batch]
                h, where, prob = self._forward(x[i])
                dz = prob.copy()
                dz[np.arange(len(i)), y[i]] -= 1
                dz /= len(i)
                g = {"D": np.maximum(h, 0).T @ dz, "d": dz.sum(0), "E": np.zeros_like(self.p["E"])}
                dh = (dz @ self.p["D"].T) * (h > 0)
                for k, (w, (cols, at)) in enumerate(zip(WIDTHS, where)):
                    dr = dh[:, k * FILTERS : (k + 1) * FILTERS]
                    taken = cols[np.arange(len(i))[:, None], at]  # windows x filters x (w * EMBED)
                    g[f"W{w}"] = np.einsum("nf,nfc->cf", dr, taken)
                    g[f"b{w}"] = dr.sum(0)
                    de = np.einsum("nf,cf->nfc", dr, self.p[f"W{w}"]).reshape(len(i), FILTERS, w, EMBED)
                    for j in range(w):
                        np.add.at(g["E"], x[i][np.arange(len(i))[:, None], at + j].ravel(), de[:, :, j].reshape(-1, EMBED))
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> list[tuple[int, np.ndarray, np.ndarray | None]]:
        """For each width: responses by the first byte pair, bias included, and by the byte or pair after it."""
        out = []
        for w in WIDTHS:
            per = self.p["E"] @ self.p[f"W{w}"].reshape(w, EMBED, FILTERS)  # w x 256 x filters
            first = (per[0][:, None] + per[1][None] + self.p[f"b{w}"]).reshape(65536, FILTERS)
            second = per[2] if w == 3 else (per[2][:, None] + per[3][None]).reshape(65536, FILTERS) if w == 4 else None
            out.append((w, first.astype(np.float32), None if second is None else second.astype(np.float32)))
        return out


class Predictor:
    """Applies a network to batches of texts."""

    def __init__(self, net: ByteCNN):
        self.langs, self.tables, self.D, self.d = net.langs, net.tables(), net.p["D"], net.p["d"]

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities, a row per text; texts must not be empty."""
        n = [-(-len(t) // WINDOW) for t in texts]
        x = np.frombuffer(b"".join([t + b"\0" * (k * WINDOW - len(t)) for t, k in zip(texts, n)]), np.uint8).reshape(-1, WINDOW)
        prob = np.concatenate([self._windows(x[i : i + 256]) for i in range(0, len(x), 256)])
        weight = np.full(len(x), float(WINDOW))
        ends = np.cumsum(n)
        weight[ends - 1] = [len(t) - (k - 1) * WINDOW for t, k in zip(texts, n)]
        sums = np.add.reduceat(prob * weight[:, None], ends - n, axis=0)
        return sums / sums.sum(1, keepdims=True)

    def _windows(self, x: np.ndarray) -> np.ndarray:
        pairs = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        h = []
        for w, first, second in self.tables:
            k = WINDOW - w + 1
            r = np.take(first, pairs[:, :k], axis=0)
            if second is not None:
                r += np.take(second, x[:, 2:] if w == 3 else pairs[:, 2:], axis=0)
            h.append(r.max(1))
        z = np.maximum(np.concatenate(h, 1), 0) @ self.D + self.d
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def windows_of(text: bytes, most: int, rng: np.random.Generator) -> list[bytes]:
    n = -(-len(text) // WINDOW)
    some = range(n) if n <= most else sorted(rng.choice(n, most, replace=False).tolist())
    return [text[i * WINDOW : (i + 1) * WINDOW].ljust(WINDOW, b"\0") for i in some]


def train(docs: DataFrame, may_learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          docs_per_lang: int = 300, windows_per_doc: int = 8, epochs: int = 8, most_langs: int = 500) -> ByteCNN | None:
    """Fits on the bounded sample. The sample's share of each language is set by the language's count, over all rows; rows that
    share an id and a language count once in it. More than most_langs languages are an error."""
    spread = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit("langid")), 11)  # 53 bits
    rows = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), spread.alias("h"))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(most_langs + 1).collect()}
    if not counts:
        return None
    if len(counts) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    langs = sorted(counts)
    shares = docs.sparkSession.createDataFrame([(x, 2.0**53 * min(1.0, 1.3 * docs_per_lang / n)) for x, n in counts.items()], "lang string, below double")  # most_langs rows
    near = rows.where(F.col("text") != "").join(F.broadcast(shares), "lang").where(F.col("h") < F.col("below")).select("lang", "text", "h")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blocks(whole, "text", MOST_BYTES)):
            own = [windows_of(t, windows_per_doc, np.random.default_rng(h)) for t, h in zip(utf8_list(batch.column(1)), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(own, pa.list_(pa.binary()))], ["lang", "h", "windows"])

    # tasks pick the windows: of a text of any length, windows_per_doc come to the driver at most
    picked = near.mapInArrow(cut, "lang string, h long, windows array<binary>").groupBy("lang", "h").agg(F.min("windows").alias("windows"))
    x, y, seen = [], [], dict.fromkeys(langs, 0)
    for r in picked.orderBy("h", "lang").collect():
        if seen[r.lang] < docs_per_lang:
            seen[r.lang] += 1
            x += r.windows
            y += [langs.index(r.lang)] * len(r.windows)
    return ByteCNN(langs).fit(np.frombuffer(b"".join(x), np.uint8).reshape(-1, WINDOW), np.array(y), epochs) if x else None


def predict(docs: DataFrame, net: ByteCNN | None, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep`, the language (string) and its score (double) under `names`, which must not be among them."""
    bound_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_li_text"), F.coalesce(F.regexp_like(F.col(text_col), F.lit(r"\p{L}")), F.lit(False)).alias("_li_letter"))
    sent = docs.sparkSession.sparkContext.broadcast(net and Predictor(net))
    schema = docs.select(*keep).withColumns({names[0]: F.lit("und"), names[1]: F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in (part for whole in batches for part in blocks(whole, "_li_text", MOST_BYTES)):
            k = batch.num_columns - 2
            texts = utf8_list(batch.column(k))
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            some = [i for i, ok in enumerate(batch.column(k + 1).to_pylist()) if ok and net]
            if some:
                prob = net([texts[i] for i in some])
                for i, best, p in zip(some, prob.argmax(1).tolist(), prob.max(1).tolist()):
                    lang[i], score[i] = net.langs[best], min(1.0, p)
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[:k], *names])

    return rows.mapInArrow(run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    net = train(docs, F.coalesce(~held_out, F.lit(False)))
    return predict(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")), net, ["doc_id", "held_out"])
