"""Language-model scoring with a hidden Markov model over the corpus' words.

Words are counted over the whole training part. The most frequent, `top_words` at most, are symbols of their own; every other word stands
for one of `rare_classes` classes, by a hash of its last three bytes, and within a class has the probability
(count + 1) / (class total + class words + 1), the one more being all words never seen. So P(text) = P(symbols) x product of
P(word | class) is a probability over texts. Counts of rare words are joined by word, in a shuffle, with each document's distinct ones; words
never seen in training have no count and add nothing there. Frequent ones are bounded by `top_words` and sent to all tasks.

Training: stepwise Baum-Welch (Cappe and Moulines 2009; Liang and Klein 2009), the same at every size. Training rows are dealt by
a hash of the id to `slices` slices. A step runs the forward-backward recursion over every row of a slice; expected counts are summed
by symbol across partitions, and what is one number per symbol and state comes back to the driver, where it is weighed into the
running counts, and the parameters are renewed. After `passes` passes over all slices a last round takes the counts of all
training rows at once. So every row is worked on passes + 1 times, while the parameters are renewed passes * slices + 1 times.
Training runs in single precision. Scoring: the scaled forward recursion in double precision, exact for texts of any length;
documents of a batch advance together, longest first.

Defined cases: null and empty texts are the end token alone; repeated rows are scored each; a null id counts as training; without
training rows every base score is 0 and the model is its untrained prior; an empty table gives no rows; other columns are left
out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bound_batches, crc_mod, table, utf8_list, written

STATES = 8
FLUSH = 100_000  # distinct words a task holds before it passes their counts on
BATCH_TOKENS = 400_000
GROUP_BYTES = 8 << 20  # of a row group: rows are in the order of slices, so that a step skips most groups of the others
BLOCK_BYTES = 2_000_000  # text that a task encodes at a time


@dataclass
class HMM:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states: P(symbol | state)


def first_guess(unigram: np.ndarray, states: int = STATES, seed: int = 3) -> HMM:
    rng = np.random.default_rng(seed)
    emit = (unigram / unigram.sum())[:, None] * rng.uniform(0.2, 1.8, (len(unigram), states))
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    return HMM(np.full(states, 1 / states), move, emit / emit.sum(0))


class _Batch:
    """Sequences laid out by time step: those that still run at step t stand at off[t] ... off[t + 1], longest first."""

    def __init__(self, seqs: list[np.ndarray]):
        n = np.array([len(s) for s in seqs])
        self.order = np.argsort(-n, kind="stable")
        n = n[self.order]
        steps = int(n[0]) if len(n) else 0
        self.alive = np.searchsorted(-n, -np.arange(steps), side="left")  # sequences longer than t
        self.off = np.concatenate(([0], np.cumsum(self.alive)))
        flat = np.concatenate([seqs[i] for i in self.order]) if seqs else np.zeros(0, np.uint16)
        t = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        doc = np.repeat(np.arange(len(n)), n)
        place = self.off[t] + doc
        self.symbols, self.doc = np.empty(len(flat), np.int64), np.empty(len(flat), np.int64)
        self.symbols[place], self.doc[place] = flat, doc

    def forward(self, m: HMM, kind=np.float64, keep: bool = False):
        """Scales by place; with keep the emissions and the scaled forward values by place as well."""
        emit, move, ones = m.emit.astype(kind), m.move.astype(kind), np.ones(len(m.start), kind)
        most = int(self.alive[0]) if len(self.alive) else 0
        b = emit[self.symbols]
        alpha = np.empty_like(b) if keep else b
        scale, step, last = np.empty(len(b), kind), np.empty((most, len(ones)), kind), None
        off = self.off.tolist()
        for t in range(len(off) - 1):
            s, e = off[t], off[t + 1]
            a = step[: e - s]
            if last is None:
                a[:] = m.start
            else:
                np.matmul(last[: e - s], move, out=a)
            a *= b[s:e]
            np.matmul(a, ones, out=scale[s:e])
            last = alpha[s:e]
            np.divide(a, scale[s:e, None], out=last)
        return scale, b, alpha

    def log10(self, m: HMM) -> np.ndarray:
        """Log10 likelihood of each sequence, in the order they came."""
        scale, _, _ = self.forward(m)
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(self.doc, np.log10(scale), minlength=len(self.order))
        return out

    def expect(self, m: HMM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions."""
        scale, b, alpha = self.forward(m, np.float32, keep=True)
        k = len(m.start)
        back = np.ascontiguousarray(m.move.T.astype(np.float32))
        b /= scale[:, None]
        beta = np.ones_like(b)
        step = np.empty((int(self.alive[1]) if len(self.alive) > 1 else 0, k), np.float32)
        off = self.off.tolist()
        for t in range(len(off) - 3, -1, -1):
            s, e, f = off[t], off[t + 1], off[t + 2]
            later = step[: f - e]
            np.multiply(b[e:f], beta[e:f], out=later)
            np.matmul(later, back, out=beta[s : s + f - e])
        moves = np.zeros((k, k))
        first = off[1] if len(off) > 1 else 0
        b *= beta
        before = np.repeat(self.off[:-1][:-1], self.alive[1:]) + self.doc[first:]  # the place one step earlier
        for i in range(0, len(before), 100_000):
            moves += alpha[before[i : i + 100_000]].T @ b[first + i : first + i + 100_000][: len(before) - i]
        alpha *= beta  # now the states' probabilities
        starts = alpha[:first].sum(0, dtype=np.float64) if first else np.zeros(k)
        emits = np.stack([np.bincount(self.symbols, alpha[:, i], minlength=len(m.emit)) for i in range(k)], 1)
        return starts, moves * m.move, emits


def improved(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, prior: np.ndarray) -> HMM:
    """The maximisation step. prior: the symbols' overall shares, of which each state gets a tenth of a count per symbol, so that
    nothing becomes impossible and small corpora do not overfit."""
    starts, moves, emits = starts + 0.1, moves + 0.1, emits + 0.1 * len(prior) * prior[:, None] + 1e-6
    return HMM(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))


def rare_class(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-3:]) % classes


def _word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """word binary, c long over all rows: summed by task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            got = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
            counts.clear()
            return got

        for batch in (part for whole in batches for part in blocks(whole, "text", BLOCK_BYTES)):
            for text in utf8_list(batch.column(0)):
                if text:
                    counts.update(text.lower().split())
                    if len(counts) > FLUSH:
                        yield out()
        yield out()

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def encoded(batch: pa.RecordBatch, known: dict[bytes, int], base: np.ndarray, in_class: np.ndarray, n_top: int, classes: int) -> pa.RecordBatch:
    """Rows (doc_id, held_out, text) with their symbols, the end last, as 16-bit numbers; their words, and those of the top; the sums of base and of
    in_class over the words' symbols; and their rare words with the number of each. All words of the batch are worked on at once."""
    words: list[bytes] = []
    n_words = np.empty(batch.num_rows, np.int64)
    for i, text in enumerate(utf8_list(batch.column(2))):
        mine = text.lower().split() if text else []
        n_words[i] = len(mine)
        words += mine
    doc = np.repeat(np.arange(len(n_words)), n_words)
    numbered = pa.array(words, pa.binary()).dictionary_encode()  # each distinct word is looked up once
    distinct, at = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
    symbol = np.fromiter(map(known.get, distinct, repeat(-1)), np.int32, len(distinct))
    is_rare = symbol < 0
    some = np.flatnonzero(is_rare)
    symbol[some] = n_top + np.fromiter((rare_class(distinct[i], classes) for i in some.tolist()), np.int32, len(some))
    coded, rare = symbol[at], np.flatnonzero(is_rare[at])
    pairs, times = np.unique(doc[rare] * len(distinct) + at[rare], return_counts=True)  # by document, then by word
    per_doc = np.bincount(pairs // max(1, len(distinct)), minlength=len(n_words))
    inner = pa.StructArray.from_arrays([numbered.dictionary.take(pa.array(pairs % max(1, len(distinct)))), pa.array(times, pa.int32())], ["word", "n"])
    ends = np.concatenate([[0], np.cumsum(n_words + 1)])
    ids = np.full(ends[-1], n_top + classes, np.uint16)
    ids[np.arange(len(coded)) + doc] = coded
    total = lambda x, of: pa.array(np.bincount(doc[of], x[coded[of]], minlength=len(n_words)), pa.float64())
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(n_words), pa.array(n_words - np.bincount(doc[rare], minlength=len(n_words))), total(base, slice(None)), total(in_class, rare),
         pa.Array.from_buffers(pa.binary(), len(n_words), [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(ids)]),
         pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_doc)]), pa.int32()), inner)],
        ["doc_id", "held_out", "n_words", "n_top", "base_sum", "class_sum", "ids", "rare"])


def _batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows of each batch, longest first, with their symbol sequences, in parts of about BATCH_TOKENS symbols."""
    for batch in batches:
        seqs = [np.frombuffer(x, np.uint16) for x in batch.column(batch.schema.names.index(column)).to_pylist()]
        order = np.argsort([-len(s) for s in seqs], kind="stable").tolist()
        at = total = 0
        for i, o in enumerate(order):
            if i > at and total + len(seqs[o]) > BATCH_TOKENS:
                yield batch.take(pa.array(order[at:i])), [seqs[j] for j in order[at:i]]
                at, total = i, 0
            total += len(seqs[o])
        if order:
            yield batch.take(pa.array(order[at:])), [seqs[j] for j in order[at:]]


def hmm_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", top_words: int = 40_000,
               rare_classes: int = 1024, slices: int = 8, passes: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns where held_out is not true.
    Symbols are 16-bit numbers, so top_words + rare_classes must stay under 65,536."""
    if top_words + rare_classes >= 1 << 16:
        raise ValueError(f"{top_words} top words and {rare_classes} rare classes do not fit 16-bit symbols")
    spark = docs.sparkSession
    bound_batches(spark)
    send = spark.sparkContext.broadcast
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    training = rows.where(~F.col("held_out"))
    counts, _ = written(_word_counts(training, "text"), "words")
    docs_n = training.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = total.n + docs_n, total.v + (docs_n > 0)
    over = float(n_all + v_all + 1)
    least, n_over = None, 0  # the smallest count of a frequent word: over it stand top_words words at most
    for r in counts.groupBy("c").agg(F.count("*").alias("words")).orderBy(F.desc("c")).limit(top_words).collect():
        n_over += r.words
        if n_over > top_words:
            break
        least = r.c
    top = sorted(counts.where(F.col("c") >= least).collect(), key=lambda r: (-r.c, r.word)) if least is not None else []
    known = {bytes(r.word): i for i, r in enumerate(top)}
    top_c = np.array([r.c for r in top], np.float64)
    n_top = len(top)
    sent = send((known, rare_classes))

    # class totals of the words outside the top
    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classes = sent.value
        for batch in batches:
            n, v = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if w not in known:
                    k = rare_class(w, classes)
                    n[k] += c
                    v[k] += 1
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes), pa.int32()), pa.array(n), pa.array(v)], ["k", "n", "v"])

    classes = counts.mapInArrow(by_class, "k int, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()  # rare_classes rows
    class_n, class_over = np.zeros(rare_classes), np.ones(rare_classes)
    for r in classes:
        class_n[r.k], class_over[r.k] = r.n, r.n + r.v + 1

    base = np.concatenate([np.log10((top_c + 1) / over), np.full(rare_classes, -np.log10(over))])  # a rare word's count is joined later
    in_class = np.concatenate([np.zeros(n_top), -np.log10(class_over)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classes = sent.value
        for batch in (part for whole in batches for part in blocks(whole, "text", BLOCK_BYTES)):
            yield encoded(batch, known, base, in_class, n_top, classes)

    kind = rows.schema["doc_id"].dataType.simpleString()
    coded = rows.mapInArrow(encode, f"doc_id {kind}, held_out boolean, n_words long, n_top long, base_sum double, class_sum double, ids binary, rare array<struct<word:binary,n:int>>")
    coded = coded.withColumns({"row": F.monotonically_increasing_id(), "slice": F.pmod(F.xxhash64("doc_id", F.lit("hmm")), F.lit(slices)).cast("int")})
    coded, _ = written(coded.sortWithinPartitions("slice"), "coded", {"parquet.block.size": GROUP_BYTES})

    unigram = np.concatenate([top_c, class_n, [float(docs_n)]]) + 0.01
    model = trained(coded.where(~F.col("held_out")).select("slice", "ids"), unigram, slices, passes) if docs_n else first_guess(unigram)
    fitted = send(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, seqs in _batches(batches, "ids"):
            yield pa.RecordBatch.from_arrays([*part.columns[:7], pa.array(_Batch(seqs).log10(fitted.value))], [*part.schema.names[:7], "hmm"])

    scored = coded.select("row", "doc_id", "held_out", "n_words", "n_top", "base_sum", "class_sum", "ids").mapInArrow(score, f"row long, doc_id {kind}, held_out boolean, n_words long, n_top long, base_sum double, class_sum double, hmm double")
    seen = counts.select("word", F.log10(F.col("c") + 1.0).alias("share"))
    rare = coded.select("row", F.inline("rare")).join(seen, "word").groupBy("row").agg(F.sum(F.col("n") * F.col("share")).alias("rare_sum"), F.sum("n").alias("rare_known"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    out = scored.join(rare, "row", "left")
    return out.select(
        F.col("doc_id").alias(id_col), "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("n_top") + zero("rare_known") + int(docs_n > 0)).cast("long").alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"), (F.col("base_sum") + zero("rare_sum") + float(np.log10((docs_n + 1) / over))).alias("base_score"), (F.col("hmm") + F.col("class_sum") + zero("rare_sum")).alias("score"))


def trained(coded: DataFrame, unigram: np.ndarray, slices: int, passes: int, states: int = STATES) -> HMM:
    """coded: slice, ids of the training rows. unigram: counts of the symbols over all of them."""
    prior, model, counts = unigram / unigram.sum(), first_guess(unigram, states), None
    for k in range(slices * passes + 1):
        last = k == slices * passes
        sent = coded.sparkSession.sparkContext.broadcast(model)
        got = _expected(coded if last else coded.where(F.col("slice") == k % slices), sent, states, len(unigram))
        sent.destroy()
        seen = got[2].sum()
        if not seen:
            continue  # an empty slice
        got = [x * (unigram.sum() / seen) for x in got]  # as if all rows were like the slice
        rate = 1.0 if last else (k + 2) ** -0.7
        counts = got if counts is None else [(1 - rate) * a + rate * b for a, b in zip(counts, got)]
        model = improved(*counts, prior)
    return model


def _expected(coded: DataFrame, sent, states: int, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over all rows: each task's are summed by symbol in a shuffle; a row per symbol comes back. Starts and moves
    travel as the symbols -1 and -2, -3, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        total = None
        for _, seqs in _batches(batches, "ids"):
            got = _Batch(seqs).expect(m)
            total = got if total is None else tuple(a + b for a, b in zip(total, got))
        if total is not None:
            starts, moves, emits = total
            some = np.flatnonzero(emits.any(1))
            rows = np.concatenate([starts[None], moves, emits[some]])
            ids = np.concatenate([-1 - np.arange(1 + states), some])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *[pa.array(np.ascontiguousarray(rows[:, i]), pa.float64()) for i in range(states)]], ["symbol", *[f"e{i}" for i in range(states)]])

    names = [f"e{i}" for i in range(states)]
    got = coded.select("ids").mapInArrow(run, "symbol int, " + ", ".join(f"{x} double" for x in names)).groupBy("symbol").agg(*[F.sum(x).alias(x) for x in names]).toPandas()
    ids, values = got["symbol"].to_numpy(), got[names].to_numpy(np.float64)
    head, emits = np.zeros((1 + states, states)), np.zeros((symbols, states))
    head[-1 - ids[ids < 0]] = values[ids < 0]
    emits[ids[ids >= 0]] = values[ids >= 0]
    return head[0], head[1:], emits


def op3_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 2)
