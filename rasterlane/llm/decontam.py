"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton holds every substring of every item, items kept apart. Training words are streamed through it; at each word it
knows the longest suffix that some item holds. A match of `window` words or more, or a whole item of fewer, marks its words as
hit. Stretches in which no two neighbouring words are neighbours in an item cannot hold a match of two words, so the automaton
is back at its start there: a table of the items' word pairs finds those stretches and they are skipped.

The items are counted before they are sent out. Up to `most_item_words` words make one automaton, which is broadcast; more are
dealt by hash into several, each applied in a pass of its own over a written table, so that no task holds more than one.

Defined cases: null and empty texts (of documents or items) have no words and match nothing; ties and repeated rows are
each scanned; equal item ids count once; null item ids are left out; no items leave all documents clean; no documents give no
rows; other columns are kept by `remove_spans`, names starting with `_dc_` are reserved.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bound_batches, drop_path, table, utf8_list, written

#: Words of UTF-8 texts that still have their capitals: bytes over 0x7F are part of words.
TOKEN_CASED = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Every other byte, and capitals in lower case, as a table for bytes.translate: words end up parted by spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)
MOST_BYTES = 2_000_000  # of text at once in a task


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class SuffixAutomaton:
    """Of item word sequences, built online. next: transitions by word id; link: suffix links; size: longest length."""

    def __init__(self, items: list[tuple[int | str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        for _, seq in coded:
            last = 0
            for w in seq:
                last = self._add(last, w)
        self.items_at: dict[int, set] = {}  # state that holds the suffix of `window` words -> items
        self.short_at: dict[int, list[tuple[int, object]]] = {}  # state -> whole short items that end there
        self.shortest = min([window, *(len(seq) for _, seq in coded)])
        for item, seq in coded:
            at = n = 0
            for w in seq:
                at, n = self.step(at, n, w)
                if n >= window:
                    self.items_at.setdefault(self._holder(at, window), set()).add(item)
            if len(seq) < window:
                self.short_at.setdefault(at, []).append((len(seq), item))
        pairs = {a * len(self.vocabulary) + b for _, seq in coded for a, b in zip(seq, seq[1:])}
        bits = max(16, (8 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.pairs = np.zeros(1 << bits, bool)
        if pairs:
            self.pairs[self._slot(np.array(sorted(pairs), np.uint64))] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _PRIME >> self.shift).astype(np.int64)

    def _add(self, last: int, w: int) -> int:
        """One more word of an item after the state of what stands before it; returns the new last state."""
        nxt, link, size = self.next, self.link, self.size
        if (q := nxt[last].get(w)) is not None:
            return q if size[q] == size[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link = self.next, self.link
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        self.size.append(self.size[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def step(self, at: int, n: int, w: int) -> tuple[int, int]:
        """State and longest matched length after one more word."""
        while (to := self.next[at].get(w)) is None:
            if not at:
                return 0, 0
            at = self.link[at]
            n = self.size[at]
        return to, n + 1

    def _holder(self, at: int, n: int) -> int:
        """The state of the suffix of n words of a match in state `at`."""
        while self.size[self.link[at]] >= n:
            at = self.link[at]
        return at

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit stretches [start, end) of the words, in order, and the items whose windows occur."""
        get = self.vocabulary.get
        ids = np.fromiter([get(w, -1) for w in words], np.int64, len(words))
        known = ids >= 0
        if self.shortest < 2:
            runs = known
        else:
            pair = known[:-1] & known[1:]
            key = np.where(pair, ids[:-1] * len(self.vocabulary) + ids[1:], 0).astype(np.uint64)
            pair &= self.pairs[self._slot(key)]
            runs = pair
        edge = np.flatnonzero(np.diff(np.concatenate(([0], runs.view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2] + (0 if self.shortest < 2 else 1)
        long = ends - starts >= self.shortest
        hits: list[tuple[int, int]] = []
        items: set = set()
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            self._stream(ids[a:b].tolist(), a, hits, items)
        return hits, items

    def _stream(self, ids: list[int], offset: int, hits: list, items: set) -> None:
        at = n = 0
        for i, w in enumerate(ids, offset + 1):
            at, n = self.step(at, n, w)
            most = 0
            if n >= self.window:
                most = n  # each word of the match is in one of its windows
                items |= self.items_at[self._holder(at, self.window)]
            if self.short_at:
                s = at
                while s > 0:
                    for size, item in self.short_at.get(s, ()):
                        if size <= n:
                            most = max(most, size)
                            items.add(item)
                    s = self.link[s]
            if most:
                start = i - most
                while hits and hits[-1][1] >= start:
                    start = min(start, hits.pop()[0])
                hits.append((start, i))


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _automata(items: DataFrame, item_id: str, item_text: str, window: int, most_item_words: int) -> Iterator:
    """Broadcasts of automata, one after the other, each over items of about most_item_words words at most."""
    spark = items.sparkSession
    rows = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    # a word is one byte and a mark at least, so bytes bound words
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / 4 / most_item_words))
    for i in range(parts):
        mine = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == i)
        yield spark.sparkContext.broadcast([(r.item, words_of(r.text.encode())) for r in mine.toLocalIterator()])


_built: dict[str, SuffixAutomaton] = {}


def _automaton(key: str, sent, window: int) -> SuffixAutomaton:
    """Built once a worker; only the last one is kept."""
    if key not in _built:
        _built.clear()
        _built[key] = SuffixAutomaton(sent.value, window)
    return _built[key]


def find_windows(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id",
                 item_text: str = "text", most_item_words: int = 2_000_000) -> DataFrame:
    """docs plus _dc_words long, _dc_hits array<struct<start, end>> (stretches of word numbers) and _dc_items array<string>."""
    bound_batches(docs.sparkSession)
    found = docs.withColumns({"_dc_words": F.lit(0).cast("long"), "_dc_hits": F.lit(None).cast("array<struct<start:int,end:int>>"), "_dc_items": F.lit(None).cast("array<string>")})
    schema = found.schema
    path = None
    for k, sent in enumerate(_automata(items, item_id, item_text, window, most_item_words)):
        if k:
            found, new = written(found, "decontam")
            if path:
                drop_path(docs.sparkSession, path)
            path = new

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(key, sent, window)
            for batch in (part for whole in batches for part in blocks(whole, text_col, MOST_BYTES)):
                names = batch.schema.names
                n_words, all_hits, all_items = [], [], []
                old_hits, old_items = (batch.column(names.index(c)).to_pylist() for c in ("_dc_hits", "_dc_items"))
                for text, hits0, items0 in zip(utf8_list(batch.column(names.index(text_col))), old_hits, old_items):
                    words = words_of(text or b"")
                    hits, items = automaton.scan(words) if words else ([], set())
                    if hits0:
                        hits = _merge([(h["start"], h["end"]) for h in hits0], hits)
                    n_words.append(len(words))
                    all_hits.append([{"start": s, "end": e} for s, e in hits])
                    all_items.append(sorted({*items, *(items0 or ())}))
                new = {"_dc_words": pa.array(n_words, pa.int64()), "_dc_hits": pa.array(all_hits, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "_dc_items": pa.array(all_items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], names)

        found = found.mapInArrow(run, schema)
    return found


def n_hit(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda s, h: s + h["end"] - h["start"])


def remove_spans(docs: DataFrame, items: DataFrame, window: int = 10, most_coverage: float = 0.5, text_col: str = "text", **more) -> DataFrame:
    """docs without the hit stretches of their texts; documents of which more than most_coverage of the words are hit, go.
    What stood on both sides of a cut is not scanned anew as one stretch. Columns stay as they are."""
    found = find_windows(docs, items, window, text_col, **more)
    cover = n_hit(F.col("_dc_hits")) / F.greatest(F.lit(1), F.col("_dc_words"))
    kept = found.where(cover <= most_coverage)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blocks(whole, text_col, MOST_BYTES)):
            texts = utf8_list(batch.column(0))
            hits = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([_without(t, h) if h else t for t, h in zip(texts, hits)], pa.binary()).cast(pa.string()), *batch.columns[2:]], [text_col, *batch.schema.names[2:]])

    rest = [c for c in docs.columns if c != text_col]
    named = kept.select(text_col, "_dc_hits", *rest)
    out = named.mapInArrow(cut, docs.select(text_col, *rest).schema).select(*docs.columns)
    return out


def _without(text: bytes, hits: list[dict]) -> bytes:
    spans = [m.span() for m in TOKEN_CASED.finditer(text)]
    out, at = [], 0
    for h in hits:
        out.append(text[at : spans[h["start"]][0]])
        at = spans[h["end"] - 1][1]
    return b"".join([*out, text[at:]])


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    hit = n_hit(F.col("_dc_hits"))
    return found.select("doc_id", F.col("_dc_words").alias("n_words"), hit.alias("n_hit"), F.size("_dc_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("_dc_items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


ORACLE = r"""
WITH w AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS g
        FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT *, least(10, len(ws)) AS n FROM w WHERE len(ws) > 0))),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS g
      FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
h AS (SELECT doc_id, i, g.n, item_id FROM g JOIN win ON g.n = win.n AND g.g = win.g),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
