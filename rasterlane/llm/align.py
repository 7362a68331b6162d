"""Alignment of two tokenizers over the bytes of every document.

Both token sequences cover the same bytes, a space and the text. A label per byte says where a token of A ends (1), of B (2) or
of both (3); a regular expression scans the labels for spans up to each 3, and the counts of labels within a span say how many
tokens of A and B make up one group. The token occurrences whose last bytes meet are linked, and every link is then told how
often its pair of ids is linked in the corpus, and whether that is the most for its id of B.

A text is cut before a space that follows anything but white space: neither tokenizer has tokens over such a place (of A by its
pattern, of B by its pieces; with other vocabularies a text is one chunk). Chunks are encoded by the libraries once a worker,
up to a bound that only affects speed.

Links stay where they are: a task writes rows of about BLOCK_BYTES of text, each with its distinct pairs and the links of its
documents as positions among them. Only (block, pair) is shuffled to sum pairs over the corpus and back to the blocks, so a
pair has one row a block, however common it is.

Defined cases: null and empty texts, texts that are not UTF-8 and those whose tokens do not give their bytes back have zeros and
''; control strings inside texts are plain text; texts of any length are taken whole, in pieces of PIECE characters; repeated
rows count each; rows without id keep null; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import SPACE, default_model
from .common import blocks, bound_batches, table, utf8_list, written

BLOCK_BYTES, BLOCK_ROWS = 2_000_000, 4096
PIECE = 1_000_000  # characters cut into chunks at once
REMEMBERED = 400_000  # chunks a worker remembers
RUN = 20_000  # characters encoded at once
ID_B = 32  # bits of an id of B within a pair
_GROUP = re.compile(rb"[\x00-\x02]*\x03")
_ZERO_WIDTH = r"\u180e\u200b-\u200d\u2060\ufeff"  # not white space to every library
_CUT = re.compile(rf"[^\s{_ZERO_WIDTH}] (?=[\s\S])")
_ENDS_WHITE = re.compile(rf"[\s{_ZERO_WIDTH}]\Z")
_ODD_SPACE = re.compile(rf"[\s{_ZERO_WIDTH}] ")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(prints))}


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray, n_bytes: int) -> list[tuple[int, int]]:
    """How many tokens of A and of B are in each group, from the byte offsets where tokens end."""
    labels = np.zeros(n_bytes, np.uint8)
    labels[a_ends - 1] |= 1
    labels[b_ends - 1] |= 2
    return [*map(_label_counts, _GROUP.findall(labels.tobytes().translate(None, b"\0")))]


@lru_cache(maxsize=4096)
def _label_counts(span: bytes) -> tuple[int, int]:
    return span.count(b"\x01") + 1, span.count(b"\x02") + 1


class Chunks:
    """What is known of chunks, as arrays by their number: tokens of A and of B, groups, and where their pairs are; their texts of groups."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, 1 if bytes differ
        self.starts = np.zeros(0, np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.said: list[bytes] = []

    def add(self, chunks: list[str], counts: list, said: list[bytes], pairs: list[np.ndarray]) -> None:
        self.number.update(zip(chunks, range(len(self.said), len(self.said) + len(chunks))))
        new = np.array(counts, np.int64).reshape(-1, 4)
        self.starts = np.concatenate([self.starts, len(self.pairs) + np.cumsum(new[:, 2]) - new[:, 2]])
        self.counts, self.pairs = np.concatenate([self.counts, new]), np.concatenate([self.pairs, *pairs])
        self.said += said


class Aligner:
    """Counts, texts of groups and linked pairs of texts, by way of their chunks. A chunk is written without the space that it begins with."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        at = byte_alphabet()
        self.a_bytes = [bytes(at.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.names = [*map(str, range(max(len(self.a_bytes), len(self.b_bytes))))]
        with open(a_path, encoding="utf-8") as f:
            split = json.load(f)["pre_tokenizer"]
        self.cut = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not any(x != SPACE and y == SPACE for p in pieces for x, y in zip(p, p[1:]))
        self.known = Chunks()

    def chunks(self, text: str) -> Iterator[list[str]]:
        """Lists of chunks, one list for each PIECE of the text."""
        if not self.cut:
            yield [text]
            return
        start = 0
        while len(text) - start > PIECE and (m := _CUT.search(text, start + PIECE)):
            yield self._cut(text[start : m.end() - 1])
            start = m.end()
        yield self._cut(text[start:])

    def _cut(self, text: str) -> list[str]:
        if not _ODD_SPACE.search(" " + text[:1]) and not _ODD_SPACE.search(text):
            words = text.split(" ")
            if words[-1] == "" and len(words) > 1:  # a space at the end belongs to the chunk before
                words[-2:] = [words[-2] + " "]
            return words
        ends = [m.end() - 1 for m in _CUT.finditer(text)]
        return [text[i:j] for i, j in zip([0, *(e + 1 for e in ends)], [*ends, len(text)])]

    def learn(self, chunks: set[str]) -> None:
        """Encodes the chunks that are not known yet: many in one text where they may follow each other."""
        if len(self.known.said) > REMEMBERED or len(self.known.pairs) > 8 * REMEMBERED:
            self.known = Chunks()
        runs, size = [[]], 0
        for c in chunks.difference(self.known.number):
            if not self.cut or not c or _ENDS_WHITE.search(c):
                runs.insert(0, [c])
                continue
            runs[-1].append(c)
            size += len(c)
            if size > RUN:
                runs.append([])
                size = 0
        told = [(run, self._encoded(run)) for run in runs if run]
        told = [x for run, got in told for x in ([(run, got)] if got or len(run) == 1 else [([c], self._encoded([c])) for c in run])]
        bad = ([(0, 0, 0, 1)], [b""], np.zeros(0, np.int64))
        told = [(run, got or bad) for run, got in told]
        self.known.add([c for run, _ in told for c in run], [n for _, got in told for n in got[0]], [t for _, got in told for t in got[1]], [got[2] for _, got in told])

    def _encoded(self, run: list[str]) -> tuple | None:
        """Counts and texts of groups by chunk, pairs of all, of chunks that make up one text; None if bytes differ."""
        text = " " + " ".join(run)
        a, b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])
        whole = text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        groups, names = groups_of(a_ends, b_ends, len(whole)), self.names
        said, i, j = [], 0, 0
        for m, n in groups:
            if m == n == 1:
                said.append(f"{a[i]}|{b[j]}")
            else:
                said.append(",".join([names[x] for x in a[i : i + m]]) + "|" + ",".join([names[x] for x in b[j : j + n]]))
            i, j = i + m, j + n
        last = np.cumsum(np.array(groups, np.int64), 0) - 1  # of each group's tokens
        group_ends = a_ends[last[:, 0]]
        ends = np.cumsum([len(c.encode()) + 1 for c in run])
        upto = np.stack([np.searchsorted(x, ends, "right") for x in (a_ends, b_ends, group_ends)] + [np.zeros(len(run), np.int64)], 1)
        cuts = [0, *upto[:, 2].tolist()]
        return np.diff(upto, axis=0, prepend=0).tolist(), [";".join(said[x:y]).encode() for x, y in zip(cuts, cuts[1:])], a_ids[last[:, 0]] << ID_B | b_ids[last[:, 1]]

    def measured(self, texts: list[list[str]]) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
        """Of each list of chunks: its four counts, the text of its groups, and the pair of every link."""
        self.learn(set().union(*texts))
        known = self.known
        sizes = np.array([*map(len, texts)], np.int64)
        at = np.fromiter(map(known.number.__getitem__, chain.from_iterable(texts)), np.int64, sizes.sum())
        start = 0
        for n in sizes.tolist():
            mine = at[start : start + n]
            start += n
            counts = known.counts[mine]
            many = counts[:, 2]
            ends = np.cumsum(many)
            where = np.repeat(known.starts[mine] - ends + many, many) + np.arange(ends[-1] if n else 0)
            yield counts.sum(0), b";".join(map(known.said.__getitem__, mine.tolist())), known.pairs[where]

    def documents(self, texts: list[str]) -> list[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """n_a, n_b, n_groups, digest, distinct pairs and how many links each has."""
        out: list[tuple | None] = [None] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= PIECE]
        for i, got in zip(short, self.measured([next(self.chunks(texts[i])) if texts[i] else [] for i in short])):
            out[i] = self._whole([got])
        return [x or self._whole(got for chunks in self.chunks(texts[i]) for got in self.measured([chunks])) for i, x in enumerate(out)]

    def _whole(self, parts) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        counts, digest, links = np.zeros(4, np.int64), hashlib.sha256(), Counter()
        pairs = n = np.zeros(0, np.int64)
        for at, (more, said, linked) in enumerate(parts):
            digest.update(b";" + said if at else said)
            counts += more
            if counts[3]:
                return 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
            pairs, n = np.unique(linked, return_counts=True)
            if at or len(said) > PIECE:  # more parts may follow
                links.update(dict(zip(pairs.tolist(), n.tolist())))
        if links:
            pairs, n = np.array([*links], np.int64), np.array([*links.values()], np.int64)
        return (*counts[:3].tolist(), digest.hexdigest() if counts[2] else "", pairs, n)


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def default_byte_level() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _decoded(raw: bytes | None) -> str:
    try:
        return (raw or b"").decode()
    except UnicodeDecodeError:
        return ""


def _one(values, kind: pa.DataType) -> pa.Array:
    """One row that holds all values."""
    values = pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def aligned_blocks(rows: DataFrame, a_path: str | None, b_path: str | None) -> DataFrame:
    """Rows (id, text) -> a row per block of documents with their counts, digests, links and the block's pairs."""
    id_kind = rows.schema["id"].dataType.simpleString()
    schema = f"block long, id array<{id_kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, digest array<string>, pair array<long>, pair_n array<long>, n_pairs array<int>, link_at array<int>, link_n array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a_path or default_byte_level(), b_path or default_model())
        block, told, size, id_type = TaskContext.get().partitionId() << 32, [], 0, None

        def flush() -> pa.RecordBatch:
            n = np.concatenate([t[6] for t in told])
            pairs, at = np.unique(np.concatenate([t[5] for t in told]), return_inverse=True)
            totals = np.zeros(len(pairs), np.int64)
            np.add.at(totals, at, n)
            columns = [pa.array([block], pa.int64()), _one([t[0] for t in told], id_type), *(_one([t[i] for t in told], pa.int64()) for i in (1, 2, 3)), _one([t[4] for t in told], pa.string()),
                       _one(pairs, pa.int64()), _one(totals, pa.int64()), _one([len(t[5]) for t in told], pa.int32()), _one(at, pa.int32()), _one(n, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

        for batch in (part for whole in batches for part in blocks(whole, "text", BLOCK_BYTES)):
            id_type, raw = batch.schema.field(0).type, utf8_list(batch.column(1))
            told += [(i, *of) for i, of in zip(batch.column(0).to_pylist(), align.documents([*map(_decoded, raw)]))]
            size += sum(len(t or b"") for t in raw)
            if size >= BLOCK_BYTES or len(told) >= BLOCK_ROWS:
                yield flush()
                block, told, size = block + 1, [], 0
        if told:
            yield flush()

    return rows.mapInArrow(run, schema)


def align_tokens(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_a, n_b, n_groups, n_links, n_best, count_sum long, groups_sha256 string of every row."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_kind = rows.schema["id"].dataType.simpleString()
    held, _ = written(aligned_blocks(rows, a_path, b_path), "aligned")
    pairs = held.select("block", F.posexplode(F.arrays_zip("pair", "pair_n")).alias("at", "p")).select("block", "at", "p.pair", F.col("p.pair_n").alias("n"))
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(2**ID_B - 1)))  # of one id of B: as many rows as A has ids at most
    totals = totals.select("pair", "count", (F.col("count") == most).alias("best"))
    back = pairs.select("block", "at", "pair").join(totals, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "count", "best"))).alias("told"))
    both = held.select("block", "id", "n_a", "n_b", "n_groups", "digest", "n_pairs", "link_at", "link_n").join(back, "block", "left")
    both = both.select("id", "n_a", "n_b", "n_groups", "digest", "n_pairs", "link_at", "link_n", F.col("told.count").alias("count"), F.col("told.best").alias("best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 1) for whole in batches for i in range(whole.num_rows)):
            flat = lambda name: batch.column(batch.schema.get_field_index(name)).flatten()
            count, best = flat("count").to_numpy(zero_copy_only=False), flat("best").to_numpy(zero_copy_only=False)
            at, n = flat("link_at").to_numpy(), flat("link_n").to_numpy()
            ends = np.cumsum(flat("n_pairs").to_numpy(), dtype=np.int64)

            def per_document(x: np.ndarray) -> np.ndarray:
                total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
                return np.diff(total[np.concatenate([[0], ends])])

            n_best = per_document(n * best[at].astype(np.int64) if len(at) else n)
            count_sum = per_document(n * count[at].astype(np.int64) if len(at) else n)
            yield pa.RecordBatch.from_arrays([flat("id"), flat("n_a"), flat("n_b"), flat("n_groups"), pa.array(per_document(n)), pa.array(n_best), pa.array(count_sum), flat("digest")],
                                             ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    out = both.mapInArrow(run, f"id {id_kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))
