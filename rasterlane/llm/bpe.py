"""Token counts by heap-and-linked-list byte-pair merging over a public vocabulary with byte fallback.

A text is cut where no merge can cross: before each space that follows another character (checked on the vocabulary: no
piece holds a space after another character; a vocabulary that does is merged over whole texts). Within a chunk the symbols
form a linked list; a heap holds the adjacent pairs whose union is a piece, and the lowest rank, leftmost first, is merged
until none is left. The count is the initial symbols less the merges; a symbol that the vocabulary lacks counts once
for each of its UTF-8 bytes. No ids are made. Counts of short chunks are remembered per Python worker, up to a bound that
only affects speed.

Defined cases: null and empty texts count 0; special strings inside texts are plain text; texts of any length are merged
whole; repeated rows are counted each; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bound_batches, table, utf8_list

SPACE = "▁"
REMEMBERED = 400_000  # chunks a worker remembers
LONGEST = 48  # characters of a remembered chunk


class PieceVocabulary:
    """Ranks of the pieces of a .model file: 0 merges first. Pieces of one character need no rank."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        pieces = [(-sp.get_score(i), sp.id_to_piece(i)) for i in range(sp.get_piece_size()) if not special(i)]
        self.rank = {p: score for score, p in pieces}
        self.cut = not any(a != SPACE and b == SPACE for p in self.rank for a, b in zip(p, p[1:]))

    def count_symbols(self, chunk: str) -> int:
        """Pieces of a chunk in which spaces are already marked."""
        rank = self.rank
        if chunk in rank and len(chunk) == 1:
            return 1
        symbols: list[str | None] = list(chunk)
        n = len(symbols)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        get = rank.get
        heap = [(r, i, len(p)) for i in range(n - 1) if (r := get(p := symbols[i] + symbols[i + 1])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            _, i, size = heappop(heap)
            a = symbols[i]
            if a is None or (j := right[i]) >= n or len(a) + len(symbols[j]) != size:
                continue  # one of the two has been merged since
            symbols[i] = a = a + symbols[j]
            symbols[j] = None
            merges += 1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                p = a + symbols[k]
                if (r := get(p)) is not None:
                    heappush(heap, (r, i, len(p)))
            if (h := left[i]) >= 0:
                p = symbols[h] + a
                if (r := get(p)) is not None:
                    heappush(heap, (r, h, len(p)))
        fallback = sum(len(s.encode()) - 1 for s in symbols if s is not None and len(s) == 1 and s not in rank)
        return n - merges + fallback


class _Remembered(dict):
    """Counts by chunk. A chunk is the word after a single space; runs of spaces are handled by the caller."""

    def __init__(self, vocabulary: PieceVocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        n = self.vocabulary.count_symbols(SPACE + word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str):
    """A function from text to its number of tokens, made once a worker."""
    vocabulary = PieceVocabulary(path)
    known = _Remembered(vocabulary)
    of = known.__getitem__

    def count(text: str) -> int:
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")  # the mark itself counts as a space
        if not vocabulary.cut:
            return vocabulary.count_symbols(SPACE + SPACE.join(words))
        if "" not in words:
            return sum(map(of, words))
        total, gap = 0, 0
        for i, w in enumerate(words):  # an empty word is one more space before the next
            if w == "" and i < len(words) - 1:
                gap += 1
            elif gap:
                total += vocabulary.count_symbols(SPACE * (gap + 1) + w)
                gap = 0
            else:
                total += of(w)
        return total

    return count


MOST_BYTES = 2_000_000  # of text at once in a task


def count_tokens(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes long, n_tokens long of every row. model_path: the vocabulary's file on the executors; by default
    they look up the public one where they run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path or default_model())
        for batch in (part for whole in batches for part in blocks(whole, "text", MOST_BYTES)):
            texts = utf8_list(batch.column(1))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(t or b"") for t in texts], pa.int64()),
                pa.array([count(t.decode()) if t else 0 for t in texts], pa.int64()),
            ], ["id", "n_bytes", "n_tokens"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 4096)
