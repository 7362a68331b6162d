"""Tokenizer alignment against whole texts encoded by the libraries, offsets compared one by one."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from rasterlane.llm import align

SCHEMA = "doc_id long, text string, lang string, pair long, block string, count int, n int"
ODD = ["", None, " ", "  ", "a", " a", "a ", "a  ", "  a", "a b", "a  b", "a\n b", "a\n  b", "a \n b", "a\tb", "a  b", "a　 b", "a​ b", "a\x1c b", "a\x85 b", "x᠎ y", "▁", "a▁b", "a ▁ b", "<s> a </s>", "<|endoftext|> a", "<unk>", "<0x41> <0x0A>", "a\0b", "\0",
       "日本語のテキスト 混ぜる", "👩‍👩‍👧‍👦 family", "été naïve", "é", "ﬁ Ａ", "can't we'll I'D", "  lead", "trail   ", "1234567 89", "....!!!", "K" * 5000, "ab " * 3000, "\r\n\r\n  x", "word" + " " * 300 + "word", "a   b", "﻿bom x", "x ﻿ y"]


def plain(rows):
    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(x): x for x in shown}
    for x in range(256):
        if x not in shown:
            table[chr(256 + sum(y not in shown for y in range(x)))] = x
    docs = []
    for i, text in rows:
        ai = bi = []
        if text:
            ai, bi = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ab = [bytes(table[c] for c in a.id_to_token(t)) for t in ai]
            bb = [bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in bi]
            if b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
                ai, bi = [], []
        groups, links, p, q, x, y, m, n = [], [], 0, 0, 0, 0, [], []
        while x < len(ai) or y < len(bi):
            if p <= q and x < len(ai) and (p < q or not m):
                m.append(ai[x])
                p, x = p + len(ab[x]), x + 1
            else:
                n.append(bi[y])
                q, y = q + len(bb[y]), y + 1
            if p == q and m and n:
                groups.append((m, n))
                links.append((m[-1], n[-1]))
                m, n = [], []
        said = ";".join(",".join(map(str, m)) + "|" + ",".join(map(str, n)) for m, n in groups)
        docs.append((i, len(ai), len(bi), len(groups), links, hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    count = Counter(k for d in docs for k in d[4])
    best = Counter()
    for (_, t), c in count.items():
        best[t] = max(best[t], c)
    return sorted(((i, na, nb, ng, len(ls), sum(count[k] == best[k[1]] for k in ls), sum(count[k] for k in ls), sha) for i, na, nb, ng, ls, sha in docs), key=repr)


def result(spark, rows, parts=3):
    df = align.align_tokens(spark.createDataFrame([(*r, "en", 1, "x", 2, 3) for r in rows], SCHEMA).repartition(parts))
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def mixed_texts(n=120, seed=5):
    rnd = random.Random(seed)
    bits = ["the", "and", "naïve", "Ordnung", "año", "x1", "日本", ",", ".", "'s", "\n", "\t", "  ", "▁", "👍", "café", "unbelievably", "12345", "é", " ", "-"]
    rows = [(i, "".join(rnd.choice(bits) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(1, 80)))) for i in range(n)]
    return rows + [(i, t) for i, t in enumerate(ODD, n)] + rows[:9] + [(None, "the and the"), (None, None)]


def test_equals_whole_texts(spark, monkeypatch):
    rows = mixed_texts()
    assert result(spark, rows) == plain(rows)


@pytest.mark.parametrize("text", [t for t in ODD if t])
def test_pieces_of_long_texts(text, monkeypatch):
    """A text cut into short pieces has the same groups."""
    monkeypatch.setattr(align, "PIECE", 3)
    monkeypatch.setattr(align, "REMEMBERED", 2)
    monkeypatch.setattr(align, "RUN", 2)
    one = align.Aligner(align.default_byte_level(), align.default_model())
    [(na, nb, ng, sha, _, links)] = one.documents([text])
    assert (0, na, nb, ng, sum(links), sha) == (0, *(p := plain([(0, text)])[0])[1:5], p[7])


def test_without_cuts():
    """A vocabulary that allows no cut is encoded whole."""
    one = align.Aligner(align.default_byte_level(), align.default_model())
    cut = [d[:4] for d in one.documents([t or "" for t in ODD])]
    one.cut, one.known = False, align.Chunks()
    assert [d[:4] for d in one.documents([t or "" for t in ODD])] == cut


def test_groups():
    import numpy as np

    assert align.groups_of(np.array([1, 3, 4]), np.array([3, 4]), 4) == [(2, 1), (1, 1)]
    assert align.groups_of(np.array([4]), np.array([1, 2, 4]), 4) == [(1, 3)]


def test_empty_table(spark):
    assert result(spark, []) == []


def test_query(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    got = align.op12_align_tokenizers(spark, "/root/testdata/sf0.001")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(list(zip(t["doc_id"], t["text"])))
