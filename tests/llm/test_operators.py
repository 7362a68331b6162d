"""The training-data operators against brute force, on small tables with nulls, empty texts, ties, repeated rows and odd columns."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlane.llm import bpe, chat, decontam, hmm, hnsw, langid, minhash, mixing, quality, warc
from rasterlane.sources.shared import new_path

DOC = "doc_id long, text string, lang string, source string, size long, row long, label long, score double"


def docs(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns clash with the operators' own names."""
    return spark.createDataFrame([(*r, 7, 7, 7, 0.5) for r in rows], DOC)


def sample(n=60, seed=1):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("n", "st", "ve", "x", "zo", "pa")]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 60))), "en" if i % 2 else "de", f"s{i % 3}") for i in range(n)]
    for i in range(n, n + 20):  # copies with an edit
        t = rows[i - n][1].split()
        t[rnd.randrange(len(t))] = "edit"
        rows.append((i, " ".join(t), "en", "s0"))
    return rows + [(1000, None, None, None), (1001, "", "en", ""), (1002, " \n\t", "de", "s1"), (rows[0][0], rows[0][1], "de", "s0"), (None, "kan lost", "en", "s1"), (1003, "K" * 30000 + " kan" * 3000, "en", "s2"), (1004, rows[3][1].upper(), "de", "s0")]


def link_components(ids, links):
    at = {i: i for i in ids}

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("k,num,den", [(3, 85, 100), (5, 4, 5)])
def test_minhash(spark, k, num, den):
    rows = sample()
    got = minhash.near_duplicates(docs(spark, rows), k, num, den).collect()
    sets = {}
    for i, t, _, _ in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    ids = [i for i in sets if i is not None]
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = link_components(ids, links)
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id]) and r.component_id == (want[r.doc_id] if r.doc_id is not None else None) and r.kept == (r.doc_id == r.component_id)
    assert minhash.near_duplicates(docs(spark, []), k, num, den).count() == 0


def test_minhash_large_clusters(spark, monkeypatch):
    """Many sets just under the threshold, finished in blocks."""
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        t = list(base)
        for _ in range(rnd.randint(1, 4)):
            t[rnd.randrange(60)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(t), "en", "s"))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows), 3, 85, 100).collect()}
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(58)} for i, t, _, _ in rows}
    assert got == link_components(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])


def test_minhash_large_clusters_count_pairs_of_unlike_signatures(spark):
    """Similarity over the threshold, though the signatures agree in far fewer places."""
    c = minhash.circulant(30, 7)
    words = [f"w{i}" for i in range(4000)]
    low = np.stack([c.signature(c.shingles(w.encode(), 1)) for w in words])
    mine, now, extra = words[:300], low[:300].min(0), []
    while len(extra) < 45:
        best = max(range(300, 4000), key=lambda i: int((low[i] < now).sum()))
        extra.append(words[best])
        now = np.minimum(now, low[best])
    assert (now == low[:300].min(0)).mean() < 0.85 - 4.5 * math.sqrt(0.85 * 0.15 / 210)
    left = spark.createDataFrame([(1, 1, 1, 30), (1, 2, 2, 30)], "cluster long, label long, node long, size long")
    texts = spark.createDataFrame([(1, " ".join(mine)), (2, " ".join(mine + extra))], "id long, text string")
    assert [tuple(sorted(r)) for r in minhash._large_clusters(left, texts, k=1, num=85, den=100, bands=30, rows=7).collect()] == [(1, 2)]


def test_signature_estimates_similarity():
    c = minhash.circulant(30, 7)
    a, b = (c.shingles(" ".join(f"w{i}" for i in r).encode(), 1) for r in (range(400), range(100, 500)))
    assert abs((c.signature(a) == c.signature(b)).mean() - 0.6) < 0.12


def test_embedding_links(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([np.repeat(base, 6, 0) + 0.2 * rng.standard_normal((240, 16)), base[:3], base[:2]])
    rows = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [1.0] * 15 + [float("nan")], 1), (903, [1.0] * 15 + [None], 1), (904, [], 1), (None, [1.0] * 16, 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1)]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in hnsw.near_duplicates(d, least_shards=2, block_rows=64).collect()}
    u = hnsw.unit(np.array([r[1] for r in rows], np.float32))
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = link_components(range(len(rows)), np.argwhere(near).tolist())
    assert all((got[i].n_links, got[i].component_id) == (near[i].sum(), want[i]) for i in range(len(rows)))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 905)) and got[None].component_id is None
    assert (got[905].n_links, got[906].component_id) == (1, 905)
    assert hnsw.near_duplicates(d.where("vec_id < 0")).count() == 0


def test_embedding_rows_that_share_an_id(spark):
    rng = np.random.default_rng(4)
    heads = rng.standard_normal((40, 8))
    vectors = np.concatenate([heads, heads + 0.02 * rng.standard_normal((40, 8)), heads[:5]])
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.01]), (5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (6, [1.0, 0.001, 0.0]), (7, [0.001, 1.0, 0.0])]
    rows += [(int(i), v.tolist()) for i, v in zip(rng.integers(100, 130, len(vectors)), vectors)]
    got = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=32).collect()
    n = len(rows)
    u = [hnsw.unit(np.array([v]))[0] for _, v in rows]
    near = np.array([[len(u[i]) == len(u[j]) and float(u[i] @ u[j]) >= 0.95 for j in range(n)] for i in range(n)])
    reach = near.copy()
    for k in range(n):
        reach |= reach[:, [k]] & reach[[k]]
    want = [(rows[i][0], int(near[i].sum()) - 1, min(rows[j][0] for j in range(n) if reach[i, j])) for i in range(n)]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(want)
    assert [w[1] for w in want[:6]] == [1] * 6 and all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_audits_leave_out_the_query_itself():
    rng = np.random.default_rng(8)
    heads = rng.standard_normal((600, 16))
    x = hnsw.unit(np.concatenate([heads, heads + 0.01 * rng.standard_normal(heads.shape)]))
    a, b, did = hnsw.linked(hnsw.Graph(x), x, x, 0.95, own=np.arange(len(x)))
    assert {(i, j) for i, j in zip(a, b) if i != j} == {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.95)) if i != j}
    assert 0 < did["audited_links"] <= did["audit_found"] * 1.1
    lost = hnsw.Graph(x)
    for layer in lost.layers:
        layer[:] = -1  # nothing can be reached: the beams must grow to the whole shard
    a, b, did = hnsw.linked(lost, x, x, 0.95, own=np.arange(len(x)))
    assert did["whole"] == len(x) and len(a) == int((x @ x.T >= 0.95).sum())


def test_graph_recall():
    rng = np.random.default_rng(0)
    x = hnsw.unit(rng.standard_normal((1500, 24)))
    g = hnsw.Graph(x)
    near, _ = g.search(x[:200], 64)
    true = np.argsort(-(x[:200] @ x.T), 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(near.tolist(), true.tolist())]) >= 0.9


def test_small_shards_are_searched_by_graph(spark):
    """500 vectors, the smallest table, in shards of 84: graph searches answer, and the first beams alone find nearly all links."""
    v = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()])
    x = hnsw.unit(v)
    found = all_ = searched = 0
    for s in range(6):
        part = x[s::6]
        g = hnsw.Graph(part)
        want = {(i, j) for i, j in np.argwhere(x @ part.T >= 0.95).tolist()}
        a, b, did = hnsw.linked(g, part, x, 0.95)
        assert set(zip(a.tolist(), b.tolist())) == want and did["audit_found"] >= 0.9 * did["audited_links"]
        searched += did["searched"] > did["whole"]
        near, sim = g.search(x, 32)
        found += len({(i, j) for i, row in enumerate(near.tolist()) for k, j in enumerate(row) if j >= 0 and sim[i, k] >= 0.95 - 1e-6} & want)
        all_ += len(want)
    assert searched == 6 and found >= 0.9 * all_


def test_graphs_travel_as_rows_of_nodes(spark, monkeypatch):
    """A shard's graph in one row, sent to every block of queries, took executors' memory as shards grew."""
    rng = np.random.default_rng(9)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((900, 8)))], "vec_id long, embedding array<double>")
    widths, put = [], hnsw.written

    def written(df, name, *more):
        got = put(df, name, *more)
        if name == "graphs":
            sizes = [F.octet_length(k) if t == "binary" else F.size(k) for k, t in got[0].dtypes if t == "binary" or t.startswith("array")]
            widths.append(tuple(got[0].agg(F.count("*"), F.max(sum(sizes))).first()))
        return got

    monkeypatch.setattr(hnsw, "written", written)
    assert hnsw.near_duplicates(d, least_shards=2).count() == 900
    assert widths[0][0] == 900 and widths[0][1] < 1000
    x = hnsw.unit(rng.standard_normal((3000, 8)))
    g = hnsw.Graph(x)
    h = hnsw.Graph.of_rows(x, *g.rows())
    assert len(g.layers) > 1 and all((a == b).all() for a, b in zip(g.layers, h.layers))
    assert all((a == b).all() for a, b in zip(g.search(x[:50], 32), h.search(x[:50], 32)))


def test_links_are_folded_as_they_are_found(monkeypatch):
    """In a dense shard links grow with its square; a task holds a bounded number of them."""
    import tracemalloc

    rng = np.random.default_rng(3)
    x = hnsw.unit(rng.standard_normal((1, 16)) + 0.03 * rng.standard_normal((2000, 16)))
    node, times = np.arange(len(x)) + 7, np.ones(len(x), np.int64)
    g = hnsw.Graph(x)
    monkeypatch.setattr(hnsw, "FOLD", 50_000, raising=False)
    monkeypatch.setattr(hnsw, "COMPONENTS", 200_000, raising=False)
    tracemalloc.start()
    links, u, v = hnsw.folded(hnsw.links_of(g, x, x, 0.95, own=np.arange(len(x))), node, node, times)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    near = x @ x.T >= 0.95
    assert near.sum(1).min() > 1000 and (links == near.sum(1) - 1).mean() > 0.999
    assert most < 40e6 < 16 * int(near.sum())  # the pairs alone
    assert set(link_components(node.tolist(), zip(u.tolist(), v.tolist())).values()) == {7}


def test_beams_widen_in_dense_places():
    rng = np.random.default_rng(7)
    x = hnsw.unit(np.concatenate([rng.standard_normal((1, 16)) + 0.03 * rng.standard_normal((400, 16)), rng.standard_normal((1600, 16))]))
    x = x[rng.permutation(2000)]
    a, b, did = hnsw.linked(hnsw.Graph(x), x, x, 0.95)
    assert did["widest"] >= 800 and did["whole"] == 0
    want = np.argwhere(x @ x.T >= 0.95)
    assert len(set(zip(a.tolist(), b.tolist())) & set(map(tuple, want.tolist()))) >= 0.999 * len(want)


def test_hmm_recursions_equal_brute_force():
    import itertools

    rng = np.random.default_rng(0)
    n = lambda x, a=-1: x / x.sum(a, keepdims=True)
    m = hmm.HMM(n(rng.random(3)), n(rng.random((3, 3))), n(rng.random((5, 3)), 0))
    seqs = [rng.integers(0, 5, k).astype(np.uint16) for k in (4, 1, 5, 2)]
    emits, likely = np.zeros((5, 3)), []
    for s in seqs:
        paths = {p: m.start[p[0]] * math.prod(m.move[a, b] for a, b in zip(p, p[1:])) * math.prod(m.emit[o, q] for o, q in zip(s, p)) for p in itertools.product(range(3), repeat=len(s))}
        total = sum(paths.values())
        likely.append(math.log10(total))
        for p, v in paths.items():
            for o, q in zip(s, p):
                emits[o, q] += v / total
    b = hmm._Batch(seqs)
    assert np.allclose(b.log10(m), likely, atol=1e-5) and np.allclose(b.expect(m)[2], emits, atol=1e-5)


def plain_expect(m, seqs):
    """Forward-backward, a sequence and a step at a time, without scaling by batch: log10 likelihoods and expected counts."""
    k = len(m.start)
    likely, starts, moves, emits = [], np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emit)
    for s in seqs:
        alpha, scale = [], []
        for t, o in enumerate(s):
            a = (m.start if t == 0 else alpha[-1] @ m.move) * m.emit[o]
            scale.append(a.sum())
            alpha.append(a / a.sum())
        likely.append(sum(math.log10(c) for c in scale))
        beta = np.ones(k)
        for t in range(len(s) - 1, -1, -1):
            state = alpha[t] * beta
            emits[s[t]] += state
            if t:
                later = m.emit[s[t]] * beta / scale[t]
                moves += np.outer(alpha[t - 1], later) * m.move
                beta = m.move @ later
            else:
                starts += state
    return likely, (starts, moves, emits)


@pytest.mark.parametrize("top,sliced", [(5000, 8), (12, 3)])
def test_hmm_scores_equal_a_plain_stepwise_training(spark, top, sliced):
    rows = sample(200)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: [w.encode() for w in (t or "").lower().split()]
    c = Counter(w for i, t, _, _ in rows if not held(i) for w in words(t))
    ends = sum(not held(i) for i, *_ in rows)
    least = min((n for n in set(c.values()) if sum(x >= n for x in c.values()) <= top), default=math.inf)  # words of one count are in or out together
    known = {w: k for k, w in enumerate(sorted((w for w in c if c[w] >= least), key=lambda w: (-c[w], w)))}
    n, v, end = sum(c.values()) + ends, len(c) + 1, len(known) + 8
    kind = {w: hmm.rare_class(w, 8) for _, t, _, _ in rows for w in words(t) if w not in known}
    code = lambda t: [*(known.get(w, len(known) + kind.get(w, 0)) for w in words(t)), end]
    class_n, class_over = Counter(), Counter({k: 1 for k in range(8)})
    for w in c:
        if w not in known:
            class_n[kind[w]] += c[w]
            class_over[kind[w]] += c[w] + 1
    unigram = np.array([*(c[w] for w in known), *(class_n[k] for k in range(8)), ends]) + 0.01
    prior, model, counts = unigram / unigram.sum(), hmm.first_guess(unigram), None
    of = dict(spark.createDataFrame([(i,) for i in {r[0] for r in rows}], "i long").select("i", F.pmod(F.xxhash64("i", F.lit("hmm")), F.lit(sliced))).collect())
    for k in range(2 * sliced + 1):
        part = [code(t) for i, t, _, _ in rows if not held(i) and (k == 2 * sliced or of[i] == k % sliced)]
        if not part:
            continue
        got = plain_expect(model, part)[1]
        got, rate = [x * unigram.sum() / got[2].sum() for x in got], 1 if k == 2 * sliced else (k + 2) ** -0.7
        counts = got if counts is None else [(1 - rate) * x + rate * y for x, y in zip(counts, got)]
        model = hmm.improved(*counts, prior)
    want = Counter()
    for (i, t, _, _), s in zip(rows, plain_expect(model, [code(t) for _, t, _, _ in rows])[0]):
        s += sum(math.log10((c[w] + 1) / class_over[kind[w]]) for w in words(t) if w not in known)
        base = sum(math.log10((x + 1) / (n + v + 1)) for x in [*(c[w] for w in words(t)), ends])
        want[(i, held(i), len(words(t)) + 1, sum(c[w] > 0 for w in words(t)) + 1, n, round(base, 6), round(s, 1))] += 1
    for parts in (1, 5):
        got = hmm.hmm_scores(docs(spark, rows).repartition(parts), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, top_words=top, rare_classes=8, slices=sliced).collect()
        assert len(got) == len(rows)
        for r in got:  # single precision in training alone
            close = [w for w in want if w[:5] == (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) and abs(w[5] - r.base_score) < 1e-5 and abs(w[6] - r.score) < 0.06 + 1e-3 * abs(r.score)]
            assert close, r


def test_hmm_encoding_looks_up_each_distinct_word_once():
    import pyarrow as pa

    class Known(dict):
        asked = 0

        def get(self, *a):
            Known.asked += 1
            return super().get(*a)

    known = Known({b"a": 0, b"b": 1})
    texts = ["A b zz a", None, "", "zz q\u00e9 zz A", "b"] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(range(250)), pa.array([False] * 250), pa.array(texts)], ["doc_id", "held_out", "text"])
    base, in_class = np.array([1.0, 10, 100, 1000]), np.array([0, 0, 0.5, 0.25])
    got = hmm.encoded(batch, known, base, in_class, 2, 2).to_pylist()
    assert Known.asked == 4  # before: once for each of the 450 words
    for r, t in zip(got, texts):
        words = [w.encode() for w in (t or "").lower().split()]
        symbols = [known[w] if w in known else 2 + hmm.rare_class(w, 2) for w in words]
        assert np.frombuffer(r["ids"], np.uint16).tolist() == [*symbols, 4]
        assert (r["n_words"], r["n_top"], r["base_sum"], r["class_sum"]) == (len(words), sum(w in known for w in words), base[symbols].sum() if words else 0, in_class[symbols].sum() if words else 0)
        assert {x["word"]: x["n"] for x in r["rare"]} == Counter(w for w in words if w not in known)


def test_hmm_edges(spark):
    assert hmm.hmm_scores(docs(spark, []), F.lit(False)).count() == 0
    none = hmm.hmm_scores(docs(spark, sample(5)), F.lit(True)).collect()  # nothing to learn from
    assert {r.base_score for r in none} == {0.0} and all(r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in none)
    with pytest.raises(ValueError):
        hmm.hmm_scores(docs(spark, []), F.lit(False), top_words=65_000)


def test_hmm_beats_word_shares_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = hmm.hmm_scores(d, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert got.s / got.n > got.b / got.n


def test_trees_equal_a_scalar_walk_and_split_best():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (300, 4)).astype(np.float32)
    y = ((x[:, 2] > 4) ^ (rng.random(300) < 0.1)).astype(float)
    t = quality.BoostedTrees().fit(x, y)

    def walk(row):
        raw = t.base
        for feature, threshold, leaf in zip(t.feature, t.threshold, t.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            raw += float(leaf[node - len(feature)])
        return 1 / (1 + math.exp(-raw))

    assert np.allclose(t.score(x), [walk(r) for r in x], atol=1e-6)
    g, h = y.mean() - y, np.full(300, y.mean() * (1 - y.mean()))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + t.ridge)
    best = max(((gain(x[:, j] > c) + gain(x[:, j] <= c), j, c) for j in range(4) for c in range(8)))
    assert t.feature[0][0] == best[1] and best[2] <= t.threshold[0][0] < best[2] + 1


def test_learned_models_hold_out_well(spark):
    sf = "/root/testdata/sf0.01"
    q = quality.op4_quality(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("quality IS NOT NULL").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("ok"), F.avg("quality").alias("base")).first()
    assert q.ok >= 0.92 and q.ok > q.base + 0.05
    lang = langid.op5_language_id(spark, sf).where("held_out AND lang_pred <> 'und'").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert lang >= 0.97


def test_folded_tables_equal_the_convolution():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (40, langid.WINDOW)).astype(np.uint8)
    net = langid.ByteCNN(["a", "b"]).fit(x, rng.integers(0, 2, 40), 1)
    assert np.allclose(langid.Predictor(net)._windows(x), net._forward(x)[2], atol=1e-4)


def test_models_on_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    for rows in ([], [(1, "a b", "en", "s")] * 30 + [(2, "# #", "de", "s"), (None, "x", None, None), (3, None, "en", "s"), (4, "", "de", "s")]):
        d = docs(spark, rows)
        told = quality.predict(d, quality.train(d, labels, F.lit(True)), d.columns, name="_s")
        assert told.count() == len(rows) and told.columns == [*d.columns, "_s"]
        net = langid.train(d, F.lit(True))
        told = langid.predict(d, net, d.columns, names=("_l", "_s"))
        assert told.count() == len(rows) and {r._l for r in told.where("text IS NULL OR text = '' OR text = '# #'").collect()} <= {"und"}
    with pytest.raises(ValueError):
        langid.train(docs(spark, [(i, "x", f"l{i}", "s") for i in range(9)]), F.lit(True), most_langs=8)


def test_quality(spark):
    rnd = random.Random(3)
    good = [(i, " ".join(rnd.choices(["alpha", "beta", "of", "the", "gamma"], k=40)) + ".", "en", "s") for i in range(150)]
    bad = [(i, "### $$$ " * rnd.randint(1, 30) + str(rnd.random()), "en", "s") for i in range(150, 300)]
    d = docs(spark, good + bad + [(900, None, None, None), (901, "", None, None), (902, "x" * 100000, None, None)])
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(0, 1), (900, None), (None, 1)], "doc_id long, quality int")
    t = quality.train(d, labels, F.coalesce(F.col("doc_id") % 5 != 0, F.lit(False)))
    got = {r.doc_id: r.s for r in quality.predict(d, t, ["doc_id"], name="s").collect()}
    assert len(got) == 303 and all((got[i] >= 0.5) == (i < 150) for i in range(0, 300, 5)) and all(0 <= s <= 1 for s in got.values())
    none = quality.train(d, labels.where("false"), F.lit(True))
    assert {r.score for r in quality.predict(d.limit(3), none, ["doc_id"]).collect()} == {0.5}


def test_language(spark):
    rnd = random.Random(6)
    en, de = ["the", "with", "thing", "that"], ["über", "nicht", "straße", "und"]
    rows = [(i, " ".join(rnd.choices(en if i % 2 else de, k=40)), "en" if i % 2 else "de", "s") for i in range(120)] + [(900, None, "en", None), (901, "", "en", None), (902, "12 34 !", "de", None), (903, "the " * 9000, None, None)]
    d = docs(spark, rows)
    net = langid.train(d, F.col("doc_id") % 3 != 1, epochs=4)
    got = {r.doc_id: r for r in langid.predict(d, net, ["doc_id"]).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(1, 120, 3)) and got[903].lang_pred == "en"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert langid.train(d.where("lang IS NULL"), F.lit(True)) is None
    assert {r.lang_pred for r in langid.predict(d.limit(4), None, ["doc_id"]).collect()} == {"und"}


def brute_windows(items, words, window):
    hit, found = set(), set()
    for item, seq in items:
        n = min(window, len(seq))
        wins = {tuple(seq[i : i + n]) for i in range(len(seq) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(item)
    return hit, found


def test_automaton():
    rnd = random.Random(1)
    for _ in range(400):
        items = [(k, [str(rnd.randrange(3)).encode() for _ in range(rnd.choice([0, 1, 2, 5, 14]))]) for k in range(4)]
        words = [str(rnd.randrange(4)).encode() for _ in range(40)]
        window = rnd.choice([2, 4, 10])
        hits, found = decontam.SuffixAutomaton(items, window).scan(words)
        assert ({p for s, e in hits for p in range(s, e)}, found) == brute_windows(items, words, window)


@pytest.mark.parametrize("most", [2_000_000, 10])
def test_decontamination(spark, most):
    rows = sample()
    items = [(1, rows[2][1]), (2, "Kan, LOST!"), (3, None), (None, "x y"), (4, rows[5][1]), (4, rows[5][1])]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_windows(docs(spark, rows), b, most_item_words=most).collect()
    words = lambda t: decontam.words_of((t or "").encode())
    known = [(str(i), words(t)) for i, t in items if i is not None and t]
    assert len(got) == len(rows)
    for r in got:
        hit, found = brute_windows(known, words(r.text), 10)
        assert {p for h in r._dc_hits for p in range(h.start, h.end)} == hit and set(r._dc_items) == found
    clean = decontam.remove_spans(docs(spark, [(1, "one two A b c D e f g h I J three four five six seven eight nine ten", None, None)]), spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")).first()
    assert clean.text == "one two  three four five six seven eight nine ten" and clean.size == 7


def test_token_counts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=bpe.default_model())
    rnd = random.Random(8)
    odd = ["a", "the", "▁", " ", "  ", "\n", "é", "ｆ", "</s>", "\x00", "中", "😀", "ing"]
    rows = [*sample(20), *[(2000 + i, "".join(rnd.choices(odd, k=rnd.randint(0, 40))), None, None) for i in range(300)]]
    got = bpe.count_tokens(docs(spark, rows)).collect()
    want = Counter((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t, _, _ in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want


def test_mixing(spark):
    rows = sample()
    got = mixing.mix_sources(docs(spark, rows), keep=["doc_id", "source"]).collect()
    total = sum(len((t or "").split()) for _, t, _, _ in rows)
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        x = by.setdefault(r.source, [0, r.target, r.source_size])
        x[0] += r.taken
    assert all(abs(taken - target) < 1 and target <= 3 * size + 1e-6 for taken, target, size in by.values())
    assert abs(sum(t for _, t, _ in by.values()) - total) < 1e-6
    again = mixing.mix_sources(docs(spark, rows[::-1]).repartition(3), keep=["doc_id", "source"]).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    clash = docs(spark, rows).withColumns({c: F.lit(-5) for c in ("target", "taken", "epochs", "source_size")})
    kept = mixing.mix_sources(clash, keep=clash.columns)
    assert kept.columns == clash.columns and kept.where("size = 7 AND taken = -5").count() == len(rows)
    both = mixing.mix_sources(clash, keep=clash.columns, prefix="m_").collect()
    assert sorted(r.m_taken for r in both) == sorted(r.taken for r in got)


def test_chat_round_trip(spark):
    t = chat.ChatTemplate()
    texts = ["", "</s>", "[INST] x [/INST]", "\\", "\\b\\.", "<<SYS>>\n", "a<s>b</s>", "[/ROLE] <\\.s>", "é\n\n", " "]
    rnd = random.Random(2)
    rows = [(k // 4, i, rnd.choice(["user", "assistant", "system", "tool", None, "[INST]"]), rnd.choice([*texts, None])) for k in range(200) for i in [k % 4]] + [(None, None, "user", "x"), (0, 1, "user", "tie"), (0, 1, "user", "tie")]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), t)
    want = {}
    for c, i, r, x in sorted(rows, key=lambda v: tuple((y is not None, y) if not isinstance(y, str) else (True, y) for y in (v[0], v[1], v[2] or "", v[3] or ""))):
        want.setdefault(c, []).append((r or "", x or ""))
    for r in out.select("*", chat.read_chat(F.col("formatted"), t).alias("back")).collect():
        assert [tuple(x) for x in r.back] == want[r.conv_id] and r.n_turns == len(want[r.conv_id])
        assert "".join(s.text for s in r.segments) == r.formatted
        assert [s.loss for s in r.segments].count(True) == sum(role == "assistant" for role, _ in want[r.conv_id])
    ok = chat.format_chat(spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "user", "u"), (2, 1, "user", "u")], "conv_id long, turn long, role string, text string")).orderBy("conv_id").collect()
    assert [(r.valid_order, r.complete, r.error_turn) for r in ok] == [(True, True, None), (False, False, 1)]


def test_warc(spark):
    rows = [(1, "http://a/ b", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "x\r\n\r\nWARC/1.1\r\n\r\n" * 3), (5, "http://e", "y"), (6, "u", "z" * 300000), (7, "u", "y"), (7, "u", "y")]
    path = new_path(spark, "warc")
    warc.write_warc(warc.read_arc(warc.pages_to_arc(spark.createDataFrame(rows, "page_id long, url string, html string"))), path, file_records=3)
    got = Counter((int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to), bytes(r.payload)) for r in warc.read_warc(spark, path).collect())
    want = Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        first = max(j for j, _, o in rows if (o or "") == (h or ""))
        want[(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first == i else "revisit", None if first == i else first, p if first == i else b"")] += 1
    assert got == want
    fused = new_path(spark, "warc")
    odd = [*rows, (None, "u", "y"), (None, "u", "unlike")]
    warc.write_warc(warc.pages_through_arc(spark.createDataFrame([(*r, "x") for r in odd], "page_id long, url string, html string, payload string"), part_bytes=5), fused, file_bytes=40)
    back = warc.read_warc(spark, fused).collect()
    assert Counter(r.page_id for r in back) == Counter(str(i) if i is not None else "" for i, *_ in odd)
    assert Counter((int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to), bytes(r.payload)) for r in back if r.page_id) == want
    assert {r.record_type for r in back if not r.page_id and r.payload_bytes == 1} == {"revisit"}
    none = new_path(spark, "warc")
    warc.write_warc(warc.read_arc(warc.pages_to_arc(spark.createDataFrame([], "page_id long, url string, html string"))), none)
    assert warc.read_warc(spark, none).count() == 0
    two = list(warc.parse_arc(warc.arc_version_block(2) + warc.arc_record(2, "9", "http://x", b"ab\n\ncd")))
    assert two[0]["payload"] == b"ab\n\ncd" and two[0]["Result-code"] == "200"
    with pytest.raises(ValueError):
        list(warc.parse_arc(warc.arc_version_block(1) + b"http://x 0.0.0.0 20200101000000 text/html 99\nshort"))


def test_empty_tables(spark):
    assert bpe.count_tokens(docs(spark, [])).count() == 0
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string, formatted string, n_turns int")).count() == 0
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontam.find_windows(docs(spark, []), items).count() == 0 and decontam.remove_spans(docs(spark, []), items).count() == 0
    assert decontam.remove_spans(docs(spark, [(1, "a b c d e f g", None, None)]), items.where("false")).first().text == "a b c d e f g"


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    """Each stage on a table with nulls, empty, long and repeated rows and clashing names, against a plain version of its rule."""
    import corpus_pipeline as C

    rows = sample()
    item = " ".join(f"item{i}" for i in range(12))
    rows += [(3000, f"{rows[2][1]} {item} and some more words than the item has {rows[7][1]}", "en", "s0"), (3001, f"{item} x", "en", "s1"), (3002, "12 34", "en", "s1")]
    rows = [r for k, r in enumerate(rows) for _ in range(1 + k % 2)]  # every other row twice
    d = docs(spark, rows).withColumns({"taken": F.lit(-1), "target": F.lit(-1)})
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 2)) for r in rows if r[0] is not None], "doc_id long, quality int").dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/labels.parquet")
    at = f"{tmp_path}"
    plain = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    every = Counter((i, t) for i, t, _, _ in rows)

    # language: the operator's verdict, text by text
    net = langid.train(d, F.lit(True))
    tell = langid.Predictor(net)
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert plain(C.language(spark, d, at)) == Counter({k: n for k, n in every.items() if letters(k[1]) and tell([k[1].encode()]).max() >= C.LEAST_LANGUAGE_SCORE})
    # quality: the same
    trees = quality.train(d, spark.read.parquet(f"{at}/labels.parquet"), F.lit(True))
    good = lambda t: trees.score(quality.statistics([(t or "").encode()]))[0] >= C.LEAST_QUALITY_SCORE
    assert plain(C.good_quality(spark, d, at)) == Counter({k: n for k, n in every.items() if good(k[1])})
    # near duplicates: one row of each component of rows, with the smallest id
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t, _, _ in rows]
    of = link_components(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    ids = {}
    for k, c in of.items():
        ids.setdefault(c, []).append((rows[k][0] is None, rows[k][0] or 0))
    got = C.near_duplicates(spark, d, at)
    assert Counter(r.doc_id for r in got.collect()) == Counter(None if x[0] else x[1] for x in (min(v) for v in ids.values()))
    # decontamination
    words = lambda t: decontam.words_of((t or "").encode())
    clean = Counter()
    for (i, t), n in every.items():
        hit, _ = brute_windows([("1", words(item))], words(t), 10)
        if 2 * len(hit) <= max(1, len(words(t))):
            clean[(i, tuple(w for p, w in enumerate(words(t)) if p not in hit))] += n
    assert Counter((r.doc_id, tuple(words(r.text))) for r in C.decontamination(spark, d, at).collect()) == clean
    # mixing: budgets cut sources in the order of the keys
    got = C.mixed(spark, d, at)
    assert got.columns == [*d.columns, "source_size", "epochs"] and got.where("taken <> -1").count() == 0
    told = mixing.mix_sources(d, keep=["doc_id", "text", "source"], prefix="m_").collect()
    assert plain(got) == Counter((r.doc_id, r.text) for r in told if r.m_taken > 0)
    for source in {r[3] for r in rows}:
        some = [r for r in told if r.source == source]
        key = lambda r: (hashlib.md5(((str(r.doc_id) if r.doc_id is not None else hashlib.md5(r.text.encode()).hexdigest()) + "#mix").encode()).hexdigest(), r.doc_id or 0, r.m_size)
        budget, whole = int(some[0].m_target), sum(len((r.text or "").split()) for r in some)
        left, want = budget % whole if whole else 0, []
        for r in sorted(some, key=key):
            want.append((r.doc_id, (budget // whole if whole else 0) * r.m_size + min(r.m_size, left)))
            left -= min(r.m_size, left)
        if len({key(r) for r in some}) == len(some):
            assert Counter((r.doc_id, r.m_taken) for r in some) == Counter(want)
        assert sum(r.m_taken for r in some) == sum(w for _, w in want)
    empty = docs(spark, [])
    for name, stage in C.STAGES:
        assert stage(spark, empty, at).count() == 0, name


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline as C

    d, sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "/root/testdata/sf0.001"
    out = {}
    for name, stage in C.STAGES:
        new = C.written(stage(spark, d, sf), name)[0]
        assert name == "mixing" or new.columns == d.columns
        out[name], d = (d.count(), new.count()), new
    assert all(a >= b > 0 for a, b in out.values()) and out["language"][1] > 0.95 * out["language"][0]


def test_pipeline_keeps_one_of_each_group(spark):
    """Rows repeated in full, null ids, and an id with two texts of which one is a copy of a smaller id's."""
    import corpus_pipeline as C

    t = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdef"]
    rows = [(1, t[0], "en", "s"), (5, t[0], "en", "s"), (5, t[1], "en", "s"), (6, t[2], "en", "s"), (6, t[2], "en", "s"), (6, t[2], "en", "s"), (None, t[3], "en", "s"), (None, t[3], "en", "s"), (None, t[4], "en", "s"), (9, t[4] + " tail", "en", "s"), (8, t[5] + " tail", "en", "s"), (7, t[5], "en", "s")]
    for parts in (1, 4):
        got = C.near_duplicates(spark, docs(spark, rows).repartition(parts), "")
        assert got.columns == docs(spark, []).columns
        assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, t[0]), (5, t[1]), (6, t[2]), (None, t[3]), (9, t[4] + " tail"), (7, t[5])])
    assert C.near_duplicates(spark, docs(spark, []), "").count() == 0


def test_pipeline_without_languages_keeps_texts_with_letters(spark):
    import corpus_pipeline as C

    rows = [(1, "some text", None, "s"), (2, "12 !", None, "s"), (3, None, None, "s"), (4, "", None, "s"), (None, "é", None, None)]
    for extra in ([], [(5, "", "en", "s")]):  # no label at all; a label of a text that teaches nothing
        got = C.language(spark, docs(spark, rows + extra), "")
        assert got.columns == docs(spark, []).columns and {r.text for r in got.collect()} == {"some text", "é"}
