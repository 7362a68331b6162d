"""The lexicon automaton against edit distances, contexts, and documents held out of learning."""

import random

import pytest
from pyspark.sql import functions as F

from rasterlane.llm import toxicity as tox
from rasterlane.llm.toxicity import Term

SCHEMA = "doc_id long, text string, lang string, y int, term string, score double, toxic int"


def distance(a, b):
    """Insertions, deletions, substitutions and swaps of neighbours, none of them edited again."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@pytest.mark.parametrize("seed", range(6))
def test_automaton_equals_edit_distances(seed):
    rnd = random.Random(seed)
    make = lambda n: "".join(rnd.choice("abc") for _ in range(n))
    terms = {make(rnd.randint(3, 8)): (rnd.random() < 0.4, rnd.randint(0, 2)) for _ in range(12)}
    terms = tuple(Term((t, stem, e, 1.0)) for t, (stem, e) in terms.items())
    auto = tox.LexiconAutomaton(terms)
    for _ in range(400):
        word = make(rnd.randint(0, 10)) + rnd.choice(["", "", "z"])
        want = {}
        for i, (t, stem, most, _) in enumerate(terms):
            e = distance(word, t)
            if stem:
                e = min(distance(word[:k], t) for k in range(len(word) + 1))
            if word.startswith(t):
                e = 0
            if e <= most:
                want[i] = e
        assert auto.matches(word) == want


def test_forms_and_contexts():
    m = tox.Matcher((Term(("idiot", False, 1, 1.0)), Term(("worthless", False, 2, 1.0))), frozenset({"idiom"}))
    weights = lambda t: [round(w, 4) for _, _, w, _ in m.occurrences(t)]
    assert weights("an Idiot, idiots! and a worthles wrothles fool") == [1, 1, 0.75, 0.6]
    assert weights("1d1ot id!ot idiooooot idiom idol") == [0.75, 0.75, 0.75]
    assert weights("you idiot") == [1.25]
    assert weights('they wrote "what an idiot" there') == weights("the term idiot there") == [0.3]
    assert weights('"fine" she laughed at an idiot " end') == [1.0]
    assert weights("") == weights(" \n") == []


def test_pieces_keep_their_windows(monkeypatch):
    m = tox.Matcher((Term(("idiot", False, 1, 1.0)),))
    text = " ".join(random.Random(1).choices(["idiot", "you", '"some', 'thing"', "word", "idoit", "plain", "x"], k=400))
    whole = [*m.occurrences(text)]
    monkeypatch.setattr(tox, "PIECE", 60)
    assert [*m.occurrences(text)] == whole and len(whole) > 50


def corpus(n=600):
    rnd = random.Random(2)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru") for b in ("n", "st", "ve", "x") for c in ("ta", "el", "io")]
    rows, labels = [], []
    for i in range(n):
        t, bad = rnd.choices(words, k=rnd.randint(5, 60)), i % 6 == 0
        for _ in range(rnd.randint(1, 3) if bad else 0):
            t.insert(rnd.randrange(len(t)), rnd.choice(["grobnik", "zwerchling"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    return rows, labels


def test_learned_lexicon(spark):
    rows, labels = corpus()
    extra = [(9000, None), (9001, ""), (9002, "kanta " * 200_000 + "grobnik"), (9003, "you gorbnik you grobnk"), (9004, "the term grobnik in kanta"), (None, "grobnik kanta"), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "en", 1, "x", 0.5, 3) for i, t in rows + extra], SCHEMA)
    told = spark.createDataFrame(labels + [(9000, None), (None, 1), (0, 0), (77777, 1)], "doc_id long, toxic int")
    model = tox.train(docs, told, F.col("doc_id") % 4 != 2)
    assert {t[0] for t in model.terms} == {"grobnik", "zwerchling"} or {t[0][:7] for t in model.terms} == {"grobnik", "zwerchl"}
    got = tox.predict(docs, model, docs.columns, name="_s").collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r._s <= 1 for r in got)
    score = {r.doc_id: r._s for r in got}
    held = [i for i, _ in rows if i % 4 == 2]
    assert all((score[i] >= 0.3) == (i % 6 == 0) for i in held)
    assert score[9000] == score[9001] < 0.3 and score[9002] >= 0.3 and score[9003] >= 0.3 and score[9004] < score[None] and score[None] >= 0.3


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "en", 1, "x", 0.5, 3), (None, None, None, None, None, None, None)], SCHEMA)
    for labels, want in (([], 0.0), ([(1, 1)], 1.0), ([(1, 0)], 0.0), ([(1, 1), (2, 0)], 0.0)):
        model = tox.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
        assert {round(r._s, 3) for r in tox.predict(docs, model, ["doc_id"], name="_s").collect()} == {want}
    empty = docs.where("false")
    assert tox.predict(empty, tox.train(empty, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), F.lit(True)), empty.columns, name="_s").count() == 0


def test_query_holds_out_well(spark):
    sf = "/root/testdata/sf0.01"
    df = tox.op13_toxicity(spark, sf)
    assert df.columns == ["doc_id", "held_out", "score", "predicted"]
    got = df.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("predicted", "toxic").collect()
    hit, told, real = (sum(f(r) for r in got) for f in (lambda r: r.predicted and r.toxic, lambda r: r.predicted, lambda r: r.toxic))
    assert hit >= 0.9 * told and hit >= 0.4 * real  # the other languages' terms are too rare in these 51 toxic documents
