"""Toxicity by Levenshtein automata over a lexicon that is learned from labels.

Lexicon: among the words, and beginnings of words of four letters on, of a bounded sample of labelled documents, those are taken
that mark toxic documents by a likelihood ratio above what chance gives for so many candidates; the best of those that begin one
another stays. Further passes look at toxic documents without any term so far. Matching: the terms form a trie; the product of
the trie and a Levenshtein automaton (insertion, deletion, substitution, swap of neighbours) is walked as one automaton whose
states are made when first reached, so an ordinary word is left after a few letters. Terms of 4 letters on allow one error, of
8 on two. Inexact forms that occur in clean documents of the sample are ordinary words; forms seen once say how many are still
unseen, and terms allow fewer errors where those would touch over 0.2 % of clean documents in all.

Score: an occurrence counts by its term's odds, its errors and its window of six tokens on either side: within quotation marks or after words of
reporting it counts QUOTED times, with an address of somebody DIRECTED times. A logistic curve over the greatest weight and the
sum of weights is fitted to the same sample, with classes weighed as in all labels.

Bounds: `most_rows` labelled documents of each class (by a hash of their ids) and `most_terms` terms teach; both are parameters.

Defined cases: null and empty texts have no occurrence and get the curve's least value; without labels scores are 0, with
one class alone they are that class's share; null labels teach nothing, of an id's labels the greatest counts, and of rows that
share an id the least text teaches; of rows that share the least hash of their five-word shingles (near copies) one teaches; texts of any length are read whole, in pieces with their windows; repeated rows are each
scored; columns pass through `keep`; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bound_batches, crc_mod, drop_path, table, utf8_list, written

MOST_BYTES = 2_000_000
WINDOW = 6  # tokens on either side
BY_ERRORS = (1.0, 0.75, 0.6)
QUOTED, DIRECTED = 0.3, 1.25
REPORTING = frozenset("said says call called calls calling quote quoted word words term insult insults wrote writes slur sagte sagt nannte wort dit disait mot écrit dijo dice palabra llamó".split())
ADDRESSED = frozenset("you your you're youre yourself u ur du dich dir dein deine ihr euch tu toi ton vous votre tú ti tus usted eres".split())
OPENING, CLOSING = "\"“„«‹‘", "\"”“»›’"
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")
LEAST_STEM, MOST_STEM, LEAST_WORD, MOST_WORD = 4, 12, 3, 24
KNOWN = 400_000  # tokens a worker remembers as ordinary
PIECE = 2_000_000  # characters read at once
_APART = re.compile(r"[^\w*@$!|'’]+")
_RUNS = re.compile(r"(.)\1{2,}")
_EDGE = "*@!|'’_"


class Term(tuple):
    """(letters, is a stem, errors allowed, weight)"""


class LexiconAutomaton:
    """All words within the allowed errors of a term, as one automaton over the terms' trie. Its states are sets of (node, errors,
    letter that a swap still waits for); they are numbered when first reached."""

    def __init__(self, terms: tuple):
        self.terms = terms
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most = [0]
        for i, (letters, _, errors, _) in enumerate(terms):
            node = 0
            self.most[0] = max(self.most[0], errors)
            for c in letters:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.next[node][c]
                self.most[node] = max(self.most[node], errors)
            self.ends[node].append(i)
        self.alphabet = {c for n in self.next for c in n}
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.passing: list[tuple] = []  # (term, errors) accepted whatever follows
        self.final: list[tuple] = []  # (term, errors) accepted where the word ends
        self.start = self._state({(0, 0, "")})

    def _state(self, members: set) -> int:
        """The number of a state, with what letters left out of the word lead to."""
        todo = list(members)
        while todo:
            node, e, wait = todo.pop()
            if not wait:
                for child in self.next[node].values():
                    if e + 1 <= self.most[child] and (new := (child, e + 1, "")) not in members:
                        members.add(new)
                        todo.append(new)
        key = frozenset(members)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            at = [(t, e) for node, e, wait in key if not wait for t in self.ends[node] if e <= self.terms[t][2]]
            self.passing.append(tuple((t, e) for t, e in at if self.terms[t][1] or e == 0))
            self.final.append(tuple(at))
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        members = set()
        for node, e, wait in self.states[state]:
            if wait:
                if c == wait:
                    members.add((node, e, ""))
                continue
            more = e + 1
            if more <= self.most[node]:
                members.add((node, more, ""))  # c is one letter too many
            for a, child in self.next[node].items():
                if a == c:
                    members.add((child, e, ""))
                elif more <= self.most[child]:
                    members.add((child, more, ""))
                if (then := self.next[child].get(c)) is not None and a != c and more <= self.most[then]:
                    members.add((then, more, a))
        return self._state(members) if members else -1

    def matches(self, word: str) -> dict[int, int]:
        """The terms that the word is, or begins with if they are stems or without an error, and the fewest errors."""
        found: dict[int, int] = {}
        state, alphabet = self.start, self.alphabet
        for c in word:
            moves = self.moves[state]
            c = c if c in alphabet else ""
            to = moves.get(c)
            if to is None:
                to = moves[c] = self._move(state, c)
            if to < 0:
                return found
            state = to
            for t, e in self.passing[state]:
                if e < found.get(t, 9):
                    found[t] = e
        for t, e in self.final[state]:
            if e < found.get(t, 9):
                found[t] = e
        return found


class Matcher:
    """Terms in tokens of texts, and the weights of their occurrences."""

    def __init__(self, terms: tuple, ordinary: frozenset = frozenset()):
        self.automaton, self.ordinary = LexiconAutomaton(terms), ordinary
        self.clean: set[str] = set()
        self.hits: dict[str, dict] = {}

    def of_token(self, token: str) -> dict[int, tuple[int, str]]:
        """Term -> (errors, form) for the words of a token between white space."""
        found: dict[int, tuple[int, str]] = {}
        for part in _APART.split(token):
            part = part.strip(_EDGE)
            forms = {part: 0}
            if not part.isalpha():
                forms.setdefault(part.translate(LOOKALIKE), 1)
            for f in [*forms]:
                if _RUNS.search(f):
                    forms.setdefault(_RUNS.sub(r"\1", f), 1)
            for form, least in forms.items():
                for t, e in self.automaton.matches(form).items() if form else ():
                    e = max(e, least)
                    if e <= self.automaton.terms[t][2] and (e == 0 or part not in self.ordinary) and e < found.get(t, (9,))[0]:
                        found[t] = (e, part)
        return found

    def tokens_with_terms(self, tokens: set[str]) -> dict[str, dict]:
        if len(self.clean) > KNOWN:
            self.clean.clear()
        if len(self.hits) > KNOWN:
            self.hits.clear()
        out = {t: self.hits[t] for t in tokens & self.hits.keys()}
        for t in tokens - self.clean - out.keys():
            if got := self.of_token(t):
                out[t] = got
                if len(t) <= 64:
                    self.hits[t] = got
            elif len(t) <= 64:
                self.clean.add(t)
        return out

    def occurrences(self, text: str) -> Iterator[tuple[int, int, float, str]]:
        """(term, errors, weight, form) of each occurrence."""
        before: list[str] = []
        piece = None
        for after in [*_pieces(text), None] if len(text) <= PIECE else (*_pieces(text), None):
            if piece is not None:
                ahead = (after or [])[: WINDOW + 1]
                got = self.tokens_with_terms(set(piece))
                if got:
                    whole, k = before + piece + ahead, len(before)
                    for i, token in enumerate(piece, k):
                        if token in got:
                            where = in_context(whole, i)
                            for t, (e, form) in got[token].items():
                                yield t, e, self.automaton.terms[t][3] * BY_ERRORS[e] * where, form
                before = (before + piece)[-WINDOW - 1 :]
            piece = after

    def features(self, text: str) -> tuple[float, float]:
        """The greatest weight of an occurrence, and the logarithm of one and the sum of weights."""
        most = total = 0.0
        for _, _, w, _ in self.occurrences(text):
            most, total = max(most, w), total + w
        return most, math.log1p(total)


def _pieces(text: str) -> Iterator[list[str]]:
    """The lower-cased tokens of a text, by pieces that end between tokens."""
    start = 0
    while start < len(text):
        m = re.compile(r"\s").search(text, start + PIECE)
        end = m.start() if m else len(text)
        yield text[start:end].lower().split()
        start = end


def in_context(tokens: list[str], i: int) -> float:
    """How much an occurrence at token i counts."""
    left, own, right = tokens[max(0, i - WINDOW) : i], tokens[i], tokens[i + 1 : i + 1 + WINDOW]
    opened = any(c in own[:1] for c in OPENING)
    for t in [] if opened else reversed(left):
        if t[-1:] in CLOSING or t.rstrip(".,;:!?")[-1:] in CLOSING:
            break
        if t[:1] in OPENING:
            opened = True
            break
    closed = opened and any(t.rstrip(".,;:!?")[-1:] in CLOSING for t in [own, *right])
    if closed or any(t.strip(".,;:!?\"'") in REPORTING for t in left[-3:]):
        return QUOTED
    return DIRECTED if any(t.strip(".,;:!?\"'") in ADDRESSED for t in left + right) else 1.0


@lru_cache(maxsize=2)
def matcher(terms: tuple, ordinary: frozenset) -> Matcher:
    return Matcher(terms, ordinary)


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in (part for whole in batches for part in blocks(whole, column, MOST_BYTES)):
        yield batch, [(t or b"").decode(errors="replace") for t in utf8_list(batch.column(batch.schema.get_field_index(column)))]


def _with_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hash of five words in a row, which near copies mostly share."""
    for batch, texts in _texts(batches, "text"):
        least = []
        for text in texts:
            w = text.lower().split()
            least.append(min(zlib.crc32(" ".join(w[i : i + 5]).encode()) for i in range(max(1, len(w) - 4))))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], [*batch.schema.names, "sketch"])


def candidates(sample: DataFrame, terms: tuple, most: int, factor: float) -> list[tuple[str, bool, float]]:
    """(letters, mostly a whole word, logarithm of odds) of what marks toxic documents that hold none of the terms so far, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = matcher(terms, frozenset())
        for batch, texts in _texts(batches, "text"):
            n = [Counter(), Counter()]
            for y, text in zip(batch.column(0).to_pylist(), texts):
                words = {w for piece in _pieces(text) for t in set(piece) for p in _APART.split(t) if LEAST_WORD <= len(w := p.strip(_EDGE)) and not w.isdigit()}
                if y and terms and any(has.tokens_with_terms(words)):
                    continue
                n[y].update({w[:k] for w in words for k in range(LEAST_STEM, min(len(w), MOST_STEM) + 1)} | {w + " " for w in words if len(w) <= MOST_WORD} | {""})
            keys = [*(n[0].keys() | n[1].keys())]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([n[1][k] for k in keys], pa.int64()), pa.array([n[0][k] for k in keys], pa.int64())], ["term", "toxic", "clean"])

    found = sample.select("y", "text").mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    found, path = written(found, "terms")
    total = found.where("term = ''").first()  # every document counts there
    if not total or not total.toxic or not total.clean:
        drop_path(sample.sparkSession, path)
        return []
    n1, n0 = float(total.toxic), float(total.clean)
    a, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    seen = a + c
    log = lambda x, of: F.when(x > 0, x * F.log(x / of)).otherwise(0.0)
    ratio = 2 * (log(a, seen * n1 / (n1 + n0)) + log(c, seen * n0 / (n1 + n0)) + log(n1 - a, (n1 + n0 - seen) * n1 / (n1 + n0)) + log(n0 - c, (n1 + n0 - seen) * n0 / (n1 + n0)))
    odds = F.log((a + 0.5) / (n1 + 1)) - F.log((c + 0.5) / (n0 + 1))
    tried = found.where("toxic + clean >= 3").count()
    best = found.where("term <> '' AND toxic >= 3").withColumns({"ratio": ratio, "odds": odds}).where((F.col("odds") >= math.log(20)) & (F.col("ratio") >= factor + 2 * math.log(max(tried, 2))))
    rows = best.orderBy(F.desc("ratio"), F.desc(F.length("term")), "term").limit(most).collect()
    drop_path(sample.sparkSession, path)
    words = {r.term[:-1]: r.toxic for r in rows if r.term.endswith(" ")}
    return [(t, 2 * words.get(t, 0) > r.toxic, r.odds) for r in rows if len(t := r.term.rstrip(" ")) >= (LEAST_WORD if r.term.endswith(" ") else LEAST_STEM)]


def errors_allowed(letters: str) -> int:
    return 0 if len(letters) < 4 else 1 if len(letters) < 8 else 2


def learned_terms(sample: DataFrame, most_terms: int) -> tuple:
    terms: dict[str, Term] = {}
    for factor in (10.0, 4.0, 4.0, 4.0):
        had = len(terms)
        for letters, word, odds in candidates(sample, tuple(terms.values()), 20 * most_terms, factor):
            if len(terms) < most_terms and not any(letters.startswith(t) or t.startswith(letters) for t in terms):
                terms[letters] = Term((letters, not word, errors_allowed(letters) if word else min(1, errors_allowed(letters)), odds))
        if len(terms) == had and factor < 10:
            break
    most = max((t[3] for t in terms.values()), default=1.0)
    return tuple(Term((*t[:3], t[3] / most)) for t in terms.values())


def calibrated(sample: DataFrame, terms: tuple, most_false: float = 0.002) -> tuple[tuple, frozenset]:
    """Terms with the errors that clean documents allow, and the ordinary words that look like terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Matcher(terms)
        for batch, texts in _texts(batches, "text"):
            rows = [(t, e, f) for y, text in zip(batch.column(0).to_pylist(), texts) if not y for t, e, f in {(t, e, f) for t, e, _, f in find.occurrences(text) if e}]
            rows = [(t, e, f, n) for (t, e, f), n in Counter(rows).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64()))], ["term", "errors", "form", "n"])

    forms = sample.select("y", "text").mapInArrow(run, "term int, errors int, form string, n long").groupBy("term", "errors", "form").agg(F.sum("n").alias("n"))
    forms, path = written(forms, "forms")
    clean = sample.where("y = 0").count()
    once = {(r.term, r.errors): r.n for r in forms.where("n = 1").groupBy("term", "errors").agg(F.count("*").alias("n")).collect()}
    # cheapest first, until what is expected of unseen forms makes up most_false of clean documents
    unseen = sorted((sum(once.get((i, k), 0) for k in range(1, e + 1)), i, e) for i, t in enumerate(terms) for e in range(1, t[2] + 1))
    errors, spent = [0] * len(terms), [0] * len(terms)
    for n, i, e in unseen:
        if sum(spent) - spent[i] + n <= most_false * clean:
            errors[i], spent[i] = max(errors[i], e), max(spent[i], n)
    out = [Term((t[0], t[1], e, t[3])) for t, e in zip(terms, errors)]
    kept = [i for i, t in enumerate(out) if t[2]]
    forms_of = forms.where(F.col("term").isin(kept)).select("form").distinct().orderBy("form").limit(100_000) if kept else None
    ordinary = frozenset(r.form for r in forms_of.collect()) if kept else frozenset()
    drop_path(sample.sparkSession, path)
    return tuple(out), ordinary


class ToxicityModel:
    def __init__(self, terms: tuple = (), ordinary: frozenset = frozenset(), curve: tuple = (-9.0, 0.0, 0.0)):
        self.terms, self.ordinary, self.curve = terms, ordinary, curve

    def score(self, text: str) -> float:
        most, total = matcher(self.terms, self.ordinary).features(text) if text and self.terms else (0.0, 0.0)
        z = self.curve[0] + self.curve[1] * most + self.curve[2] * total
        return 0.0 if z <= -700 else 1 / (1 + math.exp(-z))


def fitted_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> tuple[float, float, float]:
    """Weighted logistic regression; slopes are not below 0."""
    design, b = np.c_[np.ones(len(x)), x], np.array([-3.0, 1.0, 1.0])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -500, 500)))
        gradient = design.T @ (weight * (p - y)) + ridge * np.array([0, *b[1:]])
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1e-6, ridge, ridge])
        step = np.linalg.solve(hessian, gradient)
        b = b - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        b[1:] = np.maximum(0, b[1:])
        if np.abs(step).max() < 1e-9:
            break
    return tuple(b.tolist())


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", most_rows: int = 4000, most_terms: int = 400) -> ToxicityModel:
    """may_learn: a condition on id_col of the labels."""
    spark = docs.sparkSession
    bound_batches(spark)
    known = labels.where(may_learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_x_id")).agg(F.max((F.col(label_col).cast("int") > 0).cast("int")).alias("y"))
    known = known.withColumn("_x_h", F.xxhash64(F.col("_x_id"), F.lit("toxic")))
    picked = known.where("y = 1").orderBy("_x_h", "_x_id").limit(most_rows).unionByName(known.where("y = 0").orderBy("_x_h", "_x_id").limit(most_rows))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1) or not counts.get(0):
        return ToxicityModel(curve=(9.0 if counts.get(1) else -1000.0, 0.0, 0.0))
    rows = docs.select(F.col(id_col).alias("_x_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "_x_id")
    rows = rows.groupBy("_x_id").agg(F.min("y").alias("y"), F.min("text").alias("text"))
    # near copies would make the words of one document look like many documents' words: one of each sketch teaches
    rows = rows.mapInArrow(_with_sketch, f"{rows.schema['_x_id'].simpleString().replace(':', ' ')}, y int, text string, sketch long")
    sample, path = written(rows.groupBy("sketch", "y").agg(F.min_by("text", "_x_id").alias("text")), "labelled")
    terms, ordinary = calibrated(sample, learned_terms(sample, most_terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = matcher(terms, ordinary)
        for batch, texts in _texts(batches, "text"):
            got = [find.features(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())], ["y", "most", "total"])

    got = sample.select("y", "text").mapInArrow(run, "y int, most double, total double").toPandas().sort_values(["y", "most", "total"])  # 2 x most_rows at most
    drop_path(spark, path)
    y = got["y"].to_numpy(np.float64)
    if not 0 < y.sum() < len(y):
        return ToxicityModel(terms, ordinary, (-1000.0, 0.0, 0.0))
    share = counts[1] / (counts[0] + counts[1])
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    return ToxicityModel(terms, ordinary, fitted_curve(got[["most", "total"]].to_numpy(), y, weight))


def predict(docs: DataFrame, model: ToxicityModel, keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns `keep` and the score (double) under `name`, which must not be among them."""
    bound_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_x_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches, "_x_text"):
            k = batch.num_columns - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array([sent.value.score(t) for t in texts], pa.float64())], [*batch.schema.names[:k], name])

    return rows.mapInArrow(run, docs.select(*keep).withColumn(name, F.lit(0.0)).schema)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = predict(docs.select("doc_id", "text", held_out.alias("held_out")), model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
