"""Toxicity: a learned lexicon, its misspellings by Levenshtein automata, and context.

The lexicon is learned from labelled rows: beginnings of words that toxic documents have far
more often than clean ones. It is held as a trie. A word hits a term that begins it; words
near a term are found by running the word's Levenshtein automaton (insertions, deletions,
substitutions and swaps of neighbours) over the trie of the terms that stand as words of their
own. Each hit, misspelled or not, is judged in a window of words: within quotation marks that
open before and close after it, or just after a word of reporting, it counts as quoted, not as
abuse. A logistic model over the weights of a document's bare, quoted and misspelled terms
gives the score.

Fitting takes at most Fit.toxic + Fit.clean labelled rows (a documented bound; the rows with
the smallest hashes of their ids); near copies among them, which share the three smallest
hashes of their words, count once. Counts and features of these rows are taken in parallel;
the driver gets the counts of the terms that could be chosen and four numbers a row. Scoring
takes every row.

Null and empty texts, texts of any length without hits, get the model's base rate. Ids that have
several labels count as toxic if one says so, and of several texts the least one is fitted;
null labels and ids are left out; repeated rows are scored each. Without any toxic label nothing
is learned and every score is the base rate. Empty tables give no rows. Columns of any name pass
through `keep_clean`; `score` reads doc_id and text only.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_arrow, slices, spread


@dataclass(frozen=True)
class Fit:
    """What fitting takes for a term, and how many labelled rows it takes at most.

    A term begins `shortest` to `longest` characters of a word, is in `least` and in a `share`
    of the toxic documents at least, and its log odds are `odds` at least. Its misspellings
    (one edit) count if it has `fuzzy` characters or more and mostly stands as a word of its own.
    """

    toxic: int = 4000
    clean: int = 8000
    shortest: int = 3
    longest: int = 12
    least: int = 4
    share: float = 0.01
    odds: float = 3.5
    fuzzy: int = 5


#: Words on either side of a hit that are its context; the weights of one kind of hits count up to MOST.
WINDOW, MOST = 8, 8.0
OPEN = CLOSE = "\"'“”„«»‘’‹›"
#: Beginnings of words that an apostrophe shortens: they open no quotation.
SHORTENED = ("tis", "twas", "twere", "twill", "em", "cause", "til", "n", "bout", "round", "s", "t")
#: Words of reporting in four languages, a choice of this module.
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes quoting term word words insult insults slur alleged reportedly dit écrit appelé mot mots insulte cite cité sagte sagt schrieb nannte wort wörter zitat zitiert beleidigung dijo dice escribió llamó palabra palabras insulto cita".split())
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_KNOWN = 200_000
SHORTEST = Fit.shortest


def core(word: str) -> str:
    """A word without the signs around it."""
    return word if word.isalnum() else _EDGE.sub("", word)


class Trie:
    """Terms by their characters; "" holds a term's number."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for i, t in enumerate(terms):
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = i

    def beginning(self, word: str) -> int | None:
        """The longest term that begins word."""
        node, found = self.root, None
        for c in word:
            node = node.get(c)
            if node is None:
                break
            found = node.get("", found)
        return found


State = tuple[tuple[int, ...], tuple[int, ...], str]


class Automaton:
    """The Levenshtein automaton of a word, with swaps: a state is a row of edit counts, the row
    before it and the last character; counts are capped at edits + 1."""

    def __init__(self, word: str, edits: int):
        self.word, self.edits = word, edits

    def start(self) -> State:
        row = tuple(min(i, self.edits + 1) for i in range(len(self.word) + 1))
        return row, (self.edits + 1,) * len(row), ""

    def step(self, state: State, c: str) -> State:
        last, before, was = state
        cap = self.edits + 1
        row = [min(last[0] + 1, cap)]
        for i, w in enumerate(self.word):
            least = min(row[i] + 1, last[i + 1] + 1, last[i] + (w != c), cap)
            if i and w == was and self.word[i - 1] == c:
                least = min(least, before[i - 1] + 1)
            row.append(least)
        return tuple(row), last, c

    def alive(self, state: State) -> bool:
        return min(min(state[0]), min(state[1]) + 1) <= self.edits

    def accepts(self, state: State) -> bool:
        return state[0][-1] <= self.edits

    def meet(self, trie: Trie) -> tuple[int, int] | None:
        """(edits, number) of the nearest term of the trie that the automaton accepts."""
        best, stack = None, [(trie.root, self.start())]
        while stack:
            node, state = stack.pop()
            for c, below in node.items():
                if c == "":
                    if self.accepts(state) and (best is None or (state[0][-1], below) < best):
                        best = (state[0][-1], below)
                    continue
                after = self.step(state, c)
                if self.alive(after):
                    stack.append((below, after))
        return best


class Lexicon:
    """terms: (text, weight, whether its misspellings count)."""

    def __init__(self, terms: list[tuple[str, float, bool]], known: Iterable[str]):
        self.terms = terms
        self.trie = Trie([t for t, _, _ in terms])
        fuzzy = [(t, i) for i, (t, _, near) in enumerate(terms) if near]
        self.fuzzy = Trie([t for t, _ in fuzzy])
        self.number = [i for _, i in fuzzy]
        # One edit, a swap too, leaves so many of a term's first or last characters as they were.
        self.halves: dict[int, set[str]] = {}
        for t, _ in fuzzy:
            h = (len(t) - 1) // 2
            self.halves.setdefault(h, set()).update(("<" + t[:h], t[-h:] + ">"))
        self.known = frozenset(known)
        self.clean: set[str] = set()  # words that are known to hit nothing
        self.cache: dict[str, tuple[int, bool]] = {}

    def hits(self, words: set[str]) -> dict[str, tuple[int, bool]]:
        """(term, whether misspelled) of those of the words, as they stand in the text, that hit one."""
        if len(self.clean) + len(self.cache) > _KNOWN:
            self.clean.clear(), self.cache.clear()
        found = {}
        for w in words - self.clean:
            h = self.cache.get(w) or self._hit(core(w))
            if h is None:
                self.clean.add(w)
            else:
                found[w] = self.cache[w] = h
        return found

    def _hit(self, w: str) -> tuple[int, bool] | None:
        if len(w) < SHORTEST:
            return None
        if (i := self.trie.beginning(w)) is not None:
            return i, False
        parts = re.split(r"[\W_]+", w)
        if len(parts) > 1:
            for p in parts:
                if (i := self.trie.beginning(p)) is not None:
                    return i, False
        if w in self.known or not any(2 * h <= len(w) <= 2 * h + 3 and ("<" + w[:h] in x or w[-h:] + ">" in x) for h, x in self.halves.items()):
            return None
        near = Automaton(w, 1).meet(self.fuzzy)
        return None if near is None else (self.number[near[1]], True)


def _opens(word: str) -> bool:
    return word[0] in OPEN and not (word[0] in "'\u2019" and core(word) in SHORTENED)


def _closes(word: str) -> bool:
    end = word.rstrip(".,;:!?")[-1:]
    return bool(end) and end in CLOSE


def _quoted(words: list[str], i: int) -> bool:
    """Whether the word at i stands in quotation marks that open and close in its window, or is reported."""
    if any(core(w) in REPORTING for w in words[max(0, i - 3) : i]):
        return True
    opened = False
    for w in words[max(0, i - WINDOW) : i]:
        opened = (opened or _opens(w)) and not _closes(w)
    if not (opened or _opens(words[i])):
        return False
    for k in range(i, min(len(words), i + WINDOW + 1)):
        if k > i and _opens(words[k]):
            return False
        if _closes(words[k]):
            return True
    return False


def features(text: str, lexicon: Lexicon) -> np.ndarray:
    """1 and the summed weights of the terms hit bare, quoted (only) and misspelled (only), up to MOST each."""
    words = text.lower().split()
    bare, quoted, misspelled = {}, {}, {}
    for w, (term, wrong) in lexicon.hits(set(words)).items():
        spots = [i for i, x in enumerate(words) if x == w]
        where = quoted if all(_quoted(words, i) for i in spots) else misspelled if wrong else bare
        where[term] = lexicon.terms[term][1]
    for less, more in ((misspelled, bare), (quoted, bare), (quoted, misspelled)):
        for k in [k for k in less if k in more]:
            del less[k]
    return np.array([1.0, *(min(MOST, sum(x.values())) for x in (bare, quoted, misspelled))])


#: What the logistic model's weights are drawn to, where labels say little.
PRIOR = np.array([-2.5, 1.2, 0.5, 0.9])


def _cores(text: str, fit: Fit) -> set[str]:
    return {c for w in set(text.lower().split()) if len(c := core(w)) >= fit.shortest}


def _key(text: str, fit: Fit) -> str:
    """Copies, near ones too, would make their rare words look common: of equal keys one text counts."""
    return " ".join(map(str, sorted(zlib.crc32(w.encode()) for w in _cores(text, fit))[:3]))


class _Beginnings(dict):
    """The beginnings of a word that are candidates (None: all)."""

    def __init__(self, fit: Fit, candidates: frozenset[str] | None):
        super().__init__()
        self.fit, self.candidates = fit, candidates

    def __missing__(self, w: str) -> tuple[str, ...]:
        found = tuple(w[:k] for k in range(self.fit.shortest, min(len(w), self.fit.longest) + 1) if self.candidates is None or w[:k] in self.candidates)
        if len(self) < _KNOWN:
            self[w] = found
        return found


def _count(texts: Iterable[str], fit: Fit, candidates: frozenset[str] | None = None) -> tuple[Counter, Counter]:
    """In how many texts each beginning is, and stands as a word."""
    begin, whole, of = Counter(), Counter(), _Beginnings(fit, candidates)
    for t in texts:
        words = _cores(t, fit)
        begin.update(set().union(*map(of.__getitem__, words)))
        whole.update(words if candidates is None else words & candidates)
    return begin, whole


def _terms(pos: dict[str, int], neg: dict[str, int], whole: dict[str, int], n: dict[int, int], fit: Fit) -> list[tuple[str, float, bool]]:
    """The lexicon from the counts of candidates in the toxic and the clean documents."""

    def odds(p: str) -> float:
        return math.log((pos[p] + 0.5) / (n[1] + 1)) - math.log((neg.get(p, 0) + 0.5) / (n[0] + 1))

    chosen: dict[str, float] = {}
    for p in sorted((p for p in pos if odds(p) >= fit.odds), key=lambda p: (len(p), p)):
        if not any(p[:k] in chosen for k in range(fit.shortest, len(p))):
            chosen[p] = odds(p)
    # A term that one longer beginning accounts for almost alone is that longer one.
    tip: dict[str, str] = {}
    for p in sorted(pos, key=lambda p: (len(p), p)):
        root = p[:-1] if p[:-1] in chosen else tip.get(p[:-1])
        if root is not None and pos[p] >= 0.9 * pos[root]:
            tip[p] = root
    last = {root: p for p, root in tip.items()}  # in order of length
    terms = sorted(((t, odds(t)) for t in (last.get(p, p) for p in chosen)), key=lambda x: (-x[1], x[0]))
    return [(t, w, len(t) >= fit.fuzzy and whole.get(t, 0) >= 0.8 * pos[t]) for t, w in terms]


def _least(n: dict[int, int], fit: Fit) -> int:
    return max(fit.least, int(n.get(1, 0) * fit.share))


def _seem(texts: Iterable[str], lexicon: Lexicon, fit: Fit) -> set[str]:
    """Words of clean documents that only look misspelled."""
    return {w for t in texts for w, h in lexicon.hits(_cores(t, fit)).items() if h[1]}


def _solve(x: np.ndarray, y: np.ndarray, rates: tuple[float, float]) -> list[float]:
    """The logistic model's weights; rows count by the reciprocal of their label's sampling rate."""
    weight = np.where(y == 1, 1 / max(rates[0], 1e-9), 1 / max(rates[1], 1e-9))
    b = PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - (b - PRIOR)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(4)
        step = np.linalg.solve(curve, gradient)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return [round(float(v), 10) for v in b]


def fit(rows: list[tuple[str, int]], toxic_rate: float, clean_rate: float, how: Fit = Fit()) -> dict:
    """The model from (text, label) rows, sampled at the given rates of the two labels; all in this process."""
    docs = list({(y, _key(t, how)): (t, y) for t, y in reversed(rows)}.values())
    texts = {y: [t for t, z in docs if z == y] for y in (0, 1)}
    n = {y: len(x) for y, x in texts.items()}
    begin, whole = _count(texts[1], how)
    pos = {p: k for p, k in begin.items() if k >= _least(n, how)}
    neg = _count(texts[0], how, frozenset(pos))[0]
    terms = _terms(pos, neg, whole, n, how)
    known = sorted(_seem(texts[0], Lexicon(terms, ()), how))
    lexicon = Lexicon(terms, known)
    x = np.array([features(t, lexicon) for t, _ in docs]).reshape(-1, 4)
    return {"terms": terms, "known": known, "b": _solve(x, np.array([y for _, y in docs], float), (toxic_rate, clean_rate))}


def _keyed(how: Fit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys = [_key(t or "", how) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.string())], names=[*b.schema.names, "key"])

    return run


COUNTS = "word string, n long, whole long"


def _counted(how: Fit, candidates: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, whole = _count((t for b in slices(batches) for t in b.column("text").to_pylist()), how, candidates)
        words = list(begin)
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([begin[w] for w in part], pa.int64()), pa.array([whole[w] for w in part], pa.int64())], names=["word", "n", "whole"])

    return run


def _seeming(terms: list[tuple[str, float, bool]], how: Fit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms, ())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(_seem((t for b in slices(batches) for t in b.column("text").to_pylist()), lexicon, how)), pa.string())], names=["word"])

    return run


def _featured(terms: list[tuple[str, float, bool]], known: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms, known)
        for b in slices(batches):
            x = np.array([features(t, lexicon) for t in b.column("text").to_pylist()]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), *(pa.array(c) for c in x.T)], names=["doc_id", "toxic", *"abcd"])

    return run


def train(docs: DataFrame, labels: DataFrame, usable: Column, how: Fit = Fit()) -> dict:
    """The model, from the labelled rows for which usable (of doc_id) holds."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(usable)
    most = {1: how.toxic, 0: how.clean}
    total = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sample = None
    for y in (1, 0):
        part = known.filter(F.col("toxic") == y).withColumn("_h", F.xxhash64("doc_id", F.lit("toxicity"))).orderBy("_h", "doc_id").limit(most[y]).drop("_h")
        sample = part if sample is None else sample.unionAll(part)
    rates = tuple(min(1.0, most[y] / max(total.get(y, 0), 1)) for y in (1, 0))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select("doc_id", text).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # how.toxic + how.clean ids at most
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = map_arrow(rows, _keyed(how), f"doc_id {kind}, toxic int, text string, key string")
    rows = checkpointed(rows.groupBy("toxic", "key").agg(F.min(F.struct("doc_id", "text")).alias("x")).select("x.doc_id", "toxic", "x.text").repartition(16, "doc_id"))
    n = {0: 0, 1: 0} | {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n[1]:
        return fit([], *rates, how)
    toxic, clean = (rows.filter(F.col("toxic") == y).select("text") for y in (1, 0))
    summed = lambda df: df.groupBy("word").agg(F.sum("n").alias("n"), F.sum("whole").alias("whole"))
    # Candidates are in a share of the toxic rows, so they are bounded by the words of 1 / share rows.
    found = summed(map_arrow(toxic, _counted(how, None), COUNTS)).filter(F.col("n") >= _least(n, how)).collect()
    pos, whole = {r.word: r.n for r in found}, {r.word: r.whole for r in found}
    neg = {r.word: r.n for r in summed(map_arrow(clean, _counted(how, frozenset(pos)), COUNTS)).collect()}
    terms = _terms(pos, neg, whole, n, how)
    seem = sorted(r.word for r in map_arrow(clean, _seeming(terms, how), "word string").distinct().collect())  # within one edit of a term
    x = np.array([tuple(r) for r in map_arrow(rows, _featured(terms, seem), f"doc_id {kind}, toxic int, a double, b double, c double, d double").orderBy("doc_id").drop("doc_id").collect()])
    return {"terms": terms, "known": seem, "b": _solve(x[:, 1:], x[:, 0], rates)}


def _scored(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon([tuple(t) for t in model["terms"]], model["known"])
        weights = np.array(model["b"])
        for b in slices(batches):
            z = [float(features(t or "", lexicon) @ weights) for t in b.column("text").to_pylist()]
            score = 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "text"), pa.array(score)], names=[*(c for c in b.schema.names if c != "text"), "score"])

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(spread(docs.select("doc_id", F.col("text").cast("string").alias("text"))), _scored(model), f"doc_id {kind}, score double")


def _clean(model: dict, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon([tuple(t) for t in model["terms"]], model["known"])
        weights = np.array(model["b"])
        for b in slices(batches):
            yield b.filter(pa.array([float(features(t or "", lexicon) @ weights) < 0 for t in b.column(text).to_pylist()], pa.bool_()))

    return run


def keep_clean(docs: DataFrame, model: dict) -> DataFrame:
    """docs, all columns, without the rows whose score is 0.5 or more."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    held = docs.toDF(*names)
    return map_arrow(spread(held), _clean(model, names[docs.columns.index("text")]), held.schema).toDF(*docs.columns)
