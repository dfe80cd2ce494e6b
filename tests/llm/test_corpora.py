"""Resampling, ranked search and the exact n-gram join against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_operators import DOCS, lower, nasty

from palimpsest.llm import importance, lexical, ngram_join
from palimpsest.llm.near_dedup import Near

ITEMS = "item_id long, text string, doc_id string, score int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(nasty(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "W1 w2 w2 same w299", "x", 1), (2, None, None, None), (3, "", None, None), (4, "nothing matches this", None, None), (5, "one É É w5 changed text", "y", 2), (None, "w7 again", None, None)]
    return spark.createDataFrame(rows, ITEMS)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def resampled(rows, target, t):
    """doc_id, n_features, weight, score, rank by the contract."""
    def features(text):
        w = terms(text)
        return [" ".join(w[i : i + n]) for n in range(1, t.ngrams + 1) for i in range(len(w) - n + 1)], len(w)

    bucket = lambda x: zlib.crc32(x.encode()) % t.buckets
    own = [(i, text, *features(text)) for i, text in rows]
    s, want = Counter(bucket(x) for r in own for x in r[2]), Counter(bucket(x) for text in target for x in features(text)[0])
    all_s, all_t = sum(s.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log(float((want[b] + 1) * (all_s + t.buckets)) / float((s[b] + 1) * (all_t + t.buckets))))
    out = []
    for i, text, f, n in own:
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        key = str(i) if i is not None else "null-" + hashlib.md5((text or "").encode()).hexdigest()
        h = int(hashlib.sha256(f"{t.seed}:{key}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    long = sorted((r for r in out if r[5] >= t.least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    for k, r in enumerate(long[: t.percent * len(long) // 100], 1):
        r[4] = k
    return sorted(map(tuple, (r[:5] for r in out)), key=repr)


@pytest.mark.parametrize("t", [importance.Target(), importance.Target(ngrams=3, buckets=97, least=1, percent=60), importance.Target(buckets=1 << 17, percent=100)])
def test_resampling(docs, items, t):
    got = importance.resample(docs, items, t).select("doc_id", "n_features", "weight", "score", "rank")
    expected = resampled([(r[0], r[1]) for r in nasty()], [r.text for r in items.collect()], t)
    assert sorted(map(tuple, got.collect()), key=repr) == expected


def test_resampling_of_repeats_and_empty_tables(spark, docs, items):
    none = docs.filter("false")
    assert importance.resample(none, items).count() == 0
    rows = [(r[0], r[1]) for r in nasty()]
    got = importance.resample(docs.union(docs), items.filter("false")).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=repr) == resampled(rows * 2, [], importance.Target())


def test_salts_of_hot_buckets(docs, items, monkeypatch):
    monkeypatch.setattr(importance, "SALT", 1)
    t = importance.Target(buckets=3, least=5, percent=30)
    got = importance.resample(docs.repartition(7), items, t).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=repr) == resampled([(r[0], r[1]) for r in nasty()], [r.text for r in items.collect()], t)


@pytest.mark.parametrize("text", ["", "a", "x" * 500 + " yz", "É_É 1a\x00b", "a  b\tc"])
def test_words_and_checksums(text):
    data, start, end, of = importance.words_of([b"", text.encode(), b"q r"])
    words = data.split()
    assert [w.decode() for w in words] == [*terms(text), "q", "r"]
    assert importance.crc32(data, start, end).tolist() == [zlib.crc32(w) for w in words]
    assert of.tolist() == [1] * len(terms(text)) + [2, 2]


def ranked(rows, items, k):
    docs = [(i, Counter(terms(text)), sum(Counter(terms(text)).values())) for i, text in rows]
    docs = [d for d in docs if d[2]]
    n, total = len(docs), sum(d[2] for d in docs)
    df = Counter(w for d in docs for w in d[1])
    out = []
    for item, text in items:
        scored = []
        for i, tf, size in docs:
            m = 25 + (75 * size * n) // total
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m)) for w, r in Counter(terms(text)).items() if w in tf)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "slab", "block"), [(10, 4 << 20, 512), (3, 16, 7), (1000, 4 << 20, 512)])
def test_ranked_search(docs, items, monkeypatch, k, slab, block):
    monkeypatch.setattr(lexical, "SLAB", slab)
    monkeypatch.setattr(lexical, "BLOCK", block)
    got = lexical.search(docs, items, k)
    expected = ranked([(r[0], r[1]) for r in nasty()], [(r.item_id, r.text) for r in items.collect()], k)
    assert sorted(map(tuple, got.collect()), key=repr) == expected


def test_ranked_search_of_repeats_and_empty_tables(docs, items):
    assert lexical.search(docs.filter("false"), items).count() == 0
    assert lexical.search(docs, items.filter("false")).count() == 0
    got = lexical.search(docs.union(docs), items.union(items))
    rows, asked = [(r[0], r[1]) for r in nasty()], [(r.item_id, r.text) for r in items.collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(rows * 2, asked * 2, 10)


def test_matches_are_not_shuffled(docs, items):
    """Sums of matches need no exchange but that of the postings."""
    rows = docs.sparkSession.createDataFrame([(1, 0, [1], [0], [0], [2], [1])], lexical.POSTINGS)
    asked = docs.sparkSession.createDataFrame([(0, 1, 0, 0, 5)], "item int, item_id long, bucket int, term int, weight long")
    sums = lexical._matches(rows, asked, 1, 2, 4).groupBy("block", "place", "doc_id", "item", "item_id").sum("score")
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def joined(rows, n, percent):
    sets = {}
    for i, text in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(text, n))
    head = {i: i for i in sets}

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                p, q = sorted((root(a), root(b)))
                head[q] = p
    return sorted(((i, len(shingles(t, n)), None if i is None else root(i)) for i, t in rows), key=repr)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (2, 80), (1, 60)])
def test_join(docs, n, percent):
    got = ngram_join.classes(docs, Near(words=n, percent=percent))
    assert sorted(map(tuple, got.collect()), key=repr) == joined([(r[0], r[1]) for r in nasty()], n, percent)


@pytest.mark.parametrize("group", [4096, 8])
def test_join_of_families(spark, monkeypatch, group):
    """Many near copies, with large buckets in one tile and in many."""
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "LEAST", 1)
    rng = random.Random(3)
    rows = []
    for f in range(4):
        base = rng.choices([f"w{i}" for i in range(400)], k=50 + 20 * f)
        for _ in range(70):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(1000 + i, " ".join(rng.choices("a b c d".split(), k=rng.randrange(1, 14)))) for i in range(150)]
    got = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), Near(words=4, percent=85))
    assert sorted(map(tuple, got.collect()), key=repr) == joined(rows, 4, 85)


def test_join_of_repeats_and_empty_tables(spark, docs):
    rows = [(1, "a b c d e"), (2, "v w x y z"), (2, "a b c d e"), (3, "v w x y z"), (4, "p q r s t")]
    got = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), Near(words=4, percent=85))
    assert sorted(map(tuple, got.collect())) == joined(rows, 4, 85)
    assert ngram_join.classes(docs.filter("false"), Near(words=4, percent=85)).count() == 0
    got = ngram_join.classes(docs.union(docs), Near(words=4, percent=85))
    assert sorted(map(tuple, got.collect()), key=repr) == joined([(r[0], r[1]) for r in nasty()] * 2, 4, 85)


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_links_share_a_key(percent):
    """Every pair that links meets, whatever keys cost, and no bitmap rules it out."""
    rng = np.random.default_rng(percent)
    met = 0
    for trial in range(1500):
        n = int(rng.integers(1, 12 if trial % 2 else 400))
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        size = int(rng.integers(0, 1 + len(s) * (100 - percent) // percent))
        gone = int(rng.integers(0, size + 1))
        t = np.unique(np.concatenate([rng.permutation(s)[gone:], rng.integers(0, 2**63, size - gone).astype(np.uint64)]))
        both = len(np.intersect1d(s, t))
        if not len(t) or 100 * both < percent * (len(s) + len(t) - both) or np.array_equal(s, t):
            continue
        costs = rng.integers(0, 15, ngram_join.SLOTS).astype(np.uint8) if trial % 5 == 0 else np.zeros(ngram_join.SLOTS, np.uint8)
        x, y = ({int(k) for b in ngram_join.bands_of(percent, len(v)) for k in ngram_join.chosen(v, b, costs)} for v in (s, t))
        assert x & y
        to = min(len(ngram_join.parity(v)) for v in (s, t))
        apart = np.bitwise_count(ngram_join.folded(ngram_join.parity(s), to) ^ ngram_join.folded(ngram_join.parity(t), to)).sum()
        assert apart <= len(s) + len(t) - 2 * both <= ngram_join.most_apart(len(s), len(t), percent)
        met += 1
    assert met > 300
