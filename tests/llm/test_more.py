"""Odd columns and rows through every operator and stage, and further brute-force versions."""

import collections
import math
import random
import re
import time
import xml.etree.ElementTree as ET

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import exact_dedup, html_text, mixing, near_dedup, packing, sharding, substring_dedup, token_counts, toxicity, vector_file
from test_operators import _classes, _fewest, lower

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = "`doc_id` long, `text` string, `lang` string, `source` string, `n_chars` long, `a b` int, `a.b` struct<`x y`:int>, `_h` int, `row` string, `_copy` int, `label` int, `_row` int, `key` string"


def odd_rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(200)]
    texts = [None, "", " ", "One", "one", "a b c", "word " * 3000]
    base = rng.choices(words, k=150)
    for i in range(12):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(150)] = "other"
        texts.append(" ".join(w))
    texts += [" ".join(rng.choices(words, k=30)) for _ in range(30)]
    texts += [f"{t} scoundrel" for t in (" ".join(rng.choices(words, k=20)) for _ in range(30))]
    rows = [(i, t, "en", ["a", None, "b"][i % 3], 1, i, (i,), 2, "r", 3, 4, 5, "k") for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[3], (None, "no id", None, None, None, None, None, None, None, None, None, None, None), (None, None, *[None] * 11)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 0, int(49 <= i < 79)) for i in range(79)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_odd_columns_through_the_operators(odd, labels):
    n = len(odd_rows())
    model = toxicity.train(odd, labels, F.lit(True))
    for df in (toxicity.score(odd, model), near_dedup.classes(odd), exact_dedup.classes(odd), substring_dedup.removed(odd), token_counts.token_counts(odd, PIECES), sharding.assign(odd, sharding.tree(sharding.EIGHT), sharding.tree(sharding.NINE))):
        assert df.count() == n
    assert packing.pack(odd, BPE).select("doc_id", "piece").filter("piece = 0").count() == n
    for df in (toxicity.keep_clean(odd, model), exact_dedup.dedup(odd), near_dedup.dedup(odd), mixing.mix(odd)):
        assert df.dtypes == odd.dtypes and 0 < df.count()


def test_stages_against_brute_force(spark, odd, labels, tmp_path):
    at = str(tmp_path)
    odd.write.parquet(f"{at}/documents.parquet")
    labels.write.parquet(f"{at}/labels.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    model = toxicity.train(docs, labels, F.lit(True))
    lexicon, b = toxicity.Lexicon(model["terms"], model["known"]), np.array(model["b"])
    rows = [r for r in odd_rows() if toxicity.features(r[1] or "", lexicon) @ b < 0]
    same = lambda df, rows: sorted(map(repr, ((r.doc_id, r.text) for r in df.collect()))) == sorted(map(repr, ((r[0], r[1]) for r in rows)))
    stage = dict(corpus_pipeline.STAGES)
    docs = stage["toxicity"](spark, docs, at)
    assert same(docs, rows) and len(rows) < len(odd_rows()) - 20
    best = {}
    for r in rows:
        k = lower(r[1] or "")
        if k not in best or (-1 if r[0] is None else r[0]) > (-1 if best[k][0] is None else best[k][0]):
            best[k] = r
    docs = stage["exact dedup"](spark, docs, at).cache()
    assert same(docs.selectExpr("doc_id", "lower(coalesce(text, '')) text"), [(r[0], lower(r[1] or "")) for r in best.values()])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = _classes({i: t or "" for i, t in rows if i is not None}, 5, 80)
    rows = [(i, t) for i, t in rows if i is None or found[i][1] == i]
    docs = stage["near dedup"](spark, docs, at).cache()
    assert same(docs, rows)
    docs = stage["mixing"](spark, docs, at).cache()
    copies = collections.Counter(r.doc_id for r in docs.collect())
    assert docs.dtypes == odd.dtypes and set(copies) <= {i for i, _ in rows} and max(copies.values()) <= 2
    packed = stage["packing"](spark, docs, at).collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == copies
    whole = corpus_pipeline.run(spark, at, f"{at}/kept")
    assert whole.count() == len(packed) and corpus_pipeline.run(spark, at, f"{at}/kept").count() == len(packed)


@pytest.mark.parametrize(("count", "batches"), [(900, 3), (3000, 6)])
def test_near_copies_over_several_batches(spark, count, batches):
    rng = random.Random(count)
    base = [f"b{i}" for i in range(60)]
    texts = {}
    for i in range(count):
        w = list(base)
        for at in rng.sample(range(60), rng.randrange(6)):
            w[at] = f"e{rng.randrange(10**9)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(batches)
    got = {r.doc_id: r.component_id for r in near_dedup.classes(df, near_dedup.Near(words=2)).collect()}
    # Of a large group only pairs across components can show a lost link.
    sets = {i: {tuple(x) for x in zip(t.split(), t.split()[1:], strict=False)} for i, t in texts.items()}
    heads = collections.Counter(got.values())
    small = [i for i in texts if heads[got[i]] <= count // 2]
    for i in small:
        for j in texts:
            if got[i] != got[j]:
                assert 100 * len(sets[i] & sets[j]) < 80 * len(sets[i] | sets[j])
    members = collections.defaultdict(list)
    for i, c in got.items():
        members[c].append(i)
    for c, ids in members.items():  # and every component hangs together
        assert c == min(ids)
        left, edge = set(ids) - {c}, [c]
        while edge and left:
            i = edge.pop()
            near = {j for j in left if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
            left -= near
            edge += near
        assert not left


def test_components_against_union_find(spark):
    rng = random.Random(3)
    for n, m in ((400, 300), (300, 900)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(1000 + i, 1001 + i) for i in range(60)]
        root = {x: x for e in edges for x in e}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        got = {r.id: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
        assert got == {x: find(x) for x in root}


def test_packing_search():
    sizes = [17, 17, 30, 30, 30, 36, 41, 41, 41, 51, 51]
    assert sum(t for _, t in packing.bin_completion(np.bincount(sizes, minlength=101), 100)) == 4
    rng = random.Random(2)
    for _ in range(10_000):
        capacity = rng.choice([20, 50, 100])
        sizes = [rng.randrange(1, capacity * rng.choice([3, 6, 10]) // 10 + 1) for _ in range(rng.randrange(5, 11))]
        if rng.random() < 0.5:
            sizes = [rng.choice(sizes[:4]) for _ in sizes]
        counts = np.bincount(sizes, minlength=capacity + 1)
        plan = packing.bin_completion(counts, capacity, packing.EXACT)
        assert sum(t for _, t in plan) == _fewest(sizes, capacity)
        used = collections.Counter()
        for held, times in plan:
            assert sum(held) <= capacity
            used.update({x: k * times for x, k in collections.Counter(held).items()})
        assert used == collections.Counter(sizes)


def test_packing_of_many_lengths():
    rng = random.Random(4)
    counts = np.bincount([rng.randrange(1, 1025) for _ in range(60_000)], minlength=1025)
    began = time.process_time()
    plan = packing.bin_completion(counts)
    assert time.process_time() - began < 30
    fewest = sum(t for _, t in plan)
    assert packing.lower_bound(counts, 1024) <= fewest <= sum(t for _, t in packing.best_fit_decreasing(counts, 1024))
    assert fewest <= 1.001 * packing.lower_bound(counts, 1024)


def test_top_k_of_repeated_ids(spark):
    rows = [(0, [3.0, 0.0]), (0, [1.0, 1.0]), (1, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [5.0, 5.0])]
    for seed in (1, 2):
        df = spark.createDataFrame(random.Random(seed).sample(rows, 5), "vec_id long, embedding array<double>").repartition(seed)
        got = [(r.rank, r.vec_id, r.score) for r in vector_file.search(df, F.col("vec_id") == 0, 3).orderBy("rank").collect()]
        assert got == [(1, 2, 10 << 20), (2, 1, 2 << 20), (3, 1, 1 << 20)]  # the query is (1, 1)


def test_range_cut_of_the_mix(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 1 + cast(id % 40 as int))").alias("text"), F.expr("case when id % 3 = 0 then 'a' when id % 7 = 0 then 'b' else 'c' end").alias("source"))
    p = mixing.plan(docs)
    rows = mixing.copies_taken(p.sized, p.cuts).collect()
    budget = sum(r.target for r in p.shares.collect())
    assert 0 <= budget - sum(r.size * r.copies for r in rows) <= 40  # the last copy that would pass it is left out
    queue = collections.defaultdict(list)
    for r in rows:
        queue[r.source].append((r.h, r.doc_id, r.size, r.copies))
    at = 1 + max(math.inf if not q else 0 for q in queue.values())
    assert at == 1
    for q in queue.values():  # a prefix of each queue's rounds is taken
        taken = [c for _, _, _, c in sorted(q)]
        assert taken == sorted(taken, reverse=True) and max(taken) - min(taken) <= 1


def test_many_sources(spark, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("s"), F.col("id") % 50)).alias("source"))
    p = mixing.plan(docs)
    before = sorted((r.doc_id, r.copies) for r in mixing.copies_taken(p.sized, p.cuts).collect())
    monkeypatch.setattr(mixing, "BROADCAST", 3)
    assert sorted((r.doc_id, r.copies) for r in mixing.copies_taken(p.sized, p.cuts).collect()) == before


def test_long_texts_without_spaces():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(21)
    signs = ["日", "本", "語", "の", "を", "é", "ß", "a", "b", "the", "ing", "Z", "9", "+", "/", "\u0e01", "\U0001f600", "\u4e00", "-"]
    texts = ["".join(rng.choices(signs[: rng.randrange(2, len(signs))], k=rng.randrange(300, 4000))) for _ in range(60)]
    texts += [f"ab {t} cd  {t[:900]}" for t in texts[:20]] + ["\U0001f600" * 3000, "a" * 5000, "=" * 2000]
    assert token_counts.lengths(PIECES)(texts) == [len(x) for x in sp.encode(texts)]
    assert max(map(len, token_counts.lengths(PIECES).cache)) <= token_counts.SHORT


# --- pages


def _naive(page):
    """The densest part of a well-formed page without any declared boilerplate, by the definitions alone."""
    root = ET.fromstring(page)
    up = {c: p for p in root.iter() for c in p}

    def size(s):
        return len(" ".join((s or "").split()))

    def linked(e):
        return e is not None and (e.tag == "a" or linked(up.get(e)))

    def own(e):  # texts straight in e
        return [e.text, *(c.tail for c in e)]

    def chars(e):
        return sum(size(s) for x in e.iter() for s in own(x))

    def links(e):
        return sum(size(s) for x in e.iter() if linked(x) for s in own(x))

    ratio = links(root) / max(chars(root), 1)

    def density(e):
        c, lc = chars(e), links(e)
        g, lg = sum(1 for _ in e.iter()), sum(1 for x in e.iter() if linked(x))
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
        if base <= 1:
            return c / g
        return c / g * max(math.log(c / max(lc, 1) * g / max(lg, 1)), 0.0) / math.log(base)

    body = root.find("body")
    total = {e: sum(density(c) for c in e) for e in root.iter()}
    inline = html_text.INLINE
    walk = []

    def visit(e):
        walk.append(e)
        for c in e:
            if c.tag not in inline:
                visit(c)

    visit(body)
    top = max(total[e] for e in walk)
    best = [e for e in walk if total[e] == top]
    if len(best) > 1 and any(b not in list(best[0].iter()) for b in best):
        return None  # a tie
    best, path = best[0], []
    e = best
    while e is not body:
        path.append(e)
        e = up[e]
    chosen = {best}
    if path:
        least = min(map(density, path))
        for e in [body, *path]:
            if e is not best:
                chosen |= {c for c in e if c not in path and c.tag not in inline and density(c) >= least}
    else:
        chosen = {body}
    out = []

    def render(e, inside):
        inside = inside or e in chosen
        block = e.tag not in inline
        out.append("\n" if block else " " if e.tag == "br" else "")
        if inside:
            out.append((e.text or "").replace("\n", " "))
        for c in e:
            render(c, inside)
            if inside:
                out.append((c.tail or "").replace("\n", " "))
        out.append("\n" if block else "")

    render(root, False)
    return "\n".join(x for line in "".join(out).split("\n") if (x := " ".join(line.split())))


def _page(rng):
    def words(n):
        return " ".join(rng.choices(["alpha", "be", "gamma", "d", "epsilon"], k=n))

    def node(depth):
        tag = rng.choice(["div", "div", "section", "p", "ul"]) if depth else "p"
        inner = []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.random()
            if kind < 0.35 and depth and tag in ("div", "section"):
                inner.append(node(depth - 1))
            elif kind < 0.5:
                inner.append(f"<a>{words(rng.randrange(1, 4))}</a>")
            elif kind < 0.6:
                inner.append(f"<b>{words(2)}</b>")
            else:
                inner.append(words(rng.randrange(0, 30)) + " ")
        return f"<{tag}>{''.join(inner)}</{tag}>"

    return "<html><body>" + "".join(node(3) for _ in range(rng.randrange(1, 6))) + "</body></html>"


def test_density_against_brute_force():
    rng = random.Random(12)
    compared = 0
    for _ in range(400):
        page = _page(rng)
        expected = _naive(page)
        if expected is not None:
            compared += 1
            assert html_text.main_text(page) == expected
    assert compared > 300


@pytest.mark.parametrize(
    "page",
    [
        "<p>hi</p><a " + " ".join(f'data-{i}="v{i}"' for i in range(10_000)), "<p>hi</p><a " + " ".join(f'"v{i}"' for i in range(10_000)),
        "<p>hi</p><a " + " ".join(f"='v{i}\"" for i in range(10_000)), "<i>" * 10_000 + "<p>x" * 10_000, "<i>" * 10_000 + "</b>" * 10_000 + "yes",
        "<li><i>" * 10_000 + "yes", "hi " + "<a " * 30_000, "<div>" * 20_000 + "yes" + "</div>" * 20_000, "hi" + "<script>" * 20_000, "hi" + "<!--" * 20_000, "< " * 50_000,
    ],
)
def test_pages_take_linear_time(page):
    began = time.process_time()
    assert html_text.main_text(page)
    assert time.process_time() - began < 1


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h1>T</h1><p>One two three four.</p><blockquote class='notice'>Quoted part.</blockquote><p>More</p></article>", "T\nOne two three four.\nQuoted part.\nMore"),
        ("<body><h1>Title</h1><div class='comment-policy-story'><p>" + "long text of a story. " * 9 + "</p></div></body>", ("long text of a story. " * 9).strip()),
        ("<body><div class='post comments-open'><p>" + "some story. " * 20 + "</p><div class='post-comments'>readers say</div></div></body>", ("some story. " * 20).strip()),
        ("<body><section id=discussion><p>all the text of the page</p></section></body>", "all the text of the page"),
        ("<p title='the hidden gem'>seen</p><p hidden>unseen</p><div style='display: none'>x</div><p>5 < 6 > 4</p>", "seen\n5 < 6 > 4"),
        ('<p class="x>open quotation</p>', "open quotation"), ("<p>kept</p><a href='cut", "kept"), ("<p>kept</p><!-- never closed <p>x</p>", "kept"),
    ],
)
def test_names_are_evidence(page, text):
    assert html_text.main_text(page) == text


def test_odd_pages(spark):
    rows = [(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (None, None, "<p>y</p>"), (2, "v", None), (3, "w", "<p>" + "long " * 200_000 + "</p>")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, n_chars int, `a b` string")
    got = sorted((str(r.page_id), r.url, r.n_chars) for r in html_text.extract(df).collect())
    assert got == sorted([("1", "u", 1), ("1", "u", 1), ("None", None, 1), ("2", "v", 0), ("3", "w", 999_999)])


def test_scores_against_brute_force(spark, odd, labels):
    """Fitting in parallel gives what fitting in one process gives, and scores follow from the definitions."""
    model = toxicity.train(odd, labels, F.lit(True))
    label = {i: int(49 <= i < 79) for i in range(79)}
    texts = {}
    for r in odd_rows():
        if r[0] is not None:
            texts[r[0]] = min(texts.get(r[0], r[1] or ""), r[1] or "")
    alone = toxicity.fit([(texts[i], label[i]) for i in sorted(texts)], 1.0, 1.0)
    assert [tuple(t) for t in model["terms"]] == alone["terms"] and model["known"] == alone["known"] and model["b"] == pytest.approx(alone["b"])
    terms, z = {t: w for t, w, _ in alone["terms"]}, {}
    for r in odd_rows():
        hit = {max((t for t in terms if w.startswith(t)), key=len) for w in re.findall(r"\w+", (r[1] or "").lower()) if any(w.startswith(t) for t in terms)}
        z[r[0]] = alone["b"][0] + alone["b"][1] * min(toxicity.MOST, sum(terms[t] for t in hit))
    for r in toxicity.score(odd, model).collect():
        assert r.score == pytest.approx(1 / (1 + math.exp(-z[r.doc_id])))
