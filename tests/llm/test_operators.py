"""Each training-data operator against brute force, on rows that are meant to break it."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, html_text, mixing, near_dedup, packing, sharding, substring_dedup, token_counts, toxicity, vector_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, n string, h long, key binary, digest string, _row int, _h int"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def nasty():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", "   \t\n", "one", "One two", "one TWO", "É é x", "a" * 3000, " ".join(rng.choices(vocabulary, k=4000)), "<|endoftext|> <s> </s> ▁ x", "日本語 テキスト   \x1c x"]
    base = rng.choices(vocabulary, k=200)
    for i in range(40):  # near copies
        w = list(base)
        for _ in range(i % 12):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += ["same text again and again " * 5] * 30
    texts += [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 120))) for _ in range(60)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts += [f"{rng.choice(vocabulary)} {passage} {rng.choice(vocabulary)} {i}" for i in range(10)]
    rows = [(i, t, "en", [None, "a", "b", "ß"][i % 4], 0, i, None, None, None, "d", 1, 2) for i, t in enumerate(texts)]
    return [*rows, (None, "no id here", "en", "a", 0, 0, None, None, None, None, 1, 2), (None, None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(nasty(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] or "" for r in nasty() if r[0] is not None}


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def lower(t):
    return t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    model = toxicity.train(none, labels, F.lit(True))
    for df in (
        packing.pack(none, BPE), mixing.mix(none), near_dedup.classes(none), near_dedup.dedup(none), exact_dedup.classes(none), exact_dedup.dedup(none),
        vector_file.search(vectors, F.col("vec_id") % 100 == 0), substring_dedup.removed(none), token_counts.token_counts(none, PIECES),
        toxicity.score(none, model), toxicity.keep_clean(none, model), html_text.extract(pages), sharding.assign(none, sharding.tree(sharding.EIGHT), sharding.tree(sharding.NINE)),
    ):
        assert df.count() == 0


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    rows = packing.pack(docs, BPE, keep_ids=True).collect()
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 1024
    for i, text in texts.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert sum((p.ids for p in parts), []) == ids
        assert [p.start for p in parts] == np.cumsum([0, *(p.length for p in parts[:-1])]).tolist()
        assert len(parts) == -(-len(ids) // 1024) and all(p.length == 1024 for p in parts[1:])
    for group in _grouped(rows, "sequence_id").values():
        group.sort(key=lambda r: r.offset)
        assert [r.offset for r in group] == np.cumsum([0, *(r.length for r in group[:-1])]).tolist()
        assert sum(r.length for r in group) <= 1024


def _grouped(rows, name):
    out = collections.defaultdict(list)
    for r in rows:
        out[r[name]].append(r)
    return out


def _fewest(sizes, capacity):
    """Brute force: the fewest bins."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for r in {b for b in bins if b >= sizes[i]}:
            k = bins.index(r)
            place(i + 1, [*bins[:k], r - sizes[i], *bins[k + 1 :]])
        place(i + 1, [*bins, capacity - sizes[i]])

    place(0, [])
    return best[0]


def test_bin_completion_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.randrange(1, 21) for _ in range(9)]
        counts = np.bincount(sizes, minlength=21)
        plan = packing.bin_completion(counts, 20)
        used = collections.Counter()
        for held, times in plan:
            assert sum(held) <= 20
            for x in held:
                used[x] += times
        assert used == collections.Counter(sizes)
        assert packing.lower_bound(counts, 20) <= _fewest(sizes, 20) == sum(t for _, t in plan)


def test_mixing(docs, texts):
    p = mixing.plan(docs)
    rows = mixing.copies_taken(p.sized, p.cuts).collect()
    assert len(rows) == len(nasty())
    by = _grouped(rows, "source")
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts.values()) + 3
    assert sum(r.size for r in rows) == total
    shares = {r.source: r for r in p.shares.collect()}
    assert sum(s.target for s in shares.values()) == pytest.approx(1.5 * total)
    left = sum(w for s, w in zip(["a", "b", "ß", None], [5, 2, 1, 5], strict=True) if shares[s].target < 2 * shares[s].source_size)
    for (s, w) in zip(["a", "b", "ß", None], [5, 2, 1, 5], strict=True):
        assert shares[s].target <= 2 * shares[s].source_size and (not left or shares[s].target <= 1.5 * total * w / left)
        taken = sum(r.size * r.copies for r in by[s])
        assert abs(taken - shares[s].target) <= sum(x.largest for x in shares.values()) and all(r.copies <= 2 for r in by[s])
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert sorted(r.doc_id or -1 for r in mixed.collect()) == sorted(r.doc_id or -1 for r in mixing.mix(docs.repartition(5)).collect())


def _classes(texts, words, percent):
    sets = {}
    for i, t in texts.items():
        w = lower(t).encode().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in texts:
        for j in texts:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize("words", [2, 5])
def test_near_dedup(docs, texts, words):
    near = near_dedup.Near(words=words, percent=80)
    got = {r.doc_id: r for r in near_dedup.classes(docs, near).collect() if r.doc_id is not None}
    expected = _classes(texts, words, 80)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == expected
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    kept = near_dedup.dedup(docs, near)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, (_, c) in expected.items() if i == c)


def _edited(count, length, edits, more, seed):
    """Copies of one text, too heavily edited to be linked, and of each of them one that is."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(length)]
    texts = []

    def edit(words, n):
        words = list(words)
        for at in rng.sample(range(len(words)), n):
            words[at] = f"e{rng.random()}"
        return words

    for _ in range(count):
        texts.append(edit(base, edits))
        texts.append(edit(texts[-1], more))
    rng.shuffle(texts)
    return {i: " ".join(w) for i, w in enumerate(texts)}


@pytest.mark.parametrize("group", [1 << 16, 5000])
def test_near_dedup_finds_links_hidden_in_large_groups(spark, monkeypatch, group):
    monkeypatch.setattr(near_dedup, "GROUP", group, raising=False)  # the smaller one makes tiles
    texts = _edited(300, 200, 3, 4, 7)
    got = near_dedup.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == _classes(texts, 5, 80)


def test_exact_dedup(docs, texts):
    groups = collections.defaultdict(list)
    for i, t in texts.items():
        groups[lower(t)].append(i)
    got = {r.doc_id: r for r in exact_dedup.classes(docs).collect() if r.doc_id is not None}
    extra = collections.Counter(["no id here", ""])
    for t, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids) + extra[t], i == max(ids))
            assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted([-1, *(max(ids) for ids in groups.values())])


def test_hot_groups_are_looked_up(spark, monkeypatch):
    from palimpsest.llm import common

    monkeypatch.setattr(common, "HOT_SIZE", 5)
    docs = spark.createDataFrame([(i, f"t{i % 3 if i < 90 else i}") for i in range(100)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.classes(docs).collect()}
    assert got[0] == (87, 30) and got[95] == (95, 1) and len(got) == 100


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(700)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 0.5, 0.5, -1.0]) for i in range(300)]  # ties
    rows += [(2000, None), (2100, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2200, [float("nan")] * 6), (2300, [float("inf")] * 6), (2400, [1.0, 2.0]), (2401, [3.0, 1.0]), (2500, [])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, score string").repartition(4)
    got = _grouped(vector_file.search(df, F.col("vec_id") % 100 == 0).collect(), "query_id")
    whole = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()}
    for q in (i for i in whole if i % 100 == 0):
        scores = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:10]
        assert [(-r.score, r.vec_id) for r in sorted(got[q], key=lambda r: r.rank)] == scores
    assert set(got) <= set(whole)


def test_top_k_in_several_slabs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(120)] + [(200, [1.0, 2.0]), (300, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = sorted(map(tuple, vector_file.search(df, F.col("vec_id") % 10 == 0, 3).collect()))
    monkeypatch.setattr(vector_file, "SLAB", 160)
    assert sorted(map(tuple, vector_file.search(df, F.col("vec_id") % 10 == 0, 3).collect())) == whole
    assert len(whole) == 36  # twelve queries; one is alone with its length


def test_top_k_of_huge_components(spark):
    rows = [(i, [3e12 * (i + 1), -1e12]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vector_file.search(df, F.col("vec_id") == 0, 2).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2] and all(r.score == 2**63 - 1 for r in got)


def test_substring_dedup(docs, texts):
    got = {r.doc_id: r for r in substring_dedup.removed(docs, keep_text=True).collect()}
    seen = set()
    for i in sorted(texts):
        b = texts[i].encode()
        gone = np.zeros(len(b), bool)
        own = [b[p : p + 50] for p in range(len(b) - 49)]
        for p, w in enumerate(own):
            if w in seen:
                gone[p : p + 50] = True
        seen.update(own)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        assert bytes(got[i].kept) == kept and got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()
        assert sum(got[i].ends) - sum(got[i].starts) == gone.sum() and got[i].n_bytes == len(b)


def test_substrings_with_equal_hashes(monkeypatch):
    monkeypatch.setattr(substring_dedup, "mix", lambda x: np.zeros_like(x))
    data = bytes(range(50)) + bytes(range(1, 51)) + bytes(range(50))
    mask = substring_dedup.repeated(np.array([1, 2, 3]), np.array([1, 1, 1]), np.frombuffer(data, np.uint8))
    assert [m & 1 for m in mask.tolist()] == [0, 0, 1]


def test_suffix_order_against_sorting():
    rng = random.Random(8)
    data = bytes(rng.choices(b"ab", k=400)) * 2
    at = np.array(rng.sample(range(len(data) - 49), 300))
    ids = np.array([rng.randrange(9) for _ in at])
    order, shared = substring_dedup.suffix_order(at, ids, np.frombuffer(data, np.uint8))
    keys = [(data[at[i] : at[i] + 50], ids[i]) for i in order]
    assert keys == sorted(keys) and shared.tolist() == [x[0] == y[0] for x, y in zip(keys, keys[1:], strict=False)]


def test_token_counts(docs, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in token_counts.token_counts(docs, PIECES).collect() if r.doc_id is not None}
    for i, t in texts.items():
        n = len(sp.encode(t))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 4096)
    rng = random.Random(3)
    odd = ["".join(rng.choices(["a", " ", "  ", "é", "▁", "\n", "\t", "<s>", "the"], k=rng.randrange(12))) for _ in range(500)]
    assert token_counts.lengths(PIECES)(odd) == [len(x) for x in sp.encode(odd)]


def test_encoder_agrees_with_the_library():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(BPE), packing.encoder(BPE)
    rng = random.Random(4)
    odd = ["".join(rng.choices(["a", " ", "  ", "é", "'s", "\n", "\t", "<|endoftext|>", "the", "日", " ", "12", "\x1c", "\x85", "ﬁ"], k=rng.randrange(14))) for _ in range(500)]
    assert all(e(x).tolist() == t.encode(x, add_special_tokens=False).ids for x in odd)


def test_sharding(docs):
    eight, nine = sharding.tree(sharding.EIGHT), sharding.tree(sharding.NINE)
    rows = sharding.assign(docs, eight, nine).collect()
    for r in rows:
        assert r.grown_shard in (r.shard, 8)
    for shard, group in _grouped(rows, "shard").items():
        assert sorted(r.slot for r in group) == list(range(len(group))) and 0 <= shard < 8
    texts_of = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in nasty())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == texts_of


def test_sharding_moves_only_what_weights_change(spark):
    ids = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    heavier = sharding.tree([[[1, 1], [1, 1]], [[1, 1], [1, 3]]])
    rows = sharding.assign(ids, sharding.tree(sharding.EIGHT), heavier).collect()
    assert all(r.grown_shard >= 4 for r in rows if r.shard != r.grown_shard)  # into the changed region, or within it
    share = collections.Counter(r.grown_shard for r in rows)
    assert abs(share[7] / 4000 - 0.3) < 0.04


def test_toxicity(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = toxicity.train(docs, labels, fold != 0)
    scored = toxicity.score(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").filter(fold == 0).collect()
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in scored)
    assert right / len(scored) >= 0.88
    assert toxicity.score(docs.limit(3).withColumn("text", F.lit(None).cast("string")), model).filter("score < 0.5").count() == 3


def test_misspellings_and_quotations():
    rng = random.Random(6)
    words = [f"plain{i}" for i in range(200)]
    rows = [(" ".join([*rng.choices(words, k=20), "scoundrel"]), 1) for _ in range(60)] + [(" ".join(rng.choices(words, k=20)), 0) for _ in range(200)]
    model = toxicity.fit(rows, 1.0, 1.0)
    lexicon = toxicity.Lexicon(model["terms"], model["known"])
    b = np.array(model["b"])
    of = lambda t: float(toxicity.features(t, lexicon) @ b)
    assert of("you scoundrel") > 0 > of("you friend") and of("you scuondrel") == of("you scoundre1")
    assert of("you sc0undrel") > of("you friend") and of("you scuodnrle") == of("you friend")
    assert of('he said "scoundrel" to him') < of("you scoundrel")
    kind = lambda t: np.flatnonzero(toxicity.features(t, lexicon)[1:]).tolist()
    assert kind("you scoundrel") == [0] and kind("you scoundre1") == kind("you scuondrel") == [2]
    assert kind('he typed "scoundre1" to him') == kind("he typed \u2018scuondrel\u2019, no more") == kind("he said scoundrel") == [1]
    assert kind("'tis you scoundrel of the players' lot") == kind('"yes" you scoundrel "no"') == [0]
    assert kind('a "scoundrel" is a scoundrel') == [0]


def _distance(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 2 : i] == b[j - 1] + b[j - 2]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_against_distance():
    rng = random.Random(7)
    words = ["".join(rng.choices("abc", k=rng.randrange(1, 7))) for _ in range(60)]
    trie = toxicity.Trie(words[:20])
    for w in words:
        for k in (1, 2):
            best = min((_distance(w, t), i) for i, t in enumerate(words[:20]) if words[:20].index(t) == i or True)
            got = toxicity.Automaton(w, k).meet(trie)
            assert (got[0] if got else None) == (best[0] if best[0] <= k else None)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain words", "plain words"),
        ("<html><body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One  two<br>three <b>bold</b>.<p>Four</article><div class='comments'><p>nice</p></div><footer>x</footer></body></html>", "T & U\nOne two three bold.\nFour"),
        ("<body><div id=side class='left-sidebar'><ul><li><a href=1>a</a><li><a href=2>b</a></ul></div><div class=post><p>" + "long text here. " * 20 + "</p><ul><li>i<li>j</ul>tail</div></body>", ("long text here. " * 20).strip() + "\ni\nj\ntail"),
        ("<p>a<script>var x='<p>no</p>'</script>b</p><form><input name=q>ask</form>", "ab"),
        ("<body class='no-sidebar'><div class=site-header>Site</div><div class='layout with-sidebar'><div class=entry-header><h1>T</h1></div><p>Some text.</div><div aria-label='Reader comments'>x</div>", "T\nSome text."),
        ("<div class=popup><p>all there is</p></div>", "all there is"),
        ("<body><article><p>only", "only"), ("<!-- x --><p>5 &lt; 6", "5 < 6"),
    ],
)
def test_html(page, text):
    assert html_text.main_text(page) == text


def test_html_templates(spark, small):
    for r in html_text.extract(spark.read.parquet(f"{small}/pages.parquet")).collect():
        assert r.n_chars == len(r.text) > 0
