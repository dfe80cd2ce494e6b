import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import codec
from palimpsest.functions import text as T
from palimpsest.functions import vector as V
from palimpsest.operators import activity as A
from palimpsest.operators import build as B
from palimpsest.operators import federate as Fed
from palimpsest.operators import filters as Fil
from palimpsest.operators import grid as G
from palimpsest.operators import search as S


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["_"])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "expected"), [("[a,b/c] x", ["a", "b", "c"]), ("no tags", []), ("[open", []), ("[" + "a" * 199 + "] x", ["a" * 199]), ("[" + "a" * 200 + "] x", [])])
def test_tags(spark, text, expected):
    assert one(spark, T.tags(F.col("t")), t=text) == expected


def test_tag_match(spark):
    own = F.split("t", " ")
    assert one(spark, T.has_tag(own, "game:"), t="game:ft09 x")
    assert not one(spark, T.has_tag(own, "game"), t="game:ft09 x")


@pytest.mark.parametrize(
    ("text", "key"),
    [
        ("[HEARTBEAT,AGENT,turn-119,url=agent.example/chat/abc] hi", "agent.example/chat/abc|turn-119"),
        ("[Agent | Turn 119 | ts | agent.example/chat/abc] hi", "agent.example/chat/abc|turn-119"),
        ("[HEARTBEAT,turn-119] hi", None), ("plain", None), ("[x | Turn y | a.b/c] hi", None),
    ],
)
def test_exchange_key(spark, text, key):
    assert one(spark, T.exchange_key(F.col("t")), t=text) == key


def test_soft_truncate(spark):
    cut = lambda t: one(spark, T.soft_truncate(F.col("t")), t=t)
    assert cut("a" * 550) == "a" * 550
    assert cut("a" * 551) == "a" * 550 + " …"
    assert cut("a" * 300 + ". " + "b" * 400) == "a" * 300 + ". …"
    assert cut(("word " * 200).strip()).endswith("word …")


@pytest.mark.parametrize(("n", "starts"), [(1, [0]), (300, [0]), (301, [0, 250]), (540, [0, 250, 500])])
def test_chunks(spark, n, starts):
    words = [f"w{i}" for i in range(n)]
    rows = B.word_chunks(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).orderBy("chunk").collect()
    assert [r.text for r in rows] == [" ".join(words[s : s + 300]) for s in starts]


def test_chunks_at_breaks(spark):
    rows = B.word_chunks(spark.createDataFrame([(1, f"a b\n\n{T.BREAK}\n\n c {T.BREAK} ")], "doc_id long, text string")).collect()
    assert [r.text for r in rows] == ["a b", "c"]


def test_words_are_those_of_python(spark):
    text = "a\x1cb c　d e​f\tg  h\x85i"
    assert one(spark, T.words(F.col("t")), t=text) == text.split()


def test_sign_codes(spark):
    v = [0.0, 1.0, -1.0, 2.0] * 20
    q = F.array(*(F.lit(x) for x in v))
    minus = F.array(*(F.lit(-x if x else 1.0) for x in v))
    assert one(spark, V.sign_similarity(V.sign_words(q), V.sign_words(q), 80)) == 1.0
    assert one(spark, V.sign_similarity(V.sign_words(q), V.sign_words(minus), 80)) == 0.0
    assert one(spark, V.sign_words(F.array(F.lit(0.0), F.lit(1.0)))) == [1]


def test_thermometer_of_flat_vector(spark):
    flat = F.array(F.lit(2.0), F.lit(2.0))
    assert one(spark, V.thermometer(flat)) == [0, 0]
    assert one(spark, V.rescale(flat)) == [0.5, 0.5]


def test_u4_round_trip(spark):
    w = [0, 8, 64, 127, 120]
    got = one(spark, V.dequantise_u4(V.quantise_u4(F.array(*(F.lit(x) for x in w)))))
    assert got[-4:] == [8, 64, 120, 120][-4:] or len(got) == 8


def test_link_codec(spark):
    fields = dict.fromkeys(codec.FIELDS, 7)
    row = spark.createDataFrame([tuple(fields.values())], list(fields))
    raw = row.select(codec.pack_link(F.struct(*fields)).alias("b"))
    assert len(raw.first().b) == 64
    assert raw.select(codec.unpack_link("b").alias("l")).first().l.next == 7


def test_grid_codec(spark):
    cells = [random.Random(1).randrange(16) for _ in range(64)]
    row = spark.createDataFrame([(cells,)], "c array<int>")
    assert row.select(codec.expand_grid(codec.compact_grid("c")).alias("x")).first().x == cells


def test_quality_that_is_absent_passes(spark):
    rows = spark.createDataFrame([(0, "a", {"support_count": "3"}), (1, "b", {"support_count": "1"}), (2, "c", {})], "idx long, text string, meta map<string,string>")
    assert [r.idx for r in Fil.enumerate_filter(rows, {"quality": {"support_count_min": 2}}).collect()] == [0, 2]
    assert [r.idx for r in Fil.enumerate_filter(rows, {"meta": {"support_count": 3}}).collect()] == [0]
    assert Fil.predicate({"colour": 1})[1] == ["colour"]


def test_links_are_inverse(spark):
    rows = spark.createDataFrame([(i, f"s{i % 2}", f"t{i}") for i in range(6)], "idx long, source string, text string")
    linked = {r.idx: r for r in B.links(rows).collect()}
    assert linked[0].prev is None and linked[4].next is None and linked[5].next is None
    assert all(linked[r.next - 1].prev == r.pattern_id for r in linked.values() if r.next)


def test_boilerplate(spark):
    text = "head\n*** START OF THIS PROJECT GUTENBERG EBOOK ***\nbody\n\n\n\n\nmore\nEnd of Project Gutenberg\nlicence"
    assert one(spark, B.strip_boilerplate(F.col("t"), True), t=text) == "body\n\n\nmore"
    assert one(spark, B.strip_boilerplate(F.col("t")), t="  plain ") == "plain"


def test_embedded_texts_whose_words_cancel(spark, tmp_path):
    from palimpsest.plans.more import QUERIES

    place = lambda w: (zlib.crc32(w.encode()) % 64, zlib.crc32(w.encode()) >> 31)
    at, sign = place("search_document:")
    against = next(w for w in (f"w{i}" for i in range(10_000)) if place(w) == (at, 1 - sign))
    spark.createDataFrame([(1, against), (2, ""), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, QUERIES["embedded_texts"](spark, str(tmp_path)).collect())) == [(1, 64, 1.0), (2, 64, 1.0)]


def test_poems():
    body = "\n".join(f"line {i} of a poem with words" for i in range(4))
    found = B.poems_of(f"\n\n\nTHE FIRST POEM\n\n{body}\n\n\n\nII The Second\n\n{body}\n\n\nshort", "Verses", "A. Poet")
    assert [p.split("\n")[0] for p in found] == ['[Poem: "The First Poem" from Verses by A. Poet]', '[Poem: "The Second" from Verses by A. Poet]']
    stanza = " ".join(["word"] * 150)
    # Blank lines end no stanza here, as they are gone by then: a long poem stays whole.
    assert len(B.poems_of("\n\n".join([stanza] * 5), "V", "P")) == 1
    assert len(B._stanzas("\n\n".join([stanza] * 5))) == 3


def test_verses_that_look_like_titles(spark, tmp_path):
    from palimpsest.plans.more import QUERIES

    rows = [(i, f"{head} and nine more words of a verse without title", "src", "en") for i, head in enumerate(["4355709550244650", "12.", "I", "XIV.", "plain"])]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["poems"](spark, str(tmp_path)).collect()))
    assert got == [(i, k, f"[Poem: src by en]\n{text} x{k}") for i, text, _, _ in rows for k in range(3)]


def test_poems_fall_back_to_windows(spark):
    books = spark.createDataFrame([(1, "T", "A", " ".join(["w"] * 250))], "book long, title string, author string, text string")
    assert [r.chunk for r in B.poems(books).orderBy("chunk").collect()] == [0, 1]


def test_publish_twice(spark):
    rows = spark.createDataFrame([("m", "g", "p"), ("m", "g", "p"), ("m", "g", "q")], "machine string, game string, pattern string")
    rows = rows.withColumn("signature", Fed.signature(rows))
    fresh = Fed.publish(rows, rows.limit(0))
    assert fresh.count() == 2
    assert Fed.publish(rows, fresh).count() == 0


def test_trust(spark):
    p = spark.createDataFrame([(k, i) for i, k in enumerate([0, 1, 2, 3])], "part long, idx long")
    e = spark.createDataFrame([(0, 0, 1, 1, "CONFIRMED_BY"), (0, 0, 2, 2, "CONFIRMED_BY")], "part long, idx long, other_part long, other_idx long, kind string")
    assert {r.idx: r.trust_signal for r in Fed.preserved(p, e).collect()} == {0: "high", 1: "single_corroboration", 2: "single_corroboration", 3: "single_source"}
    assert sorted((r.idx, r.members) for r in Fed.collapsed(p, e).collect()) == [(0, 3), (3, 1)]


def test_all_contradictions_of_a_component(spark):
    p = spark.createDataFrame([(0, 0, "zero"), (1, 1, "one")] + [(2 + i % 5, 2 + i, f"text {79 - i:02d}") for i in range(80)], "part long, idx long, text string")
    e = spark.createDataFrame([(0, 0, 1, 1, "CONFIRMED_BY")] + [(i % 2, i % 2, 2 + i % 5, 2 + i, "CONTRADICTED_BY") for i in range(80)], "part long, idx long, other_part long, other_idx long, kind string")
    head = Fed.collapsed(p, e).filter("idx = 0").first()
    # The least of all beginnings is that of the last place, which no list of the first 50 has.
    assert (head.members, head.machines, head.n_contradictions, head.first_contradiction) == (2, 2, 80, "text 00")
    rows = Fed.contradictions(p, e).filter("idx = 0").collect()
    assert sorted((r.other_part, r.other_idx, r.preview) for r in rows) == sorted((2 + i % 5, 2 + i, f"text {79 - i:02d}") for i in range(80))


def test_edges_are_found_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    p = spark.createDataFrame([(k, k) for k in range(3)], "part long, idx long")
    schema = "part long, idx long, other_part long, other_idx long, kind string"
    e = spark.createDataFrame([(0, 0, 1, 1, "CONFIRMED_BY"), (1, 1, 2, 2, "CONTRADICTED_BY")], schema).mapInArrow(count, schema)
    for f in (Fed.preserved, Fed.collapsed):
        before = runs.value
        f(p, e).collect()
        assert runs.value - before == 2


def test_balanced_is_global(spark, small):
    from palimpsest.plans.queries import QUERIES

    a, b = (sorted(map(tuple, QUERIES[n](spark, small).collect())) for n in ("multi_global", "multi_balanced"))
    assert a == b


def test_bad_mode(spark, small):
    with pytest.raises(ValueError, match="no such mode"):
        S.multi_search(None, [1.0], mode="other")


def test_names():
    assert T.safe_name("../../a b.cart") == "a b.cart"
    with pytest.raises(ValueError, match="not a collection"):
        T.safe_name(".hidden")


def flood(g):
    n, m = g.shape
    seen, out = set(), []
    for i in range(n * m):
        if i in seen:
            continue
        stack, cells = [i], []
        seen.add(i)
        while stack:
            x = stack.pop()
            cells.append(x)
            r, c = divmod(x, m)
            for a, b in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= a < n and 0 <= b < m and g[a, b] == g[r, c] and a * m + b not in seen:
                    seen.add(a * m + b)
                    stack.append(a * m + b)
        out.append((int(g[divmod(i, m)]), sorted(cells)))
    return sorted(out)


def test_components_of_grids():
    rng = np.random.default_rng(3)
    for _ in range(50):
        g = rng.integers(0, 3, (8, 8))
        assert sorted((c, x.tolist()) for c, x in G.label(g, 99)) == flood(g)


def test_state_hash_knows_equal_states(spark):
    a, b = [0] * 64, [0] * 64
    a[9] = b[9] = 3
    b[10] = 2
    f = spark.createDataFrame([(0, 0, a), (0, 1, b), (1, 0, a)], "level long, step long, cells array<int>")
    h = {(r.level, r.step): r.state for r in G.state_hash(G.objects(f, 8), G.background(f, 8)).collect()}
    assert h[0, 0] == h[1, 0] != h[0, 1]


def test_tracking(spark):
    a, b = [0] * 64, [0] * 64
    a[9], b[12] = 3, 3
    f = spark.createDataFrame([(0, 0, a), (0, 1, b)], "level long, step long, cells array<int>")
    found = G.objects(f, 8)
    assert [(r.color, r.d_row, r.d_col) for r in G.tracked(found).collect()] == [(3, 0.0, 3.0)]
    assert [r.was for r in G.carried(found).collect()] == [0]


def test_insights(spark):
    rows = spark.createDataFrame([("g", i, f"h{i % 12}", 0.5 + (i % 6) / 10) for i in range(60)], "game string, seq long, hypothesis string, confidence double")
    assert A.insights(rows).count() <= 10


def test_reasoning_record(spark):
    row = spark.createDataFrame([(("h", "s"),)], "r struct<hypothesis:string,strategy:string>")
    full = F.struct(F.col("r.hypothesis").alias("hypothesis"), F.col("r.strategy").alias("strategy"), *(F.lit(None).cast("string").alias(x) for x in ("key_insight", "action_rationale", "reasoning_text")))
    text = row.select(full.alias("r")).select(G.reasoning_text(F.col("r"), F.lit("L"), F.lit(7)).alias("t"))
    assert text.first().t.split("\n")[:3] == ["[SAGE] L | Step 7", "HYPOTHESIS: h", "STRATEGY: s"]
    assert text.select(G.record_of(F.col("t")).alias("j")).first().j == '{"hypothesis":"h","strategy":"s"}'


def test_reasoning_in_full(spark):
    """Head line, fields, salience, kind and then the record, in this order; a field may hold a line that looks like a record."""
    row = spark.createDataFrame([(("h", None, "k", None, "see\nRECORD:{}"), {"surprise": 0.125, "reward": 1.0}, "plan")], "r struct<hypothesis:string,strategy:string,key_insight:string,action_rationale:string,reasoning_text:string>, s map<string,double>, k string")
    t = row.select(G.reasoning_text(F.col("r"), F.lit("L"), F.lit(3), F.col("s"), F.col("k")).alias("t"))
    lines = t.first().t.split("\n")
    assert lines[:4] == ["[SAGE] L | Step 3", "HYPOTHESIS: h", "INSIGHT: k", "REASONING: see"]
    assert lines[5] in ("SALIENCE: S=0.12 N=0.00 A=0.00 R=1.00 C=0.00", "SALIENCE: S=0.13 N=0.00 A=0.00 R=1.00 C=0.00") and lines[6] == "COGNITIVE_TYPE: plan"
    record = json.loads(t.select(G.record_of(F.col("t")).alias("j")).first().j)
    assert record["hypothesis"] == "h" and record["salience"]["reward"] == 1.0 and record["cognitive_type"] == "plan"


def test_state_hash_with_relations(spark):
    """BLAKE2b of canonical JSON over objects with the objects next to them."""
    cells = [0, 1, 2, 0, 0, 1, 2, 0, 3, 0, 0, 0, 3, 0, 0, 0]
    f = spark.createDataFrame([(0, 0, cells), (0, 1, cells), (0, 2, [0, *cells[:-1]])], "level long, step long, cells array<int>")
    found = G.related(G.objects(f, 4), 4)
    got = {r.step: r.state for r in G.state_hash(found, G.background(f, 4)).collect()}
    objs = [(1, 2, 0.5, 1.0, [1]), (2, 2, 0.5, 2.0, [0]), (3, 2, 2.5, 0.0, [])]
    held = [{"c": c, "s": s, "cr": row, "cc": col, "props": "{}", "rels": json.dumps({"part_of": None, "on_top_of": [], "contains": [], "adjacent": near}, sort_keys=True)} for c, s, row, col, near in objs]
    text = json.dumps({"bg": 0, "objs": held}, sort_keys=True)
    assert got[0] == got[1] == hashlib.blake2b(text.encode(), digest_size=32).hexdigest() != got[2]


def test_paired_rows_have_vectors(spark):
    f = spark.createDataFrame([(1, 0, [1.0, -2.0]), (1, 1, None)], "level long, step long, embedding array<double>")
    rows = {r.idx: r for r in G.paired_rows(f).collect()}
    assert rows[0].embedding == [1.0, -2.0] and rows[0].sign_words == [2] and rows[1].embedding == [0.0, 0.0] and rows[1].sign_words == [0]
    assert rows[2].embedding is None and rows[3].embedding is None and "Awaiting" in rows[3].text


@pytest.mark.parametrize("stretch", [1, 7, 1000])
def test_contrastive_in_stretches(spark, monkeypatch, stretch):
    """One long series over many stretches, among short ones, equals going through it row by row."""
    monkeypatch.setattr(G, "STRETCH", stretch)
    rng = np.random.default_rng(2)
    rows = [(7, 3 * i, rng.random(5).tolist()) for i in range(60)] + [(s, 0, rng.random(5).tolist()) for s in range(5)] + [(8, i, rng.random(5).tolist()) for i in range(9)]
    df = spark.createDataFrame(rows, "series long, step long, embedding array<double>").repartition(3)
    got = {(r.series, r.step): r.embedding for r in G.contrastive(df, 0.9, 0.7).collect()}
    expected, mean = {}, {}
    for s, t, v in sorted(rows):
        v = np.array(v)
        mean[s] = v if s not in mean else 0.9 * mean[s] + 0.1 * v
        expected[s, t] = np.clip(v - 0.7 * mean[s], 0, 1)
    assert got.keys() == expected.keys() and all(np.allclose(got[k], expected[k]) for k in got)
    assert G.contrastive(df.filter("false")).count() == 0


def test_rendered_results(spark):
    top = spark.createDataFrame([(4, 0.123456, "[a,b] the body " + "word " * 200), (7, 0.5, "no tags"), (9, 0.4, None)], "idx long, score double, text string")
    links = spark.createDataFrame([(5, 4, 6), (8, None, 2), (1, 2, 3)], "pattern_id long, prev long, next long")
    got = {r.idx: r for r in S.rendered(top, links).collect()}
    assert got[4].score == 0.1235 and got[4].tags == "a,b" and got[4].full_text.startswith("the body word") and len(got[4].text) < 560 and got[4].text.endswith("…")
    assert (got[4].prev_idx, got[4].next_idx, got[7].prev_idx, got[7].next_idx, got[9].prev_idx) == (3, 5, None, 1, None)
    assert len(got) == 3 and "prev_idx" not in S.rendered(top).columns


def test_noisy_walk(spark):
    """The noise is reproducible, normal with a tenth of the temperature, and what it perturbs is the hubs only."""
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)], "idx long, embedding array<double>")
    from palimpsest.operators.walk import perturbed, walk

    v = {r.idx: np.array(r.embedding) for r in rows.collect()}
    p = {r.idx: np.array(r.embedding, float) for r in perturbed(rows, 2.0, 5).collect()}
    assert all(abs(np.linalg.norm(x) - 1) < 1e-5 for x in p.values())
    fresh = {r.idx: np.array(r.embedding, float) for r in perturbed(rows, 2.0, 6).collect()}
    assert any(not np.allclose(p[i], fresh[i]) for i in p)
    wide = {r.idx: np.array(r.embedding, float) for r in perturbed(rows.withColumn("embedding", F.transform("embedding", lambda x: x * 0.0)), 1.0, 5).collect()}
    spread = np.concatenate(list(wide.values())) * np.sqrt(8)  # normal directions of length 1
    assert abs(spread.mean()) < 0.05 and abs(spread.std() - 1) < 0.05
    q = v[0]
    unit = lambda x: x / (np.linalg.norm(x) + V.EPSILON)
    near = lambda x, n, skip=None: sorted((i for i in v if i != skip), key=lambda i: (-round(float(unit(v[i]) @ unit(x)), 12), i))[:n]
    hubs = near(q, 5)
    hits = {}
    for h in hubs:
        for i in near(p[h], 20, h):
            hits.setdefault(i, []).append(float(unit(v[i]) @ unit(p[h])))
    want = sorted(((len(s), sum(s) / len(s), i) for i, s in hits.items() if len(s) >= 2 and i not in hubs), key=lambda x: (-x[0], -x[1], x[2]))[:10]
    got = [(r.hits, r.mean_score, r.idx) for r in walk(rows, q.tolist(), 5, temperature=2.0, seed=5).collect()]
    assert [(h, i) for h, _, i in got] == [(h, i) for h, _, i in want] and np.allclose([m for _, m, _ in got], [m for _, m, _ in want], atol=1e-5)


def test_walk_listing(spark):
    from palimpsest.operators.walk import listing, parse_listing

    rows = spark.createDataFrame([(12, 3, 0.7121, "hello")], "idx long, hits long, mean_score double, text string")
    assert tuple(parse_listing(listing(rows)).first()) == (12, 3, 0.712, "hello")


@pytest.mark.parametrize("name", ["grid_objects", "grid_tracking", "grid_state_hash", "grid_adjacency", "grid_identity"])
def test_grid_queries_read_all_frames(spark, small, name):
    from palimpsest.plans.queries import QUERIES, frames

    folder = small.replace("sf0.001", "sf0.01")
    f = frames(spark, folder)
    last = {r.level: r.step for r in f.groupBy("level").agg(F.max("step").alias("step")).collect()}
    got = {r.level: r.step for r in QUERIES[name](spark, folder).groupBy("level").agg(F.max("step").alias("step")).collect()}
    assert min(last.values()) > 5 and set(got) == set(last) and all(got[k] > 5 for k in got)
    if name in ("grid_objects", "grid_state_hash"):
        assert got == last


def test_tracked_goes_over_calls_and_gaps(spark, monkeypatch):
    rows = [(0, step, 0, 1, float(step % 7), 0.0) for step in (0, 1, 2, 5, 6, 9)]
    found = spark.createDataFrame([(*r, []) for r in rows], "level long, step long, object int, color int, row double, col double, cells array<int>")
    monkeypatch.setattr(G, "STEPS", 3)
    assert sorted((r.step, r.d_row) for r in G.tracked(found).collect()) == [(1, 1.0), (2, 1.0), (5, 3.0), (6, 1.0), (9, -4.0)]


def test_neighbours_of_ragged_vectors(spark):
    from palimpsest.operators.nearest import neighbours

    rows = [(0, 0, [1.0, 0.0]), (1, 0, [1.0, 0.1]), (2, 0, [1.0, 2.0, 3.0]), (3, 0, [1.0, 2.0, 2.0]), (4, 0, None), (5, 0, [float("nan"), 1.0]), (6, 0, []), (7, 0, [None, 1.0])]
    got = neighbours(spark.createDataFrame(rows, "idx long, part long, embedding array<float>"), 3).collect()
    assert sorted((r.idx, r.other_idx) for r in got) == [(0, 1), (1, 0), (2, 3), (3, 2)]


def test_searches_fetch_texts_late(spark, small):
    """The texts of documents are read for candidates only: their scan is below a semi join."""
    from palimpsest.plans import queries as Q

    plan = Q.QUERIES["memory_search"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    above = plan.split("LeftSemi")[0]
    assert "text#" in above and "embedding#" in plan


def test_appended_signatures(spark, tmp_path):
    import numpy as np

    from palimpsest.sources import readers

    np.savez(tmp_path / "x_signatures.npz", signatures=np.ones((3, 4), np.float32), titles=np.array(["a", "b", "c"]), n_patterns=np.array(2))
    rows = readers.read_signatures(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.collection, r.idx, r.title, r.text, r.signature) for r in rows] == [("x", 0, "a", None, [1.0] * 4), ("x", 1, "b", None, [1.0] * 4)]


def test_properties_change_the_state(spark):
    from palimpsest.operators import grid as G

    cells = [0] * 60 + [1] * 4
    f = spark.createDataFrame([(0, 0, cells)], "level long, step long, cells array<int>")
    found, bg = G.objects(f, 8), G.background(f, 8)
    plain = G.state_hash(found, bg).first().state
    assert plain == G.state_hash(found.withColumn("object", F.col("object") + 7), bg).first().state
    assert plain != G.state_hash(found.withColumn("props", F.lit('{"door":1}')), bg).first().state


def test_chains_over_stretches(spark, monkeypatch):
    rng = random.Random(5)
    ids = rng.sample(range(200), 60)
    rows = [(i, rng.choice(["a", "b", None])) for i in ids]
    monkeypatch.setattr(B, "STRETCH", 8)
    got = {r.idx: r for r in B.links(spark.createDataFrame(rows, "idx long, source string")).collect()}
    for s in ("a", "b", None):
        chain = sorted(i for i, x in rows if x == s)
        for n, i in enumerate(chain):
            r = got[i]
            assert (r.pattern_id, r.prev, r.next, r.sequence_num) == (i + 1, chain[n - 1] + 1 if n else None, chain[n + 1] + 1 if n + 1 < len(chain) else None, n)


@pytest.mark.parametrize("few", [0, 20, 1 << 15])
def test_components_of_a_chain_and_a_star(spark, monkeypatch, few):
    from palimpsest.operators import forest

    monkeypatch.setattr(forest, "FEW", few)
    edges = [(i, i + 1) for i in range(100)] + [(200, 200 + i) for i in range(1, 50)] + [(300, 300)]
    random.Random(1).shuffle(edges)
    got = {r.id: r.component for r in forest.components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    assert got == {**dict.fromkeys(range(101), 0), **dict.fromkeys(range(200, 250), 200), 300: 300}


@pytest.mark.parametrize("name", ["frame_stream", "grid_adjacency", "grid_diff", "grid_identity", "grid_objects", "grid_observations", "grid_owners", "grid_tracking", "grid_vectors", "grid_without_overlay"])
def test_cells_of_components_that_round_up(spark, tmp_path, name):
    """Components just below a colour's least: four of them plus one is that colour in single precision, not in double."""
    import duckdb
    import oracle

    from palimpsest.plans.more import QUERIES, SQL

    below = [float(np.nextafter(np.float32(x), np.float32(-1))) for x in (0.25, 0.5)] + [-5e-9]
    drawn = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.where(drawn.random(64) < 0.2, drawn.choice(below, 64), drawn.normal(0, 0.15, 64)).astype(np.float32)], i % 2) for i in range(24)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert oracle.difference(QUERIES[name](spark, str(tmp_path)), SQL[name], con) == ""


def test_cells_of_components_out_of_bounds(spark, tmp_path):
    import duckdb
    import oracle

    from palimpsest.plans.queries import _FRAME, frames

    odd = [1e9, -1e9, 1e30, -3e38, 3e38, float("inf"), -float("inf"), float("nan"), None, -0.0, 0.75, -0.25]
    spark.createDataFrame([(7, odd, 0), (9, odd[::-1], 0), (8, [], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert oracle.difference(frames(spark, str(tmp_path)), f"with {_FRAME} select * from f", con) == ""
