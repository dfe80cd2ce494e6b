"""The registered queries: each operator applied to the given tables, and its SQL where there is one.

A collection is an embedding's label, its idx the vec_id; documents with doc_id = vec_id give
it texts. The query is the vector of id 0. Figures are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..functions import text as T
from ..functions import vector as V
from ..functions.runtime import ship
from ..operators import activity as A
from ..operators import build as B
from ..operators import federate as Fed
from ..operators import filters as Fil
from ..operators import grid as G
from ..operators import search as S
from ..operators.nearest import neighbours
from ..operators.walk import walk
from ..streaming import stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ASKED = "thing the ereon tion reth tion"
CREATED = 1_700_000_000


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = lambda spark, d: f(ship(spark), d)
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return e.select(F.col("label").cast("string").alias("collection"), F.col("label").cast("int").alias("mount_seq"), F.col("vec_id").alias("idx"), "embedding")


def bare(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """patterns without their texts, which are fetched late; columns: narrow ones of documents."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("idx"), *columns)
    return vectors(spark, d).join(docs, "idx")


def heap(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("idx"), "text")


def patterns(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.col("text"), "source", "lang")
    return vectors(spark, d).join(docs, "idx")


def asked(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in read(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"]]


def r6(name: str):
    return F.round(name, 6).alias(name)


_COS = "list_inner_product(e, q) / ((sqrt(list_inner_product(e, e)) + 1e-9) * (sqrt(list_inner_product(q, q)) + 1e-9))"
_SIGN = "1 - list_sum(list_transform(list_zip(e, q), lambda z: case when (z[1] > 0) <> (z[2] > 0) then 1 else 0 end)) / 64.0"
_Q = "q as (select embedding::double[] as q from embeddings where vec_id = 0), v as (select vec_id as idx, label, embedding::double[] as e from embeddings)"
_S = f"{_Q}, s as (select idx, label, {_COS} as cos, {_SIGN} as sign, 0.7 * ({_COS}) + 0.3 * ({_SIGN}) as score from v, q)"
_BOOST = "least(0.03 * (" + " + ".join(f"case when contains(lower(text), '{w}') then 1 else 0 end" for w in T.keywords(ASKED)) + "), 0.12)"


@query(f"with {_S} select idx, round(score, 6) as score from s order by s.score desc, idx limit 10")
def hybrid_topk(spark, d):
    return S.scored(vectors(spark, d), asked(spark, d)).orderBy(F.col("score").desc(), "idx").limit(10).select("idx", r6("score"))


@query(f"with {_S} select idx, round(cos, 6) as score from s order by s.cos desc, idx limit 10")
def cosine_topk(spark, d):
    return S.scored(vectors(spark, d), asked(spark, d), "cosine").orderBy(F.col("score").desc(), "idx").limit(10).select("idx", r6("score"))


@query(f"with {_S} select idx, round(sign, 6) as score from s order by s.sign desc, idx limit 10")
def sign_topk(spark, d):
    return S.scored(vectors(spark, d), asked(spark, d), "sign").orderBy(F.col("score").desc(), "idx").limit(10).select("idx", r6("score"))


@query(f"with {_S}, w as (select i / 20.0 as share, idx, i / 20.0 * cos + (1 - i / 20.0) * sign as sc from s, range(21) t(i)), n as (select *, row_number() over (partition by share order by sc desc, idx) as rank from w) select round(share, 6) as share, idx, rank, round(sc, 6) as score from n where rank <= 5")
def blend_sweep(spark, d):
    return S.blend_sweep(vectors(spark, d), asked(spark, d), 5).select(r6("share"), "idx", "rank", r6("score"))


_CUT = f"with {_S}, c as (select s.idx, score, text from s join documents on doc_id = s.idx order by score desc, s.idx limit 20), b as (select idx, score + {_BOOST} as score, text from c where score >= 0.05)"


@query(f"{_CUT} select idx, round(score, 6) as score, row_number() over (order by score desc, idx) as rank from (select * from b order by score desc, idx limit 5) where score >= 0.1")
def memory_search(spark, d):
    return S.search(bare(spark, d), asked(spark, d), ASKED, 5, heap=heap(spark, d)).select("idx", r6("score"), "rank")


@query(f"with {_S}, c as (select s.idx, score, text from s join documents on doc_id = s.idx where lang = 'en' and source in ('src1', 'src2', 'src3') order by score desc, s.idx limit 20), b as (select idx, score + {_BOOST} as score, text from c where score >= 0.05 and idx % 7 <> 0) select idx, round(score, 6) as score from (select * from b order by score desc, idx limit 5) where score >= 0.1")
def filtered_search(spark, d):
    p = bare(spark, d, "lang", "source").withColumn("flags", (F.col("idx") % 7 == 0).cast("int"))
    where = (F.col("lang") == "en") & F.col("source").isin("src1", "src2", "src3")
    return S.search(p, asked(spark, d), ASKED, 5, where=where, honor_tombstones=True, heap=heap(spark, d)).select("idx", r6("score"))


@query(f"with {_S}, c as (select s.idx, score, text from s join documents on doc_id = s.idx order by score desc, s.idx limit 20), b as (select idx, (score + {_BOOST}) * (0.5 + 0.5 * exp(-ln(2.0) * greatest(0.0, idx * 60.0) / 86400)) as score from c where score >= 0.05) select idx, round(score, 6) as score from (select * from b order by score desc, idx limit 5) where score >= 0.1")
def recency_search(spark, d):
    p = bare(spark, d).withColumn("ts_unix", F.lit(CREATED) - F.col("idx") * 60)
    return S.search(p, asked(spark, d), ASKED, 5, recency_as_of=CREATED, heap=heap(spark, d)).select("idx", r6("score"))


@query(f"with {_S}, c as (select s.idx, score, '[HEARTBEAT,turn-' || (s.idx // 3 % 5) || ',url=a.example/' || label || '] ' || text as text, label from s join documents on doc_id = s.idx order by score desc, s.idx limit 20), b as (select idx, score + {_BOOST} as score, row_number() over (partition by label, idx // 3 % 5 order by score + {_BOOST} desc, idx) as n from c where score >= 0.05) select idx, round(score, 6) as score from (select * from b where n = 1 order by score desc, idx limit 5) where score >= 0.1")
def dedup_search(spark, d):
    text = F.concat(F.lit("[HEARTBEAT,turn-"), (F.floor(F.col("idx") / 3) % 5).cast("string"), F.lit(",url=a.example/"), "collection", F.lit("] "), "text")
    return S.search(patterns(spark, d).withColumn("text", text), asked(spark, d), ASKED, 5, dedup=True).select("idx", r6("score"))


_M = f"with {_S}, p as (select s.*, text, row_number() over (partition by label order by score desc, s.idx) as n0 from s join documents on doc_id = s.idx), b as (select idx, label, score + {_BOOST} as sc from p where n0 <= 40 and score >= 0.05 {{where}}), m as (select *, row_number() over (partition by label order by sc desc, idx) as n from b)"


@query(_M.format(where="") + " select label::varchar as collection, idx, round(sc, 6) as score from m order by sc desc, label, idx limit 10")
def multi_global(spark, d):
    return S.multi_search(bare(spark, d), asked(spark, d), ASKED, 10, heap=heap(spark, d)).select("collection", "idx", r6("score"))


@query(_M.format(where="") + " select label::varchar as collection, idx, n as rank_in_collection, round(sc, 6) as score from m where n <= 5")
def multi_per_collection(spark, d):
    return S.multi_search(bare(spark, d), asked(spark, d), ASKED, 5, mode="per_collection", heap=heap(spark, d)).select("collection", "idx", "rank_in_collection", r6("score"))


@query(_M.format(where="") + " select label::varchar as collection, idx, round(sc, 6) as score from m where n <= 10 order by sc desc, label, idx limit 10")
def multi_balanced(spark, d):
    return S.multi_search(bare(spark, d), asked(spark, d), ASKED, 10, mode="balanced", heap=heap(spark, d)).select("collection", "idx", r6("score"))


@query(_M.format(where="and label % 2 = 0") + " select label::varchar as collection, idx, n as rank_in_collection, round(sc, 6) as score from m where n <= 3")
def multi_role_filter(spark, d):
    p = bare(spark, d).withColumn("role", F.when(F.col("mount_seq") % 2 == 0, "wiki").otherwise("notes"))
    return S.multi_search(p, asked(spark, d), ASKED, 3, roles=["wiki"], mode="diagnostic", heap=heap(spark, d)).select("collection", "idx", "rank_in_collection", r6("score"))


@query(_M.format(where="and label in (1, 3)") + " select label::varchar as collection, idx, round(sc, 6) as score from m order by sc desc, label, idx limit 10")
def multi_scope(spark, d):
    return S.multi_search(bare(spark, d), asked(spark, d), ASKED, 10, scope=["1", "3"], heap=heap(spark, d)).select("collection", "idx", r6("score"))


@query(f"with {_S}, f as (select idx from s order by cos desc, idx limit 10), h as (select v.idx as hub, v.e as q from v join f using (idx)), p as (select hub, v.idx, {_COS} as c from v, h where v.idx <> hub), n as (select *, row_number() over (partition by hub order by c desc, idx) as r from p), m as (select idx, count(*) as hits, avg(c) as mean_score from n where r <= 30 group by idx having count(*) >= 2) select idx, hits, round(mean_score, 6) as mean_score from m where idx not in (select idx from f) order by hits desc, m.mean_score desc, idx limit 10")
def walk_associate(spark, d):
    return walk(vectors(spark, d), asked(spark, d), 10).select("idx", "hits", r6("mean_score"))


_PAIRS = f"with v as (select vec_id as idx, label, embedding::double[] as e from embeddings), p as (select a.idx, a.label as part, b.idx as other_idx, b.label as other_part, {_COS.replace('(e, q)', '(a.e, b.e)').replace('(e, e)', '(a.e, a.e)').replace('(q, q)', '(b.e, b.e)')} as c, {_SIGN.replace('list_zip(e, q)', 'list_zip(a.e, b.e)')} as h from v a, v b where {{on}}), n as (select *, {{score}} as score, row_number() over (partition by idx order by {{score}} desc, {{tie}}other_idx) as rank from p)"
_NEAR = _PAIRS.format(on="a.idx <> b.idx", score="c", tie="")
_SIM = _PAIRS.format(on="a.label <> b.label", score="(0.7 * c + 0.3 * h)", tie="other_part, ")


@query(_NEAR.replace("order by c desc, other_idx", "order by c desc, other_part, other_idx") + " select idx, other_idx, rank, round(score, 6) as score from n where rank <= 5")
def knn_all(spark, d):
    v = vectors(spark, d).withColumn("part", F.col("mount_seq"))
    return neighbours(v, 5).select("idx", "other_idx", "rank", r6("score"))


def parts(spark, d):
    """Patterns with as much of their texts as is compared or shown, so that no more is shuffled."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.left("text", F.lit(Fed.COMPARED)).alias("text"))
    return vectors(spark, d).join(docs, "idx").withColumn("part", F.col("mount_seq"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(left({t}, 500)), '[ \\t\\n\\r\\f]+'), lambda x: x <> ''))"
_JAC = f"case when len({_WORDS}) = 0 or len({_WORDS.replace('{t}', '{u}')}) = 0 then 0.0 else len(list_intersect({_WORDS}, {_WORDS.replace('{t}', '{u}')})) / len(list_distinct(list_concat({_WORDS}, {_WORDS.replace('{t}', '{u}')})))::double end"
_EDGE = _PAIRS.replace("from embeddings)", "from embeddings join documents on doc_id = vec_id)").replace("as h from v a", "as h, a.t, b.t as u from v a").replace("embedding::double[] as e", "embedding::double[] as e, text as t").format(on="a.label <> b.label", score="(0.7 * c + 0.3 * h)", tie="other_part, ")
#: Test vectors are far from 768 dimensions, so the registered queries look for edges at lower scores.
CONFIRMED, CLOSE = 0.62, 0.50
_EDGES = f"{_EDGE}, j as (select *, {_JAC.format(t='t', u='u')} as text_overlap from n where rank <= 3), k as (select *, case when score >= {CONFIRMED} then 'CONFIRMED_BY' when score >= {CLOSE} and text_overlap < 0.3 then 'CONTRADICTED_BY' end as kind from j), ed as (select * from k where kind is not null)"


def _edges(spark, d):
    return Fed.edges(Fed.similar_pairs(parts(spark, d), least=min(CONFIRMED, CLOSE)), CONFIRMED, CLOSE)


@query(f"{_EDGES} select part, idx, other_part, other_idx, kind, round(score, 6) as score, round(text_overlap, 6) as text_overlap from ed")
def sim_join_edges(spark, d):
    return _edges(spark, d).select(F.col("part").cast("int").alias("part"), "idx", F.col("other_part").cast("int").alias("other_part"), "other_idx", "kind", r6("score"), r6("text_overlap"))


_BOTH = "bo as (select idx, other_idx, other_part, kind from ed union select other_idx, idx, part, kind from ed)"


@query(f"{_EDGES}, {_BOTH}, n2 as (select idx, count(distinct other_part) filter (where kind = 'CONFIRMED_BY') as confirmations, count(distinct other_part) filter (where kind = 'CONTRADICTED_BY') as contradictions from bo group by idx) select vec_id as idx, coalesce(confirmations, 0)::int as confirmations, coalesce(contradictions, 0)::int as contradictions, case when coalesce(confirmations, 0) >= 2 then 'high' when confirmations = 1 then 'single_corroboration' else 'single_source' end as trust_signal from embeddings join documents on doc_id = vec_id left join n2 on n2.idx = vec_id")
def preserve_set(spark, d):
    out = Fed.preserved(parts(spark, d), _edges(spark, d))
    against = F.when(F.col("contradicted_by").isNull(), 0).otherwise(F.size("contradicted_by"))
    return out.select("idx", "confirmations", against.alias("contradictions"), "trust_signal")


@query(f"with recursive {_EDGES.removeprefix('with ')}, {_BOTH}, l as (select idx, other_idx from bo where kind = 'CONFIRMED_BY'), nodes as (select vec_id as idx, label as part from embeddings join documents on doc_id = vec_id), r as (select idx, idx as c from nodes union select l.idx, r.c from r join l on l.other_idx = r.idx), m as (select idx, min(c) as c from r group by idx) select min(m.idx) as component, count(*) as members, count(distinct part)::int as machines from m join nodes using (idx) group by c")
def collapse_components(spark, d):
    p = parts(spark, d)
    labels = Fed.components(p, Fed.symmetric(_edges(spark, d).filter("kind = 'CONFIRMED_BY'")))
    return p.select("part", "idx").join(labels, "idx").groupBy("component").agg(F.count("*").alias("members"), F.count_distinct("part").cast("int").alias("machines"))


@query(f"{_EDGES} select (select count(*) from embeddings join documents on doc_id = vec_id) as n_patterns, count(*) filter (where kind = 'CONFIRMED_BY') as n_confirmed, count(*) filter (where kind = 'CONTRADICTED_BY') as n_contradicted from ed")
def consolidate_stats(spark, d):
    return Fed.statistics(parts(spark, d), _edges(spark, d))


@query(_NEAR + ", w as (select idx, part, other_idx, other_part, rank from n where rank <= 10), t as (select a.vec_id as idx, count(*) as n from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id group by a.vec_id), h as (select idx, count(*) as hits, min(rank) as first from w where part = other_part group by idx) select count(*) as queries, round(avg(coalesce(hits / n::double, 0)), 6) as recall, round(avg(coalesce(1.0 / first, 0)), 6) as mrr from t left join h using (idx)")
def recall_mrr(spark, d):
    v = vectors(spark, d).withColumn("part", F.col("mount_seq"))
    ranked = neighbours(v, 10).select(F.col("idx").alias("query"), F.col("other_idx").alias("idx"), "rank")
    return Fed.metrics_by_label(ranked, v.select("idx", "part"), 10).select("queries", r6("recall"), r6("mrr"))


def tagged(spark, d):
    docs = read(spark, d, "documents").join(read(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")
    meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("support_count"), F.col("quality").cast("string"))
    return docs.select(F.col("doc_id").alias("idx"), F.concat(F.lit("[game:"), "source", F.lit(","), "lang", F.lit("] "), "text").alias("text"), meta.alias("meta"))


@query("select doc_id as idx from documents where lang = 'en' and source = 'src3' order by doc_id limit 500")
def filter_tags_all(spark, d):
    return Fil.enumerate_filter(tagged(spark, d), {"tags_all": ["en", "game:src3"]}).select("idx")


@query("select doc_id as idx from documents where lang = 'fr' or source = 'src5' order by doc_id limit 500")
def filter_tags_any(spark, d):
    return Fil.enumerate_filter(tagged(spark, d), {"tags_any": ["fr", "game:src5"]}).select("idx")


@query("select doc_id as idx from documents where lang is not null order by doc_id limit 100")
def filter_tag_prefix(spark, d):
    return Fil.enumerate_filter(tagged(spark, d), {"tags_all": ["game:"], "limit": 100}).select("idx")


@query("select doc_id as idx from documents where lang = 'de' order by doc_id limit 10000")
def filter_meta(spark, d):
    return Fil.enumerate_filter(tagged(spark, d), {"meta": {"lang": "de"}, "limit": 10000}).select("idx")


@query("select doc_id as idx from documents left join (select doc_id, max(quality) as q from labels group by doc_id) using (doc_id) where q is null or q >= 1 order by doc_id limit 10000")
def filter_quality(spark, d):
    return Fil.enumerate_filter(tagged(spark, d), {"quality": {"support_count_min": 1}, "limit": 10000}).select("idx")


@query("select doc_id as idx, case when length(t) > 1200 then left(t, 1200) || '...' else t end as text from (select doc_id, '[game:' || source || ',' || lang || '] ' || text as t from documents) order by doc_id limit 500")
def enumerate_filter(spark, d):
    return Fil.enumerate_filter(tagged(spark, d), {})


@query("select doc_id as idx from documents where doc_id > 1 and lang = 'en' and contains(lower(text), 'thing') order by doc_id desc limit 50 offset 5")
def browse_patterns(spark, d):
    return Fil.browse(tagged(spark, d), "EN", "THING", 5, 50).select("idx")


@query("with c as (select conv_id, turn, '[HEARTBEAT,turn-' || (turn // 2) || ',url=a.example/' || conv_id || ']' as t from conversations union all select conv_id, turn, '[Agent | Turn ' || (turn // 2) || ' | x | a.example/' || conv_id || ']' from conversations) select 'a.example/' || conv_id || '|turn-' || (turn // 2) as key, count(*) as rows from c group by 1")
def exchange_dedup(spark, d):
    c = read(spark, d, "conversations")
    half = F.floor(F.col("turn") / 2).cast("string")
    comma = c.select(F.concat(F.lit("[HEARTBEAT,turn-"), half, F.lit(",url=a.example/"), F.col("conv_id").cast("string"), F.lit("] "), "text").alias("text"))
    pipe = c.select(F.concat(F.lit("[Agent | Turn "), half, F.lit(" | x | a.example/"), F.col("conv_id").cast("string"), F.lit("] "), "text").alias("text"))
    return comma.unionAll(pipe).groupBy(T.exchange_key(F.col("text")).alias("key")).agg(F.count("*").alias("rows"))


_LINK = "l as (select doc_id as idx, source, text, lag(doc_id) over w + 1 as prev, lead(doc_id) over w + 1 as next, row_number() over w - 1 as sequence_num from documents window w as (partition by source order by doc_id))"


@query(f"with {_LINK} select idx, idx + 1 as pattern_id, prev, next, sequence_num::int as sequence_num, ('0x' || substr(md5(source), 1, 8))::bigint as source_hash, (case when prev is null then 0 else 4 end + case when next is null then 0 else 8 end)::int as flags from l")
def build_metadata(spark, d):
    docs = read(spark, d, "documents").withColumnRenamed("doc_id", "idx")
    return B.links(docs).select("idx", "pattern_id", "prev", "next", F.col("sequence_num").cast("int").alias("sequence_num"), "source_hash", "flags")


@query(f"with {_LINK} select a.idx, left(p.text, 120) as prev_text, left(n.text, 120) as next_text from l a left join documents p on p.doc_id = a.prev - 1 left join documents n on n.doc_id = a.next - 1")
def passage_links(spark, d):
    docs = read(spark, d, "documents").withColumnRenamed("doc_id", "idx")
    return B.passage_links(B.links(docs)).select("idx", "prev_text", "next_text")


@query("select source, ('0x' || substr(md5(source), 1, 8))::bigint as source_hash from documents group by source")
def source_hash(spark, d):
    return read(spark, d, "documents").select("source").distinct().select("source", T.source_hash(F.col("source")).alias("source_hash"))


@query("select vec_id as idx, label::varchar as collection, text from embeddings join documents on doc_id = vec_id where vec_id = 7")
def get_passage(spark, d):
    p = patterns(spark, d)
    return Fil.passage(p, read(spark, d, "embeddings").filter("vec_id = 7").first()["label"].__str__(), 7).select("idx", "collection", "text")


_SPLIT = "list_filter(regexp_split_to_array({t}, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')"


@query(f"with w as (select doc_id, text, {_SPLIT.format(t='text')} as ws from documents), c as (select doc_id, 0 as chunk, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as t from w where len(ws) <= 300 union all select doc_id, (st // 250)::int, array_to_string(ws[st + 1:st + 300], ' ') from (select doc_id, ws, unnest(range(0, len(ws), 250)) as st from w where len(ws) > 300)) select doc_id, chunk, md5(t) as digest from c")
def chunk_words(spark, d):
    return B.word_chunks(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", "chunk", F.md5("text").alias("digest"))


@query(f"with w as (select doc_id, source, lang, {_SPLIT.format(t='text')} as ws from documents) select doc_id, (st // 160)::int as chunk, md5('[' || source || ' by ' || lang || '] ' || array_to_string(ws[st + 1:st + 200], ' ')) as digest from (select *, unnest(range(0, len(ws), 160)) as st from w)")
def passage_chunks(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source", "lang", "text")
    return B.prefixed_chunks(docs, F.col("source"), F.col("lang")).select("doc_id", "chunk", F.md5("text").alias("digest"))


@query("select doc_id, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) as digest from documents")
def strip_boilerplate(spark, d):
    docs = read(spark, d, "documents")
    body = F.concat(F.lit("Front matter\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n"), "text", F.lit("\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nlicence"))
    return docs.withColumn("text", body).select("doc_id", F.md5(B.strip_boilerplate(F.col("text"))).alias("digest"))


_AT = "nullif(case when strpos(substr(text, 251), '{m}') > 0 then strpos(substr(text, 251), '{m}') + 250 else 0 end, 0)"
_CUTS = ", ".join(f"case when {_AT.format(m=m)} - 1 + {n} <= 550 then {_AT.format(m=m)} - 1 + {n} end" for m, n in ((". ", 2), ("? ", 2), ("! ", 2)))
_NL = "case when strpos(substr(text, 251), chr(10)) > 0 and strpos(substr(text, 251), chr(10)) + 250 <= 550 then strpos(substr(text, 251), chr(10)) + 250 end"
_LASTSPACE = "case when strpos(reverse(substr(text, 251, 300)), ' ') > 0 then 550 - strpos(reverse(substr(text, 251, 300)), ' ') end"


@query(f"select doc_id, case when length(text) <= 550 then text else rtrim(substr(text, 1, coalesce({_CUTS}, {_NL}, {_LASTSPACE}, 550))) || ' …' end as text from documents")
def soft_truncate(spark, d):
    return read(spark, d, "documents").select("doc_id", T.soft_truncate(F.col("text")).alias("text"))


@query("select a.doc_id, round(" + _JAC.format(t="a.text", u="b.text") + ", 6) as overlap from documents a join documents b on b.doc_id = a.doc_id + 1")
def word_overlap(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.left("text", F.lit(500)).alias("text"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return docs.join(after, "doc_id").select("doc_id", F.round(T.jaccard(F.col("text"), F.col("other")), 6).alias("overlap"))


def entries(spark, d):
    e = read(spark, d, "events")
    return e.select(F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("machine"), F.lit("p").alias("player"), F.col("event_type").alias("game"), (F.col("user_id") % 4 - 1).cast("int").alias("level"), F.lit("level_solved").alias("event"), (F.col("event_id") % 50).cast("string").alias("timestamp"), F.get_json_object("props", "$.k").alias("structural_pattern"), "event_id")


_SIGN_OF = "'m' || (user_id % 3) || '|' || event_type || '|' || (user_id % 4 - 1) || '|level_solved|' || (event_id % 50) || '|' || coalesce(json_extract_string(props, '$.k'), '')"


@query(f"with s as (select event_id, {_SIGN_OF} as signature from events) select distinct signature from s where event_id % 2 = 0 and signature not in (select signature from s where event_id % 2 = 1)")
def publish_dedup(spark, d):
    e = entries(spark, d)
    e = e.withColumn("signature", Fed.signature(e))
    return Fed.publish(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1")).select("signature")


@query("select event_id, '[m' || (user_id % 3) || '/p ' || event_type || ' ' || case when user_id % 4 >= 1 then 'L' || (user_id % 4 - 1) else 'L-game' end || ' level_solved @ ' || (event_id % 50) || ']' || chr(10) || case when json_extract_string(props, '$.k') is not null then 'PATTERN: ' || json_extract_string(props, '$.k') else '{}' end as text from events")
def entry_text(spark, d):
    e = entries(spark, d)
    return e.select("event_id", Fed.entry_text(e.drop("event_id")).alias("text"))


def at(spark, d):
    return read(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))


@query("select event_id, event_type from events where ts > (select min(ts) from events) and event_type in ('click', 'error') order by ts desc, event_id desc limit 50")
def activity_feed(spark, d):
    e = at(spark, d).withColumn("created_at", F.col("at"))
    return Fil.activity(e, str(e.agg(F.min("at")).first()[0]), ["click", "error"]).select("event_id", "event_type")


@query("with n as (select *, row_number() over (partition by user_id % 10 order by ts desc, event_id desc) as r from events) select (user_id % 10)::varchar as collection, event_type as agent, count(*) as writes from n where r <= 100 group by all")
def activity_by_agent(spark, d):
    e = at(spark, d).withColumn("collection", (F.col("user_id") % 10).cast("string")).withColumn("agent", F.col("event_type"))
    return A.writers(e)


@query("with n as (select event_id, user_id, row_number() over (partition by user_id order by ts desc, event_id desc) as place from events) select * from n where place <= 10")
def latest_events(spark, d):
    return A.latest(at(spark, d), "user_id", 10).select("event_id", "user_id", "place")


@query("select event_id from events order by ts desc, event_id desc limit 50")
def activity_ring(spark, d):
    return A.ring(at(spark, d)).select("event_id")


@query("with g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) > 1800000000 then 1 else 0 end as g from events), s as (select *, sum(g) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from g) select user_id, session::bigint as session, epoch_us(min(ts)) as started, epoch_us(max(ts)) as ended, count(*) as events from s group by user_id, session")
def sessionize(spark, d):
    s = A.sessions(at(spark, d).select("user_id", "event_id", "at"))
    return s.select("user_id", F.col("session").cast("long").alias("session"), F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "events")


@query("with l as (select user_id as session_id, (epoch_us(max(ts)) // 1000000) as last_seen from events group by user_id), m as (select max(last_seen) as as_of from l), r as (select *, row_number() over (order by last_seen desc, session_id) as n from l) select session_id, case when as_of - last_seen > 1800 then 'expired' when n > 50 then 'evicted' when as_of - last_seen > 300 then 'idle' else 'active' end as status from r, m")
def session_status(spark, d):
    seen = at(spark, d).groupBy(F.col("user_id").alias("session_id")).agg(F.floor(F.unix_micros(F.max("at")) / 1_000_000).alias("last_seen"))
    return A.session_status(seen, seen.agg(F.max("last_seen")).first()[0]).select("session_id", "status")


@query()
def rate_limit(spark, d):
    e = at(spark, d).select((F.col("user_id") % 20).alias("client"), "event_id", (F.unix_micros("at") / 1e6).alias("t"))
    return stateful.rate_limited(e, 3, 3600.0)


@query()
def lease_lock(spark, d):
    e = at(spark, d).select((F.col("user_id") % 20).cast("string").alias("collection"), "event_id", (F.unix_micros("at") / 1e6).alias("t"), (F.col("user_id") % 7).cast("string").alias("agent"), F.when(F.col("event_id") % 3 == 0, "release").otherwise("acquire").alias("action"), F.lit(600.0).alias("lease"))
    return stateful.leases(e)


@query("select event_type as action, count(*) as tries, sum((value > 50)::int)::bigint as changes, round(sum((value > 50)::int) / count(*)::double, 6) as effectiveness from events group by event_type")
def action_effectiveness(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("action"), (F.coalesce("value", F.lit(0.0)) > 50).alias("changed"))
    return A.action_effectiveness(e).select("action", "tries", "changes", r6("effectiveness"))


@query("with b as (select user_id as state, count(*) as total from events group by user_id having count(*) >= 3 order by total desc, state limit 5) select state, event_type as action, count(*) as tries, round(sum((value > 50)::int) / count(*)::double, 6) as effectiveness from events join b on user_id = state group by state, event_type")
def state_effectiveness(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("state"), F.col("event_type").alias("action"), (F.coalesce("value", F.lit(0.0)) > 50).alias("changed"))
    return A.state_effectiveness(e).select("state", "action", "tries", r6("effectiveness"))


@query("select user_id as game, max(event_id % 7) as levels, arg_min(event_id % 100, (-(event_id % 7)) * 1000 + event_id % 100) as steps from events group by user_id")
def best_score(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("game"), (F.col("event_id") % 7).alias("levels"), (F.col("event_id") % 100).alias("steps"))
    return A.best_score(e, "game")


@query("with f as (select user_id as game, event_type || ' (confidence: ' || printf('%.1f', (event_id % 11) / 10.0 * 100) || '%)' as insight, min(event_id) as seq from events where event_id % 11 >= 7 group by all), n as (select *, row_number() over (partition by game order by seq desc, insight) as n from f) select game, insight, seq from n where n <= 10")
def insights(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("game"), F.col("event_id").alias("seq"), F.col("event_type").alias("hypothesis"), ((F.col("event_id") % 11) / 10).alias("confidence"))
    return A.insights(e)


@query("with n as (select count(*) as n from documents) select doc_id as idx from documents, n where doc_id in (select floor(i * n / 100.0)::bigint from range(100) t(i), n)")
def even_sample(spark, d):
    return B.even_sample(read(spark, d, "documents").select(F.col("doc_id").alias("idx")), 100)


#: A vector's bytes, each component's sign, exponent and fraction put together as its format has them.
_EXP = "(floor(log2(abs(x))) + case when abs(x) / pow(2, floor(log2(abs(x)))) >= 2 then 1 when abs(x) / pow(2, floor(log2(abs(x)))) < 1 then -1 else 0 end)"
_U32 = f"case when x = 0 then 0 else (case when x < 0 then 2147483648 else 0 end) + (({_EXP} + 127) * 8388608)::bigint + ((abs(x) / pow(2, {_EXP}) - 1) * 8388608)::bigint end"
_FLOATS = f"c as (select label, vec_id, i, {_U32} as u from (select label, vec_id, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings)), h as (select label, vec_id, string_agg(printf('%02x%02x%02x%02x', u & 255, (u >> 8) & 255, (u >> 16) & 255, (u >> 24) & 255), '' order by i) as hex from c group by label, vec_id)"


@query(f"with {_FLOATS}, m as (select label, count(*) as n, arg_min(hex, vec_id) as a, arg_max(hex, vec_id) as z from h group by label) select label::varchar as collection, n as n_patterns, 64 as dim, left(sha256(unhex(a || z || hex(encode(n::varchar)))), 16) as fingerprint from m")
def catalog_manifest(spark, d):
    return B.manifest(vectors(spark, d)).select("collection", "n_patterns", "dim", "fingerprint")


@query("select label::varchar as collection, label % 2 = 0 as ok from embeddings group by label")
def catalog_verify(spark, d):
    m = B.manifest(vectors(spark, d))
    spoiled = m.withColumn("n_patterns", F.col("n_patterns") + (F.col("collection").cast("int") % 2))
    return B.verify(vectors(spark, d), spoiled)


@query("with f as (select *, case when n_name = 'AT' then 0 when contains(lower(n_name), 'at') then 1 end as k from nation) select n_name as name, count(*) over () as matches from f where k = (select min(k) from f)")
def resolve_name(spark, d):
    return Fil.resolve_name(read(spark, d, "nation").select(F.col("n_name").alias("name")), "AT").select("name", "matches")


@query("select o_custkey as owner_id, 'pack' as name, count(*) as rows from (select distinct o_custkey from orders union all select c_custkey from customer where c_custkey not in (select o_custkey from orders)) group by 1, 2")
def provision(spark, d):
    have = read(spark, d, "orders").select(F.col("o_custkey").alias("owner_id"), F.lit("pack").alias("name")).distinct()
    want = read(spark, d, "customer").select(F.col("c_custkey").alias("owner_id"), F.lit("pack").alias("name"))
    return A.provision(have, want).groupBy("owner_id", "name").agg(F.count("*").alias("rows"))


_FRAME = "f as (select label::bigint as level, row_number() over (partition by label order by vec_id) - 1 as step, list_transform(embedding, lambda x: greatest(0, least(3, floor(x * 4 + 1)))::int) as cells from embeddings)"


def frames(spark, d):
    own = Window.partitionBy("label").orderBy("vec_id")
    # In the components' own precision, as SQL has it (Spark takes a float times an int as doubles); bounded before it is an int.
    n = lambda x: F.lit(float(x)).cast("float")
    cells = F.transform("embedding", lambda x: F.floor(F.greatest(n(0), F.least(n(3), x * n(4) + n(1)))).cast("int"))
    return read(spark, d, "embeddings").select(F.col("label").cast("long").alias("level"), (F.row_number().over(own) - 1).cast("long").alias("step"), cells.alias("cells"))


@query(f"with {_FRAME}, c as (select level, step, unnest(cells) as color from f), n as (select level, step, color, count(*) as cells from c group by all), r as (select *, row_number() over (partition by level, step order by cells desc, color) as r from n) select level, step, color as background from r where r = 1")
def grid_background(spark, d):
    return G.background(frames(spark, d), 8)


@query(f"with {_FRAME}, c as (select level, step, unnest(range(64)) as p, unnest(cells) as color from f) select a.level, a.step, (a.p // 8)::int as r, (a.p % 8)::int as c, b.color as was, a.color as now from c a join c b on a.level = b.level and a.p = b.p and b.step = a.step - 1 where a.color <> b.color")
def grid_diff(spark, d):
    return G.diff(frames(spark, d), 8)


@query()
def grid_objects(spark, d):
    return G.objects(frames(spark, d), 8).select("level", "step", "color", "size", "r0", "r1")


@query()
def grid_tracking(spark, d):
    return G.tracked(G.objects(frames(spark, d), 8))


@query()
def grid_state_hash(spark, d):
    f = frames(spark, d)
    return G.state_hash(G.related(G.objects(f, 8), 8), G.background(f, 8))


@query()
def grid_adjacency(spark, d):
    return G.adjacent(G.objects(frames(spark, d), 8), 8)


@query()
def grid_identity(spark, d):
    return G.carried(G.objects(frames(spark, d), 8))


@query()
def frame_changes(spark, d):
    return stateful.frame_changes(frames(spark, d))


@query(f"with {_FRAME}, q as (select cells as x from f where level = 0 and step = 0) select level, step, round(list_sum(list_transform(list_zip(cells, x), lambda z: case when z[1] = z[2] then 1 else 0 end)) / 64.0, 6) as similarity from f, q where list_sum(list_transform(list_zip(cells, x), lambda z: case when z[1] = z[2] then 1 else 0 end)) / 64.0 >= 0.4")
def similar_snapshots(spark, d):
    f = frames(spark, d).withColumn("idx", F.col("level") * 1_000_000 + F.col("step"))
    first = [int(x) for x in f.filter("level = 0 and step = 0").first()["cells"]]
    return S.find_similar(f, first, 0.4).select("level", "step", r6("similarity"))


_MINMAX = "(x::double - list_min(e)::double) / (list_max(e)::double - list_min(e)::double)"


@query(f"with v as (select vec_id as idx, embedding as e from embeddings) select idx, list_sum(list_transform(e, lambda x: floor(floor({_MINMAX} * 255) / 255 * 4096)))::bigint as active from v")
def thermometer(spark, d):
    return vectors(spark, d).select("idx", F.aggregate(V.thermometer(F.col("embedding")), F.lit(0).cast("long"), lambda a, x: a + x).alias("active"))


@query(f"with v as (select vec_id as idx, embedding as e from embeddings) select idx, round(list_sum(list_transform(e, lambda x: {_MINMAX})), 6) as total from v")
def rescale(spark, d):
    return vectors(spark, d).select("idx", F.round(F.aggregate(V.rescale(F.col("embedding")), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query()
def contrastive_imprint(spark, d):
    f = read(spark, d, "embeddings").select(F.col("label").cast("long").alias("series"), F.col("vec_id").alias("step"), V.rescale(F.col("embedding")).alias("embedding"))
    return G.contrastive(f)


@query("select doc_id as idx, '[BEIR,doc=' || doc_id || ']Title: ' || source || chr(10) || chr(10) || text as text, doc_id::varchar as document from documents")
def ir_passages(spark, d):
    c = read(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), "text")
    return Fed.ir_passage(c).select("idx", "text", Fed.document_of(F.col("text")).alias("document"))


@query("select doc_id, i::bigint as bits, case when i & 1 > 0 then 'r' else '-' end || case when i & 2 > 0 then 'w' else '-' end || case when i & 4 > 0 then 'd' else '-' end || case when i & 8 > 0 then 'a' else '-' end as perms, i::int as back from (select doc_id, quality + 2 * toxic + 4 * (doc_id % 2) + 8 * (doc_id // 2 % 2) as i from labels)")
def perms(spark, d):
    bit = lambda c, n: F.coalesce(F.col(c), F.lit(0)) * n
    bits = read(spark, d, "labels").select("doc_id", (bit("quality", 1) + bit("toxic", 2) + F.col("doc_id") % 2 * 4 + F.floor(F.col("doc_id") / 2) % 2 * 8).cast("long").alias("bits"))
    text = bits.withColumn("perms", T.perms_text(F.col("bits")))
    return text.withColumn("back", T.perms_bits(F.col("perms")))


@query("select doc_id as idx, true as same from documents")
def link_codec(spark, d):
    linked = B.links(read(spark, d, "documents").withColumnRenamed("doc_id", "idx"))
    link = F.struct(*(F.col(c).cast("long").alias(c) if c in linked.columns else F.lit(1 if c == "format_version" else 0).cast("long").alias(c) for c in codec.FIELDS))
    out = linked.select("idx", "prev", "pattern_id", codec.unpack_link(codec.pack_link(link)).alias("b"))
    return out.select("idx", (F.col("b.pattern_id") == F.col("pattern_id")).__and__(F.col("b.prev").eqNullSafe(F.col("prev"))).alias("same"))


@query("select (user_id % 10)::varchar as collection, count(distinct user_id) as sessions from events group by 1")
def reference_counts(spark, d):
    return A.reference_counts(read(spark, d, "events").select((F.col("user_id") % 10).cast("string").alias("collection"), F.col("user_id").alias("session_id")))


@query("select doc_id as idx, 'dst' as pack, text || chr(10) || chr(10) || '[copied from ' || source || '#' || doc_id || ' on 2024-01-01]' as text from documents where source = 'src3' and doc_id = (select min(doc_id) from documents where source = 'src3')")
def copy_pattern(spark, d):
    p = read(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.col("source").alias("pack"), "text")
    first = p.filter("pack = 'src3'").agg(F.min("idx")).first()[0]
    return A.copied(p, first, "src3", "dst", "2024-01-01").select(F.lit(first).alias("idx"), "pack", "text")


@query("select source as pack, md5(string_agg('## #' || doc_id || chr(10) || chr(10) || text || chr(10), chr(10) order by doc_id)) as digest from documents group by source")
def export_markdown(spark, d):
    p = read(spark, d, "documents").select(F.col("source").alias("pack"), F.col("doc_id").alias("idx"), "text")
    return A.export_markdown(p).select("pack", F.md5("document").alias("digest"))


@query("select doc_id as idx, case when doc_id % 5 = 0 then 'new' else text end as text, case when doc_id % 5 = 0 then left(text, 8000) end as previous_text from documents")
def audited_update(spark, d):
    p = read(spark, d, "documents").select(F.lit("p").alias("pack"), F.col("doc_id").alias("idx"), "text")
    return A.audited_update(p, p.filter("idx % 5 = 0").withColumn("text", F.lit("new"))).select("idx", "text", "previous_text")


@query("select c_custkey as idx from customer where c_custkey % 2 = 0 union all select c_custkey from customer where c_custkey % 2 = 1")
def upsert(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("idx"))
    return A.upsert(c, c.filter("idx % 2 = 0"), ["idx"])
