"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"


def _draw(key: str, salt: str) -> str:
    return f"('0x' || substr(md5({key} || ':{salt}'), 1, 13))::bigint"


_KEY = "coalesce(doc_id::varchar, 'null-' || md5(coalesce(text, '')))"

#: Water filling by hand: targets are at the level at which the budget is used up.
_MIXING = f"""
with sized as (
    select doc_id, source, len({_WORDS.format(t="coalesce(text, '')")})::bigint as size, {_draw(_KEY, 'mix')} as h from documents
), src as (
    select source, sum(size)::bigint as s, row_number() over (order by source nulls last) as rank from sized group by source
), weighed as (
    select *, [5, 2, 1][(rank - 1) % 3 + 1] as w, sum(s) over () as total from src
), filled as (
    select *, coalesce(sum(2 * s) over (order by s / w, rank rows between unbounded preceding and 1 preceding), 0) as before,
        sum(w) over (order by s / w, rank rows between current row and unbounded following) as w_left from weighed
), capped as (
    select *, 4 * s * w_left <= w * (3 * total - 2 * before) as capped from filled
), level as (
    select max(w_left) as w_left, arg_max(3 * total - 2 * before, w_left) as rest from capped where not capped
), shares as (
    select source, rank, s as source_size, case when capped then (2 * s)::double else (w * rest)::double / (2 * level.w_left)::double end as target from capped, level
), queue as (
    select doc_id, size, rank, source_size, target, h, sum(size) over (partition by rank order by h, doc_id) as cum from sized join shares on sized.source is not distinct from shares.source
), copies as (
    select *, copy, (cum + copy * source_size)::double / target as finish from queue, range(2) t(copy) where target > 0
), summed as (
    select *, sum(size) over (order by finish, rank, copy, h, doc_id rows unbounded preceding) as sofar from copies
), cut as (
    select min(struct_pack(f := finish, r := rank, c := copy, h := h)) as x from summed where sofar > (select round(sum(target)) from shares)
), taken as (
    select doc_id, count(*) as n from copies, cut where x is null or struct_pack(f := finish, r := rank, c := copy, h := h) < x group by doc_id
)
select doc_id, size, source_size, target, (size * coalesce(n, 0))::bigint as taken from queue left join taken using (doc_id)
"""

_NEAR = f"""
with recursive words as (
    select doc_id, {_WORDS.format(t=_LOWER)} as w from documents
), shingles as (
    select distinct doc_id, case when len(w) < 2 then w else [w[i], w[i + 1]] end as s from (select doc_id, w, unnest(range(1, greatest(len(w), 2))) as i from words where len(w) > 0)
), sizes as (
    select doc_id, count(*) as n from shingles group by doc_id
), met as (
    select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
), links as (
    select a, b from met join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)
), edges as (
    select a, b from links union all select b, a from links
), reach as (
    select doc_id as id, doc_id as root from documents union select edges.b, reach.root from reach join edges on edges.a = reach.id
), heads as (
    select id, min(root) as component_id from reach group by id
)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from heads left join sizes on sizes.doc_id = id join documents using (doc_id)
""".replace("from heads left join sizes on sizes.doc_id = id join documents using (doc_id)", "from (select id as doc_id, component_id from heads) left join sizes using (doc_id)")

_TOPK = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint as score from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0
), ranked as (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 10
"""

_SUBSTRINGS = """
with bytes as (
    select doc_id, hex(encode(coalesce(text, ''))) as x, (octet_length(encode(coalesce(text, ''))))::bigint as n from documents
), windows as (
    select doc_id, i, md5(substr(x, 2 * i + 1, 100)) as w from (select doc_id, x, unnest(range(0, n - 49)) as i from bytes where n >= 50)
), firsts as (
    select w, min(doc_id) as first from windows group by w
), hits as (
    select doc_id, i from windows join firsts using (w) where doc_id > first
), gone as (
    select distinct doc_id, i + k as b from hits, range(50) t(k)
), counted as (
    select doc_id, count(*) as n_removed, count(*) filter (where before is null or before < b - 1) as n_spans from (select doc_id, b, lag(b) over (partition by doc_id order by b) as before from gone) group by doc_id
), kept as (
    select doc_id, string_agg(substr(x, 2 * b + 1, 2), '' order by b) as x from (select doc_id, x, unnest(range(0, n)) as b from bytes semi join counted using (doc_id)) left join gone g using (doc_id, b) where g.b is null group by doc_id
)
select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(case when n_removed is null then bytes.x else coalesce(kept.x, '') end)) as kept_sha256 from bytes left join counted using (doc_id) left join kept using (doc_id)
""".replace("left join gone g using (doc_id, b) where g.b is null", "anti join gone using (doc_id, b)")

_CRC = "list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, n + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::bigint)), lambda c, b: xor(c >> 8, table_[(xor(c, b) & 255) + 1]))"


def _straw(name: str, weight: float) -> str:
    return f"-ln((({_draw(_KEY, name)}) + 1) / 4503599627370496.0) / {weight}"


def _pick(names: list[str], weights: list[float]) -> str:
    """The position of the shortest straw."""
    straws = ", ".join(_straw(n, w) for n, w in zip(names, weights, strict=True))
    return f"list_position([{straws}], list_min([{straws}]))"


def _shards(regions: int) -> str:
    inner = {r: {k: _pick([f"shard{4 * r + 2 * k}", f"shard{4 * r + 2 * k + 1}"], [1, 1]) for k in range(2)} for r in range(2)}
    rack = {r: _pick([f"rack{2 * r}", f"rack{2 * r + 1}"], [2, 2]) for r in range(2)}
    region = _pick(["region0", "region1", "region2"][:regions], [4, 4, 1][:regions])
    one = lambda r: f"case when {rack[r]} = 1 then {4 * r} + {inner[r][0]} - 1 else {4 * r + 2} + {inner[r][1]} - 1 end"
    return f"case {region} when 1 then {one(0)} when 2 then {one(1)} else 8 end"


#: The table of the CRC (reflected polynomial 0xEDB88320) is made by its rule.
_SHARDING = f"""
with tables as (
    select list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) order by i) as table_ from range(256) t(i)
), bytes as (
    select doc_id, text, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, ''))) as n, {_shards(2)} as shard, {_shards(3)} as grown, {_draw(_KEY, 'slot')} as h from documents
)
select doc_id, (n + 1)::bigint as size, case when n = 0 then 0 else xor({_CRC}, 4294967295::bigint) end as text_crc32, 'key' as law, shard::int as shard, row_number() over (partition by shard order by h, doc_id) - 1 as slot, grown::int as grown_shard from bytes, tables
"""

_COPIES = f"""
with rows as (select doc_id, {_LOWER} as norm from documents), groups as (select norm, max(doc_id) as keep_id, count(*) as group_size from rows group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from rows join groups using (norm)
"""

_LETTERS = r"regexp_extract_all({t}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(t=_LOWER)

_IMPORTANCE = f"""
with tables as (
    select list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) order by i) as table_ from range(256) t(i)
), words as (
    select doc_id, unnest({_LETTERS}) as w from documents
), wanted as (
    select unnest({_LETTERS}) as w from benchmark
), hashed as (
    select w, xor({_CRC}, 4294967295::bigint) % 10000 as bucket from (select w, hex(encode(w)) as x, octet_length(encode(w)) as n from (select w from words union select w from wanted)), tables
), d as (
    select bucket, count(*) as s from words join hashed using (w) group by bucket
), b as (
    select bucket, count(*) as t from wanted join hashed using (w) group by bucket
), counts as (
    select bucket, coalesce(s, 0) as s, coalesce(t, 0) as t, coalesce(sum(s) over (), 0) as all_s, coalesce(sum(t) over (), 0) as all_t from d full join b using (bucket)
), gains as (
    select bucket, floor(1000 * ln(((t + 1) * (all_s + 10000))::double / ((s + 1) * (all_t + 10000))::double))::bigint as gain from counts
), sums as (
    select doc_id, count(*) as n, sum(gain)::bigint as gain from words join hashed using (w) join gains using (bucket) group by doc_id
), scored as (
    select doc_id, coalesce(n, 0) as n_features, coalesce((gain - ((gain % n) + n) % n) // n, 0)::bigint as weight, ('0x' || substr(sha256('2024:' || doc_id::varchar), 1, 8))::bigint as h from documents left join sums using (doc_id)
), drawn as (
    select *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint as score, n_features >= 20 as long from scored
), ranked as (
    select *, row_number() over (partition by long order by score desc, doc_id) as r, count(*) filter (where long) over () as n from drawn
)
select doc_id, n_features, weight, score, case when long and r <= 10 * n // 100 then r end as rank from ranked
"""

_TERMS = r"regexp_extract_all({t}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(t=_LOWER)

_LEXICAL = f"""
with postings as (
    select doc_id, w, count(*) as tf from (select doc_id, unnest({_TERMS}) as w from documents) group by doc_id, w
), lengths as (
    select doc_id, sum(tf)::bigint as n from postings group by doc_id
), totals as (
    select count(*) as all_n, sum(n)::bigint as all_l from lengths
), weights as (
    select w, floor(1000 * ln((2 * all_n + 2)::double / (2 * df + 1)::double))::bigint as weight from (select w, count(*) as df from postings group by w), totals
), asked as (
    select item_id, w, count(*) as r from (select item_id, unnest({_TERMS}) as w from benchmark) group by item_id, w
), scored as (
    select item_id, doc_id, sum(r * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * all_n) // all_l))))::bigint as score
    from asked join weights using (w) join postings using (w) join lengths using (doc_id), totals group by item_id, doc_id
), ranked as (
    select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0
)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""

#: The same join as near duplicates, over sets of four words.
_JACCARD = (
    _NEAR.replace("when len(w) < 2 then w else [w[i], w[i + 1]]", "when len(w) < 4 then w else w[i:i + 3]").replace("greatest(len(w), 2)", "greatest(len(w) - 2, 2)")
    .replace("100 * k >= 80", "100 * k >= 85").replace(", component_id, doc_id = component_id as kept", ", component_id")
)

SQL: dict[str, str] = {
    "op2_mixing": _MIXING,
    "op3_near_dedup": _NEAR,
    "op4_topk": _TOPK,
    "op5_substring_dedup": _SUBSTRINGS,
    "op8_sharding": _SHARDING,
    "op10_exact_dedup": _COPIES,
    "op11_importance": _IMPORTANCE,
    "op12_lexical": _LEXICAL,
    "op13_ngram_join": _JACCARD,
}
