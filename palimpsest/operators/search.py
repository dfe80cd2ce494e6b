"""Top-k retrieval over one or many collections.

patterns: collection, idx, text, embedding and, where a step needs them, sign_words, dim,
flags, ts_unix, tags, mount_seq. The query is one vector, so scoring is a projection and
top-k a bounded heap a task; no step shuffles the patterns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from .filters import late_fetch

#: Scores below FLOOR before, below SHOWN after the boosts are no results (fixed values).
FLOOR, SHOWN = 0.05, 0.1
#: Candidates that each collection of a multi-collection search gives at most (fixed value).
CANDIDATES = 40


def scored(patterns: DataFrame, query: Sequence[float], mode: str = "blend") -> DataFrame:
    """Adds cos, sign and score; mode names the signals there are: blend, cosine or sign."""
    q = V.literal(query)
    cos = V.cosine(F.col("embedding"), q) if mode != "sign" else F.lit(None).cast("double")
    own = F.col("sign_words") if "sign_words" in patterns.columns else V.sign_words(F.col("embedding"))
    sign = V.sign_similarity(own, V.sign_words(q), len(query)) if mode != "cosine" else F.lit(None).cast("double")
    return patterns.withColumns({"cos": cos, "sign": sign}).withColumn("score", V.blend(F.col("cos"), F.col("sign")))


def candidates(k: int) -> int:
    """Rows that reranking sees for k results."""
    return max(4 * k, 20)


def live() -> Column:
    return F.coalesce(F.col("flags"), F.lit(0)).bitwiseAND(F.lit(1)) == 0


def recency(score: Column, ts_unix: Column, as_of: int, half_life: float = 86400.0) -> Column:
    age = F.greatest(F.lit(0.0), F.lit(as_of) - ts_unix)
    return F.when(ts_unix > 0, score * (0.5 + 0.5 * F.exp(-F.log(F.lit(2.0)) * age / half_life))).otherwise(score)


def search(
    patterns: DataFrame, query: Sequence[float], query_text: str = "", k: int = 5, *, where: Column | None = None,
    honor_tombstones: bool = False, recency_as_of: int | None = None, dedup: bool = False, mode: str = "blend",
    late: DataFrame | None = None, heap: DataFrame | None = None,
) -> DataFrame:
    """The k best patterns: rank, idx, score and what the patterns carry.

    Order of steps, which results depend on: filter, score, candidate cut, floor, tombstones,
    keyword boost, recency, dedup of one exchange's siblings, k best, display minimum. late
    (idx, passage) is joined to the k rows only; heap (idx, text), for patterns without texts, to
    the candidates.
    """
    if len(query_text) > T.MAX_QUERY:
        raise ValueError("the query is too long")
    rows = patterns if where is None else patterns.filter(where)
    cut = scored(rows, query, mode).orderBy(F.col("score").desc(), "idx").limit(candidates(k)).filter(F.col("score") >= FLOOR)
    if honor_tombstones:
        cut = cut.filter(live())
    if heap is not None:
        cut = late_fetch(cut, heap)
    score = F.col("score") + T.keyword_boost(F.col("text"), T.keywords(query_text))
    if recency_as_of is not None:
        score = recency(score, F.col("ts_unix"), recency_as_of)
    cut = cut.withColumn("score", score)
    if dedup:
        own = Window.partitionBy(F.coalesce(T.exchange_key(F.col("text")), F.concat(F.lit("#"), F.col("idx")))).orderBy(F.col("score").desc(), "idx")
        cut = cut.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")
    top = cut.orderBy(F.col("score").desc(), "idx").limit(k).filter(F.col("score") >= SHOWN)
    if late is not None:
        top = top.join(late, "idx", "left")  # k rows on one side
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "idx")))


def rendered(top: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Results as a reader gets them: idx, score, tags, text (shortened), full_text, and with links
    (pattern_id, prev, next; pattern ids begin at 1) the rows before and after.

    top: the k rows of a search with their text; links are joined to these rows only.
    """
    tag, body = T.split_prefix(F.col("text"))
    out = top.select("idx", F.round("score", 4).alias("score"), F.coalesce(tag, F.lit("")).alias("tags"), T.soft_truncate(body).alias("text"), body.alias("full_text"))
    if links is None:
        return out
    near = links.select((F.col("pattern_id") - 1).alias("idx"), (F.col("prev") - 1).alias("prev_idx"), (F.col("next") - 1).alias("next_idx"))
    return out.join(near.join(F.broadcast(out.select("idx")), "idx", "left_semi"), "idx", "left")


def direct(patterns: DataFrame, query: Sequence[float], share: float, k: int) -> DataFrame:
    """The k best by share of cosine against sign similarity, without reranking."""
    s = scored(patterns, query)
    return s.withColumn("score", share * F.col("cos") + (1 - share) * F.col("sign")).orderBy(F.col("score").desc(), "idx").limit(k)


def blend_sweep(patterns: DataFrame, query: Sequence[float], k: int, steps: int = 21) -> DataFrame:
    """The k best at each of `steps` shares of cosine from 0 to 1: one scan, a heap a share."""
    shares = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: i / (steps - 1))).alias("share")
    s = scored(patterns, query).select("idx", "cos", "sign", shares)
    s = s.withColumn("score", F.col("share") * F.col("cos") + (1 - F.col("share")) * F.col("sign"))
    order = Window.partitionBy("share").orderBy(F.col("score").desc(), "idx")
    return s.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def in_scope(patterns: DataFrame, scope: str | Sequence[str] = "all", roles: Sequence[str] | None = None) -> DataFrame:
    """Patterns of the collections named, of the first mounted ("local"), or of all, by role."""
    rows = patterns
    if roles:
        rows = rows.filter(F.col("role").isin(list(roles)))
    if scope == "local":
        first = rows.agg(F.min("mount_seq")).first()[0]
        return rows.filter(F.col("mount_seq") == first)
    if scope == "all":
        return rows
    return rows.filter(F.col("collection").isin([scope] if isinstance(scope, str) else list(scope)))


def multi_search(
    patterns: DataFrame, query: Sequence[float], query_text: str = "", k: int = 10, *, scope: str | Sequence[str] = "all",
    roles: Sequence[str] | None = None, mode: str = "global", pool: int = CANDIDATES, heap: DataFrame | None = None,
) -> DataFrame:
    """Several collections at once. mode: global, per_collection, balanced or diagnostic.

    Every collection gives its `pool` best before boosts (so no more of one can be a result).
    balanced takes each collection's k best and of these the k best, which equals global. heap
    (idx, text), for patterns without texts, is joined to the pools.
    """
    if mode not in ("global", "per_collection", "balanced", "diagnostic"):
        raise ValueError(f"no such mode: {mode}")
    s = scored(in_scope(patterns, scope, roles), query)
    best = Window.partitionBy("collection").orderBy(F.col("score").desc(), "idx")
    s = s.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= pool).filter(F.col("score") >= FLOOR)
    if heap is not None:
        s = late_fetch(s, heap)
    s = s.withColumn("score", F.col("score") + T.keyword_boost(F.col("text"), T.keywords(query_text)))
    s = s.withColumn("_n", F.row_number().over(best)).withColumn("text", T.preview(F.col("text"), 500))
    if mode == "global":
        return s.orderBy(F.col("score").desc(), "mount_seq", "idx").limit(k).withColumnRenamed("_n", "rank_in_collection")
    s = s.filter(F.col("_n") <= k).withColumnRenamed("_n", "rank_in_collection")
    return s.orderBy(F.col("score").desc(), "mount_seq", "idx").limit(k) if mode == "balanced" else s


def find_similar(snapshots: DataFrame, frame: Sequence[int], least: float = 0.8) -> DataFrame:
    """Snapshots whose cells equal the frame's in at least this share, best first."""
    own = F.array(*(F.lit(int(x)) for x in frame))
    return snapshots.withColumn("similarity", V.pixel_similarity(F.col("cells"), own)).filter(F.col("similarity") >= least).orderBy(F.col("similarity").desc(), "idx")
