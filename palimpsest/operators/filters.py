"""Structured filters, browsing and point look-ups."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: What a filter may name (fixed values).
KNOWN = frozenset({"tags_all", "tags_any", "meta", "quality", "limit"})
QUALITY = ("support_count_min", "beat_dummy_pp_min", "uplift_over_weights_only_min")
DEFAULT_LIMIT, MOST = 500, 10_000


def predicate(spec: Mapping[str, Any]) -> tuple[Column, list[str]]:
    """(condition over text, meta; names it does not know). tags come of text and of meta.

    meta: all fields equal, null-safe, numbers as numbers. quality: minimums; an absent field
    passes.
    """
    own = F.concat(T.tags(F.col("text")), T.meta_tags(F.col("meta")))
    keep = F.lit(True)
    if spec.get("tags_all"):
        keep = keep & T.tags_all(own, list(spec["tags_all"]))
    if spec.get("tags_any"):
        keep = keep & T.tags_any(own, list(spec["tags_any"]))
    for name, wanted in (spec.get("meta") or {}).items():
        value = F.try_element_at("meta", F.lit(name))
        if isinstance(wanted, bool | int | float):
            number = F.when(value == "true", F.lit("1")).when(value == "false", F.lit("0")).otherwise(value)
            keep = keep & F.coalesce(number.try_cast("double") == float(wanted), F.lit(False))
        else:
            keep = keep & value.eqNullSafe(F.lit(wanted))
    for name in QUALITY:
        if (least := (spec.get("quality") or {}).get(name)) is not None:
            value = F.try_element_at("meta", F.lit(name.removesuffix("_min"))).try_cast("double")
            keep = keep & (value.isNull() | (value >= float(least)))
    return keep, sorted(set(spec) - KNOWN)


def at_least(column: str, least: float) -> Column:
    """A minimum that an absent value passes."""
    return F.col(column).isNull() | (F.col(column) >= least)


def enumerate_filter(patterns: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    """idx and shortened text of the first `limit` patterns that pass, in order of idx."""
    keep, _ = predicate(spec)
    n = min(int(spec.get("limit") or DEFAULT_LIMIT), MOST)
    return patterns.filter(keep).select("idx", T.preview(F.col("text"), 1200).alias("text")).orderBy("idx").limit(n)


def browse(patterns: DataFrame, tag: str = "", q: str = "", offset: int = 0, limit: int = 50) -> DataFrame:
    """Newest first, without the header rows 0 and 1; tag equal and q contained, whatever the case."""
    return browsed(patterns, tag, q).orderBy(F.col("idx").desc()).offset(offset).limit(min(limit, 200))


def browsed(patterns: DataFrame, tag: str = "", q: str = "") -> DataFrame:
    """All rows that browse pages through; their count is the total before paging."""
    rows = patterns.filter("idx > 1")
    if tag:
        rows = rows.filter(F.exists(T.tags(F.col("text")), lambda t: F.upper(t) == tag.upper()))
    if q:
        rows = rows.filter(F.lower("text").contains(q.lower()))
    return rows


def passage(patterns: DataFrame, collection: str, idx: int) -> DataFrame:
    """One pattern; no row where there is none. Partitions are pruned by collection."""
    return patterns.filter((F.col("collection") == collection) & (F.col("idx") == idx))


def late_fetch(top: DataFrame, heap: DataFrame) -> DataFrame:
    """top with the wide columns of a heap (idx, ...). Only the heap's rows of top are shuffled, if any."""
    ids = top.select("idx")
    return top.join(heap.join(ids, "idx", "left_semi"), "idx")


def filter_report(patterns: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    """One row: total_scanned, matched, shown (up to the limit), and the names in the spec that are not known."""
    keep, unknown = predicate(spec)
    n = min(int(spec.get("limit") or DEFAULT_LIMIT), MOST)
    out = patterns.agg(F.count("*").alias("total_scanned"), F.count_if(F.coalesce(keep, F.lit(False))).alias("matched"))
    names = F.array(*map(F.lit, unknown)) if unknown else F.array().cast("array<string>")
    return out.withColumn("shown", F.least("matched", F.lit(n))).withColumn("unknown", names)


def resolve_name(catalog: DataFrame, name: str) -> DataFrame:
    """Collections of that name, else whose names hold it in any case; several are ambiguous."""
    kind = F.when(F.col("name") == name, 0).when(F.lower("name").contains(name.lower()), 1)
    found = catalog.withColumn("_kind", kind).filter("_kind is not null").withColumn("_best", F.min("_kind").over(Window.partitionBy()))
    found = found.filter("_kind = _best").withColumn("matches", F.count("*").over(Window.partitionBy()))
    return found.withColumn("ambiguous", F.col("matches") > 1).drop("_kind", "_best")


def activity(events: DataFrame, since: str | None = None, kinds: list[str] | None = None, limit: int = 50) -> DataFrame:
    """Newest events strictly after since, of the kinds; 1 to 500 rows."""
    rows = events
    if since is not None:
        rows = rows.filter(F.col("created_at") > F.lit(since).cast("timestamp"))
    if kinds:
        rows = rows.filter(F.col("event_type").isin(kinds))
    return rows.orderBy(F.col("created_at").desc(), F.col("event_id").desc()).limit(max(1, min(limit, 500)))


def owned(packs: DataFrame, user: str) -> DataFrame:
    return packs.filter(F.col("owner_id") == user)
