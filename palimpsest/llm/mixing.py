"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every source is a queue of its documents in a reproducible shuffled order, as many rounds of
it as a document may be repeated. A copy's virtual finish time is the source's tokens up to
and with that copy, divided by the source's target. All copies are range-sorted by finish time
and cut at the total budget: sums of the ranges and their running sum name the range in which
the budget ends, and only that one is summed copy by copy. So every source gets its share to
within the documents that straddle the cut.

Nulls: a null text has size 0; a null source is a source of its own, ordered last; rows with
a null id are shuffled by their text. Rows that repeat an id are taken or left together; ties
in finish time go by the source's rank, the copy, the place in the shuffle and the id. Texts of
any length are one document each, empty ones of size 0. An empty table gives an empty mix.
Other columns, whatever their names, pass through `mix`. Sources, a row each, are ranked and
filled up in one task: they may be millions, not billions.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS, buckets_for, checkpointed, draw, key_of, look_up, running

#: Sources whose cuts are broadcast; of more sources the rows that are not in the largest are shuffled.
BROADCAST = 10_000


@dataclass(frozen=True)
class Weights:
    """weights repeat over the sources in code-point order; share is of all sizes."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: Fraction = Fraction(3, 2)
    repeats: int = 2


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and h, the place in the shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"), draw(key_of(F.col("doc_id"), F.col("text")), "mix").alias("h"))


def targets(sized: DataFrame, w: Weights) -> DataFrame:
    """One row a source: source, rank, source_size, largest, target.

    Water filling: sources in order of size per weight are capped at `repeats` times their
    size while their share of what is left exceeds that; the rest share by weight.
    """
    total = Window.partitionBy()
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy(F.col("source_size") / F.col("w"), "rank")
    num, den, r = w.share.numerator, w.share.denominator, w.repeats
    weight = F.element_at(F.array(*map(F.lit, w.weights)), (F.pmod(F.col("rank") - 1, F.lit(len(w.weights))) + 1).cast("int"))
    s = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("size").alias("largest"))
        .withColumn("rank", F.row_number().over(ranked)).withColumn("w", weight.cast("long"))
        .withColumn("all", F.sum("source_size").over(total))
        .withColumn("capped_before", F.coalesce(F.sum(r * F.col("source_size")).over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("left", num * F.col("all") - den * F.col("capped_before"))
        .withColumn("capped", r * den * F.col("source_size") * F.col("w_left") <= F.col("w") * F.col("left"))
        .withColumn("level", F.max(F.when(~F.col("capped"), F.struct("w_left", "left"))).over(total))
    )
    shared = (F.col("w") * F.col("level.left")).cast("double") / (den * F.col("level.w_left")).cast("double")
    return s.select("source", "rank", "source_size", "largest", F.when(F.col("capped"), (r * F.col("source_size")).cast("double")).otherwise(shared).alias("target"))


@dataclass(frozen=True)
class Mix:
    """sized: sizes(); shares: targets(); cuts: for each source and copy the last place of the shuffle that is taken."""

    sized: DataFrame
    shares: DataFrame
    cuts: DataFrame


def plan(docs: DataFrame, w: Weights = Weights()) -> Mix:
    sized = checkpointed(sizes(docs))
    shares = checkpointed(targets(sized, w))
    rows = sized.count()
    known = sized.join(shares.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    summed = running(known, "rank", "h", ["doc_id"], F.col("size"), buckets_for(rows), "cum")
    copies = F.explode(F.sequence(F.lit(0), F.lit(w.repeats - 1)))
    queue = checkpointed(summed.select("rank", "doc_id", "h", "size", "cum", "source_size", "target"))
    queue = (
        queue.filter("target > 0").withColumn("copy", copies)
        .withColumn("finish", (F.col("cum") + F.col("copy") * F.col("source_size")).cast("double") / F.col("target"))
    )
    budget = round(shares.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("x")).first().x)
    order = ["finish", "rank", "copy", "h", "doc_id"]
    dealt = queue.select(*order, "size").repartitionByRange(buckets_for(2 * rows, 1 << 17, 8), *order)
    dealt = checkpointed(dealt.withColumn("range", F.spark_partition_id()))
    sums = dealt.groupBy("range").agg(F.sum("size").alias("sum"), F.min(F.struct(*order)).alias("first"))
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0)))  # a row a range
    where = sums.filter(F.col("before") + F.col("sum") > budget).orderBy("first").first()
    end = None
    if where is not None:
        upto = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        over = dealt.filter(F.col("range") == where["range"]).withColumn("sum", F.sum("size").over(upto) + F.lit(where["before"]))
        end = over.filter(F.col("sum") > budget).agg(F.min(F.struct(*order[:4])).alias("x")).first().x
    taken = dealt if end is None else dealt.filter(F.struct(*order[:4]) < F.struct(F.lit(end.finish), F.lit(end["rank"]), F.lit(end["copy"]), F.lit(end.h).cast("long")))
    cuts = taken.groupBy("rank", "copy").agg(F.max("h").alias("last"))
    cuts = cuts.groupBy("rank").agg(F.collect_list("last").alias("cuts"))  # one number a copy: `repeats` at most
    return Mix(sized, shares, checkpointed(shares.join(cuts, "rank", "left")))


def copies_taken(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds to rows (source, h) the number of copies that the mix takes.

    cuts has a row a source and is broadcast up to BROADCAST rows; beyond, only the largest
    sources are, and the rows of others are spread over the shuffle.
    """
    n = F.size(F.filter(F.coalesce(F.col("cuts"), F.array().cast("array<bigint>")), lambda c: F.col("h") <= c))
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    if cuts.count() <= BROADCAST:
        by = F.broadcast(cuts.withColumnRenamed("source", "_s"))
        return rows.join(by, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("copies", n).drop("_s", "cuts", "rank", "largest")
    found = cuts.select(name.alias("_name"), F.col("source_size").alias("_size"), *(c for c in cuts.columns if c != "source"))
    out = look_up(rows.withColumn("_name", name), "_name", F.col("h").cast("string"), found, "_size")
    return out.withColumn("copies", n).drop("_name", "_size", "cuts", "rank", "largest")


def mix(docs: DataFrame, w: Weights = Weights()) -> DataFrame:
    """docs as the mix takes them, a row for each copy, with docs's own columns."""
    p = plan(docs, w)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "source", draw(key_of(F.col("doc_id"), F.col("text")), "mix").alias("h"))
    out = copies_taken(held, p.cuts).filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("_row.*")
