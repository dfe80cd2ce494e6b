"""Two-hop association: what the neighbours of a query's neighbours agree on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V


def perturbed(rows: DataFrame, temperature: float, seed: int) -> DataFrame:
    """Vectors with normal noise of 0.1 x temperature on each component, normalised again."""
    if not temperature:
        return rows
    noisy = F.transform(F.arrays_zip("embedding", F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda i: F.xxhash64("idx", i, F.lit(seed)))), lambda z: z["embedding"].cast("double") + 0.1 * temperature * F.sqrt(-2 * F.log((F.pmod(z["1"], F.lit(1 << 30)) + 1) / float(1 << 30))) * F.cos(2 * 3.141592653589793 * F.pmod(F.shiftright(z["1"], 31), F.lit(1 << 30)) / float(1 << 30)))
    rows = rows.withColumn("_v", noisy)
    return rows.withColumn("embedding", F.transform("_v", lambda x: (x / (V.norm(F.col("_v")) + V.EPSILON)).cast("float"))).drop("_v")


def walk(patterns: DataFrame, query: Sequence[float], k: int = 10, walk_k: int = 0, least_hits: int = 2, show: int = 10, temperature: float = 0.0, seed: int = 0) -> DataFrame:
    """idx, hits, mean_score of rows that at least least_hits of the k nearest have among their walk_k nearest, and the query has not.

    The k nearest (by cosine alone) are k rows, so they are joined by broadcast; each keeps a
    bounded heap of walk_k rows a task.
    """
    walk_k = walk_k or max(3 * k, 20)
    v = patterns.select("idx", "embedding")
    first = v.withColumn("score", V.cosine(F.col("embedding"), V.literal(query))).orderBy(F.col("score").desc(), "idx").limit(k)
    hubs = perturbed(first.select("idx", "embedding"), temperature, seed)
    hubs = hubs.select(F.col("idx").alias("hub"), F.col("embedding").alias("hub_vector"))
    pairs = v.join(F.broadcast(hubs), F.col("idx") != F.col("hub"))  # k rows against all, the stated query set
    pairs = pairs.select("hub", "idx", V.cosine(F.col("embedding"), F.col("hub_vector")).alias("score"))
    order = Window.partitionBy("hub").orderBy(F.col("score").desc(), "idx")
    near = pairs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= walk_k)
    met = near.groupBy("idx").agg(F.count("*").alias("hits"), F.avg("score").alias("mean_score")).filter(F.col("hits") >= least_hits)
    return met.join(F.broadcast(first.select("idx")), "idx", "left_anti").orderBy(F.col("hits").desc(), F.col("mean_score").desc(), "idx").limit(show)


def parse_listing(lines: DataFrame) -> DataFrame:
    """idx, hits, score of the lines of a rendered walk: '#12 (3 hits, avg 0.712) text'."""
    n = lambda pattern, kind: F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")).cast(kind)
    return lines.select(n(r"#(\d+)", "long").alias("idx"), n(r"(\d+)\s*hits?", "int").alias("hits"), n(r"(?:avg|score)[ =:]*([0-9.]+)", "double").alias("score"), F.trim(F.regexp_extract("line", r"\)\s*(.*)$", 1)).alias("text")).filter("idx is not null")


def listing(found: DataFrame) -> DataFrame:
    return found.select(F.format_string("#%d (%d hits, avg %.3f) %s", "idx", "hits", "mean_score", T.preview(F.col("text"), 120, "")).alias("line"))
