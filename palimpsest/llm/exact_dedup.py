"""Exact deduplication by content sort.

Texts are normalised (A-Z lower-cased, nothing else; null counts as empty). Each Arrow batch
first merges its own equal texts, so that a group of copies of any size sends one row a batch
to the shuffle. Splitters that Spark samples from the leading bytes and the digest (never
from whole texts, so the sample stays small) range-partition the normalised bytes; an
external sort places equals side by side, and the sorted runs are told apart by comparing
whole neighbouring texts. The row with the largest id stays (ids that are null come last).

Groups are told apart by whole texts, in a batch as in a range; a row then finds its group's
outcome by the SHA-256 of its text, which is trusted to name one text. Very long texts are
compared and hashed whole.

Empty tables give no rows. Rows that repeat both id and text count as one document: each is
reported as kept by `classes`, and one of them stays in `dedup`. Columns of any name pass
through `dedup`, held in a struct meanwhile.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .common import checkpointed, look_up, map_arrow

#: Leading bytes that range-partition the texts, before their digest.
PREFIX = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(batch: pa.RecordBatch) -> tuple[pa.Array, list[str]]:
    """The normalised texts as bytes, and their SHA-256 in hex."""
    text = batch.column("text")
    norm = pc.ascii_lower(pc.fill_null(text.cast(pa.string()), "")).cast(pa.binary())
    return norm, [hashlib.sha256(x.as_buffer()).hexdigest() for x in norm]


def _merged(batch: pa.RecordBatch, norm: pa.Array) -> tuple[list[int], list[int]]:
    """For each distinct text of the batch the row with its largest id, and its rows."""
    best: dict[int, int] = {}
    ids = batch.column("doc_id").to_pylist()
    codes = norm.dictionary_encode().indices.to_pylist()  # by the texts themselves
    count = [0] * len(codes)
    for i, c in enumerate(codes):
        j = best.get(c)
        count[c] += 1
        if j is None or ids[i] is not None and (ids[j] is None or ids[i] > ids[j]):
            best[c] = i
    return list(best.values()), [count[c] for c in best]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        norm, digests = normalised(b)
        rows, n = _merged(b, norm)
        at = pa.array(rows, pa.int64())
        norm = norm.take(at)
        yield pa.RecordBatch.from_arrays([pc.binary_slice(norm, 0, PREFIX), pa.array([digests[i] for i in rows]), norm, b.column("doc_id").take(at), pa.array(n, pa.int64())], names=["prefix", "digest", "norm", "keep_id", "n"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(normalised(b)[1], pa.string())], names=["doc_id", "digest"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        norm, digests = normalised(b)
        at = pa.array(_merged(b, norm)[0], pa.int64())
        prefix = pc.binary_slice(norm.take(at), 0, PREFIX)
        yield pa.RecordBatch.from_arrays([prefix, pa.array(digests, pa.string()).take(at), *(b.column(c).take(at) for c in ("doc_id", "text", "row"))], names=["prefix", "digest", "doc_id", "text", "row"])


def groups(docs: DataFrame) -> DataFrame:
    """digest, keep_id, group_size of every text that more than one row has."""
    keys = map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _keys, "prefix binary, digest string, norm binary, keep_id long, n long")
    placed = keys.repartitionByRange("prefix", "digest")
    run = Window.partitionBy("prefix", "digest", "norm")
    first = F.row_number().over(run.orderBy(F.col("keep_id").desc_nulls_last()))
    size = F.sum("n").over(run.orderBy(F.col("keep_id").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    runs = placed.select("prefix", "digest", "norm", "keep_id", first.alias("_first"), size.alias("group_size"))
    return runs.filter("_first = 1 and group_size > 1").select("digest", "keep_id", "group_size")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    found = checkpointed(groups(docs))
    rows = map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _digests, "doc_id long, digest string")
    out = look_up(rows, "digest", F.coalesce(F.col("doc_id"), F.lit(0)).cast("string"), found, "group_size")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("digest").alias("text_sha256"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs without its copies, every column as it was."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    schema = StructType([StructField("prefix", BinaryType()), StructField("digest", StringType()), *held.schema.fields])
    out = map_arrow(held, _rows, schema).repartitionByRange("prefix", "digest")
    norm = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    run = Window.partitionBy("prefix", "digest", "norm").orderBy(F.col("doc_id").desc_nulls_last())
    out = out.withColumn("norm", norm).withColumn("_first", F.row_number().over(run)).filter("_first = 1")
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
