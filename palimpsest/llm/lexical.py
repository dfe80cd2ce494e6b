"""Ranked lexical search: postings as a term-bucketed DataFrame, integer scores, top-k by window.

Items (the queries) are taken in slabs of SLAB bytes of text at most; a slab's terms are what is
sent to every task. Documents are cut into terms once a slab, and their postings of the slab's
terms are written as a table: one row for each block of documents and bucket of terms, with
arrays of terms, places in the block, lengths and occurrences. Numbers of documents, lengths and
document frequencies come from all of it. Item terms, with their weights, are joined to the
exploded postings by bucket and term; a match's score is a whole number, and matches are summed
by item and document. Postings are dealt by block for that, so a term that every document has is
spread over all tasks, and sums need no shuffle of matches: only the k best of a task and item
travel to the window that ranks them.

Nulls: a null text has no terms, as a document or as an item; null ids pass, those of documents
after others of their score. Rows that repeat an id are documents or items of their own. Ties go
to the smaller doc_id. Texts are read whole, whatever their length. An empty table on either side
gives no rows. Columns other than ids and texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, drop_folder, map_arrow, scratch, slices, spread, stored
from .importance import words_of

#: Bytes of a slab's items, documents of a block, buckets of terms, sums of a task.
SLAB, BLOCK, BUCKETS, SUMS = 4 << 20, 512, 8, 1 << 20
POSTINGS = "block long, bucket int, ids array<long>, terms array<int>, places array<int>, lengths array<int>, counts array<int>"
FOUND = "item int, item_id long, doc_id long, score long, block long, place int"


def _postings(terms: dict[bytes, int]):
    """A row for each block and bucket of terms; bucket -1 has the lengths of all of the block's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for b in slices(batches, BLOCK):
            data, _, _, text = words_of([x.as_py() or b"" for x in b.column("text").cast(pa.binary())])
            lengths = np.bincount(text, minlength=b.num_rows)
            term = np.fromiter(map(terms.get, data.split(), repeat(-1)), np.int64, len(text))
            hit = np.flatnonzero(term >= 0)
            key = (term[hit] % BUCKETS << 32 | term[hit]) * BLOCK + text[hit]
            key, count = np.unique(key, return_counts=True)
            term, place = key // BLOCK & 0xFFFFFFFF, key % BLOCK
            ids = b.column("doc_id").to_pylist()
            rows = [(at, -1, None, None, None, lengths.tolist(), None)]
            for k in range(BUCKETS):
                own = term % BUCKETS == k
                if own.any():
                    some = place[own]
                    rows.append((at, k, [ids[i] for i in some.tolist()], term[own], some, lengths[some], count[own]))
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 4)
            names = [x.split(" ")[0] for x in POSTINGS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            at += 1

    return run


def _matches(posted: DataFrame, terms: DataFrame, n: int, total: int, tasks: int) -> DataFrame:
    """block, place, doc_id, item, item_id and the score of every posting that an item asks for."""
    rows = posted.filter("bucket >= 0").repartition(tasks, "block")
    rows = rows.select("block", "bucket", F.explode(F.arrays_zip("ids", "terms", "places", "lengths", "counts")).alias("p"))
    m = F.expr(f"25L + (75L * p.lengths * {n}L) div {total}L")
    rows = rows.withColumn("m", m).withColumn("each", F.expr("(1000000000L * p.counts) div (1000L * p.counts + 8L * m)"))
    rows = rows.select("block", "bucket", F.col("p.terms").alias("term"), F.col("p.places").alias("place"), F.col("p.ids").alias("doc_id"), "each")
    return rows.join(F.broadcast(terms), ["bucket", "term"]).select("block", "place", "doc_id", "item", "item_id", (F.col("weight") * F.col("each")).alias("score"))


def _slab(docs: DataFrame, items: list[tuple[int | None, bytes]], k: int, folder: str) -> DataFrame:
    """The k best documents of each of the items, and those that tie with them by all but place."""
    spark = docs.sparkSession
    data, _, _, of = words_of([t for _, t in items])
    codes: dict[bytes, int] = {}
    asked: dict[tuple[int, int], int] = {}
    for i, w in zip(of.tolist(), data.split(), strict=True):
        pair = i, codes.setdefault(w, len(codes))
        asked[pair] = asked.get(pair, 0) + 1
    posted = stored(map_arrow(docs, _postings(codes), POSTINGS), f"{folder}/postings")
    blocks = posted.filter("bucket < 0").select(F.explode("lengths").alias("n")).filter("n > 0")
    n, total = blocks.agg(F.count("*"), F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0))).first()
    df = posted.filter("bucket >= 0").select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    rows = [(i, items[i][0], c % BUCKETS, c, r) for (i, c), r in asked.items()]
    terms = spark.createDataFrame(rows, "item int, item_id long, bucket int, term int, n long")
    w = F.floor(1000 * F.log(F.lit(2 * n + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    terms = checkpointed(terms.join(df, "term").select("item", "item_id", "bucket", "term", (F.col("n") * w).alias("weight")))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * len(items) // SUMS))
    sums = _matches(posted, terms, n, max(total, 1), tasks).groupBy("block", "place", "doc_id", "item", "item_id").agg(F.sum("score").alias("score")).filter("score > 0")
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "block", "place")
    return sums.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents that score highest for every item."""
    spark = docs.sparkSession
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text <> ''")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + 16), F.lit(0)).alias("x")).first().x
    slabs = max(1, -(-2 * size // SLAB) if size > SLAB else 1)
    at = scratch(spark, "lexical")
    for s in range(slabs):
        own = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slabs)) == s).select("item_id", F.col("text").cast("binary").alias("text"))
        _slab(docs, [(r.item_id, bytes(r.text)) for r in own.collect()], k, f"{at}/{s}").write.mode("append").parquet(f"{at}/found")
        drop_folder(spark, f"{at}/{s}")
    out = checkpointed(spark.read.schema("item_id long, rank int, doc_id long, score long").parquet(f"{at}/found"))
    drop_folder(spark, at)
    return out
