"""Importance resampling towards a target corpus by bucket-partitioned inverted postings.

Texts are cut into words, and every run of 1 to `ngrams` words is a feature that falls into one
of `buckets` buckets. A slice of documents gives its postings (bucket, document, count) as
arrays, one row for each of PARTS groups of buckets, and these are shuffled by group and salt. The
counts of both corpora, summed per task before the shuffle, are co-grouped by bucket; each
bucket's gain is computed there, and every group meets its buckets' gains in its own partition.
It emits what it contributes to each document, and contributions are reduced by document. Salts
grow with the number of slices, so a bucket that every document has is never in one task.

The draw is a Gumbel top-k: rows are range-sorted by score, the ranges counted, and the first
floor(percent * N / 100) of the N documents with `least` words get their rank.

Nulls: a null text has no words, so no features and weight 0; a row with a null id is drawn by
its text (`key_of`), after others of its score. Rows that repeat an id are documents of their
own; equal scores go by id, then weight and number of features. Texts are read whole, whatever
their length. An empty table gives no rows; an empty target corpus has all counts 0. Columns
other than doc_id and text (target: text) are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, drop_folder, key_of, map_arrow, scratch, slices, spread, stored

#: Documents of a slice, groups of buckets, slices of a salt.
SLICE, PARTS, SALT = 512, 16, 64
#: Lower-cases A-Z and blanks every other ASCII byte that is no digit; other bytes stay.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
POSTINGS = "slice long, part int, buckets binary, places binary, counts binary, ids array<long>, keys array<string>, features array<long>, words array<long>"


@dataclass(frozen=True)
class Target:
    """Features are runs of 1 to ngrams words; percent of the documents with least words are drawn."""

    ngrams: int = 1
    buckets: int = 10_000
    least: int = 20
    percent: int = 10
    seed: int = 2024


#: CRC-32 of each byte (reflected polynomial 0xEDB88320).
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> 1), _CRC >> 1).astype(np.uint32)
#: Longer features are hashed one by one.
_LONG = 48


def words_of(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words with one blank between two; where each begins and ends, and which text it is of."""
    joined = b" ".join(texts).translate(_WORDS)
    data = np.frombuffer(joined, np.uint8)
    letter = data != 32
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = np.searchsorted(np.cumsum([0, *(len(t) + 1 for t in texts)]), start, "right") - 1
    size = end - start
    begin = np.cumsum(size + 1) - size - 1
    keep = letter.copy()
    keep[start[1:] - 1] = True
    return data[keep].tobytes(), begin, begin + size, text


def crc32(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of every span, all spans a byte at a time."""
    size, flat = end - start, np.frombuffer(data, np.uint8)
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    left = np.flatnonzero(size <= _LONG)
    at = 0
    while len(left := left[size[left] > at]):
        now = out[left]
        out[left] = _CRC[(now ^ flat[start[left] + at]) & 255] ^ (now >> 8)
        at += 1
    out ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(size > _LONG).tolist():
        out[k] = zlib.crc32(data[start[k] : end[k]])
    return out


def _postings(t: Target):
    """A row for each slice and group of buckets that it has, and one (part -1) for its documents."""
    each = -(-t.buckets // PARTS)  # buckets of a group
    kind = np.uint16 if each * PARTS <= 1 << 16 else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for b in slices(batches, SLICE):
            data, start, end, text = words_of([x.as_py() or b"" for x in b.column("text").cast(pa.binary())])
            words = np.bincount(text, minlength=b.num_rows)
            bucket, place = [], []
            for n in range(1, t.ngrams + 1):
                own = text[n - 1 :] == text[: len(text) - n + 1]
                bucket.append(crc32(data, start[: len(own)][own], end[n - 1 :][own]) % t.buckets)
                place.append(text[n - 1 :][own])
            bucket, place = np.concatenate(bucket).astype(np.int64), np.concatenate(place)
            features = np.bincount(place, minlength=b.num_rows)
            key = (bucket % PARTS * each + bucket // PARTS).astype(kind)
            order = np.argsort(place, kind="stable") if t.ngrams > 1 else np.arange(len(place))
            order = order[np.argsort(key[order], kind="stable")]
            key, place = key[order].astype(np.int64), place[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(place) != 0)])[: len(key)])
            count = np.diff(np.concatenate([first, [len(key)]]))
            key, place = key[first], place[first]
            part, bucket = key // each, key % each * PARTS + key // each
            parts, begin = np.unique(part, return_index=True)
            rows = []
            for p, i, j in zip(parts.tolist(), begin.tolist(), [*begin[1:].tolist(), len(key)][: len(parts)], strict=True):
                rows.append((at, p, bucket[i:j].astype(np.int32).tobytes(), place[i:j].astype(np.int16).tobytes(), count[i:j].astype(np.int32).tobytes(), None, None, None, None))
            rows.append((at, -1, None, None, None, b.column("doc_id").to_pylist(), b.column("key").to_pylist(), features.tolist(), words.tolist()))
            longs = pa.list_(pa.int64())
            kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 3, longs, pa.list_(pa.string()), longs, longs)
            names = [x.split(" ")[0] for x in POSTINGS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            at += 1

    return run


def postings(docs: DataFrame, doc_id: Column, t: Target) -> DataFrame:
    rows = docs.select(doc_id.cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("key", F.when(F.col("doc_id").isNull(), key_of(F.col("doc_id"), F.col("text"))))
    return map_arrow(spread(rows), _postings(t), POSTINGS)


def _arrays(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    for r in zip(*(b.column(c) for c in ("buckets", "places", "counts")), strict=True):
        yield tuple(np.frombuffer(x.as_buffer(), k) for x, k in zip(r, (np.int32, np.int16, np.int32), strict=True))


def _totals(n: int):
    """A task's features in each of the n buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for b in batches:
            for buckets, _, counts in _arrays(b):
                total += np.bincount(buckets, counts, n).astype(np.int64)  # exact below 2^53
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["bucket", "n"])

    return run


def totals(posted: DataFrame, t: Target, name: str) -> DataFrame:
    """bucket, and under name how many features of the corpus fall into it."""
    some = map_arrow(posted.filter("part >= 0").select("buckets", "places", "counts"), _totals(t.buckets), "bucket long, n long")
    return some.groupBy("bucket").agg(F.sum("n").alias(name))


def gains(documents: DataFrame, target: DataFrame, t: Target) -> DataFrame:
    """part, buckets and gains of each group of buckets, from the counts s and t of both corpora."""
    both = checkpointed(documents.join(target, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")))
    all_ = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    up, down = ((F.col(c) + 1) * F.lit(n + t.buckets).cast("long") for c, n in (("t", all_.s), ("s", all_.t)))
    gain = F.floor(1000 * F.log(up.cast("double") / down.cast("double")))
    held = both.select((F.col("bucket") % PARTS).cast("int").alias("part"), F.struct("bucket", gain.alias("gain")).alias("x"))
    held = held.groupBy("part").agg(F.array_sort(F.collect_list("x")).alias("x"))  # buckets / PARTS of them
    return held.select("part", F.col("x.bucket").alias("own"), F.col("x.gain").alias("gains"))


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the buckets of a group add to each document."""
    for b in batches:
        rows, sums = [], []
        for at, own, gain, (buckets, places, counts) in zip(b.column("slice").to_pylist(), b.column("own"), b.column("gains"), _arrays(b), strict=True):
            own, gain = (x.values.to_numpy(zero_copy_only=False) for x in (own, gain))
            each = gain[np.searchsorted(own, buckets)] * counts
            total = np.bincount(places, each, SLICE).astype(np.int64)  # exact below 2^53
            some = np.flatnonzero(total)
            rows.append(at * SLICE + some), sums.append(total[some])
        columns = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, sums)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "gain"])


def weighted(posted: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, key (of rows without an id), n_features, n_words, weight of every document of the postings."""
    info = posted.filter("part < 0").select("slice", F.posexplode(F.arrays_zip("ids", "keys", "features", "words")))
    info = info.select((F.col("slice") * SLICE + F.col("pos")).alias("row"), *(F.col("col")[c].alias(c) for c in ("ids", "keys", "features", "words")))
    salts = max(1, -(-posted.filter("part < 0").count() // SALT))
    rows = posted.filter("part >= 0").select("part", F.pmod(F.xxhash64("slice"), F.lit(salts)).alias("salt"), "slice", "buckets", "places", "counts")
    each = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    met = rows.join(each.hint("shuffle_hash"), ["part", "salt"])
    parts = map_arrow(met.select("slice", "own", "gains", "buckets", "places", "counts"), _contributions, "row long, gain long")
    none = [F.lit(None).cast(k).alias(c) for c, k in (("ids", "long"), ("keys", "string"), ("features", "long"), ("words", "long"))]
    both = info.withColumn("gain", F.lit(0).cast("long")).unionByName(parts.select("row", *none, "gain"))
    out = both.groupBy("row").agg(*(F.max(c).alias(c) for c in ("ids", "keys", "features", "words")), F.sum("gain").alias("gain"))
    mean = F.when(F.col("features") > 0, F.expr("(gain - pmod(gain, features)) div features")).otherwise(0)  # rounded down
    return out.select(F.col("ids").alias("doc_id"), F.col("keys").alias("key"), F.col("features").alias("n_features"), F.col("words").alias("n_words"), mean.cast("long").alias("weight"))


def draw(rows: DataFrame, t: Target) -> DataFrame:
    """Adds score and rank to weighted rows; rank is null where a row is not drawn."""
    key = F.concat(F.lit(f"{t.seed}:"), F.coalesce(F.col("doc_id").cast("string"), "key"))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    rows = rows.withColumn("score", F.col("weight") + gumbel)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    some = checkpointed(rows.filter(F.col("n_words") >= t.least).repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sums = some.groupBy("range").agg(F.count("*").alias("n")).collect()  # a number a range
    before, n = {}, 0
    for r in sorted(sums):
        before[r["range"]] = n
        n += r["n"]
    most = t.percent * n // 100
    upto = [(k, v) for k, v in before.items() if v < most]  # ranges that hold a drawn row
    sofar = F.coalesce(*(F.when(F.col("range") == k, F.lit(v)) for k, v in upto), F.lit(most)) if upto else F.lit(most)
    rank = (F.row_number().over(Window.partitionBy("range").orderBy(*order)) + sofar).cast("long")
    ranked = some.withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).drop("range")
    return ranked.unionByName(rows.filter(F.col("n_words") < t.least).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, t: Target = Target()) -> DataFrame:
    """doc_id, n_features, n_words, weight, score, rank of every row of docs; drawn rows have a rank."""
    spark = docs.sparkSession
    at = scratch(spark, "importance")
    posted = stored(postings(docs, F.col("doc_id"), t), f"{at}/postings")
    known = gains(totals(posted, t, "s"), totals(postings(target, F.lit(None), t), t, "t"), t)
    out = checkpointed(draw(checkpointed(weighted(posted, known)), t).drop("key"))
    drop_folder(spark, at)
    return out
