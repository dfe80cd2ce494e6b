"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Runs of anything but ASCII white space, the "words" of every size and shingle here.
WORDS = r"[^\x20\x09-\x0D]+"
#: Draws are the first 13 hex digits of an MD5, so they fit a double exactly.
DRAW_BITS = 52
DRAWS = 1 << DRAW_BITS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the cluster's checkpoint folder (shared_folder), its lineage cut.

    Spark's context cleaner owns the files.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one is chosen only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or "/tmp/checkpoints"


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def draw(key: Column, salt: str) -> Column:
    """A reproducible 52-bit number for key (a string column)."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(":" + salt))), 1, 13), 16, 10).cast("long")


def key_of(doc_id: Column, text: Column) -> Column:
    """The string that stands for a row: its id, or for rows without one their text's digest."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("null-"), F.md5(F.coalesce(text, F.lit("")))))


def buckets_for(rows: int, per_bucket: int = 4096, least: int = 256) -> int:
    """A power of two of buckets, so many that a bucket holds about per_bucket rows at most."""
    n = least
    while n * per_bucket < rows:
        n *= 2
    return n


def bucket(h: Column, n: int) -> Column:
    """The leading bits of a draw: buckets follow the draw's order."""
    return F.shiftright(h, DRAW_BITS - (n.bit_length() - 1)).cast("int")


def running(df: DataFrame, group: str, h: str, ties: list[str], value: Column, n: int, name: str) -> DataFrame:
    """Adds name, the running sum (inclusive) of value in each group by (h, ties).

    No task sees more than one bucket of one group: buckets are summed first (combined before
    the shuffle), their sums accumulated per group, and rows added up within their bucket only.
    """
    b = bucket(F.col(h), n)
    df = df.withColumn("_b", b).withColumn("_v", value)
    sums = df.groupBy(group, "_b").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_g"), F.col("_b").alias("_bb"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(group, "_b").orderBy(h, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.join(sums, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_bb")), "left")
        .withColumn(name, F.sum("_v").over(inside) + F.col("_o"))
        .drop("_b", "_v", "_g", "_bb", "_o")
    )


#: Workers outlive tasks: these make them give freed memory back to the system.
WORKER = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "131072", "MALLOC_TRIM_THRESHOLD_": "131072", "ARROW_DEFAULT_MEMORY_POOL": "system"}
BATCH, _BATCH_CONF = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def slices(batches, rows: int = 256):
    """Smaller record batches, so that no more than their texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def map_arrow(df: DataFrame, f, schema: str | StructType) -> DataFrame:
    """df.mapInArrow where Python workers can import this package from the driver's folder.

    Batches that would be larger than BATCH bytes are cut, unless the session says otherwise:
    a task holds a batch several times over.
    """
    spark = df.sparkSession
    if spark.conf.get(_BATCH_CONF, "64MB").lower() in ("64mb", "67108864b", "67108864"):
        spark.conf.set(_BATCH_CONF, str(BATCH))
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), root]))
    for name, value in WORKER.items():
        env.setdefault(name, value)
    return df.mapInArrow(f, schema)


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt to all cores where their files have fewer splits than there are cores.

    Such a table is small, or its files cannot be split; others stay where they are.
    """
    plan = rows._jdf.queryExecution().executedPlan()
    n = rows.sparkSession.sparkContext.defaultParallelism
    if "Adaptive" in plan.getClass().getSimpleName() or plan.execute().getNumPartitions() >= n:
        return rows
    return rows.repartition(n)


#: Bits of the id filter: a hashed bitmap of this size, whatever the number of ids.
FILTER_BITS = 1 << 26


def id_filter(ids: DataFrame) -> DataFrame:
    """A hashed bitmap of the ids in column 0: bucket, bits. At most FILTER_BITS / 8 bytes."""
    bits = F.expr("bitmap_construct_agg(bitmap_bit_position(_h))").alias("_bits")
    return ids.select(_slot(F.col(ids.columns[0])).alias("_h")).groupBy(F.expr("bitmap_bucket_number(_h)").alias("_bucket")).agg(bits)


def _slot(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(FILTER_BITS))


def maybe_in(rows: DataFrame, doc_id: str, bitmap: DataFrame) -> DataFrame:
    """Adds _maybe: false where doc_id is surely not among the filter's ids (null ids: false)."""
    rows = rows.withColumn("_h", _slot(F.col(doc_id)))
    rows = rows.withColumn("_b", F.expr("bitmap_bucket_number(_h)")).withColumn("_p", F.expr("bitmap_bit_position(_h)"))
    byte = F.expr("cast(conv(hex(substring(_bits, cast(_p div 8 as int) + 1, 1)), 16, 10) as int)")
    bit = (F.expr("cast(pow(2, _p % 8) as int)").bitwiseAND(byte) != 0) & F.col(doc_id).isNotNull()
    out = rows.join(F.broadcast(bitmap), F.col("_b") == F.col("_bucket"), "left")
    return out.withColumn("_maybe", F.coalesce(bit, F.lit(False))).drop("_h", "_b", "_p", "_bucket", "_bits")


#: Groups above HOT_SIZE rows are looked up in a broadcast table of at most HOT_GROUPS rows.
HOT_SIZE, HOT_GROUPS = 1000, 1000


def look_up(rows: DataFrame, key: str, spare: Column, found: DataFrame, size: str) -> DataFrame:
    """rows left-joined with found (one row a key) without sending a hot key's rows to one task.

    The largest groups, HOT_GROUPS of them at most, are broadcast; their rows take part in the
    shuffled join under keys made of spare, a string column that spreads them.
    """
    values = [c for c in found.columns if c != key]
    hot = found.filter(F.col(size) > HOT_SIZE).orderBy(F.col(size).desc(), key).limit(HOT_GROUPS)
    hot = hot.select(F.col(key).alias("_hot"), *(F.col(c).alias("_hot_" + c) for c in values))
    rows = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    own = F.when(F.col("_hot").isNull(), F.col(key).cast("string")).otherwise(F.concat(F.lit("#"), spare))
    other = found.select(F.col(key).cast("string").alias("_own"), *values)
    out = rows.withColumn("_own", F.coalesce(own, F.concat(F.lit("#"), spare))).join(other, "_own", "left")
    return out.select(*(c for c in rows.columns if c == key or not c.startswith("_hot")), *(F.coalesce("_hot_" + c, c).alias(c) for c in values))


def stored(df: DataFrame, folder: str) -> DataFrame:
    """df written as Parquet to folder and read again: its lineage is cut, its columns are packed."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def scratch(spark: SparkSession, name: str) -> str:
    """The name of a new folder that the driver and all executors share; drop_folder removes it."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4()}"
