"""Heaps of texts behind predicates, and activity polled by a cursor."""

import datetime as dt
import sqlite3

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import heap as H
from palimpsest.streaming import polling as P


@pytest.fixture
def pushing(spark):
    with H.pushing(spark):
        yield spark


@pytest.fixture
def heap(spark, tmp_path):
    spark.dataSource.register(H.Heap)
    rows = spark.range(1000).select(F.col("id").alias("idx"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("é text "), F.col("id").cast("string"))).alias("passage"), F.col("id").cast("string").alias("paper_id"))
    at = str(tmp_path / "heap")
    rows.repartitionByRange(3, "idx").write.format("patterns_sqlite").mode("append").save(at)
    return at


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_heap_is_read_whole(spark, heap, monkeypatch):
    monkeypatch.setattr(H, "SPAN", 100)
    reader, rows = H.HeapReader({"path": heap}), H.read_heap(spark, heap)
    parts = reader.partitions()
    assert rows.count() == sum(b.num_rows for p in parts for b in reader.read(p)) == 1000 and len(parts) >= 10
    assert rows.filter("idx = 18").first().passage is None and rows.filter("idx = 19").first().passage == "é text 19"


def test_predicates_reach_the_heap(pushing, heap):
    rows = H.read_heap(pushing, heap)
    some = rows.filter(F.col("idx").isin(5, 700, 5000))
    assert sorted((r.idx, r.passage) for r in some.collect()) == [(5, "é text 5"), (700, "é text 700")]
    assert "Filter" not in plan_of(some).replace("RuntimeFilters", "")  # nothing is left for Spark to filter
    assert some.rdd.getNumPartitions() == 2  # the file that has neither row is not opened for rows
    assert rows.filter("idx >= 10 and idx < 13 and passage like '%11'").count() == 1
    assert rows.filter("idx = 3 and idx > 4").count() == 0 and rows.filter("idx in (3, 4) and idx in (4, 5)").first().idx == 4


def test_only_named_rows_are_read(heap):
    reader = H.PushingReader({"path": heap})
    assert list(reader.pushFilters([H.In(("idx",), (7, 8, None)), H.EqualTo(("title",), "x")])) == [H.EqualTo(("title",), "x")]
    parts = reader.partitions()
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 2 and len(parts) == 1


def test_fetch(pushing, heap):
    top = pushing.createDataFrame([(3, 0.5), (4000, 0.4), (12, 0.3)], "idx long, score double")
    got = {r.idx: r.passage for r in H.fetch(top, H.read_heap(pushing, heap)).collect()}
    assert got == {3: "é text 3", 4000: None, 12: "é text 12"}
    assert H.fetch(top.filter("false"), H.read_heap(pushing, heap)).count() == 0


def test_heap_written_over(spark, heap):
    spark.range(5).selectExpr("id as idx", "'n' as passage").write.format("patterns_sqlite").mode("overwrite").save(heap)
    assert H.read_heap(spark, heap).count() == 5
    with pytest.raises(Exception, match="idx and passage"):
        spark.range(5).write.format("patterns_sqlite").mode("append").save(heap)
    with pytest.raises(ValueError, match="mounted"):
        H.local("s3://bucket/x.db")


def test_file_of_another_tool(spark, tmp_path):
    with sqlite3.connect(tmp_path / "x.sqlite") as c:
        c.execute("CREATE TABLE passages (idx INTEGER PRIMARY KEY, passage TEXT, title TEXT, paper_id TEXT)")
    assert H.read_heap(spark, str(tmp_path / "x.sqlite")).count() == 0


def at(seconds):
    return dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=seconds)


def add(spark, folder, *events):
    rows = spark.createDataFrame([(p, i, k, at(s)) for p, i, k, s in events], "pack string, event_id long, event_type string, created_at timestamp")
    rows.coalesce(1).write.mode("append").parquet(folder)


def poll(spark, tmp_path, name="out", **options):
    spark.dataSource.register(P.Activity)
    rows = spark.readStream.format("activity").options(**options).load(str(tmp_path / "log"))
    out = str(tmp_path / name)
    q = rows.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(r.event_id for r in spark.read.schema(P.ROW).parquet(out).collect())


def test_polls_go_on_from_their_cursor(spark, tmp_path):
    log = str(tmp_path / "log")
    add(spark, log, ("p", 1, "store", 0), ("p", 2, "copy", 5), ("q", 3, "store", 5))
    assert poll(spark, tmp_path) == [1, 2, 3]
    assert poll(spark, tmp_path) == [1, 2, 3]  # nothing new
    add(spark, log, ("p", 4, "store", 5), ("p", 5, "store", 9), ("p", 0, "store", 3))
    assert poll(spark, tmp_path) == [1, 2, 3, 4, 5]  # 4 came later at the same moment; 0 is older than the cursor
    assert poll(spark, tmp_path, "since", since=at(5).isoformat()) == [5]  # strictly newer
    assert poll(spark, tmp_path, "typed", types="copy, none") == [2] and poll(spark, tmp_path, "packed", pack="q") == [3]


def test_a_batch_that_runs_again_is_the_same(spark, tmp_path):
    log = str(tmp_path / "log")
    add(spark, log, ("p", 1, "store", 0), ("p", 2, "copy", 5))
    reader = P.Poll({"path": log})
    first = reader.latestOffset()
    read = lambda a, z: sorted(r["event_id"] for p in reader.partitions(a, z) for b in reader.read(p) for r in b.to_pylist())
    assert read(reader.initialOffset(), first) == [1, 2]
    add(spark, log, ("p", 3, "store", 7))
    assert read(reader.initialOffset(), first) == [1, 2] and read(first, reader.latestOffset()) == [3]
    assert P.Poll({"path": str(tmp_path / "none")}).latestOffset() == P.Poll({"path": log}).initialOffset()
