"""Appends by rival writers, manifests out of the log, locks among processes."""

import multiprocessing
import threading
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import build as B
from palimpsest.sources import ledger as L

ROWS = "collection string, place long, text string, embedding array<float>"


def rows(spark, name, n, tag):
    return spark.createDataFrame([(name, i, f"{tag} {i}", [float(i), 1.0]) for i in range(n)], ROWS)


def test_rival_writers_lose_nothing(spark, tmp_path):
    """Writers that know nothing of each other; every row is there once, under a number of its own."""
    at = str(tmp_path / "book")
    failed = []

    def write(agent):
        try:
            for k in range(3):
                L.Ledger(spark, at).append(rows(spark, "c", 2, f"{agent}{k}").unionByName(rows(spark, agent, 1, f"{agent}{k}")), agent)
        except Exception as e:  # shown by the assertion below
            failed.append(e)

    threads = [threading.Thread(target=write, args=(a,)) for a in ("a", "b", "d")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    book = L.Ledger(spark, at)
    got = book.read().collect()
    assert sorted(r.idx for r in got if r.collection == "c") == list(range(18)) and len({r.text for r in got if r.collection == "c"}) == 18
    assert sorted(r.idx for r in got if r.collection == "d") == [0, 1, 2]
    assert [r.version for r in book.commits().orderBy("version").collect()] == list(range(1, 10))
    assert {(r.collection, r.agent): r.rows for r in book.writers(100).filter("collection = 'c'").collect()} == {("c", a): 6 for a in "abd"}


def test_manifest_out_of_the_log(spark, tmp_path):
    book = L.Ledger(spark, str(tmp_path / "book"))
    assert book.manifest().count() == 0
    with pytest.raises(ValueError, match="nothing"):
        book.read()
    for k in range(3):
        book.append(rows(spark, "c", 4, k).withColumn("embedding", F.transform("embedding", lambda x, k=k: x + k).cast("array<float>")))
    want = {tuple(r) for r in B.manifest(book.read()).select("collection", "n_patterns", "dim", "fingerprint").collect()}
    assert {tuple(r) for r in book.manifest().collect()} == want
    plan = book.manifest()._jdf.queryExecution().optimizedPlan().toString()
    assert "place" not in plan and "parquet" not in plan  # no row that is stored is read again


def test_rows_that_have_their_numbers(spark, tmp_path):
    book = L.Ledger(spark, str(tmp_path / "book"))
    book.append(rows(spark, "c", 2, "x").withColumnRenamed("place", "idx").withColumn("idx", F.col("idx") + 50))
    assert sorted(r.idx for r in book.read().collect()) == [50, 51]
    with pytest.raises(ValueError, match="places"):
        book.append(rows(spark, "c", 3, "x").filter("place > 0"))
    assert book.read().count() == 2  # rows of an append that failed are not seen


def claims(folder, agent, n, out):
    log = L.Log(None, folder)
    for _ in range(n):
        while not log.make(L._name(k := log.latest() + 1), {"agent": agent}):
            pass
        out.put((k, agent))


def test_processes_make_each_number_once(tmp_path):
    at, out = str(tmp_path / "log"), multiprocessing.get_context("fork").Queue()
    own = [multiprocessing.get_context("fork").Process(target=claims, args=(at, a, 40, out)) for a in "abc"]
    for p in own:
        p.start()
    got = [out.get(timeout=60) for _ in range(120)]
    for p in own:
        p.join()
    assert sorted(k for k, _ in got) == list(range(1, 121))
    assert all(L.Log(None, at).read(L._name(k))["agent"] == a for k, a in got)


def holding(folder, agent, spans):
    lock = L.SharedLock(folder, lease=30.0)
    for _ in range(5):
        assert lock.acquire(agent, timeout=30)
        began = time.monotonic()
        time.sleep(0.005)
        spans.put((began, time.monotonic()))
        lock.release(agent)


def test_a_lock_among_processes(tmp_path):
    at, spans = str(tmp_path / "lock"), multiprocessing.get_context("fork").Queue()
    own = [multiprocessing.get_context("fork").Process(target=holding, args=(at, a, spans)) for a in "abc"]
    for p in own:
        p.start()
    got = sorted(spans.get(timeout=60) for _ in range(15))
    for p in own:
        p.join()
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))  # never two at a time


def test_leases_of_a_shared_lock(tmp_path):
    one, other = (L.SharedLock(str(tmp_path / "lock"), lease=0.4) for _ in range(2))
    assert one.acquire("a") and one.agent == other.agent == "a"
    began = time.monotonic()
    assert not other.acquire("b", timeout=0.1) and time.monotonic() - began < 1
    with pytest.raises(PermissionError):
        other.release("b")
    assert other.acquire("b", timeout=3.0) and one.agent == "b"  # taken over
    other.release("b")
    assert one.agent is None and one.acquire("a", timeout=0)
