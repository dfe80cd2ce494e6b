import time

import pytest
from pyspark.sql import functions as F

from palimpsest.api import Engine, Lock
from palimpsest.functions.vector import hashed_embedder
from palimpsest.operators import activity as A
from palimpsest.operators import federate as Fed
from palimpsest.streaming import stateful


def test_rate_limit(spark):
    rows = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate([0, 1, 2, 3, 61, 62])], "client long, event_id long, t double")
    got = stateful.rate_limited(rows, 3, 60.0).orderBy("event_id").collect()
    assert [r.allowed for r in got] == [True, True, True, False, True, True]


def test_rate_limit_as_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate([0, 1, 2, 3, 61, 62])], "client long, event_id long, t double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stateful.rate_limited(stream, 3, 60.0).writeStream.format("memory").queryName("allowed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("allowed").filter("allowed").count() == 5


def test_leases(spark):
    events = [("c", 0, 0.0, "a", "acquire", 5.0), ("c", 1, 1.0, "b", "acquire", 5.0), ("c", 2, 2.0, "b", "release", 5.0), ("c", 3, 6.0, "b", "acquire", 5.0), ("c", 4, 7.0, "b", "release", 5.0)]
    rows = spark.createDataFrame(events, "collection string, event_id long, t double, agent string, action string, lease double")
    assert [r.result for r in stateful.leases(rows).orderBy("event_id").collect()] == ["granted", "refused", "not the holder", "granted", "released"]


def test_publish_stream(spark, tmp_path):
    rows = spark.createDataFrame([("m", "a"), ("m", "a"), ("m", "b")], "machine string, pattern string")
    rows = rows.withColumn("signature", Fed.signature(rows))
    for k in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        stateful.publish_stream(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2, k


def test_sync_stream(spark, tmp_path):
    spark.createDataFrame([("a/b", "x")], "machine string, text string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("machine string, text string").json(str(tmp_path / "in"))
    stateful.sync(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).first().machine == "a_b"


def test_lock():
    lock = Lock(lease=0.2)
    assert lock.acquire("a")
    began = time.monotonic()
    assert not lock.acquire("b", timeout=0.1)
    assert time.monotonic() - began < 1
    with pytest.raises(PermissionError):
        lock.release("b")
    assert lock.acquire("b", timeout=1.0)


@pytest.fixture
def engine(spark):
    _, embed = hashed_embedder(64)
    e = Engine(spark, embed)
    for name, texts in {"one": ["the river flows north", "cats sleep all day"], "two": ["the river flows north now", "engines burn fuel"]}.items():
        rows = [(i, t, [float(x) for x in embed(t)], {"lang": "en"}) for i, t in enumerate(texts)]
        e.mount(name, spark.createDataFrame(rows, "idx long, text string, embedding array<float>, meta map<string,string>"), role=name)
    return e


def test_engine(spark, engine, tmp_path):
    assert engine.memory_search("one", "river flows north", 1).first().idx == 0
    assert engine.multi_search("river flows", 2, roles=["two"]).first().collection == "two"
    with pytest.raises(ValueError, match="is mounted"):
        engine.mount("one", engine.mounted["one"].patterns)
    idx = engine.imprint("one", "volcanoes erupt", "alice", tags="geo")
    assert idx == 2 and engine.get_passage("one", idx).first().text == "[geo] volcanoes erupt"
    assert engine.writes_by_agent("one") == {"alice": 1} and engine.lock_holder("one") is None
    assert engine.filter("one", {"tags_all": ["geo"]}).count() == 1
    engine.save("one", str(tmp_path / "one"))
    assert spark.read.parquet(str(tmp_path / "one" / "patterns")).count() == 3
    assert engine.consolidate().count() == 5
    engine.unmount("two")
    assert [s["collection"] for s in engine.status()] == ["one"]


def test_session_eviction(engine):
    engine.most_sessions = 2
    for s in "abc":
        engine.session(s)
    assert list(engine.sessions) == ["b", "c"]


def test_provision_twice(spark):
    packs = spark.createDataFrame([("u", "p")], "owner_id string, name string")
    want = spark.createDataFrame([("u", "p"), ("v", "p"), ("v", "p")], "owner_id string, name string")
    once = A.provision(packs, want)
    assert once.count() == 2 and A.provision(once, want).count() == 2


def test_starter_and_queue(spark):
    packs = spark.createDataFrame([("p", "o"), ("q", None)], "pack string, owner_id string")
    rows = A.starter(packs, "{pack} of {owner}", "read {pack}", 1)
    found = {(r.pack, r.idx): (r.text, r.pattern_id, r.next, r.flags, r.perms_byte, r.format_version) for r in rows.collect()}
    assert found[("p", 0)] == ("p of o", 0, 1, 0x42, 1, 2) and found[("q", 1)] == ("read q", 1, 0, 0x42, 3, 2)
    rows = rows.filter("pack = 'p'").select("pack", "idx", "text")
    task = rows.limit(1).select("pack", F.lit(5).cast("long").alias("idx"), A.dispatch(F.lit("do it"), "2024").alias("text"))
    assert [r.idx for r in A.queue(rows.union(task)).collect()] == [5]


def test_observer_keeps_names_over_batches(spark, tmp_path):
    def frame(*at):
        cells = [0] * 64
        for p, color in at:
            cells[p] = color
        return cells

    steps = [frame((9, 1), (50, 2)), frame((10, 1), (50, 2)), frame((11, 1), (50, 2), (60, 3)), frame((50, 2))]
    rows = spark.createDataFrame([(0, i, c) for i, c in enumerate(steps)], "level long, step long, cells array<int>")
    expected = [(0, 2, None, None, [0, 1]), (1, 2, 2, 1, [0, 1]), (2, 3, 3, 1, [0, 1, 2]), (3, 1, 2, 0, [1])]
    assert [(r.step, r.objects, r.changed, r.moves, r.names) for r in stateful.observed(rows, 8).orderBy("step").collect()] == expected
    got = []
    for k in range(2):
        rows.filter(f"step div 2 = {k}").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        q = stateful.observed(stream, 8).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = [(r.step, r.objects, r.changed, r.moves, r.names) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("step").collect()]
    assert got == expected


def test_publishing_a_batch_again(spark, tmp_path):
    """A batch that is run again after its write, before its commit, leaves the table as it was."""
    import shutil

    rows = spark.createDataFrame([("m", "a"), ("m", "b")], "machine string, pattern string")
    rows.withColumn("signature", Fed.signature(rows)).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("machine string, pattern string, signature string").parquet(str(tmp_path / "in"))
        stateful.publish_stream(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        shutil.rmtree(tmp_path / "c" / "commits")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_writers_do_not_lose_rows(spark):
    import threading

    _, embed = hashed_embedder(8)
    engine = Engine(spark, embed)
    engine.mount("c", spark.createDataFrame([], "idx long, text string, embedding array<float>, meta map<string,string>"))
    threads = [threading.Thread(target=engine.store, args=("c", f"text {i}"), kwargs={"timeout": 60.0}) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r.idx for r in engine._of("c").select("idx").collect()) == list(range(6))


def replay(spark, tmp_path, rows, batches, run, name):
    """What run gives out of a stream of the batches (conditions on rows), polled one after another."""
    for k, which in enumerate(batches):
        rows.filter(which).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        q = run(stream).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(str(tmp_path / name))


def test_rate_limit_in_event_order(spark, tmp_path, monkeypatch):
    """Late and interleaved batches give what one batch gives, as far as the watermark has come."""
    rows = spark.createDataFrame([(c, i, 1.0 + (i * 37) % 100) for c in (1, 2) for i in range(100)] + [(c, 1000 + k, 5000.0 + 1000 * k) for c in (1, 2) for k in range(3)], "client long, event_id long, t double")
    batch = {(r.client, r.event_id): r.allowed for r in stateful.rate_limited(rows, 3, 10.0).collect()}
    parts = ["event_id % 3 = 0 and event_id < 1000", "event_id % 3 = 1 and event_id < 1000", "event_id % 3 = 2 and event_id < 1000", "event_id = 1000", "event_id = 1001", "event_id = 1002"]
    got = {(r.client, r.event_id): r.allowed for r in replay(spark, tmp_path, rows, parts, lambda s: stateful.rate_limited(s, 3, 10.0, delay="200 seconds"), "out").collect()}
    assert len([k for k in got if k[1] < 1000]) == 200 and all(batch[k] == got[k] for k in got)


def test_chunks_of_a_key_carry_on(spark):
    """A key's rows that come in many chunks are gone through in order."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.createDataFrame([(c, i, float((i * 53) % 200)) for c in (1, 2, 3) for i in range(200)], "client long, event_id long, t double").repartition(5)
        got = {(r.client, r.event_id): r.allowed for r in stateful.rate_limited(rows, 2, 5.0).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for c in (1, 2, 3):
        held = []
        for t, i in sorted((float((i * 53) % 200), i) for i in range(200)):
            held = [x for x in held if x >= t - 5.0]
            assert got[c, i] == (len(held) < 2)
            held += [t] if len(held) < 2 else []


def test_sessions_in_a_stream(spark, tmp_path):
    """Beginnings and ends of sessions, idle ones gone and the longest unseen pushed out, in a batch and replayed."""
    times = [(5, 1), (10, 2), (20, 3), (30, 1), (40, 4), (2000, 5), (2001, 2), (9000, 1), (20000, 9), (40000, 9), (60000, 9)]
    rows = spark.createDataFrame([(7, i, s, float(t)) for i, (t, s) in enumerate(times)], "server long, event_id long, session_id long, t double")
    log = [(r.session_id, r.t, r.what) for r in stateful.session_log(rows, most=3).orderBy("t", "what", "session_id").collect()]
    assert log[:5] == [(1, 5.0, "created"), (2, 10.0, "created"), (3, 20.0, "created"), (4, 40.0, "created"), (2, 40.0, "evicted")]
    assert [x for x in log if x[1] == 2000.0] == [(5, 2000.0, "created"), (1, 2000.0, "expired"), (3, 2000.0, "expired"), (4, 2000.0, "expired")]
    states = {r.session_id: r.status for r in stateful.session_states(stateful.session_log(rows.filter("t <= 2001"), most=3), rows.filter("t <= 2001")).collect()}
    assert states == {1: "expired", 2: "active", 3: "expired", 4: "expired", 5: "active"}
    got = replay(spark, tmp_path, rows, ["event_id in (0, 2, 4, 6)", "event_id in (1, 3, 5)", "event_id = 7", "event_id = 8", "event_id = 9", "event_id = 10"], lambda s: stateful.session_log(s, most=3, delay="3000 seconds"), "out")
    seen = sorted((r.t, r.what, r.session_id) for r in got.collect())
    assert [(s, t, w) for t, w, s in seen] == log[: len(seen)] and len(seen) >= 12


def test_resets_within_a_batch(spark, tmp_path):
    """Steps that begin again are ordered by time; a reset begins the level anew."""
    from datetime import datetime, timedelta

    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    cells = lambda k: [k, *[0] * 63]
    rows = [(0, 0, cells(1), at(0), None), (0, 1, cells(2), at(1), None), (0, 0, cells(2), at(2), True), (0, 1, cells(2), at(3), None), (0, 9, cells(0), at(500), None), (0, 10, cells(0), at(900), None), (0, 11, cells(0), at(1300), None)]
    df = spark.createDataFrame(rows, "level long, step long, cells array<int>, at timestamp, reset boolean").repartition(3)
    want = [(0, -1), (1, 1), (0, -1), (1, 0), (9, 1), (10, 0), (11, 0)]
    got = [(r.step, r.changed) for r in stateful.frame_changes(df).collect()]
    assert sorted(got) == sorted(want)
    seen = [(r.step, r.changed) for r in stateful.observed(df, 8).collect()]
    assert sorted(seen, key=str) == sorted([(s, None if c < 0 else c) for s, c in want], key=str)
    late = replay(spark, tmp_path, df, ["second(at) in (0, 3) and step < 9", "second(at) in (1, 2) and step < 9", "step = 9", "step = 10", "step = 11"], lambda s: stateful.frame_changes(s, delay="60 seconds"), "out")
    assert sorted((r.step, r.changed) for r in late.collect() if r.step < 9) == sorted(want[:4])


def test_engines_that_share_a_ledger(spark, tmp_path):
    """Two engines, as of two processes: numbers do not clash, and each sees what the other has committed."""
    import threading

    _, embed = hashed_embedder(8)
    one, two = Engine(spark, embed), Engine(spark, embed)
    for e in (one, two):
        e.open("c", str(tmp_path / "book"))
    assert one.imprint("c", "first", "alice", tags="t") == 0 and two.imprint("c", "second", "bob") == 1
    threads = [threading.Thread(target=e.store, args=("c", f"text {i}"), kwargs={"timeout": 120.0}) for i, e in enumerate((one, two))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    for e in (one, two):
        e.refresh("c")
        rows = {r.idx: r.text for r in e._of("c").collect()}
        assert sorted(rows) == [0, 1, 2, 3] and rows[0] == "[t] first" and e.lock_holder("c") is None
    assert one.memory_search("c", "second", 1).first().text == "second"
    assert two.acquire_lock("c", "bob", 1.0) and not one.acquire_lock("c", "alice", 0.05) and one.lock_holder("c") == "bob"
    with pytest.raises(TimeoutError, match="bob"):
        one.store("c", "late", timeout=0.05)
    two.release_lock("c", "bob")


def test_objects_at_one_place_have_names_of_their_own(spark):
    """A ring and the cell in its middle have one colour and one centroid."""
    cell = lambda r, c: 1 if (r, c) == (3, 3) else 0
    ringed = lambda r, c: 1 if (r, c) == (3, 3) or max(abs(r - 3), abs(c - 3)) == 2 else 0
    rows = [(0, step, [f(r, c) for r in range(8) for c in range(8)]) for step, f in enumerate((cell, ringed, ringed))]
    got = stateful.observed(spark.createDataFrame(rows, "level long, step long, cells array<int>"), 8).orderBy("step").collect()
    assert [r.objects for r in got] == [1, 2, 2] and all(len(set(r.names)) == r.objects for r in got)
    assert got[1].names == got[2].names and 0 in got[1].names
