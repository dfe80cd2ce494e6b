import json
import os
import zlib

import numpy as np
import pytest

from palimpsest.operators import build as B
from palimpsest.sources import archives as A
from palimpsest.sources import readers as R


@pytest.fixture
def archive(tmp_path):
    rng = np.random.default_rng(0)
    d = tmp_path / "carts"
    d.mkdir()
    np.savez(d / "a.cart.npz", embeddings=rng.normal(size=(3, 8)).astype(np.float32), passages=np.array(["x", "y", "z"]), per_pattern_meta=np.array(json.dumps([{"k": 1}, {}])))
    packed = np.array([np.frombuffer(zlib.compress(b"text %d" % i).ljust(20, b"\0"), np.uint8) for i in range(2)])
    np.savez(d / "b.npz", sign_bits=np.packbits(rng.normal(size=(2, 16)) > 0, axis=1), compressed_texts=packed)
    np.savez(d / "a_signatures.npz", signatures=np.zeros((1, 4)))
    return d


def test_archives(spark, archive):
    rows = {(r.collection, r.idx): r for r in R.read_archives(spark, str(archive)).collect()}
    assert sorted(rows) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]
    assert rows["a", 0].meta == {"k": "1"} and rows["a", 2].meta == {} and rows["a", 0].dim == 8
    assert rows["b", 0].embedding is None and rows["b", 0].dim == 16 and rows["b", 1].text == "text 1"


def test_data_source(spark, archive):
    spark.dataSource.register(A.Archives)
    assert spark.read.format("patterns_npz").load(str(archive / "a.cart.npz")).count() == 3
    key = lambda rows: sorted((r.collection, r.idx, r.text, r.embedding, r.sign_words, r.dim, r.link, r.meta) for r in rows.collect())
    assert key(spark.read.format("patterns_npz").load(str(archive))) == key(R.read_archives(spark, str(archive)))


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_archive_in_ranges(spark, tmp_path, monkeypatch, save):
    """Several tasks a stored file give what one gives; a deflated one is read through, block by block."""
    monkeypatch.setattr(A, "PART", 4000)
    monkeypatch.setattr(A, "BATCH", 7)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(101, 70)).astype(np.float32)
    save(tmp_path / "c.npz", embs=v, memories=np.array([f"é{i}" * (i % 5) for i in range(101)]), hippocampus=rng.integers(0, 255, (101, 64), dtype=np.uint8), per_pattern_meta=np.array([json.dumps({"n": i}) for i in range(101)]))
    reader = A.ArchiveReader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) > 5 if save is np.savez else len(parts) == 1
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [r["idx"] for r in rows] == list(range(101)) and [r["text"] for r in rows] == [f"é{i}" * (i % 5) for i in range(101)]
    assert np.allclose([r["embedding"] for r in rows], v) and dict(rows[40]["meta"]) == {"n": "40"} and {r["dim"] for r in rows} == {70}
    words = [int("".join("1" if x > 0 else "0" for x in part), 2) for part in (v[5][:64], v[5][64:])]
    assert [w % 2**64 for w in rows[5]["sign_words"]] == words and len(rows[5]["link"]) == 64
    assert rows == [dict(zip(A.SCHEMA.names, r[:-1], strict=False)) | {"meta": list(r[-1].items())} for r in A.rows_of("c", (tmp_path / "c.npz").read_bytes())]


def test_archives_written(spark, tmp_path):
    spark.dataSource.register(A.Archives)
    rows = [("a/b" if i % 3 else "c", i, None if i % 5 == 0 else f"text {i}\n" * (i % 4), [float(i), -1.0] if i % 7 else None, {"k": str(i)} if i % 2 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "collection string, idx long, text string, embedding array<float>, meta map<string,string>").repartition(3)
    at = str(tmp_path / "out")
    df.write.format("patterns_npz").mode("append").save(at)
    back = spark.read.format("patterns_npz").load(at)
    assert sorted((r.collection, r.idx, r.text, r.embedding, r.meta or None) for r in back.collect()) == sorted(rows)
    df.filter("idx < 10").write.format("patterns_npz").mode("overwrite").save(at)
    assert spark.read.format("patterns_npz").load(at).count() == 10
    assert not [f for f in os.listdir(at) if not f.endswith(".npz")]
    with pytest.raises(Exception, match="need the columns"):
        df.drop("embedding").write.format("patterns_npz").mode("append").save(at)


def test_failed_write_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(A.Archives)
    df = spark.range(200, numPartitions=4).selectExpr("'c' as collection", "id as idx", "'t' as text", "if(id = 150, array(float(raise_error('no'))), array(float(id))) as embedding")
    with pytest.raises(Exception, match="no"):
        df.write.format("patterns_npz").mode("append").save(str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("*.npz")) if (tmp_path / "out").exists() else True


def test_pickle_is_refused(tmp_path):
    with pytest.raises(ValueError, match="pickled"):
        A.refuse_pickle("x.pkl")
    np.savez(tmp_path / "p.npz", embeddings=np.zeros((2, 2)), passages=np.array(["a", None], object))
    with pytest.raises(ValueError, match="pickled"):
        list(A.rows_of("p", (tmp_path / "p.npz").read_bytes()))


def test_catalog(spark, archive):
    assert sorted(r.name for r in R.find_collections(spark, [str(archive)]).collect()) == ["a", "b"]


def test_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello there")
    (tmp_path / "b.jsonl").write_text('{"text": "one"}\nnot json\n{"content": "two"}\n')
    (tmp_path / "c.json").write_text(json.dumps([{"text": "p"}, {"content": "q"}]))
    (tmp_path / "d.md").write_text("  \n")
    rows = {r.source: r.text for r in R.read_folder(spark, str(tmp_path)).collect()}
    assert rows["a.txt"] == "hello there" and sorted(rows) == ["a.txt", "b.jsonl", "c.json"]
    assert [p.strip() for p in rows["b.jsonl"].split("---PASSAGE_BREAK---")] == ["one", "not json", "two"]
    assert [p.strip() for p in rows["c.json"].split("---PASSAGE_BREAK---")] == ["p", "q"]


def test_entries(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"entries": [{"game": "g"}, {"game": "h"}]}))
    (tmp_path / "m1").mkdir()
    (tmp_path / "m1" / "x_learning.jsonl").write_text('{"game": "g"}\n{broken\n')
    assert R.read_entries(spark, str(tmp_path / "e.json"), "game string").count() == 2
    assert [(r.machine, r.game) for r in R.read_machines(spark, str(tmp_path), "game string").collect()] == [("m1", "g")]


def test_manifest(spark, archive, tmp_path):
    rows = R.read_archives(spark, str(archive)).filter("collection = 'a'")
    R.write_manifest(B.manifest(rows), str(tmp_path / "m"))
    stored = spark.read.json(str(tmp_path / "m"))
    assert B.verify(rows, stored).first().ok
    assert not B.verify(rows.limit(2), stored).first().ok
    R.write_collections(rows, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("collection = 'a'").count() == 3


def test_ir(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "title": "t", "text": "x"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "x"}\n{"_id": "q2", "text": "y"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq2\td1\t0\n")
    corpus, queries, judged = R.read_ir(spark, str(tmp_path))
    assert (corpus.count(), [r.id for r in queries.collect()], judged.count()) == (1, ["q1"], 1)
