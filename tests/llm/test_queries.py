import oracle
import pytest

from palimpsest.llm.queries import QUERIES
from palimpsest.llm.sql import SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, small, name):
    assert oracle.difference(QUERIES[name](spark, small), SQL[name], con) == ""


def test_pipeline(spark, small):
    import corpus_pipeline

    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    texts = {}
    for r in rows:
        texts.setdefault("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in docs[r.doc_id].text), set()).add(r.doc_id)
    assert all(len(ids) == 1 for ids in texts.values())  # no two copies are left


def test_stages_keep_columns(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
