import oracle
import pytest

from palimpsest.plans.more import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, small, name):
    df = QUERIES[name](spark, small)
    if name in SQL:
        assert oracle.difference(df, SQL[name], con) == ""
    else:
        assert df.count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_top_k_needs_no_shuffle(spark, small):
    plan = QUERIES["hybrid_topk"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_filters_reach_the_scan(spark, small):
    from pyspark.sql import functions as F

    from palimpsest.operators import search as S
    from palimpsest.plans.queries import asked, vectors

    df = S.search(vectors(spark, small).withColumn("text", F.lit("")), asked(spark, small), "", 5, where=F.col("idx") > 100)
    assert "GreaterThan(vec_id,100)" in df._jdf.queryExecution().executedPlan().toString()
