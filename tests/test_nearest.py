"""Pruned neighbours against brute force, and how much is pruned."""

import numpy as np
import pytest

from palimpsest.functions.vector import COSINE_SHARE, EPSILON, SIGN_SHARE
from palimpsest.operators import federate as Fed
from palimpsest.operators import nearest as N

SCHEMA = "idx long, part long, embedding array<float>"


def clustered(n=1200, clusters=24, dim=16, spread=0.05, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    own = rng.integers(0, clusters, n)
    own[: n // 3] = 0  # a third of all rows is one cluster
    v = (centres[own] + spread * rng.normal(size=(n, dim))).astype(np.float32)
    v[5], v[6] = 0, v[7]
    return [(i, int(i % 7), v[i].tolist()) for i in range(n)]


def naive(rows, k, other_parts, blended, least):
    out = {}
    for i, p, v in rows:
        v, found = np.array(v), []
        for j, q, w in rows:
            if len(w) != len(v) or (p == q if other_parts else i == j):
                continue
            w = np.array(w)
            s = v @ w / ((np.linalg.norm(v) + EPSILON) * (np.linalg.norm(w) + EPSILON))
            if blended:
                s = COSINE_SHARE * s + SIGN_SHARE * (1 - ((v > 0) != (w > 0)).mean())
            if s >= least:
                found.append((round(-s, 9), q, j))
        out[i] = [(j, -s) for s, _, j in sorted(found)[:k]]
    return {i: x for i, x in out.items() if x}


@pytest.mark.parametrize(("other_parts", "blended", "least", "block"), [(False, False, -np.inf, 90), (True, True, 0.75, 90), (True, True, -np.inf, 90), (True, True, 0.75, 8192)])
def test_neighbours(spark, monkeypatch, other_parts, blended, least, block):
    monkeypatch.setattr(N, "ROWS", block)
    monkeypatch.setattr(N, "EACH", 16)
    rows = clustered(500) + [(900 + i, i % 2, [1.0, i / 9]) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {}
    for r in N.neighbours(df, 4, other_parts=other_parts, blended=blended, least=least).collect():
        got.setdefault(r.idx, {})[r["rank"]] = (r.other_idx, r.score)
    expected = naive(rows, 4, other_parts, blended, least)
    assert got.keys() == expected.keys()
    for i, x in expected.items():
        mine = [got[i][r] for r in sorted(got[i])]
        assert np.allclose([s for _, s in mine], [s for _, s in x], atol=1e-6)
        assert [j for j, _ in mine] == [j for j, _ in x] or len({round(s, 6) for _, s in x}) < len(x) or abs(mine[-1][1] - x[-1][1]) < 1e-6


def test_little_is_scored_where_vectors_have_clusters(spark, monkeypatch):
    monkeypatch.setattr(N, "EACH", 16)
    rows = [(i, int(i % 50), v) for i, _, v in clustered(4000, 120)]
    df = spark.createDataFrame(rows, SCHEMA)
    everything = N.scored(df, 3, other_parts=True, blended=True, least=Fed.CLOSE).first()
    assert everything.rows == 4000 and everything.share < 0.2  # the cluster of a third is a ninth of all pairs
    few = N.scored(df.filter("idx >= 1400"), 3, other_parts=True, blended=True, least=Fed.CLOSE).first()
    assert few.share < 0.1


def test_blocks_that_need_nothing_of_each_other_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(N, "ROWS", 40)
    monkeypatch.setattr(N, "EACH", 16)
    p = N._plan(*N._rows(spark.createDataFrame(clustered(2000, 60), SCHEMA)), N.Metric(3, True, True, Fed.CLOSE))
    blocks = {b for c in p.known.values() for k, n in zip(c.block.tolist(), c.subs.tolist(), strict=True) for b in range(k, k + n)}
    met = p.rows.mapInArrow(N._needs(p.known, N.Metric(3, True, True, Fed.CLOSE)), N.ASKS).select("own", "block").distinct().count()
    assert len(blocks) > 8 and met < 0.5 * len(blocks) ** 2


def test_no_usable_vectors(spark):
    rows = [(1, 1, None), (2, 1, []), (3, 1, [float("nan")]), (None, 1, [1.0]), (4, None, [2.0]), (5, 1, [2.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.idx, r.other_idx) for r in N.neighbours(df, 3).collect()} == {(4, 5), (5, 4)}
    assert N.neighbours(df.filter("false"), 3).count() == 0 and N.scored(df.filter("false"), 3).first().scored == 0
