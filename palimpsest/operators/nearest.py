"""Exact nearest neighbours of every row, pruned by clusters of vectors and of sign codes.

Rows are dealt to clusters around pivots, a sample of bounded size. Angles obey the triangle
inequality, and so do numbers of differing signs; how far a row is from a pivot, and how far the
pivot's cluster reaches, bound the cosine and the sign similarity of the row with every member of
the cluster. A row's k-th best score among the pivots and in its own cluster is a floor that its
neighbours surely reach; clusters whose bound stays below it are not looked at.

Clusters that lie side by side make blocks of about ROWS rows, or of a SHARE-th of more, MOST at
most. The rows of one block that need one of another's clusters meet that block in one task, and
there only the clusters that each needs; pairs of blocks of which no row needs the other do not
meet. Where vectors have no clusters every block meets every other, and a row is sent once a
block: SHARE times or so, until blocks have MOST rows.

Rows that meet are scored in single precision, a strip of them at a time; what may be among the
k best by more than its rounding is scored again in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.runtime import checkpointed, ship
from ..functions.vector import COSINE_SHARE, EPSILON, SIGN_SHARE

#: Rows of a block; rows a pivot; pivots, and bytes of them, at most.
ROWS, EACH, PIVOTS, PIVOT_BYTES = 8192, 256, 4096, 8 << 20
#: Of many rows a block has this share, and so many at most.
SHARE, MOST = 16, 1 << 16
#: Rows that are scored at once against as many others, and pairs that are scored again at once.
CHUNK, STRIP, PAIRS = 1024, 4096, 1 << 17
#: Rounding of angles and scores that no bound may fall short by.
SLACK = 1e-6
PLACED = "dim int, cluster int, sub int, idx long, part long, vector binary, floor double"
FOUND = "idx long, part long, other_idx long, other_part long, score double"


@dataclass(frozen=True)
class Metric:
    """k best by cosine or blended score, of other parts or of all rows but the row itself, from least on."""

    k: int
    other_parts: bool = False
    blended: bool = False
    least: float = -np.inf

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        unit = lambda m: m / (np.linalg.norm(m, axis=1) + EPSILON)[:, None]
        s = unit(a) @ unit(b).T
        return COSINE_SHARE * s + SIGN_SHARE * (1 - _differing(a, b) / a.shape[1]) if self.blended else s

    def features(self, m: np.ndarray) -> np.ndarray:
        """Rows in single precision whose inner products are scores, less the constant()."""
        unit = m / (np.linalg.norm(m, axis=1) + EPSILON)[:, None]
        if self.blended:
            unit = np.hstack([COSINE_SHARE**0.5 * unit, (SIGN_SHARE / 2 / m.shape[1]) ** 0.5 * np.where(m > 0, 1.0, -1.0)])
        return unit.astype(np.float32)

    def constant(self) -> float:
        return SIGN_SHARE / 2 if self.blended else 0.0

    def paired(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The score of each row of a with the row of b beside it, the same both ways."""
        norms = [np.sqrt(np.einsum("ij,ij->i", m, m)) + EPSILON for m in (a, b)]
        s = np.einsum("ij,ij->i", a, b) / (norms[0] * norms[1])
        return COSINE_SHARE * s + SIGN_SHARE * (1 - ((a > 0) != (b > 0)).sum(1) / a.shape[1]) if self.blended else s

    def allowed(self, idx: np.ndarray, part: np.ndarray, other_idx: np.ndarray, other_part: np.ndarray) -> np.ndarray:
        return part[:, None] != other_part[None, :] if self.other_parts else idx[:, None] != other_idx[None, :]


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    signs = [np.where(m > 0, 1.0, -1.0) for m in (a, b)]
    return (a.shape[1] - signs[0] @ signs[1].T) / 2


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(Metric(1).scores(a, b), -1, 1))


@dataclass
class Clusters:
    """Pivots of one length of vectors, and once they are known: how far each cluster reaches, how many rows it has, and its first block and number of blocks."""

    idx: np.ndarray
    part: np.ndarray
    vectors: np.ndarray
    near: np.ndarray | None = None
    far: np.ndarray | None = None
    signs: np.ndarray | None = None
    rows: np.ndarray | None = None
    block: np.ndarray | None = None
    subs: np.ndarray | None = None

    def only(self, names: np.ndarray) -> Clusters:
        return replace(self, **{f: getattr(self, f)[names] for f in ("idx", "part", "vectors", "near", "far", "signs", "rows")})

    def bounds(self, m: np.ndarray, metric: Metric) -> np.ndarray:
        """No member of a cluster scores higher with a row than this; -inf where there is none."""
        angle = _angles(m, self.vectors)
        s = np.cos(np.clip(np.maximum(angle - self.far, self.near - angle), 0, np.pi))
        if metric.blended:
            differing = np.maximum(_differing(m, self.vectors) - self.signs, 0)
            s = COSINE_SHARE * s + SIGN_SHARE * (1 - differing / m.shape[1])
        return np.where(self.rows > 0, s + SLACK, -np.inf)


Known = dict[int, Clusters]


def _matrix(raw, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), np.float32).reshape(-1, dim).astype(np.float64)


def _longs(t, *names: str) -> list[np.ndarray]:
    return [t.column(c).to_numpy(zero_copy_only=False).astype(np.int64) if isinstance(t, pa.RecordBatch) else t.column(c).to_numpy().astype(np.int64) for c in names]


def _usable(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(idx, part, vectors) of a batch's rows for each length of their vectors."""
    v = b.column("embedding")
    offsets, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False).astype(np.float32)
    size = np.diff(offsets) * np.asarray(v.is_valid())
    idx, part = _longs(b, "idx", "part")
    for d in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == d)
        m = flat[offsets[at][:, None] + np.arange(d)]
        ok = np.isfinite(m).all(1)
        if ok.any():
            yield idx[at[ok]], part[at[ok]], m[ok]


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f[1]]) for c, f in zip(columns, fields, strict=True)], names=[f[0] for f in fields])


def _kth(s: np.ndarray, k: int) -> np.ndarray:
    """The k-th best of each row, or -inf."""
    return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] >= k else np.full(len(s), -np.inf)


def _placed(known: Known, metric: Metric) -> Callable:
    """Each row's cluster, and its floor among the pivots; signs and angle to the cluster's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for idx, part, m in _usable(b):
                c = known.get(m.shape[1])
                for at in range(0, len(idx), 1024):
                    i, p, v = idx[at : at + 1024], part[at : at + 1024], m[at : at + 1024].astype(np.float64)
                    n = len(i)
                    if c is None:
                        nearest, floor, angle, signs = np.zeros(n, int), np.full(n, metric.least), np.zeros(n), np.zeros(n)
                    else:
                        angles = _angles(v, c.vectors)
                        nearest = angles.argmin(1)
                        s = np.where(metric.allowed(i, p, c.idx, c.part), metric.scores(v, c.vectors), -np.inf)
                        floor = np.maximum(_kth(s, metric.k) - SLACK, metric.least)
                        angle, signs = angles[np.arange(n), nearest], ((v > 0) != (c.vectors[nearest] > 0)).sum(1)
                    yield _batch(PLACED + ", angle double, signs double", np.full(n, m.shape[1]), nearest, np.zeros(n, int), i, p, [x.tobytes() for x in m[at : at + 1024]], floor, angle, signs)

    return run


def _floored(metric: Metric) -> Callable:
    """A part of a cluster with each row's floor raised to its k-th best there."""

    def run(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        (idx, part), m = _longs(t, "idx", "part"), _matrix(t.column("vector"), dim)
        floor = t.column("floor").to_numpy().copy()
        for at in range(0, len(idx), 1024):
            own = slice(at, at + 1024)
            s = np.where(metric.allowed(idx[own], part[own], idx, part), metric.scores(m[own], m), -np.inf)
            floor[own] = np.maximum(floor[own], _kth(s, metric.k) - SLACK)
        return t.drop_columns(["floor"]).append_column("floor", pa.array(floor))

    return run


def _needs(known: Known, metric: Metric) -> Callable:
    """(dim, own, block, idx, part, vector, floor) of each row for every block that it needs; ASKS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, cluster, sub = _longs(b, "dim", "cluster", "sub")
            for d in np.unique(dims).tolist():
                rows = b.take(pa.array(np.flatnonzero(dims == d)))
                c, floor = known[d], rows.column("floor").to_numpy()
                needed = c.bounds(_matrix(rows.column("vector"), d), metric) >= floor[:, None]
                own = c.block[cluster[dims == d]] + sub[dims == d]
                spans = np.stack([c.block, c.subs])
                for first, n in np.unique(spans, axis=1).T.tolist():
                    some = np.flatnonzero(needed[:, (c.block == first) & (c.subs == n)].any(1))
                    for block in range(first, first + n) if len(some) else ():
                        t = rows.take(pa.array(some))
                        yield pa.RecordBatch.from_arrays([t.column("dim"), pa.array(own[some]), pa.array(np.full(len(some), block)), *(t.column(x) for x in ("idx", "part", "vector", "floor"))], names=[x.split(" ")[0] for x in ASKS.split(", ")])

    return run


ASKS = "dim int, own long, block long, idx long, part long, vector binary, floor double"


def _counted(known: Known, metric: Metric) -> Callable:
    """A task's number of pairs that are scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            (dims,) = _longs(b, "dim")
            for d in np.unique(dims).tolist():
                rows = b.take(pa.array(np.flatnonzero(dims == d)))
                n += int(((known[d].bounds(_matrix(rows.column("vector"), d), metric) >= rows.column("floor").to_numpy()[:, None]) * known[d].rows).sum())
        yield _batch("n long", [n])

    return run


@dataclass
class _Rows:
    idx: np.ndarray
    part: np.ndarray
    vectors: np.ndarray

    def at(self, which) -> _Rows:
        return _Rows(self.idx[which], self.part[which], self.vectors[which])


@dataclass
class _Held:
    """The k best so far of each of some rows: places among the rows and the others, and scores."""

    metric: Metric
    rows: _Rows
    others: _Rows
    floor: np.ndarray

    def __post_init__(self) -> None:
        self.found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        self.more: list[list[np.ndarray]] = []
        self.n = 0

    def add(self, r: np.ndarray, c: np.ndarray) -> None:
        """Pairs that may be among the best."""
        ok = self.rows.part[r] != self.others.part[c] if self.metric.other_parts else self.rows.idx[r] != self.others.idx[c]
        r, c = r[ok], c[ok]
        for at in range(0, len(r), PAIRS):
            i, j = r[at : at + PAIRS], c[at : at + PAIRS]
            score = self.metric.paired(self.rows.vectors[i], self.others.vectors[j])
            ok = score >= self.floor[i]
            self.more.append([i[ok], j[ok], score[ok]])
            self.n += int(ok.sum())
            if self.n > max(PAIRS, 4 * self.metric.k * len(self.floor)):
                self.settle()

    def settle(self) -> None:
        r, c, score = (np.concatenate(x) for x in zip(self.found, *self.more, strict=True))
        order = np.lexsort((self.others.idx[c], self.others.part[c], -score, r))
        r, c, score = r[order], c[order], score[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        last = place == self.metric.k - 1
        self.floor[r[last]] = np.maximum(self.floor[r[last]], score[last])
        keep = place < self.metric.k
        self.found, self.more, self.n = [r[keep], c[keep], score[keep]], [], 0


def _strip(held: _Held, some: np.ndarray, a: int, z: int, own: np.ndarray, other: np.ndarray) -> None:
    """Scores the rows `some` with the others from a to z and holds what may be among the best."""
    metric = held.metric
    slack = (own.shape[1] + 16) * 1.2e-7  # rounding of single precision
    s = own[some] @ other[a:z].T
    hit = s >= (held.floor[some] - metric.constant() - slack).astype(np.float32)[:, None]
    if np.count_nonzero(hit) > 8 * metric.k * len(some) and z - a > metric.k:  # the floor is low: the strip's own k-th best raises it
        s[~metric.allowed(held.rows.idx[some], held.rows.part[some], held.others.idx[a:z], held.others.part[a:z])] = -np.inf
        edge = _kth(s, metric.k)
        held.floor[some] = np.maximum(held.floor[some], edge.astype(np.float64) + metric.constant() - slack)
        hit = s >= np.maximum(edge - np.float32(2 * slack), (held.floor[some] - metric.constant() - slack).astype(np.float32))[:, None]
    at = np.flatnonzero(hit)
    held.add(some[at // (z - a)], a + at % (z - a))


def _best(known: Known, metric: Metric) -> Callable:
    """The k best of one block for each row of another that needs it."""

    def run(t: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)] + [[np.zeros(0)]]
        asking, asked = (t.filter(pa.compute.equal(t.column("side"), s)) for s in (0, 1))
        if asking.num_rows and asked.num_rows:
            dim = t.column("dim")[0].as_py()
            rows, floor = _Rows(*_longs(asking, "idx", "part"), _matrix(asking.column("vector"), dim)), asking.column("floor").to_numpy()
            other_idx, other_part, cluster = _longs(asked, "idx", "part", "cluster")
            order = np.lexsort((other_idx, other_part, cluster))
            others, cluster = _Rows(other_idx, other_part, _matrix(asked.column("vector"), dim)).at(order), cluster[order]
            features = metric.features(others.vectors)
            names, begin = np.unique(cluster, return_index=True)
            end = np.append(begin[1:], len(cluster))
            c = known[dim].only(names) if dim in known else None
            for at in range(0, len(rows.idx), CHUNK):
                own = rows.at(slice(at, at + CHUNK))
                held, mine = _Held(metric, own, others, floor[at : at + CHUNK].copy()), metric.features(own.vectors)
                needed = c.bounds(own.vectors, metric) >= held.floor[:, None] if c is not None else np.ones((len(own.idx), len(names)), bool)
                for a in range(0, len(cluster), STRIP):
                    z = min(a + STRIP, len(cluster))
                    here = np.flatnonzero((begin < z) & (end > a))
                    sizes = np.minimum(end[here], z) - np.maximum(begin[here], a)
                    if (needed[:, here] @ sizes).sum() > len(own.idx) * (z - a) / 4:
                        _strip(held, np.flatnonzero(needed[:, here].any(1)), a, z, mine, features)
                        continue
                    for k in here.tolist():
                        some = np.flatnonzero(needed[:, k])
                        if len(some):
                            _strip(held, some, max(int(begin[k]), a), min(int(end[k]), z), mine, features)
                held.settle()
                r, o, score = held.found
                for x, y in zip(out, (own.idx[r], own.part[r], others.idx[o], others.part[o], score), strict=True):
                    x.append(y)
        return pa.table({f.split(" ")[0]: np.concatenate(x) for f, x in zip(FOUND.split(", "), out, strict=True)})

    return run


def _chain(v: np.ndarray) -> np.ndarray:
    """The pivots in an order in which each follows the one that it is nearest to of those left."""
    left, order, at = np.ones(len(v), bool), [], 0
    unit = v / (np.linalg.norm(v, axis=1) + EPSILON)[:, None]
    for _ in range(len(v)):
        order.append(at)
        left[at] = False
        at = int(np.where(left, unit @ unit[at], -np.inf).argmax())
    return np.array(order)


@dataclass
class _Plan:
    known: Known
    rows: DataFrame  # PLACED
    total: int


def _rows(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """The rows with vectors, their number, and the longest vector's length."""
    ship(vectors.sparkSession)
    v = vectors.select(F.col("idx").cast("long"), F.col("part").cast("long"), F.col("embedding").cast("array<float>"))
    v = v.filter("idx is not null and size(embedding) > 0").withColumn("part", F.coalesce("part", F.lit(-1).cast("long")))
    return v, *v.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()


def _plan(v: DataFrame, total: int, widest: int, metric: Metric) -> _Plan:
    spark = v.sparkSession
    most = min(PIVOTS, PIVOT_BYTES // (8 * widest) or 1, max(1, -(-total // EACH)))
    sample = v.orderBy(F.xxhash64("idx", "part")).limit(most).toArrow().combine_chunks()
    known: Known = {}
    for b in sample.to_batches():
        for idx, part, m in _usable(b):
            known[m.shape[1]] = Clusters(idx, part, m.astype(np.float64))
    placed = checkpointed(v.mapInArrow(_placed(known, metric), PLACED + ", angle double, signs double"))
    reach = placed.groupBy("dim", "cluster").agg(F.min("angle"), F.max("angle"), F.max("signs"), F.count("*")).collect()  # PIVOTS rows, and one a length without
    for d in {r.dim for r in reach} - set(known):
        known[d] = Clusters(np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones((1, d)))
        known[d].near, known[d].far, known[d].signs = np.zeros(1), np.full(1, np.pi), np.full(1, float(d))
    subs = []
    for d, c in known.items():
        n = len(c.idx)
        if c.near is None:
            c.near, c.far, c.signs = np.zeros(n), np.zeros(n), np.zeros(n)
        c.rows = np.zeros(n, np.int64)
        for _, k, low, high, signs, count in (r for r in reach if r.dim == d):
            c.rows[k] = count
            if c.far[k] < np.pi:
                c.near[k], c.far[k], c.signs[k] = low, high, signs
        c.block, c.subs = np.zeros(n, np.int64), np.maximum(1, -(-c.rows // ROWS))
        block, held, full = 0, 0, max(ROWS, min(MOST, total // SHARE))
        for k in _chain(c.vectors).tolist():
            if held and held + c.rows[k] > full:
                block, held = block + 1, 0
            c.block[k] = block
            held += int(c.rows[k])
            if c.subs[k] > 1:
                block, held = block + int(c.subs[k]), 0
        subs += [(d, k, int(s)) for k, s in enumerate(c.subs.tolist()) if s > 1]
    rows = placed.drop("angle", "signs")
    if subs:
        many = spark.createDataFrame(subs, "dim int, cluster int, n int")  # PIVOTS rows at most
        rows = rows.join(F.broadcast(many), ["dim", "cluster"], "left").withColumn("sub", F.coalesce(F.pmod(F.xxhash64("idx", "part"), F.col("n")), F.lit(0)).cast("int"))
    rows = rows.select(*(x.split(" ")[0] for x in PLACED.split(", ")))
    return _Plan(known, checkpointed(rows.groupBy("dim", "cluster", "sub").applyInArrow(_floored(metric), PLACED)), total)


def neighbours(vectors: DataFrame, k: int, *, other_parts: bool = False, blended: bool = False, least: float = -np.inf) -> DataFrame:
    """idx, part, other_idx, other_part, score, rank: each row's k nearest, by cosine or blended score.

    vectors: idx, part (a collection's number), embedding. other_parts looks only outside of a
    row's own part; otherwise only the row itself is left out. Scores below least are left out.
    Ties go to the smaller part and idx. Rows meet rows of their own length; vectors that are
    null, empty or hold no number take no part, nor do rows without an idx.
    """
    metric = Metric(k, other_parts, blended, least)
    v, total, widest = _rows(vectors)
    order = Window.partitionBy("idx", "part").orderBy(F.col("score").desc(), "other_part", "other_idx")
    if total <= ROWS:  # one block has them all
        placed = v.mapInArrow(_placed({}, metric), PLACED + ", angle double, signs double")
        both = placed.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        found = both.groupBy("dim").applyInArrow(_best({}, metric), FOUND)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    p = _plan(v, total, widest, metric)
    asks = p.rows.mapInArrow(_needs(p.known, metric), ASKS)
    met = checkpointed(asks.select("dim", "own", "block").distinct())
    blocks = [(d, i, int(x)) for d, c in p.known.items() for i, x in enumerate(c.block.tolist())]
    at = vectors.sparkSession.createDataFrame(blocks, "dim int, cluster int, first long")  # PIVOTS rows at most
    asked = p.rows.join(F.broadcast(at), ["dim", "cluster"]).withColumn("block", F.col("first") + F.col("sub"))
    asked = asked.join(met, ["dim", "block"]).select("dim", "own", "block", "idx", "part", "vector", "floor", "cluster", F.lit(1).alias("side"))
    both = asks.withColumn("cluster", F.lit(0)).withColumn("side", F.lit(0)).unionByName(asked)
    found = both.groupBy("dim", "own", "block").applyInArrow(_best(p.known, metric), FOUND)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def scored(vectors: DataFrame, k: int, *, other_parts: bool = False, blended: bool = False, least: float = -np.inf) -> DataFrame:
    """One row: rows, scored (pairs that neighbours() scores to answer), share of the pairs that there are."""
    metric = Metric(k, other_parts, blended, least)
    p = _plan(*_rows(vectors), metric)
    n = p.rows.mapInArrow(_counted(p.known, metric), "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scored"))
    share = F.col("scored") / F.greatest(F.lit(p.total) * F.lit(p.total), F.lit(1))
    return n.select(F.lit(p.total).alias("rows"), "scored", share.alias("share"))
