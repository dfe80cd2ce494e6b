"""Exact top-k inner products by a vector-approximation file.

Vectors are turned to integers and written in blocks as Parquet, each with a column of cells,
a byte per component (widths are powers of two, so bounds are exact integers), and a column of
exact vectors. Queries are taken in slabs of SLAB bytes at most; a slab is what is sent to
every block. The first pass reads the cells alone and bounds every score from below, which
gives each query a score that its k-th best surely reaches, and with a second look at the
cells names the blocks where an upper bound reaches it. Of these blocks the last pass decodes
the exact vectors whose bounds reach it, highest bound first, until the k-th exact score is
above every bound left.

Vectors that are null, or hold null or non-finite components, take no part; nor do they for
queries of another length. Ties go to the smaller id. Fewer than k candidates: all of them.
Rows that repeat an id: as candidates each counts, as queries those of one length are one, the
row that is least by its components; none of them is a candidate of their own query. Integer
products are exact in double precision below 2^53; blocks that could exceed it use Python
integers, and scores beyond 64 bits are clipped. Empty tables give no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, drop_folder, id_filter, map_arrow, maybe_in, shared_folder

#: Bytes of the queries of a slab, vectors of a block, cells of a component.
SLAB, BLOCK, CELLS = 8 << 20, 4096, 256
EXACT = 2**53
FOUND = "dim int, query_id long, vec_id long, score long"
INDEX = "dim int, ids binary, low binary, width binary, cells binary, vectors binary"


def whole_numbers(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, floor(1024 x)) of the batch's usable vectors, by length of the vector."""
    ids, vectors = batch.column(0), batch.column(1)
    size = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, np.int32)
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components are NaN
    start = vectors.offsets.to_numpy()[:-1]
    known = np.asarray(vectors.is_valid()) & np.asarray(ids.is_valid())
    out = []
    for d in np.unique(size[known]):
        rows = np.flatnonzero(known & (size == d))
        v = flat[start[rows][:, None] + np.arange(d)[None, :]] if d else np.zeros((len(rows), 0))
        ok = np.isfinite(v).all(1)
        if ok.any():
            out.append((ids.to_numpy(zero_copy_only=False)[rows[ok]].astype(np.int64), np.floor(1024 * v[ok])))
    return out


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, v in whole_numbers(b):
            for at in range(0, len(ids), BLOCK):
                x = v[at : at + BLOCK]
                low = x.min(0, initial=np.inf)
                span = x.max(0, initial=-np.inf) - low
                width = np.exp2(np.ceil(np.log2(np.maximum(span + 1, CELLS) / CELLS)))
                cells = np.minimum((x - low) // width, CELLS - 1).astype(np.uint8)
                yield pa.RecordBatch.from_pylist([{"dim": x.shape[1], "ids": ids[at : at + BLOCK].tobytes(), "low": low.tobytes(), "width": width.tobytes(), "cells": cells.tobytes(), "vectors": x.tobytes()}], pa.schema([("dim", pa.int32()), *((c, pa.binary()) for c in ("ids", "low", "width", "cells", "vectors"))]))


class _Block:
    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        n, d = len(self.ids), row["dim"]
        self.low, self.width = np.frombuffer(row["low"]), np.frombuffer(row["width"])
        self.cells = np.frombuffer(row["cells"], np.uint8).reshape(n, d)
        self.raw, self.shape = row.get("vectors"), (n, d)

    @property
    def vectors(self) -> np.ndarray:
        return np.frombuffer(self.raw.as_buffer()).reshape(self.shape)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores, a row a query: from below, from above."""
        under = self.low + self.cells * self.width
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        rest = self.width - 1  # a cell's largest whole number is its least plus this
        base = q @ under.T
        return base + (down @ rest)[:, None], base + (up @ rest)[:, None]

    def safe(self, q: np.ndarray) -> bool:
        top = np.maximum(np.abs(self.low), np.abs(self.low + self.width * CELLS))
        return bool((np.abs(q) @ top).max(initial=0.0) < EXACT)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The batch's rows; exact vectors stay where they are until they are asked for."""
    held = batch.column("vectors") if "vectors" in batch.schema.names else None
    rest = batch.select([c for c in batch.schema.names if c != "vectors"]).to_pylist()
    for i, row in enumerate(rest):
        yield row | ({"vectors": held[i]} if held is not None else {})


Slab = dict[int, tuple[np.ndarray, np.ndarray]]


def _floor(slab: Slab, k: int):
    """First pass: for each query the k-th best lower bound of the task's vectors, if it has k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: np.full((len(ids), k), -np.inf) for d, (ids, _) in slab.items()}
        for b in batches:
            for row in _rows(b):
                if row["dim"] not in slab:
                    continue
                block, (ids, q) = _Block(row), slab[row["dim"]]
                if not block.safe(q):
                    continue  # no bound: every vector of the block is read exactly
                for at in range(0, len(ids), 512):
                    low = block.bounds(q[at : at + 512])[0]
                    low[ids[at : at + 512, None] == block.ids[None, :]] = -np.inf
                    both = np.concatenate([best[row["dim"]][at : at + 512], low], 1)
                    best[row["dim"]][at : at + 512] = -np.partition(-both, k - 1, 1)[:, :k]
        for d, (ids, _) in slab.items():
            found = best[d].min(1)
            ok = np.isfinite(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(ok.sum(), d, np.int32)), pa.array(ids[ok]), pa.array(found[ok])], names=["dim", "query_id", "bound"])

    return run


def _floors(slab: Slab, least: dict[tuple[int, int], float]) -> dict[int, np.ndarray]:
    return {d: np.array([least.get((d, i), -np.inf) for i in ids.tolist()]) for d, (ids, _) in slab.items()}


def _needed(slab: Slab, least: dict[tuple[int, int], float]):
    """The blocks with an upper bound that reaches a query's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = _floors(slab, least)
        for b in batches:
            out = []
            for row in _rows(b):
                if row["dim"] not in slab:
                    continue
                block, q = _Block(row), slab[row["dim"]][1]
                floor = floors[row["dim"]]
                if not block.safe(q) or any((block.bounds(q[at : at + 512])[1] >= floor[at : at + 512, None]).any() for at in range(0, len(q), 512)):
                    out.append(row["block"])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["block"])

    return run


def _exact(q: np.ndarray, v: np.ndarray, safe: bool) -> np.ndarray:
    if safe:
        return v @ q
    whole = [sum(int(a) * int(b) for a, b in zip(x, q, strict=True)) for x in v]
    return np.array([max(min(x, 2**63 - 1), -(2**63)) for x in whole], object)


def _read(slab: Slab, least: dict[tuple[int, int], float], k: int):
    """Last pass: the k best of the task's vectors for each query, read in order of their bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list[tuple[int, int]]] = {}  # (dim, query): (-score, id), in order
        floors = _floors(slab, least)
        for b in batches:
            for row in _rows(b):
                d = row["dim"]
                if d not in slab:
                    continue
                block, (ids, q) = _Block(row), slab[d]
                safe, vectors = block.safe(q), None
                for at in range(0, len(ids), 512):
                    part, floor = q[at : at + 512], floors[d][at : at + 512]
                    high = block.bounds(part)[1] if safe else np.full((len(part), len(block.ids)), np.inf)
                    for i in np.flatnonzero((high >= floor[:, None]).any(1)).tolist():
                        query = int(ids[at + i])
                        held = best.setdefault((d, query), [])
                        least_here = max(floor[i], -held[k - 1][0] if len(held) == k else -np.inf)
                        near = np.flatnonzero((high[i] >= least_here) & (block.ids != query))
                        near = near[np.argsort(-high[i][near], kind="stable")]
                        done = 0
                        while done < len(near):
                            if len(held) == k and high[i][near[done]] < -held[k - 1][0]:
                                break  # no bound left reaches the k-th score
                            take = near[done : done + max(64, done)]
                            done += len(take)
                            vectors = block.vectors if vectors is None else vectors
                            score = _exact(part[i], vectors[take], safe)
                            held = sorted([*held, *((-int(s), x) for s, x in zip(score.tolist(), block.ids[take].tolist(), strict=True))])[:k]
                        best[d, query] = held
        rows = [(d, query, x, -s) for (d, query), held in best.items() for s, x in held]
        columns = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.int64()] * 3), strict=True)], names=["dim", "query_id", "vec_id", "score"])

    return run


def _slab(rows: DataFrame) -> Slab:
    """The queries of a slab (SLAB bytes at most) by their length; rows of one id and length are one."""
    out: Slab = {}
    for ids, q in whole_numbers(pa.RecordBatch.from_struct_array(rows.toArrow().combine_chunks().to_struct_array().combine_chunks())):
        order = np.lexsort((*q.T[::-1], ids))
        first = order[np.unique(ids[order], return_index=True)[1]]
        out[q.shape[1]] = (ids[first], q[first])
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k best for every row for which is_query holds."""
    spark = vectors.sparkSession
    narrow = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    at = f"{shared_folder(spark).rstrip('/')}/vectors-{uuid.uuid4()}"
    map_arrow(narrow, _index, INDEX).withColumn("block", F.monotonically_increasing_id()).write.parquet(f"{at}/index")
    index = spark.read.parquet(f"{at}/index")
    cells = index.drop("vectors")
    asked = narrow.filter(is_query & F.col("embedding").isNotNull())
    size = asked.agg(F.coalesce(F.sum(8 * F.size("embedding").cast("long") + 8), F.lit(0)).alias("x")).first().x
    slabs = max(1, -(-2 * size // SLAB) if size > SLAB else 1)
    for s in range(slabs):
        slab = _slab(asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(slabs)) == s))
        bounds = map_arrow(cells, _floor(slab, k), "dim int, query_id long, bound double").groupBy("dim", "query_id").agg(F.max("bound").alias("bound"))
        least = {(r.dim, r.query_id): r.bound for r in bounds.collect()}
        needed = id_filter(map_arrow(cells, _needed(slab, least), "block long"))  # a bitmap: no block more than once in a task
        found = map_arrow(maybe_in(index, "block", needed).filter("_maybe").drop("_maybe"), _read(slab, least, k), FOUND)
        found.write.mode("append").parquet(f"{at}/found")  # so the driver and the plan hold one slab
    out = spark.read.schema(FOUND).parquet(f"{at}/found")
    order = Window.partitionBy("query_id", "dim").orderBy(F.col("score").desc(), "vec_id")
    ranked = checkpointed(out.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    drop_folder(spark, at)
    return ranked
