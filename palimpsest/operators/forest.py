"""Connected components of links: forests a task, contracted between rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import checkpointed, ship


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) for every node of the edges that is not the smallest of its component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        x, y = label[u], label[v]
        open_ = x != y
        if not open_.any():
            break
        np.minimum.at(label, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (label[label] != label).any():
            label = label[label]
    below = label != np.arange(len(ids))
    return ids[label[below]], ids[below]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars: as many rows as it has nodes at most."""
    held = np.zeros((2, 0), np.int64)
    for b in batches:
        held = np.stack(forest(*(np.concatenate(x) for x in zip(held, (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b")), strict=True))))
    yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["a", "b"])


#: Edges that one task joins at the end: half a megabyte.
FEW = 1 << 15


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every node of the edges (a, b).

    Each task turns its edges to stars, every node takes its smallest root, and edges are
    contracted to the roots of these pointers. Each round at least halves the nodes that
    still have edges, so rounds grow with the logarithm of the nodes; FEW edges that are left
    take no more rounds. edges are read twice, so they should have been written before.
    """
    ship(edges.sparkSession)
    labels = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id"))
    edges = edges.select("a", "b")
    while True:
        stars = checkpointed(edges.filter("a <> b").mapInArrow(_forests, "a long, b long"))
        left = stars.count()
        if left <= FEW:
            to = stars.coalesce(1).mapInArrow(_forests, "a long, b long").select(F.col("b").alias("component"), F.col("a").alias("root"))
            return checkpointed(labels.join(to, "component", "left").select("id", F.coalesce("root", "component").alias("component"))) if left else labels
        up = checkpointed(stars.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        while True:  # pointers double until all end in roots
            above = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            step = checkpointed(up.join(above, "root", "left"))
            up = step.select("node", F.coalesce("top", "root").alias("root"))
            if step.filter("top is not null").isEmpty():
                break
        low, high = (up.select(F.col("node").alias(c), F.col("root").alias("_" + c)) for c in ("a", "b"))
        # A star that became one pointer, and whose root has none, is done.
        edges = stars.join(high, "b").filter("_b <> a").join(low, "a", "left")
        edges = checkpointed(edges.select(F.coalesce("_a", "a").alias("a"), F.col("_b").alias("b")).filter("a <> b").distinct())
        to = up.select(F.col("node").alias("component"), "root")
        labels = checkpointed(labels.join(to, "component", "left").select("id", F.coalesce("root", "component").alias("component")))
