"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A document descends from region to rack to shard. At each node it draws a straw for every
child, -ln(u) / weight with u hashed from its key and the child's name, and follows the
shortest. A child's straw depends on nothing but its own name and weight, so a change of
weights moves rows only into or out of the subtrees whose weights change.

Nulls: a row without an id is placed by its text's digest; a null text has no bytes. Empty
tables give no rows; rows that repeat share a shard and get slots of their own. Texts of any
length only count by their bytes. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DRAWS, buckets_for, checkpointed, draw, key_of, running


@dataclass(frozen=True)
class Node:
    """A shard (number) or a node with children; a node weighs what its children do."""

    name: str
    weight: float = 1.0
    number: int | None = None
    children: tuple[Node, ...] = ()

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight


def tree(regions: Sequence[Sequence[Sequence[float]]]) -> Node:
    """A tree from the shards' weights, nested by region and rack; shards are numbered in order."""
    shard, rack, tops = 0, 0, []
    for i, racks in enumerate(regions):
        mid = []
        for weights in racks:
            leaves = []
            for w in weights:
                leaves.append(Node(f"shard{shard}", float(w), shard))
                shard += 1
            mid.append(Node(f"rack{rack}", children=tuple(leaves)))
            rack += 1
        tops.append(Node(f"region{i}", children=tuple(mid)))
    return Node("root", children=tuple(tops))


#: Eight equal shards: two regions of two racks of two.
EIGHT = [[[1, 1], [1, 1]], [[1, 1], [1, 1]]]
#: One more shard comes as a region of its own, so that rows move into nothing but it.
NINE = [*EIGHT, [[1]]]


def shard_of(key: Column, node: Node) -> Column:
    """The number of the shard that key (a string column) descends to."""
    if not node.children:
        return F.lit(node.number)
    if len(node.children) == 1:
        return shard_of(key, node.children[0])
    straws = [F.struct((-F.log((draw(key, c.name) + 1) / F.lit(float(DRAWS))) / F.lit(c.total)).alias("straw"), F.lit(i).alias("at")) for i, c in enumerate(node.children)]
    at = F.array_min(F.array(*straws))["at"]
    out = None
    for i, c in enumerate(node.children[:-1]):
        out = F.when(at == i, shard_of(key, c)) if out is None else out.when(at == i, shard_of(key, c))
    return out.otherwise(shard_of(key, node.children[-1]))


def assign(docs: DataFrame, now: Node, grown: Node) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard, slot for every row of docs.

    slot numbers the rows of a shard from 0 in the order of a hash, by buckets of it, so that
    no task holds a shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = key_of(F.col("doc_id"), F.col("text"))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("_k"))
    rows = rows.select("doc_id", "size", "text_crc32", shard_of(F.col("_k"), now).alias("shard"), shard_of(F.col("_k"), grown).alias("grown_shard"), draw(F.col("_k"), "slot").alias("h"))
    rows = checkpointed(rows)
    rows = running(rows, "shard", "h", ["doc_id", "text_crc32", "size"], F.lit(1).cast("long"), buckets_for(rows.count()), "_n")
    return rows.select("doc_id", "size", "text_crc32", "shard", "grown_shard", (F.col("_n") - 1).alias("slot"))
