"""Exact Jaccard join of word n-gram sets by universe partition and the pigeonhole principle.

Two sets with 100 * intersection >= percent * union differ in at most H shingles, a number that
their sizes give. Sizes are cut into bands; a set takes part in the band of its own size and in
those below from which a smaller partner may come. In a band, shingles are hashed into H + 1
segments, the universe's parts. A set's key of a segment is the subset of its shingles there; a
few segments of a band (RESERVE) have the subset's one-deletion neighbourhood as keys besides.
Of two sets that link, some segment has equal subsets; and whoever gives a segment up can take
two units at another whose subsets differ by one shingle at most. So any choice of units, one for
a subset and two for a subset with its neighbourhood, finds all links as soon as it has H + 1.

The choice goes by cost: about how many documents have a key, counted over all of them in SLOTS
hashed counters, in classes; an empty subset is dearest. A set pays as little as it can: it is
found under the keys up to the least cost at which its units are differ + 1. Costs belong to keys,
not to sets, so of two sets that link, the one that pays more has all keys of the other's choice.

Documents of equal sets are one class, and only classes are joined. In a bucket of SMALL documents
each meets each; in larger ones all meet the first, which joins most. Parity bitmaps of the sets
differ in no more bits than the sets in shingles, so they rule candidates out without loss; the
rest are confirmed on their full sets. After that the larger buckets are gone through twice more,
with wider bitmaps, which almost tell links themselves. First a task takes candidates of different
components for links, joins the components and gives out only what it joined; then every two that
are of different components still, and whose sizes and bitmaps allow a link, are candidates. Both
are confirmed as before, so what was joined too soon is looked at again and no link is lost.
Buckets that the counters say have more than GROUP documents are dealt to groups, two of which
meet in one task; comparisons grow with the squares of such buckets, rows do not.

Documents without words link with nothing. Null ids are components of their own with a null
component_id; rows that repeat an id are one node. Empty tables give no rows. Texts are read
whole; sets are held as 64-bit hashes of shingles. Columns but doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.forest import components
from .common import checkpointed, id_filter, look_up, map_arrow, maybe_in, spread
from .near_dedup import Near, _bytes, _candidates, _dealt, _longs, _packed, _parts, _ramp, _runs, _sets, confirm
from .shingles import LEFT, RIGHT, mix, shingle_sets

#: Counters of keys; what a task must count of a slot to say so; the cost of an empty subset.
SLOTS, LEAST, DEAREST = 1 << 20, 4, 15
#: Buckets up to SMALL have each document meet each.
SMALL = 16
#: Documents of one group of a large bucket.
GROUP = 4096
#: One segment of so many has one-deletion neighbourhoods; in bands up to so many segments all have.
RESERVE, FEW = 16, 4
#: Bits of the filter of large buckets' keys; how many times wider bitmaps are in these.
KEYS, WIDE = 1 << 26, 8
ENTRIES = "part int, keys binary, ids binary, sizes binary, many binary, firsts binary, others binary"
FOUND = "a long, b long, id long, code long"
TILES = "part int, cells binary, places binary, sides binary, ids binary, heads binary, sizes binary, bits binary"
PAIRS = "a long, b long"


@dataclass(frozen=True)
class Band:
    """Sets of low..high shingles with partners of up to top; differ is the most that two which link differ in."""

    number: int
    low: int
    high: int
    top: int
    differ: int

    @property
    def segments(self) -> int:
        return self.differ + 1

    @property
    def reserve(self) -> int:
        return self.segments if self.segments <= FEW else -(-self.segments // RESERVE)


@cache
def bands_of(percent: int, n: int) -> tuple[Band, ...]:
    """The bands in which a set of n shingles takes part; sizes at which only equal sets link have none."""
    out, low, number = [], 1, 0
    while low <= n:
        high = max(low, low * 7 // 5)
        top = high * 100 // percent
        differ = (high + top) * (100 - percent) // (100 + percent)
        if n <= top and differ:
            out.append(Band(number, low, high, top, differ))
        low, number = high + 1, number + 1
    return tuple(out)


def _mix(x: int) -> np.ndarray:
    return mix(np.array([x % (1 << 64)], np.uint64))


def keys_of(s: np.ndarray, b: Band) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(exact, near, of, empty): the keys of all segments, of the neighbourhoods, whose segment the latter are, and the keys of empty subsets."""
    segment = ((s >> np.uint64(24)) % np.uint64(b.segments)).astype(np.int64)
    each = mix(s * LEFT + RIGHT)
    order = np.argsort(segment, kind="stable")
    segment, each = segment[order], each[order]
    total = np.concatenate([[np.uint64(0)], np.cumsum(each)])
    edge = np.searchsorted(segment, np.arange(b.segments + 1))
    sums = total[edge[1:]] - total[edge[:-1]]
    name = mix(np.arange(b.segments, dtype=np.uint64) * RIGHT + _mix(b.number + 1))
    of = segment[: edge[b.reserve]]
    return mix(sums + name), mix(sums[of] - each[: len(of)] + name[of]), of, mix(name)


def chosen(s: np.ndarray, b: Band, costs: np.ndarray | None) -> np.ndarray:
    """The keys under which the set is found: those up to the least cost at which they make differ + 1 units."""
    exact, near, of, empty = keys_of(s, b)
    keys = np.concatenate([exact, near])
    if costs is None:
        return keys
    cost = costs[(keys % np.uint64(SLOTS)).astype(np.int64)]
    cost[keys == np.concatenate([empty, empty[of]])] = DEAREST
    one, two = cost[: b.segments], cost[: b.reserve].copy()
    np.maximum.at(two, of, cost[b.segments :])
    units = np.concatenate([one, two])
    return keys[cost <= np.partition(units, b.differ)[b.differ]]


def width(n: np.ndarray | int) -> np.ndarray:
    """Bits of the parity bitmap of a set of n: half of n, to a power of two, 64 at least."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(np.asarray(n) / 2, 1))).astype(np.int64))


def parity(s: np.ndarray, times: int = 1) -> np.ndarray:
    """The bitmap in which each shingle turns one bit; as words."""
    w = int(width(len(s))) * times
    bits = np.bincount((s >> np.uint64(7)).astype(np.int64) % w, minlength=w) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, to: int) -> np.ndarray:
    """A bitmap as one of fewer words: what sets differ in only gets less."""
    return np.bitwise_xor.reduce(words.reshape(-1, to), axis=0)


def most_apart(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray:
    """The shingles in which linked sets of these sizes differ at most."""
    return (np.asarray(a) + b) * (100 - percent) // (100 + percent)


def _digests(near: Near):
    """doc_id, n, same (digest of the set), bits (parity) of each document; at the end the task's slots with LEAST documents or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(SLOTS, np.int32)
        names = ["doc_id", "n", "same", "bits", "slot", "hits"]
        for b in batches:
            n, same, bits, held = [], [], [], []
            for s in shingle_sets(_bytes(b.column("text")), near.words):
                n.append(len(s))
                same.append(np.array([mix(s).sum(), mix(s * RIGHT).sum()]).tobytes() if len(s) else None)
                bits.append(parity(s).tobytes() if len(s) else None)
                held += [chosen(s, band, None) for band in bands_of(near.percent, len(s))]
            if held:
                slots += np.bincount((np.concatenate(held) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (same, bits)), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.int64())], names=names)
        some = np.flatnonzero(slots >= LEAST)
        none = [pa.nulls(len(some), k) for k in (pa.int64(), pa.int64(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(some.astype(np.int32)), pa.array(slots[some].astype(np.int64))], names=names)

    return run


def _costs(counted: DataFrame) -> np.ndarray:
    """The cost class of each slot: 0 up to SMALL documents above what the mean slot has, then one more each time that they double. SLOTS bytes whatever the corpus."""
    sums = counted.groupBy("slot").agg(F.sum("hits").alias("hits")).filter(F.col("hits") > SMALL).toPandas()  # SLOTS rows at most
    hits = np.zeros(SLOTS)
    hits[sums["slot"].to_numpy(np.int64)] = sums["hits"].to_numpy(np.float64)
    over = np.maximum(hits - hits.mean(), 1) / SMALL
    return np.clip(np.ceil(np.log2(np.maximum(over, 1))), 0, DEAREST - 1).astype(np.uint8)


def _groups(cost: np.ndarray) -> np.ndarray:
    """Into how many groups a key of such a cost deals its documents."""
    return np.maximum(1, (SMALL << np.minimum(cost, DEAREST - 1).astype(np.int64)) // GROUP)


def _ordered(key: np.ndarray, ids: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((mix(ids.astype(np.uint64)), key))
    return tuple(x[order] for x in (key, ids, *more))


def _code(key: np.ndarray, parts: int) -> np.ndarray:
    """What is left of a key in its part, with the part."""
    return ((key >> np.uint64(32)) * np.uint64(parts) + key % np.uint64(parts)).astype(np.int64)


def _sent(near: Near, costs: np.ndarray, parts: int):
    """Each batch's entries as arrays by part; of keys that more than SMALL of the batch have, the first, and the others beside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, s in zip(_longs(b, "doc_id")[0].tolist(), shingle_sets(_bytes(b.column("text")), near.words), strict=True):
                for band in bands_of(near.percent, len(s)):
                    own = chosen(s, band, costs)
                    keys.append(own), ids.append(np.full(len(own), i)), sizes.append(np.full(len(own), len(s)))
            key, id_, n = _ordered(*(np.concatenate(x) for x in (keys, ids, sizes)))
            size = _runs(key)[1]
            many = np.repeat(size > SMALL, size)
            place = _ramp(size)
            hidden = np.flatnonzero(many & (place > 0))
            first, part = id_[hidden - place[hidden]], key % np.uint64(parts)
            rest = dict(_dealt(part[hidden], first, id_[hidden]))
            kept = np.flatnonzero(~(many & (place > 0)))
            kept = kept[np.argsort(id_[kept], kind="stable")]  # in order of ids they are packed best
            rows = []
            for p, c in _dealt(part[kept], (key[kept] >> np.uint64(32)).astype(np.uint32), id_[kept], n[kept].astype(np.int32), many[kept]):
                pairs = np.unique(np.stack(rest.pop(p)), axis=1) if p in rest else np.zeros((2, 0), np.int64)
                rows.append((p, [*c, *pairs]))
            yield _packed(rows, ENTRIES)

    return run


def _met(near: Near, parts: int):
    """The candidates of a part's buckets; the documents and the codes of its larger ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, columns in _numbered(batches, (np.uint32, np.int64, np.int32, bool, np.int64, np.int64)):
            key, ids, n, many, first, other = (np.concatenate(c) for c in columns)
            key, ids, n, many = _ordered(key, ids, n.astype(np.int64), many)
            pairs = np.concatenate([_candidates(key, ids, n, near.percent), np.sort(np.stack([first, other]), 0)], 1)
            pairs = np.unique(pairs[:, pairs[0] < pairs[1]], axis=1)
            start, size = _runs(key)
            large = size > SMALL
            if len(start):
                large |= np.logical_or.reduceat(many, start)
            held = np.unique(np.concatenate([ids[np.repeat(large, size)], first, other]))
            codes = key[start[large]].astype(np.int64) * parts + part
            none = lambda k: pa.nulls(k, pa.int64())
            counts = pairs.shape[1], len(held), len(codes)
            given = [[pairs[0], pairs[1]], [held], [codes]]
            at = [(0, 0), (0, 1), (1, 0), (2, 0)]
            columns = [pa.concat_arrays([pa.array(given[k][j]) if k == g else none(counts[k]) for k in range(3)]) for g, j in at]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split(" ")[0] for x in FOUND.split(", ")])

    return run


def _numbered(batches: Iterator[pa.RecordBatch], kinds: tuple) -> Iterator[tuple[int, list[list[np.ndarray]]]]:
    """A task's parts by number, as _parts gives them; a part's rows are put together before."""
    held: dict[int, list[pa.RecordBatch]] = {}
    for b in batches:
        for i, p in enumerate(b.column("part").to_pylist()):
            held.setdefault(p, []).append(b.slice(i, 1))
    while held:
        p, rows = held.popitem()
        yield p, next(_parts(iter(rows), kinds))


def _allowed(near: Near):
    """The pairs that the bitmaps of their sets do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            sizes = _longs(b, "n_a", "n_b")
            most = most_apart(*sizes, near.percent)
            for k, (x, y) in enumerate(zip(b.column("bits_a"), b.column("bits_b"), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                to = min(len(x), len(y))
                ok[k] = np.bitwise_count(folded(x, to) ^ folded(y, to)).sum() <= most[k]
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return run


def allowed(pairs: DataFrame, nodes: DataFrame, near: Near) -> DataFrame:
    side = lambda c: nodes.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    return checkpointed(map_arrow(pairs.join(side("a"), "a").join(side("b"), "b"), _allowed(near), PAIRS))


def _tiles(near: Near, costs: np.ndarray, large: np.ndarray, before: int, parts: int):
    """Documents with their bitmaps for each large bucket, or tile of one, that they are in, as arrays by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, heads = _longs(b, "doc_id", "component")
            cells, places, sides, sizes, bits = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int8)], [], []
            for k, s in enumerate(shingle_sets(_bytes(b.column("text")), near.words)):
                sizes.append(len(s)), bits.append(parity(s, WIDE) if len(s) else np.zeros(WIDE, np.uint64))
                for band in bands_of(near.percent, len(s)):
                    own = chosen(s, band, costs)
                    slot = _slots(_code(own, before))
                    own = own[(large[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)]
                    many = _groups(costs[(own % np.uint64(SLOTS)).astype(np.int64)])
                    mine = _mix(int(ids[k]))[0] % many.astype(np.uint64)
                    x, mine, key = _ramp(many).astype(np.uint64), np.repeat(mine, many), np.repeat(own, many)
                    low, high = np.minimum(x, mine), np.maximum(x, mine)
                    cells.append(mix(key + low * LEFT + high * RIGHT)), places.append(np.full(len(key), k))
                    sides.append(np.where(np.repeat(many, many) == 1, 0, (mine > x).astype(np.int8) + (mine != x)).astype(np.int8))
            cells, places, sides = (np.concatenate(x) for x in (cells, places, sides))
            sizes, rows = np.array(sizes, np.int64), []
            for p, (c, at, side) in _dealt(cells % np.uint64(parts), cells, places, sides):
                own, at = np.unique(at, return_inverse=True)
                rows.append((p, [c, at.astype(np.int64), side, ids[own], heads[own], sizes[own], np.concatenate([bits[k] for k in own])]))
            yield _packed(rows, TILES)

    return run


def _slots(code: np.ndarray) -> np.ndarray:
    return (mix(code.astype(np.uint64)) % np.uint64(KEYS)).astype(np.int64)


def _crossed(near: Near, every: bool):
    """The pairs of different components in a tile whose sizes and bitmaps allow a link; not every: as many as join the components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _parts(batches, (np.uint64, np.int64, np.int8, np.int64, np.int64, np.int64, np.uint64)):
            before = np.cumsum([0, *(len(x) for x in columns[3][:-1])])
            columns[1] = [x + k for x, k in zip(columns[1], before, strict=True)]
            cells, places, sides, ids, heads, n, bits = (np.concatenate(c) for c in columns)
            words = width(n) // 64 * WIDE
            begin = np.cumsum(words) - words
            order = np.lexsort((n[places], cells))
            cells, places, sides = (x[order] for x in (cells, places, sides))
            found: set[tuple[int, int]] = set()
            for s, z in zip(*(x.tolist() for x in _runs(cells)), strict=True):
                w, side = places[s : s + z], sides[s : s + z]
                label, size = heads[w], n[w]
                if (label == label[0]).all():
                    continue
                to = int(words[w].min())
                m = np.stack([folded(bits[begin[k] : begin[k] + words[k]], to) for k in w.tolist()])
                most = np.searchsorted(size * near.percent, size * 100, "right")
                for x in range(z - 1):
                    y = x + 1 + np.flatnonzero(label[x + 1 : most[x]] != label[x])
                    y = y[side[y] != side[x]] if side[x] else y
                    y = y[np.bitwise_count(m[y] ^ m[x]).sum(1) <= most_apart(size[x], size[y], near.percent)]
                    if not every and len(y):
                        joins, first = np.unique(label[y], return_index=True)
                        y = y[first]
                        label[np.isin(label, joins)] = label[x]
                        heads[np.isin(heads, joins)] = label[x]
                    found.update((int(min(ids[w[x]], i)), int(max(ids[w[x]], i))) for i in ids[w[y]].tolist())
            a, b = np.array(sorted(found), np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _bitmap(codes: DataFrame) -> np.ndarray:
    """A hashed bitmap of the large buckets' codes; KEYS / 8 bytes whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_slots(_longs(b, "code")[0]))], names=["_h"])

    slots = map_arrow(codes, run, "_h long").groupBy(F.shiftright("_h", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("_h") % (1 << 15)).alias("bits"))
    out = np.zeros(KEYS // 8, np.uint8)
    for r in slots.toLocalIterator():  # a bucket of bits after the other
        out[r.k << 12 : (r.k + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    return out


def rest(found: DataFrame, labels: DataFrame, sizes: DataFrame, docs: DataFrame, costs: np.ndarray, before: int, near: Near, every: bool) -> DataFrame:
    """Links between components that documents of the larger buckets have: every one, or as many as seem to join them."""
    some = found.filter("id is not null").select(F.col("id").alias("doc_id")).distinct()
    rows = some.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").join(sizes, "doc_id")
    rows = checkpointed(rows.select("doc_id", F.coalesce("component", "doc_id").alias("component"), "n"))
    large = _bitmap(found.filter("code is not null").select("code").distinct())
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("x")).first().x
    parts = max(16, -(-total // 1_000_000))
    asked = maybe_in(docs, "doc_id", id_filter(rows.select("doc_id"))).filter("_maybe").select("doc_id", "text").join(rows.select("doc_id", "component"), "doc_id")
    placed = map_arrow(asked.select("doc_id", "text", "component"), _tiles(near, costs, large, before, parts), TILES).repartition(parts, "part")
    pairs = checkpointed(map_arrow(placed, _crossed(near, every), PAIRS).distinct())
    return confirm(pairs, docs, near)


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, component) after more links (a, b) join components."""
    of = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"_{c}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    above = components(checkpointed(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).distinct()))
    alone = above.join(labels, "id", "left_anti")
    sized = above.select(F.col("id").alias("component"), F.col("component").alias("top")).join(labels.groupBy("component").agg(F.count("*").alias("size")), "component")
    out = look_up(labels, "component", F.col("id").cast("string"), sized, "size").select("id", F.coalesce("top", "component").alias("component"))
    return checkpointed(out.unionAll(alone.select("id", "component")))


def classes(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = checkpointed(map_arrow(spread(docs), _digests(near), "doc_id long, n long, same binary, bits binary, slot int, hits long"))
    counted, rows = first.filter("slot is not null").select("slot", "hits"), first.filter("slot is null").select("doc_id", "n", "same", "bits")
    equal = checkpointed(rows.filter("same is not null").groupBy("same").agg(F.min("doc_id").alias("head"), F.count("*").alias("rows")).filter("rows > 1"))
    spare = F.coalesce(F.col("doc_id"), F.lit(0)).cast("string")
    known = checkpointed(look_up(rows, "same", spare, equal, "rows").withColumn("head", F.coalesce("head", "doc_id")))
    nodes = known.filter("doc_id = head and n > 0").select("doc_id", "n", "bits")
    sizes = nodes.groupBy("doc_id").agg(F.max("n").alias("n"))
    heads = maybe_in(docs, "doc_id", id_filter(sizes)).filter("_maybe").select("doc_id", "text")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("x")).first().x
    parts = max(16, -(-total // 1_000_000))  # half as many entries
    costs = _costs(counted)
    placed = map_arrow(spread(heads), _sent(near, costs, parts), ENTRIES).repartition(parts, "part")
    found = checkpointed(map_arrow(placed, _met(near, parts), FOUND))
    pairs = found.filter("a is not null").select("a", "b").distinct()
    twice = known.filter("n > 0").groupBy("doc_id").agg(F.min("head").alias("a"), F.max("head").alias("_z")).filter("a <> _z")
    same = known.join(twice, "doc_id").select("a", F.col("head").alias("b")).filter("a <> b")  # texts of rows with one id
    links = checkpointed(confirm(allowed(pairs, nodes, near), docs, near).unionAll(same))
    labels = components(links)
    for every in (False, True):
        more = rest(found, labels, sizes, docs, costs, parts, near, every)
        if not more.isEmpty():
            labels = joined(labels, more)
    # head is hot where copies are; look-ups spread such rows.
    copies = equal.groupBy("head").agg(F.max("rows").alias("rows"))
    labels = labels.withColumnRenamed("id", "head").join(copies, "head", "left").withColumn("rows", F.coalesce("rows", F.lit(1)))
    out = look_up(known.select("doc_id", "n", "head"), "head", spare, labels, "rows")
    component = F.coalesce("component", F.when(F.col("n") > 0, F.col("head")), "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
