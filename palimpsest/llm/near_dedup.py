"""Near-duplicate components by MinHash with tensored banding.

Two small collections of TABLES half-bands each are computed, every half-band from ROWS
minima. A table's key is a pair, one half-band of either collection, so 2 x TABLES x ROWS
minima make TABLES^2 tables of 2 x ROWS rows; a pair of similarity 0.8 shares no key with a
probability of about 1 in 15,000.

Documents with equal shingle sets are one class, and only classes are compared. Keys travel
in arrays, one row a task and part. The first round pairs all documents of a key's bucket with
the first in one order of all documents, so that a hundred tables give few distinct pairs, and
in buckets up to SMALL each with each. Where a batch alone has more than SMALL documents of a
key, its first stands for them in other batches. Candidates whose sizes rule a link out go, and
those whose minima agree on a share below `Near.seen`; the rest are confirmed on their full sets.

The exact rest takes all documents of the larger buckets. They meet by the half-bands of the
first collection, with their full sets, and every pair of different components that shares a
key is compared there, once, unless sizes rule it out. A task joins components as it goes and
returns only what it joined, so rows grow with the components and only comparisons with the
squares of groups. Half-bands with more than GROUP shingles are dealt to groups by a hash of
the id, the largest component of the half-band apart from the others: two groups meet in one
tile, so that a task stays bounded, and groups of the largest component do not meet.

Sets are held as 64-bit hashes of shingles, the hashes of whose words are polynomials of all
their bytes; what is compared in full are these sets.

Documents without words are linked with nothing. Rows with a null id are components of their
own with a null component_id. Rows that repeat an id count as one node. Empty tables give no
rows. Texts are processed whole. Other columns, whatever their names, pass through `dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.forest import components
from .common import checkpointed, id_filter, look_up, map_arrow, maybe_in, slices, spread
from .shingles import LEFT, RIGHT, mix, shingle_sets

TABLES, ROWS = 10, 2
#: Buckets up to SMALL have each document paired with each in the first round.
SMALL = 16
#: Shingles of the documents that a half-band sends to one group of the exact rest.
GROUP = 1 << 16
PAIRS = "a long, b long"


@dataclass(frozen=True)
class Near:
    """Link at percent * union <= 100 * intersection of sets of `words` words.

    seen: pairs of the first round with a smaller share of equal minima are not confirmed; at
    0.5 that is a pair of similarity 0.8 with a probability under 10^-5, at 0 none.
    """

    words: int = 5
    percent: int = 80
    seen: float = 0.5


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.arange(1, n + 1, dtype=np.uint64)
    return mix(x * LEFT) | np.uint64(1), mix(x * RIGHT)


def _bytes(texts: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, plus = _seeds(2 * TABLES * ROWS)
        for b in slices(batches):
            n, same, halves, seen = [], [], [], []
            for s in shingle_sets(_bytes(b.column("text")), words):
                n.append(len(s))
                if not len(s):
                    same.append(None), halves.append(None), seen.append(None)
                    continue
                low = np.full(len(times), np.uint64(2**64 - 1))
                for at in range(0, len(s), 4096):
                    low = np.minimum(low, (s[None, at : at + 4096] * times[:, None] + plus[:, None]).min(1))
                rows = mix(low).reshape(2 * TABLES, ROWS)
                half = np.arange(2 * TABLES, dtype=np.uint64)
                for k in range(ROWS):
                    half = mix(half * LEFT + rows[:, k])
                same.append(np.array([mix(s).sum(), mix(s * RIGHT).sum()]).tobytes())
                halves.append(half.tobytes())
                seen.append((rows >> np.uint64(48)).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (same, halves, seen))], names=["doc_id", "n", "same", "halves", "seen"])

    return run


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (shingles), same (digest of the set), halves (half-bands), seen (minima, shortened)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(spread(rows), _sketch(words), "doc_id long, n long, same binary, halves binary, seen binary")


def _keyed(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(key, id, n) of every table entry of the batch, in order of key and a hash of the id."""
    ids, n = _longs(b, "doc_id", "n")
    half = _halves(b)
    key = mix(half[:, :TABLES, None] * LEFT + half[:, None, TABLES:] * RIGHT).reshape(len(ids), -1)
    each = key.shape[1]
    return _ordered(key.ravel(), np.repeat(ids, each), np.repeat(n, each))


def _longs(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]


def _halves(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("halves").to_pylist()), np.uint64).reshape(b.num_rows, 2 * TABLES)


def _ordered(key: np.ndarray, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((mix(ids.astype(np.uint64)), key))
    return key[order], ids[order], n[order]


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and sizes of the runs of equal keys."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(np.concatenate([start, [len(key)]]))


def _candidates(key: np.ndarray, ids: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """The first round's pairs, whose sizes do not rule them out."""
    start, size = _runs(key)
    pairs = []
    for d in range(1, SMALL):
        # The k-th of a bucket with the one d before it, in buckets up to SMALL.
        some, many = start[(size > d) & (size <= SMALL)], size[(size > d) & (size <= SMALL)]
        a = np.repeat(some, many - d) + _ramp(many - d)
        pairs.append(np.stack([a, a + d]))
    big, many = start[size > SMALL], size[size > SMALL]
    first = np.repeat(big, many - 1)
    pairs.append(np.stack([first, first + 1 + _ramp(many - 1)]))
    return _distinct(np.concatenate(pairs, 1), ids, n, percent)


def _distinct(p: np.ndarray, ids: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    lo, hi = np.minimum(n[p[0]], n[p[1]]), np.maximum(n[p[0]], n[p[1]])
    x = np.sort(ids[p[:, 100 * lo >= percent * hi]], 0)
    x = x[:, x[0] < x[1]]
    x = x[:, np.lexsort((x[1], x[0]))]
    return x[:, np.concatenate([[True], (np.diff(x, axis=1) != 0).any(0)])] if x.size else x


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, end to end."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


ENTRIES = "part int, keys binary, ids binary, sizes binary, many binary"


def _dealt(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns of each part that has entries."""
    order = np.argsort(part, kind="stable")
    for a, n in zip(*(x.tolist() for x in _runs(part[order])), strict=True):
        yield int(part[order[a]]), [c[order[a : a + n]] for c in columns]


def _packed(rows: list[tuple[int, list[np.ndarray]]], names: str) -> pa.RecordBatch:
    """One row a part, its arrays as bytes."""
    names = [x.split(" ")[0] for x in names.split(", ")]
    columns = zip(*([x.tobytes() for x in c] for _, c in rows), strict=True) if rows else [()] * (len(names) - 1)
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=names)


def _sent(parts: int):
    """Each batch's entries as arrays by part; the first alone of keys that more than SMALL of the batch have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            key, ids, n = _keyed(b)
            size = _runs(key)[1]
            many = np.repeat(size > SMALL, size)
            kept = ~many | (_ramp(size) == 0)
            key, ids, n, many = key[kept], ids[kept], n[kept], many[kept]
            part = (key >> np.uint64(32)) % np.uint64(parts)
            yield _packed(list(_dealt(part, key, ids, n.astype(np.int32), many)), ENTRIES)

    return run


FOUND = "a long, b long, id long"


def _found(x: np.ndarray, large: np.ndarray) -> pa.RecordBatch:
    """Pairs, and the ids that large buckets hold, in one table."""
    m, k = x.shape[1], len(large)
    none = lambda n: pa.nulls(n, pa.int64())
    columns = [pa.concat_arrays([pa.array(c, pa.int64()), none(k)]) for c in x] + [pa.concat_arrays([none(m), pa.array(large, pa.int64())])]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "id"])


def _large(key: np.ndarray, ids: np.ndarray, many: np.ndarray | None = None) -> np.ndarray:
    """The ids in buckets of more than SMALL; many: entries that stand for so many."""
    start, size = _runs(key)
    large = size > SMALL
    if many is not None and len(start):
        large |= np.logical_or.reduceat(many, start)
    return np.unique(ids[np.repeat(large, size)])


def _local(percent: int):
    """What the keys for which _sent keeps the first give within each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            key, ids, n = _keyed(b)
            _, size = _runs(key)
            many = np.repeat(size > SMALL, size)
            key, ids, n = key[many], ids[many], n[many]
            yield _found(_candidates(key, ids, n, percent), _large(key, ids))

    return run


def _parts(batches: Iterator[pa.RecordBatch], kinds: tuple) -> Iterator[list[list[np.ndarray]]]:
    """A task's parts, whose number keeps each to some 10 MB: of each column the arrays sent."""
    held: dict[int, list[list[bytes]]] = {}
    for b in batches:
        names = b.schema.names[1:]
        for r in b.to_pylist():
            for c, x in zip(held.setdefault(r["part"], [[] for _ in names]), names, strict=True):
                c.append(r[x])
    while held:
        yield [[np.frombuffer(x, k) for x in c] for c, k in zip(held.popitem()[1], kinds, strict=True)]


def _met(percent: int):
    """The first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _parts(batches, (np.uint64, np.int64, np.int32, bool)):
            key, ids, n, many = (np.concatenate(c) for c in columns)
            order = np.lexsort((mix(ids.astype(np.uint64)), key))
            key, ids, n, many = key[order], ids[order], n[order].astype(np.int64), many[order]
            yield _found(_candidates(key, ids, n, percent), _large(key, ids, many))

    return run


HALVES = "part int, keys binary, ids binary, heads binary, sizes binary, tables binary"


def _half_bands(parts: int):
    """The first collection's half-bands of each batch, as arrays by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            key = _halves(b)[:, :TABLES].ravel()
            entries = [np.repeat(x, TABLES) for x in _longs(b, "doc_id", "component", "n")]
            tables = np.tile(np.arange(TABLES, dtype=np.int64), b.num_rows)
            yield _packed(list(_dealt((key >> np.uint64(32)) % np.uint64(parts), key, *entries, tables)), HALVES)

    return run


TALLY = "id long, tables long, t int, main long, mains long, others long"


def _tally(group: int):
    """Of half-bands with several components: each id with a mask of its tables, and for those of
    over group shingles each id with its table, the largest component, the groups of that one and of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _parts(batches, (np.uint64, *[np.int64] * 4)):
            key, ids, heads, n, tables = (np.concatenate(c) for c in columns)
            order = np.lexsort((heads, key))
            key, ids, heads, n, tables = (x[order] for x in (key, ids, heads, n, tables))
            start, size = _runs(key)
            open_ = heads[start] < heads[start + size - 1]
            total = np.add.reduceat(n, start)
            some = np.repeat(open_, size)
            none = lambda k, kind=pa.int64(): pa.nulls(k, kind)
            hot: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
            for k in np.flatnonzero(open_ & (total > group)).tolist():
                own = slice(start[k], start[k] + size[k])
                first = _runs(heads[own])[0]
                each = np.add.reduceat(n[own], first)
                top = int(each.argmax())
                main, most = int(heads[own][first[top]]), int(each[top])
                info = (main, -(-most // group), -(-int(total[k] - most) // group))
                for column, x in zip(hot, (ids[own], tables[own], *(np.full(size[k], v, np.int64) for v in info)), strict=True):
                    column.append(x)
            ids, bits = ids[some], np.int64(1) << tables[some]
            order = np.argsort(ids, kind="stable")
            ids, bits = ids[order], bits[order]
            first = _runs(ids)[0]
            masks = np.bitwise_or.reduceat(bits, first) if len(ids) else bits
            named, table, *more = (np.concatenate(c) for c in hot)
            m, k = len(first), len(named)
            columns = [pa.array(np.concatenate([ids[first], named])), pa.concat_arrays([pa.array(masks), none(k)]), pa.concat_arrays([none(m, pa.int32()), pa.array(table.astype(np.int32))])]
            columns += [pa.concat_arrays([none(m), pa.array(c)]) for c in more]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split(" ")[0] for x in TALLY.split(", ")])

    return run


TILES = "part int, cells binary, places binary, sides binary, tables binary, heads binary, halves binary, sizes binary, shingles binary"


def _tiles(words: int, parts: int):
    """Documents with their sets for each tile that they are in, as arrays by part; a part gets a batch's document once.

    The column hot has for each of a document's hot half-bands its table, the largest component,
    the groups of that one and of the others.
    """

    def dealt(half, ids, heads, masks, groups, sets):
        cells, places, sides, tables = [], [], [], []

        def put(cell, at, side, t):
            cells.append(cell), places.append(at), sides.append(np.full(len(at), side, np.int8)), tables.append(np.full(len(at), t, np.int8))

        for t in range(TABLES):
            at = np.flatnonzero(masks >> t & 1)
            hot = np.array([t in groups[k] for k in at.tolist()], bool)
            put(half[at[~hot], t], at[~hot], 0, t)
            for k in at[hot].tolist():
                main, mains, others = groups[k][t]
                draw, here = int(mix(ids[k : k + 1].astype(np.uint64))[0]), np.array([k])
                # Groups of other components have the numbers from 0, those of the largest come after them.
                if heads[k] == main:
                    pairs = [(x, others + draw % mains, 2) for x in range(others)]
                else:
                    mine = draw % others
                    pairs = [(min(mine, x), max(mine, x), (mine > x) + (mine != x)) for x in range(others + mains)]
                for x, y, side in pairs:
                    put(mix(half[here, t] + np.array([x * (others + mains) + y + 1], np.uint64) * LEFT), here, side, t)
        cells, places, sides, tables = (np.concatenate(x) for x in (cells, places, sides, tables))
        rows = []
        for p, (c, at, side, t) in _dealt((cells >> np.uint64(32)) % np.uint64(parts), cells, places, sides, tables):
            own, at = np.unique(at, return_inverse=True)
            rows.append((p, [c, at.astype(np.int64), side, t, heads[own], half[own], np.array([len(sets[k]) for k in own], np.int64), np.concatenate([sets[k] for k in own])]))
        return _packed(rows, TILES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            half, (ids, heads, masks) = _halves(b), _longs(b, "doc_id", "component", "tables")
            groups = [{x["t"]: (x["main"], x["mains"], x["others"]) for x in own} for own in b.column("hot").to_pylist()]
            sets, begin = [], 0
            for k, s in enumerate(shingle_sets(_bytes(b.column("text")), words), 1):
                sets.append(s)
                if k == b.num_rows or sum(map(len, sets)) > 1 << 19:
                    yield dealt(*(x[begin:k] for x in (half, ids, heads, masks, groups)), sets)
                    sets, begin = [], k

    return run


def _joined(percent: int):
    """The pairs of components that documents of one tile link, as many as it takes to join them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _parts(batches, (np.uint64, np.int64, np.int8, np.int8, np.int64, np.uint64, np.int64, np.uint64)):
            before = np.cumsum([0, *(len(h) for h in columns[4][:-1])])
            columns[1] = [x + k for x, k in zip(columns[1], before, strict=True)]
            cells, places, sides, tables, heads, halves, n, shingles = (np.concatenate(c) for c in columns)
            halves = halves.reshape(len(heads), 2 * TABLES)
            codes = np.unique(shingles, return_inverse=True)[1]
            begin, marked = np.cumsum(n) - n, np.zeros(len(shingles), bool)
            order = np.lexsort((n[places], cells))
            cells, places, sides, tables = (x[order] for x in (cells, places, sides, tables))
            links = []
            for s, z in zip(*(x.tolist() for x in _runs(cells)), strict=True):
                w, side, t = places[s : s + z], sides[s : s + z], tables[s]
                label, size, own = heads[w], n[w], halves[w]
                most = np.searchsorted(size * percent, size * 100, "right")
                for x in range(z - 1):
                    y = x + 1 + np.flatnonzero(label[x + 1 : most[x]] != label[x])
                    if side[x]:
                        y = y[side[y] != side[x]]
                    same = own[y] == own[x]  # a pair is compared in the first table that it shares
                    y = y[~same[:, :t].any(1) & same[:, TABLES:].any(1)]
                    if not len(y):
                        continue
                    mine, lengths = codes[begin[w[x]] : begin[w[x]] + size[x]], size[y]
                    marked[mine] = True
                    hits = marked[codes[np.repeat(begin[w[y]], lengths) + _ramp(lengths)]]
                    marked[mine] = False
                    both = np.add.reduceat(hits, np.cumsum(lengths) - lengths, dtype=np.int64)
                    for k in y[100 * both >= percent * (size[x] + lengths - both)].tolist():
                        if label[k] != label[x]:
                            a, b = sorted((int(label[k]), int(label[x])))
                            links.append((a, b))
                            label[label == b] = a
                            heads[heads == b] = a
            x = np.array(links, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], names=["a", "b"])

    return run


def rest(found: DataFrame, nodes: DataFrame, labels: DataFrame, docs: DataFrame, near: Near) -> DataFrame:
    """The pairs of components that documents of the larger buckets link."""
    some = found.filter("id is not null").select(F.col("id").alias("doc_id")).distinct()
    rows = nodes.join(some, "doc_id", "left_semi").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    rows = checkpointed(rows.select("doc_id", "n", "halves", F.coalesce("component", "doc_id").alias("component")))
    parts = max(16, -(-rows.count() * TABLES // 250_000))
    tally = checkpointed(map_arrow(map_arrow(rows, _half_bands(parts), HALVES).repartition(parts, "part"), _tally(GROUP), TALLY))
    hot = F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", "main", "mains", "others"))).alias("hot")  # TABLES at most
    tables = tally.groupBy(F.col("id").alias("doc_id")).agg(F.bit_or("tables").alias("tables"), hot)
    rows = checkpointed(rows.join(tables, "doc_id"))
    more = F.aggregate("hot", F.lit(0).cast("long"), lambda x, h: x + h["others"] + F.when(h["main"] == F.col("component"), 0).otherwise(h["mains"]) - 1)
    sent = rows.agg(F.sum((F.col("n") + 32) * (F.bit_count("tables") + more))).first()[0] or 0
    parts = max(16, -(-sent // 1_000_000))
    asked = maybe_in(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id", id_filter(rows.select("doc_id")))
    asked = asked.filter("_maybe").select("doc_id", "text").join(rows, "doc_id").select("doc_id", "text", "halves", "component", "tables", "hot")
    placed = map_arrow(asked, _tiles(near.words, parts), TILES).repartition(parts, "part")
    return checkpointed(map_arrow(placed, _joined(near.percent), PAIRS))


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in ("seen_a", "seen_b"))
            ok = (x == y).mean(1) >= least if b.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], names=["a", "b"])

    return run


def likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The distinct pairs whose minima do not rule the link out."""
    seen = nodes.select("doc_id", "seen")
    p = pairs.select("a", "b").distinct()
    p = p.join(seen.withColumnsRenamed({"doc_id": "a", "seen": "seen_a"}), "a").join(seen.withColumnsRenamed({"doc_id": "b", "seen": "seen_b"}), "b")
    return checkpointed(map_arrow(p, _likely(least), PAIRS))


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids = b.column("doc_id").to_pylist()
            held, size = ([], []), 0
            for i, s in zip(ids, shingle_sets(_bytes(b.column("text")), words), strict=True):
                held[0].append(i), held[1].append(s.tobytes())
                size += 8 * len(s)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[1], pa.binary())], names=["doc_id", "shingles"])
                    held, size = ([], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[1], pa.binary())], names=["doc_id", "shingles"])

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            ok = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])

    return run


def confirm(pairs: DataFrame, docs: DataFrame, near: Near) -> DataFrame:
    """The pairs that are links, by the full sets of their documents."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    asked = maybe_in(rows, "doc_id", id_filter(ids)).filter("_maybe").select("doc_id", "text")
    sets = map_arrow(asked, _sets(near.words), "doc_id long, shingles binary")
    p = pairs.join(sets.withColumnsRenamed({"doc_id": "a", "shingles": "set_a"}), "a").join(sets.withColumnsRenamed({"doc_id": "b", "shingles": "set_b"}), "b")
    return checkpointed(map_arrow(p.select("a", "b", "set_a", "set_b"), _confirmed(near.percent), PAIRS))


def classes(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    sketched = checkpointed(sketches(docs, near.words))
    equal = sketched.filter("same is not null").groupBy("same").agg(F.min("doc_id").alias("head"), F.count("*").alias("rows"))
    spare = F.coalesce(F.col("doc_id"), F.lit(0)).cast("string")
    known = checkpointed(look_up(sketched, "same", spare, equal.filter("rows > 1"), "rows").withColumn("head", F.coalesce("head", "doc_id")))
    nodes = known.filter("doc_id = head and n > 0").dropDuplicates(["doc_id"]).select("doc_id", "n", "halves", "seen")
    nodes = checkpointed(nodes)
    entries = nodes.count() * TABLES * TABLES
    parts = max(16, -(-entries // 500_000))
    placed = map_arrow(nodes, _sent(parts), ENTRIES).repartition(parts, "part")
    found = checkpointed(map_arrow(placed, _met(near.percent), FOUND).unionAll(map_arrow(nodes, _local(near.percent), FOUND)))
    links = confirm(likely(found.filter("a is not null"), nodes, near.seen), docs, near)
    labels = components(links)
    more = rest(found, nodes, labels, docs, near)
    if not more.isEmpty():
        above = components(more)
        alone = above.join(labels, "id", "left_anti")
        sized = above.select(F.col("id").alias("component"), F.col("component").alias("top")).join(labels.groupBy("component").agg(F.count("*").alias("size")), "component")
        labels = look_up(labels, "component", F.col("id").cast("string"), sized, "size").select("id", F.coalesce("top", "component").alias("component"))
        labels = checkpointed(labels.unionAll(alone.select("id", "component")))
    # head is hot where copies are; look-ups spread such rows.
    heads = equal.filter("rows > 1").select("head", "rows").groupBy("head").agg(F.max("rows").alias("rows"))
    labels = labels.withColumnRenamed("id", "head").join(heads, "head", "left").withColumn("rows", F.coalesce("rows", F.lit(1)))
    out = look_up(known.select("doc_id", "n", "head"), "head", spare, labels, "rows")
    component = F.coalesce("component", F.when(F.col("n") > 0, F.col("head")), "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def dedup(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """docs with one document of each component, the one with the smallest id."""
    gone = checkpointed(classes(docs, near).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct())
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    rows = maybe_in(held, "_id", id_filter(gone))
    # Only rows that the bitmap cannot clear are shuffled.
    doubtful = rows.filter("_maybe").join(gone, F.col("_id") == F.col("_gone"), "left_anti")
    return rows.filter("not _maybe").unionByName(doubtful).select("_row.*")
