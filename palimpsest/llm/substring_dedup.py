"""Removal of repeated substrings by prefix-free parsing.

A rolling hash picks triggers: of every string of LENGTH bytes the K-gram with the least hash.
Windows (the strings of LENGTH bytes, by their start) that have one trigger in common, next to
each other, make a phrase; its bytes are all that its windows hold. Equal windows have equal
triggers, so they lie in phrases of the same trigger. The dictionary holds each distinct phrase
once, and what the parse says of it, the smallest document that it occurs in. The suffixes of
the dictionary are put in order by their bytes; suffixes next to each other that share LENGTH
bytes, with the documents that the parse gives their phrases, say which windows a smaller
document has. The order of what follows a phrase in the parse decides only between suffixes
that share more than LENGTH bytes, on which nothing here depends, so it is not taken.

    1. Documents are dealt to blocks of about BLOCK bytes and written once, compressed;
       triggers are dealt to parts, about one for each PART bytes of text.
    2. Each block sends its triggers, two to three bytes each; which of them other blocks have comes back
       as a bitmap.
    3. Each block sends the distinct phrases of shared triggers. A part merges equal phrases,
       leaves out the suffixes whose LENGTH bytes have a hash of their own, sorts the others, and
       a mask of repeated windows comes back for each phrase.
    4. Each block covers the repeated windows and gives spans, or the bytes that stay.

Phrases are equal, and suffixes share bytes, where the bytes themselves agree; hashes only choose
what is compared. Rows are few and hold arrays, so a trigger or phrase that a third of all
documents share costs one entry a block. Null texts are empty; texts shorter than LENGTH lose
nothing and very long ones are taken whole; a null id comes after all others (a document with the
largest possible id beside it), and rows that repeat an id, or have none, do not remove from each
other. Empty tables give no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_arrow, slices
from .shingles import LEFT, mix, powers, sums

LENGTH, K = 50, 28
#: Bytes of text in a block, and of the text whose triggers meet in a part.
BLOCK, PART = 4 << 20, 12 << 20
CHUNK = 1 << 16
LAST = np.iinfo(np.int64).max
TEXTS = "block int, ids binary, sizes binary, data binary"


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _dealt(blocks: int):
    """Texts of a batch by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            ids = np.array([LAST if i is None else i for i in b.column("doc_id").to_pylist()], np.int64)
            texts = [b"" if t is None else t for t in b.column("text").cast(pa.binary()).to_pylist()]
            size = np.array([len(t) for t in texts], np.int64)
            none = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            block = (mix(ids.astype(np.uint64) + (ids == LAST) * size.astype(np.uint64)) >> np.uint64(8)) % np.uint64(blocks)
            rows = []
            for p in np.unique(block):
                at = np.flatnonzero(block == p)
                rows.append({"block": int(p), "ids": ids[at].tobytes(), "sizes": np.where(none, -size - 1, size)[at].tobytes(), "data": _pack(b"".join(texts[i] for i in at))})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return run


_SCHEMA = pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())])


class Phrases:
    """The parse of a block: for each phrase its document, first window, windows and trigger's hash."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, data: np.ndarray, none: np.ndarray | None = None):
        self.ids, self.data, self.none = ids, data, none
        self.end = np.cumsum(size)
        self.begin = self.end - size
        parts = [self._chunk(a, b) for a, b in self._chunks()]
        self.doc, self.first, self.windows, self.trigger, self.content = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in enumerate((np.int64, np.int64, np.int64, np.uint64, np.uint64)))

    def _chunks(self) -> Iterator[tuple[int, int]]:
        a = 0
        while a < len(self.ids):
            b = max(a + 1, int(np.searchsorted(self.end, self.begin[a] + CHUNK, "right")))
            yield a, b
            a = b

    def _chunk(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        base = int(self.begin[a])
        data = self.data[base : int(self.end[b - 1])]
        n = len(data)
        empty = tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        if n < LENGTH:
            return empty
        prefix = sums(data)
        inverse = powers(n + 1)[1]
        gram = mix((prefix[K:] - prefix[:-K]) * inverse[: n - K + 1])
        place = np.arange(len(gram), dtype=np.uint64)
        least = (gram & np.uint64(0xFFFFFFFF00000000)) | place  # the leftmost of equals
        width, span = LENGTH - K + 1, 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # the trigger of each window
        valid = np.zeros(n + 1, np.int32)
        begin, end = self.begin[a:b] - base, self.end[a:b] - base
        long = end - begin >= LENGTH
        np.add.at(valid, begin[long], 1)
        np.add.at(valid, end[long] - LENGTH + 1, -1)
        start = np.flatnonzero(np.cumsum(valid[: len(at)]))
        if not len(start):
            return empty
        t = at[start]
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (start[1:] != start[:-1] + 1)])
        # Windows next to each other in two documents are apart by LENGTH at least, so `new` parts them.
        first = start[new]
        windows = np.diff(np.concatenate([np.flatnonzero(new), [len(start)]]))
        stop = first + windows - 1 + LENGTH
        content = mix((prefix[stop] - prefix[first]) * inverse[first] + (stop - first).astype(np.uint64))
        doc = np.searchsorted(end, first, "right") + a
        return doc, first + base, windows, gram[t[new]], content


def _block(row: dict) -> Phrases:
    """A block's parse; documents in order of id, so that all steps see the same order."""
    ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in row["texts"]])
    size = np.concatenate([np.frombuffer(r["sizes"], np.int64) for r in row["texts"]])
    none = size < 0  # rows without an id
    size = np.where(none, -size - 1, size)
    data = b"".join(_unpack(r["data"]) for r in row["texts"])
    end = np.cumsum(size)
    texts = [data[e - s : e] for s, e in zip(size.tolist(), end.tolist(), strict=True)]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], none[i], texts[i]))
    return Phrases(ids[order], size[order], np.frombuffer(b"".join(texts[i] for i in order), np.uint8), none[order])


def _stable(small: np.ndarray) -> np.ndarray:
    """A stable order of numbers that fit 32 bits."""
    return np.argsort(small.astype(np.uint16 if small.max(initial=0) < 1 << 16 else np.uint32), kind="stable")


class Parts:
    """Where the entries of each part are in an order of parts; parts without entries cost nothing."""

    def __init__(self, part: np.ndarray):
        names, start = np.unique(part, return_index=True)
        ends = [*start[1:].tolist(), len(part)]
        self.at = {int(p): slice(a, b) for p, a, b in zip(names.tolist(), start.tolist(), ends, strict=False)}

    def __iter__(self) -> Iterator[tuple[int, slice]]:
        return iter(self.at.items())

    def __getitem__(self, part: int) -> slice:
        return self.at[part]


class Triggers:
    """The distinct triggers of a block by part, and for each phrase which of them is its own."""

    def __init__(self, p: Phrases, parts: int):
        self.order = np.argsort(p.trigger, kind="stable")  # phrases come in order of document
        t = p.trigger[self.order]
        new = np.concatenate([[True], t[1:] != t[:-1]])[: len(t)]
        key = t[new]
        part = key % np.uint64(parts)
        by = _stable(part)
        self.key, self.parts = key[by], Parts(part[by])
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.own = place[np.cumsum(new) - 1]  # of the phrases in order


def _coded(key: np.ndarray) -> bytes:
    """The leading 32 bits of sorted keys, as differences byte by byte: two to three bytes each.

    Two triggers of a part may share them; then phrases are sent that need not be.
    """
    x = (key >> np.uint64(32)).astype(np.uint32)
    return _pack(np.diff(x, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes())


def _decoded(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpack(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def _triggers(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                found = Triggers(_block(row), parts)
                rows = []
                for p, own in found.parts:
                    rows.append({"block": row["block"], "part": p, "data": _coded(found.key[own])})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _SENT)

    return run


_SENT = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])
SENT = "block int, part int, data binary"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Each part's rows; a task holds its parts."""
    held: dict[int, list[tuple[int, bytes]]] = {}
    for b in batches:
        for block, part, data in zip(*(b.column(c).to_pylist() for c in ("block", "part", "data")), strict=True):
            held.setdefault(part, []).append((block, data))
    while held:
        yield held.popitem()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and part a bitmap of the triggers that other blocks have too."""
    for part, rows in _parts(batches):
        keys = [_decoded(data) for _, data in rows]
        every = np.sort(np.concatenate(keys))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for (block, _), key in zip(rows, keys, strict=True):
            at = np.minimum(np.searchsorted(twice, key), max(len(twice) - 1, 0))
            out.append({"block": block, "part": part, "data": np.packbits(twice[at] == key if len(twice) else np.zeros(len(key), bool)).tobytes()})
        yield pa.RecordBatch.from_pylist(out, _SENT)


class Dictionary:
    """The distinct phrases that a block sends, in order of part, and each phrase's entry (or -1)."""

    def __init__(self, p: Phrases, bitmaps: list[dict], parts: int):
        found = Triggers(p, parts)
        shared = np.zeros(len(found.key), bool)
        for r in bitmaps:
            own = found.parts[r["part"]]
            shared[own] = np.unpackbits(np.frombuffer(r["data"], np.uint8), count=own.stop - own.start).astype(bool)
        # Triggers that several documents of the block itself have are shared as well.
        d = p.ids[p.doc[found.order]]
        shared[found.own[1:][(found.own[1:] == found.own[:-1]) & (d[1:] != d[:-1])]] = True
        self.rows = np.sort(found.order[shared[found.own]])
        # Equal phrases: the first has the smallest document, as documents are in order.
        trigger = p.trigger[self.rows]
        first, entry = _equal(mix(trigger * LEFT + p.content[self.rows]), p.first[self.rows], p.windows[self.rows], p.data)
        part = trigger[first] % np.uint64(parts)
        by = _stable(part)
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        self.entry = rank[entry]
        self.first = self.rows[first[by]]  # the phrase that each entry stands for
        self.parts = Parts(part[by])


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """The bytes of the spans, end to end."""
    view = memoryview(data)
    return b"".join([view[a : a + n] for a, n in zip(start.tolist(), size.tolist(), strict=True)])


def _entries(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                p = _block(row)
                d = Dictionary(p, row["shared"] or [], parts)
                rows = []
                for part, own in d.parts:
                    at = d.first[own]
                    head = np.array([len(at)], np.int64).tobytes() + p.ids[p.doc[at]].tobytes() + p.windows[at].astype(np.uint8).tobytes()
                    rows.append({"block": row["block"], "part": part, "data": _pack(head + _gather(p.data, p.first[at], p.windows[at] + LENGTH - 1))})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _SENT)

    return run


def _words(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, as numbers in the order of the bytes."""
    return np.ndarray((max(len(data) - 7, 0),), ">u8", data if data.flags.c_contiguous else data.copy(), 0, (1,))


def _equal(hashed: np.ndarray, first: np.ndarray, windows: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each set of equal phrases, and the number of each phrase's set."""
    if not len(hashed):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, head, entry = np.unique(hashed, return_index=True, return_inverse=True)
    entry = entry.ravel()
    twin = head[entry]
    some = np.flatnonzero(twin != np.arange(len(twin)))
    same = windows[some] == windows[twin[some]]
    word, last = _words(data), windows[some] + LENGTH - 9
    for k in range(0, LENGTH + LENGTH - K, 8):  # the last of the words overlap
        at = np.minimum(k, last)
        same &= word[first[some] + at] == word[np.minimum(first[twin[some]] + at, len(word) - 1)]
    if same.all():
        return head, entry
    found: dict[bytes, int] = {}  # phrases that have a hash in common are told apart by their bytes
    head = []
    for i, (a, n) in enumerate(zip(first.tolist(), windows.tolist(), strict=True)):
        entry[i] = k = found.setdefault(data[a : a + n + LENGTH - 1].tobytes(), len(head))
        if k == len(head):
            head.append(i)
    return np.array(head, np.int64), entry


def _hashes(data: np.ndarray, begin: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each window of phrases that lie one after another, and of each phrase."""
    size = windows + LENGTH - 1
    first = np.cumsum(windows) - windows
    suffix, whole = np.empty(int(windows.sum()), np.uint64), np.empty(len(windows), np.uint64)
    a = 0
    while a < len(windows):  # a chunk of phrases at a time
        b = max(a + 1, int(np.searchsorted(begin + size, begin[a] + CHUNK, "right")))
        prefix = sums(data[begin[a] : begin[b - 1] + size[b - 1]])
        inverse = powers(len(prefix))[1]
        own = begin[a:b] - begin[a]
        whole[a:b] = mix((prefix[own + size[a:b]] - prefix[own]) * inverse[own] + size[a:b].astype(np.uint64))
        x = np.repeat(own - first[a:b] + first[a], windows[a:b]) + np.arange(windows[a:b].sum())
        suffix[first[a] : first[b - 1] + windows[b - 1]] = mix((prefix[x + LENGTH] - prefix[x]) * inverse[x])
        a = b
    return suffix, whole


def suffix_order(at: np.ndarray, ids: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes that begin at `at` by their first LENGTH bytes (of equals the
    smallest document first), and for each but the first whether it shares them with the one before."""
    word = _words(data)
    keys = [word[at + k].astype(np.uint64) for k in (*range(0, LENGTH - 7, 8), LENGTH - 8)]
    order = np.lexsort((ids, *keys[::-1]))
    shared = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        x = k[order]
        shared &= x[1:] == x[:-1]
    return order, shared


def repeated(ids: np.ndarray, windows: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each phrase (they lie one after another) the mask of its windows that a smaller document has."""
    if not len(ids):
        return np.zeros(0, np.uint32)
    begin = np.cumsum(windows + LENGTH - 1) - (windows + LENGTH - 1)
    hashed, whole = _hashes(data, begin, windows)
    place = np.cumsum(windows) - windows
    by = np.argsort(ids, kind="stable")  # so the first of equal phrases has the smallest document
    head, entry = _equal(whole[by], begin[by], windows[by], data)
    head = by[head]
    own = np.empty(len(by), np.int64)
    own[by] = entry
    # The dictionary: the distinct phrases and their suffixes of LENGTH bytes or more.
    n = windows[head]
    first = np.cumsum(n) - n
    phrase = np.repeat(np.arange(len(head)), n)
    within = np.arange(len(phrase)) - first[phrase]
    hashed = hashed[place[head][phrase] + within]
    order = np.argsort(hashed)
    twice = np.concatenate([[False], hashed[order][1:] == hashed[order][:-1]])
    twice[:-1] |= twice[1:]
    some = np.sort(order[twice])  # another suffix may share its LENGTH bytes
    hit = np.zeros(len(phrase), np.uint32)
    if len(some):
        owner = ids[head][phrase[some]]
        order, shared = suffix_order((begin[head][phrase] + within)[some], owner, data)
        start = np.flatnonzero(np.concatenate([[True], ~shared]))
        least = np.repeat(owner[order][start], np.diff(np.concatenate([start, [len(order)]])))
        hit[some[order[owner[order] > least]]] = 1
    mask = np.add.reduceat(hit << within.astype(np.uint32), first).astype(np.uint32)
    return np.where(ids > ids[head][own], np.uint32(0xFFFFFFFF), mask[own])


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, rows in _parts(batches):
        ids, windows, data = [], [], []
        for _, packed in rows:
            raw = _unpack(packed)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            ids.append(np.frombuffer(raw, np.int64, n, 8))
            windows.append(np.frombuffer(raw, np.uint8, n, 8 + 8 * n).astype(np.int64))
            data.append(np.frombuffer(raw, np.uint8, -1, 8 + 9 * n))
        mask = repeated(np.concatenate(ids), np.concatenate(windows), np.concatenate(data))
        out, at = [], 0
        for (block, _), i in zip(rows, ids, strict=True):
            out.append({"block": block, "part": part, "data": _pack(mask[at : at + len(i)].tobytes())})
            at += len(i)
        yield pa.RecordBatch.from_pylist(out, _SENT)


def covered(p: Phrases, d: Dictionary, masks: list[dict]) -> np.ndarray:
    """Which bytes of the block lie in a window that a smaller document has."""
    mask = np.zeros(len(d.first), np.uint32)
    for r in masks:
        mask[d.parts[r["part"]]] = np.frombuffer(_unpack(r["data"]), np.uint32)
    later = p.ids[p.doc[d.rows]] > p.ids[p.doc[d.first[d.entry]]]  # a smaller document of the block has the phrase
    own = np.where(later, np.uint32(0xFFFFFFFF), mask[d.entry])
    change = np.zeros(len(p.data) + 1, np.int32)
    for k in range(LENGTH - K + 1):
        hit = ((own >> np.uint32(k)) & np.uint32(1)).astype(bool) & (p.windows[d.rows] > k)
        at = p.first[d.rows[hit]] + k  # every window starts once, so these are distinct
        change[at] += 1
        change[at + LENGTH] -= 1
    return np.cumsum(change[:-1]) > 0


def _removed(parts: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                p = _block(row)
                gone = covered(p, Dictionary(p, row["shared"] or [], parts), row["masks"] or [])
                out = []
                for i, null, s, e in zip(p.ids.tolist(), p.none.tolist(), p.begin.tolist(), p.end.tolist(), strict=True):
                    own = gone[s:e]
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                    kept = p.data[s:e][~own].tobytes() if len(edge) else p.data[s:e].tobytes()
                    out.append((None if null else i, e - s, edge[::2], edge[1::2], hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
                    if len(out) == 2000:
                        yield _result(out, keep_text)
                        out = []
                yield _result(out, keep_text)

    return run


def _result(out: list[tuple], keep_text: bool) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.binary())
    names = ["doc_id", "n_bytes", "starts", "ends", "kept_sha256", "kept"]
    columns = list(zip(*out, strict=True)) or [()] * 6
    n = 6 if keep_text else 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:n], kinds, strict=False)], names=names[:n])


def _with(blocks: DataFrame, **sent: DataFrame) -> DataFrame:
    """blocks with the rows that came back for each, as an array a column."""
    out = blocks
    for name, rows in sent.items():
        own = rows.groupBy("block").agg(F.collect_list(F.struct("part", "data")).alias(name))  # one entry a part
        out = out.join(own.hint("shuffle_hash"), "block", "left")
    return out


def removed(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, starts and ends of the removed runs (bytes), kept_sha256, and kept if asked for."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    blocks_n, parts = max(8, -(-total // BLOCK)), max(8, -(-total // PART))
    spark = docs.sparkSession
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.execution.arrow.maxBytesPerBatch")}
    # Without adaptive planning the written blocks keep their partitioning, so that what comes
    # back is sent to them and they stay where they are. A batch is about one block.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BLOCK))
    try:
        dealt = checkpointed(map_arrow(rows, _dealt(blocks_n), TEXTS).repartition(blocks_n, "block"))
        blocks = dealt.groupBy("block").agg(F.collect_list(F.struct("ids", "sizes", "data")).alias("texts"))  # where they are
        shared = checkpointed(map_arrow(map_arrow(blocks, _triggers(parts), SENT).repartition(parts, "part"), _shared, SENT).repartition(blocks_n, "block"))
        masks = map_arrow(map_arrow(_with(blocks, shared=shared), _entries(parts), SENT).repartition(parts, "part"), _sorted, SENT)
        masks = checkpointed(masks.repartition(blocks_n, "block"))
        schema = "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept_sha256 string" + ", kept binary" * keep_text
        return checkpointed(map_arrow(_with(blocks, shared=shared, masks=masks), _removed(parts, keep_text), schema))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
