"""Best-fit packing by bin completion.

Texts are encoded, an end token added, and documents over the capacity cut into pieces of
the capacity (the first may be shorter). Only the number of pieces of each length, at most
`capacity` numbers whatever the input, goes to the driver, where bin completion plans the
sequences. Around the longest piece left it enumerates undominated fillings of the rest, those
of least waste first and led to them by the sums that the pieces left can make. It branches
over the fillings and over how often each is used, from as often as the counts allow downwards,
and prunes by the waste and the lower bound of a packing that would be better than the best
known, at first best-fit decreasing. `Search` bounds the search; without bounds (EXACT) it is
complete, as dominated fillings and orders of the same sequences are all that it leaves out.
It ends where the lower bound is met. Pieces are then numbered within their length, by buckets
of a hash so that no task holds a length, and their number gives sequence and offset.

A null text is empty; an empty text is its end token alone. Empty tables give no rows.
Rows that repeat an id are packed each, and so are rows with a null id. Very long texts are
encoded whole. Which of several pieces of one length takes which place follows a hash of id
and text, so ties do not change the plan. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import buckets_for, checkpointed, draw, map_arrow, running, slices, spread

CAPACITY, END = 1024, 2
#: Letters and signs on which all regex engines agree; other texts go to the slower library.
_PLAIN = re.compile("[^\x00-\x7f\xa1-ɏ‐-‧‰-›€]")
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Ids under a byte-level BPE tokenizers file, without added special tokens.

    Where the file's merges are its ids in order, a faster library that works by ranks gives
    the same ids; it takes the texts whose characters leave no doubt.
    """

    def __init__(self, path: str):
        import json

        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = self._ranked(spec)

    @staticmethod
    def _ranked(spec: dict):
        pre, model = spec["pre_tokenizer"], spec["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        plain = spec["normalizer"] is None and pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]
        special = {t["id"] for t in spec["added_tokens"]}
        if not plain or any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        import public_tokenizers
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = (b for b in range(256) if b not in shown)
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if i not in special}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def slow(self):
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return self.library

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and (text.isascii() or not _PLAIN.search(text)) and not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cuts(n: int, capacity: int) -> list[int]:
    """Where the pieces of a document of n ids begin."""
    first = n - (n - 1) // capacity * capacity
    return [0, *range(first, n, capacity)]


def _encode(path: str, capacity: int, end: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in slices(batches):
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end))
                starts = cuts(len(ids), capacity)
                for piece, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    raw = ids[s:e]
                    for column, x in zip(out, (doc_id, piece, s, e - s, zlib.crc32(raw.tobytes()), raw.astype(np.int32) if keep_ids else None), strict=True):
                        column.append(x)
                if len(out[0]) >= 4096:
                    yield _pieces(b, out, keep_ids)
                    out = [[], [], [], [], [], []]
            yield _pieces(b, out, keep_ids)

    return run


def _pieces(b: pa.RecordBatch, out: list[list], keep_ids: bool) -> pa.RecordBatch:
    kinds = (b.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    n = 6 if keep_ids else 5
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out[:n], kinds, strict=False)], names=names[:n])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of the pieces of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return map_arrow(spread(docs.select("doc_id", "text")), _encode(path, capacity, end, keep_ids), schema)


Plan = list[tuple[tuple[int, ...], int]]


@dataclass(frozen=True)
class Search:
    """Fillings looked at around one piece, and nodes of a pass; None: no bound.

    Passes differ in the order of fillings: those of at most so much waste (`tolerances`) come
    first, the ones with the longest pieces before others, which leaves short pieces for the end.
    """

    fillings: int | None = 4
    nodes: int | None = 1200
    tolerances: tuple[int, ...] = (8, 2, 16)


EXACT = Search(None, None, (0,))


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: by total size, and by pieces too long to share one."""
    n = np.arange(capacity + 1)
    c, s = (np.concatenate([[0], np.cumsum(x)]) for x in (counts, counts * n))  # of lengths below
    half = capacity // 2
    a = n[1 : half + 1]
    alone, large = c[-1] - c[capacity - a + 1], c[capacity - a + 1] - c[half + 1]
    room = large * capacity - (s[capacity - a + 1] - s[half + 1])
    rest = s[half + 1] - s[a] - room
    return max(int((alone + large + np.maximum(0, -(-rest // capacity))).max(initial=0)), -(-int(s[-1]) // capacity))


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> Plan:
    """Longest pieces first, each where it leaves least room; equal sequences are handled together."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            r = min((r for r in room if r >= length), default=None)
            if r is None:
                each = capacity // length
                full, over = divmod(left, each)
                for k, times in ((each, full), (over, 1)):
                    if k and times:
                        room.setdefault(capacity - k * length, []).append(((length,) * k, times))
                break
            held, times = room[r].pop()
            if not room[r]:
                del room[r]
            k = min(times, left)
            if times > k:
                room.setdefault(r, []).append((held, times - k))
            room.setdefault(r - length, []).append(((*held, length), k))
            left -= k
    return [x for xs in room.values() for x in xs]


def _dominated(f: tuple[int, ...], by: tuple[int, ...]) -> bool:
    """Whether the pieces of f fit, in groups, into the pieces of `by`: then `by` is no worse."""
    if f == by or len(f) > 12:
        return False
    room = list(by)

    def fit(i: int) -> bool:
        if i == len(f):
            return True
        tried = set()
        for k, r in enumerate(room):
            if f[i] <= r and r not in tried:
                tried.add(r)
                room[k] -= f[i]
                if fit(i + 1):
                    return True
                room[k] += f[i]
        return False

    return fit(0)


class Sums:
    """The sums that pieces of the smallest lengths can make, as bits; kept while counts stay."""

    def __init__(self, capacity: int):
        self.capacity, self.mask = capacity, (1 << capacity + 1) - 1
        self.known: list[tuple[int, int]] = []
        self.reach = [1]  # reach[j]: with the j smallest lengths

    def of(self, counts: np.ndarray, most: int) -> tuple[list[int], list[int]]:
        """The lengths up to most that are left, and how many of each could share a sequence."""
        lengths = np.flatnonzero(counts[: most + 1])
        many = np.minimum(counts[lengths], self.capacity // np.maximum(lengths, 1))
        now = list(zip(lengths.tolist(), many.tolist(), strict=True))
        same = next((i for i, (x, y) in enumerate(zip(now, self.known, strict=False)) if x != y), min(len(now), len(self.known)))
        del self.reach[same + 1 :]
        bits = self.reach[-1]
        for length, left in now[same:]:
            k = 1
            while left:
                k = min(k, left)
                bits |= bits << length * k & self.mask
                left, k = left - k, 2 * k
            self.reach.append(bits)
        self.known = now
        return lengths.tolist(), many.tolist()


def fillings(counts: np.ndarray, space: int, most_waste: int, sums: Sums, most: int | None = None, tolerance: int = 0) -> list[tuple[int, ...]]:
    """Undominated sets of the pieces left that fill space: of a waste within the tolerance those
    with the longest pieces first, then by waste. most: so many in all, and its share of each waste."""
    if space <= 0 or not counts[: space + 1].any():
        return [()] if space <= most_waste else []
    if counts[space]:
        return [(space,)]  # a perfect single piece dominates every other filling
    lengths, many = sums.of(counts, space)
    reach = sums.reach

    def exactly(j: int, total: int, held: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        """Sets of the j smallest lengths that make total."""
        if not total:
            yield held
            return
        for i in range(bisect_right(lengths, total, 0, j) - 1, -1, -1):
            if not reach[i + 1] >> total & 1:
                return  # nor can fewer lengths make it
            length = lengths[i]
            for k in range(min(many[i], total // length), 0, -1):
                if reach[i] >> total - k * length & 1:
                    yield from exactly(i, total - k * length, held + (length,) * k)

    kept: list[tuple[int, ...]] = []
    found: list[tuple[int, ...]] = []
    each = most and -(-most // (tolerance + 1))
    for waste in range(min(space, most_waste) + 1):
        if most and waste > tolerance and found:
            break
        if any(counts[x] * x > space for x in lengths if x <= waste):
            break  # from here on another piece always fits
        here = 0
        for looked, f in enumerate(exactly(len(lengths), space - waste, ())):
            if each and looked == 4 * each:
                break
            if any(n > f.count(x) for x, n in zip(lengths, many, strict=True) if x <= waste):
                continue  # another piece fits
            found.append(f)
            here += 1
            if here == each:
                break
        if waste >= tolerance and found:
            for f in sorted(found, reverse=True) if waste == tolerance or most else found:
                if not any(_dominated(f, k) for k in kept):
                    kept.append(f)
                    if len(kept) == most:
                        return kept
            found = []
    for f in sorted(found, reverse=True):
        if len(kept) != most and not any(_dominated(f, k) for k in kept):
            kept.append(f)
    return kept


def bin_completion(counts: np.ndarray, capacity: int = CAPACITY, search: Search = Search()) -> Plan:
    """A packing of counts[length] pieces of each length into as few sequences as the search finds."""
    counts = counts.astype(np.int64)
    total = int((counts * np.arange(capacity + 1)).sum())
    if not total:
        return []
    best = best_fit_decreasing(counts, capacity)
    fewest, least = sum(t for _, t in best), lower_bound(counts, capacity)
    sums, seen = Sums(capacity), {}  # seen: the fewest sequences with which the same pieces were left

    def options(tolerance: int, left: np.ndarray, plan: Plan, waste: int, used: int, banned: frozenset) -> Iterator[tuple]:
        """The nodes below one; banned: fillings of its longest piece that were used as often as they are to be."""
        longest = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[longest] -= 1
        allowed = (fewest - 1) * capacity - total - waste  # of a packing that would be better
        for f in fillings(rest, capacity - longest, allowed, sums, search.fillings and search.fillings + len(banned), tolerance):
            held = (longest, *f)
            if held in banned:
                continue
            per = {x: held.count(x) for x in held}
            lost = capacity - sum(held)
            most = min(int(left[x]) // k for x, k in per.items())
            perfect = not lost and len(held) <= 2  # no packing is worse for such pairs
            for times in (most,) if perfect else range(most, 0, -1):
                if waste + lost * times > (fewest - 1) * capacity - total:
                    continue
                after = left.copy()
                for x, k in per.items():
                    after[x] -= k * times
                yield after, [*plan, (held, times)], waste + lost * times, used + times, banned | {held} if after[longest] else frozenset()

    for tolerance in search.tolerances:
        stack, nodes = [iter([(counts, [], 0, 0, frozenset())])], 0
        seen.clear()
        while stack and fewest > least and nodes != search.nodes:
            node = next(stack[-1], None)
            if node is None:
                stack.pop()
                continue
            left, plan, waste, used, banned = node
            nodes += 1
            if not left.any():
                if used < fewest:
                    best, fewest = plan, used
                continue
            state = left.tobytes() + repr(sorted(banned)).encode() * bool(banned)
            if seen.get(state, fewest) <= used or used + lower_bound(left, capacity) >= fewest:
                continue
            seen[state] = used
            stack.append(options(tolerance, left, plan, waste, used, banned))
    return best


def places(plan: Plan) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first numbers of its runs, and each run's first sequence, pieces a sequence, offset."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    number: dict[int, int] = {}
    base = 0
    for held, times in plan:
        offset = 0
        for length in sorted(set(held), reverse=True):
            k = held.count(length)
            runs.setdefault(length, []).append((number.get(length, 0), base, k, offset))
            number[length] = number.get(length, 0) + k * times
            offset += k * length
        base += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


def _placed(by_length: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_n"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, base, k, off = by_length[int(x)]
                r = np.searchsorted(first, number[at], "right") - 1
                j = number[at] - first[r]
                sequence[at] = base[r] + j // k[r]
                offset[at] = off[r] + j % k[r] * x
            kept = [c for c in b.schema.names if c != "_n"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False, search: Search = Search()) -> DataFrame:
    """The pieces of docs with sequence_id and offset."""
    cut = checkpointed(pieces(docs, path, capacity, end, keep_ids))
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # one row a length: `capacity` at most
        counts[r["length"]] = r["count"]
    by_length = places(bin_completion(counts, capacity, search))
    key = F.concat_ws(":", F.col("doc_id").cast("string"), "piece", "start", "ids_crc32")
    numbered = running(cut.withColumn("_h", draw(key, "pack")), "length", "_h", ["doc_id", "piece", "start", "ids_crc32"], F.lit(1).cast("long"), buckets_for(int(counts.sum())), "_n")
    numbered = numbered.drop("_h").withColumn("_n", F.col("_n") - 1).select(*cut.columns, "_n")
    schema = StructType([*cut.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return map_arrow(numbered, _placed(by_length), schema)
