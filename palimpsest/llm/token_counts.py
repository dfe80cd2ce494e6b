"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are taken in batches of about BATCH_BYTES. Each is split at boundaries that no token
of the vocabulary crosses: where a space follows something else, and, in what is longer than
LONG characters without one (scripts without spaces, encoded data), between two characters that
no token holds next to each other. So a long text is never encoded as one piece, and a segment
that came up before costs a look-up. The batch's new segments are encoded together. A
vocabulary that has no such boundary gets whole texts.

Null and empty texts have 0 tokens. Special strings inside texts are what the library makes
of them by default. Rows that repeat, or have a null id, are counted each; empty tables give no
rows; very long texts are counted whole. Other columns, whatever their names, are not read. The
cache of a worker holds CACHE segments of up to SHORT characters and is then emptied.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, spread

BATCH_BYTES = 1 << 20
CACHE, SHORT, LONG = 300_000, 128, 512
_LOADED: dict[str, Callable[[list[str]], list[int]]] = {}
#: Spaces and what follows them up to the next space.
_SEGMENT = re.compile(r" *[^ ]+| +")


class _Pieces:
    """Lengths under a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        self.safe = n.name == "identity" and n.add_dummy_prefix and not n.remove_extra_whitespaces and not m.trainer_spec.treat_whitespace_as_suffix and not any(re.search("[^▁]▁", p.piece) for p in m.pieces)
        self.cache: dict[str, int] = {}
        pieces = [p.piece for p in m.pieces]
        # Unknown characters next to each other may be one token, so both sides of a boundary must be known.
        self.known = {p for p in pieces if len(p) == 1}
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}

    def _parts(self, segment: str) -> tuple[list[str], list[str]]:
        """Texts whose counts, less those of the second list, make the segment's.

        A part after the first is encoded behind the character before it, as the model would
        put a space before it else; that character's own count is taken off again.
        """
        if len(segment) <= LONG:
            return [segment], []
        more, less, begin, lead = [], [], 0, ""
        while begin < len(segment):
            stop = begin + LONG
            while stop < len(segment) and (segment[stop - 1 : stop + 1] in self.joined or segment[stop - 1] not in self.known or segment[stop] not in self.known):
                stop += 1
            more.append(lead + segment[begin:stop])
            less += [lead] * bool(lead)
            begin, lead = stop, segment[stop - 1 : stop]
        return more, less

    def _segments(self, text: str) -> list[str]:
        """Segments as the model is given them: it puts a space before each by itself."""
        if "\u2581" in text:
            return [text]  # the model's own sign for a space: nothing is known to be safe
        if text[0] != " " and text[-1] != " " and "  " not in text:
            return text.split(" ")
        parts = _SEGMENT.findall(text)
        return [parts[0], *(p[1:] for p in parts[1:])]

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        cache = self.cache
        split = [self._segments(t) if t else [] for t in texts]
        less: list[list[str]] = [[] for _ in texts]
        for i, segments in enumerate(split):
            if any(len(s) > LONG for s in segments):
                parts = [self._parts(s) for s in segments]
                split[i], less[i] = [x for more, _ in parts for x in more], [x for _, off in parts for x in off]
        new = {s for segments in (*split, *less) for s in segments if s not in cache}
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = {s for segments in (*split, *less) for s in segments}
        new.discard("")
        order = list(new)
        for s, ids in zip(order, self.model.encode(order, num_threads=1) if order else [], strict=True):
            cache[s] = len(ids)
        if "" not in cache:
            cache[""] = len(self.model.encode("a ")) - len(self.model.encode("a"))  # a space that ends a text
        out = [sum(map(cache.__getitem__, segments)) - sum(map(cache.__getitem__, off)) for segments, off in zip(split, less, strict=True)]
        for s in order:
            if len(s) > SHORT:
                del cache[s]
        return out


class _Json:
    """Lengths under a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode_batch(texts, add_special_tokens=False)]


def lengths(path: str) -> Callable[[list[str]], list[int]]:
    """The function that counts under the vocabulary file; loaded once in a worker."""
    if path not in _LOADED:
        _LOADED[path] = _Pieces(path) if path.endswith(".model") else _Json(path)
    return _LOADED[path]


def _by_bytes(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Slices whose texts have `most` bytes, or are one."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text").cast(pa.string())), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, stop - at)
            at = stop


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = lengths(path)
        for b in _by_bytes(batches, BATCH_BYTES):
            texts = ["" if t is None else t for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(count(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_arrow(spread(docs.select("doc_id", "text")), _counter(path), f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
