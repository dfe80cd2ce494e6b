"""Vector expressions; sums run in double precision, in order of the components."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keeps a zero vector's norm from dividing by zero (fixed value).
EPSILON = 1e-9
#: Shares of cosine and sign similarity in the blended score (fixed values).
COSINE_SHARE, SIGN_SHARE = 0.7, 0.3


def literal(v: Sequence[float]) -> Column:
    """A constant vector; as one text that the optimiser reads once, not as a literal a component."""
    return F.from_json(F.lit(json.dumps([float(x) for x in v])), "array<double>")


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + EPSILON) * (norm(b) + EPSILON))


def sign_words(a: Column) -> Column:
    """The sign code (a component above 0 is a 1, zero is a 0), 64 bits a word."""
    bits = F.transform(a, lambda x: (x > 0).cast("long"))
    words = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 64).cast("int"))
    return F.transform(words, lambda w: F.aggregate(F.slice(bits, w * 64 + 1, F.lit(64)), F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b)))


def sign_similarity(a: Column, b: Column, dim: Column | int) -> Column:
    """1 - differing bits / dim of two sign codes as words; dim is explicit, never guessed from the width."""
    differing = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return 1 - differing / (F.lit(dim) if isinstance(dim, int) else dim)


def blend(cos: Column, sign: Column) -> Column:
    """The blended score, or whichever of the two there is."""
    return F.coalesce(COSINE_SHARE * cos + SIGN_SHARE * sign, cos, sign)


def pixel_similarity(a: Column, b: Column) -> Column:
    """Equal cells / cells; 0 for different shapes."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), equal / F.size(a)).otherwise(F.lit(0.0))


def thermometer(a: Column, cells: int = 4096) -> Column:
    """Active cells of each component: min-max to a byte, byte / 255 of the cells; a flat vector has none."""
    lo, hi = F.array_min(a).cast("double"), F.array_max(a).cast("double")
    return F.transform(a, lambda x: F.when(hi - lo > EPSILON, F.floor(F.floor((x.cast("double") - lo) / (hi - lo) * 255) / 255 * cells)).otherwise(F.lit(0)).cast("int"))


def thermometer_decode(counts: Column, cells: int = 4096) -> Column:
    return F.transform(counts, lambda c: c / cells)


def rescale(a: Column) -> Column:
    """To [0, 1]; a constant vector becomes 0.5 throughout."""
    lo, hi = F.array_min(a).cast("double"), F.array_max(a).cast("double")
    return F.transform(a, lambda x: F.when(hi > lo, (x.cast("double") - lo) / (hi - lo)).otherwise(F.lit(0.5)))


def region_means(a: Column, regions: int) -> Column:
    """Means of equally long runs of the components."""
    size = F.floor(F.size(a) / regions).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(regions - 1)), lambda r: _sum(F.transform(F.slice(a, r * size + 1, size), lambda x: x.cast("double"))) / size)


def region_code(bits: Column) -> Column:
    """A 64-bit code of up to 64 values, a bit where the value is above 0.5."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR((x > 0.5).cast("long")))


def quantise_u4(weights: Column) -> Column:
    """Seven-bit weights to four bits each (shifted right by three), four to a number."""
    small = F.transform(weights, lambda w: F.shiftright(w.cast("int"), 3).bitwiseAND(F.lit(15)))
    groups = F.sequence(F.lit(0), F.floor((F.size(weights) - 1) / 4).cast("int"))
    return F.transform(groups, lambda g: F.aggregate(F.slice(small, g * 4 + 1, F.lit(4)), F.lit(0), lambda acc, x: F.shiftleft(acc, 4).bitwiseOR(x)))


def dequantise_u4(words: Column) -> Column:
    return F.flatten(F.transform(words, lambda w: F.transform(F.array(F.lit(12), F.lit(8), F.lit(4), F.lit(0)), lambda s: F.shiftleft(F.call_function("shiftright", w, s).bitwiseAND(F.lit(15)), 3))))


def hashed_embedder(dim: int = 64, prefix: str = "search_document: "):
    """A deterministic stand-in for a model: signed hashed words, normalised. Texts are cut at 8000 characters.

    Where all words cancel each other, the text as a whole picks the one component that is not zero.
    """
    import zlib

    def embed(text: str) -> np.ndarray:
        v = np.zeros(dim)
        whole = (prefix + text[:8000]).lower()
        for w in whole.split():
            h = zlib.crc32(w.encode())
            v[h % dim] += 1 if h >> 31 else -1
        if not v.any():
            v[zlib.crc32(whole.encode()) % dim] = 1
        return (v / np.linalg.norm(v)).astype(np.float32)

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: embed(t or "").tolist())

    return F.pandas_udf(run, "array<float>"), embed


def grid_embedding(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A fixed 128-number description of square colour grids: histograms, activity, symmetry; normalised."""
    for s in frames:
        out = []
        for f in s:
            side = int(len(f) ** 0.5)
            g = np.array(f, np.int64).reshape(side, side)
            background = np.bincount(g.ravel(), minlength=16).argmax()
            on = (g != background).astype(float)
            h = side // 2
            parts = [np.bincount(g.ravel(), minlength=16)[:16] / g.size]
            parts += [x.reshape(min(16, side), -1).mean(1) for x in (on.mean(1), on.mean(0))]
            parts += [np.bincount(q.ravel(), minlength=16)[:16] / max(q.size, 1) for q in (g[:h, :h], g[:h, h:], g[h:, :h], g[h:, h:])]
            parts += [np.array([(g == g[:, ::-1]).mean(), (g == g[::-1]).mean()])]
            v = np.concatenate(parts)[:128]
            v = np.pad(v, (0, 128 - len(v)))
            out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
        yield pd.Series(out)
