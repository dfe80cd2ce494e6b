"""Binary codecs as Arrow-batched functions: link records, compressed texts, grids."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: The 64-byte link record, little-endian (fixed format): pattern id, format, kind, previous,
#: next, sibling, source hash, sequence, time, flags, permissions, padding.
LINK = "<IBBIIIIHIBB34s"
FIELDS = ["pattern_id", "format_version", "kind", "prev", "next", "sibling", "source_hash", "sequence_num", "ts_unix", "flags", "perms_byte"]
LINK_TYPE = "pattern_id long, format_version int, kind int, prev long, next long, sibling long, source_hash long, sequence_num int, ts_unix long, flags int, perms_byte int"


def arrow(kind: str):
    """An Arrow-batched function of columns; its type is parsed when a session is there."""

    def wrap(f):
        return lambda *columns: F.pandas_udf(f, kind)(*columns)

    return wrap


@arrow("binary")
def pack_link(link: pd.DataFrame) -> pd.Series:
    """Links to 64 bytes; null pointers are 0."""
    rows = link[FIELDS].fillna(0).astype("int64").itertuples(index=False)
    return pd.Series([struct.pack(LINK, *r, b"") for r in rows])


@arrow(LINK_TYPE)
def unpack_link(raw: pd.Series) -> pd.DataFrame:
    """64 bytes to links, of both known forms; pointers of 0 are null."""
    out = pd.DataFrame([struct.unpack(LINK, bytes(r))[:-1] for r in raw], columns=FIELDS)
    for c in ("prev", "next", "sibling"):
        out[c] = out[c].astype("Int64").where(out[c] != 0)
    return out


@arrow("string")
def decompress(raw: pd.Series) -> pd.Series:
    """zlib texts; what cannot be read becomes a fixed note."""

    def one(b):
        try:
            return zlib.decompress(bytes(b)).decode()
        except Exception:
            return "[decompress error]"

    return raw.map(one)


@arrow("string")
def blake2(text: pd.Series) -> pd.Series:
    return text.map(lambda t: hashlib.blake2b(t.encode(), digest_size=32).hexdigest())


@arrow("string")
def compact_grid(cells: pd.Series) -> pd.Series:
    """Cells 0-15 to hex digits, two cells a byte, the first in the high half."""
    return cells.map(lambda c: "".join(f"{int(x) & 15:x}" for x in c))


@arrow("array<int>")
def expand_grid(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [int(x, 16) for x in t])


@arrow("string")
def fingerprint(first: pd.Series, last: pd.Series, n: pd.Series) -> pd.Series:
    """16 hex digits over the first and the last vector's bytes and the number of rows."""
    row = lambda v: np.array(v, np.float32).tobytes()
    return pd.Series([hashlib.sha256(row(a) + row(b) + str(k).encode()).hexdigest()[:16] for a, b, k in zip(first, last, n, strict=True)])
