"""Archives (.npz) of patterns as a Spark data source that reads and writes them in ranges of rows.

An archive is a zip file of arrays. Where an array is stored as it is, its rows have fixed places,
so a file is dealt to as many tasks as it has PART bytes; where it is deflated, one task reads the
file through, a block of rows at a time. Texts of any length are a block of bytes and an array of
ends, so that neither reading nor writing needs room for the longest; arrays of texts of fixed
width and zlib texts are read too. Pickled arrays are refused.

    spark.dataSource.register(Archives)
    patterns.write.format("patterns_npz").mode("append").save(folder)
    spark.read.format("patterns_npz").load(folder)     # a file, a folder or several, by commas

Each task writes its rows to archives of its own, a collection and length of vectors a file, under
a hidden folder; they are moved to their places when all tasks have ended, so that a failed or
repeated task leaves nothing. Paths are those of a folder that driver and executors share, or of
any store that Arrow opens.
"""

from __future__ import annotations

import io
import json
import posixpath
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Keys under which archives hold vectors and texts, first found first taken (fixed values).
VECTORS, TEXTS = ("embeddings", "embs"), ("passages", "memories", "compressed_texts")
#: Companion files of a collection, which are no collections (fixed values).
COMPANIONS = ("_signatures.npz", "_brain.npy", "_manifest.json")
ROW = "collection string, idx long, text string, embedding array<float>, sign_words array<long>, dim int, link binary, meta map<string,string>"
SCHEMA = pa.schema([("collection", pa.string()), ("idx", pa.int64()), ("text", pa.string()), ("embedding", pa.list_(pa.float32())), ("sign_words", pa.list_(pa.int64())), ("dim", pa.int32()), ("link", pa.binary()), ("meta", pa.map_(pa.string(), pa.string()))])
#: Bytes of a file that one task reads, rows of a batch; bytes that a writing task holds, rows of a file.
PART, BATCH, HELD, FILE_ROWS = 32 << 20, 2000, 64 << 20, 1 << 16


class Member:
    """One array of an archive, whose rows are read by place, or in order where it is deflated."""

    def __init__(self, archive: Archive, info: zipfile.ZipInfo):
        self.archive, self.info, self.at = archive, info, 0
        self.stream = archive.zip.open(info)
        major = np.lib.format.read_magic(self.stream)
        read = np.lib.format.read_array_header_1_0 if major == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, fortran, self.dtype = read(self.stream)
        if self.dtype.hasobject:
            raise ValueError("pickled arrays are not read; their objects could run code")
        if fortran and len(self.shape) > 1:
            raise ValueError("arrays in column order have no rows to read")
        self.width = self.dtype.itemsize * int(np.prod(self.shape[1:], dtype=np.int64))
        self.start: int | None = None  # where the rows of a stored array are in the file
        if info.compress_type == zipfile.ZIP_STORED:
            archive.file.seek(info.header_offset + 26)
            name, extra = np.frombuffer(archive.file.read(4), "<u2").tolist()
            self.start = info.header_offset + 30 + name + extra + self.stream.tell()

    def __len__(self) -> int:
        return self.shape[0] if self.shape else 1

    def rows(self, first: int, last: int) -> np.ndarray:
        """The rows from first up to last; a deflated array is read through from those read before."""
        n = max(0, min(last, len(self)) - first)
        if self.start is not None:
            self.archive.file.seek(self.start + first * self.width)
            raw = self.archive.file.read(n * self.width)
        else:
            if first < self.at:
                self.__init__(self.archive, self.info)
            skip = (first - self.at) * self.width
            while skip:
                skip -= len(self.stream.read(min(skip, 1 << 20)))
            raw = self.stream.read(n * self.width)
            self.at = first + n
        return np.frombuffer(raw, self.dtype).reshape(n, *self.shape[1:]) if self.width else np.zeros((n, *self.shape[1:]), self.dtype)


class Archive:
    """An archive over an open file."""

    def __init__(self, file):
        self.file, self.zip = file, zipfile.ZipFile(file)
        self.held: dict[str, Member] = {}
        self.infos = {i.filename.removesuffix(".npy"): i for i in self.zip.infolist()}

    def __contains__(self, name: str) -> bool:
        return name in self.infos

    def __getitem__(self, name: str) -> Member:
        if name not in self.held:
            self.held[name] = Member(self, self.infos[name])
        return self.held[name]

    def first(self, names: tuple[str, ...]) -> str | None:
        return next((n for n in names if n in self), None)

    def value(self, name: str):
        """An array without dimensions, or the first entry of one."""
        return self[name].rows(0, 1).ravel()[0]

    @property
    def text_key(self) -> str | None:
        return "text_ends" if "text_ends" in self else self.first(TEXTS)

    def __len__(self) -> int:
        names = [n for n in (self.first(VECTORS), self.text_key, "sign_bits" if "sign_bits" in self else None) if n]
        return max((len(self[n]) for n in names), default=0)

    @property
    def splits(self) -> int:
        """Into how many ranges of rows the archive is worth cutting; 1 where one has to be read through."""
        names = {"embeddings", "embs", "passages", "memories", "compressed_texts", "text_ends", "text_bytes", "sign_bits", "hippocampus"}
        infos = [i for n, i in self.infos.items() if n in names]
        if any(i.compress_type != zipfile.ZIP_STORED for i in infos):
            return 1
        return max(1, min(len(self), -(-sum(i.file_size for i in infos) // PART)))

    def blob(self, name: str, first: int, last: int) -> list[bytes]:
        """Rows of a block of bytes with an array of ends."""
        ends = self[f"{name}_ends"].rows(max(first - 1, 0), last).astype(np.int64)
        ends = ends if first else np.concatenate([[0], ends])
        raw = self[f"{name}_bytes"].rows(int(ends[0]), int(ends[-1])).tobytes() if len(ends) else b""
        return [raw[a - ends[0] : z - ends[0]] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def texts(self, first: int, last: int) -> list[str | None]:
        key = self.text_key
        if key is None:
            return []
        if key == "text_ends":
            return [b[1:].decode() if b[:1] == b"+" else None for b in self.blob("text", first, last)]
        rows = self[key].rows(first, last)
        return [unpacked(x) for x in rows] if key == "compressed_texts" else [x.decode() if isinstance(x, bytes) else str(x) for x in rows.tolist()]

    def meta(self) -> list[dict]:
        """Metadata of all rows, where an archive has them in one text."""
        return [r if isinstance(r, dict) else {} for r in json.loads(str(self.value("per_pattern_meta")))]

    def metas(self, first: int, last: int) -> list[dict]:
        if "meta_ends" in self:
            return [json.loads(b or b"{}") for b in self.blob("meta", first, last)]
        if "per_pattern_meta" not in self:
            return []
        if not self["per_pattern_meta"].shape:
            return self.meta()[first:last]
        rows = (json.loads(str(x)) for x in self["per_pattern_meta"].rows(first, last))
        return [r if isinstance(r, dict) else {} for r in rows]

    def batches(self, name: str, first: int, last: int) -> Iterator[pa.RecordBatch]:
        """The patterns from first up to last; rows that a part lacks have null there."""
        vectors, n = self.first(VECTORS), len(self)
        signs = self["sign_bits"] if "sign_bits" in self else None
        dim = int(self.value("dim")) if "dim" in self else self[vectors].shape[1] if vectors and len(self[vectors]) else 8 * signs.shape[1] if signs is not None else 0
        name = str(self.value("collection")) if "collection" in self else name
        single = "per_pattern_meta" in self and not self["per_pattern_meta"].shape
        all_meta = self.meta() if single else None
        for a in range(first, min(last, n), BATCH):
            z = min(a + BATCH, last, n)
            pad = lambda xs, size=z - a: [*xs, *[None] * (size - len(xs))]
            v = self[vectors].rows(a, z).astype(np.float32) if vectors else np.zeros((0, 0), np.float32)
            bits = v > 0 if vectors and len(v) == z - a else None
            codes = [] if signs is None else np.unpackbits(signs.rows(a, z), axis=1)[:, :dim].astype(bool)
            words = _words(bits) if bits is not None else [w for part in (v > 0, codes[len(v) :]) if len(part) for w in _words(part)]
            links = self["hippocampus"].rows(a, z) if "hippocampus" in self else []
            idx = self["idx"].rows(a, z).tolist() if "idx" in self else list(range(a, z))
            meta = all_meta[a:z] if single else self.metas(a, z)
            flat = [{k: x if isinstance(x, str) else json.dumps(x) for k, x in m.items() if x is not None}.items() for m in meta]
            columns = ([name] * (z - a), idx, pad(self.texts(a, z)), pad(list(v)), [*words, *[[]] * (z - a - len(words))], [dim] * (z - a), pad([bytes(x) for x in links]), [list(m) for m in flat] + [[]] * (z - a - len(flat)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SCHEMA.types, strict=True)], schema=SCHEMA)


def _words(bits: np.ndarray) -> list[list[int]]:
    """Sign codes as 64-bit words, the first component the highest bit; a last word that is not full is right-aligned."""
    if not bits.size:
        return [[] for _ in bits]
    out = []
    for at in range(0, bits.shape[1], 64):
        part = bits[:, at : at + 64]
        packed = np.packbits(np.pad(part, ((0, 0), (64 - part.shape[1], 0))), axis=1)
        out.append(packed.reshape(-1).view(">i8"))
    return np.stack(out, 1).astype(np.int64).tolist()


def unpacked(raw) -> str:
    """A zlib text; what cannot be read becomes a fixed note."""
    try:
        return zlib.decompress(bytes(raw)).decode()
    except Exception:
        return "[decompress error]"


def rows_of(name: str, content: bytes) -> Iterator[tuple]:
    """The patterns of an archive that is in memory as a whole."""
    a = Archive(io.BytesIO(content))
    for b in a.batches(name, 0, len(a)):
        yield from zip(*(c.to_pylist() for c in b.columns[:-1]), map(dict, b.column("meta").to_pylist()), strict=True)


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def refuse_pickle(path: str) -> None:
    """Pickled collections can run code when read, so none is."""
    if path.endswith((".pkl", ".pickle")):
        raise ValueError("pickled collections are not read; convert them to .npz first")


@dataclass
class Range(InputPartition):
    path: str
    first: int
    last: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]

    def files(self) -> Iterator[str]:
        for path in self.paths:
            refuse_pickle(path)
            fs, inner = store(path)
            if fs.get_file_info(inner).type != pafs.FileType.Directory:
                yield path
                continue
            prefix = path[: len(path.rstrip("/")) - len(inner.rstrip("/"))]
            for f in sorted(fs.get_file_info(pafs.FileSelector(inner, recursive=True)), key=lambda f: f.path):
                hidden = any(part.startswith(("_", ".")) for part in f.path[len(inner) :].split("/"))
                if f.type == pafs.FileType.File and f.path.endswith(".npz") and not hidden and not f.path.endswith(COMPANIONS):
                    yield prefix + f.path

    def partitions(self) -> list[InputPartition]:
        """Ranges of rows; the arrays' headers are read for that, and no rows."""
        out = []
        for path in self.files():
            fs, inner = store(path)
            with fs.open_input_file(inner) as f:
                a = Archive(f)
                n, parts = len(a), a.splits
            out += [Range(path, n * k // parts, n * (k + 1) // parts) for k in range(parts)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, inner = store(partition.path)
        with fs.open_input_file(inner) as f:
            name = posixpath.basename(inner).removesuffix(".npz").removesuffix(".cart")
            yield from Archive(f).batches(name, partition.first, partition.last)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    @property
    def hidden(self) -> str:
        return f"{store(self.path)[1].rstrip('/')}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs = store(self.path)[0]
        fs.create_dir(self.hidden)
        held: dict[tuple[str, int], list[pa.Table]] = {}
        size: dict[tuple[str, int], int] = {}
        files: list[str] = []

        def flush(key: tuple[str, int]) -> None:
            rows = pa.concat_tables(held.pop(key))
            size.pop(key)
            for at in range(0, rows.num_rows, FILE_ROWS):
                files.append(f"{safe(key[0])}.{uuid.uuid4().hex}.cart.npz")
                with fs.open_output_stream(f"{self.hidden}/{files[-1]}") as f:
                    f.write(packed(key[0], key[1], rows.slice(at, FILE_ROWS)))

        for b in iterator:
            t = pa.Table.from_batches([b])
            names = t.column("collection").to_pylist()
            dims = pc.fill_null(pc.list_value_length(t.column("embedding")), 0).to_pylist()
            rows: dict[tuple[str, int], list[int]] = {}
            for i, key in enumerate(zip(names, dims, strict=True)):
                rows.setdefault((key[0] or "", key[1]), []).append(i)
            for key, at in rows.items():
                own = t.take(pa.array(at))
                held.setdefault(key, []).append(own)
                size[key] = size.get(key, 0) + own.nbytes
            while sum(size.values()) > HELD:
                flush(max(size, key=size.get))
        for key in list(held):
            flush(key)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, inner = store(self.path)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(inner)) if f.type == pafs.FileType.File and f.path.endswith(".npz")] if self.overwrite else []
        for m in messages:
            for f in m.files if m else ():
                fs.move(f"{self.hidden}/{f}", f"{inner.rstrip('/')}/{f}")
        for f in old:  # the new rows are there before the old ones go
            fs.delete_file(f)
        self._clear(fs)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(store(self.path)[0])

    def _clear(self, fs: pafs.FileSystem) -> None:
        if fs.get_file_info(self.hidden).type == pafs.FileType.Directory:
            fs.delete_dir(self.hidden)


def safe(name: str) -> str:
    return "".join(c if c.isalnum() or c in "-_ " else "_" for c in name) or "_"


def _ends(xs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(xs), np.uint8), np.cumsum([len(x) for x in xs], dtype=np.int64)


def packed(name: str, dim: int, rows: pa.Table) -> bytes:
    """An archive of rows of one collection, whose vectors are dim long; only what the rows have."""
    has = lambda c: c in rows.schema.names
    arrays: dict[str, np.ndarray] = {"collection": np.array(name), "dim": np.array(dim), "idx": rows.column("idx").to_numpy().astype(np.int64)}
    if dim:
        arrays["embeddings"] = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
        arrays["sign_bits"] = np.packbits(arrays["embeddings"] > 0, axis=1)
    texts = rows.column("text").to_pylist() if has("text") else [None] * rows.num_rows
    arrays["text_bytes"], arrays["text_ends"] = _ends([b"" if t is None else b"+" + t.encode() for t in texts])  # a sign before a text that is there
    if has("meta"):
        arrays["meta_bytes"], arrays["meta_ends"] = _ends([json.dumps(dict(m)).encode() if m else b"" for m in rows.column("meta").to_pylist()])
    links = rows.column("link").to_pylist() if has("link") else []
    if links and all(x is not None and len(x) == 64 for x in links):
        arrays["hippocampus"] = np.frombuffer(b"".join(links), np.uint8).reshape(-1, 64)
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


class Archives(DataSource):
    """spark.read / df.write .format("patterns_npz") after spark.dataSource.register(Archives)."""

    @classmethod
    def name(cls) -> str:
        return "patterns_npz"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        missing = {"collection", "idx", "embedding"} - set(schema.names)
        if missing:
            raise ValueError(f"archives need the columns {sorted(missing)}")
        return ArchiveWriter(self.options, overwrite)
