"""The texts of split collections: SQLite files beside the vectors, read by row number.

A split collection keeps its vectors or sign codes in an archive and its passages in a SQLite file
with a table passages (idx, passage, title, paper_id). Predicates on idx reach the files: of ten
million passages a top five reads five rows, by the primary key.

    heap = read_heap(spark, folder)                      # a file, or a folder of files
    heap.filter(F.col("idx").isin(3, 8))                 # WHERE idx IN (3, 8) in each file
    fetch(top, heap)                                     # the k results with their passages

Without such a predicate a file is dealt to tasks in ranges of its row numbers. Files are opened
read-only where they lie, so the folder is one that driver and executors share. As a sink the
source writes a file a task, moved to its place when all tasks have ended.
"""

from __future__ import annotations

import glob
import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

ROW = "idx long, passage string, title string, paper_id string"
_TABLE = "CREATE TABLE passages (idx INTEGER PRIMARY KEY, passage TEXT, title TEXT, paper_id TEXT)"
SCHEMA = pa.schema([("idx", pa.int64()), ("passage", pa.string()), ("title", pa.string()), ("paper_id", pa.string())])
#: Row numbers that one task reads, rows of a batch; row numbers that one statement names.
SPAN, BATCH, NAMED = 1 << 18, 2000, 500
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_SIGNS = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def local(path: str) -> str:
    """The path without file:; other stores cannot be opened by SQLite."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"SQLite opens files of mounted folders only, not {path}")
    return path.removeprefix("file://").removeprefix("file:")


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)


@dataclass
class Part(InputPartition):
    """Rows of a file: those named, or a range of row numbers (last not included); and further conditions on idx."""

    path: str
    first: int = 0
    last: int = 0
    ids: list[int] | None = None
    also: list[tuple[str, int]] = field(default_factory=list)


class HeapReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = local(options.get("path", ""))
        self.ids: set[int] | None = None
        self.also: list[tuple[str, int]] = []

    def files(self) -> list[str]:
        return sorted(f for e in ("db", "sqlite") for f in glob.glob(f"{glob.escape(self.path)}/*.{e}")) if os.path.isdir(self.path) else [self.path]

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.files():
            with _open(path) as c:
                low, high = c.execute("SELECT min(idx), max(idx) FROM passages").fetchone()
            if low is None:
                continue
            if self.ids is not None:
                ids = sorted(i for i in self.ids if low <= i <= high)
                out += [Part(path, ids=ids, also=self.also)] if ids else []
                continue
            for sign, x in self.also:
                low = max(low, x + (sign == ">")) if sign[0] == ">" else low
                high = min(high, x - (sign == "<")) if sign[0] == "<" else high
            out += [Part(path, a, min(a + SPAN, high + 1)) for a in range(low, high + 1, SPAN)]
        return out or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with _open(partition.path) as c:
            for where, values in _wheres(partition):
                rows = c.execute(f"SELECT idx, passage, title, paper_id FROM passages WHERE {where}", values)
                while some := rows.fetchmany(BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)


class PushingReader(HeapReader):
    """Spark takes such readers in sessions with PUSHDOWN on only."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what is said about idx; what is left goes back to Spark."""
        for f in filters:
            named = [f.value] if isinstance(f, EqualTo) and f.attribute == ("idx",) else list(f.value) if isinstance(f, In) and f.attribute == ("idx",) else None
            if named is not None:
                own = {int(x) for x in named if x is not None}
                self.ids = own if self.ids is None else self.ids & own
            elif type(f) in _SIGNS and f.attribute == ("idx",) and f.value is not None:
                self.also.append((_SIGNS[type(f)], int(f.value)))
            else:
                yield f


def _wheres(p: Part) -> Iterator[tuple[str, list[int]]]:
    also = "".join(f" AND idx {sign} ?" for sign, _ in p.also)
    more = [x for _, x in p.also]
    if p.ids is None:
        yield "idx >= ? AND idx < ?" + also, [p.first, p.last, *more]
        return
    for at in range(0, len(p.ids), NAMED):
        some = p.ids[at : at + NAMED]
        yield f"idx IN ({', '.join('?' * len(some))})" + also, [*some, *more]


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class HeapWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = local(options["path"]), overwrite, uuid.uuid4().hex

    @property
    def hidden(self) -> str:
        return f"{self.path.rstrip('/')}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.hidden, exist_ok=True)
        name, some = f"{uuid.uuid4().hex}.db", False
        with sqlite3.connect(f"{self.hidden}/{name}") as c:
            c.execute(_TABLE)
            for b in iterator:
                columns = [b.column(n).to_pylist() if n in b.schema.names else [None] * b.num_rows for n in SCHEMA.names]
                c.executemany("INSERT INTO passages VALUES (?, ?, ?, ?)", zip(*columns, strict=True))
                some = some or b.num_rows > 0
        c.close()
        return Written([name] if some else [])

    def commit(self, messages: list[Written | None]) -> None:
        old = glob.glob(f"{glob.escape(self.path)}/*.db") if self.overwrite else []
        for m in messages:
            for f in m.files if m else ():
                os.replace(f"{self.hidden}/{f}", f"{self.path}/{f}")
        for f in old:  # the new rows are there before the old ones go
            os.remove(f)
        shutil.rmtree(self.hidden, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)


class Heap(DataSource):
    """spark.read / df.write .format("patterns_sqlite") after spark.dataSource.register(Heap)."""

    @classmethod
    def name(cls) -> str:
        return "patterns_sqlite"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> HeapReader:
        return PushingReader(self.options) if self.options.get("pushdown") == "true" else HeapReader(self.options)

    def writer(self, schema, overwrite: bool) -> HeapWriter:
        if "idx" not in schema.names or "passage" not in schema.names:
            raise ValueError("a heap needs the columns idx and passage")
        return HeapWriter(self.options, overwrite)


@contextmanager
def pushing(spark: SparkSession) -> Iterator[None]:
    """Within it, predicates reach Python data sources; the session is as before then."""
    before = spark.conf.get(PUSHDOWN, None)
    spark.conf.set(PUSHDOWN, "true")
    try:
        yield
    finally:
        spark.conf.unset(PUSHDOWN) if before is None else spark.conf.set(PUSHDOWN, before)


def read_heap(spark: SparkSession, path: str) -> DataFrame:
    """idx, passage, title, paper_id. Predicates on idx reach the files where the session has PUSHDOWN on (pushing), else Spark filters."""
    spark.dataSource.register(Heap)
    on = (spark.conf.get(PUSHDOWN, "false") or "false").lower()
    return spark.read.format("patterns_sqlite").option("pushdown", on).load(path)


def fetch(top: DataFrame, heap: DataFrame) -> DataFrame:
    """top, the k best of a search (idx, ...), with the passages of a heap that predicates reach.

    top goes through the driver once, as its k row numbers become the predicate; k is a parameter
    of the search, not of the data. Results whose passage the heap lacks have nulls.
    """
    ids = [r.idx for r in top.select("idx").distinct().collect()]
    return top.join(F.broadcast(heap.filter(F.col("idx").isin(ids) if ids else F.lit(False))), "idx", "left")
