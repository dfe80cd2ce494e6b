"""Delta polling of activity as a streaming source whose offset is the `since` of the next poll.

    spark.dataSource.register(Activity)
    events = spark.readStream.format("activity").option("types", "store,copy").load(folder)

The store is a folder of Parquet files with created_at and event_id, to which writers add files. A
batch holds the events strictly newer than the cursor, up to the newest there is as the batch
begins; its order is (created_at, event_id), so that of events of one moment that arrive apart none
is lost or repeated as long as their ids grow. Files and row groups whose statistics say that they
are older are not read. The cursor is the source's offset: a query that starts again from its
checkpoint polls on from there, and a batch that is run again holds the same events.

Options: path; since (an ISO time, with which the first poll begins); types (names by commas);
pack (one pack's events alone).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.archives import store

ROW = "pack string, event_id long, event_type string, summary string, agent_label string, created_at timestamp"
NAMES = [x.split(" ")[0] for x in ROW.split(", ")]
TYPES = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.timestamp("us", "UTC"))
#: Microseconds that every resolution of a column of times can hold; statistics are asked within them only.
HELD = 9_200_000_000_000_000


def _micros(text: str) -> int:
    at = dt.datetime.fromisoformat(text)
    return round((at if at.tzinfo else at.replace(tzinfo=dt.UTC)).timestamp() * 1_000_000)


@dataclass
class File(InputPartition):
    path: str
    after: tuple[int, int]
    upto: tuple[int, int]


class Poll(DataSourceStreamReader):
    """An offset is {"at": microseconds, "id": event_id}, the place of the last event that was given out."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.since = _micros(options["since"]) if options.get("since") else -(2**62)
        self.types = [t.strip() for t in options.get("types", "").split(",") if t.strip()]
        self.pack = options.get("pack")

    def initialOffset(self) -> dict:
        return {"at": self.since, "id": 2**62}  # strictly newer: no id of that moment is above it

    def latestOffset(self) -> dict:
        """The place of the newest event that there is."""
        begin = self.initialOffset()
        at, i = max([(begin["at"], begin["id"]), *(p for f in self._files() if (p := self._last(f)) is not None)])
        return {"at": at, "id": i}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, upto = (start["at"], start["id"]), (end["at"], end["id"])
        return [File(f, after, upto) for f in self._files()] if upto > after else []

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        """The file's events after one place, up to another."""
        data = self._dataset(partition.path)
        names = [n for n in NAMES if n in data.schema.names]
        keep, at = self._wanted(), ds.field("created_at")
        for bound, low in ((partition.after, True), (partition.upto, False)):
            if abs(bound[0]) < HELD:
                edge = pa.scalar(bound[0], pa.timestamp("us", data.schema.field("created_at").type.tz))
                keep = keep & (at >= edge if low else at <= edge)
        for b in data.scanner(columns=names, filter=keep, batch_size=5000).to_batches():
            micros, ids = _time(b), b.column("event_id").cast(pa.int64())
            beyond = lambda place: pc.or_(pc.greater(micros, place[0]), pc.and_(pc.equal(micros, place[0]), pc.greater(ids, place[1])))  # noqa: B023, E731
            some = b.filter(pc.and_not(beyond(partition.after), beyond(partition.upto)))
            own = {n: some.column(n) if n in names else pa.nulls(some.num_rows, pa.string()) for n in NAMES}
            own["created_at"] = _time(some)
            yield pa.RecordBatch.from_arrays([own[n].cast(k) for n, k in zip(NAMES, TYPES, strict=True)], names=NAMES)

    def commit(self, end: dict) -> None:
        """Events stay in the store; other readers have cursors of their own."""

    def _files(self) -> list[str]:
        fs, inner = store(self.path)
        if fs.get_file_info(inner).type != pafs.FileType.Directory:
            return []
        found = fs.get_file_info(pafs.FileSelector(inner, recursive=True))
        return sorted(f.path for f in found if f.path.endswith(".parquet") and not f.path[len(inner) :].lstrip("/").startswith(("_", ".")))

    def _dataset(self, path: str) -> ds.Dataset:
        return ds.dataset(path, filesystem=store(self.path)[0], format="parquet")

    def _wanted(self):
        keep = ds.field("created_at").is_valid() & ds.field("event_id").is_valid()
        if self.types:
            keep = keep & ds.field("event_type").isin(self.types)
        return keep & (ds.field("pack") == self.pack) if self.pack is not None else keep

    def _last(self, path: str) -> tuple[int, int] | None:
        """The place of the newest wanted event of a file, whose columns of places alone are read."""
        best = None
        for b in self._dataset(path).scanner(columns=["created_at", "event_id"], filter=self._wanted()).to_batches():
            if b.num_rows:
                micros = _time(b)
                top = pc.max(micros)
                place = top.as_py(), int(pc.max(b.column("event_id").filter(pc.equal(micros, top))).as_py())
                best = place if best is None else max(best, place)
        return best


def _time(b: pa.RecordBatch) -> pa.Array:
    """created_at in microseconds."""
    at = b.column("created_at")
    return pc.cast(at, pa.timestamp("us", at.type.tz), safe=False).cast(pa.int64())


class Activity(DataSource):
    """spark.readStream.format("activity") after spark.dataSource.register(Activity)."""

    @classmethod
    def name(cls) -> str:
        return "activity"

    def schema(self) -> str:
        return ROW

    def streamReader(self, schema) -> Poll:
        return Poll(self.options)
