"""Collections that several processes append to: segments of rows under a log of numbered commits.

    book = Ledger(spark, folder)
    book.append(rows, agent="alice")         # rows: collection, text, ...; idx or place
    book.read()                              # all committed rows with their idx
    book.manifest()                          # collection, n_patterns, dim, fingerprint: out of the log alone

An append writes its rows to a segment of its own, which nobody reads yet, sums them up (rows, first
and last vector of each collection; only the new rows are read), and then makes the next file of the
log, if nobody else has made it before; else it numbers its rows anew after those that came between,
and tries the number after. So no writer waits for another, none is lost, a writer that dies leaves
rows that are never seen, and readers see whole appends or nothing. Manifests are merged out of
the commits' sums; what is stored is not read again.

Rows have their idx, or a `place` (0, 1, 2, ... within each collection of the append), to which the
number of rows committed before is added. The log's folder and the driver's view of it must be one
that can make a file only if it is absent: local and mounted folders by hard links, others by Hadoop's rename.

`SharedLock` is a lease for what must not run twice at a time; it holds among processes, too.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.runtime import checkpointed, ship

COMMIT = "version long, segment string, agent string, at double, numbered boolean, collections array<struct<collection:string,n:long,base:long,low:long,high:long,first:array<float>,last:array<float>>>"
TRIES = 1000


class Log:
    """Numbered files of a folder, each made by one writer only."""

    def __init__(self, spark: SparkSession | None, folder: str):
        self.spark, self.folder = spark, folder
        self.local = "://" not in folder or folder.startswith("file://")
        self.path = folder.removeprefix("file://").removeprefix("file:") if self.local else folder
        if self.local:
            os.makedirs(self.path, exist_ok=True)

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        """The numbers' files in order."""
        if self.local:
            found = os.listdir(self.path)
        else:
            path, fs = self._fs()
            found = [s.getPath().getName() for s in fs.listStatus(path(self.path))] if fs.exists(path(self.path)) else []
        return sorted(n for n in found if n[0].isdigit())

    def latest(self) -> int:
        names = self.names()
        return int(names[-1].split(".")[0]) if names else 0

    def read(self, name: str) -> dict:
        if self.local:
            with open(f"{self.path}/{name}", encoding="utf-8") as f:
                return json.load(f)
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first().value)

    def make(self, name: str, content: dict) -> bool:
        """The file with its content, whole, if there is none of that name; whether it was made."""
        text = json.dumps(content)
        hidden = f"{self.path}/_{uuid.uuid4().hex}"
        if self.local:
            with open(hidden, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(hidden, f"{self.path}/{name}")
                return True
            except FileExistsError:
                return False
            finally:
                os.remove(hidden)
        path, fs = self._fs()
        out = fs.create(path(hidden), False)
        out.write(text.encode())
        out.close()
        jvm = self.spark.sparkContext._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(hidden).toUri()).rename(path(hidden), path(f"{self.path}/{name}"), none)
            return True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(path(hidden), False)
            return False


def _name(version: int) -> str:
    return f"{version:020d}.json"


def sums(rows: DataFrame, number: str) -> DataFrame:
    """collection, n, low, high, first, last: what merges into a manifest, of rows numbered by a column."""
    v = "embedding" if "embedding" in rows.columns else None
    end = lambda f: (f(F.col(v), F.col(number)) if v else F.lit(None)).cast("array<float>")
    return rows.groupBy("collection").agg(F.count("*").alias("n"), F.min(number).alias("low"), F.max(number).alias("high"), end(F.min_by).alias("first"), end(F.max_by).alias("last"))


def merged(parts: DataFrame) -> DataFrame:
    """collection, n_patterns, dim, fingerprint out of sums of parts (their numbers low and high are idx)."""
    ship(parts.sparkSession)
    out = parts.groupBy("collection").agg(F.sum("n").alias("n_patterns"), F.min_by("first", "low").alias("_a"), F.max_by("last", "high").alias("_b"))
    return out.select("collection", "n_patterns", F.size("_a").alias("dim"), F.when(F.col("_a").isNotNull(), codec.fingerprint("_a", "_b", "n_patterns")).alias("fingerprint"))


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Log(spark, f"{self.path}/log")

    def append(self, rows: DataFrame, agent: str = "") -> int:
        """Commits rows as one append and gives its number. The driver holds a row a collection of the append."""
        number = "idx" if "idx" in rows.columns else "place"
        segment = f"s{uuid.uuid4().hex}"
        at = f"{self.path}/rows/segment={segment}"
        rows.write.parquet(at)
        own = [r.asDict(recursive=True) for r in sums(self.spark.read.parquet(at), number).collect()]
        if number == "place" and any(c["low"] != 0 or c["high"] != c["n"] - 1 for c in own):
            raise ValueError("places are 0, 1, 2 and so on within each collection")
        base: dict[str, int] = {}
        seen = 0
        for _ in range(TRIES):
            latest = self.log.latest()
            if number == "place" and latest > seen:  # what others have committed meanwhile
                held = self.commits().filter(F.col("version") > seen).select(F.explode("collections").alias("c"))
                held = held.groupBy("c.collection").agg(F.sum("c.n").alias("n")).filter(F.col("collection").isin([c["collection"] for c in own]))
                for r in held.collect():
                    base[r.collection] = base.get(r.collection, 0) + r.n
                seen = latest
            listed = [{**c, "base": base.get(c["collection"], 0) if number == "place" else 0} for c in own]
            if self.log.make(_name(latest + 1), {"version": latest + 1, "segment": segment, "agent": agent, "at": time.time(), "numbered": number == "idx", "collections": listed}):
                return latest + 1
        raise TimeoutError(f"{self.path}: other writers were first {TRIES} times")

    def commits(self) -> DataFrame:
        """A row a commit; their files are read as Spark reads any."""
        names = self.log.names()
        if not names:
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).option("pathGlobFilter", "[0-9]*.json").json(self.log.folder)

    def _parts(self) -> DataFrame:
        return self.commits().select("version", "segment", "agent", "at", F.explode("collections").alias("c")).select("version", "segment", "agent", "at", "c.*")

    def read(self) -> DataFrame:
        """All rows that are committed, with idx, agent and version; rows of collections without commits are not there."""
        if not self.log.names():
            raise ValueError(f"nothing has been committed to {self.path}")
        parts = self._parts().select("segment", "collection", "base", "agent", "version")
        rows = self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/rows").join(parts, ["segment", "collection"])
        place = F.col("place") + F.col("base") if "place" in rows.columns else F.lit(None)
        idx = F.coalesce(F.col("idx"), place) if "idx" in rows.columns else place
        return rows.withColumn("idx", idx.cast("long")).drop("segment", "base", "place")

    def manifest(self) -> DataFrame:
        """collection, n_patterns, dim, fingerprint, from the log alone."""
        return merged(self._parts().select("collection", "n", (F.col("low") + F.col("base")).alias("low"), (F.col("high") + F.col("base")).alias("high"), "first", "last"))

    def rows(self, collection: str) -> int:
        """How many rows of a collection are committed."""
        return self._parts().filter(F.col("collection") == collection).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def first(self, version: int, collection: str) -> int:
        """The idx of a commit's first row of a collection."""
        own = next(c for c in self.log.read(_name(version))["collections"] if c["collection"] == collection)
        return own["base"] + own["low"]

    def writers(self, n: int) -> DataFrame:
        """collection, agent, rows of each collection's last n appends."""
        from pyspark.sql import Window

        own = Window.partitionBy("collection").orderBy(F.col("version").desc())
        last = self._parts().withColumn("_k", F.row_number().over(own)).filter(F.col("_k") <= n)
        return last.groupBy("collection", "agent").agg(F.sum("n").alias("rows"))

    def snapshot(self) -> DataFrame:
        """read(), kept as it is now."""
        return checkpointed(self.read())


@dataclass
class SharedLock:
    """A lock under a lease among all who see its folder. Who waits longer than a timeout gives up; a lease that is over is taken over."""

    folder: str
    lease: float = 30.0
    spark: SparkSession | None = None

    def __post_init__(self) -> None:
        self.log = Log(self.spark, self.folder)

    def _now(self) -> tuple[int, str | None]:
        """The latest claim's number, and who holds it; None where it was released or its lease is over."""
        names = self.log.names()
        if not names:
            return 0, None
        n = int(names[-1].split(".")[0])
        claim = self.log.read(_name(n))
        over = f"{n:020d}.released" in names or time.time() - claim["at"] > claim["lease"]
        return n, None if over else claim["agent"]

    @property
    def agent(self) -> str | None:
        return self._now()[1]

    def acquire(self, agent: str, timeout: float = 5.0) -> bool:
        end, wait = time.monotonic() + timeout, 0.005
        while True:
            n, holder = self._now()
            if holder is None and self.log.make(_name(n + 1), {"agent": agent, "at": time.time(), "lease": self.lease}):
                return True
            if time.monotonic() >= end:
                return False
            time.sleep(min(wait, max(0.0, end - time.monotonic())))
            wait = min(2 * wait, 0.25)

    def release(self, agent: str) -> None:
        n, holder = self._now()
        if holder is None:
            return
        if holder != agent:
            raise PermissionError(f"held by {holder}, not by {agent}")
        self.log.make(f"{n:020d}.released", {"agent": agent, "at": time.time()})
