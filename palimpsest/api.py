"""Sessions over collections: the engine's operations under their everyday names.

The catalog is an explicit object, so two engines in one program do not see each other's
mounts. Collections are DataFrames of patterns; what is stored is appended, and `save` writes it.
"""

from __future__ import annotations

import os
import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.runtime import checkpointed
from .operators import build, federate, filters, search
from .operators.walk import walk
from .sources import readers
from .sources.ledger import Ledger, SharedLock

MOST_ENTRIES = 3_000_000


@dataclass
class Lock:
    """A lease lock: whoever holds it longer than the lease loses it to the next."""

    lease: float = 30.0
    agent: str | None = None
    since: float = 0.0
    guard: threading.Condition = field(default_factory=threading.Condition)

    def acquire(self, agent: str, timeout: float = 5.0) -> bool:
        end = time.monotonic() + timeout
        with self.guard:
            while self.agent not in (None, agent) and time.monotonic() - self.since <= self.lease:
                left = end - time.monotonic()
                if left <= 0:
                    return False
                self.guard.wait(min(left, 0.05))
            self.agent, self.since = agent, time.monotonic()
            return True

    def release(self, agent: str) -> None:
        with self.guard:
            if self.agent != agent:
                raise PermissionError(f"{agent} does not hold the lock")
            self.agent = None
            self.guard.notify_all()


@dataclass
class Mounted:
    patterns: DataFrame
    role: str
    seq: int
    read_only: bool = False
    lock: Lock | SharedLock = field(default_factory=Lock)
    writes: list[dict] = field(default_factory=list)
    book: Ledger | None = None


class Engine:
    def __init__(self, spark: SparkSession, embed: Callable[[str], Sequence[float]], most_sessions: int = 50, idle: float = 1800.0):
        self.spark, self.embed = spark, embed
        self.mounted: OrderedDict[str, Mounted] = OrderedDict()
        self.sessions: OrderedDict[str, tuple[float, str | None]] = OrderedDict()
        self.most_sessions, self.idle = most_sessions, idle
        self._seq = 0

    def session(self, name: str) -> str | None:
        """The collection a session uses; idle sessions go, and the least recent beyond the most."""
        now = time.monotonic()
        for s in [s for s, (seen, _) in self.sessions.items() if now - seen > self.idle]:
            del self.sessions[s]
        used = self.sessions.pop(name, (now, None))[1]
        self.sessions[name] = (now, used)
        while len(self.sessions) > self.most_sessions:
            self.sessions.popitem(last=False)
        return used

    def list_collections(self, folders: list[str]) -> DataFrame:
        return readers.find_collections(self.spark, folders)

    def mount(self, name: str, patterns: DataFrame, role: str = "", session: str | None = None, manifest: DataFrame | None = None, read_only: bool = False) -> None:
        """Mounts patterns under a name; a manifest that does not fit them is an error."""
        name = T.safe_name(name)
        if name in self.mounted:
            raise ValueError(f"{name} is mounted")
        if "collection" not in patterns.columns:
            patterns = patterns.withColumn("collection", F.lit(name))
        if manifest is not None and not build.verify(patterns, manifest).filter("not ok").isEmpty():
            raise ValueError(f"{name} does not fit its manifest")
        self.mounted[name] = Mounted(patterns, role, self._seq, read_only)
        self._seq += 1
        if session is not None:
            self.session(session)
            self.sessions[session] = (time.monotonic(), name)

    def open(self, name: str, path: str, role: str = "", session: str | None = None, lease: float = 30.0) -> None:
        """Mounts a collection that is stored as a ledger, to which other engines and processes may write too.

        What is stored is committed there, under a lock that all of them see.
        """
        book = Ledger(self.spark, path)
        none = self.spark.createDataFrame([], "collection string, idx long, text string, embedding array<float>, meta map<string,string>, agent string, version long")
        self.mount(name, book.read().filter(F.col("collection") == name) if book.log.names() else none, role, session)
        m = self.mounted[name]
        m.book, m.lock = book, SharedLock(f"{book.path}/lock", lease, self.spark)

    def refresh(self, name: str) -> None:
        """Makes what others have committed since visible."""
        m = self.mounted[name]
        if m.book is not None and m.book.log.names():
            m.patterns = m.book.read().filter(F.col("collection") == name)

    def mount_directory(self, folder: str, role: str = "") -> list[str]:
        """All archives below a folder, each under its own name."""
        rows = readers.read_archives(self.spark, folder)
        names = [r.collection for r in rows.select("collection").distinct().orderBy("collection").collect()]  # files of a folder
        for n in names:
            self.mount(n, rows.filter(F.col("collection") == n), role)
        return names

    def unmount(self, name: str) -> None:
        del self.mounted[name]

    def total_patterns(self) -> int:
        return sum(m.patterns.count() for m in self.mounted.values())

    def status(self) -> list[dict]:
        return [{"collection": n, "role": m.role, "patterns": m.patterns.count(), "holder": m.lock.agent} for n, m in self.mounted.items()]

    def _of(self, name: str) -> DataFrame:
        return self.mounted[name].patterns

    def memory_search(self, name: str, query: str, top_k: int = 5, **options) -> DataFrame:
        return search.search(self._of(name), self.embed(query), query, top_k, **options)

    def walk_associate(self, name: str, query: str, **options) -> DataFrame:
        return walk(self._of(name), self.embed(query), **options)

    def filter(self, name: str, spec: dict) -> DataFrame:
        return filters.enumerate_filter(self._of(name), spec)

    def all_patterns(self) -> DataFrame:
        out = None
        for n, m in self.mounted.items():
            rows = m.patterns.withColumns({"collection": F.lit(n), "mount_seq": F.lit(m.seq), "role": F.lit(m.role)})
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def multi_search(self, query: str, top_k: int = 10, **options) -> DataFrame:
        return search.multi_search(self.all_patterns(), self.embed(query), query, top_k, **options)

    def get_passage(self, name: str, idx: int) -> DataFrame:
        return self._of(name).filter(F.col("idx") == idx)

    def get_pattern_meta(self, name: str, idx: int) -> DataFrame:
        return self.get_passage(name, idx).select("meta")

    def passage_links(self, name: str, idx: int) -> DataFrame:
        return build.passage_links(self._of(name)).filter(F.col("idx") == idx)

    def store(self, name: str, content: str, tags: str = "", meta: dict[str, str] | None = None, timeout: float = 5.0) -> int:
        """Appends a pattern under the collection's lock and gives its idx."""
        agent = f"store-{os.getpid()}-{threading.get_ident()}"
        return self._locked(name, agent, timeout, lambda: self._append(name, content, tags, meta, agent))

    def _locked(self, name: str, agent: str, timeout: float, work):
        m = self.mounted[name]
        if not m.lock.acquire(agent, timeout):
            raise TimeoutError(f"{name} is locked by {m.lock.agent}")
        try:
            return work()
        finally:
            m.lock.release(agent)

    def _append(self, name: str, content: str, tags: str, meta: dict[str, str] | None, agent: str) -> int:
        m = self.mounted[name]
        if m.read_only:
            raise PermissionError(f"{name} is read-only")
        if len(content) > T.MAX_TEXT:
            raise ValueError("the text is too long")
        text = f"[{tags}] {content}" if tags else content
        vector = [float(x) for x in self.embed(text)]
        if m.book is not None:  # the log says how many rows there are; none is read for that
            if m.book.rows(name) >= MOST_ENTRIES:
                raise ValueError("the collection is full")
            row = self.spark.createDataFrame([(name, 0, text, vector, meta or {})], "collection string, place long, text string, embedding array<float>, meta map<string,string>")
            idx = m.book.first(m.book.append(row, agent), name)
            self.refresh(name)
            return idx
        idx = (m.patterns.agg(F.max("idx")).first()[0] if not m.patterns.isEmpty() else -1) + 1
        if idx >= MOST_ENTRIES:
            raise ValueError("the collection is full")
        row = self.spark.createDataFrame([(name, idx, text, vector, meta or {})], "collection string, idx long, text string, embedding array<float>, meta map<string,string>")
        m.patterns = m.patterns.unionByName(row, allowMissingColumns=True)
        return idx

    def imprint(self, name: str, content: str, agent: str, tags: str = "", timeout: float = 5.0) -> int:
        """A write under the collection's lock, attributed to its agent; reads never wait."""
        def write() -> int:
            m = self.mounted[name]
            idx = self._append(name, content, tags, {"agent": agent, "written": str(int(time.time()))}, agent)
            m.writes = [*m.writes, {"agent": agent, "idx": idx}][-100:]
            return idx

        return self._locked(name, agent, timeout, write)

    def acquire_lock(self, name: str, agent: str, timeout: float = 5.0) -> bool:
        return self.mounted[name].lock.acquire(agent, timeout)

    def release_lock(self, name: str, agent: str) -> None:
        self.mounted[name].lock.release(agent)

    def lock_holder(self, name: str) -> str | None:
        return self.mounted[name].lock.agent

    def writes_by_agent(self, name: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for w in self.mounted[name].writes:
            out[w["agent"]] = out.get(w["agent"], 0) + 1
        return out

    def save(self, name: str, path: str) -> None:
        """Writes patterns and manifest; links and metadata stay with the rows."""
        rows = self._of(name)
        readers.write_collections(rows, f"{path}/patterns", "overwrite")
        readers.write_manifest(build.manifest(rows), f"{path}/manifest")

    def publish(self, name: str, entries: DataFrame, timeout: float = 5.0) -> int:
        """Appends the entries that the collection does not have, under its lock; gives their number."""

        def write() -> int:
            m = self.mounted[name]
            fresh = checkpointed(federate.publish(entries.withColumn("signature", federate.signature(entries)), m.patterns))
            m.patterns = m.patterns.unionByName(fresh, allowMissingColumns=True)
            return fresh.count()

        return self._locked(name, f"publish-{threading.get_ident()}", timeout, write)

    def consolidate(self, mode: str = "preserve") -> DataFrame:
        """Corroboration among all mounted collections: every pattern (preserve), one row a component (collapse), or every text against one (contradictions)."""
        rows = self.all_patterns()
        p = rows.select(F.col("mount_seq").cast("long").alias("part"), (F.col("mount_seq") * 10_000_000_000 + F.col("idx")).alias("idx"), "text", "embedding")
        found = federate.edges(federate.similar_pairs(p))
        how = {"preserve": federate.preserved, "contradictions": federate.contradictions}
        return how.get(mode, federate.collapsed)(p, found)
