"""Keyed state over event streams: rate limits, leases, sessions, frames; sinks of micro-batches.

The processors take batches as well as streams (Spark runs both through the same state
interface), and a key's events one after another in order of their event time. A batch is sorted
before it comes, and is gone through as its chunks arrive. Of a stream with a watermark
(`delay`) events wait in the state until the watermark has passed them, so that late and
interleaved batches give what one batch gives; of one without, each micro-batch is gone through
in its own order. No key's rows are ever held together outside of the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T
from ..functions.runtime import ship
from ..operators.activity import IDLE, SESSIONS

#: How the events of a key come: sorted, in micro-batches of their own order, or to wait for the watermark.
SORTED, BATCHES, WATERMARK = "sorted", "batches", "watermark"
#: Rows that are given out at a time.
CHUNK = 2000


def watermarked(events: DataFrame, at: str = "at", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, delay)


class InOrder(StatefulProcessor):
    """Goes through a key's events in order of (at_us, tie), microseconds and what breaks ties.

    A subclass names the columns of an event (EVENT, a schema) and of what it gives out (OUT), opens
    its state, and turns one event and the state so far into the state after it and rows to give out.
    """

    EVENT = OUT = ""

    def __init__(self, mode: str):
        self.mode = mode

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [x.strip().split(" ")[0] for x in self.EVENT.split(",")]
        self.given = [x.strip().split(" ")[0] for x in self.OUT.split(",")]
        if self.mode != SORTED:
            self.waiting = handle.getMapState("waiting", "at long, place long", self.EVENT)
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def load(self):
        raise NotImplementedError

    def save(self, state) -> None:
        raise NotImplementedError

    def step(self, key: tuple, state, event: dict) -> tuple[object, list[tuple]]:
        raise NotImplementedError

    def _frames(self, key: tuple, events: Iterator[dict]) -> Iterator[pd.DataFrame]:
        state, out = self.load(), []
        for e in events:
            state, rows = self.step(key, state, e)
            out += rows
            if len(out) >= CHUNK:
                yield self._frame(out)
                out = []
        self.save(state)
        yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=self.given)
        whole = [x.strip().split(" ")[0] for x in self.OUT.split(",") if x.strip().split(" ")[1] in ("long", "int")]
        return out.astype(dict.fromkeys(whole, "Int64"))

    def _arrived(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[int, int], dict]]:
        for chunk in rows:
            for r in chunk[["at_us", "tie", *self.names]].itertuples(index=False):
                yield (int(r[0]), int(r[1])), dict(zip(self.names, map(_plain, r[2:]), strict=True))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.mode == SORTED:
            yield from self._frames(key, (e for _, e in self._arrived(rows)))
            return
        timers = set()
        for place, e in self._arrived(rows):
            self.waiting.updateValue(place, tuple(e[n] for n in self.names))
            timers.add(-(-place[0] // 1000))
        if self.mode == BATCHES:
            yield from self._frames(key, self._released(None))
            return
        for t in timers:
            self.handle.registerTimer(t)
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._frames(key, self._released(timerValues.getCurrentWatermarkInMs() * 1000))

    def _released(self, upto: int | None) -> Iterator[dict]:
        """The waiting events up to a time, in order; only their places are held together."""
        for place in sorted((int(at), int(k)) for at, k in self.waiting.keys() if upto is None or at <= upto):
            row = self.waiting.getValue(place)
            self.waiting.removeKey(place)
            yield dict(zip(self.names, row, strict=True))

    def close(self) -> None:
        pass


def _plain(x):
    """A cell as the state takes it: arrays as lists, absent values as None."""
    if hasattr(x, "tolist"):
        return x.tolist()
    return None if x is None or x != x else x


def _mode(events: DataFrame, delay: str | None) -> str:
    return SORTED if not events.isStreaming else BATCHES if delay is None else WATERMARK


def _run(events: DataFrame, key: str, at: Column, place: Column, processor: type[InOrder], delay: str | None, *arguments) -> DataFrame:
    """The processor over events by key; at: microseconds."""
    ship(events.sparkSession)
    events.sparkSession.streams.active  # noqa: B018  starts the session's state store coordinator, which batches need too
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    if events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != provider:
        events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", provider)  # the only one that keeps such state
    mode = _mode(events, delay)
    names = [x.strip().split(" ")[0] for x in processor.EVENT.split(",")]
    rows = events.select(key, at.cast("long").alias("at_us"), place.cast("long").alias("tie"), *(n for n in names if n != key))
    if mode == SORTED:
        rows = rows.repartition(key).sortWithinPartitions(key, "at_us", "tie")
    elif mode == WATERMARK:
        rows = rows.withColumn("event_time", F.timestamp_micros("at_us")).withWatermark("event_time", delay)
    return rows.groupBy(key).transformWithStateInPandas(processor(mode, *arguments), processor.OUT, "Append", "EventTime" if mode == WATERMARK else "None")


class RateLimit(InOrder):
    """At most `limit` allowed requests in any `window` seconds a client; denied ones do not count.

    The bounds are inclusive: a request exactly `window` seconds old still counts.
    """

    EVENT = "event_id long, t double"
    OUT = "client long, event_id long, t double, allowed boolean"

    def __init__(self, mode: str, limit: int = 60, window: float = 60.0):
        super().__init__(mode)
        self.limit, self.window = limit, window

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.allowed = handle.getListState("allowed", "t double")

    def load(self) -> list[float]:
        return [t for (t,) in self.allowed.get()] if self.allowed.exists() else []

    def save(self, held: list[float]) -> None:
        if held:
            self.allowed.put([(t,) for t in held])  # `limit` numbers at most
        else:
            self.allowed.clear()

    def step(self, key, held, e):
        held = [t for t in held if t >= e["t"] - self.window]
        ok = len(held) < self.limit
        return [*held, e["t"]] if ok else held, [(key[0], e["event_id"], e["t"], ok)]


def rate_limited(requests: DataFrame, limit: int = 60, window: float = 60.0, delay: str | None = None) -> DataFrame:
    """client, event_id, t, allowed for requests (client, event_id, t in seconds)."""
    return _run(requests, "client", F.col("t") * 1_000_000, F.col("event_id"), RateLimit, delay, limit, window)


class Lease(InOrder):
    """A lock a collection, held under a lease: acquire waits for no one here, it is granted or refused.

    A lease that is over is taken over; a release by someone else is an error and changes nothing.
    """

    EVENT = "event_id long, t double, agent string, action string, lease double"
    OUT = "collection string, event_id long, t double, agent string, action string, result string, holder string"

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.holder = handle.getValueState("holder", "agent string, since double, lease double")

    def load(self) -> tuple | None:
        return tuple(self.holder.get()) if self.holder.exists() else None

    def save(self, now: tuple | None) -> None:
        if now is None:
            self.holder.clear()
        else:
            self.holder.update(now)

    def step(self, key, now, e):
        if now is not None and e["t"] - now[1] > now[2]:
            now = None
        if e["action"] == "acquire":
            result = "granted" if now is None or now[0] == e["agent"] else "refused"
            now = (e["agent"], e["t"], e["lease"]) if result == "granted" else now
        elif now is None:
            result = "not held"
        elif now[0] == e["agent"]:
            result, now = "released", None
        else:
            result = "not the holder"
        return now, [(key[0], e["event_id"], e["t"], e["agent"], e["action"], result, now[0] if now else None)]


def leases(events: DataFrame, delay: str | None = None) -> DataFrame:
    """What becomes of acquire and release events (collection, event_id, t, agent, action, lease)."""
    return _run(events, "collection", F.col("t") * 1_000_000, F.col("event_id"), Lease, delay)


class Sessions(InOrder):
    """The sessions that a server keeps: idle ones expire, and of more than `most` the longest unseen goes.

    Accesses in order; what is given out is each session's beginning and end. The state is one entry
    a kept session, in order of their last access.
    """

    EVENT = "session_id long, t double"
    OUT = "server long, session_id long, t double, what string"

    def __init__(self, mode: str, idle: float = IDLE, most: int = SESSIONS):
        super().__init__(mode)
        self.idle, self.most = idle, most

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "session_id long, t double")

    def load(self) -> dict[int, float]:
        return dict(self.kept.get()) if self.kept.exists() else {}

    def save(self, kept: dict[int, float]) -> None:
        if kept:
            self.kept.put(list(kept.items()))  # `most` at most
        else:
            self.kept.clear()

    def step(self, key, kept, e):
        gone = [(s, "expired") for s, t in kept.items() if e["t"] - t > self.idle]
        for s, _ in gone:
            del kept[s]
        own, fresh = e["session_id"], e["session_id"] not in kept
        if fresh and len(kept) >= self.most:
            oldest = next(iter(kept))
            del kept[oldest]
            gone.append((oldest, "evicted"))
        kept.pop(own, None)
        kept[own] = e["t"]
        return kept, [(key[0], s, e["t"], what) for s, what in [*gone, *([(own, "created")] if fresh else [])]]


def session_log(accesses: DataFrame, idle: float = IDLE, most: int = SESSIONS, delay: str | None = None) -> DataFrame:
    """server, session_id, t, what (created, expired, evicted) for accesses (server, event_id, session_id, t in seconds)."""
    return _run(accesses, "server", F.col("t") * 1_000_000, F.col("event_id"), Sessions, delay, idle, most)


def session_states(log: DataFrame, accesses: DataFrame, idle: float = IDLE, quiet: float = 300.0) -> DataFrame:
    """server, session_id, status of every session at its server's last access, from what session_log gave."""
    last = log.groupBy("server", "session_id").agg(F.max_by("what", F.struct("t", F.col("what") == "created")).alias("what"))
    seen = accesses.groupBy("server", "session_id").agg(F.max("t").alias("seen"))
    now = seen.groupBy("server").agg(F.max("seen").alias("now"))  # a row a server
    age = F.col("now") - F.col("seen")
    status = F.when(age > idle, "expired").when(F.col("what") == "evicted", "evicted").when(age > quiet, "idle").otherwise("active")
    return seen.join(now, "server").join(last, ["server", "session_id"]).select("server", "session_id", status.alias("status"))


class Frames(InOrder):
    """The frame before of each level, for the number of cells that changed; a reset begins the level anew."""

    EVENT = "step long, cells array<int>, reset boolean"
    OUT = "level long, step long, changed long"

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getValueState("before", "cells array<int>")

    def load(self) -> list[int] | None:
        return [int(x) for x in self.before.get()[0]] if self.before.exists() else None

    def save(self, cells: list[int] | None) -> None:
        if cells is not None:
            self.before.update((cells,))

    def step(self, key, old, e):
        cells = [int(x) for x in e["cells"]]
        old = None if e["reset"] else old
        return cells, [(key[0], e["step"], -1 if old is None else sum(a != b for a, b in zip(old, cells, strict=True)))]


def _in_time(frames: DataFrame) -> tuple[DataFrame, Column]:
    """Frames with a reset flag, and their event time: `at` where they have it, else their step."""
    own = frames if "reset" in frames.columns else frames.withColumn("reset", F.lit(False))
    return own.withColumn("reset", F.coalesce("reset", F.lit(False))), F.unix_micros("at") if "at" in frames.columns else F.col("step")


def frame_changes(frames: DataFrame, delay: str | None = None) -> DataFrame:
    """level, step, changed (-1 for a level's first frame, and after a reset).

    frames: level, step, cells; at (a timestamp) orders them where steps begin again, reset marks a frame that begins a level anew.
    """
    own, at = _in_time(frames)
    return _run(own, "level", at, F.col("step"), Frames, delay)


class Observer(InOrder):
    """What each frame of a level shows against the one before, whose cells and objects' names are the state.

    An object keeps the name of the one it moved from, or of one that stands where it stood;
    others get new names. A reset, or a step that is not above the last, starts the level anew.
    """

    EVENT = "step long, cells array<int>, reset boolean"
    OUT = "level long, step long, objects long, changed long, moves long, names array<int>"

    def __init__(self, mode: str, side: int):
        super().__init__(mode)
        self.side = side

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getValueState("before", "step long, cells array<int>, names array<int>, next int")

    def load(self) -> tuple | None:
        return tuple(self.before.get()) if self.before.exists() else None

    def save(self, held: tuple | None) -> None:
        if held is not None:
            self.before.update(held)

    def step(self, key, held, e):
        from ..operators.grid import described, moves

        cells = [int(x) for x in e["cells"]]
        now = [(x[0], x[5], x[6]) for x in described(cells, self.side)]
        names, fresh, changed, moved = [None] * len(now), 0, None, None
        if held is not None and not e["reset"] and e["step"] > held[0]:
            before = [int(x) for x in held[1]]
            old = [(x[0], x[5], x[6]) for x in described(before, self.side)]
            fresh = held[3]
            changed = sum(a != b for a, b in zip(before, cells, strict=True))
            found = moves(old, now)
            moved = len(found)
            for i, k in found:
                names[k] = held[2][i]
            still: dict[tuple, list[int]] = {}
            for i, x in enumerate(old):
                still.setdefault(x, []).append(held[2][i])
            for k, x in enumerate(now):  # several may stand at one place, as a ring and what it rings: each name is given once
                if names[k] is None:
                    names[k] = next((n for n in still.get(x, []) if n not in names), None)
        for k, n in enumerate(names):
            if n is None:
                names[k], fresh = fresh, fresh + 1
        names = [int(n) for n in names]
        return (int(e["step"]), cells, names, int(fresh)), [(key[0], e["step"], len(now), changed, moved, names)]


def observed(frames: DataFrame, side: int, delay: str | None = None) -> DataFrame:
    """level, step, objects, changed and moves (null for a level's first frame, and after a reset), names of the objects.

    frames as for frame_changes.
    """
    own, at = _in_time(frames)
    return _run(own, "level", at, F.col("step"), Observer, delay, side)


def sync(entries: DataFrame, folder: str, checkpoint: str):
    """A stream of exchanges (machine, ...) appended as JSON by machine; machine names are made safe."""
    named = entries.withColumn("machine", T.machine_name(F.col("machine")))
    return named.writeStream.format("json").partitionBy("machine").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def publish_stream(entries: DataFrame, table: str, checkpoint: str):
    """A stream of entries (with `signature`) appended to a Parquet table, each signature once.

    Signatures are keyed state, so no batch reads what was published before; the sink's log makes a
    batch that is run again leave the table as it was.
    """
    fresh = entries.dropDuplicates(["signature"])
    return fresh.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
