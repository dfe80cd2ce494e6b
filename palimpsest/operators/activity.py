"""Sessions, activity, packs: the stateful side as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import AGENT_MEMORY, ARCHIVAL, FORM, PERM_R, PERM_W, PINNED

#: Seconds, rows and characters (fixed values).
IDLE, SESSIONS, RING, SHOWN, WRITES, RECENT, AUDIT = 1800, 50, 200, 50, 100, 10, 8000


def sessions(events: DataFrame, idle: int = IDLE) -> DataFrame:
    """user_id, session, started, ended, events: parted where nothing happened for longer than idle seconds.

    events: user_id, event_id, at (timestamp).
    """
    own = Window.partitionBy("user_id").orderBy("at", "event_id")
    gap = F.unix_micros("at") - F.unix_micros(F.lag("at").over(own))
    marked = events.withColumn("session", F.sum(F.when(gap > idle * 1_000_000, 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("user_id", "session").agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.count("*").alias("events"))


def session_status(last_seen: DataFrame, as_of: int, most: int = SESSIONS) -> DataFrame:
    """Each session's status at as_of (unix seconds): active, idle or expired; beyond the `most` latest: evicted."""
    age = F.lit(as_of) - F.col("last_seen")
    rank = F.row_number().over(Window.orderBy(F.col("last_seen").desc(), "session_id"))
    latest = last_seen.orderBy(F.col("last_seen").desc(), "session_id").limit(most).withColumn("_n", rank)
    out = last_seen.join(F.broadcast(latest.select("session_id", "_n")), "session_id", "left")
    return out.withColumn("status", F.when(age > IDLE, "expired").when(F.col("_n").isNull(), "evicted").when(age > 300, "idle").otherwise("active")).drop("_n")


def latest(events: DataFrame, by: str, n: int) -> DataFrame:
    """The n newest rows of each group with their place."""
    own = Window.partitionBy(by).orderBy(F.col("at").desc(), F.col("event_id").desc())
    return events.withColumn("place", F.row_number().over(own)).filter(F.col("place") <= n)


def writers(events: DataFrame, n: int = WRITES) -> DataFrame:
    """Writes by agent over each collection's last n."""
    return latest(events, "collection", n).groupBy("collection", "agent").agg(F.count("*").alias("writes"))


def ring(events: DataFrame, keep: int = RING, shown: int = SHOWN) -> DataFrame:
    """The newest rows of the last `keep`, newest first."""
    return events.orderBy(F.col("at").desc(), F.col("event_id").desc()).limit(min(keep, shown))


def created(patterns: DataFrame, events: DataFrame) -> DataFrame:
    """patterns with the time of the first event that names them (pattern_idx, at); null where there is none."""
    first = events.filter("pattern_idx is not null").groupBy(F.col("pattern_idx").alias("idx")).agg(F.min("at").alias("created_at"))
    return patterns.join(first, "idx", "left")


def mounts(packs: DataFrame, events: DataFrame) -> DataFrame:
    """packs with mount_count raised by, and last_mounted_at of, the mount events (name, at)."""
    own = events.groupBy("name").agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    out = packs.join(own, "name", "left").withColumn("mount_count", F.coalesce("mount_count", F.lit(0)) + F.coalesce("_n", F.lit(0)))
    return out.withColumn("last_mounted_at", F.greatest("last_mounted_at", "_at")).drop("_n", "_at")


def reference_counts(mounts: DataFrame) -> DataFrame:
    return mounts.groupBy("collection").agg(F.count_distinct("session_id").alias("sessions"))


def provision(packs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Packs with those wanted (owner_id, name) that were not there; repeating it changes nothing."""
    fresh = wanted.dropDuplicates(["owner_id", "name"]).join(packs.select("owner_id", "name"), ["owner_id", "name"], "left_anti")
    return packs.unionByName(fresh, allowMissingColumns=True)


def logging_on(users: DataFrame) -> DataFrame:
    """Audit flag of each user; unknown means on."""
    return users.withColumn("logged", F.coalesce("flag", F.lit(True)))


def upsert(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """rows with changes: keys that changes has are replaced, the rest stay."""
    return rows.join(changes.select(*keys), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def audited_update(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Replaces texts by (pack, idx), keeping the previous one, cut at AUDIT characters."""
    new = changes.select("pack", "idx", F.col("text").alias("_new"))
    out = rows.join(new, ["pack", "idx"], "left")
    old = F.when(F.col("_new").isNotNull(), F.left("text", F.lit(AUDIT)))
    return out.withColumn("previous_text", old).withColumn("text", F.coalesce("_new", "text")).drop("_new")


def starter(packs: DataFrame, header: str, page: str, created: int) -> DataFrame:
    """The two rows of every new pack (pack, owner_id): a read-only header that points to the page of
    instructions, and that page; {pack} and {owner} stand for names in either text. Both are pinned
    and never perish."""
    named = lambda text: F.replace(F.replace(F.lit(text), F.lit("{owner}"), F.coalesce("owner_id", F.lit("unknown"))), F.lit("{pack}"), F.col("pack"))
    rows = [(named(header), 1, PERM_R), (named(page), 0, PERM_R | PERM_W)]
    each = [F.struct(F.lit(i).cast("long").alias("idx"), t.alias("text"), F.lit(n).cast("long").alias("next"), F.lit(p).alias("perms_byte")) for i, (t, n, p) in enumerate(rows)]
    out = packs.select("pack", F.explode(F.array(*each)).alias("x")).select("pack", "x.*")
    return out.withColumns({"pattern_id": F.col("idx"), "sequence_num": F.col("idx").cast("int"), "format_version": F.lit(FORM), "kind": F.lit(AGENT_MEMORY), "flags": F.lit(PINNED | ARCHIVAL), "ts_unix": F.lit(created).cast("long")})


def dispatch(body, at: str):
    """A task as a pattern's text; queue() finds it again."""
    return F.concat(F.lit("[DISPATCH] "), body, F.lit(f"\n\n[dispatched: {at}]"))


def queue(patterns: DataFrame) -> DataFrame:
    return patterns.filter(F.col("text").startswith("[DISPATCH]")).orderBy("idx")


def copied(patterns: DataFrame, idx: int, source: str, target: str, at: str) -> DataFrame:
    """One pattern as it is appended to another pack, with where it came from."""
    note = F.concat("text", F.lit(f"\n\n[copied from {source}#"), F.col("idx").cast("string"), F.lit(f" on {at}]"))
    return patterns.filter((F.col("pack") == source) & (F.col("idx") == idx)).select(F.lit(target).alias("pack"), note.alias("text"))


def export_markdown(patterns: DataFrame) -> DataFrame:
    """pack, document: all patterns of a pack in order. A document is what one reader downloads, so it is one row."""
    block = F.format_string("## #%d\n\n%s\n", "idx", "text")
    parts = F.sort_array(F.collect_list(F.struct("idx", block.alias("block"))))
    return patterns.groupBy("pack").agg(F.array_join(F.transform(parts, lambda p: p["block"]), "\n").alias("document"))


def backfill(rows: DataFrame, old: list[str], template: str) -> DataFrame:
    """Pages that still hold a mark of an old default get the new one."""
    stale = F.lit(False)
    for mark in old:
        stale = stale | F.col("text").contains(mark)
    return rows.withColumn("text", F.when(stale & (F.col("idx") == 1), F.lit(template)).otherwise(F.col("text")))


def stored(content, tags: str = ""):
    """A text as it is stored: its tags in brackets before it. Longer than MAX_TEXT: null."""
    text = F.concat(F.lit(f"[{tags}] "), content) if tags else content
    return F.when(F.length(content) <= T.MAX_TEXT, text)


def action_effectiveness(tries: DataFrame) -> DataFrame:
    """action, tries, changes, effectiveness over (action, changed) rows."""
    out = tries.groupBy("action").agg(F.count("*").alias("tries"), F.sum(F.col("changed").cast("long")).alias("changes"))
    return out.withColumn("effectiveness", F.col("changes") / F.greatest("tries", F.lit(1)))


def state_effectiveness(tries: DataFrame, least: int = 3, top: int = 5) -> DataFrame:
    """The same by state, for the `top` most tried states of `least` tries or more."""
    each = tries.groupBy("state", "action").agg(F.count("*").alias("tries"), F.sum(F.col("changed").cast("long")).alias("changes"))
    best = tries.groupBy("state").agg(F.count("*").alias("total")).filter(F.col("total") >= least).orderBy(F.col("total").desc(), "state").limit(top)
    return each.join(F.broadcast(best), "state").withColumn("effectiveness", F.col("changes") / F.greatest("tries", F.lit(1)))


def best_score(runs: DataFrame, by: str) -> DataFrame:
    """Most levels, then fewest steps."""
    best = F.max(F.struct(F.col("levels"), (-F.col("steps")).alias("steps"))).alias("b")
    return runs.groupBy(by).agg(best).select(by, F.col("b.levels").alias("levels"), (-F.col("b.steps")).alias("steps"))


def insights(rows: DataFrame, least: float = 0.7, keep: int = 10) -> DataFrame:
    """Each game's last `keep` distinct insights of enough confidence, as text. rows: game, seq, hypothesis, confidence."""
    text = F.format_string("%s (confidence: %.1f%%)", "hypothesis", F.col("confidence") * 100)
    first = rows.filter(F.col("confidence") >= least).withColumn("insight", text).groupBy("game", "insight").agg(F.min("seq").alias("seq"))
    own = Window.partitionBy("game").orderBy(F.col("seq").desc(), "insight")
    return first.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= keep).drop("_n")
