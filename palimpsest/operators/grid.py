"""Colour grids: frames (level, step, cells: rows x columns of colours 0-15, row by row)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.runtime import checkpointed, ship

MOST_APART, LEAST_MOVED = 10.0, 0.01
#: Steps whose pairs of frames are matched in one call.
STEPS = 64
OBJECT = "level long, step long, object int, color int, r0 int, c0 int, r1 int, c1 int, row double, col double, size int, cells array<int>"


def exploded(frames: DataFrame, side: int) -> DataFrame:
    """level, step, r, c, color."""
    return frames.select("level", "step", F.posexplode("cells").alias("p", "color")).select("level", "step", F.floor(F.col("p") / side).cast("int").alias("r"), (F.col("p") % side).cast("int").alias("c"), "color")


def histogram(frames: DataFrame, side: int) -> DataFrame:
    return exploded(frames, side).groupBy("level", "step", "color").agg(F.count("*").alias("cells"))


def background(frames: DataFrame, side: int) -> DataFrame:
    """The most frequent colour, the lowest of equals."""
    order = Window.partitionBy("level", "step").orderBy(F.col("cells").desc(), "color")
    return histogram(frames, side).withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("level", "step", F.col("color").alias("background"))


def diff(frames: DataFrame, side: int) -> DataFrame:
    """Cells that changed from the step before: level, step, r, c, was, now."""
    own = Window.partitionBy("level").orderBy("step")
    pairs = frames.withColumn("_before", F.lag("cells").over(own)).filter("_before is not null")
    changed = F.filter(F.transform(F.arrays_zip("_before", "cells"), lambda z, i: F.struct(i.alias("p"), z["_before"].alias("was"), z["cells"].alias("now"))), lambda x: x["was"] != x["now"])
    return pairs.select("level", "step", F.inline(changed)).select("level", "step", F.floor(F.col("p") / side).cast("int").alias("r"), (F.col("p") % side).cast("int").alias("c"), "was", "now")


def label(grid: np.ndarray, skip: int) -> list[tuple[int, np.ndarray]]:
    """(colour, cells) of the 4-connected components, by colour and then by first cell."""
    n, m = grid.shape
    flat = grid.ravel()
    name = np.arange(n * m)
    right = np.flatnonzero((np.arange(n * m) % m < m - 1)[: n * m - 1] & (flat[:-1] == flat[1:])) if n * m > 1 else np.zeros(0, int)
    down = np.flatnonzero(flat[: (n - 1) * m] == flat[m:]) if n > 1 else np.zeros(0, int)
    a, b = np.concatenate([right, down]), np.concatenate([right + 1, down + m])
    while True:  # smallest names spread along equal neighbours and along names
        low = name.copy()
        np.minimum.at(low, a, name[b])
        np.minimum.at(low, b, name[a])
        low = low[low]
        if (low == name).all():
            break
        name = low
    return [(int(flat[k]), np.flatnonzero(name == k)) for k in sorted(set(name.tolist()), key=lambda k: (flat[k], k)) if flat[k] != skip]


def objects(frames: DataFrame, side: int) -> DataFrame:
    """The components of equal colour of each frame, its background left out."""
    ship(frames.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split(" ")[0] for x in OBJECT.split(", ")]
        for f in batches:
            rows = []
            for level, step, cells in zip(f["level"], f["step"], f["cells"], strict=True):
                rows += [(level, step, i, *x) for i, x in enumerate(described(cells, side))]
            yield pd.DataFrame(rows, columns=names)

    return frames.select("level", "step", "cells").mapInPandas(run, OBJECT)


def described(cells, side: int) -> list[tuple]:
    """(color, r0, c0, r1, c1, row, col, size, cells) of the objects of one frame."""
    g = np.asarray(cells, np.int64).reshape(-1, side)
    skip = int(np.bincount(g.ravel(), minlength=16).argmax())
    out = []
    for color, at in label(g, skip):
        r, c = at // side, at % side
        out.append((color, int(r.min()), int(c.min()), int(r.max()), int(c.max()), round(float(r.mean()), 2), round(float(c.mean()), 2), len(at), at.tolist()))
    return out


def moves(old: list[tuple], new: list[tuple]) -> list[tuple[int, int]]:
    """Pairs of objects (color, row, col): in order, each of old takes the nearest unused one of its colour."""
    out, used = [], set()
    for color in dict.fromkeys(x[0] for x in old):
        for i in (i for i, x in enumerate(old) if x[0] == color):
            near, best = MOST_APART, None
            for k in (k for k, x in enumerate(new) if x[0] == color and k not in used):
                d = round(float(np.hypot(old[i][1] - new[k][1], old[i][2] - new[k][2])), 9)
                if LEAST_MOVED < d < near:
                    near, best = d, k
            if best is not None:
                used.add(best)
                out.append((i, best))
    return out


def tracked(found: DataFrame) -> DataFrame:
    """Moves from one step to the next: greedy, each object in order takes the nearest unused one of its colour.

    Order decides, so a pair of frames is matched in one call, with those of STEPS steps at most;
    a frame has as many objects as cells at most.
    """
    ship(found.sparkSession)

    def match(key, f: pd.DataFrame) -> pd.DataFrame:
        out = []
        sides = {k: x.sort_values("object") for k, x in f.groupby(["now", "old"])}
        for now in sorted({k[0] for k in sides}):
            old, new = sides.get((now, True)), sides.get((now, False))
            if old is None:
                continue
            if new is None:
                continue
            a, b = (list(x[["color", "row", "col", "object"]].itertuples(index=False, name=None)) for x in (old, new))
            out += [(key[0], now, a[i][3], a[i][0], b[k][3], round(b[k][1] - a[i][1], 2), round(b[k][2] - a[i][2], 2)) for i, k in moves(a, b)]
        return pd.DataFrame(out, columns=["level", "step", "object", "color", "now_object", "d_row", "d_col"])

    found = found.drop("cells")
    after = found.select("level", "step").distinct().withColumn("now", F.lead("step").over(Window.partitionBy("level").orderBy("step"))).filter("now is not null")
    old = found.join(after, ["level", "step"]).withColumn("old", F.lit(True))
    sides = old.unionByName(found.withColumn("now", F.col("step")).withColumn("old", F.lit(False)))
    return sides.groupBy("level", F.floor(F.col("now") / STEPS).alias("_steps")).applyInPandas(match, "level long, step long, object int, color int, now_object int, d_row double, d_col double")


def carried(found: DataFrame) -> DataFrame:
    """Each object's nearest of its colour in the step before, if nearer than MOST_APART; several may share one."""
    before = found.select("level", (F.col("step") + 1).alias("step"), "color", F.col("object").alias("was"), F.col("row").alias("_r"), F.col("col").alias("_c"))
    d = F.hypot(F.col("row") - F.col("_r"), F.col("col") - F.col("_c"))
    near = found.join(before, ["level", "step", "color"]).withColumn("_d", d).filter(F.col("_d") < MOST_APART)
    return near.groupBy("level", "step", "object").agg(F.min_by("was", F.struct(F.round("_d", 9), "was")).alias("was"))


def owners(found: DataFrame) -> DataFrame:
    """level, step, cell, owner (the last), stack (all) of the cells that objects claim."""
    cells = found.select("level", "step", "object", F.explode("cells").alias("cell"))
    return cells.groupBy("level", "step", "cell").agg(F.max("object").alias("owner"), F.sort_array(F.collect_list("object")).alias("stack"))


def adjacent(found: DataFrame, side: int) -> DataFrame:
    """Objects of a frame that share a border: level, step, object, other."""
    own = owners(found).select("level", "step", "cell", "owner")
    steps = F.array(F.when(F.col("cell") % side < side - 1, F.col("cell") + 1), F.when(F.col("cell") + side < side * side, F.col("cell") + side))
    moved = own.withColumn("cell", F.explode(F.filter(steps, lambda x: x.isNotNull()))).withColumnRenamed("owner", "other")
    pairs = own.join(moved, ["level", "step", "cell"]).filter("owner <> other")
    both = pairs.select("level", "step", F.col("owner").alias("object"), "other").union(pairs.select("level", "step", "other", "owner"))
    return both.distinct()


def without(found: DataFrame, colors: list[int]) -> DataFrame:
    """Objects of other colours than those of an overlay."""
    return found.filter(~F.col("color").isin(colors)) if colors else found


def state_hash(found: DataFrame, backgrounds: DataFrame) -> DataFrame:
    """A frame's digest over its background and its objects' colours, sizes, places, properties and
    relations (props and rels, JSON texts; absent: empty); no identities.

    BLAKE2b of canonical JSON, so equal states have equal digests wherever they were seen.
    """
    ship(found.sparkSession)
    held = [F.coalesce(F.col(c) if c in found.columns else F.lit(None).cast("string"), F.lit("{}")).alias(c) for c in ("props", "rels")]
    key = F.struct(F.col("color"), F.col("size"), F.col("row"), F.col("col"), *held)
    each = backgrounds.join(found.groupBy("level", "step").agg(F.sort_array(F.collect_list(key)).alias("objects")), ["level", "step"], "left")

    @F.pandas_udf("string")
    def digest(bg: pd.Series, objs: pd.Series) -> pd.Series:
        def one(b, xs):
            held = [{"c": int(o["color"]), "s": int(o["size"]), "cr": float(o["row"]), "cc": float(o["col"]), "props": str(o["props"]), "rels": str(o["rels"])} for o in (xs if xs is not None else [])]
            return hashlib.blake2b(json.dumps({"bg": int(b), "objs": held}, sort_keys=True).encode(), digest_size=32).hexdigest()

        return pd.Series([one(b, xs) for b, xs in zip(bg, objs, strict=True)])

    return each.select("level", "step", digest("background", "objects").alias("state"))


def boxes(records: DataFrame) -> DataFrame:
    """Bounding boxes of records that give centroid and size only: centroid +- sqrt(n) / 2."""
    half = F.sqrt("size") / 2
    return records.withColumns({"r0": F.floor(F.col("row") - half), "r1": F.ceil(F.col("row") + half), "c0": F.floor(F.col("col") - half), "c1": F.ceil(F.col("col") + half)})


def paired_rows(frames: DataFrame) -> DataFrame:
    """Two rows a step: even, the frame with its vector; odd, a place for reasoning about it, whose
    vector and sign code are zero, so that searches find frames alone. Without an embedding: no vectors."""
    head = lambda kind, more="": F.concat(F.lit(f"[{kind}] "), F.col("level").cast("string"), F.lit(" | Step "), F.col("step").cast("string"), F.lit(more)).alias("text")
    v = F.col("embedding").cast("array<double>") if "embedding" in frames.columns else F.lit(None).cast("array<double>")
    pair = [((F.col("step") * 2).alias("idx"), head("GRID"), v), ((F.col("step") * 2 + 1).alias("idx"), head("SAGE", " | Awaiting SAGE reasoning"), F.transform(v, lambda x: F.lit(0.0)))]
    each = [F.struct(i, t, e.alias("embedding"), V.sign_words(e).alias("sign_words")) for i, t, e in pair]
    return frames.select("level", F.explode(F.array(*each)).alias("x")).select("level", "x.*")


def reasoned(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Paired rows with the odd ones replaced where there is a text (level, step, text) for their step."""
    new = records.select("level", (F.col("step") * 2 + 1).alias("idx"), F.col("text").alias("_new"))
    return rows.join(new, ["level", "idx"], "left").withColumn("text", F.coalesce("_new", "text")).drop("_new")


def observed(frames: DataFrame, side: int) -> DataFrame:
    """A row a frame: level, step, background, objects, changed (cells; null for a level's first), moves."""
    found = objects(frames, side)
    count = lambda rows, name: rows.groupBy("level", "step").agg(F.count("*").alias(name))
    out = background(frames, side).join(count(found, "objects"), ["level", "step"], "left").join(count(diff(frames, side), "changed"), ["level", "step"], "left").join(count(tracked(found), "moves"), ["level", "step"], "left")
    first = F.col("step") == F.min("step").over(Window.partitionBy("level"))
    return out.select("level", "step", "background", F.coalesce("objects", F.lit(0)).alias("objects"), F.when(~first, F.coalesce("changed", F.lit(0))).alias("changed"), F.when(~first, F.coalesce("moves", F.lit(0))).alias("moves"))


#: What salience is made of, and its letters (fixed values).
SALIENCE = (("surprise", "S"), ("novelty", "N"), ("arousal", "A"), ("reward", "R"), ("conflict", "C"))


def salience_text(salience):
    """A struct or map of salience scores as a line; an absent one is 0."""
    return F.concat(F.lit("SALIENCE: "), F.concat_ws(" ", *(F.format_string(f"{letter}=%.2f", F.coalesce(salience[name].cast("double"), F.lit(0.0))) for name, letter in SALIENCE)))


#: Labels of a reasoning record's fields, in their order (fixed values).
REASONING = (("HYPOTHESIS", "hypothesis"), ("STRATEGY", "strategy"), ("INSIGHT", "key_insight"), ("RATIONALE", "action_rationale"), ("REASONING", "reasoning_text"))


def reasoning_text(record, level, step, salience=None, kind=None):
    """A step's reasoning as lines: level and step, the fields that record (a struct of strings) has,
    salience and cognitive type where there are any, and the whole record as JSON last."""
    head = F.concat(F.lit("[SAGE] "), level.cast("string"), F.lit(" | Step "), step.cast("string"))
    lines = [F.when(record[f].isNotNull(), F.concat(F.lit(f"{label_}: "), record[f])) for label_, f in REASONING]
    own = [record[f].alias(f) for _, f in REASONING]
    if salience is not None:
        lines.append(F.when(salience.isNotNull(), salience_text(salience)))
        own.append(salience.alias("salience"))
    if kind is not None:
        lines.append(F.when(F.coalesce(kind, F.lit("")) != "", F.concat(F.lit("COGNITIVE_TYPE: "), kind)))
        own.append(kind.alias("cognitive_type"))
    return F.concat_ws("\n", head, *lines, F.concat(F.lit("RECORD:"), F.to_json(F.struct(*own))))


def record_of(text):
    """The JSON of a rendered reasoning record."""
    return F.nullif(F.regexp_extract(text, r"(?s)^(?:.*\n)?RECORD:([^\n]*)$", 1), F.lit(""))  # the last line


#: Rows of a stretch of the running mean, about.
STRETCH = 4096
_SCAN = "stretch int, series long, rows long, before array<double>, total array<double>"


def _ended(keep: float):
    """The stretch's rows of each series: their number, its first vector, and the mean at its end if it were zero before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        out = []
        for b in batches:
            for stretch, series, v in zip(b.column("stretch").to_pylist(), b.column("series").to_pylist(), b.column("embedding").to_pylist(), strict=True):
                v = np.array(v, float)
                if held is None or held[1] != series:
                    out += [held] if held is not None else []
                    held = [stretch, series, 0, v, np.zeros(len(v))]
                held[2], held[4] = held[2] + 1, keep * held[4] + (1 - keep) * v
        out += [held] if held is not None else []
        columns = zip(*out, strict=True) if out else ((),) * 5
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[x.split(" ")[0] for x in _SCAN.split(", ")])

    return run


def _chained(keep: float):
    """The mean before each stretch of a series, from the means at their ends: a row a stretch."""

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["stretch"])
        mean = np.array(rows[0]["before"])  # the first vector is the mean to begin with
        for r in rows:
            r["before"], mean = mean.tolist(), keep ** r["rows"] * mean + np.array(r["total"])
        return pa.Table.from_pylist([{k: r[k] for k in ("stretch", "series", "before")} for r in rows], pa.schema([("stretch", pa.int32()), ("series", pa.int64()), ("before", pa.list_(pa.float64()))]))

    return run


def _lessened(keep: float, alpha: float):
    def run(key, rows: pa.Table, before: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"series": pa.array([], pa.int64()), "step": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float64()))})
        rows = rows.sort_by("step")
        v = np.array(rows.column("embedding").to_pylist(), float)
        mean, out = np.array(before.column("before")[0].as_py()), []
        for x in v:
            mean = keep * mean + (1 - keep) * x
            out.append(np.clip(x - alpha * mean, 0, 1))
        return pa.table({"series": rows.column("series"), "step": rows.column("step"), "embedding": pa.array(out, pa.list_(pa.float64()))})

    return run


def contrastive(rows: DataFrame, keep: float = 0.95, alpha: float = 1.0) -> DataFrame:
    """Each series' vectors less alpha times a running mean, clipped to [0, 1].

    A stretch of a series is an affine map of the mean before it, so stretches are worked on side by
    side: rows are range-sorted by series and step into stretches of about STRETCH rows, each is
    reduced to its map, the maps of a series (a row a stretch) give the mean before each, and then
    every stretch is gone through by itself. No series is one task. Series and steps are numbers.
    """
    ship(rows.sparkSession)
    own = rows.select(F.col("series").cast("long"), F.col("step").cast("long"), F.col("embedding").cast("array<double>"))
    stretches = max(1, -(-own.count() // STRETCH))
    placed = own.repartitionByRange(stretches, "series", "step").withColumn("stretch", F.spark_partition_id()).sortWithinPartitions("series", "step")
    placed = checkpointed(placed)
    ends = placed.select("stretch", "series", "embedding").mapInArrow(_ended(keep), _SCAN)
    before = ends.groupBy("series").applyInArrow(_chained(keep), "stretch int, series long, before array<double>")
    return placed.groupBy("stretch", "series").cogroup(before.groupBy("stretch", "series")).applyInArrow(_lessened(keep, alpha), "series long, step long, embedding array<double>")


def related(found: DataFrame, side: int) -> DataFrame:
    """found with rels: each object's relations as canonical JSON, adjacent objects in order; the other kinds are empty."""
    near = adjacent(found, side).groupBy("level", "step", "object").agg(F.sort_array(F.collect_set("other")).alias("_near"))  # objects of one frame
    out = found.join(near, ["level", "step", "object"], "left")
    listed = F.array_join(F.transform(F.coalesce("_near", F.array().cast("array<int>")), lambda x: x.cast("string")), ", ")
    return out.withColumn("rels", F.concat(F.lit('{"adjacent": ['), listed, F.lit('], "contains": [], "on_top_of": [], "part_of": null}'))).drop("_near")
