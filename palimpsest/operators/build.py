"""Corpus building: passages, chunks, links, catalog rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec, runtime
from ..functions import text as T
from ..schema import ARCHIVAL, FORM, HAS_CHILD, HAS_PARENT, PERM_R, PERM_W, PINNED

#: First and last lines of a public-domain e-book's own text (fixed values, in order of rank).
STARTS = ("*** START OF THE PROJECT GUTENBERG", "*** START OF THIS PROJECT GUTENBERG", "***START OF THE PROJECT GUTENBERG", "*END*THE SMALL PRINT")
ENDS = ("*** END OF THE PROJECT GUTENBERG", "*** END OF THIS PROJECT GUTENBERG", "***END OF THE PROJECT GUTENBERG", "End of the Project Gutenberg", "End of Project Gutenberg")


def word_chunks(docs: DataFrame, size: int = 300, overlap: int = 50) -> DataFrame:
    """doc_id, chunk, text: windows of words; texts with passage breaks are cut there instead.

    A text of up to size words is one trimmed chunk; longer ones begin a window every
    size - overlap words, also where it lies wholly in the one before.
    """
    d = docs.withColumn("_w", T.words(F.col("text"))).withColumn("_n", F.size("_w"))
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.col("_n") - 1, F.lit(0)), F.lit(size - overlap)), lambda s: F.array_join(F.slice(F.col("_w"), s + 1, F.lit(size)), " "))
    passages = F.filter(F.transform(F.split("text", T.BREAK), lambda p: T.strip(p)), lambda p: p != "")
    parts = F.when(F.col("text").contains(T.BREAK), passages).when(F.col("_n") <= size, F.array(T.strip(F.col("text")))).otherwise(starts)
    return d.select(*[c for c in docs.columns if c != "text"], F.posexplode(parts).alias("chunk", "text"))


def prefixed_chunks(docs: DataFrame, title: Column, author: Column, size: int = 200, overlap: int = 40) -> DataFrame:
    """Windows of words behind '[title by author] '."""
    d = docs.withColumn("_w", T.words(F.col("text"))).withColumn("_head", F.concat(F.lit("["), title, F.lit(" by "), author, F.lit("] "))).filter(F.size("_w") > 0)
    parts = F.transform(F.sequence(F.lit(0), F.size("_w") - 1, F.lit(size - overlap)), lambda s: F.concat(F.col("_head"), F.array_join(F.slice(F.col("_w"), s + 1, F.lit(size)), " ")))
    return d.select(*[c for c in docs.columns if c != "text"], F.posexplode(parts).alias("chunk", "text"))


def strip_boilerplate(text: Column, collapse: bool = False) -> Column:
    """A text between the first start and the first end marker that it has; collapse thins blank lines."""
    start = F.lit(1)
    for m in reversed(STARTS):
        line = F.locate("\n", text, 1)
        at = F.locate(m, text)
        line = F.expr("0") + F.call_function("locate", F.lit("\n"), text, F.greatest(at, F.lit(1)))
        start = F.when(at > 0, F.when(line > 0, line + 1).otherwise(F.lit(1))).otherwise(start)
    end = F.length(text) + 1
    for m in reversed(ENDS):
        at = F.locate(m, text)
        end = F.when(at > 0, at).otherwise(end)
    out = T.strip(F.substring(text, start, F.greatest(end - start, F.lit(0))))
    return F.regexp_replace(out, "\n{4,}", "\n\n\n") if collapse else out


def part_prefix(chunks: DataFrame, source: str = "source") -> DataFrame:
    """'source (part i/n)' or, for single chunks, 'source' on a line before each chunk."""
    n = F.count("*").over(Window.partitionBy(source))
    head = F.when(n > 1, F.format_string("%s (part %d/%d)", source, F.col("chunk") + 1, n)).otherwise(F.col(source))
    return chunks.withColumn("text", F.concat(head, F.lit("\n"), "text"))


#: Numbers of a source that are chained in one task.
STRETCH = 1 << 16


def links(patterns: DataFrame, source: str = "source") -> DataFrame:
    """Adds pattern_id, prev, next, sequence_num, source_hash, flags, perms_byte: the chain of each source.

    A source's rows are chained stretch by stretch (STRETCH numbers each); the stretches' ends
    and counts, a row each, are chained in turn, so that no task holds a source.
    """
    rows = patterns.withColumn("_stretch", F.floor(F.col("idx") / STRETCH))
    ends = rows.groupBy(source, "_stretch").agg(F.min("idx").alias("_first"), F.max("idx").alias("_last"), F.count("*").alias("_n"))
    order = Window.partitionBy(source).orderBy("_stretch")
    ends = ends.select(
        F.col(source).alias("_source"), F.col("_stretch").alias("_s"), F.lag("_last").over(order).alias("_before"), F.lead("_first").over(order).alias("_after"),
        (F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_offset"),
    )
    rows = rows.join(ends, F.col(source).eqNullSafe(F.col("_source")) & (F.col("_stretch") == F.col("_s")))
    own = Window.partitionBy(source, "_stretch").orderBy("idx")
    prev, after = F.coalesce(F.lag("idx").over(own), "_before") + 1, F.coalesce(F.lead("idx").over(own), "_after") + 1
    out = rows.withColumns({"pattern_id": F.col("idx") + 1, "prev": prev, "next": after, "sequence_num": (F.row_number().over(own) - 1 + F.col("_offset")).cast("int"), "source_hash": T.source_hash(F.col(source))})
    flags = F.when(F.col("prev").isNotNull(), F.lit(HAS_PARENT)).otherwise(F.lit(0)).bitwiseOR(F.when(F.col("next").isNotNull(), F.lit(HAS_CHILD)).otherwise(F.lit(0)))
    return out.drop("_stretch", "_source", "_s", "_before", "_after", "_offset").withColumn("flags", flags).withColumn("perms_byte", F.lit(3))


def passage_links(linked: DataFrame) -> DataFrame:
    """Each pattern with the shortened texts before and after it, by its own pointers."""
    side = lambda name: linked.select(F.col("pattern_id").alias(name), T.preview(F.col("text"), 120, "").alias(f"{name}_text"))
    return linked.join(side("prev"), "prev", "left").join(side("next"), "next", "left")


def relink(texts: DataFrame) -> DataFrame:
    """Chains from the sources that the texts' own prefixes name."""
    return links(texts.withColumn("source", T.source_of(F.col("text"))))


def rebuild(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """New chunks with the old rows' metadata where there is one, chunk and chunks written anew."""
    n = F.lit(chunks.count())
    out = chunks.join(meta.select("idx", F.col("meta").alias("_m")), "idx", "left")
    fresh = F.map_from_arrays(F.array(F.lit("chunk"), F.lit("chunks")), F.array(F.col("idx").cast("string"), n.cast("string")))
    kept = F.map_filter(F.coalesce("_m", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("chunk", "chunks"))
    return out.withColumn("meta", F.map_concat(kept, fresh)).drop("_m")


def legacy_links(patterns: DataFrame, at: int, kind: int) -> DataFrame:
    """Link records for rows (idx) of a collection that has none: row 0 is the read-only header and
    points to row 1, the page of instructions, if there is one; both are pinned and never perish.
    Others are plain and perish with time."""
    head = F.col("idx") <= 1
    more = patterns.agg(F.max("idx").alias("_last"))  # one row
    return patterns.join(F.broadcast(more)).select(
        "idx", F.col("idx").alias("pattern_id"), F.lit(FORM).alias("format_version"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("prev"),
        F.when((F.col("idx") == 0) & (F.col("_last") > 0), 1).otherwise(0).cast("long").alias("next"), F.lit(0).cast("long").alias("sibling"), F.lit(0).cast("long").alias("source_hash"),
        F.col("idx").alias("sequence_num"), F.lit(at).cast("long").alias("ts_unix"), F.when(head, PINNED | ARCHIVAL).otherwise(0).alias("flags"),
        F.when(F.col("idx") == 0, PERM_R).otherwise(PERM_R | PERM_W).alias("perms_byte"),
    )


def pattern_totals(manifests: DataFrame) -> DataFrame:
    """collections and total_patterns of all that is mounted."""
    return manifests.agg(F.count("*").alias("collections"), F.coalesce(F.sum("n_patterns"), F.lit(0)).alias("total_patterns"))


def built(texts: DataFrame, name: str, embed=None, created: int = 0, chunk: bool = True, prefix: bool = True) -> DataFrame:
    """A whole collection of texts (source, text): chunked, prefixed by part, embedded and linked, behind a pinned read-only header.

    Rows are numbered by source and chunk: sources are counted, and their running sum gives each its first number.
    """
    parts = word_chunks(texts) if chunk else texts.withColumn("chunk", F.lit(0))
    each = parts.groupBy("source").agg(F.count("*").alias("_n"))
    first = each.withColumn("_first", F.sum("_n").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n") + 1)  # a row a source
    rows = part_prefix(parts) if prefix else parts
    rows = rows.join(first, "source").withColumn("idx", F.col("_first") + F.row_number().over(Window.partitionBy("source").orderBy("chunk")) - 1).drop("_first", "_n")
    out = links(rows).select("idx", "source", "chunk", "text", "pattern_id", "prev", "next", "sequence_num", "source_hash", "flags", "perms_byte")
    head = texts.sparkSession.createDataFrame([(0, f"[HEADER] {name}", 1, PINNED, PERM_R)], "idx long, text string, pattern_id long, flags int, perms_byte int")
    out = out.unionByName(head, allowMissingColumns=True).withColumn("ts_unix", F.lit(created).cast("long"))
    return out.withColumn("embedding", embed("text")) if embed is not None else out


def even_sample(rows: DataFrame, most: int) -> DataFrame:
    """`most` rows spread evenly over idx 0 .. N-1: floor(i N / most)."""
    n = rows.count()
    if n <= most:
        return rows
    ids = rows.sparkSession.range(most).select(F.floor(F.col("id") * n / most).alias("idx"))
    return rows.join(F.broadcast(ids), "idx", "left_semi")  # `most` rows, a parameter


def manifest(patterns: DataFrame) -> DataFrame:
    """collection, n_patterns, dim and fingerprint (over the first and last vector and the count)."""
    runtime.ship(patterns.sparkSession)
    ends = patterns.groupBy("collection").agg(F.count("*").alias("n_patterns"), F.min_by("embedding", "idx").alias("_a"), F.max_by("embedding", "idx").alias("_b"))
    return ends.select("collection", "n_patterns", F.size("_a").alias("dim"), codec.fingerprint("_a", "_b", "n_patterns").alias("fingerprint"))


def verify(patterns: DataFrame, manifests: DataFrame) -> DataFrame:
    """collection, ok: whether count and fingerprint agree; a collection without manifest is fine."""
    now = manifest(patterns).withColumnsRenamed({"n_patterns": "_n", "fingerprint": "_f"})
    out = now.join(manifests.select("collection", "n_patterns", "fingerprint"), "collection", "left")
    return out.select("collection", F.coalesce((F.col("_n") == F.col("n_patterns")) & (F.col("_f") == F.col("fingerprint")), F.lit(True)).alias("ok"))


#: Titles: capitals alone on a line, or a Roman or decimal number before one (fixed patterns).
_CAPITALS = re.compile(r"[A-Z][A-Z\s\-',.!?:;]{4,60}")
_NUMBERED = re.compile(r"(?:[IVXLC]+|\d+)\.?\s(.+)?")
SHORT_TEXT, SHORT_WORDS, LONG_WORDS, GROUP_WORDS = 20, 8, 600, 400


def poems_of(text: str, collection: str, author: str, titled: bool = True) -> list[str]:
    """The poems of a collection, each behind its tag; long ones in groups of stanzas.

    Three blank lines end a poem; after two, a title begins one. Where poems have no titles, a line
    that looks like one, with a number before it, is verse.
    """
    found: list[tuple[str | None, list[str]]] = [(None, [])]
    blank = 0
    for line in text.split("\n"):
        bare = line.strip()
        if not bare:
            blank += 1
            if blank == 3 and found[-1][1]:
                found.append((None, []))
            continue
        title = None
        if titled and blank >= 2:
            if _CAPITALS.fullmatch(bare):
                title = bare.title()
            elif m := _NUMBERED.match(bare):
                title = (m[1] or "").strip() or bare
        blank = 0
        if title is None:
            found[-1][1].append(line)
        elif found[-1][1]:
            found.append((title, []))
        else:
            found[-1] = (title, [])
    out = []
    for title, lines in found:
        body = "\n".join(lines).strip()
        n = len(body.split())
        if len(body) < SHORT_TEXT or n < SHORT_WORDS:
            continue
        named = f'"{title}" from ' if title else ""
        head = f"[Poem: {named}{collection} by {author}]"
        out += [f"{head}\n{part}" for part in (_stanzas(body) if n > LONG_WORDS else [body])]
    return out


def _stanzas(body: str) -> list[str]:
    groups: list[list[str]] = [[]]
    held = 0
    for stanza in re.split(r"\n\s*\n", body):
        n = len(stanza.split())
        if groups[-1] and held + n > GROUP_WORDS:
            groups.append([])
            held = 0
        groups[-1].append(stanza)
        held += n
    return ["\n\n".join(g) for g in groups if g]


def poems(books: DataFrame, least: int = 3, titled: bool = True) -> DataFrame:
    """book, chunk, text of books (book, title, author, text); fewer than `least` poems: word windows.

    titled: whether the books' poems may have titles.
    """
    runtime.ship(books.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(r.book, i, p) for r in f.itertuples() if len(ps := poems_of(r.text, r.title, r.author, titled)) >= least for i, p in enumerate(ps)]
            yield pd.DataFrame(rows, columns=["book", "chunk", "text"])

    kind = books.schema["book"].dataType.simpleString()
    split = runtime.checkpointed(books.mapInPandas(run, f"book {kind}, chunk int, text string"))  # parsed once
    rest = books.join(split.select("book").distinct(), "book", "left_anti")
    return split.unionByName(prefixed_chunks(rest, F.col("title"), F.col("author")).select("book", "chunk", "text"))
