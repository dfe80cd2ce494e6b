"""Text expressions: tags, keywords, truncation, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no keywords (fixed values).
STOP_WORDS = frozenset("the a an is are was were of in to and or for on it be as at by this that with from not but has had have do does did will can its who what how why".split())
#: White space as str.split() knows it; regular expressions' \s knows less (fixed values).
SPACE = r"[\s\x1c-\x1f\u0085   -     　]"
#: Limits on stored contents and queries, in characters (fixed values).
MAX_TEXT, MAX_QUERY = 10_000, 2_000
KEYWORD_BOOST, MOST_BOOST = 0.03, 0.12
BREAK = "---PASSAGE_BREAK---"


#: The same characters one by one.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))


def words(text: Column) -> Column:
    """Runs of anything but white space. All of it becomes blanks first, as splitting at one character is fast."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def tags(text: Column) -> Column:
    """Tags of a leading [...] whose ] is among the first 201 characters; / and , part them."""
    close = F.locate("]", text)
    inner = F.substring(text, F.lit(2), close - 2)
    return F.when(text.startswith("[") & close.between(1, 201), words(F.translate(inner, "/,", "  "))).otherwise(F.array().cast("array<string>"))


def meta_tags(meta: Column) -> Column:
    """key:value of a map's non-empty values."""
    return F.transform(F.filter(F.map_entries(meta), lambda e: e["value"].isNotNull() & (e["value"] != "")), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))


def has_tag(own: Column, wanted: str) -> Column:
    """Equality, or, for a wanted tag that ends in a colon, a prefix."""
    return F.exists(own, lambda t: t.startswith(wanted) if wanted.endswith(":") else t == wanted)


def tags_all(own: Column, wanted: list[str]) -> Column:
    out = F.lit(True)
    for w in wanted:
        out = out & has_tag(own, w)
    return out


def tags_any(own: Column, wanted: list[str]) -> Column:
    out = F.lit(not wanted)
    for w in wanted:
        out = out | has_tag(own, w)
    return out


def keywords(query: str) -> list[str]:
    """Lower-cased words of three letters or more that are no stop words; repeats stay."""
    return [w for w in query.lower().split() if len(w) >= 3 and w not in STOP_WORDS]


def keyword_boost(text: Column, wanted: list[str]) -> Column:
    low, hits = F.lower(text), F.lit(0)
    for w in wanted:
        hits = hits + low.contains(w).cast("int")
    return F.least(KEYWORD_BOOST * hits, F.lit(MOST_BOOST))


def preview(text: Column, n: int, more: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(more))).otherwise(text)


def soft_truncate(text: Column, soft: int = 250, hard: int = 550) -> Column:
    """Cut at the first end of a sentence from soft on, at the last space before hard, or at hard."""
    cut = []
    for mark in (". ", "? ", "! ", "\n"):
        at = F.locate(mark, text, soft + 1)
        cut.append(F.when((at > 0) & (at - 1 + len(mark) <= hard), at - 1 + len(mark)))
    window = F.substring(text, soft + 1, hard - soft)
    back = F.locate(" ", F.reverse(window))
    cut.append(F.when(back > 0, F.lit(hard) - back))
    end = F.coalesce(*cut, F.lit(hard))
    return F.when(F.length(text) <= hard, text).otherwise(F.concat(F.rtrim(F.substring(text, F.lit(1), end)), F.lit(" …")))


def split_prefix(text: Column) -> tuple[Column, Column]:
    """(tag, body) of a text whose leading [...] closes within 300 characters."""
    close = F.locate("]", text)
    tagged = text.startswith("[") & close.between(1, 300)
    return F.when(tagged, F.substring(text, F.lit(2), close - 2)), F.when(tagged, strip(F.substring(text, close + 1, F.length(text)))).otherwise(text)


def exchange_key(text: Column) -> Column:
    """url|turn of an exchange's prefix, in its comma or its pipe form; null without both."""
    close = F.locate("]", text)
    prefix = F.when(text.startswith("[") & close.between(1, 300), F.substring(text, F.lit(2), close - 2))
    comma = F.transform(F.split(prefix, ","), lambda t: F.trim(t))
    first = lambda xs: F.try_element_at(xs, F.lit(1))
    turn1 = F.when(prefix.contains(","), first(F.filter(comma, lambda t: t.startswith("turn-"))))
    url1 = F.when(prefix.contains(","), F.substring(first(F.filter(comma, lambda t: t.startswith("url="))), F.lit(5), F.lit(1000)))
    pipe = F.transform(F.split(prefix, "[|]"), lambda t: F.trim(t))
    numbered = first(F.filter(pipe, lambda t: F.lower(t).rlike(r"^turn\s+\d+(\s|$)")))
    turn2 = F.when(prefix.contains("|"), F.concat(F.lit("turn-"), F.nullif(F.regexp_extract(numbered, r"(\d+)", 1), F.lit(""))))
    last = F.try_element_at(pipe, F.lit(-1))
    url2 = F.when(prefix.contains("|") & last.contains("/") & last.contains("."), last)
    return F.concat(F.nullif(F.coalesce(url1, url2), F.lit("")), F.lit("|"), F.nullif(F.coalesce(turn1, turn2), F.lit("")))


def word_set(text: Column) -> Column:
    """The lower-cased words, each once."""
    return F.array_distinct(words(F.lower(text)))


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of lower-cased words; 0 for empty ones."""
    return overlap(word_set(a), word_set(b))


def overlap(x: Column, y: Column) -> Column:
    """Jaccard of two sets; 0 for empty ones."""
    either = F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / either)


def source_hash(source: Column) -> Column:
    """The first eight hex digits of a source's MD5 as a number."""
    return F.conv(F.substring(F.md5(source), 1, 8), 16, 10).cast("long")


def source_of(text: Column) -> Column:
    """A passage's source: of a poem's tag, of any tag, or its first line without (part n/m)."""
    poem = F.trim(F.regexp_extract(text, r'^\[Poem:\s*(?:"[^"]*"\s*from\s*)?(.+?\s+by\s+.+?)\]', 1))
    tag = F.trim(F.regexp_extract(text, r"^\[([^\]]+)\]", 1))
    line = F.regexp_replace(F.trim(F.substring(F.substring_index(text, "\n", 1), 1, 80)), r"\s*\(part\s+\d+/\d+\)\s*$", "")
    empty = F.lit("")
    return F.coalesce(F.nullif(poem, empty), F.nullif(tag, empty), F.nullif(line, empty), F.lit("unknown"))


def safe_name(name: str) -> str:
    """A collection's name without folders; raises for signs that a name may not have."""
    import os
    import re

    base = os.path.basename(name)
    if not re.fullmatch(r"[a-zA-Z0-9][a-zA-Z0-9_\- \.]*", base):
        raise ValueError(f"not a collection name: {name!r}")
    return base


def machine_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9_\-]", "_")


def perms_bits(text: Column) -> Column:
    """Bits of a permission string such as rw-a."""
    out = F.lit(0)
    for letter, bit in (("r", 1), ("w", 2), ("d", 4), ("a", 8)):
        out = out + F.when(text.contains(letter), F.lit(bit)).otherwise(F.lit(0))
    return out


def perms_text(bits: Column) -> Column:
    return F.concat(*(F.when(bits.bitwiseAND(F.lit(bit)) != 0, F.lit(letter)).otherwise(F.lit("-")) for letter, bit in (("r", 1), ("w", 2), ("d", 4), ("a", 8))))
