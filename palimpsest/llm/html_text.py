"""Main text of web pages by composite text density.

Every node of a page's tree gets a link-adjusted density: characters per tag, damped by the
share of them inside links. The node whose children's densities sum highest is where the
article is; the least density on its way up to the body is the threshold that a block must
reach, and of each such block the subtree with the highest sum is the text.

Elements that HTML itself declares not to be running text (menus, footers, forms, scripts and
so on) are left out before densities are taken. Classes, ids and roles are evidence only: a
container named after another part (an advert, comments, a sidebar) is left out, unless another
of its names is that of an article, or unless a tenth of the page's text at most would be left
(SHARE); names take no paragraph, heading, quotation, figure or table out.

Tags are read in one pass, in time linear in the page. As browsers do, a quotation mark counts
after "=" only, a tag that is cut off by the page's end is dropped, and so is what an unclosed
comment holds; an attribute whose quotation mark is never closed ends with its tag.

Null or empty html gives an empty text, and so does a page without text. Unclosed, stray and
misnested tags are repaired as browsers do for these cases; nothing is dropped for length.
Rows that repeat, or have a null id or url, are extracted each; empty tables give no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, slices, spread

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What may end a tag, or begin a value in quotation marks inside it.
_STOP = re.compile(r""">|=\s*+["']""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s"'>]++)))?""")
_WORD = re.compile(r"[a-z]+|\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are not running text, with all that they hold.
NOT_TEXT = frozenset("head script style noscript template nav footer aside form button select option textarea input iframe object embed svg math canvas audio video map dialog menu title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Words of a class, id or role that speak of other parts than the article.
NOT_ARTICLE = frozenset("ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disclaimer disqus footer gdpr masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related replies respond share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription teaser toolbar trending widget widgets complementary contentinfo search alert discussion reply login signin toc topbar outbrain taboola".split())
#: Words that name an article, or its header, where a name ends in them.
OWN = frozenset("article body content entry main post story text title".split())
_OTHERS = re.compile(r"\b(?:has|with|without|no|show|hide)[-_]\w+")
#: Elements that names do not take out.
CONTENT = frozenset("html body article main p h1 h2 h3 h4 h5 h6 blockquote q pre figure figcaption table caption thead tbody tr td th dt dd".split())
#: The share of the page's text that must be left for names to be believed.
SHARE = 0.1
#: What the start of an element closes, and the elements that shield from it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())


class _Tree:
    """A page's elements in order: parent, name and whether it stays; texts by element."""

    __slots__ = ("name", "named_out", "parent", "stays", "texts")

    def __init__(self) -> None:
        self.parent, self.name, self.stays, self.named_out = [-1], ["#root"], [True], [False]
        self.texts: list[tuple[int, int, str]] = []  # element, elements begun by then, text

    def add(self, parent: int, name: str, stays: bool, named_out: bool) -> int:
        self.parent.append(parent)
        self.name.append(name)
        self.stays.append(stays)
        self.named_out.append(named_out)
        return len(self.name) - 1


class _Open:
    """The open elements, with the places of each name, so that each step takes constant time."""

    def __init__(self) -> None:
        self.held: list[tuple[int, str]] = [(0, "#root")]
        self.at: dict[str, list[int]] = {}
        self.blocks = [0]  # places of those that are not inline

    def push(self, element: int, name: str) -> None:
        self.at.setdefault(name, []).append(len(self.held))
        if name not in INLINE:
            self.blocks.append(len(self.held))
        self.held.append((element, name))

    def cut(self, place: int) -> None:
        while len(self.held) > place:
            name = self.held.pop()[1]
            self.at[name].pop()
            if name not in INLINE:
                self.blocks.pop()

    def last(self, name: str) -> int:
        places = self.at.get(name)
        return places[-1] if places else 0

    def end(self, name: str) -> None:
        place = self.last(name)
        if place and (name not in INLINE or self.blocks[-1] < place):  # a stray end of an inline element closes no block
            self.cut(place)

    def begin(self, name: str) -> None:
        """Closes what the start of an element closes."""
        if name in CLOSES_P and self.held[self.blocks[-1]][1] == "p":
            self.cut(self.blocks[-1])
        if name in CLOSES:
            ends, shield = CLOSES[name]
            floor = max(map(self.last, shield))
            first = [places[k] for e in ends if (places := self.at.get(e)) and (k := bisect_right(places, floor)) < len(places)]
            if first:
                self.cut(min(first))


def _tag(page: str, at: int, last: dict[str, int]) -> int:
    """Where the tag whose attributes begin at `at` ends (the place of its ">"), or -1."""
    while (m := _STOP.search(page, at)) is not None:
        if m[0] == ">":
            return m.start()
        quote = m[0][-1]
        at = page.index(quote, m.end()) + 1 if last[quote] >= m.end() else m.end()
    return -1


def _declared_out(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element says that it is not running text: by HTML's own means, or by its names."""
    if name in NOT_TEXT or name == "header" and not inside:
        return True, False
    if not attributes:
        return False, False
    other = own = False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return True, False
        if key in ("class", "id", "role", "aria-label") and name not in CONTENT:
            for token in [value] if key == "aria-label" else value.split():
                words = _WORD.findall(_OTHERS.sub("", token))
                if words and words[-1] in OWN:
                    own = True
                elif not NOT_ARTICLE.isdisjoint(words) or "header" in words and not inside and OWN.isdisjoint(words):
                    other = True
    return False, other and not own


def parse(page: str) -> _Tree:
    """The page's tree."""
    t, open_ = _Tree(), _Open()
    at, end, text = 0, len(page), 0
    last = {q: page.rfind(q) for q in "\"'"}
    while True:
        at = page.find("<", at)
        head = page[at + 1 : at + 2] if at >= 0 else ""
        closing = head == "/"
        m = _NAME.match(page, at + 1 + closing) if at >= 0 else None
        if at >= 0 and m is None and head not in ("!", "?"):
            at += 1  # a sign, not a tag
            continue
        stop = end if at < 0 else at
        if stop > text:
            t.texts.append((open_.held[-1][0], len(t.name), page[text:stop]))
        if at < 0:
            return t
        if m is None:
            to = page.find("-->", at + 4) if page.startswith("<!--", at) else page.find(">", at)
            at = text = end if to < 0 else to + (3 if page[to] == "-" else 1)
            continue
        to = _tag(page, m.end(), last)
        if to < 0:
            return t  # cut off by the page's end
        name, attributes = m[0].lower(), page[m.end() : to]
        at = text = to + 1
        if closing:
            open_.end(name)
            continue
        open_.begin(name)
        up = open_.held[-1][0]
        out, named = _declared_out(name, attributes, bool(open_.at.get("article") or open_.at.get("main")))
        me = t.add(up, name, t.stays[up] and not out, t.named_out[up] or named)
        if name in VOID or attributes.endswith("/") and name not in INLINE and name not in CLOSES_P:
            continue
        if name in RAW:
            stop = re.compile(f"</{name}[\\s/>]", re.I).search(page, at)
            at = text = page.find(">", stop.start()) + 1 or end if stop else end
            continue
        open_.push(me, name)


def main_text(page: str | None) -> str:
    """The article of a page, one line a block."""
    if not page:
        return ""
    t = parse(page)
    sizes = [0, 0]  # of the text that stays, and of its part that names do not take out
    for e, _, raw in t.texts:
        if t.stays[e]:
            size = len("".join(raw.split()))
            sizes[0] += size
            sizes[1] += size * (not t.named_out[e])
    if sizes[1] > SHARE * sizes[0]:
        t.stays = [s and not n for s, n in zip(t.stays, t.named_out, strict=True)]
    return _main(t)


def _main(t: _Tree) -> str:
    n = len(t.name)
    chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[t.parent[i]] or t.name[i] == "a"
        if t.stays[i]:
            tags[i] += 1
            link_tags[i] += in_link[i]
    texts, page_chars, page_links = [], 0, 0
    for e, begun, raw in t.texts:
        s = html.unescape(raw)
        size = len(" ".join(s.split()))
        page_chars += size
        page_links += size * in_link[e]
        if t.stays[e]:
            texts.append((e, begun, s))
            chars[e] += size
            link_chars[e] += size * in_link[e]
    for i in range(n - 1, 0, -1):
        p = t.parent[i]
        chars[p] += chars[i]
        link_chars[p] += link_chars[i]
        tags[p] += tags[i]
        link_tags[p] += link_tags[i]
    if not chars[0]:
        return ""
    body = next((i for i in range(n) if t.name[i] == "body"), 0)
    if chars[body] < chars[0]:
        body = 0  # text outside of the body counts as well
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        if t.stays[i] and chars[i]:
            density[i] = _density(chars[i], link_chars[i], max(tags[i], 1), link_tags[i], page_links / page_chars)
    for i in range(1, n):
        total[t.parent[i]] += density[i]
    return _render(t, texts, _blocks(t, body, density, total))


def _density(c: int, lc: int, g: int, lg: int, page_ratio: float) -> float:
    """Characters per tag, damped by the node's and the page's share of characters in links."""
    base = math.log(c / max(c - lc, 1) * lc + page_ratio * c + math.e)
    if base <= 1:
        return c / g  # the page has no links
    return c / g * max(math.log(c / max(lc, 1) * g / max(lg, 1)), 0.0) / math.log(base)


def _subtree_best(t: _Tree, children: list[list[int]], top: int, total: list[float]) -> int:
    """The element under (or at) top whose children's densities sum highest; the outermost of equals."""
    best, stack = top, [top]
    while stack:
        i = stack.pop()
        if total[i] > total[best]:
            best = i
        stack.extend(c for c in children[i] if t.name[c] not in INLINE)
    return best


def _blocks(t: _Tree, body: int, density: list[float], total: list[float]) -> set[int]:
    children: list[list[int]] = [[] for _ in t.name]
    for i in range(1, len(t.name)):
        if t.stays[i]:
            children[t.parent[i]].append(i)
    best = _subtree_best(t, children, body, total)
    least, i, whole = math.inf, best, 0
    while i > 0 and i != body:
        least = min(least, density[i])
        whole = i if t.name[i] in ("article", "main") else whole
        i = t.parent[i]
    best = whole or best  # an element that says it is the article is taken as a whole
    if best == body or least is math.inf:
        return {body}
    above, i = set(), best
    while i > 0:
        i = t.parent[i]
        above.add(i)
    found, stack = {best}, [body]
    while stack:
        i = stack.pop()
        if i == best:
            continue
        if i == body or i in above:
            stack.extend(children[i])
        elif not whole and density[i] >= least and t.name[i] not in INLINE:
            found.add(i)
    return found


def _render(t: _Tree, texts: list[tuple[int, int, str]], blocks: set[int]) -> str:
    inside = [False] * len(t.name)
    block = [0] * len(t.name)
    for i in range(len(t.name)):
        p = t.parent[i]
        inside[i] = i in blocks or p >= 0 and inside[p]
        block[i] = block[p] if t.name[i] in INLINE and p >= 0 else i
    lines: list[list[str]] = []
    at, seen = -1, 0
    for e, begun, s in texts:
        if not inside[e]:
            continue
        between = [k for k in range(seen, begun) if t.stays[k]]
        if block[e] != at or any(t.name[k] not in INLINE for k in between):
            lines.append([])
            at = block[e]
        elif any(t.name[k] == "br" for k in between):
            lines[-1].append(" ")
        lines[-1].append(s)
        seen = begun
    joined = (" ".join("".join(x).split()) for x in lines)
    return "\n".join(x for x in joined if x)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        texts = [main_text(h) for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return map_arrow(spread(pages.select("page_id", "url", "html")), _extract, f"page_id {kind}, url string, text string, n_chars long")
