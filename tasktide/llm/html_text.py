"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged: elements with the same path (tags and class words from the root down) are one node
of the host's style tree. A node's presentation importance is the entropy, over the pages that have it, of its styles (the
elements below it in order, and the power of two that its text's length has); its content importance is the entropy of
its texts; both with logarithms to the base of the number of pages, so that 1 means a different value on every page and 0
the same on all. The importance of a container (div, section, nav, ...) is the mean of both, that of a block of text
(heading, paragraph, cell, ...) the content's. It is drawn towards `neutral` by `weight` pages, as few pages say little:
a host of any size is judged in the same way. Pages of a host with equal html are one page, as copies are no evidence.

Names are a prior: a node's importance is multiplied by a factor for what its tag, role, classes or id say. Navigation,
footers, forms, adverts, comments and the like have one so low that no evidence lifts them over `limit`; words that
pages also use for content (header, social, related, a part of a longer class name) have one that presentation and
content of the site's pages decide about, both ways; inside article and main elements these weigh little, and ids nothing.
Branches below `limit` are removed from every page of the host. Text of article or main elements, where a page has any
that are kept, is its main text.

Only nodes on two or more pages can be judged otherwise than by name and `neutral`; those that are, are one short row for
each host, and a page's text is made in the task that reads the page, so no page is shuffled where Spark can broadcast
these rows. Node counts are map-side sums over a host, path and value.

Defined results: null or empty html gives the empty text; a null or odd url is a host named by the empty string;
repeated rows keep a row each in the result; unclosed or misnested tags end with the elements around them; elements nest
to any depth; a tag without end is text, an attribute value without end stops at the next ">"; a form that holds most of a
page's text is no form but the page; what is removed leaves a block's end, so the words around it don't join. The time to
read a page is linear in its length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Workspace

_NAME = re.compile(r"/?([a-zA-Z][^\s/<>\"'=]*)")
_PLAIN = re.compile(r"[^<>=]*")
_SPACE = re.compile(r"\s*")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_RAW = frozenset("script style noscript template textarea title svg math iframe object canvas video audio select button".split())
_TO_THE_END = frozenset("script style textarea title".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed frame hr img input link meta param source track".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LISTS = frozenset("ul ol dl table select".split())
_BLOCKS_OF_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th pre blockquote figcaption caption summary address".split())
_NO_CONTENT_TAGS = frozenset("nav footer aside form menu head dialog fieldset".split())
_NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Class words that name no content where they are a whole class.
_NO_CONTENT = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar masthead comment comments disqus cookie cookies "
    "consent gdpr popup modal overlay subscribe newsletter share sharing pagination pager footer replies responses respond".split()
)
#: Words that often, not always, do; so do those above as parts of longer names.
_DOUBTFUL = _NO_CONTENT | frozenset("banner header aside widget notice signup login social related recommended toolbar copyright legal skip".split())

#: Words that say where or how something stands, so that a longer name with one of the above says no more than that one.
_PLACES = frozenset("area bar block bottom box button buttons col column container desktop element fixed global group icon icons inner item items left link links list main mobile module outer page panel posts region right row section site sticky stories top wrap wrapper".split())
#: Raw elements that show nothing, so the text around them goes on.
_UNSEEN = frozenset("script style noscript template title".split())
#: Items of lists and tables, and what they are in.
_ITEMS = frozenset(_SAME) | _LISTS

#: What a node's name says: kinds of names, from no content to nothing.
SURE, DOUBTFUL, DOUBTFUL_IN_MAIN, PLAIN = range(4)


class _Node:
    """An open element. paragraph and item: the places in the stack of the innermost element, itself included, that ends the
    search for an open paragraph, or for an open item of a list or table; 0 if there is none."""

    __slots__ = ("tag", "path", "kind", "style", "content", "size", "noise", "main", "paragraph", "item")

    def __init__(self, tag: str, path: int, kind: int, noise: bool, main: bool, paragraph: int = 0, item: int = 0):
        self.tag, self.path, self.kind, self.noise, self.main, self.style, self.content, self.size = tag, path, kind, noise, main, 0, 0, 0
        self.paragraph, self.item = paragraph, item


def _doubtful(value: str) -> bool:
    """Whether a class or id is, or ends with, a doubtful word, or says nothing else but places."""
    for name in value.split():
        words = _WORD.findall(name)
        if words and (words[-1] in _DOUBTFUL or (not _DOUBTFUL.isdisjoint(words) and all(w in _DOUBTFUL or w in _PLACES for w in words))):
            return True
    return False


def _named(tag: str, attributes: str, within_main: bool, plain_forms: bool = False) -> tuple[str, int]:
    """The name of an element in its path, and the kind of name."""
    kind = SURE if (tag in _NO_CONTENT_TAGS and not (plain_forms and tag == "form")) or (tag == "header" and not within_main) else PLAIN
    name, doubtful = tag, False
    if "=" in attributes and tag not in ("body", "html", "main"):
        for m in _ATTRIBUTE.finditer(attributes):
            of, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if of == "role":
                kind = SURE if value.strip() in _NO_CONTENT_ROLES else kind
                continue
            words = _WORD.findall(value)
            name += "." + "-".join(words)
            if not _NO_CONTENT.isdisjoint(value.split()) and (of == "class" or not within_main):
                kind = SURE
            elif tag not in _BLOCKS_OF_TEXT and not (of == "id" and within_main) and _doubtful(value):
                doubtful = True
    return name, kind if kind == SURE or not doubtful else DOUBTFUL_IN_MAIN if within_main else DOUBTFUL


def _tag_end(text: str, at: int, unclosed: dict[str, int]) -> int:
    """Where the tag whose name ends at `at` ends: at its ">", or before a "<"; -1 if nothing ends it. Where such searches
    to the end of a page have read it many times over, the next ">" ends a tag."""
    n, begin = len(text), at
    while unclosed.get("read", 0) <= 16 * n:
        at = _PLAIN.match(text, at).end()
        if at == n:
            unclosed["read"] = unclosed.get("read", 0) + n - begin
            return -1
        if text[at] != "=":
            return at
        at = _SPACE.match(text, at + 1).end()
        if at < n and (q := text[at]) in "\"'":
            end = text.find(q, at + 1) if at < unclosed.get(q, n) else -1
            if end < 0:
                unclosed[q] = min(at, unclosed.get(q, n))
                break
            at = end + 1
    return text.find(">", at) if at < unclosed.get(">", n) else -1


def walk(text: str, unlike: frozenset[int] | None) -> tuple[list[tuple[str, bool]], list[tuple[int, int, bool, int, int]]]:
    """_walk(), with forms taken for plain elements where one holds most of the page's text."""
    *found, form = _walk(text, unlike, False)
    return _walk(text, unlike, True)[:2] if form else tuple(found)


def _walk(text: str, unlike: frozenset[int] | None, plain_forms: bool) -> tuple[list[tuple[str, bool]], list[tuple[int, int, bool, int, int]], bool]:
    """Parts of the page's text that are content, each with whether it lies in an article or main element; a part that is a
    single space stands for a block's end. And (path, kind of name, block of text, style, content) of each element; and
    whether a form holds most of the text.

    unlike holds the paths that are judged otherwise than their names alone would be; without it nothing is removed."""
    parts: list[tuple[str, bool]] = []
    nodes: list[tuple[int, int, bool, int, int]] = []
    stack = [_Node("", 1, PLAIN, False, False)]
    opened: dict[str, int] = {}
    form = 0
    unclosed: dict[str, int] = {">": text.rfind(">") + 1}
    ends: dict[str, int] = {}
    at, pos, n = 0, 0, len(text)

    def close(depth: int) -> None:
        nonlocal form
        block = False
        while len(stack) > depth:
            e = stack.pop()
            opened[e.tag] -= 1
            up = stack[-1]
            block |= e.tag not in _INLINE or (e.noise and not up.noise)
            if e.tag == "form":
                form = max(form, e.size)
            up.content = crc32(e.content.to_bytes(4, "big"), up.content)
            up.size += e.size
            nodes.append((e.path, e.kind, e.tag in _BLOCKS_OF_TEXT or e.tag in _INLINE, crc32(b"%d" % e.size.bit_length(), e.style), e.content))
        if block:
            parts.append((" ", False))

    def put(end: int) -> None:
        top = stack[-1]
        chunk = text[pos:end]
        top.content, top.size = crc32(chunk.encode("utf-8", "replace"), top.content), top.size + end - pos
        if not top.noise:
            parts.append((entities.unescape(chunk), top.main))

    while at < n:
        i = text.find("<", at)
        if i < 0:
            break
        at = i + 1
        first = text[at : at + 1]
        if first in ("!", "?"):
            if i > pos:
                put(i)
            end = text.find("-->", at + 1) + 2 if text.startswith("!--", at) else text.find(">", at)
            at = pos = end + 1 if end >= at else n
            continue
        m = _NAME.match(text, at)
        if not m:
            continue
        end = _tag_end(text, m.end(), unclosed)
        if end < 0:
            continue
        if i > pos:
            put(i)
        attributes = text[m.end() : end]
        at = pos = end + (text[end] == ">")
        tag = m[1].lower()
        if first == "/":
            if opened.get(tag):
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            elif tag not in _INLINE:
                parts.append((" ", False))
            continue
        alone = tag in _VOID or attributes.endswith("/")
        if tag in _INLINE:
            if alone or not ("=" in attributes or opened.get(tag)):
                continue
            name, kind = _named(tag, attributes, stack[-1].main, plain_forms)
            if kind == PLAIN and not opened.get(tag):
                continue
        else:
            if tag in _RAW:
                stop = None
                if not alone and ends.get(tag, n) > at:
                    stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(text, at)
                    if not stop:
                        ends[tag] = at
                if stop:
                    end = text.find(">", stop.end())
                    at = pos = end + 1 if end >= 0 else n
                elif tag in _TO_THE_END and not alone:
                    pos = n
                    break
                if tag not in _UNSEEN:
                    parts.append((" ", False))
                continue
            if tag in _CLOSES_P and stack[stack[-1].paragraph].tag == "p":
                close(stack[-1].paragraph)
            if tag in _SAME:
                # Between two lists each kind of item is open once at most, so the steps are few.
                k = stack[-1].item
                while k and stack[k].tag not in _LISTS:
                    below = stack[k - 1].item
                    if stack[k].tag in _SAME[tag]:
                        close(k)
                        if tag != "tr":
                            break
                    k = below
            parts.append((" ", False))
            name, kind = _named(tag, attributes, stack[-1].main, plain_forms)
        top = stack[-1]
        top.style = crc32(name.encode("utf-8", "replace"), top.style)
        if alone:
            continue
        path = ((top.path * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 1) ^ crc32(name.encode("utf-8", "replace")) << 15
        noise = top.noise or (unlike is not None and (kind in (SURE, DOUBTFUL)) != (path in unlike))
        here = len(stack)
        paragraph = here if tag in ("p", "li") or tag in _CLOSES_P else top.paragraph
        stack.append(_Node(tag, path, kind, noise, (top.main or tag in ("article", "main")) and not noise, paragraph, here if tag in _ITEMS else top.item))
        opened[tag] = opened.get(tag, 0) + 1
    if n > pos:
        put(n)
    close(1)
    return parts, nodes, not plain_forms and 2 * form > stack[0].size


def main_text(text: str | None, unlike: frozenset[int] = frozenset()) -> str:
    parts = walk(text or "", unlike)[0]
    if any(main and not p.isspace() for p, main in parts):
        parts = [(p, main) for p, main in parts if main or p == " "]
    return " ".join("".join(p for p, _ in parts).split())


@dataclass(frozen=True)
class StyleTree:
    """limit: least importance kept. neutral, weight: importance without evidence, and the pages that it counts as. factors:
    what SURE, DOUBTFUL, DOUBTFUL_IN_MAIN and PLAIN names multiply importance by. By neutral evidence the first two are
    below the limit, the others above it (walk() takes that for granted)."""

    limit: float = 0.1
    neutral: float = 0.6
    weight: float = 2.0
    factors: tuple[float, float, float, float] = (0.09, 0.16, 0.3, 1.0)

    def __post_init__(self) -> None:
        if [x * self.neutral < self.limit for x in self.factors] != [True, True, False, False]:
            raise ValueError("factors, neutral and limit don't agree with the kinds of names")

    def _rows(self, pages: DataFrame) -> DataFrame:
        """page key columns: host and html."""
        host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
        return pages.select("page_id", "url", host.alias("host"), "html")

    def importance(self, pages: DataFrame) -> DataFrame:
        """host, path, kind, pages, presentation, content and importance of each node of every host's style tree, over the
        different pages of the host."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    out: list[tuple] = []
                    for host, text, a, b in zip(*(c.slice(at, 500).to_pylist() for c in batch.columns), strict=True):
                        merged: dict[int, tuple] = {}
                        for path, kind, block, style, content in walk(text or "", None)[1]:
                            _, _, s, c = merged.get(path, (0, 0, 0, 0))
                            merged[path] = (kind, block, (31 * s + style) % (1 << 61), (31 * c + content) % (1 << 61))
                        out += [(host, a, b, path, *x) for path, x in merged.items()]
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64())
                    columns = zip(*out, strict=True) if out else [()] * 8
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "a", "b", "path", "kind", "block", "style", "content"])

        named = self._rows(pages).select("host", "html", F.xxhash64("html"), F.xxhash64(F.lit(1), "html"))
        rows = named.mapInArrow(run, "host string, a long, b long, path long, kind int, block boolean, style long, content long").distinct()
        # Both kinds of values in one aggregation.
        each = rows.select("host", "path", "kind", "block", F.explode(F.array(F.struct(F.lit(0).alias("of"), F.col("style").alias("value")), F.struct(F.lit(1).alias("of"), F.col("content").alias("value")))).alias("x"))
        counts = each.groupBy("host", "path", "x.of", "x.value").agg(F.count("*").alias("n"), F.min("kind").alias("kind"), F.max("block").alias("block"))
        sums = [F.sum(F.when(F.col("of") == i, F.col("n") * F.log("n"))).alias(f"s{i}") for i in (0, 1)]
        tree = counts.groupBy("host", "path").agg(F.sum(F.when(F.col("of") == 0, F.col("n"))).alias("pages"), F.min("kind").alias("kind"), F.max("block").alias("block"), *sums)

        def entropy(s: str) -> Column:
            return F.when(F.col("pages") > 1, (F.log("pages") - F.col(s) / F.col("pages")) / F.log("pages"))

        tree = tree.select("host", "path", "kind", "pages", "block", entropy("s0").alias("presentation"), entropy("s1").alias("content"))
        found = F.coalesce(F.when(F.col("block"), F.col("content")).otherwise((F.col("presentation") + F.col("content")) / 2), F.lit(0.0))
        drawn = ((F.col("pages") - 1) * found + self.weight * self.neutral) / (F.col("pages") - 1 + self.weight)
        factor = F.element_at(F.array(*(F.lit(x) for x in self.factors)), F.col("kind") + 1)
        return tree.select("host", "path", "kind", "pages", "block", "presentation", "content", (factor * drawn).alias("importance"))

    def extract(self, pages: DataFrame) -> DataFrame:
        """page_id, url, text and n_chars of each page."""
        work = Workspace(pages.sparkSession, "html-text")
        unlike = (F.col("importance") < self.limit) != F.col("kind").isin(SURE, DOUBTFUL)
        odd = work.keep(self.importance(pages).filter((F.col("pages") > 1) & unlike).groupBy("host").agg(F.collect_list("path").alias("unlike")), "unlike")
        kind = pages.schema["page_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    texts = [main_text(t, frozenset(x or ())) for t, x in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        joined = self._rows(pages).join(odd, "host", "left").select("page_id", "url", "html", "unlike")
        return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
