"""Operator 1: main text of web pages by the distribution of text over line blocks.

Markup is stripped so that every block element gives a line and nested containers leave
blank lines.  The lengths of the lines are summed over sliding windows; a sum that surges
from nothing opens a region and the one that dives back to nothing closes it.  Regions with
enough text are kept.  Links weigh nothing, nor does what its element or its name marks as
no part of an article, so such places read as gaps.
"""

from __future__ import annotations

import functools
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3          # lines of a block
SURGE = 120         # characters of a region, unless it is the longest of its page

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'=/>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|\"[^\"]*\"|'[^']*'")
NAMING = re.compile(r"(?:class|id|role|label)\s*=", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

RAW = frozenset("script style noscript template iframe svg math object textarea title canvas video audio".split())
APART = frozenset("nav footer aside form button select dialog menu head".split())
BLOCKS = frozenset(("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form "
                    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul").split())
CONTAINERS = frozenset("article aside body div dl figure footer form header main nav ol section table ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Names that mark an element as no part of the article, when nothing but qualifiers stands beside them.
COMMENTS = frozenset("comment comments commentary discussion disqus replies respond".split())
MARKS = COMMENTS | frozenset((
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login sidebar sidenav aside widget widgets related recommended recommendations "
    "trending popular nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar masthead topbar header footer copyright "
    "share sharing social follow tags search form skip complementary contentinfo").split())
QUALIFIERS = frozenset((
    "site page main global top bottom left right primary secondary upper lower side sticky fixed mobile desktop box block list area section container "
    "wrapper wrap wrapping inner outer bar item items link links panel module region holder group row column col slot unit button buttons icon icons "
    "post posts article articles entry story stories content news text media reader user visitor facebook google twitter disqus email jump this "
    "bs js wp tag title heading buttonbar count thread you may also like more the and to of on for our your us").split())
PAGE_PARTS = frozenset("header footer sidebar nav navigation menu form search".split())
OF_ARTICLE = frozenset("post posts article articles entry story stories content news text page section".split())   # such a header is its head
ARTICLE = frozenset(("article", "main"))
KEPT = ARTICLE | frozenset("h1 h2 h3 h4 h5 h6".split())


@functools.lru_cache(4096)
def _boilerplate(name: str) -> str:
    """The mark that a class, id, role or label is, all of it; has-sidebar and entry-header are none."""
    parts = [part.lower() for part in PART.findall(name)]
    marks = [part for part in parts if part in MARKS]
    if not marks or not all(part in MARKS or part in QUALIFIERS for part in parts):
        return ""
    if marks[-1] in PAGE_PARTS and not OF_ARTICLE.isdisjoint(parts) and PAGE_PARTS.issuperset(marks):
        return ""
    return "comments" if not COMMENTS.isdisjoint(marks) else marks[0]


def _marked(attributes: str) -> str:
    """What a name among the attributes marks an element as: a word, empty for nothing."""
    if "=" not in attributes or not NAMING.search(attributes):
        return ""
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role", "aria-label"):
            for name in [value] if key == "aria-label" else value.split():
                if mark := _boilerplate(name):
                    return mark
    return ""


def _closed(page: str) -> str:
    """Without a comment that is never closed behind the last tag."""
    at = page.find("<!--", page.rfind(">") + 1)
    return page if at < 0 else page[:at]


def _tokens(page: str):
    """(start, end, closing, name, attributes) of every tag or comment; a raw element is one, with its content."""
    at, end = 0, page.rfind(">") + 1
    while m := TOKEN.search(page, at, end):
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name and m.group().startswith("<!--") and not m.group().endswith("-->"):
            at = len(page)
        elif name in RAW and not m.group(1) and not m.group(3).endswith("/"):
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at, end)
            at = close.end() if close else len(page)
        yield m.start(), at, m.group(1) == "/", name, m.group(3) or ""


def _shares(page: str) -> dict[int, float]:
    """By its place, how much of the page's unlinked text each element holds."""
    weight, at, in_link = 0, 0, False
    opened: dict[str, list[tuple[int, int]]] = {}
    held: dict[int, int] = {}
    for start, end, closing, name, attributes in _tokens(page):
        if not in_link:
            weight += len(page[at:start].strip())
        at = end
        if name == "a":
            in_link = not closing
        elif closing and opened.get(name):
            place, before = opened[name].pop()
            held[place] = weight - before
        elif name and not closing and name not in VOID and name not in RAW and not attributes.endswith("/"):
            opened.setdefault(name, []).append((start, weight))
    weight += 0 if in_link else len(page[at:].strip())
    for left in opened.values():
        held.update((place, weight - before) for place, before in left)
    return {place: n / max(1, weight) for place, n in held.items()}


def lines_of(page: str) -> tuple[list[tuple[str, int]], bool]:
    """(text, weight) of every line, and whether the page marks its article; blank lines have no text."""
    lines: list[tuple[str, int, bool]] = []
    text: list[str] = []
    linked = weight = 0
    depth_article = 0
    skipped: list[str] = []       # open elements of the part that is left out
    at = 0
    in_link = False
    shares = None                 # of elements, when one is marked by its name
    page = _closed(page)
    seen_article = False

    def flush(blank: int = 0):
        nonlocal text, linked, weight
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            lines.append((joined, max(0, weight - linked), depth_article > 0))
        lines.extend([("", 0, depth_article > 0)] * blank)
        text, linked, weight = [], 0, 0

    def say(piece: str):
        nonlocal linked, weight
        text.append(piece)
        n = len(piece.strip())
        weight += n
        if in_link:
            linked += n

    for start, end, closing, name, attributes in _tokens(page):
        if not skipped and start > at:
            say(page[at:start])
        at = end
        if not name or name in RAW and not closing:
            continue
        if skipped:
            if not closing and name in ARTICLE and depth_article == 0:
                skipped = []      # a part left open ends where the article begins
            elif closing and name == skipped[0]:
                skipped.pop()
                if not skipped:
                    flush(WINDOW)
                continue
            else:
                if not closing and name == skipped[0] and not attributes.endswith("/"):
                    skipped.append(name)
                continue
        if name == "a":
            in_link = not closing
        elif name == "br":
            say(" ")
        apart = name in APART or (name == "header" and depth_article == 0)
        if not (apart or closing or name in KEPT or name in ("html", "body", "a") or name in VOID) and (mark := _marked(attributes)):
            # Comments may well be longer than the article, other parts are not.
            shares = _shares(page) if shares is None else shares
            apart = mark == "comments" or shares.get(start, 0) <= 0.5
        if not closing and apart and not attributes.endswith("/"):
            if name in BLOCKS or name in APART:
                flush(WINDOW)
            skipped = [name]
            continue
        if name in BLOCKS:
            flush(1 if name in CONTAINERS else 0)
        if name in ARTICLE:
            if not closing:
                seen_article = True
                depth_article += 1
            elif depth_article:
                flush()
                depth_article -= 1
    if not skipped:
        say(page[at:])
    flush()
    if seen_article and any(inside and line for line, _, inside in lines):
        return [(line, w) if inside else ("", 0) for line, w, inside in lines], True
    return [(line, w) for line, w, _ in lines], False


def regions(lines: list[tuple[str, int]]) -> list[tuple[int, int]]:
    """Line ranges from a surge of the window sums to the dive that follows, with the links right behind it."""
    n, out, start = len(lines), [], None
    for i in range(n + 1):
        block = sum(w for _, w in lines[i : i + WINDOW])
        if block > 0 and start is None:
            start = i
        elif block == 0 and start is not None:
            while i < n and lines[i][0] and not lines[i][1]:
                i += 1
            out.append((start, i))
            start = None
    if start is not None:
        out.append((start, n))
    return out


def main_text(page: str | None) -> str:
    """The article of a page, one line for each block; empty for NULL and for pages without text."""
    lines, marked = lines_of(page or "")
    found = regions(lines)
    sizes = [sum(w for _, w in lines[a:b]) for a, b in found]
    if not found:
        return ""
    least = 1 if marked else min(SURGE, max(sizes))
    return "\n".join(line for (a, b), size in zip(found, sizes) if size >= least for line, _ in lines[a:b] if line)


def _extracted(parts):
    for batch in parts:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text of the article, n_chars (its code points).

    pages: page_id, url, html; other columns are not read.  Character references are
    decoded, white space in a block is one space, blocks are joined by one line break.
    NULL, empty and text-free pages give an empty text; NULL ids and URLs stay; repeated
    rows give repeated results.  Each page is read whole and alone, without a shuffle.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        _extracted, "page_id long, url string, text string, n_chars long")
