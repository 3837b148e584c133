"""Operator 3: main text of HTML pages by line-block distribution.

The markup is stripped so that every block element becomes one line. Contents
of scripts, styles, forms, menus, headers, footers, sidebars, notices, adverts
and reader comments vanish, and the border of every other container becomes empty
lines. Text lengths are summed over sliding windows of ``WINDOW`` lines:
where the sum surges over a threshold a span of main text starts, where it
dives to zero the span ends. The distribution of the whole page judges what a
page declares as its article (``article``, ``main``): unless its lines nowhere
surge and surging text elsewhere is ``HINT`` times as long (teasers beside the
article), they alone are kept, and then any text is a surge: the lines of the
spans are the text. Else, and on pages that declare none, a span must hold a window of ``SURGE``
characters (half the highest window on pages that never reach twice that), a
line counts without its link text, and the spans locate the article: short
lines of its containers and paragraphs around it are text too (``article``).

Character references are decoded, white space inside a block becomes one
space, empty blocks vanish, and blocks are joined by one empty line. A null or
empty page, or one without main text, gives an empty text. Pages are read
whole; unclosed elements, comments and scripts end where browsers end them.
Repeated rows give repeated results, other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, texts

WINDOW = 3
SURGE = 120
HINT = 3  # a declared article is given up for this many times as much text elsewhere

# comments, declarations, tags (a quote opens a value only after "="), and a tag cut off by the page's end
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
                   r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>=]++|=)*+)>"
                   r"|</?[a-zA-Z][^<>]*\Z", re.S)
# behind the last ">" of a page: what runs to its end
TAIL = re.compile(r"<[!?].*|</?[a-zA-Z][^<]*\Z", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
# their content is not markup: it ends at the next end tag of the same name
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "noscript", "template", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir",
          "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
          "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre",
          "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
# borders of these are empty lines to the distribution
CONTAINERS = {"article", "aside", "body", "dialog", "div", "fieldset", "footer", "form", "head", "header", "main",
              "nav", "section", "table"}
DROPPED = {"aside", "button", "dialog", "fieldset", "footer", "form", "head", "menu", "nav", "select", "object",
           "canvas", "audio", "video"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"}
DROPPED_WORDS = {"ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "alert", "banner",
                 "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "copyright", "disclaimer", "footer",
                 "gdpr", "legal", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
                 "notice", "notices", "pager", "pagination", "popup", "promo", "recommended", "related", "search",
                 "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe",
                 "toolbar", "widget", "widgets"}
# inside a declared article only whole names count: "share-price" or "related-work" are its own
ARTICLE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsored", "promo", "comment",
                 "comments", "comment-list", "comments-area", "disqus", "respond", "replies", "cookie-notice",
                 "cookie-banner", "notice", "notices", "newsletter", "newsletter-signup", "subscribe", "signup",
                 "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination"}
COMMENT_WORDS = {"comment", "comments", "disqus", "respond", "replies"}
HEADER_WORDS = {"header"}
HAVING = {"with", "has", "no", "without"}  # "content-with-sidebar" is no sidebar
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# a line in one of these is written as text; one in a bare container may be a label
PROSE = {"blockquote", "caption", "dd", "dt", "figcaption", "li", "p", "pre", "td", "th"}
BARE, WRITTEN, HEADING = 0, 1, 2
OPEN, HEADER, SOFT, HARD = 0, 1, 2, 3  # kept; only headings kept; dropped unless an article follows inside; dropped


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if "=" in text else {}


def treatment(name: str, attrs: str, inside: bool = False) -> int:
    """How the text inside an element is treated; ``inside``: it lies in a declared article."""
    if name in DROPPED:
        return HARD
    if name == "header":
        return HEADER
    if not attrs or name in ("html", "body", "article", "main") and "comment" not in attrs:
        return OPEN
    found = attributes(attrs)
    style = found.get("style", "").replace(" ", "").lower()
    if "display:none" in style or found.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?=\s|/|$)", attrs):
        return HARD
    if found.get("role", "").lower() in DROPPED_ROLES:
        return HARD
    if inside:
        names = set(f"{found.get('class', '')} {found.get('id', '')}".lower().split())
        return HARD if names & ARTICLE_WORDS else HEADER if names & HEADER_WORDS else OPEN
    words: set[str] = set()  # first and last part of each class name or id: what it is or where it is
    for label in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
        parts = [p for p in re.split(r"[_\-]+", label) if p]
        if parts and not HAVING & set(parts):
            words.update((parts[0], parts[-1]))
    if words & COMMENT_WORDS:
        return HARD
    if name in HEADINGS:
        return OPEN
    if words & DROPPED_WORDS:
        return SOFT
    return HEADER if words & HEADER_WORDS else OPEN


class Line(NamedTuple):
    text: str  # empty at borders
    length: int
    declared: bool
    box: int = 0  # number of the innermost open container
    kind: int = BARE


EMPTY = Line("", 0, False)


def block_lines(page: str) -> tuple[list[Line], bool, list[list[int]]]:
    """Lines of a page, whether it declares an article, and its containers ``[parent, first line, end]``.

    Container 0 is the page; its body is no container of its own.
    """
    lines: list[Line] = []
    boxes = [[0, 0, 0]]
    words: list[str] = []  # of the line at hand
    links = 0  # characters of its link text
    stack: list[list] = []  # open elements: name, treatment, container, kind of a line in it
    # of the open elements: how many of a name and of a treatment, where those are that an article opens, and that
    # end a search for an open paragraph or item; all kept up to date, so no step walks the whole stack
    names: Counter[str] = Counter()
    treated = [0, 0, 0, 0]
    opened_by_article: list[int] = []
    stops: list[int] = []
    declared_depth = link_depth = heading_depth = 0
    declares = False

    def end_line() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(words)).split())
        if text:
            length = len(text) if declared_depth else max(0, len(text) - links)
            box, kind = (stack[-1][2], stack[-1][3]) if stack else (0, BARE)
            lines.append(Line(text, length, declared_depth > 0, box, kind))
        words.clear()
        links = 0

    def border() -> None:
        if lines and lines[-1][0]:
            lines.extend([EMPTY] * WINDOW)

    def close(position: int) -> None:
        nonlocal declared_depth, link_depth, heading_depth
        for name, how, box, _ in stack[position:]:
            names[name] -= 1
            treated[how] -= 1
            declared_depth -= name in ("article", "main")
            link_depth -= name == "a"
            heading_depth -= name in HEADINGS
            if name in CONTAINERS and name != "body":
                boxes[box][2] = len(lines)
        del stack[position:]
        for places in (opened_by_article, stops):
            while places and places[-1] >= position:
                places.pop()

    def kept() -> bool:
        return not treated[HARD] and not treated[SOFT] and (not treated[HEADER] or heading_depth > 0)

    def add(text: str) -> None:
        nonlocal links
        if text and kept():
            words.append(text)
            if link_depth:
                links += len(text.strip())

    at, n = 0, len(page)
    last = page.rfind(">") + 1
    while at < n:
        m = TOKEN.search(page, at, last) if at < last else None
        if m is None:  # no whole tag is left
            m = TAIL.search(page, max(at, last))
            add(page[at: m.start() if m else n])
            break
        add(page[at: m.start()])
        at = m.end()
        if page.startswith("<!--", m.start()) and not m[0].endswith("-->"):
            break  # a comment that is never closed
        name = (m[2] or "").lower()
        if not name:
            continue
        attrs = m[3] or ""
        if m[1]:  # an end tag closes the nearest open element of its name
            if name in BLOCKS:
                end_line()
            if names[name]:
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                if name in CONTAINERS and kept():
                    border()
                close(i)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            if name != "svg" or not attrs.endswith("/"):  # only foreign elements close themselves
                at = end.end() if end else n
            continue
        if name in BLOCKS:
            end_line()
            # a block start ends an open paragraph, an item an open item
            for i in reversed(stops):
                if stack[i][0] == "p" or name == "li" and stack[i][0] == "li":
                    close(i)
                    break
                if stack[i][0] != "li":
                    break
            if name == "body":
                close(0)
        elif name == "br":
            words.append(" ")
        how = treatment(name, attrs, declared_depth > 0)
        if name in CONTAINERS and how == OPEN and kept():
            border()
        if name in VOID:  # a slash closes no other element
            continue
        if name in ("article", "main") and how == OPEN:
            for i in opened_by_article:
                treated[stack[i][1]] -= 1
                stack[i][1] = OPEN
                treated[OPEN] += 1
            opened_by_article.clear()
            declares = declares or not treated[HARD]
        declared_depth += name in ("article", "main")
        link_depth += name == "a"
        heading_depth += name in HEADINGS
        names[name] += 1
        treated[how] += 1
        if how in (SOFT, HEADER):
            opened_by_article.append(len(stack))
        if name in CONTAINERS or name in ("p", "li", "ul", "ol"):
            stops.append(len(stack))
        kind = HEADING if name in HEADINGS else WRITTEN if name in PROSE else BARE
        kind = BARE if name in CONTAINERS and name != "body" else max(kind, stack[-1][3] if stack else BARE)
        box = stack[-1][2] if stack else 0
        if name in CONTAINERS and name != "body":
            boxes.append([box, len(lines), 0])
            box = len(boxes) - 1
        stack.append([name, how, box, kind])
    end_line()
    close(0)
    boxes[0][2] = len(lines)
    return lines, declares, boxes


def kept_spans(lengths: list[int], surge: int) -> list[tuple[int, int]]:
    """Spans of lines between a surge and the next dive of the windowed length sums."""
    spans: list[tuple[int, int]] = []
    n, start, high = len(lengths), None, False
    highest = max((sum(lengths[i: i + WINDOW]) for i in range(n)), default=0)
    surge = max(1, min(surge, highest // 2))
    for i in range(n + 1):
        total = sum(lengths[i: i + WINDOW])
        if start is None and i < n and lengths[i]:
            start, high = i, False
        if start is not None:
            high = high or total >= surge
            if total == 0:  # dive
                if high:
                    spans.append((start, i))
                start = None
    return spans


def article(lines: list[Line], boxes: list[list[int]], spans: list[tuple[int, int]]) -> list[int]:
    """Which lines are the text of a page that declares no article, given its surge spans.

    All lines of a container (or page) that directly holds a line of a span, and all between the
    first and last span in a container they share; elsewhere between them, and around these up to
    the first other line, lines written as paragraphs, items, cells or headings. Label lines in
    bare containers before the text come with a heading before them, if the text has none. A
    container other than these whose text is all links is a menu, not text.
    """
    surged = [i for a, b in spans for i in range(a, b) if lines[i].text]
    first, last = surged[0], surged[-1]
    own = {lines[i].box for i in surged}
    common = lines[first].box
    while common and boxes[common][2] <= last:
        common = boxes[common][0]
    plain = [0] * len(boxes)
    for x in lines:
        plain[x.box] += x.length
    n = len(lines)
    edges = [0] * (n + 1)  # where containers of spans start and end
    for b in own:
        edges[boxes[b][1]] += 1
        edges[boxes[b][2]] -= 1
    low, high = min(boxes[b][1] for b in own), max(boxes[b][2] for b in own)

    def menu(x: Line) -> bool:
        return not plain[x.box] and x.kind != HEADING and x.box not in own

    kept, depth = [], sum(edges[:low])
    for i in range(low, high):
        depth += edges[i]
        x = lines[i]
        if x.text and (first <= i <= last and (common or 0 in own) or not menu(x) and (depth or x.kind)):
            kept.append(i)
    at = len(kept)
    for i in range(high, n):
        x = lines[i]
        if x.text:
            if menu(x) or x.kind == BARE:
                while len(kept) > at and lines[kept[-1]].kind == HEADING:  # of what is not text
                    kept.pop()
                break
            kept.append(i)
    before: list[int] = []
    labels: list[int] = []
    titled = any(lines[i].kind == HEADING for i in kept)
    for i in range(low - 1, -1, -1):
        x = lines[i]
        if not x.text:
            continue
        if menu(x) or x.kind == BARE and titled:
            break
        if x.kind == BARE or labels and x.kind != HEADING:
            labels.append(i)
            continue
        before += [*labels, i]
        labels = []
        titled = titled or x.kind == HEADING
    return before[::-1] + kept


def teasers(lines: list[Line], surge: int) -> bool:
    """Whether the declared lines nowhere surge, while surging text elsewhere is ``HINT`` times as long."""
    surging = [x for a, b in kept_spans([x.length for x in lines], surge) for x in lines[a:b]]
    inside = sum(x.length for x in lines if x.declared)
    return (inside > 0 and not any(x.declared for x in surging)
            and sum(x.length for x in surging) >= max(HINT * inside, surge))


def main_text(page: str, surge: int = SURGE) -> str:
    """The main text of one page."""
    lines, declares, boxes = block_lines(page)
    if declares and teasers(lines, surge):
        lines, declares = [EMPTY if x.declared else x for x in lines], False
    if declares:
        lines = [x if x.declared else EMPTY for x in lines]
        surge = 1
    spans = kept_spans([x.length for x in lines], surge)
    if spans and not declares:
        return "\n\n".join(lines[i].text for i in article(lines, boxes, spans))
    return "\n\n".join(x.text for a, b in spans for x in lines[a:b] if x.text)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",),
            ) -> DataFrame:
    """``(id, kept columns, text, n_chars)`` of every page."""

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        found = [main_text(t) for t in texts(batch.column(0))]
        return {**{c: batch.column(i + 1) for i, c in enumerate((id_col, *keep))}, "text": found,
                "n_chars": [len(t) for t in found]}

    chosen = pages.select(html_col, id_col, *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return map_batches(chosen, run, f"{kinds}, text string, n_chars long")
