"""Main text of HTML pages by line-block distribution.

Markup is stripped to one line per block element. A line weighs its code points outside links; menus,
headers, footers, sidebars, notices, adverts, forms, reader comments and hidden elements are told by their
tags, roles and class names and leave nothing, so the text around them stays together. The weights are summed
over sliding windows of ``WINDOW`` lines: text surges where a window sum rises from zero and dives where it
returns to zero, and the lines between are a candidate. Borders of article and main elements part candidates.

If the heaviest candidate stands in an article or main element, only those inside one count: all stay but
short ones that are mostly links, with fewer than ``WINDOW`` link lines beside them. Else those stay that reach
``SURGE``, or stand between two that do and are not mostly links; if none reaches it, all that are not mostly links.

One pass over each page in the task that reads it, nothing shuffled.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 80  # window sum that makes a candidate text by itself

# Element and class names.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "title", "object", "canvas", "select", "xmp"}
DROPPED = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "head"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
          "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th",
          "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSED_BY_BLOCK = {"p", "li", "dt", "dd", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6"}
NEVER_DROPPED = {"html", "body", "main"}
NOISE = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus",
         "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promotion", "related",
         "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
BODY_WORDS = {"article", "body", "container", "content", "entry", "has", "layout", "main", "no", "page", "post", "story", "text", "title", "with", "without", "wrapper"}
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)|<[!?/][^>]*(?:>|\Z)", re.S)
VALUE_OR_END = re.compile(r"=\s*+([\"'])|>")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")


def is_noise(name: str, attributes: str) -> bool:
    """Do the tag, its role or one of its class names mark an element beside the text?"""
    if name in DROPPED:
        return True
    if name in NEVER_DROPPED or not attributes or name in VOID:
        return False
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in ROLES) or (key == "style" and "display:none" in value.replace(" ", "")):
            return True
        if key in ("class", "id"):
            for one in value.split():
                words = set(re.split(r"[^a-z0-9]+", one))
                if words & NOISE and not words & BODY_WORDS:
                    return True
    return False


def tag_end(page: str, at: int, dead: set[int]) -> int:
    """Where the tag ends whose name ends at ``at``: at the first '>' outside quoted values, of any length; at the first
    one of all if no such follows; -1 without any. ``dead`` keeps the page's quotes from which none follows, so that
    each is looked at once."""
    seen, x = [], at
    while m := VALUE_OR_END.search(page, x):
        if not m[1]:
            return m.start()
        seen.append(m.end())
        if m.end() in dead or (close := page.find(m[1], m.end())) < 0:
            break
        x = close + 1
    dead.update(seen)
    return page.find(">", at)


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """Lines of a page: text, weight, and whether it stands in an article or main element."""
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = 0  # code points of the line inside links
    link, inside, dropping, depth = False, 0, "", 0
    dead: set[int] = set()

    def end_line(gap: bool = False) -> None:
        nonlocal linked
        text = SPACE.sub(" ", markup.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            lines.append((text, 0 if linked and linked >= len(text) - 1 else len(text) - linked, inside > 0))
        linked = 0
        if gap:
            lines.extend([("", 0, inside > 0)] * WINDOW)

    at = 0
    while True:
        m = TOKEN.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text and not dropping:
            parts.append(text)
            if link:
                linked += len(SPACE.sub(" ", markup.unescape(text)).strip())
        if m is None:
            break
        at = m.end()
        if not m[2]:
            continue
        if (end := tag_end(page, at, dead)) < 0:
            break  # a tag cut off by the end of the page
        name, closes, attributes, at = m[2].lower(), bool(m[1]), page[at:end], end + 1
        if not closes and name in RAW and not attributes.endswith("/"):
            close = re.compile(f"</{name}(?=[\\s/>])|\\Z", re.I).search(page, at)
            at = close.end()  # the rest of the closing tag is read as text up to its end
            at = page.find(">", at) + 1 or len(page) if close[0] else len(page)
            continue
        if dropping:
            if not closes and name in BLOCKS and dropping in CLOSED_BY_BLOCK:
                dropping = ""  # a block element ends an unclosed paragraph or item
            else:
                depth += (-1 if closes else 1) if name == dropping else 0
                dropping = dropping if depth else ""
                continue
        if not closes and is_noise(name, attributes):
            if name not in VOID and not attributes.endswith("/"):
                end_line()
                dropping, depth, link = name, 1, False
            continue
        if name in ("article", "main"):
            end_line(gap=True)
            inside = max(0, inside + (-1 if closes else 1))
        elif name in BLOCKS:
            end_line()
        elif name == "a":
            link = not closes and "href" in attributes.lower()
        elif name in ("br", "wbr", "img"):
            parts.append(" " if name != "wbr" else "")
    end_line()
    return lines


def main_text(page: str | None) -> str:
    """Main text of a page: its blocks in page order, joined by line ends; empty if there is none."""
    lines = lines_of(page or "")
    weights = np.array([w for _, w, _ in lines], dtype=np.int64)
    if not weights.any():  # nothing but links: what an article or main element holds
        return "\n".join(text for text, _, inside in lines if inside and text)
    total = np.concatenate([[0], np.cumsum(np.concatenate([weights, np.zeros(WINDOW - 1, dtype=np.int64)]))])
    sums = total[WINDOW:] - total[:-WINDOW]  # of the window that starts at each line
    high = np.concatenate([[False], sums > 0, [False]])
    surges, dives = np.flatnonzero(~high[:-1] & high[1:]), np.flatnonzero(high[:-1] & ~high[1:])
    runs = []  # first and last line with weight, weight, does it reach SURGE, is it mostly text, is it inside
    for a, b in zip(surges, dives, strict=True):
        first, last = (a + int(k) for k in np.flatnonzero(weights[a:b])[[0, -1]])
        weight = int(weights[first:last + 1].sum())
        runs.append((first, last, weight, sums[a:b].max() >= SURGE, 2 * weight >= sum(len(text) for text, _, _ in lines[first:last + 1]), lines[first][2]))
    bounded = max(runs, key=lambda run: (run[2], run[5]))[5]
    surging = [i for i, run in enumerate(runs) if run[3]]
    kept = []
    for i, (first, last, _, surge, textual, inside) in enumerate(runs):
        if bounded:
            if inside and (surge or textual):
                kept.append((first - _links_beside(lines, first, -1), last + _links_beside(lines, last, 1)))
        elif surge or (textual and (not surging or surging[0] < i < surging[-1])):
            kept.append((first, last))
    return "\n".join(text for first, last in kept for text, _, _ in lines[first:last + 1] if text)


def _links_beside(lines: list[tuple[str, int, bool]], at: int, step: int) -> int:
    """How many link lines stand beside a run up to its element's border; 0 if they are a list."""
    for n in range(WINDOW):
        k = at + (n + 1) * step
        if not (0 <= k < len(lines) and lines[k][0] and lines[k][2]):
            return n
    return 0


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with ``text_col`` for every whole page; a column of that name is replaced.

    Null or empty html, and pages without text, give an empty text; repeated rows are treated each."""
    kept = [c for c in pages.columns if c != text_col]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p) for p in b.column(b.schema.get_field_index(html_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(texts, pa.string())], [*kept, text_col])

    return pages.mapInArrow(extract, pages.select(*kept, F.lit("").alias(text_col)).schema)
