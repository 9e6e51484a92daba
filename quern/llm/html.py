"""Operator 8: the main text of web pages, from flat text blocks and a decision tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.ship import ship
from quern.llm.tree import Tree

# Fixed values of HTML: elements inside a line of text, elements whose content is no text, elements without an end.
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rb rp rt s samp small "
                   "span strike strong sub sup time tt u var wbr label".split())
OPAQUE = "script|style|title|noscript|template|textarea|select|iframe|object|svg|math|canvas|audio|video"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("nav header footer aside button menu".split())
WEIGHED = frozenset("form dialog fieldset".split())  # boilerplate, or around the whole page
ROOTS = frozenset("html body main".split())  # never boilerplate
STATES = (frozenset("no not has have with without hide hides".split()), frozenset("open closed enabled disabled on off".split()))
HINTS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disqus footer header login masthead menu modal nav navbar navigation newsletter notice pagination popup promo "
    "promoted recommended related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget "
    "contentinfo complementary search alert alertdialog".split())
MAIN = frozenset(("article", "main"))
_ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
_PART = re.compile(rf"<!--.*?(?:-->|\Z)|(<(?:svg|math)(?=[\s/>]){_ATTRIBUTES}(?<=/)>|<({OPAQUE})(?=[\s/>])[^>]*>.*?(?:</\2(?=[\s/>])[^>]*>|\Z))"
                   rf"|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})>"
                   r"|</?[a-zA-Z][^>]*>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z", re.S | re.I)
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")

# Labelled blocks: words, link density, the same of the block before and after, scope (2: in an article or main element,
# 1: in a page without one, 0: outside the page's one), how far in a boilerplate element (1 by name; by class, the part of
# the text outside of it), label.
LABELLED = (
    (120, 0.0, 80, 0.0, 90, 0.0, 2, 0, 1), (2, 0.0, 60, 0.0, 40, 0.0, 2, 0, 1), (9, 0.0, 4, 0.0, 150, 0.0, 2, 0, 1),
    (1, 0.0, 1, 0.0, 1, 0.0, 2, 0, 1), (40, 0.3, 60, 0.0, 8, 0.0, 2, 0, 1), (6, 1.0, 90, 0.1, 70, 0.0, 2, 0, 1),
    (3, 0.0, 0, 0.0, 0, 0.0, 2, 0, 1), (300, 0.05, 0, 0.0, 12, 0.0, 2, 0, 1), (14, 0.0, 3, 1.0, 200, 0.0, 2, 0, 1),
    (5, 0.0, 200, 0.0, 11, 0.0, 2, 1, 0), (30, 0.0, 120, 0.0, 30, 0.0, 2, 1, 0), (80, 0.0, 60, 0.0, 70, 0.0, 2, 1, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 2, 1, 0), (12, 0.5, 90, 0.0, 4, 0.0, 2, 1, 0), (150, 0.0, 20, 0.0, 15, 0.0, 2, 1, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0), (8, 0.0, 1, 1.0, 10, 0.0, 0, 1, 0), (14, 0.0, 70, 0.0, 0, 0.0, 0, 1, 0),
    (60, 0.0, 3, 1.0, 100, 0.0, 0, 1, 0), (200, 0.0, 90, 0.0, 80, 0.0, 0, 1, 0), (4, 0.0, 0, 0.0, 2, 1.0, 0, 1, 0),
    (7, 0.0, 9, 0.0, 120, 0.0, 0, 0, 0), (25, 0.1, 2, 1.0, 9, 0.0, 0, 0, 0), (90, 0.0, 12, 0.0, 110, 0.0, 0, 0, 0),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0), (160, 0.0, 5, 0.0, 200, 0.0, 0, 0, 0), (3, 0.0, 50, 0.0, 0, 0.0, 0, 0, 0),
    (110, 0.0, 70, 0.0, 95, 0.0, 1, 0, 1), (45, 0.1, 80, 0.0, 30, 0.0, 1, 0, 1), (22, 0.0, 30, 0.0, 60, 0.0, 1, 0, 1),
    (4, 0.0, 60, 0.0, 90, 0.0, 1, 0, 1), (2, 0.0, 40, 0.0, 55, 0.0, 1, 0, 1), (8, 0.0, 2, 1.0, 120, 0.0, 1, 0, 1),
    (18, 0.2, 25, 0.0, 70, 0.1, 1, 0, 1), (12, 0.0, 100, 0.0, 20, 0.0, 1, 0, 1), (65, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), (3, 1.0, 2, 1.0, 90, 0.0, 1, 0, 0), (12, 0.9, 60, 0.0, 10, 1.0, 1, 0, 0),
    (30, 0.8, 4, 1.0, 40, 0.7, 1, 0, 0), (5, 1.0, 80, 0.0, 60, 0.0, 1, 0, 0), (9, 0.7, 9, 0.8, 70, 0.0, 1, 0, 0),
    (2, 1.0, 110, 0.0, 0, 0.0, 1, 0, 0), (6, 0.6, 3, 1.0, 3, 1.0, 1, 0, 0), (40, 0.9, 90, 0.0, 5, 1.0, 1, 0, 0),
    (7, 0.0, 90, 0.0, 14, 0.0, 1, 1, 0), (90, 0.0, 100, 0.0, 80, 0.0, 1, 1, 0), (1, 1.0, 1, 1.0, 60, 0.0, 1, 1, 0),
    # beside an article, and link lists without one
    (45, 0.0, 4, 0.0, 9, 0.0, 0, 0, 0), (60, 0.0, 10, 1.0, 3, 1.0, 0, 0, 0), (120, 0.0, 6, 0.0, 20, 0.0, 0, 0, 0), (10, 0.0, 8, 0.0, 30, 0.0, 0, 0, 0), (6, 0.0, 5, 0.0, 6, 0.0, 0, 0, 0), (25, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0), (80, 0.1, 15, 0.0, 90, 0.0, 0, 0, 0), (36, 0.0, 12, 0.0, 40, 0.0, 0, 0, 0),
    (15, 0.0, 20, 0.0, 25, 0.0, 0, 0, 0), (5, 0.0, 9, 1.0, 50, 0.0, 0, 0, 0), (200, 0.0, 8, 0.0, 70, 0.0, 0, 0, 0), (26, 0.0, 12, 0.0, 15, 0.0, 0, 0, 0), (60, 0.9, 4, 1.0, 6, 0.9, 1, 0, 0), (45, 0.7, 10, 0.8, 30, 0.0, 1, 0, 0), (80, 1.0, 0, 0.0, 9, 1.0, 1, 0, 0), (38, 0.8, 15, 0.0, 60, 0.0, 1, 0, 0),
    (120, 0.7, 20, 0.8, 0, 0.0, 1, 0, 0), (30, 0.9, 6, 1.0, 70, 0.0, 1, 0, 0), (25, 0.7, 8, 1.0, 12, 1.0, 1, 0, 0), (6, 1.0, 10, 1.0, 50, 0.0, 1, 0, 0), (9, 0.8, 12, 0.0, 15, 0.0, 1, 0, 0), (14, 1.0, 5, 0.0, 30, 0.0, 1, 0, 0),
    # lists and links in an article
    (3, 0.0, 4, 1.0, 5, 1.0, 2, 0, 1), (1, 0.0, 1, 1.0, 1, 1.0, 2, 0, 1), (8, 0.0, 2, 1.0, 1, 1.0, 2, 0, 1), (14, 0.0, 60, 0.0, 2, 1.0, 2, 0, 1), (25, 0.0, 3, 1.0, 6, 1.0, 2, 0, 1), (2, 0.0, 50, 0.0, 4, 1.0, 2, 0, 1), (12, 0.0, 2, 0.0, 1, 1.0, 2, 0, 1), (7, 0.0, 5, 1.0, 0, 0.0, 2, 0, 1),
    (35, 0.1, 10, 1.0, 9, 0.9, 2, 0, 1), (5, 1.0, 4, 1.0, 6, 1.0, 2, 0, 1), (2, 1.0, 1, 1.0, 3, 1.0, 2, 0, 1), (9, 0.8, 7, 1.0, 8, 1.0, 2, 0, 1), (5, 0.0, 30, 0.0, 1, 1.0, 2, 0, 1), (18, 0.0, 9, 0.8, 3, 1.0, 2, 0, 1), (1, 0.0, 3, 0.0, 1, 1.0, 2, 0, 1), (30, 0.6, 20, 0.7, 25, 0.9, 2, 0, 1),
    # no article and no hints: labels, notices and footers beside link lists, replies with their names and buttons, prose between link lists
    (1, 0.0, 6, 1.0, 8, 1.0, 1, 0, 0), (3, 0.0, 10, 1.0, 12, 0.9, 1, 0, 0), (2, 0.0, 1, 1.0, 1, 1.0, 1, 0, 0), (4, 0.0, 2, 1.0, 5, 1.0, 1, 0, 0), (9, 0.0, 4, 0.8, 7, 1.0, 1, 0, 0),
    (12, 0.0, 8, 1.0, 6, 1.0, 1, 0, 0), (16, 0.0, 1, 1.0, 3, 1.0, 1, 0, 0), (7, 0.0, 3, 1.0, 0, 0.0, 1, 0, 0), (9, 0.0, 5, 0.9, 0, 0.0, 1, 0, 0), (5, 0.2, 1, 1.0, 0, 0.0, 1, 0, 0),
    (14, 0.0, 2, 0.0, 1, 0.0, 1, 0, 0), (18, 0.0, 3, 0.0, 2, 0.0, 1, 0, 0), (2, 0.0, 14, 0.0, 18, 0.0, 1, 0, 0), (3, 0.0, 1, 0.0, 25, 0.0, 1, 0, 0),
    (1, 0.0, 18, 0.0, 3, 0.0, 1, 0, 0), (2, 0.0, 1, 1.0, 14, 0.0, 1, 0, 0), (11, 0.0, 3, 0.0, 1, 1.0, 1, 0, 0),
    (120, 0.0, 4, 1.0, 6, 1.0, 1, 0, 1), (60, 0.05, 10, 1.0, 0, 0.0, 1, 0, 1), (45, 0.0, 8, 1.0, 9, 1.0, 1, 0, 1), (70, 0.0, 2, 0.0, 1, 1.0, 1, 0, 1), (38, 0.0, 3, 1.0, 50, 0.0, 1, 0, 1),
    (5, 0.0, 6, 1.0, 80, 0.0, 1, 0, 1), (7, 0.0, 1, 1.0, 45, 0.0, 1, 0, 1), (4, 0.0, 1, 1.0, 4, 0.2, 1, 0, 1), (5, 0.2, 4, 0.0, 4, 0.0, 1, 0, 1), (6, 0.0, 10, 1.0, 60, 0.1, 1, 0, 1), (10, 0.0, 50, 0.0, 2, 1.0, 1, 0, 1),
    (8, 0.0, 60, 0.0, 0, 0.0, 1, 0, 1), (14, 0.0, 70, 0.0, 65, 0.0, 1, 0, 1), (20, 0.0, 40, 0.0, 25, 0.0, 1, 0, 1), (3, 0.0, 45, 0.0, 38, 0.0, 1, 0, 1), (28, 0.0, 35, 0.0, 40, 0.0, 1, 0, 1),
    (30, 0.0, 5, 0.0, 0, 0.0, 1, 0, 1), (24, 0.0, 4, 0.0, 2, 1.0, 1, 0, 1), (26, 0.0, 3, 1.0, 5, 0.0, 1, 0, 1), (2, 0.0, 3, 1.0, 60, 0.0, 1, 0, 1), (3, 0.0, 8, 1.0, 45, 0.0, 1, 0, 1),
    (1, 0.0, 5, 0.0, 90, 0.0, 1, 0, 1), (3, 0.0, 0, 0.0, 60, 0.0, 1, 0, 1), (2, 0.0, 0, 0.0, 40, 0.0, 1, 0, 1), (90, 0.0, 9, 0.0, 100, 0.0, 1, 0, 1),
    (30, 0.0, 60, 0.0, 5, 1.0, 1, 0, 1), (20, 0.0, 80, 0.0, 3, 1.0, 1, 0, 1), (14, 0.0, 50, 0.0, 8, 1.0, 1, 0, 1), (40, 0.0, 70, 0.0, 1, 1.0, 1, 0, 1),
    (12, 0.0, 12, 0.0, 15, 0.0, 1, 0, 1), (9, 0.0, 11, 0.0, 10, 0.0, 1, 0, 1), (6, 0.0, 5, 0.0, 6, 0.0, 1, 0, 1),
    # boilerplate by class that holds nearly all of the text is a frame of the page
    (100, 0.0, 70, 0.0, 80, 0.0, 2, 0.08, 1), (6, 0.0, 30, 0.0, 80, 0.0, 2, 0.08, 1), (90, 0.0, 60, 0.0, 80, 0.0, 1, 0.08, 1), (50, 0.0, 70, 0.0, 60, 0.0, 2, 0.12, 0),
    (70, 0.0, 50, 0.0, 60, 0.0, 1, 0.12, 0), (40, 0.0, 60, 0.0, 50, 0.0, 1, 0.5, 0), (40, 0.0, 60, 0.0, 50, 0.0, 2, 0.5, 0),
    (20, 0.0, 15, 0.0, 0, 0.0, 1, 1, 0), (33, 0.2, 60, 0.0, 45, 0.0, 1, 1, 0), (5, 0.0, 0, 0.0, 100, 0.0, 1, 1, 0),
)


def train() -> Tree:
    table = np.array(LABELLED, float)
    return Tree(table[:, :-1], table[:, -1], depth=12)


def _hinted(name: str, attributes: str) -> bool:
    """Whether an element's class, id or role names boilerplate. A state (`no-sidebar`, `comment-open`) does not; an article needs the whole word."""
    if name in ROOTS:
        return False
    for mark in " ".join("".join(m) for m in _MARKS.findall(attributes)).lower().split():
        parts = [t for t in re.split(r"[^a-z0-9]+", mark) if t]
        if any(t in HINTS for t in parts) and (len(parts) == 1 or not (name in MAIN or parts[0] in STATES[0] or parts[-1] in STATES[1])):
            return True
    return False


def blocks(page: str) -> tuple[list[str], np.ndarray]:
    """The page's text blocks in order, and their features."""
    texts, rows, parts, linked = [], [], [], [0]
    stack: list[tuple[str, bool, bool, int]] = []  # open elements: name, boilerplate by name, main, hinted element, each with what holds around it
    around: list[int] = []  # of every hinted element: the hinted element around it, or -1
    anchors, has_main = 0, False

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                boiler, main, hinted = stack[-1][1:] if stack else (False, False, -1)
                texts.append(text)
                rows.append((len(text.split(" ")), min(1.0, linked[0] / max(len(text), 1)), main, boiler, hinted))
            parts.clear()
            linked[0] = 0

    def text(raw: str) -> None:
        if raw:
            parts.append(raw)
            if anchors:
                linked[0] += len(raw.strip())

    at = 0
    for found in _PART.finditer(page):
        text(page[at:found.start()])
        at = found.end()
        name = found[4] and found[4].lower()
        if not name:
            if found[1]:
                parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
        if name not in INLINE:
            flush()
        if found[3]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    anchors -= sum(e[0] == "a" for e in stack[k:])
                    del stack[k:]
                    break
        elif name not in VOID and not found[5].endswith("/"):
            _, boiler, main, hinted = stack[-1] if stack else ("", False, False, -1)
            if name in WEIGHED or _hinted(name, found[5]):
                around.append(hinted)
                hinted = len(around) - 1
            has_main = has_main or name in MAIN
            stack.append((name, boiler or name in BOILER, main or name in MAIN, hinted))
            anchors += name == "a"
    text(page[at:])
    flush()
    out = np.zeros((len(rows), 8))
    held, total = np.zeros(len(around)), 0.0  # words of the main element, or else of the page, that are not linked
    for n, density, main, boiler, hinted in rows:
        if not boiler and (main or not has_main):
            total += n * (1 - density)
            if hinted >= 0:
                held[hinted] += n * (1 - density)
    for k in range(len(around) - 1, -1, -1):
        if around[k] >= 0:
            held[around[k]] += held[k]
    rest = 1 - held / total if total else np.ones(len(around))
    for k, outer in enumerate(around):
        rest[k] = max(rest[k], rest[outer] if outer >= 0 else 0.0)
    for i, (n, density, main, boiler, hinted) in enumerate(rows):
        out[i, :2], out[i, 6:] = (n, density), (2 if main else 0 if has_main else 1, 1 if boiler else rest[hinted] if hinted >= 0 else 0)
    out[1:, 2:4], out[:-1, 4:6] = out[:-1, :2], out[1:, :2]
    return texts, out


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """One row per row of `pages`: page_id, url, text (main blocks joined by two line breaks), n_chars (its code points).

    A page is cut into flat text blocks at every element that is not part of a line of text. A block's features are its
    word count and link density, those of the blocks before and after, whether it lies in an article or main element, and
    whether in an element that is boilerplate by name or, where it holds only a part of the text, by class, id or role; one
    that holds nearly all of it is the page's frame. A decision tree, trained on LABELLED, decides.
    Comments, scripts, styles and similar content are no text; character references are decoded; white space inside a block
    becomes one space. Nothing is capped; a tag that the page's end cuts off is dropped.

    NULL or empty pages, and pages without main blocks, give an empty text. Repeated rows give equal rows, NULL ids and urls stay,
    other columns are ignored."""
    ship(pages.sparkSession)
    own = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{markup}`").alias("html"))
    kinds = [own.schema[c].dataType for c in ("page_id", "url")]
    tree = train()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, features = zip(*(blocks(p or "") for p in batch["html"].to_pylist()), strict=True) if len(batch) else ((), ())
            keep = tree.predict(np.concatenate(features)) > 0.5 if features else np.zeros(0, bool)
            out, at = [], 0
            for page in texts:
                out.append("\n\n".join(t for t, k in zip(page, keep[at:at + len(page)].tolist(), strict=True) if k))
                at += len(page)
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(out, pa.string()),
                                              pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return own.mapInArrow(extract, f"page_id {kinds[0].simpleString()}, url {kinds[1].simpleString()}, text string, n_chars long")
