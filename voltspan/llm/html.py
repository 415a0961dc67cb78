"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one a block element, and each line has a weight for each of its characters: none in menus,
adverts, forms and their like, where the line is left empty; on pages with text in an article or main element, none outside
it and FULL inside; else 1. Weighted lengths are summed over sliding windows of lines. Where the sum reaches a threshold is
a surge point, where it then falls to zero a dive point, and the lines between each surge and its dive point are the main
text, on every page. Menus without a known class fall away before a surge, but for the two lines next to it; those that
follow the text with nothing set aside between stay.

An element that would be set aside but is never closed isn't set aside, so no text behind it is lost. Null or empty html: no
text. A page cut off in the middle keeps what is there; half a tag at its end is markup. Rows that repeat a page_id are pages
of their own. An empty table gives an empty result. Further columns are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: Weighted characters that a window of main text has at least; on pages with little text, this part of their fullest window.
ENOUGH, SHARE = 86, 4
#: Weight of a line in an article or main element; any line there is a surge.
FULL = ENOUGH
SCHEMA = "page_id long, url string, text string, n_chars long"
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</?\Z", re.S)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg")}
_MARK = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
#: Elements that never hold main text; header only where it isn't the article's own.
ASIDE = frozenset("nav footer aside form head button select menu dialog object canvas audio video fieldset".split())
#: Words of a class, id or role that mark an element as such.
MARKED = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored banner promo nav navbar navigation menu breadcrumb breadcrumbs sidebar complementary contentinfo comment comments disqus reply replies respond cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup share sharing social related recommended footer header masthead toolbar search login widget pagination pager".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag is often left out; the next of these ends them.
LOOSE = frozenset("p li dt dd td th tr".split())


def _aside(name: str, attributes: str, inside: bool) -> bool:
    if name in ASIDE or name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    if _HIDDEN.search(attributes):
        return True
    for found in _MARK.findall(attributes):
        words = re.split(r"[^a-z0-9]+", found.lower())
        if not MARKED.isdisjoint(words) and not (inside and {"header", "search"}.issuperset(MARKED.intersection(words))):
            return True
    return False


def _closed(page: str) -> set[int]:
    """Where the start tags stand that have an end tag; each end tag closes the last open element of its name."""
    opened: dict[str, list[int]] = {}
    out: set[int] = set()
    at = 0
    while m := _TAG.search(page, at):
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if name in _RAW and not (m[1] or m[4]):
            end = _RAW[name].search(page, at)
            at = end.end() if end else at
        elif name and (m[1] or m[4]):
            if opened.get(name):
                out.add(opened[name].pop())
        elif name:
            opened.setdefault(name, []).append(m.start())
    return out


def lines(page: str, closed: set[int] | None = None) -> list[tuple[str, bool]]:
    """(text, whether it is in an article or main element) by block, "" for what is set aside.

    closed: the only places whose elements may be set aside; found out where one stays open to the end of the page.
    """
    out: list[tuple[str, bool]] = []
    parts: list[str] = []
    at, depth, skip, nested = 0, 0, "", 0

    def flush() -> None:
        if parts:
            if text := " ".join(entities.unescape("".join(parts)).split()):
                out.append((text, depth > 0))
            parts.clear()

    while True:
        m = _TAG.search(page, at)
        if not skip and (piece := page[at : m.start() if m else len(page)]):
            parts.append(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA[") and not skip:
                parts.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        closes, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in _RAW:
            if not closes and not attributes.rstrip().endswith("/"):
                end = _RAW[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if skip:
            if name == skip:
                nested += -1 if closes else 1
            if not nested or skip in LOOSE and (name in BLOCKS if not closes else name in BLOCKS and name not in LOOSE):
                again = nested and not closes
                skip = ""
                if not again:
                    continue
                out.append(("", depth > 0))
            else:
                continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            parts.append(" ")
        if name in ("article", "main"):
            depth = max(0, depth - 1) if closes else depth + 1
        elif not closes and name not in VOID and _aside(name, attributes, depth > 0) and (closed is None or name in LOOSE or m.start() in closed):
            flush()
            out.append(("", depth > 0))
            if not attributes.rstrip().endswith("/"):
                skip, nested = name, 1
    flush()
    if skip and skip not in LOOSE and closed is None:
        return lines(page, _closed(page))
    return out


def main_text(page: str | None) -> str:
    found = lines(page or "")
    marked = any(t and inside for t, inside in found)
    weight = np.array([(FULL if inside else 0) if marked else 1 for _, inside in found], dtype=np.int64)
    size = np.array([len(t) for t, _ in found], dtype=np.int64) * weight
    if not size.any():
        return ""
    # sums[i]: text of the WINDOW lines that end with line i. A run from a surge to its dive has all lines of its first window.
    total = np.concatenate((np.zeros(WINDOW, dtype=np.int64), np.cumsum(size)))
    sums = total[WINDOW:] - total[:-WINDOW]
    enough, on = min(ENOUGH, sums.max() / SHARE), False
    surge = np.array([on := n > 0 and (on or n >= enough) for n in sums.tolist()])
    keep = (size > 0) & (surge | np.append(surge[1:], False) | np.append(surge[2:], (False, False))[: len(surge)])
    return "\n\n".join(t for (t, _), kept in zip(found, keep, strict=True) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, SCHEMA)
