"""Op 4: main text of web pages by line-block distribution."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from splitscope.llm.common import map_arrow, text_groups

#: Lines of a sliding window, and the characters of a window at which text surges.
WINDOW, SURGE = 3, 80

# Element names of HTML.
_BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_BOXES = frozenset("article aside body center details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
_FLOWING = frozenset("dl figure ol table ul".split())  # boxes that belong to the text around them
_DROPPED = frozenset("nav header footer aside form menu dialog button select datalist noscript iframe object svg canvas audio video template map search".split())
_NAMED = frozenset("address article aside blockquote div dl details fieldset figure main ol p section span table ul".split())
# Words of class, id and role attributes that name what is no main text.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion promoted recommended related respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
_COMMENTS = frozenset("comment comments respond disqus".split())
# Words that say where a box stands or what it looks like, not what it holds.
_NEUTRAL = frozenset("area bar block bottom box container content inner left list main outer page right section site top wrap wrapper".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title|textarea|xmp|noframes)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^<>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
_HEADER_END, _TITLE = re.compile(r"</header\b", re.I), re.compile(r"<h[12]\b", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)


def _marked(name: str, attributes: str) -> bool:
    """Whether the element's name or attributes say that it holds no main text."""
    if name in _DROPPED:
        return True
    if not attributes or name not in _NAMED:
        return False
    if _HIDDEN.search(attributes):
        return True
    marks = _COMMENTS if name in ("article", "main") else _MARKS
    tokens = (_WORD.findall(x) for m in _ATTRIBUTE.finditer(attributes) for x in m[1].lower().strip("\"'").split())
    # a token counts as a whole: cookie-notice and site-footer are marks, share-price and article-header aren't
    return any(marks.intersection(t) and (marks | _NEUTRAL).issuperset(t) for t in tokens)


def _holds_title(html: str, at: int) -> bool:
    """Whether a header element whose start tag ends at `at` holds a heading of the first two levels."""
    end = _HEADER_END.search(html, at)
    return _TITLE.search(html, at, end.start() if end else len(html)) is not None


def page_lines(html: str) -> list[tuple[str, bool]]:
    """Lines of a page without markup: text and whether it stands in an article or main element.

    Every block element starts a line. Boundaries of boxes, but for lists, tables and
    figures, leave WINDOW blank lines, so that no window reaches over them.
    """
    lines: list[tuple[str, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool]] = []  # open boxes: name, dropped
    dropped = inside = 0

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                lines.append((text, inside > 0))
            parts.clear()

    def close(to: int) -> None:
        nonlocal dropped, inside
        while len(stack) > to:
            name, drop = stack.pop()
            dropped -= drop
            inside -= name in ("article", "main")

    at = 0
    for m in _MARKUP.finditer(html):
        if not dropped and m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        name = m[3].lower() if m[3] else ""
        if not name:
            continue
        if name == "br":
            if not dropped:
                parts.append(" ")
            continue
        opens = not m[2]
        drop = opens and _marked(name, m[4]) and not (name == "header" and inside and _holds_title(html, at))
        if name in _BREAKS or drop:
            flush()
        if name not in _BOXES and not drop and not any(n == name for n, d in stack if d):
            continue
        if opens:
            if name in ("article", "main") and not drop and dropped:
                close(next(i for i, (_, d) in enumerate(stack) if d))  # an article ends what was left open
            if not (m[4] or "").rstrip().endswith("/"):
                stack.append((name, drop))
                dropped += drop
                inside += name in ("article", "main")
        else:
            found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if found is not None:
                close(found)
        if name in _BOXES and name not in _FLOWING:
            lines.extend([("", inside > 0)] * WINDOW)
    if not dropped:
        parts.append(html[at:])
    flush()
    return lines


def main_text(html: str | None) -> str:
    """The page's main text: its blocks, joined by an empty line; empty if there is none.

    Text lengths are summed over windows of WINDOW lines. A stretch runs from where a window's sum rises from nothing
    to where it falls to nothing; text surges in it if a sum reaches SURGE. From the first stretch with a surge to the
    end of the last one all is main text, what lies between them too. Article and main elements are a hint: text
    surges in them at any length. Where text surges nowhere, the stretch with the largest sum is the main text;
    a short text without any markup is no page and has none.
    """
    if not html:
        return ""
    lines = page_lines(html)
    sizes = [len(t) for t, _ in lines]
    sums, total = [], 0
    for i, n in enumerate(sizes):
        total += n - (sizes[i - WINDOW] if i >= WINDOW else 0)
        sums.append(total)
    regions: list[tuple[int, int, int]] = []
    start, peak = -1, 0
    for i, s in enumerate([*sums, 0]):
        if s and start < 0:
            start, peak = i, 0
        peak = max(peak, s)
        if not s and start >= 0:
            regions.append((start, i, peak))
            start = -1
    surging = [(a, b) for a, b, p in regions if p >= SURGE or lines[a][1]]
    if not surging:
        if not regions or not _MARKUP.search(html):
            return ""
        # a page of short lines: the stretch with the largest sum, the first of equal ones
        surging = [max(regions, key=lambda r: (r[2], -r[0]))[:2]]
    first, last = surging[0][0], surging[-1][1]
    return "\n\n".join(t for t, _ in lines[first:last] if t)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Null or empty html: empty text, 0 characters. A page cut short gives what came
    before the cut. A row gives a row, repeated or not; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, html in text_groups(batches, ("page_id", "url", "html"), "html"):
            texts = [main_text(h) for h in html]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return map_arrow(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
