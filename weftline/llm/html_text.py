"""Main text of web pages by the distribution of text over lines (line blocks).

Each block of a page is a line. Markup, and lines of page furniture, count as no text.
Text lengths are summed over sliding windows of lines; text is kept from a surge
(a window whose sum passes a threshold) to the next dive (a window of no text), on every
page. An article or main element is evidence: its text weighs ``CONTENT_WEIGHT`` times,
and the heaviest region tells whether the main text is inside such elements or outside.
Regions of the other side are kept if they weigh ``OTHER_SIDE`` of the heaviest. Short text
that furniture parts from a region goes with it if both stand in the same element.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices

WINDOW = 3
SURGE_CHARS = 86
LINK_SHARE = 0.6
CONTENT_WEIGHT = 2
OTHER_SIDE = 0.5

# Element names of HTML by their part in a page.
RAW = "script style noscript template svg math iframe object canvas head title textarea select".split()
FURNITURE = "nav header footer aside form dialog menu button option".split()
CONTENT = ("article", "main")
BLOCKS = frozenset("address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role values that mark furniture.
MARKS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|newsletter|subscribe|signup|login|search|nav\w*|menu|breadcrumbs?|pagination|pager|toolbar|sidebar|side-bar|aside|widget|related|recommended|share|sharing|social|footer|header|masthead|comments?|commentlist|disqus|respond|replies|contentinfo|complementary|banner|navigation)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[a-zA-Z/!?][^>]*\Z", re.S)
_ATTR = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")


def lines_of(page: str):
    """``(text, characters inside links, furniture, article or main element, element)`` for each block with text, in page order.

    Elements are numbered; the outermost article or main element counts, 0 where there is none.
    """
    out, buf, linked = [], [], 0
    stack: list[tuple[str, bool, bool, int]] = []  # name, furniture, content, number
    junk = inside = links = number = content = 0

    def flush():
        nonlocal buf, linked
        text = _SPACE.sub(" ", "".join(buf)).strip()
        if text:
            out.append((text, linked, junk > 0, content if inside else 0, stack[-1][3] if stack else 0))
        buf, linked = [], 0

    def add(raw):
        nonlocal linked
        if raw:
            text = entities.unescape(raw)
            buf.append(text)
            if links:
                linked += len(_SPACE.sub(" ", text).strip())

    at, n, unclosed = 0, len(page), set()
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"])
        if not (name := m["name"]):
            continue
        name, ending = name.lower(), bool(m["end"])
        if name in RAW and not ending:
            # everything to the end tag is not text; without one, scripts and styles run to the end of the page
            close = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if not close:
                unclosed.add(name)  # there is no end further on either, so it is looked for once
            if name in BLOCKS:
                flush()
            at = close.end() if close else n if name in ("script", "style") else at
            continue
        if name == "a":
            links = 0 if ending else 1
            continue
        if name == "br":
            buf.append(" ")
            continue
        if name in BLOCKS:
            flush()
            links = 0
        if name in EMPTY:
            continue
        if not ending:
            marks = " ".join(x for g in _ATTR.findall(m["attrs"] or "") for x in g if x)
            bad = name in FURNITURE and not (name == "header" and inside) or bool(marks and name not in ("html", "body", *CONTENT) and MARKS.search(marks))
            good = name in CONTENT and not junk
            if not m["attrs"].rstrip().endswith("/") and (name in BLOCKS and name not in ("p", "li") or bad):
                number += 1
                if good and not inside:
                    content = number
                stack.append((name, bad, good, number))
                junk += bad
                inside += good
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    for _, bad, good, _ in stack[k:]:
                        junk -= bad
                        inside -= good
                    del stack[k:]
                    break
    flush()
    return out


def main_text(page: str, window: int = WINDOW, surge: int = SURGE_CHARS) -> str:
    lines = lines_of(page)
    sizes = [0 if bad or (not content and linked >= LINK_SHARE * len(text)) else len(text) for text, linked, bad, content, _ in lines]
    if not any(sizes):
        return ""
    # regions of text up to the dive (a window without text); an article or main element begins and ends one
    n, regions, i = len(sizes), [], 0
    while i < n:
        if not sizes[i]:
            i += 1
            continue
        content, at, j = lines[i][3], [i], i + 1
        while j < n and j - at[-1] <= window:
            if sizes[j]:
                if lines[j][3] != content:
                    break
                at.append(j)
            j += 1
        regions.append(at)
        i = at[-1] + 1
    sums = [max(sum(sizes[k] for k in at if f <= k < f + window) for f in at) for at in regions]
    least = min(surge, max(1, max(sums) // 4))  # relative where a page has little text
    whole: dict[int, int] = {}
    for (_, _, _, content, _), size in zip(lines, sizes, strict=True):
        whole[content] = whole.get(content, 0) + size
    contents = [lines[at[0]][3] for at in regions]
    weights = [CONTENT_WEIGHT * whole[c] if c else sum(sizes[k] for k in at) for c, at in zip(contents, regions, strict=True)]
    side = contents[weights.index(max(weights))] > 0
    allowed = [(c > 0) == side or w >= OTHER_SIDE * max(weights) for c, w in zip(contents, weights, strict=True)]
    surges = [good and x >= least for good, x in zip(allowed, sums, strict=True)]
    # where text surges: the whole article or main element, and elsewhere the elements that hold its lines
    homes = {lines[k][3] or -lines[k][4] for at, good in zip(regions, surges, strict=True) if good for k in at}
    kept = []
    for at, good, may in zip(regions, surges, allowed, strict=True):
        kept.extend(lines[k][0] for k in at if good or (may and (lines[k][3] or -lines[k][4]) in homes))
    return "\n\n".join(kept)


def extract(pages: DataFrame, window: int = WINDOW, surge: int = SURGE_CHARS) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``page_id, url, html``.

    The whole page is read. Null or empty html, or a page without content, gives an
    empty text; null ids and addresses stay; repeated rows each give a row; an empty
    table gives none; other columns are left out. A map over the rows, without a shuffle.
    """

    def run(batches):
        for batch in in_slices(batches, 128):
            texts = [main_text(x, window, surge) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
