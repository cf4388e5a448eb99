"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element.  Elements that hold menus, headers, footers, sidebars, notices,
adverts, forms, scripts or reader comments, by tag or by class, id or role, are markup too; outside an article blocks of
them leave a break of ``WINDOW`` empty lines, and inline ones (a button, an advert in a sentence) leave their line whole.
Where a page marks its article (``<article>``, ``<main>``, articleBody), everything outside is markup, and the lines of
several articles follow each other.

A line weighs its characters, those of links a quarter.  The weights of ``WINDOW`` lines in a row are summed; a stretch
begins where the sum rises from zero and dives where it is zero again.  Main text are the stretches in which a sum surges
to ``SURGE``, by the same threshold on every page; a page without a surge has its stretch with the largest sum.

Cases: a null or empty page gives an empty text; markup that is not closed is closed by what follows (``</head>`` may be
left out); tags may be nested to any depth, in linear time; a page of markup alone gives an empty text; repeated rows get
equal results; page_id and url may be null; an empty table gives an empty result; extra columns of any name are passed over.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import lean

WINDOW = 3  #: lines whose weights are summed
SURGE = 40  #: weight of a window at which a stretch is main text

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
#: elements whose content is no markup of the page
RAW = frozenset("script style noscript template iframe object svg math canvas title select textarea".split())
ASIDE = frozenset("head nav header footer aside form menu dialog button label input fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br"}
IN_HEAD = frozenset("base link meta title style script noscript template".split())
#: parts of a class, id or role that name other things than text, wherever they stand in it
NOISE = frozenset("ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors breadcrumb breadcrumbs nav navbar navigation menu menubar masthead footer sidebar cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login disqus comment comments commentlist respond replies pagination pager toolbar complementary contentinfo".split())
#: parts that do so at the end of a name, or before a word for a container
NOISE_LAST = frozenset("header foot side aside widget widgets notice promo promotion promotions share sharing social related recommended recommendations search form legal copyright skip".split())
CONTAINER = frozenset("bar block box button buttons container content field group icons area items link links list media posts articles stories topics section text widget wrap wrapper row panel".split())
#: a name that begins so tells of the layout around the text
LAYOUT = frozenset("has no with without is not layout page body".split())
#: parts by which an article inside is not the page's own
OTHERS = frozenset("comment comments commentlist respond replies disqus related recommended recommendations sidebar widget widgets promo".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMED = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s=/])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
BODY = re.compile(r"itemprop\s*=\s*[\"']?articleBody", re.I)
SPACE = re.compile(r"\s+")
PART = re.compile(r"[-_]+")


def _noise_name(element: str, attributes: str, in_article: bool) -> frozenset[str]:
    """The parts of an element's class, id and role that say it holds no text of the page; a heading's id is made of its words."""
    found = set()
    for key, a, b, c in NAMED.findall(attributes):
        if element in HEADING and key.lower() == "id":
            continue
        for name in (a or b or c).lower().split():
            parts = PART.split(name)
            if parts[0] in LAYOUT:
                continue
            found.update(p for p in parts if p in NOISE)
            for i, p in enumerate(parts):
                if p in NOISE_LAST and (i + 1 == len(parts) or parts[i + 1] in CONTAINER) and not (p == "header" and in_article):
                    found.add(p)
    return frozenset(found)


def lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, weight, in article) of each line: white space made single, character references decoded; breaks are ("", 0, False)."""
    out: list[tuple[str, int, bool]] = []
    buf: list[str] = []
    linked: list[str] = []
    stack: list[tuple] = []  # (name, noise, article, parts, link) before the element
    depth: dict[str, int] = {}
    noise = article = link = False
    parts: frozenset[str] = frozenset()
    gone: set[str] = set()  # raw elements without an end further on

    def clean(text: list[str]) -> str:
        return SPACE.sub(" ", _html.unescape("".join(text))).strip()

    def flush() -> None:
        if buf:
            text = clean(buf)
            if text:
                inside = len(clean(linked)) if linked else 0
                out.append((text, max(1, len(text) - inside + inside // 4), article))
        buf.clear()
        linked.clear()

    def close(name: str) -> None:
        nonlocal noise, article, parts, link
        while stack:
            top, *state = stack.pop()
            depth[top] -= 1
            if noise and not state[0] and not state[1] and (top in BLOCK or top == "head"):
                out.extend([("", 0, False)] * WINDOW)
            noise, article, parts, link = state
            if top == name:
                return

    def say(text: str) -> None:
        if text and not noise:
            buf.append(text)
            if link:
                linked.append(text)

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCK:
                flush()
            if depth.get(name):
                if name not in BLOCK and any(s[0] in BLOCK for s in stack[-1:]):
                    flush()
                close(name)
            continue
        if depth.get("head") and name not in IN_HEAD and name not in RAW and name != "head":
            flush()
            close("head")
        if name in RAW:
            if not m[3].rstrip().endswith("/") and name not in gone:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if end or name in ("script", "style"):
                    at = end.end() if end else n
                else:
                    gone.add(name)
            continue
        if name in BLOCK:
            flush()
        if name in CLOSES_P and depth.get("p"):
            close("p")
        if name in VOID:
            continue
        stack.append((name, noise, article, parts, link))
        depth[name] = depth.get(name, 0) + 1
        named = _noise_name(name, m[3], article) if m[3] and name not in ("html", "body", "main") else frozenset()
        if name in ("article", "main") or (m[3] and BODY.search(m[3])):
            if noise and parts and not named and (name == "main" or not parts & OTHERS):
                noise, parts = False, frozenset()  # named by a wrapper that holds the page's article
            article = not noise
        link = link or name == "a"
        # an article's own header holds its title
        if (name in ASIDE and not (name == "header" and article)) or named or (m[3] and HIDDEN.search(m[3])):
            if not noise:
                # an inline element leaves its line whole
                if not article and (name in BLOCK or name == "head"):
                    flush()
                    out.extend([("", 0, False)] * WINDOW)
                parts = named
            noise = True
    flush()
    return out


def extract(page: str | None) -> str:
    """The main text of a page, a line per block."""
    if not page:
        return ""
    rows = lines(page)
    if any(a for _, _, a in rows):
        rows = [r for r in rows if r[2]]
    n = len(rows)
    total = [0]
    for _, weight, _ in rows:
        total.append(total[-1] + weight)
    sums = [total[min(i + WINDOW, n)] - total[i] for i in range(n)]
    stretches: list[tuple[int, int, int]] = []  # (largest sum, from, to)
    i = 0
    while i < n:
        j = i
        while j < n and sums[j] > 0:
            j += 1
        if j > i:
            stretches.append((max(sums[i:j]), i, j))
        i = j + 1
    main = [s for s in stretches if s[0] >= SURGE] or sorted(stretches, key=lambda s: (-s[0], s[1]))[:1]
    return "\n".join(text for _, a, z in main for text, _, _ in rows[a:z] if text)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return lean(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
