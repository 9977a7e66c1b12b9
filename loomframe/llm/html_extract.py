"""Main text by line-block distribution.

A page is cut at its block elements into lines of plain text; empty lines are
skipped.  Lines of page furniture (menus, headers, footers, asides, forms,
notices, adverts, comments) and of links weigh nothing.  The weights are summed
over sliding windows of WINDOW lines; the main text begins where the sum surges
and ends where it dives, and all lines between are kept.

An element that marks an article is a bounded hint.  Where marked elements hold
at least half of the page's text, links in them weigh as text, a run in them
needs a peak HINT times lower, and any other run one HINT times higher.  Where
they hold less, the hint is turned round: text outside is favoured.

Words of class, id or role that may as well name a part of an article (``SOFT``)
are a hint too.  Inside an article, a stretch of lines so marked is furniture only
where its own window sums stay below DENSE characters.

Cases: null and empty pages give an empty text; unclosed and stray tags, cut-off
pages and very long pages are read to their end; rows of a repeated or null
page_id are read one by one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window; share of the largest window sum at which a run's peak counts as a surge; how far a marked article moves it.
WINDOW, SURGE, HINT = 3, 0.2, 2.5
#: Characters outside links in a window from which on softly marked lines of an article are text.
DENSE = 120

# Element names of HTML by their role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes noembed xmp select desc metadata".split())
FURNITURE = frozenset("nav header footer aside form menu dialog button label fieldset search object audio video canvas".split())
#: Words of class, id or role that mark page furniture.
MARKS = re.compile(
    r"(?<!\bno-)(?<!\bhas-)(?<!\bwith-)(?:(?<=^)|(?<=[\s_-]))(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|sidebar|aside|nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|topbar|topnav|toolbar|sidenav|header|masthead|footer|comment|comments|commentlist|disqus|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|share|sharing|social|related|widget|widgets|searchbox|pager|pagination|contentinfo|hidden)(?=$|[\s_-])"
)
#: Words of class, id or role that mark furniture outside an article, and inside it where there is little text.
SOFT = re.compile(
    r"(?<!\bno-)(?<!\bhas-)(?<!\bwith-)(?:(?<=^)|(?<=[\s_-]))(?:side|foot|bottom|reply|replies|respond|response|responses|feedback|discussion|signup|login|recommended|recommendations|search|copyright|legal|disclaimer|complementary|tags|tagcloud|skip)(?=$|[\s_-])"
)
TAG = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
SPACE = re.compile(r"\s+")


def _marked(attributes: str, in_article: bool) -> int:
    """2 if the attributes mark furniture, 1 if they may, else 0."""
    level = 0
    if "=" not in attributes and "hidden" not in attributes:
        return level
    for name, value in ATTR.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            # an article's own header holds its headline
            if any(not (in_article and m[0] == "header") for m in MARKS.finditer(value)):
                return 2
            if SOFT.search(value):
                level = 1 if in_article else 2
        elif name == "hidden" or value == "true":
            return 2
    return level


def lines(page: str, marks: bool = True) -> list[tuple[str, int, int, bool]]:
    """(text, characters outside links, level of furniture, inside the article) of each block, in order.

    The level is 2 inside furniture, 1 inside what is only softly marked, else 0.

    Without ``marks`` only elements that are furniture by their name count as such.
    """
    out: list[tuple[str, int, int, bool]] = []
    text: list[str] = []
    links = 0
    open_tags: list[tuple[str, int, bool]] = []  # name, level of furniture, article
    furniture = soft = article = 0
    in_link = 0

    def put(s: str) -> None:
        nonlocal links
        if s:
            text.append(s)
            if in_link:
                links += len(s)

    def cut() -> None:
        nonlocal links
        s = SPACE.sub(" ", entities.unescape("".join(text))).strip()
        out.append((s, max(0, len(s) - links) if s else 0, 2 if furniture else 1 if soft else 0, article > 0))
        text.clear()
        links = 0

    def close(until: int) -> None:
        nonlocal furniture, soft, article, in_link
        while len(open_tags) > until:
            name, f, a = open_tags.pop()
            furniture -= f == 2
            soft -= f == 1
            article -= a
            in_link -= name == "a"

    at = 0
    while m := TAG.search(page, at):
        put(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            cut()
        elif name == "br":
            text.append(" ")
        if m[1]:
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == name:
                    close(i)
                    break
            continue
        if name in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option", "a"):
            # these close an open element of their kind by themselves
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == name:
                    close(i)
                    break
                if open_tags[i][0] in ("ul", "ol", "dl", "table", "div", "article", "section", "main", "body"):
                    break
        a = name in ("article", "main") or name == "div" and 'role="main"' in m[3]
        # an article's own header holds its headline
        f = 0
        if name in FURNITURE and not (name in ("header", "label") and article):
            f = 2
        elif marks and name not in ("html", "body", "article", "main"):
            f = _marked(m[3], article > 0)
        open_tags.append((name, f, a))
        furniture += f == 2
        soft += f == 1
        article += a
        in_link += name == "a"
    rest = page[at:]
    put(re.sub(r"<[a-zA-Z/!][^>]*$", "", rest, flags=re.S))
    cut()
    return out


def runs(weights: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """Runs of lines (first, after the last, largest window sum) between surge and dive points.

    A run begins at a line of weight where the window sum rises from nothing
    and ends where the sum falls to nothing again.
    """
    n = len(weights)
    total = sum(weights[:window])
    out, start, best = [], -1, 0
    for i in range(n + 1):
        if total and (start >= 0 or weights[i]):
            start, best = (i, total) if start < 0 else (start, max(best, total))
        elif start >= 0:
            out.append((start, i, best))
            start = -1
        if i < n:
            total += (weights[i + window] if i + window < n else 0) - weights[i]
    return out


def main_text(page: str) -> str:
    """The page's main text, its blocks joined by one space.

    Where class names leave no text at all, they are not followed.
    """
    return _text(lines(page)) or _text(lines(page, marks=False))


def judged(rows: list[tuple[str, int, int, bool]], dense: int = DENSE) -> list[bool]:
    """Whether each line is furniture: softly marked stretches are where no window of theirs is dense."""
    out: list[bool] = []
    for level, group in groupby(rows, key=lambda x: x[2]):
        weights = [weight for _, weight, *_ in group]
        most = max(sum(weights[i : i + WINDOW]) for i in range(len(weights)))
        out += [level == 2 or level == 1 and most < dense] * len(weights)
    return out


def _text(found: list[tuple[str, int, int, bool]]) -> str:
    kept = [x for x in found if x[0]]
    rows = [(s, weight, furniture, article) for (s, weight, _, article), furniture in zip(kept, judged(kept), strict=True)]
    size = lambda inside: sum(weight for _, weight, furniture, article in rows if not furniture and article == inside)
    marked = size(True) > 0
    favoured = size(True) >= size(False)
    weights = [0 if furniture else len(s) if marked and favoured and article else weight for s, weight, furniture, article in rows]
    # a run lies on one side of the article's edge
    pieces, at = [], 0
    for article, group in groupby(rows, key=lambda x: x[3]):
        n = len(list(group))
        share = SURGE if not marked else SURGE / HINT if article == favoured else SURGE * HINT
        pieces += [(at + first, at + end, peak, share) for first, end, peak in runs(weights[at : at + n])]
        at += n
    top = max((peak for _, _, peak, _ in pieces), default=0)
    keep: list[str] = []
    for first, end, peak, share in pieces:
        if peak >= share * top:
            keep += [s for s, _, furniture, _ in rows[first:end] if not furniture]
    return " ".join(keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "") for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
