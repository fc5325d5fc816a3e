"""Main text of web pages by nearest-URL page differencing.

Pages of a host are sorted by URL path, and each is paired with the page whose path shares the longest beginning
and whose content differs.  Both are turned into text lines (one for each block element), the lines are aligned by
their longest common subsequence, and shared lines are deleted: what a site repeats on pages of different content is
its template.

Copies say nothing about the template, so differencing alone would lose their text.  A page is passed over as a copy
if it has more than half of the text of an ``article`` or ``main`` element, or nine tenths of a page without one.
It looks through eight runs of equal pages on either side; where all of them are copies the page stays whole, unless
two pages that differ from each other have all of it: then it is nothing but template.

Differencing decides inside an ``article`` or ``main`` element too; structure corrects it.  Adverts, notices and the
like may differ from page to page, so lines inside elements that name themselves as such (by tag, or a whole token of
role, class or id) are deleted though they are not shared, but never an ``article`` or ``main`` inside a wrapper of
such a name; if a page has an ``article`` or ``main`` element, lines outside go too.

Pages are dealt by ranges of (host, path), found over a narrow table of addresses and digests first.  Each range is
handed the pages of the nearest runs outside it, so the pairs do not depend on the number of pages or ranges.  One
task holds the runs within reach at a time.

Defined results: null html is an empty page with empty text; pages without a URL are one host; a page that is cut
off in the middle gives what came before; of two equally near pages the one before in order is compared; repeated rows
get equal results; an empty table gives an empty one; a page of any length is taken whole, n lines against m in about
n * m / 64 steps.  Other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from html import unescape
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Neighbours whose articles share more than this part of the text (in characters) carry one article.
SAME_ARTICLE = 0.5
#: As much of pages without such an element makes them copies: template lines may be most of a page.
SAME_PAGE = 0.9
#: So many runs of equal pages are looked through on either side for a page of other content.
REACH = 8
_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>|</?[a-zA-Z!?/][^>]*\Z", re.S)
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg")}
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_BOILER_TAGS = frozenset("nav header footer aside form button select menu dialog head object embed audio video canvas map".split())
_BOILER_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent notice notices alert popup modal newsletter subscribe subscription signup login search breadcrumb breadcrumbs pagination pager share sharing social related recommended comment comments reply replies respond discussion disqus widget toolbar contentinfo complementary".split()
)
_MAIN_TAGS = frozenset(("article", "main"))
#: By a word of theirs these are never boilerplate: the page itself, its article, and headings, whose ids name topics.
_NEVER_BY_WORD = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
#: An article inside one of these is a teaser, not the page's own.
_TEASER_TAGS = frozenset("nav aside footer menu dialog select button".split())
_PART = re.compile(r"[-_]+")
#: Words that leave the meaning of a boilerplate word beside them: site-footer, ad-slot, comment-list.
_NEUTRAL_WORDS = frozenset("site main top bottom slot unit box block list links form bar".split())
_CLOSES = {"p": frozenset(("p",)), "li": frozenset(("li",)), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "tr": frozenset(("tr", "td", "th")), "option": frozenset(("option",)), "dd": frozenset(("dd", "dt")), "dt": frozenset(("dd", "dt"))}

#: What a line is by structure.
OUTSIDE, MAIN, BOILER = 0, 1, 2


def _names_boiler(token: str) -> bool:
    """By the whole token: sidebar, cookie-notice and site-footer, but not has-sidebar or related-work."""
    parts = {p for p in _PART.split(token.lower()) if p} - _NEUTRAL_WORDS
    return bool(parts) and parts <= _BOILER_WORDS


def _is_boiler(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in _BOILER_TAGS and not (tag == "header" and in_main):
        return True
    if attributes and tag not in _NEVER_BY_WORD:
        for m in _NAMED.finditer(attributes):
            if any(map(_names_boiler, (m[1] or m[2] or m[3] or "").split())):
                return True
    return False


def _restores(tag: str, around: Counter) -> bool:
    """Whether a ``main`` or ``article`` inside boilerplate is the page's own: comments on an article and teasers are not."""
    return tag == "main" or not (around["article"] or any(around[t] for t in _TEASER_TAGS))


def lines_of(html: str | None) -> list[tuple[str, int]]:
    """The text lines of a page, in order, with what each is by structure."""
    lines: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    around: Counter = Counter()  # open tags
    kind, at, text = OUTSIDE, 0, html or ""

    def end_line() -> None:
        if parts:
            line = _SPACE.sub(" ", unescape("".join(parts))).strip()
            parts.clear()
            if line:
                lines.append((line, kind))

    while at < len(text):
        m = _TOKEN.search(text, at)
        if m is None:
            parts.append(text[at:])
            break
        if m.start() > at:
            parts.append(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "br":
            parts.append(" ")
            continue
        if not m[1]:
            if tag in _RAW:
                close = _RAW[tag].search(text, at)
                at = close.end() if close else len(text)
                continue
            if tag in _BLOCK:
                end_line()
                closes = _CLOSES.get(tag)
                while closes and stack and stack[-1][0] in closes:
                    closed, kind = stack.pop()
                    around[closed] -= 1
            if tag in _VOID or (m[3] or "").rstrip().endswith("/"):
                continue
            own = kind == BOILER and tag in _MAIN_TAGS and _restores(tag, around)
            stack.append((tag, kind))
            around[tag] += 1
            if kind != BOILER:
                if _is_boiler(tag, m[3] or "", kind == MAIN):
                    end_line()
                    kind = BOILER
                elif tag in _MAIN_TAGS:
                    end_line()
                    kind = MAIN
            elif own:
                end_line()
                kind = MAIN
        elif around[tag]:
            closed, outer = "", kind
            while closed != tag:  # with all that was left open inside
                closed, outer = stack.pop()
                around[closed] -= 1
            if tag in _BLOCK or outer != kind:
                end_line()
            kind = outer
        elif tag in _BLOCK:
            end_line()
    end_line()
    return lines


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    Bit-parallel: after each line of ``a`` one whole number holds, as its zero bits, where in ``b`` the length of the
    common subsequence grows.  Rows are kept at every ``step``-th line and made again between two of these on the way back, so n
    lines against m take n * m / 64 machine steps, and room for about two square roots of n rows.
    """
    start, end_a, end_b = 0, len(a), len(b)
    while start < min(end_a, end_b) and a[start] == b[start]:
        start += 1
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a -= 1
        end_b -= 1
    found = {*range(start), *range(end_a, len(a))}
    places = _places(b[start:end_b])
    lines = [(k, places[a[k]]) for k in range(start, end_a) if a[k] in places]  # others are in no common subsequence
    if not lines:
        return found
    full = (1 << (end_b - start)) - 1

    def rows(row: int, some: list[tuple[int, int]]) -> list[int]:
        out = [row]
        for _, mask in some:
            both = row & mask
            row = ((row + both) | (row - both)) & full
            out.append(row)
        return out

    step, kept, row = isqrt(len(lines)) + 1, [], full
    for k in range(0, len(lines), step):
        kept.append(row)
        row = rows(row, lines[k : k + step])[-1]
    at = (row ^ full).bit_length() - 1  # the last growth
    for block in range(len(kept) - 1, -1, -1):
        here = lines[block * step : (block + 1) * step]
        made = rows(kept[block], here)
        for k in range(len(here) - 1, -1, -1):
            if at < 0:
                return found
            before = made[k]
            if before >> at & 1:  # without this line it does not grow there: the line is matched
                found.add(here[k][0])
                at = ((before ^ full) & ((1 << at) - 1)).bit_length() - 1
    return found


def _places(lines: list[str]) -> dict[str, int]:
    """Bits of the positions of each line."""
    at: dict[str, list[int]] = {}
    for k, line in enumerate(lines):
        at.setdefault(line, []).append(k)
    out = {}
    for line, spots in at.items():
        if len(spots) == 1:
            out[line] = 1 << spots[0]
        else:
            bits = bytearray(spots[-1] // 8 + 1)
            for k in spots:
                bits[k // 8] |= 1 << k % 8
            out[line] = int.from_bytes(bits, "little")
    return out


def _content(page: list[tuple[str, int]]) -> list[int]:
    """Positions of the lines that may be main text by structure."""
    place = MAIN if any(kind == MAIN for _, kind in page) else OUTSIDE
    return [k for k, (_, kind) in enumerate(page) if kind == place]


def _compared(page: list[tuple[str, int]], neighbour: list[tuple[str, int]]) -> tuple[set[int], bool, bool]:
    """Positions of the lines that both have, and whether these are nearly all of the page, and of the neighbour."""
    shared = shared_lines([x for x, _ in page], [x for x, _ in neighbour])
    content = _content(page)
    limit = SAME_ARTICLE if content and page[content[0]][1] == MAIN else SAME_PAGE
    same = sum(len(page[k][0]) for k in content if k in shared)
    return shared, *(same > limit * sum(len(x[k][0]) for k in _content(x)) for x in (page, neighbour))


def differenced(page: list[tuple[str, int]], neighbours: Iterable[list[tuple[str, int]]], compared=_compared) -> str:
    """The page's text after its difference to the nearest neighbour of other content; ``neighbours`` are nearest first.

    A page of template lines only is found by two neighbours that have all of it, and other content than each other.
    """
    content = _content(page)
    shared, around = set(), []
    for neighbour in neighbours if content else ():
        found, is_page, is_neighbour = compared(page, neighbour)
        if not is_page:
            shared = found
            break
        if not is_neighbour and page[content[0]][1] != MAIN and len(around) < 2:
            if not around or not any(_compared(neighbour, around[0][1])[1:]):
                around.append((found, neighbour))
    else:
        if len(around) == 2:
            shared = around[0][0]
    return "\n".join(page[k][0] for k in content if k not in shared)


def main_text(page: list[tuple[str, int]], *neighbours: list[tuple[str, int]] | None) -> str:
    return differenced(page, filter(None, neighbours))


class _Run:
    """Consecutive pages of one html."""

    __slots__ = ("html", "lines", "first", "last", "pages")

    def __init__(self, html: str | None, lines: list[tuple[str, int]], path: str):
        self.html, self.lines, self.first, self.last = html, lines, path, path
        self.pages: list[tuple] = []


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _by_nearness(path: str, before: list[_Run], after: list[_Run]) -> Iterator[_Run]:
    """Runs by the beginning that their paths share with ``path``; in sorted order it only gets shorter with distance."""
    left, right = iter(before), iter(after)
    a, b = next(left, None), next(right, None)
    while a or b:
        if b is None or (a and _common(a.last, path) >= _common(b.first, path)):
            yield a
            a = next(left, None)
        else:
            yield b
            b = next(right, None)


def _texts(run: _Run, before: list[_Run], after: list[_Run]) -> Iterator[tuple]:
    """Rows (id, url, text, length) of a run's pages."""
    known: dict[int, tuple] = {}

    def compared(page, neighbour):
        if id(neighbour) not in known:
            known[id(neighbour)] = _compared(page, neighbour)
        return known[id(neighbour)]

    for path, key, url in run.pages:
        near = (x.lines for x in _by_nearness(path, before, after) if x.lines)
        text = differenced(run.lines, near, compared)
        yield key, url, text, len(text)


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _difference(batches):
    """Rows (own, host, path, id, url, html) sorted by host and path; only own rows are given out."""
    out: list[tuple] = []
    runs: list[_Run] = []  # of one host: those before the run at ``at``, that run, and those after it
    at = 0

    def advance(least: int):
        nonlocal at
        while len(runs) - at > least:
            out.extend(_texts(runs[at], runs[max(0, at - REACH) : at][::-1], runs[at + 1 : at + 1 + REACH]))
            runs[at].pages.clear()
            at += 1
            if at > REACH:
                del runs[0]
                at -= 1

    host = None
    for own, h, path, key, url, html in _rows(batches):
        if h != host:
            advance(0)
            runs.clear()
            host, at = h, 0
        if not runs or runs[-1].html != html:
            advance(REACH)
            runs.append(_Run(html, lines_of(html), path))
        runs[-1].last = path
        if own:
            runs[-1].pages.append((path, key, url))
        if len(out) >= 1000:
            yield _batch(out)
            out.clear()
    advance(0)
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["page_id", "url", "text", "n_chars"])


def _ends(batches):
    """Of a range's rows (host, path, id, digest), sorted: the first pages of the first runs of its first host, and the
    last pages of the last runs of its last host."""
    head: list[tuple] = []
    tail: deque[tuple] = deque(maxlen=REACH + 1)
    one_host, before = True, None
    for row in _rows(batches):
        if before is not None and row[0] != before[0]:
            one_host = False
            tail.clear()
        if not tail or row[3] != tail[-1][3]:
            tail.append(row)
            if one_host and len(head) <= REACH:
                head.append(row)
        tail[-1] = before = row
    if head:
        part = TaskContext.get().partitionId()
        ends = [(part, one_host, side, k, *row) for side, rows in ((0, head), (1, tail)) for k, row in enumerate(rows)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*ends, strict=True)], names=["part", "one_host", "side", "k", "host", "path", "key", "digest"])


def _outer(ranges: list[tuple[bool, list, list]], at: int, step: int) -> list[tuple]:
    """Pages of the nearest runs outside a range, of the host at its end, from as many ranges as it takes."""
    host, found = ranges[at][1 if step < 0 else 2][0 if step < 0 else -1][0], []
    at += step
    while 0 <= at < len(ranges):
        one_host, head, tail = ranges[at]
        for row in tail[::-1] if step < 0 else head:
            if row[0] != host or len(found) > REACH:
                return found
            if not found or found[-1][3] != row[3]:
                found.append(row)
        if not one_host:
            break
        at += step
    return found


def _dealing(keys: DataFrame, parts: int) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """The first key of each range of ``keys``, and for pages near its ends the other ranges that need them."""
    order = ("host", "path", "key", "digest")
    kinds = "part long, one_host boolean, side long, k long, host string, path string, key long, digest long"
    ends: dict[int, tuple[bool, list, list]] = {}
    for r in sorted(map(tuple, keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_ends, kinds).collect())):
        ends.setdefault(r[0], (r[1], [], []))[1 + r[2]].append(r[4:])
    ranges = sorted(ends.values(), key=lambda x: x[1][0])
    handed: dict[tuple, list[int]] = {}
    for k in range(len(ranges)):
        for row in (*_outer(ranges, k, -1), *_outer(ranges, k, 1)):
            handed.setdefault(row, []).append(k)
    return [head[0] for _, head, _ in ranges], handed


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", parts: int | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for each page; keys are integers."""
    address = F.coalesce(F.col(url).cast("string"), F.lit(""))
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(
        F.regexp_extract(address, r"(?s)^(?:[^/?#]*://)?([^/?#]*)", 1).alias("host"),
        F.regexp_extract(address, r"(?s)^(?:[^/?#]*://)?[^/?#]*([^?#]*)", 1).alias("path"),
        F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("key"), F.xxhash64(body).alias("digest"),
        F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("html"),
    )
    parts = parts or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    starts, handed = _dealing(rows.select("host", "path", "key", "digest"), parts)

    @F.arrow_udf("array<int>")
    def dealt(host: pa.Array, path: pa.Array, key: pa.Array, digest: pa.Array) -> pa.Array:
        """Twice the range, and one more where it is the row's own."""
        out = []
        for row in zip(*(c.to_pylist() for c in (host, path, key, digest)), strict=True):
            own = max(0, bisect_right(starts, row) - 1)
            out.append([2 * own + 1, *(2 * k for k in handed.get(row, ()) if k != own)])
        return pa.array(out, pa.list_(pa.int32()))

    order = ("host", "path", "key", "digest")
    copied = rows.withColumn("range", F.explode(dealt(*order)))
    ready = copied.repartitionById(max(1, len(starts)), F.expr("range div 2").cast("int")).sortWithinPartitions(F.expr("range div 2"), *order)
    own = (F.col("range") % 2 == 1).alias("own")
    return ready.select(own, "host", "path", "id", "url", "html").mapInArrow(_difference, "page_id long, url string, text string, n_chars long")
