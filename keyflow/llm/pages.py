"""Main text of web pages: blocks of the page, less its boilerplate, by nearest-URL page differencing and markup.

A page is read into blocks of text. Each lies in the article (``article``, ``main`` or an equivalent role), in what markup
names as boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, comments), or outside both. Pages are
sorted by host and path; each is paired with the nearest pages by path that differ from it, their lines are aligned by
longest common subsequence, and lines that they share are deleted: they belong to the template. Markup is asked about what
is left: a page with lines of an article gives these, another what is left outside articles and boilerplate.

Lines outside articles are template if the nearest page has them. Articles are copied between pages, passages of theirs too,
and many articles may end with the same line, so lines of an article need more: all of the next ``REACH`` pages on
each side share them, and ``WITNESSES`` or more at the same place from the start or the end of their articles. Headings stay,
unless all of the article is template. A page that shares more than ``VERSION`` of the longer one's text, or more than ``COPY``
of this one's, is another version of it and says nothing about template.

A page with the same lines as another is its copy and no partner for differencing, nor is for lines outside articles one
that shares more than ``COPY`` of them: then the nearest differing page on the other side is, and if that is a copy too
nothing is deleted. So pages that repeat keep their text.

Pages are dealt out by ranges of (host, path), a partition for each range, and streamed in that order. The nearest
differing pages before and after each range also go to it, so a host with a third of all pages is cut anywhere and results
do not depend on where. A partition holds the ids and URLs of the copies of five pages in a row, and the lines of nine.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from hashlib import blake2b
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from keyflow.llm.common import released, tasks

#: Share of a page's text outside articles from which on another page that has it too is a copy, not a template.
COPY = 0.9
#: Share of the longer page's text from which on two pages that have it are versions of one another, for lines of articles.
VERSION = 0.5
#: Pages on each side that lines of articles are compared with, and how many must have a line at the same place.
REACH = 4
WITNESSES = 4
#: Cells of an alignment that are kept at once, in bits.
_ALIGN_BITS = 1 << 26

BOILERPLATE, OUTSIDE, ARTICLE, FORM, NOTHING = 0, 1, 2, 3, 4
# Element names of HTML by what they do to text and to open elements.
_VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section select summary table tbody "
    "tfoot thead tr ul".split()
)
_SPACED = frozenset("br td th img".split())
_RAW_TEXT = frozenset("script style textarea title iframe noembed noframes".split())
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_DROPPED = frozenset("nav footer aside button select dialog menu fieldset object canvas audio video".split())
_UNSEEN = frozenset("noscript template svg annotation annotation-xml datalist".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "li listing main menu nav ol p pre search section summary table ul".split()
)
_SCOPE = frozenset("applet caption html marquee object table td template th".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BOUNDS = _BLOCK | _SCOPE
_BUTTON_SCOPE = _SCOPE | {"button"}
_ITEM_BOUNDS = _BOUNDS - {"address", "div", "p"}
_TABLE_SCOPE = frozenset(("table",))
_FOREIGN_PARTS = frozenset(("foreignobject", "desc", "title"))
_NONE: frozenset[str] = frozenset()
_TABLE = {
    "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "tr": frozenset(("td", "th", "tr", "caption", "colgroup")),
    **dict.fromkeys(("tbody", "thead", "tfoot"), frozenset("td th tr tbody thead tfoot caption colgroup".split())),
}
_LEAVES_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span "
    "strong strike sub sup table tt u ul var".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Parts of class names and ids that name boilerplate, parts that may stand beside them, and whole names.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner promo promoted promotion sponsor sponsored sidebar nav navbar navigation "
    "menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations trending comment comments commentlist disqus respond replies widget toolbar pagination pager".split()
)
_FILLERS = frozenset(
    "box list bar area section wrapper wrap container inner outer block slot button buttons link links post posts article articles entry story item items form "
    "top bottom left right site page main global primary secondary unit holder module panel row col title heading icon icons group dropdown mobile desktop "
    "sticky fixed policy media thread side content this by the".split()
)
_WHOLE_NAMES = frozenset("site-header page-header skip-link".split())
#: Names that exclude even an element that is an article by its tag.
_NO_ARTICLE = frozenset("ad ads advert adverts advertisement sponsored promoted comment comments commentlist disqus respond replies".split())

_ATTRIBUTES = r"((?:[\s/]++|=?[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+))?+|=)*+)"
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*>|<(/?)([a-zA-Z][^\s/>]*)" + _ATTRIBUTES + r"(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_PART = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
#: A block of a page: its zone, its text, and whether it is a heading.
Line = tuple[int, str, bool]
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in _RAW_TEXT}


def _named(names: str, among: frozenset[str] = _NAMES) -> bool:
    """Whether one of the names, taken whole, names boilerplate: some of its parts do and all others are fillers, so that
    ``ad``, ``related-posts`` and ``commentList`` do, ``has-sidebar``, ``no-ads`` and ``content-sidebar`` don't."""
    for name in names.split():
        if name.lower() in _WHOLE_NAMES and among is _NAMES:
            return True
        parts = [p.lower().strip("0123456789") for p in _PART.split(name)]
        parts = [p for p in parts if p]
        if parts and parts[0] != "content" and any(p in among for p in parts) and all(p in _NAMES or p in _FILLERS for p in parts):
            return True
    return False


def _bare_zone(tag: str, zone: int) -> int:
    """The zone inside an element without attributes."""
    if tag in _DROPPED or (tag == "header" and zone != ARTICLE):
        return BOILERPLATE
    return ARTICLE if tag in ("article", "main") else FORM if tag == "form" else zone


def _zone(tag: str, attributes: str, zone: int, code: bool) -> int:
    """The zone inside an element that stands in ``zone``; ``code``: inside of program text, where names mean nothing."""
    if zone in (BOILERPLATE, NOTHING):
        return zone
    if tag in _UNSEEN:
        return NOTHING
    if not attributes.strip(" /\t\r\n"):
        return _bare_zone(tag, zone)
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), next((v for v in values if v), ""))
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", ""))
    if tag in _DROPPED or role in _ROLES or hidden:
        return BOILERPLATE
    names = "" if code else found.get("class", "") + " " + found.get("id", "")
    if tag in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
        return BOILERPLATE if _named(names, _NO_ARTICLE) else ARTICLE
    if tag == "form" or role == "form":
        return FORM
    if (tag == "header" and zone != ARTICLE) or _named(names):
        return BOILERPLATE
    return zone


class _Open:
    """The open elements: (tag, zone around it), and the zone inside the last."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.count: dict[str, int] = {}
        self.zone = OUTSIDE

    def push(self, tag: str, inside: int) -> None:
        self.stack.append((tag, self.zone))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.zone = inside

    def cut(self, i: int) -> None:
        """Close the i-th open element and all inside it."""
        self.zone = self.stack[i][1]
        for tag, _ in self.stack[i:]:
            self.count[tag] -= 1
        del self.stack[i:]

    def find(self, tags: frozenset[str] | tuple[str, ...], stops: frozenset[str]) -> int:
        """The innermost open element of ``tags``, -1 if there is none inside the innermost one of ``stops``."""
        count = self.count
        for t in tags:
            if count.get(t):
                break
        else:
            return -1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                return i
            if self.stack[i][0] in stops:
                return -1
        return -1

    def implied(self, tag: str) -> None:
        """Close what a start tag closes, as end tags may be left out."""
        if tag in _CLOSES_P and self.count.get("p") and (i := self.find(("p",), _BUTTON_SCOPE)) >= 0:
            self.cut(i)
        if tag == "li":
            if (i := self.find(("li",), _ITEM_BOUNDS)) >= 0:
                self.cut(i)
        elif tag in ("dt", "dd"):
            if (i := self.find(("dt", "dd"), _ITEM_BOUNDS)) >= 0:
                self.cut(i)
        elif tag in _TABLE:
            low = -1
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in ("table", "template"):
                    break
                if self.stack[i][0] in _TABLE[tag]:
                    low = i
            if low >= 0:
                self.cut(low)
        elif self.stack and (self.stack[-1][0] in _HEADINGS and tag in _HEADINGS or self.stack[-1][0] == "option" and tag in ("option", "optgroup")):
            self.cut(len(self.stack) - 1)

    def leave_foreign(self, tag: str) -> None:
        """HTML inside of a drawing ends the drawing."""
        if tag in _LEAVES_FOREIGN and (i := self.find(("svg",), _FOREIGN_PARTS)) >= 0:
            self.cut(i)

    def end(self, tag: str) -> None:
        if tag in ("html", "body", "head"):
            return
        if tag in _HEADINGS:
            i = self.find(_HEADINGS, _SCOPE)
        elif tag in _BLOCK or tag in _SCOPE:
            i = self.find((tag,), _TABLE_SCOPE if tag in _SCOPE or tag in _TABLE else _SCOPE)
        else:
            i = self.find((tag,), _BOUNDS)
            if i < 0 and tag in _FORMATTING and (i := self.find((tag,), _SCOPE)) >= 0:
                del self.stack[i]  # what it wraps goes on
                self.count[tag] -= 1
                return
        if i >= 0:
            self.cut(i)


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of each block in page order. Character references are decoded; white space becomes one space."""
    return [(z, t) for z, t, _ in page_lines(page)]


def page_lines(page: str | None) -> list[Line]:
    """The blocks of a page, and whether each is a heading."""
    out: list[Line] = []
    tree, parts = _Open(), []
    zone, heading = tree.zone, False

    def close() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split()) if zone != NOTHING else ""
            if text:
                out.append((zone, text, heading))
            parts.clear()

    page, at = page or "", 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        foreign = tree.zone == NOTHING and tree.find(("svg",), _NONE) >= 0
        if m[1]:
            tree.end(tag)
        else:
            if foreign:
                tree.leave_foreign(tag)
                foreign = tree.zone == NOTHING and tree.find(("svg",), _NONE) >= 0
            if tag in _RAW_TEXT and not foreign:
                if tag == "iframe" or tag == "textarea":
                    parts.append(" ")
                end = _END[tag].search(page, at)
                at = end.end() if end else len(page)
                continue
            tree.implied(tag)
            if tag not in _VOID and tag not in ("html", "body", "head") and not ((foreign or tag in ("svg", "math")) and (m[3] or "").endswith("/")):
                inside = _zone(tag, m[3] or "", tree.zone, bool(m[3]) and tree.find(("pre", "code"), _NONE) >= 0)
                tree.push(tag, inside)
        if tag in _BLOCK or tree.zone != zone:
            close()
            zone = tree.zone
            if tag in _BLOCK:
                heading = tag in _HEADINGS and not m[1]
        if tag in _SPACED:
            parts.append(" ")
    if at < len(page):
        parts.append(page[at:])
    close()
    return out


def _row(lines: list[str], masks: dict[str, int], full: int) -> Iterator[int]:
    """Bit-parallel rows of the alignment: a bit of row i that is 0 raises the length of the subsequence of the first i
    lines there."""
    v = full
    yield v
    for line in lines:
        u = v & masks.get(line, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(lines: list[str], other: list[str]) -> np.ndarray:
    """The length of the longest common subsequence of ``lines`` and the first j of ``other``, for each j."""
    v = 0
    for v in _row(lines, _masks(other), (1 << len(other)) - 1):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(other) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(other)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _masks(other: list[str]) -> dict[str, int]:
    places: dict[str, list[int]] = {}
    for j, line in enumerate(other):
        places.setdefault(line, []).append(j)
    out = {}
    for line, found in places.items():
        if len(found) == 1:
            out[line] = 1 << found[0]
        else:
            bits = np.zeros(found[-1] + 1, np.uint8)
            bits[found] = 1
            out[line] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return out


def shared_lines(mine: list[str], other: list[str]) -> set[int]:
    """Places in ``mine`` of one longest common subsequence with ``other``. Lines that only one has are left out, what both
    begin and end with is cut off, and long alignments are halved, so memory is bounded."""
    both = set(mine) & set(other)
    at = [i for i, x in enumerate(mine) if x in both]
    a, b = [mine[i] for i in at], [x for x in other if x in both]
    return {at[i] for i in _aligned(a, b)}


def _aligned(a: list[str], b: list[str]) -> list[int]:
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    found = [*range(low), *range(len(a) - high, len(a))]
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if not a or not b:
        return found
    if len(a) * len(b) > _ALIGN_BITS and len(a) > 1:
        half = len(a) // 2
        j = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return found + [low + i for i in _aligned(a[:half], b[:j])] + [low + half + i for i in _aligned(a[half:], b[j:])]
    rows, j = list(_row(a, _masks(b), (1 << len(b)) - 1)), len(b)
    for i in range(len(a), 0, -1):
        mask = (1 << j) - 1
        if (rows[i] & mask).bit_count() != (rows[i - 1] & mask).bit_count():
            j = (~rows[i] & mask).bit_length() - 1
            found.append(low + i - 1)
    return found


def _key(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.netloc or "").lower(), parts.path + ("?" + parts.query if parts.query else "")
    except ValueError:
        return "", url or ""


def _digest(url: str | None, found: list[Line]) -> str:
    """Host and lines: what makes a page another's copy."""
    lines = (f"{z}{h:d}{t}" if z == ARTICLE else f"{z}{t}" for z, t, h in found)
    return blake2b("\x00".join((_key(url)[0], *lines)).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _order(url: str | None, page_id: object, digest: str) -> str:
    """What pages are sorted by: host, path, and the rest to tell them apart; the digest stands at the end."""
    return "\x00".join((*_key(url), url or "", "" if page_id is None else str(page_id), digest))


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def without_shared(mine: list[str], other: list[str]) -> set[int] | None:
    """Places of ``mine`` that ``other`` shares; None if they are so much of it that ``other`` is a copy."""
    gone = shared_lines(mine, other)
    if sum(len(mine[i]) for i in gone) > COPY * sum(map(len, mine)):
        return None
    return gone


def article_shared(mine: list[Line], other: list[Line]) -> dict[int, bool] | None:
    """Places of ``mine`` in its article that ``other`` shares, and whether it has them at the same place from the start or
    the end of its own; None if ``other`` can't tell, as it has no article or is another version of the page."""
    sides = [([i for i, line in enumerate(mine) if line[0] == zone], [t for z, t, _ in other if z == zone]) for zone in (OUTSIDE, ARTICLE)]
    at, theirs = sides[1]
    if not theirs:
        return None
    gone = {some[k] for some, others in sides for k in shared_lines([mine[i][1] for i in some], others)}
    size, longer = sum(len(mine[i][1]) for some, _ in sides for i in some), sum(len(t) for _, others in sides for t in others)
    if sum(len(mine[i][1]) for i in gone) > min(COPY * size, VERSION * max(size, longer)):
        return None
    shift, out = len(theirs) - len(at), {}
    for k, i in enumerate(at):
        text = mine[i][1]
        placed = theirs[k : k + 1] == [text] or (shift + k >= 0 and theirs[shift + k] == text)
        if placed or i in gone:
            out[i] = placed
    return out


def article_template(mine: list[Line], near: list[list[Line]]) -> set[int]:
    """Places of ``mine`` in its article that are template by all pages of ``near`` that can tell."""
    told: dict[int, int] = {i: 0 for i, (z, _, _) in enumerate(mine) if z == ARTICLE}
    for found in (article_shared(mine, other) for other in near):
        if found is not None:
            told = {i: n + found[i] for i, n in told.items() if i in found}
        if not told:
            break
    return {i for i, n in told.items() if n >= WITNESSES}


def main_text(mine: list[Line], partners: list[list[Line]], near: list[list[Line]]) -> str:
    """The main text of a page of these blocks: template is deleted by differencing, then markup decides on what is left.
    ``partners``: the differing pages next to it, ``near``: those and the ones behind them, both the nearest first."""
    kept = [i for i, (z, _, _) in enumerate(mine) if z == ARTICLE]
    if kept:
        gone = article_template(mine, near)
        kept = [i for i in kept if i not in gone or mine[i][2]] if len(gone) < len(kept) else []
    if not kept:
        outer = [i for i, (z, _, _) in enumerate(mine) if z != ARTICLE]
        found = [mine[i][1] for i in outer]
        shared = (without_shared(found, [t for z, t, _ in other if z != ARTICLE]) for other in partners)
        gone = next((g for g in shared if g is not None), set())
        kept = [i for k, i in enumerate(outer) if mine[i][0] == OUTSIDE and k not in gone]
    return "\n\n".join(mine[i][1] for i in kept)


class _Run:
    """Pages in a row with the same lines; they wait for the pages after the run. ``url``: of the last of them."""

    def __init__(self, first: dict):
        self.first, self.url, self.digest, self.waiting = first["url"], first["url"], first["key"][-24:], []
        self.lines: list[Line] = list(zip(first["zones"], first["lines"], first["headings"], strict=True))

    def texts(self, before: list[_Run], after: list[_Run]) -> Iterator[tuple]:
        """(id, URL, text) of its pages. ``before``, ``after``: the runs on its sides, the next first."""
        seen: dict[tuple, str] = {}
        sides = [(k, i, url, run) for i, side in enumerate((before, after)) for k, run in enumerate(side) for url in (run.first if i else run.url,)]
        for page_id, url in self.waiting:
            host, path = _key(url)
            near = [(-_common(path, _key(u)[1]), k, i, run) for k, i, u, run in sides if host and _key(u)[0] == host]
            near.sort(key=lambda x: x[:3])
            order = tuple(x[1:3] for x in near)
            if order not in seen:
                seen[order] = main_text(self.lines, [x[3].lines for x in near if x[1] == 0], [x[3].lines for x in near])
            yield page_id, url, seen[order]


def _edges(rows: Iterator[str]) -> list[list[str]]:
    """Of sorted orders: the first of each of the first runs, and the last of each of the last runs from the end on; a run
    is of one digest."""
    heads: list[str] = []
    tails: deque[str] = deque(maxlen=REACH + 1)
    for order in rows:
        if tails and tails[0][-24:] == order[-24:]:
            tails[0] = order
            continue
        tails.appendleft(order)
        if len(heads) <= REACH:
            heads.append(order)
    return [heads, list(tails)]


def _guests(edges: list[list[list[str]]]) -> dict[str, list[int]]:
    """The partitions that a page goes to besides its own: it is one of the nearest pages before or after that differ."""
    out: dict[str, list[int]] = {}
    for forward in (True, False):
        seen: list[str] = []  # the nearest page of each of the last runs
        for p in range(len(edges)) if forward else range(len(edges) - 1, -1, -1):
            first, ends = (edges[p][0][0], edges[p][1]) if forward else (edges[p][1][0], edges[p][0])
            same = bool(seen) and seen[0][-24:] == first[-24:]
            for guest in seen[same : same + REACH]:
                if guest.split("\x00", 1)[0] == first.split("\x00", 1)[0]:
                    out.setdefault(guest, []).append(p)
            seen = (ends + seen[same:])[: REACH + 1]
    return out


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each row of ``pages``, empty if there is none.

    A null page is empty; pages without a URL or host are compared with none; rows that repeat keep their rows and have
    the same text; an empty table gives an empty result. Other columns are not read.
    """
    spark = pages.sparkSession
    frame = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    kind = dict(frame.dtypes)["page_id"]
    n = tasks(frame, "html")[0]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(0, batch.num_rows, 200):
                found += [_order(r["url"], r["page_id"], _digest(r["url"], page_lines(r["html"]))) for r in batch.slice(i, 200).to_pylist()]
            yield pa.record_batch([pa.array(found, pa.string())], names=["key"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _edges(x for batch in batches for x in batch.column("key").to_pylist())
        if found[0]:
            yield pa.record_batch([pa.array([found], pa.list_(pa.list_(pa.string())))], names=["edges"])

    dealt = frame.mapInArrow(released(keys), "key string").repartitionByRange(n, "key").sortWithinPartitions("key")
    edges = sorted((r.edges for r in dealt.mapInArrow(ends, "edges array<array<string>>").collect()), key=lambda e: e[0][0])  # ten keys for each partition
    lows, guests = [e[0][0] for e in edges], _guests(edges)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                rows = []
                for r in batch.slice(i, 200).to_pylist():
                    found = page_lines(r["html"])
                    key = _order(r["url"], r["page_id"], _digest(r["url"], found))
                    row = {"key": key, "page_id": r["page_id"], "url": r["url"]}
                    row |= {"zones": [z for z, _, _ in found], "lines": [t for _, t, _ in found], "headings": [h for _, _, h in found]}
                    rows.append({**row, "part": max(0, bisect_right(lows, key) - 1), "guest": False})
                    rows += [{**row, "part": p, "guest": True} for p in guests.get(key, ())]
                yield pa.RecordBatch.from_pylist(rows, schema=parsed_schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        runs: deque[_Run] = deque(maxlen=2 * REACH + 1)

        def settle(at: int) -> None:
            if 0 <= at < len(runs):
                found = list(runs)
                out.extend(found[at].texts(found[:at][::-1][:REACH], found[at + 1 :][:REACH]))
                found[at].waiting = []

        def given(least: int) -> Iterator[pa.RecordBatch]:
            while len(out) >= least:
                ids, urls, texts = zip(*out[:500], strict=True)
                del out[:500]
                yield pa.record_batch([pa.array(ids, id_type), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                for row in batch.slice(i, 200).to_pylist():
                    if not runs or row["key"][-24:] != runs[-1].digest:
                        runs.append(_Run(row))
                        settle(len(runs) - 1 - REACH)
                    runs[-1].url = row["url"]
                    if not row["guest"]:
                        runs[-1].waiting.append((row["page_id"], row["url"]))
                    yield from given(500)
        for at in range(len(runs) - REACH, len(runs)):
            settle(at)
        yield from given(1)

    schema = f"part int, guest boolean, key string, page_id {kind}, url string, zones array<tinyint>, lines array<string>, headings array<boolean>"
    parsed_schema = to_arrow_schema(spark.createDataFrame([], schema).schema)
    id_type = parsed_schema.field("page_id").type
    parsed = frame.mapInArrow(released(read), schema).repartitionById(max(1, len(lows)), F.col("part"))
    ordered = parsed.sortWithinPartitions("part", "key", "guest").drop("part")
    return ordered.mapInArrow(released(stream), f"page_id {kind}, url string, text string, n_chars long")
