"""Main text of web pages by differencing against the page with the nearest URL.

Within a host the distinct pages are put in order of URL path, and each is paired with the neighbour whose path has
more in common with its own. The lines (text blocks) of both are aligned by longest common subsequence, and shared
lines go. Markup qualifies that in both directions: lines of an article element that both pages have are protected, as
pages that quote each other are common, and lines that only one page has still go where markup says that they are a
menu, header, footer, sidebar, notice, advert, form or comment.

Pages are paired by hashes of their lines, so only those are sorted, and a page at the edge of a task's range gets its
neighbour from the next range by a join over the ranges' edges: how rows are dealt to tasks changes nothing.
"""

from __future__ import annotations

import html
import re
from collections import deque
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text_batches import record_batch, slices
from tidemark.operators.indexing import starts_of_tasks
from tidemark.sources.scratch import written

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
# HTML elements and the words by which sites name parts of a page.
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
OPAQUE = set("script style title noscript template textarea select option button svg iframe object canvas audio video math".split())
AROUND = set("nav footer aside form menu dialog head".split())
CONTENT = set("article main".split())
PARTS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended comments comment commentlist reply replies respond disqus contentinfo complementary".split())
#: Names that inside an article stand for its own parts.
OWN = {"header"}
#: A line outside an article is a menu line if at least this share of its characters is in links.
LINKED = 0.5


class Line(NamedTuple):
    """A text block of a page. article: inside an article element; linked: the share of its characters that is in links;
    ruled_out: markup names it as a part that isn't the page's text."""

    text: str
    article: bool
    linked: float
    ruled_out: bool


def blocks_of(page: str) -> list[Line]:
    """The text blocks of a page in order."""
    out: list[Line] = []
    parts: list[str] = []
    state = {"linked": 0, "link": 0}
    stack: list[tuple[str, bool, bool]] = []  # element, ruled out, inside an article

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                _, ruled_out, article = stack[-1] if stack else ("", False, False)
                out.append(Line(text, article, min(1.0, state["linked"] / len(text)), ruled_out))
            parts.clear()
        state["linked"] = 0

    at, skip = 0, ""
    for tag in _TAG.finditer(page):
        if tag.start() < at:
            continue
        name = (tag[2] or "").lower()
        if skip:
            if name == skip and tag[1]:
                skip, at = "", tag.end()
            continue
        if tag.start() > at:
            text = page[at : tag.start()]
            parts.append(text)
            if state["link"]:
                state["linked"] += len(text)
        at = tag.end()
        if not name:
            continue
        if name in OPAQUE:
            if not tag[1] and not tag[3].rstrip().endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page) if name in ("script", "style") else at
            parts.append(" ")
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            state["link"] = 0 if tag[1] else 1
        elif name in BLOCKS:
            close()
            state["link"] = 0
            if tag[1]:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if depth is not None:
                    del stack[depth:]
            elif name in AROUND or name in CONTENT or name in ("div", "section", "header", "ul", "ol", "table", "body", "p", "li"):
                if name == "body":
                    stack.clear()
                elif name in ("p", "li"):
                    named = "=" in tag[3] and _parts(tag[3], bool(stack and stack[-1][2]))
                    if stack and stack[-1][0] == name:
                        stack.pop()
                    if not named:
                        continue
                    stack.append((name, True, bool(stack and stack[-1][2])))
                    continue
                out_of, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                if name in CONTENT:
                    stack.append((name, _parts(tag[3]), True))  # an article opens even where a part before it was left open
                else:
                    header = name == "header" and not inside
                    stack.append((name, out_of or name in AROUND or header or _parts(tag[3], inside), inside))
    if not skip and at < len(page):
        rest = page[at:]
        parts.append(rest[: rest.find("<")] if re.search(r"<[a-zA-Z/!]", rest) else rest)
    close()
    return out


def _parts(attributes: str, inside: bool = False) -> bool:
    """Whether class, id or role names a part of a page that isn't its text."""
    return any(w in PARTS and not (inside and w in OWN) for value in _NAMES.findall(attributes) for w in re.split(r"[^a-z0-9]+", value.lower()))


def shared_lines(a: list, b: list) -> list[int]:
    """The positions in a of a longest common subsequence with b, in order.

    Equal ends and lines that only one has are set aside first; what is left is halved again and again (Hirschberg's
    way) over rows of the length table that are kept as bits, so memory stays in proportion to the lines.
    """
    both = set(a) & set(b)
    if not both:
        return []
    lead, most = 0, min(len(a), len(b))
    while lead < most and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < most - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    at = [i for i in range(lead, len(a) - tail) if a[i] in both]
    middle = _common([a[i] for i in at], [t for t in b[lead : len(b) - tail] if t in both])
    return [*range(lead), *(at[i] for i in middle), *range(len(a) - tail, len(a))]


def _common(a: list, b: list) -> list[int]:
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, u, v = todo.pop()
        if i == j or u == v:
            continue
        if j - i == 1:
            if a[i] in b[u:v]:
                found.append(i)
            continue
        mid = (i + j) // 2
        ahead = _lengths(a[i:mid], b[u:v])
        behind = _lengths(a[mid:j][::-1], b[u:v][::-1])[::-1]
        cut = u + int(np.argmax(ahead + behind))
        todo += [(i, mid, u, cut), (mid, j, cut, v)]
    return sorted(found)


def _lengths(a: list, b: list) -> np.ndarray:
    """How long a longest common subsequence of a with the first k of b is, for k from 0. Bit k of `row` is 0 where it
    is one longer with b[k]."""
    places: dict = {}
    for k, t in enumerate(b):
        places.setdefault(t, []).append(k)
    masks = {t: sum(1 << k for k in p) for t, p in places.items() if len(p) > 64}  # few lines stand that often
    full = (1 << len(b)) - 1
    row = full
    for t in a:
        if t in places:
            hit = row & (masks[t] if t in masks else sum(1 << k for k in places[t]))
            row = (row + hit | row - hit) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def main_lines(lines: list[Line], shared: set[int]) -> list[int]:
    """Which lines are the page's text, given those that the nearest page has as well.

    In a page that marks an article: its lines, shared or not. Else the lines that aren't shared. Lines that markup
    rules out never are; nor are link lines outside an article, as menus differ from page to page too.
    """
    marked = any(x.article and not x.ruled_out for x in lines)
    return [i for i, x in enumerate(lines) if not x.ruled_out and (x.article if marked else i not in shared and x.linked < LINKED)]


def _hashes(lines: list[Line]) -> bytes:
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(x.text) for x in lines), np.uint64, len(lines)).tobytes()


def extract_text(pages: DataFrame, host: Column, path: Column, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_lines, n_shared, n_protected for every row of pages.

    n_lines counts all text blocks, n_shared those that the page with the nearest URL has as well, n_protected the
    shared ones that stay because an article element holds them. Null or empty html gives an empty text. Pages without
    a host, and the only page of a host, are paired with nothing, so of these only markup decides. Pages of a host with
    the same lines count as one page, so copies never delete each other; repeated rows, null ids and null urls stay.
    Other columns are left out. Very long pages are handled whole, in memory in proportion to the page. An empty table
    gives an empty result.
    """
    named = pages.select(host.alias("h"), path.alias("p"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    shared = _shared(named)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_lines", pa.int64()), ("n_shared", pa.int64()), ("n_protected", pa.int64())])

    def run(batches):
        for batch in slices(batches):
            texts, lines, both, kept = [], [], [], []
            for page, common in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                own, common = blocks_of(page or ""), set(common or ())
                main = main_lines(own, common)
                texts.append("\n".join(own[i].text for i in main))
                lines.append(len(own))
                both.append(len(common))
                kept.append(sum(i in common for i in main))
            yield record_batch(schema, [batch.column(0), batch.column(1), texts, [len(t) for t in texts], lines, both, kept])

    keyed = named.withColumn("page", _page_key())
    joined = keyed.join(shared, ["h", "page"], "left").select("page_id", "url", "html", "common")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_lines long, n_shared long, n_protected long")


def _page_key() -> Column:
    return F.unhex(F.md5("html"))


def _shared(named: DataFrame) -> DataFrame:
    """(h, page, common): the positions of the lines that the page with the nearest URL has, of pages that share any."""
    schema = pa.schema([("h", pa.string()), ("p", pa.string()), ("page", pa.binary()), ("lines", pa.binary())])

    def lines_of(batches):
        for batch in slices(batches):
            yield record_batch(schema, [*batch.columns[:3], [_hashes(blocks_of(page)) for page in batch.column(3).to_pylist()]])

    with_host = named.where("h <> '' and html <> ''").select("h", "p", _page_key().alias("page"), "html")
    lines = with_host.mapInArrow(lines_of, "h string, p string, page binary, lines binary").where("octet_length(lines) > 0")
    lines = written(lines.withColumn("content", F.unhex(F.md5("lines"))), "page-lines")
    distinct = lines.groupBy("h", "content").agg(F.min("p").alias("p"), F.any_value("lines").alias("lines"))
    pages = lines.select("h", "page", "content").distinct()
    return pages.join(_compared(distinct), ["h", "content"]).select("h", "page", "common")


def common_with_nearest(before: tuple | None, row: tuple, after: tuple | None) -> list[int]:
    """Rows are (host, path, content, hashes of lines). The neighbour of the same host with more of the path in common
    counts; of two with the same, the one before."""

    def alike(other: tuple) -> int:
        return next((k for k, (x, y) in enumerate(zip(other[1], row[1])) if x != y), min(len(other[1]), len(row[1])))

    near = [x for x in (before, after) if x is not None and x[0] == row[0]]
    if not near:
        return []
    own, other = (np.frombuffer(x[3], np.uint64).tolist() for x in (row, max(near, key=alike)))
    return shared_lines(own, other)


def _compared(distinct: DataFrame) -> DataFrame:
    """(h, content, common) of the rows (h, p, content, lines) that share lines with their neighbour."""
    order = ["h", "p", "content"]
    columns = "task int, at long, edge boolean, h string, p string, content binary, lines binary, common array<int>"
    schema = pa.schema([("task", pa.int32()), ("at", pa.int64()), ("edge", pa.bool_()), ("h", pa.string()), ("p", pa.string()), ("content", pa.binary()), ("lines", pa.binary()), ("common", pa.list_(pa.int32()))])

    def compare(batches):
        """Compares what has both neighbours in the task; the first and last two rows keep their lines for the edges."""
        from pyspark import TaskContext

        task, at, before, waiting, done = TaskContext.get().partitionId(), 0, None, deque(), []

        def answer(ending: bool) -> None:
            nonlocal at, before
            row, after = waiting.popleft(), waiting[0] if waiting else None
            edge = before is None or after is None
            near_edge = at < 2 or ending and len(waiting) < 2
            done.append((task, at, edge, *row[:3], row[3] if near_edge else None, None if edge else common_with_nearest(before, row, after)))
            before, at = row, at + 1

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                waiting.append(row)
                if len(waiting) == 4:
                    answer(False)
            if done:
                yield record_batch(schema, [list(c) for c in zip(*done)])
                done.clear()
        while waiting:
            answer(True)
        if done:
            yield record_batch(schema, [list(c) for c in zip(*done)])

    dealt = distinct.select(*order, "lines").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(dealt.mapInArrow(compare, columns), "compared-pages")
    ends = placed.where("lines is not null").join(F.broadcast(starts_of_tasks(placed)), "task")  # one row a task
    ends = ends.select((F.col("before") + F.col("at")).alias("place"), "edge", *order, "lines")
    row, before, after = (ends.select(F.col("place").alias("place"), F.struct(*order, "lines").alias(c), *(["edge"] if c == "row" else [])) for c in ("row", "before", "after"))
    before, after = before.withColumn("place", F.col("place") + 1), after.withColumn("place", F.col("place") - 1)
    edges = row.where("edge").join(before, "place", "left").join(after, "place", "left").select("before", "row", "after")
    found = pa.schema([("h", pa.string()), ("content", pa.binary()), ("common", pa.list_(pa.int32()))])

    def across(batches):
        for batch in batches:
            out = []
            for three in zip(*(c.to_pylist() for c in batch.columns)):
                before, row, after = (x and (x["h"], x["p"], x["content"], x["lines"]) for x in three)
                out.append((row[0], row[2], common_with_nearest(before, row, after)))
            yield record_batch(found, [list(c) for c in zip(*out)] if out else [[], [], []])

    inside = placed.where("not edge").select("h", "content", "common")
    return inside.union(edges.mapInArrow(across, "h string, content binary, common array<int>")).where("size(common) > 0")
