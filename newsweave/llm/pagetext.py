"""Main text of web pages, by differencing pages with near URLs of one host."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Pages in one range of the order by host and path, and the most ranges.
RANGE_PAGES = 2_000
MOST_RANGES = 65_536
_SAMPLED = 4
# Bits of a table of two pages' lines beyond which the longer one is halved.
TABLE_BITS = 1 << 26

# Element names and words in class, id and role attributes.
_RAW = "script|style|noscript|template|iframe|svg|textarea|select|object|canvas|math"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset((
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img picture").split())
_CONTAINERS = frozenset((
    "html head body nav header footer aside form dialog div section article main ul ol dl table thead tbody tfoot tr figure "
    "details fieldset menu center").split())
_NEVER = frozenset("head nav aside form footer dialog button menu".split())
_BOILERPLATE = frozenset((
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside notice cookie cookies consent gdpr banner advert adverts "
    "advertisement advertising ad ads adsense adbox promo promotion sponsor sponsored comment comments disqus share sharing "
    "social related recommended newsletter subscribe subscription popup modal login signup form search complementary "
    "contentinfo footer copyright pagination pager toolbar widget alert").split())
_HEADS = frozenset("header masthead topbar".split())
_MAIN = frozenset("article main content post entry story".split())

# What follows a tag's name. It reaches over no next tag, and what it took it never gives back.
_REST = r"(?:[^\"'<>]++|\"[^\"]*+\"|'[^']*+')*+"
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b{_REST}>.*?(?:</(?P=raw)\s*+>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>{_REST})>|<[!?][^<>]*+>", re.S | re.I)
_NAMED = re.compile(r"\b(class|id|role|style|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Line:
    """A block of text: whether it stands in an article or main element (2) or in a part
    that is called so (1), and in a part that is none by its markup."""

    text: str
    inside: int
    apart: bool


def _marks(name: str, rest: str) -> tuple[bool, bool, int]:
    """Whether an element is boilerplate by name or attributes, a page head, or an
    article: 2 as an element, 1 by what it is called."""
    words: set[str] = set()
    hidden = False
    if rest:
        for key, *values in _NAMED.findall(rest):
            value = next((v for v in values if v), "").lower()
            if key.lower() == "style":
                hidden |= bool(_HIDDEN.search(value))
            elif key.lower() == "aria-hidden":
                hidden |= value == "true"
            else:
                words.update(_PARTS.findall(value))
        hidden |= bool(re.search(r"\shidden(?=[\s/=]|$)", rest, re.I)) and "aria-hidden" not in rest.lower()
    apart = name in _NEVER or hidden or bool(words & _BOILERPLATE) and name not in ("body", "html")
    return apart, name == "header" or bool(words & _HEADS), 2 if name in ("article", "main") else int(bool(words & _MAIN))


def lines_of(page: str) -> list[Line]:
    """The blocks of a page in order, with character references decoded and white
    space turned into single blanks; blocks without text are left out."""
    found: list[Line] = []
    # (name, apart, inside) of the open containers; outside all, nothing is known.
    stack: list[tuple[str, bool, int]] = []
    opened: Counter[str] = Counter()
    held: list[str] = []
    block_apart = False
    inline_apart: list[str] = []

    def close() -> None:
        nonlocal block_apart
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            top = stack[-1] if stack else ("", False, 0)
            found.append(Line(text, top[2], top[1] or block_apart))
        block_apart = False
        inline_apart.clear()

    at = 0
    for tag in _TAG.finditer(page):
        if not inline_apart:
            held.append(page[at : tag.start()])
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            continue
        if name == "br":
            held.append(" ")
        elif name in _INLINE:
            if tag["end"]:
                if inline_apart and inline_apart[-1] == name:
                    inline_apart.pop()
            elif inline_apart:
                inline_apart.append(name)
            elif tag["rest"] and name not in _VOID and _marks(name, tag["rest"])[0]:
                inline_apart.append(name)
        elif name in _CONTAINERS:
            close()
            if tag["end"]:
                while opened[name]:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == name:
                        break
            else:
                if name == "body" and opened["head"]:
                    stack[:] = [s for s in stack if s[0] != "head"]
                    opened["head"] = 0
                apart, head, main = _marks(name, tag["rest"])
                outer = stack[-1] if stack else ("", False, 0)
                apart = outer[1] or apart or (head and not outer[2])
                stack.append((name, apart, outer[2] if apart else max(outer[2], main)))
                opened[name] += 1
        else:
            # A block that ends where the next one starts.
            close()
            if not tag["end"] and name not in _VOID:
                block_apart = name in _NEVER or bool(tag["rest"]) and _marks(name, tag["rest"])[0]
    if not inline_apart:
        held.append(page[at:])
    close()
    return found


def _steps(a: list[str], b: list[str]) -> Iterator[int]:
    """A row of bits after each line of ``a``, one bit for each line of ``b``. A bit is 0
    where the length of the longest common subsequence goes up by one."""
    places: dict[str, int] = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    yield row
    for line in a:
        hit = row & places.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """How long the common subsequence of ``a`` with each beginning of ``b`` is."""
    row = 0
    for row in _steps(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def common_lines(a: list[str], b: list[str]) -> tuple[set[int], set[int]]:
    """Places of a longest common subsequence in both lists. Up to TABLE_BITS the rows
    of all steps are held; beyond it the first list is halved where the lengths from
    both sides add up to the most, so that memory grows with the lines only."""
    left, right = set(), set()
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        i0, i1, j0, j1 = open_.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            left.add(i0)
            right.add(j0)
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            left.add(i1)
            right.add(j1)
        if i0 == i1 or j0 == j1:
            continue
        if (i1 - i0) * (j1 - j0) > TABLE_BITS and i1 - i0 > 1:
            half = (i0 + i1) // 2
            ahead, behind = _lengths(a[i0:half], b[j0:j1]), _lengths(a[half:i1][::-1], b[j0:j1][::-1])[::-1]
            cut = j0 + int((ahead + behind).argmax())
            open_ += [(i0, half, j0, cut), (half, i1, cut, j1)]
            continue
        rows = list(_steps(a[i0:i1], b[j0:j1]))
        i, j = i1 - i0, j1 - j0
        while i and j:
            below = (1 << j) - 1
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif (~rows[i] & below).bit_count() == (~rows[i - 1] & below).bit_count():
                i -= 1
            else:
                left.add(i0 + i - 1)
                right.add(j0 + j - 1)
                i, j = i - 1, j - 1
    return left, right


def main_text(lines: list[Line], shared: set[int]) -> str:
    """The lines that stay. Lines shared with a near page go, unless they stand in an
    article or main element: an article may quote what another one says. Of the rest,
    what the markup names as no article goes; where a page has such an element only
    that stays, else where a part is called so only that."""
    kept = [x for i, x in enumerate(lines) if (x.inside == 2 or i not in shared) and not x.apart]
    most = max((x.inside for x in kept), default=0)
    return "\n\n".join(x.text for x in kept if x.inside == most)


@dataclass
class _Page:
    """Pages with the same lines: their (page_id, url), and which lines others share."""

    names: list[tuple]
    lines: list[Line]
    shared: set[int]

    def compare(self, other: _Page) -> None:
        self.shared.update(common_lines([x.text for x in self.lines], [x.text for x in other.lines])[0])

    def rows(self) -> Iterator[tuple]:
        text = main_text(self.lines, self.shared)
        return ((*name, text) for name in self.names)


def _texts(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(page_id, url, text) from rows (range, host, path, page_id, url, html, border) in
    order. Pages in a row that have the same main text by their markup alone are
    copies, which tell nothing about what belongs to the site: each page is compared
    with the page before its run of copies and the page after it, of the same host and
    range. ``border`` pages are another range's. Pages of a run with equal lines are held once."""
    run: dict[tuple, _Page] = {}
    main, place, before, last = None, None, None, None

    def ended(after: _Page | None) -> Iterator[tuple]:
        for page in run.values():
            if after is not None and page.names:
                page.compare(after)
            yield from page.rows()

    for row in rows:
        lines = lines_of(row[5] or "")
        now = _Page([] if row[6] else [(row[3], row[4])], lines, set())
        own_main, own_place = main_text(lines, set()), (row[0], row[1])
        if own_place != place or own_main != main:
            same = own_place == place
            yield from ended(now if same else None)
            before = last if same else None
            run, main, place = {}, own_main, own_place
        key = tuple((x.text, x.inside, x.apart) for x in lines)
        if key in run:
            run[key].names += now.names
        else:
            run[key] = now
            if before is not None and now.names:
                now.compare(before)
        last = run[key]
    yield from ended(None)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)


def _order(df: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return df.withColumn("_host", _host(url)).withColumn("_path", _path(url)).withColumn(
        "_key", F.concat_ws("\x01", "_host", "_path", F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0")))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) per row of ``pages`` (page_id, url, html).

    Pages are put in the order of host, path and page_id, cut into ranges of about
    RANGE_PAGES at keys that depend on the data alone, so that a host with a third
    of all pages fills many ranges, and streamed in order: a task holds a page and
    what its copies don't have in common. Each range also gets the last page before
    it and the first one after it. Neighbours of one host are compared line by line.
    Pages of a null url share one nameless host; a null or empty html has an empty
    text. Rows that repeat are copies, and get the same text.
    """
    pages = _order(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")))
    spark = pages.sparkSession
    ranges = int(min(MOST_RANGES, -(-pages.count() // RANGE_PAGES)))
    # The keys with the least hashes are a fair sample, and the same in every run.
    sample = sorted(r[0] for r in pages.select("_key").orderBy(F.xxhash64("_key"), "_key").limit(ranges * _SAMPLED).collect())
    cuts = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    shared = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bisect_right(shared.value, k))

    ranged = pages.withColumn("_range", range_of("_key"))
    # One row for each range. The page at an end of a range goes to the next one too.
    ends = ranged.groupBy("_range").agg(F.min("_key").alias("first"), F.max("_key").alias("last")).orderBy("_range").collect()
    onward = {(r["_range"], r["last"]): after["_range"] for r, after in zip(ends, ends[1:])}
    back = {(r["_range"], r["first"]): ahead["_range"] for ahead, r in zip(ends, ends[1:])}
    borders = spark.sparkContext.broadcast((onward, back))

    @F.pandas_udf("array<int>")
    def ranges_of(places: pd.Series, keys: pd.Series) -> pd.Series:
        onward, back = borders.value
        return pd.Series([[p, *(side[p, k] for side in (onward, back) if (p, k) in side)] for p, k in zip(places, keys)])

    placed = ranged.select("_range", F.explode(ranges_of("_range", "_key")).alias("_place"), "_host", "_path", "page_id", "url", "html").select(
        F.col("_place").alias("_range"), "_host", "_path", "page_id", "url", "html", (F.col("_place") != F.col("_range")).alias("_border"))

    def run(batches):
        rows = (row for b in batches for row in zip(*(b.column(i) for i in range(b.num_columns))))
        held = []
        for found in _texts(tuple(v.as_py() for v in row) for row in rows):
            held.append(found)
            if len(held) == 500:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    # Several times as many partitions as ranges, so that few of them hold two.
    ordered = placed.repartition(min(4 * max(ranges, 1), MOST_RANGES), "_range").sortWithinPartitions("_range", "_host", "_path", "page_id", "url", F.xxhash64("html"))
    return ordered.mapInArrow(run, "page_id long, url string, text string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["page_id", "url", "text"])
