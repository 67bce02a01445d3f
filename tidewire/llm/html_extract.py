"""Main text of web pages: markup into blocks, then differencing against the page with the nearest URL.

Pages are dealt by host and path into key ranges, so that neighbours by URL lie in one task even where one host holds most
pages; the pages that end a range are also sent to other ranges, so every page meets both neighbours. A page's blocks are
aligned with those of the nearer neighbour by longest common subsequence; common ones are menus, notices and the like and
go, wherever they lie. Paragraphs and headings inside an article or main element are exempt: pages may share passages of text.

Copies are no neighbours: of equal pages in a row each is compared with the nearest page, before or after, whose blocks differ.
Nothing goes because of a page that is nearly the same (`NEAR`).
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewire.functions.scalar import bind
from tidewire.llm.common import partitions, slices

# --- fixed values: element names of HTML ---------------------------------------
NO_TEXT = frozenset("script style noscript template svg math canvas iframe object audio video head title select textarea button form "
                    "input nav header footer aside dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 "
                   "h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript template svg math".split())
#: Elements that inside an article hold its own text.
PROSE = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"br", "body", "html"}
#: Words of class and id names that mark what is not the article.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
                  "footer header login masthead menu modal nav navbar navigation newsletter notice popup promo related replies reply share sharing "
                  "sidebar signup social sponsor sponsored subscribe toolbar widget".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog form menu alert".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPACES = re.compile(r"\s+")
#: Two pages of which blocks with so large a share of the longer one's characters are the same are near copies.
NEAR = 0.8


@dataclass
class Block:
    text: str
    article: bool
    prose: bool = False                                 # a paragraph or heading of the article


def is_marked(attributes: str) -> bool:
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id") and any(w in MARKS for w in re.split(r"[^a-z]+", value)):
            return True
        if name == "role" and value in ROLES or name == "aria-hidden" and value == "true":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$|=)", attributes))


def blocks(page: str) -> list[Block]:
    """The blocks of visible text in page order. Unclosed and misnested tags are tolerated, references decoded once."""
    found: list[Block] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []            # name, is left out, is or lies in the article
    at = 0

    def flush() -> None:
        if text:
            line = SPACES.sub(" ", "".join(text)).strip()
            text.clear()
            if line:
                inside = bool(stack) and stack[-1][2]
                found.append(Block(line, inside, inside and any(name in PROSE and i for name, _, i in stack)))

    def close(name: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                del stack[i:]
                return

    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            lt = len(page)
        if lt > at and not (stack and stack[-1][1]):
            text.append(html.unescape(page[at:lt]))
        if lt == len(page):
            break
        tag = TAG.match(page, lt)
        if tag is None:                                  # a bare '<' is text
            if not (stack and stack[-1][1]):
                text.append("<")
            at = lt + 1
            continue
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            flush()
        if tag[1]:
            close(name)
            continue
        if name in CLOSES_P and any(s[0] == "p" for s in stack[-8:]):
            # a block ends an open paragraph, with what was left open inside it
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in BLOCKS:
                    break
        if name == "li" and stack and stack[-1][0] == "li":
            stack.pop()
        if name in VOID or tag[3].endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        out = bool(stack) and stack[-1][1]
        inside = bool(stack) and stack[-1][2]
        # a header inside an article is its head line unless marked; elsewhere it is the site's
        left_out = name in NO_TEXT and not (name == "header" and inside) or is_marked(tag[3]) and name not in ("html", "body", "article", "main")
        stack.append((name, out or left_out, inside or name in ("article", "main") or 'role="main"' in tag[3]))
    flush()
    return found


def common(a: list[bytes], b: list[bytes]) -> set[int]:
    """Places in `a` that lie on a longest common subsequence with `b`, by rows of bits; memory is bounded by halving."""
    start, end = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    found = {*range(start), *range(len(a) - end, len(a))}
    mid_a, mid_b = a[start:len(a) - end], b[start:len(b) - end]
    return found | {start + i for i in _align(mid_a, mid_b)}


def _rows(a: list[bytes], b: list[bytes]) -> Iterator[int]:
    """After each element of `a`: bits at the places of `b` where the common length does not grow."""
    places: dict[bytes, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
        yield row


def _align(a: list[bytes], b: list[bytes], most: int = 1 << 28) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > most and len(a) > 1:
        half = len(a) // 2
        for row_f in _rows(a[:half], b):
            pass
        for row_b in _rows(a[:half - 1:-1], b[::-1]):
            pass
        n = len(b)
        ahead, back = [0], [0]
        for j in range(n):
            ahead.append(ahead[-1] + (~row_f >> j & 1))
            back.append(back[-1] + (~row_b >> j & 1))
        cut = max(range(n + 1), key=lambda j: ahead[j] + back[n - j])
        return _align(a[:half], b[:cut], most) + [half + i for i in _align(a[half:], b[cut:], most)]
    rows = list(_rows(a, b))
    found, j = [], len(b)
    full = (1 << len(b)) - 1
    for i in range(len(a) - 1, -1, -1):
        above = rows[i - 1] if i else full
        # lengths of the prefixes of b: zeros below j
        here = j - (rows[i] & (1 << j) - 1).bit_count()
        if here == 0:
            break
        if j - (above & (1 << j) - 1).bit_count() == here:
            continue
        # element i is matched to the last place where this row gains below j
        gains = ~rows[i] & (1 << j) - 1
        j = gains.bit_length() - 1
        found.append(i)
    return found


def shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Page:
    """The blocks of a page; all but the prose of an article are compared."""

    def __init__(self, host: str, path: str, html: str | None):
        self.host, self.path, self.blocks = host, path, blocks(html or "")
        every = [blake2b(b.text.encode("utf-8", "replace"), digest_size=8).digest() for b in self.blocks]
        self.hashes = [h for h, b in zip(every, self.blocks) if not b.prose]
        self.sign = blake2b(b"".join(h + (b"p" if b.prose else b"-") for h, b in zip(every, self.blocks)), digest_size=16).digest()
        self.sizes = {h: len(b.text) for h, b in zip(every, self.blocks)}
        self.counts = Counter(every)

    def is_near(self, other: Page) -> bool:
        shared = sum(n * self.sizes[h] for h, n in (self.counts & other.counts).items())
        return shared >= NEAR * max(sum(n * p.sizes[h] for h, n in p.counts.items()) for p in (self, other))

    def without(self, other: Page | None) -> str:
        gone = common(self.hashes, other.hashes) if other else set()
        places, kept = count(), []
        for b in self.blocks:
            if b.prose or next(places) not in gone:
                kept.append(b.text)
        return "\n".join(kept)


class Run:
    """Equal pages in a row: their blocks once, and a row for each page that lies in this range."""

    def __init__(self, page: Page):
        self.page, self.first, self.last = page, page.path, page.path
        self.rows: list[tuple] = []                     # key, url, path

    def texts(self, before: Run | None, after: Run | None) -> Iterator[tuple]:
        """(key, url, text) of each row, compared with the nearer of the runs beside it that is no near copy."""
        if not self.rows:
            return
        near = [(r, path) for r, path in ((before, before and before.last), (after, after and after.first))
                if r and r.page.host and r.page.host == self.page.host and not self.page.is_near(r.page)]
        found: dict[int | None, str] = {}
        for key, url, path in self.rows:
            other = max(near, key=lambda x: shared_prefix(x[1], path), default=(None, ""))[0]            # a tie goes to the page before
            if id(other) not in found:
                found[id(other)] = self.page.without(other and other.page)
            yield key, url, found[id(other)]


Place = tuple[str, str, int, int]                       # host, path, mark, content
Ends = tuple[tuple[Place, bytes], tuple[Place, bytes] | None]


def extend(ends: Ends | None, one: tuple[Place, bytes], high: bool) -> Ends:
    """The outermost page, and the outermost of those unlike it; `high` for the end of a range, else its start."""
    if ends is None:
        return one, None
    first, second = ends
    if (one[0] > first[0]) == high and one[0] != first[0]:
        return one, first if first[1] != one[1] else second
    if one[1] != first[1] and (second is None or (one[0] > second[0]) == high):
        return first, one
    return ends


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page; text is '' where a page has none or its html is null.

    Null keys and urls stay null; pages of no host (null or empty url) have no neighbours, nor have those whose neighbours
    are of other hosts, are copies or near copies: they lose no lines to differencing. Pages without text are passed over.
    Rows of one url and key are neighbours in the order of a hash of their html. Other columns are not read. There are as many key ranges as shuffle partitions; neither their number nor their
    borders show in the result.
    """
    n = partitions(pages.sparkSession)
    keyed = bind(pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).cast("string").alias("html")),
                 {"bare": F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://|[?#](?s:.*)$", "")})
    keyed = keyed.select("key", "url", "html", F.lower(F.substring_index("bare", "/", 1)).alias("host"),
                         F.expr("substring(bare, instr(concat(bare, '/'), '/') + 1)").alias("path"), F.xxhash64("key").alias("mark"),
                         F.xxhash64("html").alias("content"))
    narrow = keyed.select("host", "path", "mark")
    # borders of the ranges: at most 50 keys for each, picked by hash
    total = narrow.count()
    share = min(1_000_000, 50_000_000 * n // max(total, 1) + 1)
    sample = sorted(tuple(r) for r in narrow.where(F.pmod(F.xxhash64("mark", "path"), F.lit(1_000_000)) < share).collect())
    borders = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []

    def ends_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, bool], Ends] = {}
        for part in slices(batches, "html"):
            for host, path, mark, content, text in zip(*(part.column(c).to_pylist() for c in ("host", "path", "mark", "content", "html"))):
                page = Page(host, path, text)
                if not page.blocks or not host:
                    continue
                at, one = bisect_right(borders, (host, path, mark)), ((host, path, mark, content), page.sign)
                for high in (False, True):
                    found[at, high] = extend(found.get((at, high)), one, high)
        yield packed(found)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, bool], Ends] = {}
        for b in batches:
            for at, high, host, path, mark, content, sign in zip(*(c.to_pylist() for c in b.columns)):
                found[at, high] = extend(found.get((at, high)), ((host, path, mark, content), sign), high)
        yield packed(found)

    def packed(found: dict[tuple[int, bool], Ends]) -> pa.RecordBatch:
        rows = [(at, high, *place, sign) for (at, high), ends in found.items() for place, sign in filter(None, ends)]
        types = (pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                          ["range", "high", "host", "path", "mark", "content", "sign"])

    end_schema = "range int, high boolean, host string, path string, mark long, content long, sign binary"
    ends = keyed.select("host", "path", "mark", "content", "html").mapInArrow(ends_of, end_schema).repartition(n, "range").mapInArrow(merged, end_schema)
    outer: dict[tuple[int, bool], list[tuple[Place, bytes]]] = {}
    for r in ends.collect():                             # four rows a range
        outer.setdefault((r["range"], r["high"]), []).append(((r["host"], r["path"], r["mark"], r["content"]), bytes(r["sign"])))
    beside: dict[Place, set[int]] = {}
    for high in (True, False):
        # what lies before a range (or after it): the nearest page of all ranges there, and the nearest unlike that one
        so_far: Ends | None = None
        for at in range(len(borders) + 1) if high else range(len(borders), -1, -1):
            for place, _ in filter(None, so_far or ()):
                beside.setdefault(place, set()).add(at)
            for one in outer.get((at, high), ()):
                so_far = extend(so_far, one, high)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, to, home = [], [], []
            for i, row in enumerate(zip(*(b.column(c).to_pylist() for c in ("host", "path", "mark", "content")))):
                at = bisect_right(borders, row[:3])
                for r in (at, *beside.get(row, ())):
                    take.append(i)
                    to.append(r)
                    home.append(r == at)
            t = b.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(to, pa.int32()), pa.array(home, pa.bool_())],
                                             [*b.schema.names, "range", "home"])

    kind = pages.schema[key].dataType.simpleString()
    sent = keyed.mapInArrow(send, f"key {kind}, url string, html string, host string, path string, mark long, content long, range int, home boolean")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for part in slices(batches, "html"):
                yield from part.to_pylist()

        def texts() -> Iterator[tuple]:
            before: Run | None = None
            here: Run | None = None
            at = None
            for row in rows():
                if row["range"] != at:
                    if here:
                        yield from here.texts(before, None)
                    at, before, here = row["range"], None, None
                page = Page(row["host"], row["path"], row.pop("html"))
                if not page.blocks or not page.host:
                    if row["home"]:
                        yield row["key"], row["url"], page.without(None)
                    continue
                if here is None or (page.host, page.sign) != (here.page.host, here.page.sign):
                    new = Run(page)
                    if here:
                        yield from here.texts(before, new)
                    before, here = here, new
                here.last = page.path
                if row["home"]:
                    here.rows.append((row["key"], row["url"], page.path))
            if here:
                yield from here.texts(before, None)

        def emit(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _, _ in done], key_type), pa.array([u for _, u, _ in done], pa.string()),
                 pa.array([t.encode("utf-8", "replace").decode() for _, _, t in done], pa.string()), pa.array([len(t) for _, _, t in done], pa.int64())],
                ["key", "url", "text", "n_chars"])

        done: list[tuple] = []
        size = 0
        for row in texts():
            done.append(row)
            size += len(row[2])
            if len(done) >= 500 or size > 4_000_000:
                yield emit(done)
                done, size = [], 0
        if done:
            yield emit(done)

    key_type = to_arrow_type(pages.schema[key].dataType)
    found = (sent.repartition(n, "range").sortWithinPartitions("range", "host", "path", "mark", "content")
             .mapInArrow(extract, f"key {kind}, url string, text string, n_chars long"))
    return found.select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")
