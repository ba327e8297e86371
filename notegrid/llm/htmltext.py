"""Operator 4: main text of web pages by nearest-URL page differencing.

Pages of a host are paired with their neighbours by URL path, their text lines
aligned by longest common subsequence, and shared lines deleted. Two rules on
markup correct what differencing alone gets wrong: lines of an article stay
although a neighbour shares them (articles quote each other), and lines in
menus, headers, footers, adverts and the like go although no neighbour does.
Differencing decides all other lines: those outside both, and those of an
article in an element whose class or id reads like an advert or a comment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.llm.arrow import blocks, strings
from notegrid.llm.common import running_total, small, stage

#: Zones of a line. Differencing decides those that are free or doubtful.
FREE, MAIN, ASIDE, DOUBT = 0, 1, 2, 3
#: Pages of a host that are aligned in one task, besides the first page of the next ones.
CHUNK = 64

_BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_ASIDES = frozenset("nav header footer aside form menu dialog button select textarea iframe noscript template svg head title script style object canvas audio video".split())
_MAINS = frozenset(("article", "main"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HINT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|popup|modal|overlay|newsletter|subscribe|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|header|masthead|comments?|respond|disqus|share|sharing|social|related|recommended|widget|pagination|pager|toolbar|login|signup|search)(?=$|[\s_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())


#: What may stand in a head; anything else ends one that is not closed (fixed values).
_HEAD = frozenset("head title meta link style script base noscript template".split())
#: Elements that a next one of the same group ends where their end tag is left out (fixed values).
_ENDS = {t: frozenset(g.split()) for g in ("li", "dt dd", "tr", "td th", "option") for t in g.split()}
_LISTS = frozenset(("ul", "ol", "dl", "table", "select"))


class _Reader(HTMLParser):
    """Collects (zone, text) blocks in page order. End tags that a page may
    leave out are implied: of a head, a paragraph, an item or a cell."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[int, str]] = []
        self.held: list[str] = []
        self.open: list[tuple[str, int]] = []  # elements that set a zone
        self.depth: list[int] = []  # plain elements of the same name within
        self.lists: list[int] = []  # lists and tables open within

    def zone(self) -> int:
        zones = [z for _, z in self.open]
        return ASIDE if ASIDE in zones else DOUBT if DOUBT in zones else MAIN if zones else FREE

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.blocks.append((self.zone(), text))
        self.held = []

    def cut(self, k: int) -> None:
        self.flush()
        del self.open[k:], self.depth[k:], self.lists[k:]

    def implied(self, tag: str) -> None:
        """Close what the start of ``tag`` ends."""
        if self.open and self.open[0][0] == "head" and tag not in _HEAD:
            self.cut(0)
        if self.open and self.open[-1][0] == "p" and tag in _BLOCKS:
            self.cut(len(self.open) - 1)
        if self.open and tag in _ENDS.get(self.open[-1][0], ()) and not self.lists[-1]:
            self.cut(len(self.open) - 1)

    def handle_starttag(self, tag, attrs):
        self.implied(tag)
        if tag in _BLOCKS or tag in _ASIDES:
            self.flush()
        elif tag == "br":
            self.held.append(" ")
        if tag in _VOID:
            return
        if tag in _LISTS and self.open:
            self.lists[-1] += 1
        given = dict(attrs)
        names = f"{given.get('class') or ''} {given.get('id') or ''}"
        inside = MAIN in [z for _, z in self.open]
        quoted = "article" in [t for t, _ in self.open]
        role = (given.get("role") or "").lower()
        plain = "hidden" in given or (given.get("aria-hidden") or "").lower() == "true" or role in _ROLES
        hinted = tag not in ("body", "html") and bool(_HINT.search(names))
        if plain or (tag in _ASIDES and not (tag == "header" and inside)) or (hinted and not quoted):
            self.push(tag, ASIDE)
        elif hinted:
            self.push(tag, DOUBT)
        elif tag in _MAINS or role == "main":
            self.push(tag, MAIN)
        elif self.open and self.open[-1][0] == tag:
            self.depth[-1] += 1

    def push(self, tag: str, zone: int) -> None:
        self.flush()
        self.open.append((tag, zone))
        self.depth.append(0)
        self.lists.append(0)

    def handle_endtag(self, tag):
        if tag in _BLOCKS or tag in _ASIDES:
            self.flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if self.depth[k]:
                    self.depth[k] -= 1
                else:
                    self.cut(k)
                break
        if tag in _LISTS and self.lists and self.lists[-1]:
            self.lists[-1] -= 1

    def handle_data(self, data):
        if len(self.open) == 1 and self.open[0][0] == "head" and data.strip():
            self.cut(0)
        self.held.append(data)

    def handle_startendtag(self, tag, attrs):
        self.implied(tag)
        if tag in _BLOCKS:
            self.flush()
        elif tag == "br":
            self.held.append(" ")


def page_blocks(html: str) -> list[tuple[int, str]]:
    """(zone, text) of each block: white space is one space, references decoded."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.blocks


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of a longest common subsequence of b with each prefix of a, by
    one row of bits: a zero where a longer prefix gains a line."""
    where: dict[int, int] = {}
    for k, line in enumerate(a):
        where[line] = where.get(line, 0) | 1 << k
    every = state = (1 << len(a)) - 1
    for line in b:
        hit = state & where.get(line, 0)
        state = (state + hit | state - hit) & every
    bits = np.unpackbits(np.frombuffer(state.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(a)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence in memory that grows with the
    lines, not their product: b is halved, and a split where both halves share
    most, first on ties. Lines that the other page lacks are left out before."""
    both = set(a) & set(b)
    left, right = ([k for k, x in enumerate(lines) if x in both] for lines in (a, b))
    todo, out = [(0, len(left), 0, len(right))], []
    while todo:
        i, j, p, q = todo.pop()
        if i == j or p == q:
            continue
        own = [a[left[k]] for k in range(i, j)]
        if q - p == 1:
            line = b[right[p]]
            if line in own:
                out.append((left[i + own.index(line)], right[p]))
            continue
        middle = (p + q) // 2
        first = _lengths(own, [b[right[k]] for k in range(p, middle)])
        last = _lengths(own[::-1], [b[right[k]] for k in range(q - 1, middle - 1, -1)])[::-1]
        cut = i + int((first + last).argmax())
        todo += [(i, cut, p, middle), (cut, j, middle, q)]
    return sorted(out)


def _hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "replace")) - (1 << 63)


def outcome(blocks: list[tuple[int, str]]) -> tuple[str | None, list[tuple[int, str]]]:
    """The text of a page that differencing cannot change, or null and the
    lines (place, text) that may stay, of which :func:`unsure` ones may go."""
    article = any(z == MAIN for z, _ in blocks)
    may = [(k, x) for k, (z, x) in enumerate(blocks) if z == MAIN or z == DOUBT or (z == FREE and not article)]
    if any(unsure(blocks[k][0], article) for k, _ in may):
        return None, may
    return "\n\n".join(x for _, x in may), []


def unsure(zone: int, article: bool) -> bool:
    """Whether a line's fate hangs on its neighbours."""
    return zone == DOUBT or (zone == FREE and not article)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with the zones and hashes of their lines, and their outcome."""
    line = pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string())]))
    for batch in batches:
        for block in blocks([batch], "html"):
            found = [page_blocks(t) for t in strings(block.column(2))]
            ends = [outcome(b) for b in found]
            yield pa.RecordBatch.from_arrays([
                block.column(0), block.column(1), pa.array([[z for z, _ in b] for b in found], pa.list_(pa.int8())), pa.array([[_hash(x) for _, x in b] for b in found], pa.list_(pa.int64())),
                pa.array([t for t, _ in ends], pa.string()), pa.array([[{"at": k, "text": x} for k, x in may] for _, may in ends], line)], names=["page_id", "url", "zones", "hashes", "text", "lines"])


def parsed(pages: DataFrame, html: str, url: str, page_id: str) -> DataFrame:
    """One staged row a page: _ng_row, page_id, url, zones and hashes of its
    lines, text (null while undecided) and the undecided lines. Pages are parsed once."""
    slim = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    out = slim.mapInArrow(_parsed, f"page_id {dict(slim.dtypes)['page_id']}, url string, zones array<tinyint>, hashes array<bigint>, text string, lines array<struct<at: int, text: string>>")
    return stage(out.withColumn("_ng_row", F.monotonically_increasing_id()), "html-pages", "zstd")


def _shared(every: bool):
    """For pages sorted by host, chunk and place: the lines that a page shares
    with the one before or after in its chunk; of those that are sure, only if ``every``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = None, None
        for batch in batches:
            out = []
            for name, row, zones, hashes in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                article = MAIN in zones
                own = (row, hashes, [every or unsure(z, article) for z in zones])
                if name == key:
                    for i, j in common_lines(held[1], hashes):
                        out += [(r, k) for (r, _, told), k in ((held, i), (own, j)) if told[k]]
                held, key = own, name
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32())], names=["_ng_of", "line"])

    return run


def shared_lines(rows: DataFrame, every: bool = False) -> DataFrame:
    """(_ng_of, shared): for each page that shares lines with a neighbour, their
    places. Neighbours are the pages before and after by path within the host.
    A host is dealt in chunks of CHUNK pages, each with the first page of the
    next, so that a hot host spreads over tasks and no pair is lost. Only hashes
    of lines move."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    thin = rows.select("_ng_row", "page_id", F.coalesce(host, F.lit("")).alias("_ng_host"), F.coalesce(path, F.lit("")).alias("_ng_path"), F.lit(1).cast("long").alias("_ng_one"), F.xxhash64("url", "hashes").alias("_ng_tie"), "zones", "hashes")
    placed = running_total(thin, ["_ng_host"], ["_ng_path", "page_id", "_ng_tie", "_ng_row"], "_ng_one", "_ng_upto", "html-order")
    placed = placed.withColumn("_ng_place", F.col("_ng_upto") - 1)
    chunk = F.floor(F.col("_ng_place") / CHUNK)
    edge = (F.col("_ng_place") > 0) & (F.col("_ng_place") % CHUNK == 0)
    placed = placed.withColumn("_ng_chunk", F.explode(F.when(edge, F.array(chunk - 1, chunk)).otherwise(F.array(chunk))))
    placed = placed.withColumn("_ng_key", F.concat_ws(" ", "_ng_host", F.col("_ng_chunk").cast("string")))
    dealt = placed.repartition("_ng_key").sortWithinPartitions("_ng_key", "_ng_place").select("_ng_key", "_ng_row", "zones", "hashes")
    lines = dealt.mapInArrow(_shared(every), "_ng_of long, line int").distinct()
    return stage(lines.groupBy("_ng_of").agg(F.array_sort(F.collect_list("line")).alias("shared")), "html-shared")


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of undecided pages, without the unsure lines that a neighbour shares."""
    for batch in batches:
        texts = []
        for zones, lines, shared in zip(*[batch.column(k).to_pylist() for k in (2, 3, 4)]):
            article, gone = MAIN in zones, set(shared or ())
            texts.append("\n\n".join(x["text"] for x in lines if x["at"] not in gone or not unsure(zones[x["at"]], article)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame, *, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """A row per row of ``pages``: page_id, url, text, n_chars.

    text is the lines that stay, joined by two line feeds; empty if none do: an
    article's lines but for those in a doubtful element that a neighbour shares;
    without an article, the lines outside boilerplate markup that no neighbour
    shares. Pages are parsed once. All are aligned, by hashes; only undecided
    ones are joined to what their neighbours share, with their texts, never
    with the markup.

    Null html is empty; null urls are pages of one host without a name; pages
    that tie in path are ordered by id, then a digest; repeated rows are
    neighbours (free lines of both go) and keep a row each. Other columns are
    not carried; an empty table gives an empty one.
    """
    rows = parsed(pages, html, url, page_id)
    gone = shared_lines(rows)
    open_ = rows.where("text IS NULL").join(small(gone), F.col("_ng_row") == F.col("_ng_of"), "left").select("page_id", "url", "zones", "lines", "shared")
    done = open_.mapInArrow(_left, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string")
    return rows.where("text IS NOT NULL").select("page_id", "url", "text").unionByName(done).withColumn("n_chars", F.char_length("text").cast("long"))


def difference_report(pages: DataFrame, *, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """A row per row of ``pages``: page_id, url, and by how many lines: n_lines,
    n_shared (a neighbour has them too), n_kept (of these, those that stay as an
    article's) and n_cut (unshared, deleted by markup): what differencing does
    alone, and where markup overrules it. No text is joined."""
    rows = parsed(pages, html, url, page_id)
    gone = shared_lines(rows, every=True)
    both = rows.select("_ng_row", "page_id", "url", "zones").join(small(gone), F.col("_ng_row") == F.col("_ng_of"), "left")
    article = F.array_contains("zones", F.lit(MAIN).cast("tinyint"))
    kept = F.size(F.filter(F.coalesce("shared", F.array().cast("array<int>")), lambda k: F.get("zones", k) == MAIN))
    cut = lambda z: (z == ASIDE) | ((z == FREE) & article)
    sure = F.size(F.filter("zones", cut)) - F.size(F.filter(F.coalesce("shared", F.array().cast("array<int>")), lambda k: cut(F.get("zones", k))))
    return both.select("page_id", "url", F.size("zones").cast("long").alias("n_lines"), F.coalesce(F.size("shared"), F.lit(0)).cast("long").alias("n_shared"), kept.cast("long").alias("n_kept"), sure.cast("long").alias("n_cut"))
