r"""Operator 6: main text of web pages by nearest-URL page differencing, with structure where differencing can't tell.

*Lines* (``blocks``): all text of a page in order, menus, adverts and footers too; only scripts, styles, forms' fields and the like hold no
lines. Each line is *main* (inside ``article``, ``main`` or a role of that kind), *out* (inside an element that its tag, its role or a
whole class or id names as a menu, header, footer, sidebar, notice, advert, form or comments) or *open* (anything else).

*Differencing*: the distinct URLs of a host are in order of path, whatever their number: they are cut into ranges of about ``group`` URLs
(at most ``MOST_RANGES`` ranges), and the first and last URL of a range meet those of the ranges beside it. A URL is paired with the
neighbour whose path shares the longer prefix, and its rows are compared with one page of that neighbour (least page_id, then least
hash of html). Both pages' lines, all of them, as hashes, are aligned by a longest common subsequence, and the lines that are aligned are deleted, but for main ones:
copies of an article, and passages that articles share, are main text. ``n_differenced`` counts what went this way.

*Structure* decides only what differencing leaves: lines that are *out* go too, since menus, adverts and footers often have words of their own on each page
(README has figures). Open lines stay.

URLs alone are sorted. The lines of one page for each URL, as hashes, go to the rows of its neighbours; rows of frequent URLs are dealt over
groups that each get a copy of these hashes.

Defined results: null or empty html gives an empty text; a null or odd URL has the host "" and is paired as any other, so null and empty URLs
are one URL, the first of host ""; a URL alone on its host keeps its open lines; rows of one URL are never compared with each other (they
may be the same page) but all with the neighbour; an empty table gives an empty result. Only the named columns are read. Time of an alignment grows
with the pairs of equal lines of both pages, beyond the lines that both begin and end with.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

#: Bounds of this many ranges of URLs, at most, are gathered and sent to tasks.
MOST_RANGES = 2000
#: Rows of a URL are dealt over groups of about this many.
ROWS_OF_A_URL = 2000

#: Elements whose text is never main text, elements that hold raw text, and elements that end a line.
LEFT_OUT = frozenset("nav header footer aside form script style noscript template iframe object svg math canvas button select option textarea dialog menu head title audio video map datalist".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BREAKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Of the elements left out, those whose lines take part in the differencing.
STRUCTURE = frozenset("nav header footer aside menu dialog form".split())
#: Words in class, id or role that mark what isn't main text (fixed values).
NOISE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored banner sidebar side nav navbar navigation menu menubar footer contentinfo complementary header masthead cookie cookies consent gdpr notice notices alert comment comments disqus reply replies respond newsletter subscribe signup login share sharing social related recommended breadcrumb breadcrumbs popup modal overlay promo widget pagination pager skip search form toolbar".split())
MAIN = frozenset("article main".split())
#: Words that may stand beside a word of NOISE in one class or id, as in site-footer (fixed values).
BESIDE = frozenset("site page global top bottom left right box block wrap wrapper container area section list inner outer primary secondary main".split())
#: Elements that end an open paragraph, list item or table part when they begin (fixed values of the HTML standard), and where the search for it stops.
ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPE = frozenset("html table td th caption object template button".split())
LISTS = frozenset("ul ol dl table menu".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)


def _names_noise(value: str) -> bool:
    """Whether a class, id or role holds a whole word that names noise: ad, cookie-notice, site-footer, but not has-sidebar or search-algorithms."""
    for word in value.split():
        parts = [x for x in re.split(r"[-_:]+", word) if x]
        if any(x in NOISE for x in parts) and all(x in NOISE or x in BESIDE for x in parts):
            return True
    return False


def _kind(tag: str, attributes: str, in_main: bool) -> str | None:
    """'none' for what holds no lines, 'out' for what isn't main text, 'main' for a marked article."""
    if tag in LEFT_OUT and not (tag == "header" and in_main):
        return "out" if tag in STRUCTURE else "none"
    found = "main" if tag in MAIN else None
    if attributes and not attributes.isspace() and tag not in ("html", "body"):
        if _HIDDEN.search(attributes):
            return "none"
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return "none"
            if name == "role" and value in MAIN:
                found = "main"
            if found is None and _names_noise(value):
                return "out"
    return found


def _ended(stack: list[tuple[str, str | None]], tag: str) -> int:
    """How many elements of the stack stay open when ``tag`` begins."""
    keep = len(stack)
    if tag in ENDS_P:
        for i in range(keep - 1, -1, -1):
            if stack[i][0] == "p":
                return i
            if stack[i][0] in SCOPE:
                break
    for i in range(keep - 1, -1, -1):
        if stack[i][0] in ENDS.get(tag, ()):
            keep = i
        elif stack[i][0] in LISTS or tag not in ENDS:
            break
    return keep


def blocks(page: str | None) -> list[tuple[str, str]]:
    """Lines of a page in order, each with its kind: main, open or out."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str | None]] = []
    held: list[str] = []
    open_ = {"none": 0, "out": 0, "main": 0}
    at, page = 0, page or ""

    def flush():
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((text, "out" if open_["out"] else "main" if open_["main"] else "open"))

    def leave(keep: int):
        for _, kind in stack[keep:]:
            if kind:
                open_[kind] -= 1
        del stack[keep:]

    while at < len(page):
        m = _TAG.search(page, at)
        begin = m.start() if m else len(page)
        if begin > at and not open_["none"]:
            held.append(page[at:begin])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m.end() == len(page) and not m[0].endswith(">"):
            break  # a tag that is cut off
        closing = bool(m[1])
        if not open_["none"]:
            if tag in BREAKS:
                flush()
            elif tag == "br":
                held.append(" ")
        if not closing:
            if stack and (keep := _ended(stack, tag)) < len(stack):
                leave(keep)
            if tag in VOID:
                continue
            if tag in RAW:
                stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else len(page)
                if not open_["none"] and tag not in LEFT_OUT:
                    held.append(" ")
                continue
            kind = _kind(tag, m[3], open_["main"] > 0)
            if kind == "out" and held and not open_["none"]:
                flush()
            stack.append((tag, kind))
            if kind:
                open_[kind] += 1
        else:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if held and any(k == "out" for _, k in stack[i:]):
                        flush()
                    leave(i)
                    break
    if not open_["none"]:
        flush()
    return out


def lines(page: str | None) -> list[tuple[str, bool]]:
    """Lines of a page that may be main text, and whether each is open."""
    return [(text, kind == "open") for text, kind in blocks(page) if kind != "out"]


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence of a and b (Hunt and Szymanski, within what both begin and end with)."""
    least = min(len(a), len(b))
    head = next((i for i in range(least) if a[i] != b[i]), least)
    tail = next((i for i in range(least - head) if a[-1 - i] != b[-1 - i]), least - head)
    if head or tail:
        inner = common_lines(a[head : len(a) - tail], b[head : len(b) - tail]) if least > head + tail else []
        return [*range(head), *(head + i for i in inner), *range(len(a) - tail, len(a))]
    places = defaultdict(list)
    for j, x in enumerate(b):
        places[x].append(j)
    ends: list[int] = []
    nodes: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect_left(ends, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                nodes.append(node)
            elif j < ends[k]:
                ends[k], nodes[k] = j, node
    found, node = [], nodes[-1] if nodes else None
    while node:
        found.append(node[0])
        node = node[1]
    return found[::-1]


def _shared_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _hash_list(page: list[tuple[str, str]]) -> list[int]:
    return [xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in page]


def _hashes(batches):
    """Batches (host, path, page_id, print, html) to the same with line hashes in place of html."""
    for batch in batches:
        lists = [_hash_list(blocks(x)) for x in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(lists, pa.list_(pa.int64()))], ["host", "path", "page_id", "print", "lines"])


def _nearer(batches):
    """Batches (host, path, path on either side or null) to the one that shares the longer prefix, or the one before."""
    for batch in batches:
        chosen = []
        for path, *sides in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            chosen.append(max((x for x in sides if x is not None), key=lambda x: _shared_prefix(x, path), default=None))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chosen, pa.string())], ["host", "path", "partner"])


def _texts(batches):
    """Batches (page_id, url, html, line hashes of the partner or null) to texts and counts."""
    for batch in batches:
        texts, counts = [], []
        for page, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            found = blocks(page)
            aligned = common_lines(_hash_list(found), other) if other and any(kind != "main" for _, kind in found) else ()
            gone = {i for i in aligned if found[i][1] != "main"}
            texts.append("\n".join(t for i, (t, kind) in enumerate(found) if kind != "out" and i not in gone))
            counts.append((len(texts[-1]), len(found), len(gone)))
        numbers = np.array(counts, np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), *(pa.array(numbers[:, k].copy()) for k in range(3))], ["page_id", "url", "text", "n_chars", "n_lines", "n_differenced"])


def _partners(urls: DataFrame, group: int) -> DataFrame:
    """host, path, partner of distinct URLs (host, path): the neighbour in order of path with the longer shared prefix."""
    n = urls.count()
    ranges = min(-(-n // group), MOST_RANGES)
    # bounds are some of the URLs, chosen by their hash, so ranges depend on nothing but the table
    every = max(n // (20 * ranges), 1) if ranges else 1
    some = sorted((r.host.encode(), r.path.encode()) for r in urls.where(F.pmod(F.xxhash64("host", "path"), F.lit(every)) == 0).collect()) if ranges > 1 else []
    bounds = some[:: max(len(some) // ranges, 1)] if some else []

    def place(batches):
        for batch in batches:
            at = [bisect_left(bounds, (h.encode(), p.encode())) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int32())], ["host", "path", "part"])

    placed = urls.mapInArrow(place, "host string, path string, part int")
    url = F.struct("host", "path")
    edges = placed.groupBy("part").agg(F.min(url).alias("first"), F.max(url).alias("last"))
    whole = Window.orderBy("part")  # one row for each range
    edges = edges.select("part", F.lag("last").over(whole).alias("left"), F.lead("first").over(whole).alias("right"))
    near = Window.partitionBy("part").orderBy("host", "path")
    sided = placed.select("part", "host", "path", F.lag(url).over(near).alias("before"), F.lead(url).over(near).alias("after")).join(F.broadcast(edges), "part")
    same = lambda x: F.when(x["host"] == F.col("host"), x["path"])
    sided = sided.select("host", "path", same(F.coalesce("before", "left")).alias("before"), same(F.coalesce("after", "right")).alias("after"))
    return sided.mapInArrow(_nearer, "host string, path string, partner string").where("partner is not null")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", group: int = 400) -> DataFrame:
    """page_id, url, text, n_chars, n_lines (of all kinds) and n_differenced (lines that differencing deleted) for each row of pages."""
    small_batches(pages.sparkSession, 500)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    where = F.coalesce("url", F.lit(""))
    host = F.coalesce(F.regexp_extract(where, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    path = F.regexp_replace(where, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    rows = rows.withColumn("host", host).withColumn("path", path)
    urls = rows.groupBy("host", "path").agg(F.count("*").alias("n"))
    partners = _partners(urls.select("host", "path"), group)
    hashed = rows.select("host", "path", "page_id", F.coalesce(F.xxhash64("html"), F.lit(0)).alias("print"), "html")
    hashed = hashed.mapInArrow(_hashes, "host string, path string, page_id long, print long, lines array<bigint>")
    one = hashed.groupBy("host", F.col("path").alias("partner")).agg(F.min(F.struct("page_id", "print", "lines"))["lines"].alias("other"))
    # rows of a frequent URL are dealt over groups, each of which meets the partner's lines
    often = urls.where(F.col("n") > ROWS_OF_A_URL).select("host", "path", F.ceil(F.col("n") / ROWS_OF_A_URL).alias("deals"))
    deals = F.coalesce("deals", F.lit(1))
    rows = rows.join(F.broadcast(often), ["host", "path"], "left").withColumn("deal", F.pmod(F.monotonically_increasing_id(), deals))
    shared = partners.join(one, ["host", "partner"]).join(F.broadcast(often), ["host", "path"], "left")
    shared = shared.select("host", "path", "other", F.explode(F.sequence(F.lit(0).cast("long"), deals.cast("long") - 1)).alias("deal"))
    joined = rows.join(shared, ["host", "path", "deal"], "left").select("page_id", "url", "html", "other")
    return joined.mapInArrow(_texts, "page_id long, url string, text string, n_chars long, n_lines long, n_differenced long")
