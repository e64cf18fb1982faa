"""HTML extraction: nearest-URL page differencing, with the markup as evidence where a neighbour cannot tell.

Each page becomes text lines, a line for a block, each with a zone: main (inside an article or main element), open (outside
of these), frame (inside menus, headers, footers, sidebars, notices, adverts, forms, comments, by tag, role or a class of
that very name), or doubt (inside main, but in a header or a class with such a name as a part, like content-header).
Pages of a host are sorted by URL path, and each is held against the page with other lines, of those beside it, whose path
shares the longer prefix with its own; all lines of the two are aligned by a longest common subsequence. A line is shared
if it is on that alignment and, where the page on the other side has open lines in common too, on that with it as well: the frames of
a template are on both, a copied article is on one.

Shared lines are deleted, but for those that the markup says are the article: differencing alone cannot give right results,
as frames that differ from page to page share no lines, and articles quote each other. So frame lines go whether shared or not;
main lines stay; doubt lines stay unless shared; and open lines go where main holds most of the text, else stay unless shared.
Where the deletion would leave nothing of a page, as in a group of copies, its lines stay.

Neighbours come from a range-partitioned sort by host and path, so a host with a third of all pages is spread over many
tasks; the pages that a range needs of others are also sent to it. Bounds come from a sample of keys, of SAMPLE a range, the same
on each run. Copies beside each other, however many ranges they fill, all have the page before and the page after the copies, so
bounds do not change which pages are beside each other.

Cases: null html counts as empty; pages without text give an empty text; null urls, and urls without ://, are on the host
'' and beside each other; equal urls are beside each other, sorted by page_id; repeated rows stay; pages with equal lines
are not held against each other, but against the pages before and after all of them; cut-off or deeply nested markup is read as far as it goes, in linear time; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape
from os.path import commonprefix

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from veilwork.llm import common as shared, urls

MAIN, OPEN, FRAME, DOUBT = 0, 1, 2, 3

# Fixed values of HTML: elements without content, of raw text, and that start a block of their own
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "svg", "math"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
FRAMES = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "search", "object", "audio", "video", "canvas"}
FRAME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
FRAME_NAME = r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|comments?|disqus|replies|sidebar|side-bar|nav|navbar|navigation|menu|breadcrumbs?|footer|header|masthead|share|sharing|social|related|recommended|newsletter|subscribe|signup|popup|modal|overlay|widget|pagination|pager|skip-link"
FRAME_CLASS = re.compile(rf"(?:^|\s)(?:{FRAME_NAME})(?:$|\s)", re.I)
FRAME_PART = re.compile(rf"(?:^|[\s_-])(?:{FRAME_NAME})(?:$|[\s_-])", re.I)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(?P<odd>/?[a-zA-Z])[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


def marked_as(name: str, attrs: str) -> int:
    """FRAME, DOUBT or (neither) OPEN, by what an element's tag says."""
    if name in ("html", "body", "main", "article"):
        return OPEN
    found = DOUBT if name == "header" else FRAME if name in FRAMES else OPEN
    if "=" in attrs or "hidden" in attrs:
        for m in ATTR.finditer(attrs):
            key, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
            if key in ("class", "id") and FRAME_CLASS.search(value) or key == "role" and value.lower() in FRAME_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return FRAME
            if key in ("class", "id") and found == OPEN and FRAME_PART.search(value):
                found = DOUBT
    return found


def lines(html: str) -> list[tuple[str, int]]:
    """The text lines of a page, in order, with their zones."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements, with the zone around each
    depth: Counter = Counter()  # of them, by name
    zone, at, end = OPEN, 0, len(html)

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((text, zone))

    while at < end:
        m = TAG.search(html, at)
        if not m:
            held.append(html[at:])
            break
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["close"]:
            if name in BLOCK or name in RAW:
                flush()
            around = zone
            while depth[name]:
                inner, around = stack.pop()
                depth[inner] -= 1
                if inner == name:
                    break
            if around != zone:
                flush()
                zone = around
            continue
        if name == "br":
            held.append(" ")
        if name in BLOCK:
            flush()
        if name in VOID or m["attrs"].endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = close.end() if close else end
            continue
        if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and stack and stack[-1][0] == name:
            zone = stack.pop()[1]
            depth[name] -= 1
        inner = zone
        if zone != FRAME:
            says = marked_as(name, m["attrs"])
            if says == FRAME:
                inner = FRAME
            elif says == DOUBT:  # outside of an article, a header is a frame
                inner = DOUBT if zone in (MAIN, DOUBT) else FRAME if name == "header" else OPEN
            elif name in ("article", "main"):
                inner = MAIN
        if inner != zone:
            flush()
        stack.append((name, zone))
        depth[name] += 1
        zone = inner
    flush()
    return out


def row_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of a longest common subsequence of a with each prefix of b (bit-parallel over b)."""
    where: dict[int, int] = {}
    for j, x in enumerate(b.tolist()):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a.tolist():
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer((~v & full).to_bytes(len(b) // 8 + 1, "little"), "u1"), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(bits)]


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of a are on a longest common subsequence with b: Hirschberg's division, in linear memory."""
    out = np.zeros(len(a), bool)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out[i] = True
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            out[j - 1] = True
            j, m = j - 1, m - 1
        if i == j or k == m:
            continue
        if j - i == 1:
            out[i] = bool((b[k:m] == a[i]).any())
            continue
        mid = (i + j) // 2
        cut = k + int(np.argmax(row_lengths(a[i:mid], b[k:m]) + row_lengths(a[mid:j][::-1], b[k:m][::-1])[::-1]))
        todo += [(i, mid, k, cut), (mid, j, cut, m)]
    return out


def aligned(page: list[tuple[str, int]], other: list[tuple[str, int]]) -> np.ndarray:
    """Which lines of a page are on a longest common subsequence with another page's."""
    names: dict[str, int] = {}
    a, b = (np.array([names.setdefault(t, len(names)) for t, _ in x], "i8") for x in (page, other))
    return common(a, b)


def shared_lines(page: list[tuple[str, int]], near: list[list[tuple[str, int]]]) -> np.ndarray:
    """Which lines are frames by the pages beside this one, nearest first: those on the alignment with the nearest, and with
    the other too where the two have a template in common, that is open lines."""
    shared = aligned(page, near[0])
    if len(near) > 1:
        plain = [[line for line in x if line[1] == OPEN] for x in (page, near[1])]
        if aligned(*plain).any():
            shared &= aligned(page, near[1])
    return shared


def main_text(page: list[tuple[str, int]], near: list[list[tuple[str, int]]] = ()) -> str:
    zones = np.array([z for _, z in page], "i8")
    size = np.array([len(t) for t, _ in page], "i8")
    article = np.isin(zones, (MAIN, DOUBT))
    kept = article if size[article].sum() > size[zones == OPEN].sum() else zones != FRAME
    if kept.any() and near:
        left = kept & ~(shared_lines(page, near) & (zones != MAIN))
        kept = left if left.any() else kept
    return "\n".join(t for (t, _), k in zip(page, kept) if k)


ROW = "place string, host string, path string, page_id string, url string, held long, lines array<struct<t:string,z:int>>"


def beside(keys: DataFrame) -> DataFrame:
    """place, held, also: the pages that further ranges need, of keys (place, host, held, range). A range needs the last page before it that
    is no copy of its first page, and the first page after it that is no copy of its last, however many ranges the copies fill.
    At most two pages a range; the windows run over the table of ranges."""
    page = F.struct("place", "held", "host")
    differ = lambda a, b: (F.col(f"{a}.held") != F.col(f"{b}.held")) | (F.col(f"{a}.host") != F.col(f"{b}.host"))
    ends = shared.materialize(keys.groupBy("range").agg(F.min(page).alias("first"), F.max(page).alias("last")))
    other = shared.written_join(keys.withColumn("page", page), ends, "range").groupBy("range").agg(F.max(F.when(differ("page", "last"), F.col("page"))).alias("below"), F.min(F.when(differ("page", "first"), F.col("page"))).alias("above"))
    order = Window.orderBy("range")
    t = ends.join(other, "range").withColumns({"left": F.lag("last").over(order), "right": F.lead("first").over(order)})
    # up to and from each range, the nearest page that is no copy of its last and of its first page; a range of copies alone passes on
    t = t.withColumn("below", F.coalesce("below", F.when(differ("left", "first"), F.col("left")))).withColumn("above", F.coalesce("above", F.when(differ("right", "last"), F.col("right"))))
    t = t.withColumns({"below": F.last("below", True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "above": F.first("above", True).over(order.rowsBetween(0, Window.unboundedFollowing))})
    before = F.when(differ("left", "first"), F.col("left")).otherwise(F.lag("below").over(order))
    after = F.when(differ("right", "last"), F.col("right")).otherwise(F.lead("above").over(order))
    t = t.select("range", before.alias("before"), after.alias("after"))
    needs = t.select("range", F.explode(F.array("before", "after")).alias("page")).where("page is not null")
    return needs.groupBy(F.col("page.place").alias("place"), F.col("page.held").alias("held")).agg(F.collect_set("range").alias("also"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    shared.small_batches(pages.sparkSession)
    kind = dict(pages.dtypes)["page_id"]
    keyed = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", urls.host("url").alias("host"), urls.path("url").alias("path"))
    keyed = keyed.withColumn("place", F.concat_ws("\x00", "host", "path", F.lpad(F.coalesce("page_id", F.lit("")), 20, "0"), F.hex(F.xxhash64("url"))))
    bounds = urls.bounds_of(keyed.select("place"))

    @F.pandas_udf("int")
    def range_of(place: pd.Series) -> pd.Series:
        return place.map(lambda p: bisect_right(bounds, p)).astype("int32")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [lines(h) if h else [] for h in b.pop("html")]
            b["held"] = [xxhash.xxh3_64_intdigest("\n".join(t for t, _ in x)) - (1 << 63) for x in found]
            b["lines"] = [[{"t": t, "z": z} for t, z in x] for x in found]
            yield b

    parsed = keyed.select("place", "host", "path", "page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInPandas(parse, ROW)
    sent = beside(shared.materialize(parsed.select("place", "host", "held", range_of("place").alias("range"))))
    rows = shared.written_join(parsed, shared.materialize(sent), ["place", "held"], "left").withColumn("range", range_of("place"))
    to = F.concat(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("copy"))), F.coalesce(F.transform("also", lambda r: F.struct(r.alias("range"), F.lit(True).alias("copy"))), F.array().cast("array<struct<range:int,copy:boolean>>")))
    rows = rows.withColumn("to", F.explode(to)).select("to.range", "to.copy", *[c.split(" ")[0] for c in ROW.split(", ")])

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a group of pages with equal lines waits for the page after it; of the pages before it, the last is known
        group, before, members, zoned, out = None, None, [], {}, []

        def done(after) -> None:
            near = [x for x in (before, after) if x is not None and x.range == group.range and x.host == group.host]
            texts = {}
            for page_id, url, path, zones in members:
                mine = sorted(near, key=lambda x: -len(commonprefix([path, x.path])))  # of equals, the one before
                key = zones, tuple(x is before for x in mine)
                if key not in texts:
                    texts[key] = main_text(zoned[zones], [lines_of(x) for x in mine])
                out.append((page_id, url, texts[key]))

        lines_of = lambda x: [(line["t"], line["z"]) for line in x.lines]
        for b in batches:
            for r in b.itertuples(index=False):
                if group is not None and (r.range, r.host, r.held) != (group.range, group.host, group.held):
                    done(r)
                    before, members, zoned = (last if last.range == r.range else None), [], {}
                group = last = r
                if not r.copy:
                    zones = bytes(line["z"] for line in r.lines)
                    zoned.setdefault(zones, lines_of(r))
                    members.append((r.page_id, r.url, r.path, zones))
            yield pd.DataFrame(out, columns=["page_id", "url", "text"])
            out.clear()
        if group is not None:
            done(None)
            yield pd.DataFrame(out, columns=["page_id", "url", "text"])

    swept = rows.repartition("range").sortWithinPartitions("range", "place", "held").mapInPandas(sweep, "page_id string, url string, text string")
    return swept.withColumn("page_id", F.col("page_id").cast(kind))
