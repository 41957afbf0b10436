"""Main text of web pages by nearest-URL page differencing.

A page is cut into lines at block tags, in page order. The distinct pages of a host are put in the order of their URL
paths, and each is compared with its nearest: the neighbour in that order with the longer common path. A longest common
subsequence aligns the lines of both, and lines that they share are the site's and are deleted. Tags only help where
differencing can't tell: lines inside an article or main element stay although a neighbour has them too, and what no
neighbour shares goes if it stands in an element for menus, footers, sidebars, forms and the like or in one whose class
or id says so (adverts, notices, comments).

A page without an article or main element is not told from a copy by its lines' place. If its neighbours share most of
its lines, those at distance 2, 4, 8 and so on in the host's order are asked until one doesn't; if none is found, only
what all that were asked share is the site's, and nothing if only one was there to ask.

Only the lines' hashes are compared and sent around. Pages meet their neighbours by consecutive numbers, so that no host
is gathered anywhere and no border of partitions parts two neighbours.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN, small_parts, staged

#: A page without an article of whose lines a neighbour shares more than this part may be a copy of it.
COPY = 0.8

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_TAG_STOP = re.compile("[>\"']")
# Tags of HTML by role.
RAW = frozenset("script style textarea title template svg iframe noframes xmp".split())
SKIPPED = frozenset("nav footer aside form noscript head button select option datalist dialog object audio video canvas map menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUTSIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|popup|modal|newsletter|subscribe|sidebar|side|nav\w*|menu|breadcrumbs?|header|masthead|topbar|footer|copyright|comments?|disqus|replies|share|social|related|recommended|pagination|pager|login|search)(?:$|[\s_-])", re.I
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)


def tokens(page: str) -> Iterator[tuple[str, bool, str]]:
    """(text, ...) as ("", False, text); tags as (name, whether it ends, attributes). Raw elements and comments are left out,
    but a raw element is given as a tag that begins. Each character is looked at a bounded number of times: once a tag is
    found whose quotes leave it open to the end of the page, the tags from there on end at the next ">"."""
    at, end = 0, len(page)
    last, quoted = page.rfind(">"), True
    while at < end:
        open_ = page.find("<", at)
        if open_ < 0:
            yield "", False, page[at:]
            return
        if open_ > at:
            yield "", False, page[at:open_]
        if page.startswith("<!--", open_):
            close = page.find("-->", open_ + 4)
            at = end if close < 0 else close + 3
            continue
        ending = page.startswith("</", open_)
        name = _NAME.match(page, open_ + 1 + ending)
        if open_ >= last or not (name or page[open_ + 1] in "!?"):
            yield "", False, "<"
            at = open_ + 1
            continue
        begin = name.end() if name else open_ + 2
        close = begin
        while quoted and name:
            stop = _TAG_STOP.search(page, close)
            if stop and stop[0] == ">":
                close = stop.start()
                break
            close = page.find(stop[0], stop.end()) + 1 if stop else 0
            if not close:
                quoted = False
        if not quoted or not name:
            close = page.find(">", begin)
            if close < 0:
                yield "", False, "<"
                at = open_ + 1
                continue
        at = close + 1
        if not name:
            continue
        tag = name[0].lower()
        if tag in RAW and not ending:
            closing = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = closing.end() if closing else end
        yield tag, ending, page[begin:close]


def _marked(attributes: str) -> bool:
    return any(_OUTSIDE.search(next(filter(None, x), "")) for x in _ATTRIBUTE.findall(attributes))


def lines(page: str) -> list[tuple[str, bool, bool]]:
    """(line, whether an article or main element holds it, whether tags or classes tell that it is the site's)."""
    out: list[tuple[str, bool, bool]] = []
    words: list[str] = []
    inside, skip, depth = 0, "", 0
    held = told = False

    def close() -> None:
        nonlocal words
        if words:
            line = " ".join(html.unescape("".join(words)).split())
            if line:
                out.append((line, held, told))
            words = []

    for name, ending, attributes in tokens(page):
        if not name:
            words.append(attributes)
            held, told = inside > 0, bool(skip)
            continue
        if name in RAW:
            if name in ("title", "textarea"):
                close()
            continue
        if name in INLINE and name != skip:
            continue
        close()
        if skip:
            if name == skip and not attributes.rstrip().endswith("/"):
                depth += -1 if ending else 1
                if skip == "p" and not ending:
                    depth = 0  # a paragraph ends where the next begins
                if depth <= 0:
                    skip = ""
            if skip or ending:
                continue
        if name in ("article", "main"):
            if not ending and _marked(attributes):
                skip, depth = name, 1
            else:
                inside = max(0, inside + (-1 if ending else 1))
        elif not ending and name not in VOID and name not in ("html", "body"):
            if name in SKIPPED or (name == "header" and not inside) or (attributes and (_marked(attributes) or _HIDDEN.search(attributes))):
                skip, depth = name, 1
    close()
    return out


def shared(a: list, b: list) -> set[int]:
    """The places of a on a longest common subsequence of a and b; rows of the table are whole numbers taken as bits. What
    both begin or end with is matched at once, which some longest common subsequence does."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    found = {*range(first), *range(len(a) - last, len(a))}
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    where: dict = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    places = [i for i, line in enumerate(a) if line in where]  # the others are on no common subsequence
    full, row = (1 << len(b)) - 1, (1 << len(b)) - 1
    rows = [row]
    for i in places:  # a zero bit is a place where the length grows
        match = row & where[a[i]]
        row = ((row + match) | (row - match)) & full
        rows.append(row)
    i, j = len(places), len(b)
    grown = lambda r, n: n - (rows[r] & ((1 << n) - 1)).bit_count()
    while i and j:
        here = grown(i, j)
        if not here:
            break
        if grown(i - 1, j) == here:
            i -= 1
        elif grown(i, j - 1) == here:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.add(first + places[i])
    return found


def common_path(a: str, b: str) -> int:
    """How many characters two paths begin with alike."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def ask(own: list[int], held: bool, path: str, near: list[tuple[str, list[int]]], so_far: set[int] | None) -> tuple[set[int], bool, int]:
    """(lines of a page that the site has, whether that is settled, how many neighbours were asked). own: hashes of its lines;
    held: whether it has an article; near: (path, hashes) of neighbours before and after, the nearer of which is asked
    first; so_far: what all that were asked before share."""
    asked = 0
    for _, other in sorted(near, key=lambda n: -common_path(path, n[0])):
        found, asked = shared(own, other), asked + 1
        if held or len(found) <= COPY * len(own):
            return found, True, asked
        so_far = found if so_far is None else so_far & found
    return so_far or set(), False, asked


def kept_text(page: list[tuple[str, bool, bool]], gone: set[int]) -> tuple[str, int, int]:
    """(the page's main text, lines that differencing deleted, lines that only tags deleted)."""
    by_lines = {i for i in gone if not page[i][1]}
    by_tags = {i for i, (_, _, told) in enumerate(page) if told} - by_lines
    return " ".join(line for i, (line, _, _) in enumerate(page) if i not in by_lines and i not in by_tags), len(by_lines), len(by_tags)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows host, path, key, html -> host, path, key, held, hashes of lines."""
    for batch in small_parts(batches, 3):
        found = [lines(page or "") for page in batch.column(3).to_pylist()]
        hashes = [np.array([xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) for line, _, _ in page], np.uint64).view(np.int64) for page in found]
        held = pa.array([any(x for _, x, _ in page) for page in found], pa.bool_())
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), held, pa.array(hashes, pa.list_(pa.int64()))], ["host", "path", "key", "held", "own"])


ASKED = "at long, gone array<int>, settled boolean, asked int"


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows at, path, held, own, gone, asked, p_path, p_own, n_path, n_own -> ASKED."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            near = [(r[f"{x}_path"], r[f"{x}_own"]) for x in "pn" if r[f"{x}_path"] is not None]
            gone, settled, asked = ask(r["own"], r["held"], r["path"], near, None if r["gone"] is None else set(r["gone"]))
            out.append((r["at"], sorted(gone), settled, r["asked"] + asked))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.list_(pa.int32()), pa.bool_(), pa.int32()))], ["at", "gone", "settled", "asked"])


def _numbered(pages: DataFrame) -> DataFrame:
    """The rows in order of host, path and key, with consecutive numbers in the column at."""
    own = f"{OWN}n"
    rows = staged(pages.orderBy("host", "path", "key").withColumn(own, F.monotonically_increasing_id()), "pages")
    part = F.shiftrightunsigned(own, 33)
    # A row per partition; an exchange of these alone goes to one task.
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    bases = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))
    return rows.withColumn("part", part).join(bases, "part").withColumn("at", F.col("base") + F.col(own).bitwiseAND((1 << 33) - 1)).drop("part", "base", own)


def site_lines(pages: DataFrame) -> DataFrame:
    """host, key, gone: the places of the lines that neighbours share, of each distinct page (host, path, key, html)."""
    distinct = pages.select("host", "path", "key", "html").mapInArrow(_hashed, "host string, path string, key string, held boolean, own array<long>")
    distinct = distinct.groupBy("host", "key").agg(F.min("path").alias("path"), F.first("held").alias("held"), F.first("own").alias("own"))
    units = staged(_numbered(distinct), "page-lines")
    side = lambda name, step: units.select((F.col("at") + step).alias("at"), "host", F.col("path").alias(f"{name}_path"), F.col("own").alias(f"{name}_own"))
    waiting = units.select("at", "host", "path", "held", "own", F.lit(None).cast("array<int>").alias("gone"), F.lit(0).alias("asked"))
    done, distance = [], 1
    while True:
        met = waiting.join(side("p", distance), ["at", "host"], "left").join(side("n", -distance), ["at", "host"], "left")
        # Where both sides are beyond the host's pages there is no one left to ask.
        alone = met.where("p_path is null and n_path is null")
        answers = staged(met.where("p_path is not null or n_path is not null").drop("host").mapInArrow(_ask, ASKED), "page-answers")
        done += [answers.where("settled").select("at", "gone"), alone.where("asked > 1").select("at", "gone")]
        open_ = answers.where("not settled")
        if open_.isEmpty():
            break
        waiting = staged(units.join(open_.select("at", "gone", "asked"), "at").select("at", "host", "path", "held", "own", "gone", "asked"), "page-waiting")
        distance *= 2
    gone = done[0]
    for more in done[1:]:
        gone = gone.unionByName(more)
    return staged(units.select("at", "host", "key").join(gone, "at").select("host", "key", "gone"), "site-lines")


TEXTS = "page_id long, url string, text string, n_chars long, n_shared int, n_tagged int"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows page_id, url, gone, html -> TEXTS."""
    for batch in small_parts(batches, 3):
        found = [kept_text(lines(page or ""), set(gone or ())) for gone, page in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        text, by_lines, by_tags = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), pa.array(by_lines, pa.int32()), pa.array(by_tags, pa.int32())],
            ["page_id", "url", "text", "n_chars", "n_shared", "n_tagged"],
        )


def _of_url(url: Column, part: int) -> Column:
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:www\.)?([^/?#]*)([^?#]*)"
    return F.coalesce(F.regexp_extract(url, pattern, part), F.lit(""))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars, n_shared (lines that differencing deleted), n_tagged (lines that only tags
    deleted).

    A null page is empty and gives an empty text. Pages without a URL count as one host without paths. Equal pages of a
    host count as one page at the least of their paths, so that a copy deletes nothing; of two neighbours with equally
    long common paths the one before is asked. Every row has a row in the result, also without an id or repeated. Very
    long pages are read whole, in time that grows with their length (the alignment with the product of the numbers of
    lines in bits). An empty table gives an empty result. Other columns are not read.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.lower(_of_url(url, 1)).alias("host"), _of_url(url, 2).alias("path"), F.md5(F.coalesce(html_col, F.lit(""))).alias("key"), F.col(html_col).alias("html"))
    return rows.join(site_lines(rows), ["host", "key"], "left").select("page_id", "url", "gone", "html").mapInArrow(_texts, TEXTS)
