"""Main text of HTML pages, by structure and by differencing with the nearest page of the host.

A page is cut into lines, the texts of its block elements.  Lines in menus,
headers, footers, side bars, notices, adverts, forms, scripts, styles and
reader comments go by their elements' names, roles and classes.

Each page is compared with the nearest page of its host: pages are sorted by
host and URL path, and of the two neighbours the one with the longer common
path counts.  A copy says nothing about the template, so neighbours are the
pages before and after a run of copies.  A copy has equal lines, or (nearly)
equal ones once the lines that are common on the host are set aside; a long
template makes no copy.  The lines are aligned by their longest common
subsequence, and shared lines go.

If the page marks its article (``article``, else ``main``), only lines in it
are its text, and of the shared ones only those go that most articles of the
host hold (a bar of links or of the licence) and that lie before the article's
first or behind its last own line: an article keeps what some other page says
too, such as a licence line, a quotation or the headings of a recipe.

Every page is parsed twice, so that no text is stored: first for the hashes of
its lines, which alone are sorted and compared; what is to go returns as line
numbers, and the second time the text is made without these lines.  Few such
numbers are broadcast, so that the pages stay where they are; many are joined
by a shuffle of the pages.  Neighbours are adjacent in one
global order, whatever the partitions: runs of copies at the partitions' edges
are answered apart, once the driver has seen four pages of each partition.

A null html is an empty page, its text is empty.  A null URL is an empty one.
"""
from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrel.llm.runtime import setup, stored, wide

COPY = 0.8      # a neighbour that shares more of the own lines of the page that has fewer is a copy
#: Bits of the table of an alignment that are held at a time; what is found does not depend on it.
CELLS = 1 << 24

DROP = frozenset("nav header footer aside form script style noscript template svg iframe button select textarea "
                 "dialog menu head title object canvas audio video option input annotation annotation-xml".split())
RAW = frozenset("script style noscript template textarea title svg iframe annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end no line: the text around them goes on, also where their own text is dropped.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark q s samp "
                   "small span strike strong sub sup time tt u var wbr br rp rt ruby script style noscript template svg "
                   "iframe button select textarea object canvas audio video input output meter progress picture embed "
                   "slot source track area math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder "
                   "munderover mtable mtr mtd mstyle mspace mfenced semantics annotation annotation-xml".split())
#: Words of class, id and role that mark what is not the article.
WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion "
                  "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
                  "signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus "
                  "respond replies social share sharing related recommended pagination pager footer masthead toolbar "
                  "contentinfo complementary search adsbygoogle".split())
OUTER_WORDS = frozenset("header".split())     # in an article, a header is its title
ROLES = frozenset("dialog alertdialog".split())
#: A token with one of these says something of a page or its state, not what the element is.
STATES = frozenset("has have no not with without is enabled disabled open opened closed results free".split())
#: Parts that are written on to such a word: sharebar, commentlist.
_AFTER = "container wrapper wrap box bar area block list links link section menu banner slot unit form text title".split()
MARKS = WORDS | {w + x for w in WORDS for x in _AFTER}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
                  r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


@lru_cache(1 << 16)
def _token_marks(token: str) -> tuple[bool, bool]:
    """Whether a token marks what is not the article, anywhere and outside an article; by whole words of it."""
    words = {w.lower() for w in _PARTS.findall(token)}
    if words & STATES:
        return False, False
    return bool(words & MARKS), bool(words & OUTER_WORDS)


def _marked(attrs: str, in_article: bool) -> bool:
    """Whether a word of class, id or role says that the element is not the article."""
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        if name in ("class", "id", "role"):
            for token in (m[2] or m[3] or m[4] or "").split():
                inside, outside = _token_marks(token)
                if inside or outside and not in_article or name == "role" and token.lower() in ROLES:
                    return True
    return False


_ARTICLE = re.compile(r"<(?:article|main)\b", re.I)


def _hidden(attrs: str) -> bool:
    return any(m[1].lower() == "hidden" for m in _ATTR.finditer(attrs))


def regions_of(page: str) -> list[tuple[int, str]]:
    """The page's lines that its structure does not rule out, each with 2 in an article, 1 in main, 0 elsewhere.

    A token rules out no element that holds the page's largest article (or
    main); ``html``, ``body``, ``main`` and ``article`` are never ruled out by
    their own tokens.  If tokens rule out all there is, they count for nothing."""
    lines: list[tuple[int, str, tuple, int]] = []     # region, text, marked elements around, outermost article around
    stack: list[tuple[str, bool, int, tuple, int]] = []  # open elements: name, ruled out for certain, and as in lines
    text: list[str] = []
    around: dict[int, tuple] = {}                     # the marked elements around each outermost article
    at, n = 0, 0
    start = (False, 0, (), 0)
    out, region, marks, inside = start

    def flush():
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                lines.append((region, line, marks, inside))
            text.clear()

    while at < len(page):
        m = _TAG.search(page, at)
        if not out:
            text.append(page[at:m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if out:
            pass                                      # what lies in a dropped element ends no line
        elif name not in INLINE:
            flush()
        elif name == "br":
            text.append(" ")
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if any(not x[1] and (x[0] not in INLINE or len(x[3]) > len(stack[i - 1][3] if i else ())) for x in stack[i:]):
                        flush()
                    del stack[i:]
                    out, region, marks, inside = stack[-1][1:] if stack else start
                    break
            continue
        if name == "svg" and m[3].endswith("/"):
            continue
        if name in RAW:
            end = re.compile(f"</{name}\\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or m[3].endswith("/") and name not in ("p", "div", "article", "main"):
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):  # these end their like
            if stack and stack[-1][0] == name:
                stack.pop()
                out, region, marks, inside = stack[-1][1:] if stack else start
        n += 1
        exempt = name in ("html", "body", "article", "main")
        own = bool(m[3]) and _marked(m[3], region == 2)
        gone = out or name in DROP and not (region == 2 and name == "header") or not exempt and bool(m[3]) and _hidden(m[3])
        if own and name in INLINE and not gone:       # goes without ending the line, unless an article lies in it
            end = re.compile(f"</{name}\\b", re.I).search(page, at)
            gone = not _ARTICLE.search(page, at, end.start() if end else len(page))
        if name not in INLINE and (gone and not out or own and not exempt) or own and not gone:
            flush()
        out = gone
        kind = 2 if name == "article" else 1 if name == "main" or 'role="main"' in m[3] else 0
        if kind and not inside and not out:
            inside = n
            if not own:                               # an article marked as a comment is not the page's
                around[n] = marks
        region = max(region, kind)
        if own and not exempt and not out:
            marks = (*marks, n)
        stack.append((name, out, region, marks, inside))
    if not out:
        flush()
    articles = Counter()
    for _, line, _, where in lines:
        if where in around:
            articles[where] += len(line)
    free = set(around.get(max(articles, key=articles.get, default=None), ()))
    return [(r, t) for r, t, over, _ in lines if free.issuperset(over)] or [(r, t) for r, t, _, _ in lines]


def lines_of(page: str, every: bool = False) -> tuple[list[str], bool]:
    """The page's lines that its structure does not rule out, and whether an article marks them.

    ``every``: with the lines outside that article."""
    lines = regions_of(page)
    best = max((r for r, _ in lines), default=0)
    return [t for r, t in lines if every or r == best], best > 0


def shared(a: list, b: list) -> set[int]:
    """Places in ``a`` of one longest common subsequence with ``b``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = set(range(head)) | set(range(len(a) - tail, len(a)))
    x, y = a[head:len(a) - tail], b[head:len(b) - tail]
    in_x, in_y = set(x), set(y)
    places = [head + i for i, k in enumerate(x) if k in in_y]
    return out | {places[i] for i in _common([k for k in x if k in in_y], [k for k in y if k in in_x])}


def _rows(x: list, y: list):
    """Bits of each row of the alignment's table: a zero where a place of ``y`` lengthens the common subsequence."""
    where: dict = {}
    for j, k in enumerate(y):
        where[k] = where.get(k, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for k in x:
        up = row & where.get(k, 0)
        row = ((row + up) | (row - up)) & full
        yield row


def _lengths(x: list, y: list) -> np.ndarray:
    """Lengths of the longest common subsequences of ``x`` with each start of ``y``."""
    row = 0
    for row in _rows(x, y):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes((len(y) + 7) // 8, "little"), np.uint8), count=len(y), bitorder="little")
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _common(x: list, y: list) -> list[int]:
    """Places in ``x`` of one longest common subsequence: bit-parallel rows, halved (Hirschberg) until they fit memory."""
    if not x or not y:
        return []
    if len(x) == 1 or len(x) * len(y) <= CELLS:
        rows, out = list(_rows(x, y)), []
        i, j = len(x), len(y)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.append(i)
        return out[::-1]
    half = len(x) // 2
    cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[:half - 1:-1], y[::-1])[::-1]))
    return _common(x[:half], y[:cut]) + [half + i for i in _common(x[half:], y[cut:])]


def is_copy(one: dict, other: dict) -> bool:
    """Whether two pages of a host are copies by their own lines: those that are not common on the host."""
    if one["lines"] == other["lines"]:
        return True
    a, b = _own(one), _own(other)
    if not a or not b:
        return False
    return a == b or len(shared(a, b)) > COPY * min(len(a), len(b))


def _own(row: dict) -> list[int]:
    return np.frombuffer(row["lines"], np.uint64)[np.frombuffer(row["flags"], np.uint8) & COMMON == 0].tolist()


def to_delete(own: dict, before: dict | None, after: dict | None) -> list[int]:
    """Numbers of the lines that a page shares with the nearer of its neighbours."""
    def near(other):
        n = 0
        for c, d in zip(own["path"], other["path"]):
            if c != d:
                break
            n += 1
        return -n
    for other in sorted((x for x in (before, after) if x is not None and x["lines"]), key=near):
        if not is_copy(own, other):
            return sorted(shared(_line_list(own), _line_list(other)))
    return []


#: Flags of a line: on most pages of its host; in the article (or main); in most articles of the host.
COMMON, INSIDE, BAR = 1, 2, 4
#: Hosts with more than this part of the pages are joined by broadcast, so there are no more than so many.
SPREAD = 500
BARS = 4        # articles that must hold a line before it is a bar of the host
SIGNS = "host string, path string, page_id long, key long, marked boolean, lines binary, flags binary"
PAGE = {"host": pa.string(), "path": pa.string(), "marked": pa.bool_(), "lines": pa.binary(), "flags": pa.binary()}
PAGE_TYPE = "struct<host: string, path: string, marked: boolean, lines: binary, flags: binary>"
TEXTS = "page_id long, url string, text string"
FOUND = ("page_id long, key long, gone array<int>, part int, side int, tip int, "
         "host string, path string, marked boolean, lines binary, flags binary")
FIRST, LAST, WHOLE = 0, 1, 2     # sides: a partition's first chain, its last chain, one chain that is both
#: Tips of a partition: its first page, the one after its first chain, the one before its last chain, its last page.
HEAD, SECOND, BEFORE, END = range(4)


def _hash(line: str) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(line)


def _parsed(batches):
    """A page's hashed lines."""
    for batch in batches:
        *rest, source = batch.columns
        found = [regions_of(x or "") for x in source.to_pylist()]
        best = [max((r for r, _ in t), default=0) for t in found]
        yield pa.RecordBatch.from_arrays(
            [*rest, pa.array([x > 0 for x in best], pa.bool_()),
             pa.array([np.array([_hash(x) for _, x in t], np.uint64).tobytes() for t in found], pa.binary()),
             pa.array([bytes(INSIDE if b and r == b else 0 for r, _ in t) for t, b in zip(found, best)], pa.binary())],
            _names(SIGNS))


def _texts(batches):
    """The text that a page's structure leaves, without the lines that are to go, a line feed between lines."""
    for batch in batches:
        page_id, url, source, gone = batch.columns
        out = []
        for x, g in zip(source.to_pylist(), gone.to_pylist()):
            lines, _ = lines_of(x or "")
            g = set(g or ())
            out.append("\n".join(t for i, t in enumerate(lines) if i not in g))
        yield pa.RecordBatch.from_arrays([page_id, url, pa.array(out, pa.string())], _names(TEXTS))


def _counted(batches):
    """Each line of a page once, and whether its article holds it; a null line for the page itself."""
    for batch in batches:
        host, marked, lines, flags = batch.columns
        found, inside = [], []
        for x, f in zip(lines.to_pylist(), flags.to_pylist()):
            line, of = np.unique(np.frombuffer(x, np.int64), return_inverse=True)
            found.append(line)
            inside.append(np.bincount(of, np.frombuffer(f, np.uint8) & INSIDE, len(line)) > 0)
        of = pa.array(np.repeat(np.arange(len(found)), np.array([len(x) for x in found], np.int64)))
        line = pa.concat_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found])), pa.nulls(len(found), pa.int64())])
        inside = pa.concat_arrays([pa.array(np.concatenate([np.zeros(0, bool), *inside])), marked])
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([host.take(of), host]), line, inside], ["h", "line", "inside"])


def _flagged(batches):
    for batch in batches:
        *rest, lines, flags, common, bars = batch.columns
        new = [(np.frombuffer(f, np.uint8) | np.isin(line, c or []) * np.uint8(COMMON) | np.isin(line, b or []) * np.uint8(BAR)
                ).tobytes() for line, f, c, b in zip((np.frombuffer(x, np.int64) for x in lines.to_pylist()),
                                                     flags.to_pylist(), common.to_pylist(), bars.to_pylist())]
        yield pa.RecordBatch.from_arrays([*rest, lines, pa.array(new, pa.binary())],
                                         ["host", "path", "page_id", "key", "marked", "lines", "flags"])


def _with_common(signs: DataFrame) -> DataFrame:
    """``signs`` with flags of the lines that are common on their host.

    Pages with equal lines count once.  A line is common if it is on more than
    half of the pages, and on three at least (on two if there are no more); it
    is a bar if more than half of the articles hold it, and ``BARS`` at least."""
    signs = signs.withColumn("h", F.xxhash64("host"))
    pages = signs.withColumn("sig", F.xxhash64("lines", "flags")).dropDuplicates(["h", "sig"])
    counts = (pages.select("h", "marked", "lines", "flags").mapInArrow(_counted, "h long, line long, inside boolean")
              .groupBy("h", "line").agg(F.count("*").alias("n"), F.count_if("inside").alias("m")).where("n > 1"))
    counts = stored(counts, "page-common")
    total = counts.where("line is null").selectExpr("h", "n as pages", "m as articles")
    common = (counts.where("line is not null").join(total, "h")
              .selectExpr("h", "line", "2 * n > pages and n >= least(3, pages) as c", f"2 * m > articles and m >= {BARS} as b")
              .where("c or b").groupBy("h").agg(F.collect_list(F.expr("if(c, line, null)")).alias("common"),
                                                F.collect_list(F.expr("if(b, line, null)")).alias("bars")))
    common = stored(common, "page-hosts")
    large = signs.groupBy("h").count().where(F.col("count") > signs.count() // SPREAD).select("h", F.lit(True).alias("large"))
    large = large.join(common, "h", "left")
    rest = common.selectExpr("h as k", "common as common_", "bars as bars_")
    signs = (signs.join(F.broadcast(large), "h", "left")
             .withColumn("k", F.when(F.col("large"), F.xxhash64("page_id", "key")).otherwise(F.col("h")))
             .join(rest, "k", "left"))
    lists = [F.when(F.col("large"), F.col(c)).otherwise(F.col(c + "_")).alias(c) for c in ("common", "bars")]
    return signs.select(*_names(SIGNS), *lists).mapInArrow(_flagged, SIGNS)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _answer(own: dict, before: dict | None, after: dict | None) -> list[int]:
    """Lines to delete from a page; of an article, by their numbers in it.

    What an article shares goes only if it is a bar of the host, as articles share their own lines, too, and
    only before the article's first or behind its last line that stays."""
    gone = to_delete(own, *(x if x is not None and x["host"] == own["host"] else None for x in (before, after)))
    if not own["marked"]:
        return gone
    flags = np.frombuffer(own["flags"], np.uint8)
    place = np.cumsum(flags & INSIDE > 0) - 1
    bars = {int(place[i]) for i in gone if flags[i] & INSIDE and flags[i] & BAR}
    first, last = 0, int(place[-1]) if len(place) else -1
    while first in bars:
        first += 1
    while last in bars:
        last -= 1
    return sorted(i for i in bars if i < first or i > last) if first <= last else []


def _line_list(row: dict) -> list[int]:
    return np.frombuffer(row["lines"], np.uint64).tolist()


def _linked(one: dict, other: dict) -> bool:
    return one["host"] == other["host"] and is_copy(one, other)


def _compare(batches):
    """Answers for the pages of a sorted partition; the members of its first and last chain as they are, and its tips.

    A chain is a run of pages each of which is a copy of the one before; its
    neighbours are the pages before and after it."""
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    chain: list[dict] = []
    before = None                                     # the page before the chain
    out: list[dict] = []
    tips: dict[int, dict] = {}

    def close(after):
        if before is None or after is None:
            side = WHOLE if before is after else FIRST if before is None else LAST
            out.extend(x | {"part": part, "side": side} for x in chain)
        else:
            out.extend({"page_id": x["page_id"], "key": x["key"], "gone": gone}
                       for x in chain if (gone := _answer(x, before, after)))

    for batch in batches:
        for row in batch.to_pylist():
            tips.setdefault(HEAD, row)
            if chain and not _linked(chain[-1], row):
                close(row)
                tips.setdefault(SECOND, row)
                before, chain = chain[-1], []
            if chain and chain[-1]["lines"] == row["lines"]:
                row["lines"], row["flags"] = chain[-1]["lines"], chain[-1]["flags"]
            chain.append(row)
        for at in range(0, len(out), 4096):
            yield _found(out[at:at + 4096])
        out.clear()
    if chain:
        close(None)
        tips |= {END: chain[-1]} | ({} if before is None else {BEFORE: before})
    out.extend(row | {"part": part, "tip": k} for k, row in tips.items())
    for at in range(0, len(out), 4096):
        yield _found(out[at:at + 4096])


def _found(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "key": pa.int64(), "gone": pa.list_(pa.int32()), "part": pa.int32(),
             "side": pa.int32(), "tip": pa.int32()} | PAGE
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], k) for c, k in kinds.items()], list(kinds))


def _sides(rows: list[dict]) -> list[tuple]:
    """Of each partition's first and last chain: the pages before and after it."""
    of: dict[int, dict[int, dict]] = {}
    for r in rows:
        of.setdefault(r["part"], {})[r["tip"]] = r
    parts = [of[k] for k in sorted(of)]

    def beyond(i, step, own, edge, inner):
        """The page before (after) a chain that reaches the edge of partition i."""
        while 0 <= i + step < len(parts):
            other = parts[i + step]
            if not _linked(parts[i][own], other[edge]):
                return other[edge]
            if inner in other:
                return other[inner]
            i += step
        return None

    out = []
    for i, (part, x) in enumerate(sorted(of.items())):
        before, after = beyond(i, -1, HEAD, END, BEFORE), beyond(i, 1, END, HEAD, SECOND)
        sides = [(FIRST, before, x[SECOND]), (LAST, x[BEFORE], after)] if SECOND in x else [(WHOLE, before, after)]
        out += [(part, side, *(tuple(y[c] for c in PAGE) if y else None for y in (b, a))) for side, b, a in sides]
    return out


def _at_edges(batches):
    for batch in batches:
        rows = [(r, _answer(r, r["before"], r["after"])) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r["page_id"] for r, _ in rows], pa.int64()), pa.array([r["key"] for r, _ in rows], pa.int64()),
             pa.array([g for _, g in rows], pa.list_(pa.int32()))], ["page_id", "key", "gone"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    setup(spark)
    src = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    src = src.withColumn("key", F.xxhash64("url", "html"))
    parts = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)(.*)$"
    url = F.coalesce("url", F.lit(""))
    signs = stored(src.select(F.lower(F.regexp_extract(url, parts, 1)).alias("host"),
                              F.when(url.rlike(parts), F.regexp_extract(url, parts, 2)).otherwise(url).alias("path"),
                              "page_id", "key", "html").mapInArrow(_parsed, SIGNS), "page-lines")
    order = ["host", "path", "page_id", "key"]
    ordered = _with_common(signs).repartitionByRange(wide(spark), *order).sortWithinPartitions(*order)
    found = stored(ordered.mapInArrow(_compare, FOUND), "page-shared")
    tips = [r.asDict() for r in found.where("tip is not null").collect()]        # four pages of each partition
    sides = spark.createDataFrame(_sides(tips), f"part int, side int, before {PAGE_TYPE}, after {PAGE_TYPE}")
    kind = "page_id long, key long, gone array<int>"
    edges = found.where("side is not null").drop("gone", "tip").join(F.broadcast(sides), ["part", "side"])
    gone = (found.where("gone is not null").select("page_id", "key", "gone")
            .unionByName(edges.mapInArrow(_at_edges, kind).where("size(gone) > 0")).dropDuplicates(["page_id", "key"]))
    # stored, so that Spark knows its size: a small one is broadcast and no page is shuffled
    gone = stored(gone.withColumnsRenamed({"page_id": "p", "key": "k"}), "page-gone")
    rows = src.join(gone, src["page_id"].eqNullSafe(gone["p"]) & (src["key"] == gone["k"]), "left")
    texts = rows.select("page_id", "url", "html", "gone").mapInArrow(_texts, TEXTS)
    return texts.withColumn("n_chars", F.length("text").cast("long"))
