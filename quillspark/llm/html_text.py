"""Main text of web pages: markup zones, and line differencing between pages with neighbouring URLs.

Each page becomes lines, one for each block element, those of menus, footers, adverts and the like among them. They are
compared with the lines of the page whose path is nearest within the same host: both pages' lines are aligned by their
longest common subsequence, and the lines they share, being the site's and not the page's, are deleted.

A check by markup follows, on every page. Lines in marked elements go even if no neighbour has them. Where a page has
article elements, what stands outside of them goes, and lines of theirs that were deleted as shared are put back, since
articles that quote each other would lose their own text; but an article element that is shared whole, as a list of the
latest stories is, stays deleted if another of the page has lines of its own.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, slices, written

BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is text alone, whatever stands in it; without an end tag it is the rest of the page.
TEXT = frozenset("script style textarea title".split())
#: Elements that go with their content up to their own end tag; closed in their start tag or never, they are empty.
WHOLE = frozenset("noscript template svg iframe object select button canvas audio video".split())
OUT = frozenset("nav footer aside form menu dialog".split())
ARTICLE = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open p, and where the search for it stops.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt td th tr tbody thead tfoot caption".split())
P_BARS = frozenset("table td th caption".split())
_LIST, _CELL = BLOCKS - frozenset("address div p li dd dt".split()), frozenset(("table",))
#: Of elements whose end tag may be left out: which open ones a new one ends, and where the search for them stops.
ENDS = {"li": ({"li"}, _LIST), "dd": ({"dd", "dt"}, _LIST), "dt": ({"dd", "dt"}, _LIST), "option": ({"option"}, {"optgroup"}), "optgroup": ({"optgroup"}, ()), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, _CELL), "tbody": ({"tbody", "thead", "tfoot"}, _CELL), "tfoot": ({"tbody", "thead", "tfoot"}, _CELL)}
#: Elements that go on in the next paragraph when theirs ends.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: Start tags that svg and math can't hold, and the elements of theirs that hold html again.
BREAKS = frozenset("article blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 head hr li main menu ol p pre table ul".split())
HOLDS_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: Words of class, id or role that mark what is not the article.
_MARKS = "ad ads adsbygoogle advert adverts advertisement aside banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies dialog disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted promotion related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget"
MARKS = frozenset(_MARKS.split())
#: Words that go with them; beside any other word, as in share-price or related-work, they mark nothing.
PARTS = frozenset("area bar block body box btn c button buttons card container content feed form group holder icon icons inner is item items js label link links list main modal outer overlay panel post posts reader readers row section site slot sticky stories text thread title top bottom left right unit user users visitor wrap wrapper zone".split())
#: Within an article a header holds its title.
MARKS_INSIDE = MARKS - {"header"}
RULED_OUT = -1
#: Cells of the table that aligns two pages; larger ones are halved first, so that memory stays in proportion to lines.
CELLS = 4 << 20
#: Attributes: quotes count only where a value begins, as in HTML. Outside of quotes a < ends the search, and nothing is
#: tried twice, so that markup that never ends costs little.
_ATTRIBUTES = r"""((?>[^<>=]|=[ \t\n\f\r]*+(?:"[^"]*"|'[^']*'|[^\s<>"'][^\s<>]*)?)*+)"""
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*){_ATTRIBUTES}>|<[!?][^>]*>", re.DOTALL)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_UNQUOTED_SLASH = re.compile(r"=\s*[^\s\"'][^\s\"']*/\Z|=/\Z")
_TEXT_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>", re.IGNORECASE) for x in TEXT}


def _marked(attributes: str, marks: frozenset = MARKS) -> bool:
    if "=" not in attributes:
        return "hidden" in attributes and bool(_HIDDEN.search(attributes))
    for a, b, c in _NAMED.findall(attributes):
        for said in (a or b or c).lower().split():
            words = set(_WORD.findall(said))
            if words & marks and words <= marks | PARTS:
                return True
    return bool(_HIDDEN.search(attributes))


def _closed(attributes: str) -> bool:
    """Whether a start tag ends with a slash that isn't of an attribute's value."""
    return attributes.endswith("/") and not _UNQUOTED_SLASH.search(attributes)


def _after_text(text: str, name: str, at: int, closed: bool) -> int:
    """Where a text-only element ends whose start tag ends at `at`."""
    stop = _TEXT_END[name].search(text, at)
    return stop.end() if stop else at if closed or name == "title" else len(text)


class _Open:
    """The names of open elements, outermost first."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.counts: dict[str, int] = {}

    def push(self, name: str) -> None:
        self.names.append(name)
        self.counts[name] = self.counts.get(name, 0) + 1

    def cut(self, k: int) -> list[str]:
        """Close the k-th and all within."""
        gone = self.names[k:]
        del self.names[k:]
        for x in gone:
            self.counts[x] -= 1
        return gone

    def last(self, names, bars=()) -> int:
        """The innermost open element of `names`, -1 if there is none or one of `bars` stands around first."""
        if any(self.counts.get(x) for x in names):
            for k in range(len(self.names) - 1, -1, -1):
                if self.names[k] in names:
                    return k
                if self.names[k] in bars:
                    break
        return -1

    def ended(self, name: str) -> int:
        """The element that an end tag closes; inline ones don't close blocks."""
        return self.last((name,), () if name in BLOCKS or name in WHOLE else BLOCKS)


def _ends(text: str) -> dict[int, int]:
    """Of the elements in WHOLE that are closed within the element around them: the ends of their start and end tags."""
    tags, starts, found = _Open(), [], {}
    at = 0
    while m := _TAG.search(text, at):
        at = m.end()
        if m[2] is None:
            continue
        name, foreign = m[2].lower(), tags.last(("svg", "math"), HOLDS_HTML)
        if m[1]:
            k = tags.ended(name)
            if k >= 0:
                if name in WHOLE:
                    found[starts[k]] = at
                tags.cut(k)
                del starts[k:]
            continue
        closed = _closed(m[3])
        if name in TEXT and not (foreign >= 0 and (closed or name == "title")):
            at = _after_text(text, name, at, closed)
            continue
        if foreign >= 0 and name in BREAKS:
            tags.cut(foreign)
            del starts[foreign:]
        if name not in VOID and not closed:
            tags.push(name)
            starts.append(at)
    return found


def _matched(text: str, name: str) -> dict[int, int]:
    """Where each start tag of an element that has an end tag ends, and where that begins: the innermost open one is closed."""
    out, held, at = {}, [], 0
    while m := _TAG.search(text, at):
        at = m.end()
        if m[2] is None:
            continue
        said = m[2].lower()
        if said in TEXT and not m[1]:
            at = _after_text(text, said, at, _closed(m[3]))
        elif said == name and m[1] and held:
            out[held.pop()] = m.start()
        elif said == name and not m[1] and not _closed(m[3]):
            held.append(at)
    return out


def page_lines(text: str) -> list[tuple[str, int]]:
    """The lines of a page that markup doesn't rule out, each with the number of the article element it stands in, else 0."""
    return [(line, unit) for line, unit in all_lines(text) if unit != RULED_OUT]


def all_lines(text: str) -> list[tuple[str, int]]:
    """All lines of a page; the number of those that markup rules out is RULED_OUT.

    The outermost article counts; of lines in a main element alone, that.

    What stands in a marked element goes, articles too, as those of a list of comments or a sidebar; only where nothing
    would be left of any article do articles end the marked elements around them.
    """
    lines, hidden = _lines(text, False)
    return _lines(text, True)[0] if hidden and not any(unit > 0 for _, unit in lines) else lines


def _lines(text: str, freed: bool) -> tuple[list[tuple[str, int]], bool]:
    """The lines, and whether an article stands in a marked element; freed: such an article ends it."""
    out: list[tuple[str, int]] = []
    hidden, closings = False, {}
    held: list[str] = []
    tags = _Open()
    inside = 0  # open article elements
    units, of = 0, {}  # numbers given so far, and by name that of the outermost open one
    skip, skipped_in, skipped_at = -1, 0, 0  # the open element whose content goes, articles around it, the end of its tag
    ends: dict[int, int] | None = None

    def close() -> None:
        if held:
            line = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if line:
                out.append((line, RULED_OUT if skip >= 0 else of["article" if tags.counts.get("article") else "main"] if inside else 0))

    def cut(k: int) -> None:
        nonlocal inside, skip
        if skip >= k:
            close()
        inside -= sum(x in ARTICLE for x in tags.cut(k))
        if skip >= k:
            skip = -1

    at, end = 0, len(text)
    while at < end:
        m = _TAG.search(text, at)
        if (m.start() if m else end) > at:
            held.append(text[at : m.start() if m else end])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in BLOCKS:
            close()
        elif name == "br":
            held.append(" ")
        if m[1]:
            k = tags.ended(name)
            if k >= 0:
                cut(k)
            continue
        closed = _closed(m[3])
        if name in TEXT:
            close()
            at = _after_text(text, name, at, closed)
            continue
        if name in WHOLE:
            close()
            if not closed:
                ends = _ends(text) if ends is None else ends
                at = ends.get(at, at)
            continue
        if name in ENDS:
            k = tags.last(*ENDS[name])
            if k >= 0:
                cut(k)
        if name in ENDS_P and tags.counts.get("p") and (name == "p" or skip < 0 or tags.names[skip] not in FORMATTING):
            k = tags.last(("p",), P_BARS)
            if k >= 0:
                cut(k)
        if skip >= 0 and name in ARTICLE and not skipped_in:
            around = tags.names[skip]
            if around not in closings and not freed:
                closings[around] = _matched(text, around)
            if freed or closings[around].get(skipped_at, 0) < at:
                cut(skip)  # the element was never closed
            else:
                hidden = True
        if name in VOID or closed:
            continue
        tags.push(name)
        if name in ARTICLE:
            inside += 1
            if tags.counts[name] == 1:
                units += 1
                of[name] = units
            if skip < 0 and not freed and _marked(m[3], MARKS_INSIDE):
                close()
                hidden, skip, skipped_in, skipped_at = True, len(tags.names) - 1, inside, at
        elif skip < 0 and (name in OUT or name == "header" and not inside or (name not in ("html", "head", "body") and _marked(m[3], MARKS_INSIDE if inside else MARKS))):
            close()
            skip, skipped_in, skipped_at = len(tags.names) - 1, inside, at
    close()
    return out, hidden


def common_lines(a: list, b: list) -> list[bool]:
    """For each element of a, whether a longest common subsequence with b holds it."""
    shared = [False] * len(a)
    i, na, nb = 0, len(a), len(b)
    while i < min(na, nb) and a[i] == b[i]:
        shared[i] = True
        i += 1
    while na > i and nb > i and a[na - 1] == b[nb - 1]:
        na, nb = na - 1, nb - 1
        shared[na] = True
    x, y = a[i:na], b[i:nb]
    if not x or not y:
        return shared
    # Only lines that both hold can be common; the rest of the table would be copies of its neighbours.
    both = set(x) & set(y)
    number = {v: k for k, v in enumerate(both)}
    xs = [k for k, v in enumerate(x) if v in both]
    for k, common in zip(xs, _aligned(np.array([number[x[k]] for k in xs], np.int64), np.array([number[v] for v in y if v in both], np.int64)), strict=True):
        shared[i + k] = common
    return shared


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How long the longest common subsequences of x and each beginning of y are."""
    row = np.zeros(len(y) + 1, np.int32)
    for v in x:
        np.maximum.accumulate(np.where(y == v, row[:-1] + 1, row[1:]), out=row[1:])
    return row


def _aligned(x: np.ndarray, y: np.ndarray) -> list[bool]:
    if len(x) > 1 and len(x) * len(y) > CELLS:
        half = len(x) // 2
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        return _aligned(x[:half], y[:cut]) + _aligned(x[half:], y[cut:])
    shared = [False] * len(x)
    rows = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for r in range(len(x) - 1, -1, -1):
        best = np.where(y == x[r], rows[r + 1, 1:] + 1, rows[r + 1, :-1])
        rows[r, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    r = c = 0
    while r < len(x) and c < len(y):
        if x[r] == y[c]:
            shared[r] = True
            r, c = r + 1, c + 1
        elif rows[r + 1, c] >= rows[r, c + 1]:
            r += 1
        else:
            c += 1
    return shared


def staying(units: list[int], shared: list[bool]) -> list[bool]:
    """Which lines are the text's, of those that markup leaves: what differencing left, checked by article elements."""
    articles = {unit for unit in units if unit}
    if not articles:
        return [not gone for gone in shared]
    whole = articles & {unit for unit, gone in zip(units, shared, strict=True) if not gone} or articles
    return [unit in whole for unit in units]


def _hashes(lines: list[str]) -> bytes:
    return np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines], np.uint64).tobytes()


def _page_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page that has lines: their hashes and article numbers, and a digest of those that markup leaves."""
    for batch in slices(batches, "html"):
        keep, out = [], []
        for i, html in enumerate(batch.column("html").to_pylist()):
            if lines := all_lines(html or ""):
                hashes, units = _hashes([x for x, _ in lines]), np.array([unit for _, unit in lines], np.int32)
                keep.append(i)
                out.append((hashes, units.tobytes(), hashlib.sha256(np.frombuffer(hashes, np.uint64)[units != RULED_OUT].tobytes()).digest()))
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("page_key").take(at), batch.column("url").take(at), *(pa.array([x[k] for x in out], pa.binary()) for k in range(3))], ["page_key", "url", "lines", "units", "digest"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of the lines that markup leaves: which of them stay. Pages that keep all they would keep without a neighbour have no row."""
    for batch in batches:
        keep, out = [], []
        for i, (a, units, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lines", "units", "near_lines")), strict=True)):
            units = np.frombuffer(units, np.int32)
            left = units != RULED_OUT
            shared = np.array(common_lines(np.frombuffer(a, np.uint64).tolist(), np.frombuffer(b, np.uint64).tolist()), bool)[left].tolist()
            units = units[left].tolist()
            stay = staying(units, shared)
            if stay != staying(units, [False] * len(units)):
                keep.append(i)
                out.append(np.packbits(stay).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("same").take(pa.array(keep, pa.int64())), pa.array(out, pa.binary())], ["same", "stay"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        out = []
        for text, stay in zip(batch.column("html").to_pylist(), batch.column("stay").to_pylist(), strict=True):
            lines = page_lines(text or "")
            bits = staying([unit for _, unit in lines], [False] * len(lines)) if stay is None else np.unpackbits(np.frombuffer(stay, np.uint8), count=len(lines)).tolist()
            out.append("\n".join([x for (x, _), kept in zip(lines, bits, strict=True) if kept]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _nearer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page, which of the pages before and after it in its host shares the longer beginning of its path."""
    for batch in batches:
        near = []
        for host, path, before, after in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "before", "after")), strict=True):
            found = [(len(commonprefix([path, x["path"]])) + (path == x["path"]), x["same"]) for x in (before, after) if x and x["host"] == host]
            near.append(max(found, key=lambda x: x[0])[1] if found else None)
        yield pa.RecordBatch.from_arrays([batch.column("same"), pa.array(near, pa.string())], ["same", "near"])


def differenced(pages: DataFrame) -> DataFrame:
    """page_key and bits of the lines that markup leaves: which of them stay, for pages whose text the page of nearest path changes.

    All lines of both pages are aligned, those in menus and the like too; the check by article elements follows at once,
    so that a page of which it puts back every line has no row here, and its html need not move.

    Pages are ordered by path over the whole host; of the one before and the one after, that with the longer common
    beginning counts, of two alike the one before. Rows of one path of which markup leaves the same lines are copies of one page, which
    isn't its own neighbour; of their lines the least are aligned. A page alone in its host shares nothing.
    """
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-zA-Z][\w+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    same = F.sha2(F.concat(F.concat_ws("\x1f", "host", "path", F.lit("")).cast("binary"), "digest"), 256)
    opened = pages.select("page_key", "url", "html").mapInArrow(_page_hashes, "page_key string, url string, lines binary, units binary, digest binary")
    lines = written(opened.select("page_key", "lines", "units", "digest", host.alias("host"), path.alias("path")).withColumn("same", same).drop("digest"), "page-lines")
    once = lines.groupBy("host", "path", "same").agg(F.min(F.struct("lines", "units")).alias("least")).select("host", "path", "same", "least.*")
    # Contiguous ranges of all paths, however large a host is; the rows at their edges are handed on to the ranges beside.
    ranges = once.select("host", "path", "same").repartitionByRange(partitions(pages.sparkSession), "host", "path", "same")
    placed = written(ranges.withColumn("part", F.spark_partition_id()), "page-order")
    page = F.struct("host", "path", "same")
    w, over = Window.partitionBy("part").orderBy("host", "path", "same"), Window.orderBy("part")
    # One row a range, so the order over all of them and the broadcast stay small.
    edges = placed.groupBy("part").agg(F.min(page).alias("first"), F.max(page).alias("last"))
    edges = edges.select("part", F.lag("last").over(over).alias("before_part"), F.lead("first").over(over).alias("after_part"))
    within = placed.select("part", "host", "path", "same", F.lag(page).over(w).alias("before"), F.lead(page).over(w).alias("after"))
    beside = within.join(F.broadcast(edges), "part").select("host", "path", "same", F.coalesce("before", "before_part").alias("before"), F.coalesce("after", "after_part").alias("after"))
    near = beside.mapInArrow(_nearer, "same string, near string")
    own, other = once.select("same", "lines", "units"), once.select(F.col("same").alias("near"), F.col("lines").alias("near_lines"))
    # A page is near to two others at most, so no key of these joins is hot.
    bits = near.filter("near IS NOT NULL").join(own, "same").join(other, "near").mapInArrow(_compared, "same string, stay binary")
    return written(lines.select("page_key", "same").dropDuplicates(["page_key"]).join(bits, "same").select("page_key", "stay"), "staying-lines")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null html counts as empty and gives an empty text. Rows that repeat a page (id, url and html) get the same text. A
    null url stands for a page without host, paired with others of that kind. An empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    key = F.sha2(F.concat_ws("\x1f", F.col("page_id").cast("string"), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))), 256)
    keyed = rows.withColumn("page_key", key)
    stay = differenced(keyed.withColumn("url", F.coalesce("url", F.lit(""))))
    # A written table, so Spark knows its size: it broadcasts it only below the session's threshold, else joins by key.
    return keyed.join(stay, "page_key", "left").select("page_id", "url", "html", "stay").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
