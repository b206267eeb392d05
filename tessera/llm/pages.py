"""HTML extraction by nearest-URL page differencing.

A page becomes lines, one for each block of text, menus and footers included. Within each host, pages of different lines
are sorted by URL path; a page's neighbours are those at most REACH places before or after it, the NEAR ones whose paths
share most leading segments (then the closest), and each is aligned with the page by longest common subsequence. A
neighbour that shares COPY of the page's text outside its frame, or of its own, carries the same article and tells
nothing, so it counts for no line. A line shared with VOTES of the other neighbours (with one, if there is only one) is
the site's frame and is deleted, unless it stands inside an article: articles share sentences, so there a line goes only
if SITE of the host's pages lose it and nothing but such lines lies between it and the article's edge.

Markup settles only what differencing leaves open: a line that no neighbour has, such as a menu that differs from page
to page, has a role from its markup. Lines in menus, footers, side columns, forms, adverts, notices and reader comments
go; and where a page has an `article` or `main` element, only its lines count.

Neighbours are found on keys and line hashes alone: pages of equal lines on a host are one page, which is dealt by range
of (host, path), numbered densely, and joined by number, so a host or a group of copies of any size spreads over all
tasks.

Defined cases: null or empty html gives an empty text; a page without a neighbour loses no shared lines; unclosed,
stray and badly nested tags never fail; a null url is a host of its own and has no neighbour; repeated rows and repeated
ids are each answered; a page of any length is read whole; only the id, url and html columns are read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, join_skewed, slices, staged, tasks_for

_START = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/<>]*))")
_STOP, _ANGLE = re.compile(r"[<>\"']"), re.compile("[<>]")
#: What stands before an attribute's opening quote; before the quote of another tag's attribute.
_VALUE, _OTHER_TAG = re.compile(r"=\s*\Z"), re.compile(r"<[a-zA-Z][^<>]*=\s*\Z")
#: Elements without text of the page; each is read up to its end tag.
_RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in "script style noscript template textarea svg iframe title".split()}
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_DROP = frozenset("nav footer aside form head button select menu dialog".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_OPEN_END = frozenset("p li dt dd tr td th option".split())
#: Class and id words of parts that are no article: everywhere, and those that count outside an article only.
_HINT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo|banner|cookies?|consent|popup|modal|overlay|sidebar|navbar|navigation|breadcrumbs?|pagination|comments?|share|sharing|newsletter|subscribe|signup)(?:$|[\s_-])", re.I)
_OUTSIDE = re.compile(r"(?:^|[\s_-])(?:notices?|alert|side|menu|nav|pager|footer|masthead|site-?header|topbar|toolbar|repl(?:y|ies)|social|related|recommend\w*|login|widget|tags?|skip-?link|copyright|legal|disclaimer)(?:$|[\s_-])", re.I)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
#: Roles of a line.
OTHER, MAIN, FRAME = 0, 1, 2
REACH, NEAR, VOTES, COPY, BLOCK = 3, 4, 2, 0.75, 64
#: A line inside articles is the site's frame on SITE of a host's pages, and SITE_PAGES, at least.
SITE, SITE_PAGES = 0.9, 5
#: Bits of the largest table that aligning two pages holds; pages that a task sorts or aligns.
TABLE, SORTED = 1 << 24, 20_000


def _unwanted(attrs: str, tag: str, inside: bool) -> bool:
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id") and (_HINT.search(value) or not inside and _OUTSIDE.search(value)):
            return True
        if name == "role" and value.lower() in _ROLE or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
    return False


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the tag ends whose name ends at `at`; last: the last place of each quote.

    A quote after = holds all up to the next one, unless none follows or it opens another tag's attribute; then the tag
    ends at the next < or >, as does one without quotes.
    """
    while m := _STOP.search(page, at):
        quote = m[0]
        if quote == ">":
            return m.end()
        if quote == "<":
            return m.start()
        at = m.end()
        if _VALUE.search(page, max(0, m.start() - 64), m.start()):
            end = page.find(quote, at) if at <= last[quote] else -1
            if end < 0 or _OTHER_TAG.search(page, max(at, end - 256), end):
                stop = _ANGLE.search(page, at)
                return len(page) if not stop else stop.end() if stop[0] == ">" else stop.start()
            at = end + 1
    return len(page)


def _tags(page: str):
    """(start, end, name, whether it closes, attributes) of each tag, and of what is no text with an empty name, in one pass."""
    last, at = {q: page.rfind(q) for q in "\"'"}, 0
    while m := _START.search(page, at):
        start, name = m.start(), (m[4] or "").lower()
        if m[1]:
            at = page.find("-->", m.end())
            at = len(page) if at < 0 else at + 3
        elif m[2]:
            stop = _ANGLE.search(page, m.end())
            at = len(page) if not stop else stop.end() if stop[0] == ">" else stop.start()
        else:
            at = end = _tag_end(page, m.end(), last)
            if name not in _RAW or m[3]:
                yield start, end, name, bool(m[3]), page[m.end() : end].removesuffix(">")
                continue
            if not page.endswith("/>", start, end):
                close = _RAW[name].search(page, end)
                at = close.end() if close else len(page)
        yield start, at, "", False, ""


def lines(page: str | None) -> list[tuple[str, int]]:
    """(text, role) of each block of the page."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    inside, skip, depth, at = 0, "", 0, 0

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((text, FRAME if skip else MAIN if inside else OTHER))
            held.clear()

    page = page or ""
    for start, end, tag, closing, attrs in _tags(page):
        if start > at:
            held.append(page[at:start])
        at = end
        if not tag:
            continue
        root = tag in ("article", "main")
        if tag in _BLOCK:
            flush()
        elif tag == "br":
            held.append(" ")
        if skip:
            # an unclosed element ends at the article, and one whose end may be left out ends at the next block
            if root and not closing or skip in _OPEN_END and tag in _BLOCK and (tag != skip or not closing):
                flush()
                skip = ""
            else:
                if tag == skip:
                    depth += -1 if closing else 1
                    if depth <= 0:
                        flush()
                        skip = ""
                continue
        if root:
            inside = max(0, inside + (-1 if closing else 1))
        elif not closing and tag not in _VOID and (tag in _DROP or tag == "header" and not inside or _unwanted(attrs, tag, inside > 0)):
            flush()
            skip, depth = tag, 1
    held.append(page[at:])
    flush()
    return out


def _rows(a: list, b: list) -> tuple[list[int], dict]:
    """The rows of the bit-parallel table of a against b, where a zero bit at j says that the length grows with column j; and where b's values are."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full, row, rows = (1 << len(b)) - 1, (1 << len(b)) - 1, []
    for x in a:
        u = row & where.get(x, 0)
        row = (row + u | row - u) & full
        rows.append(row)
    return rows, where


def _traced(a: list, b: list) -> list[int]:
    """shared() with the whole table held."""
    rows, where = _rows(a, b)
    full, out, j = (1 << len(b)) - 1, [], len(b)
    for k in range(len(a) - 1, -1, -1):
        row, before = rows[k] | ~((1 << j) - 1), (rows[k - 1] if k else full) | ~((1 << j) - 1)
        zeros = lambda r, j=j: j - (r & (1 << j) - 1).bit_count()
        if zeros(row) > zeros(before):
            out.append(k)
            hit = where[a[k]] & (1 << j) - 1
            length = zeros(row)
            while hit:
                top = hit.bit_length() - 1
                below = (1 << top) - 1
                if top - (before & below).bit_count() == length - 1:
                    j = top
                    break
                hit &= below
    return out[::-1]


def _lengths(a: list, b: list) -> np.ndarray:
    """Lengths of the longest common subsequences of a and each prefix of b, from the last row alone."""
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    masks = {}
    full = row = (1 << len(b)) - 1
    for x in a:
        if x not in masks:
            bits = np.zeros(len(b), np.uint8)
            bits[where.get(x, [])] = 1
            masks[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            if len(masks) > 1_000:  # each is as long as b
                masks.pop(next(iter(masks)))
        u = row & (masks[x] if x in masks else 0)
        row = (row + u | row - u) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _halved(a: list, b: list) -> list[int]:
    """shared() by halving a where the table would take over TABLE bits, so that memory grows with the lines, not their square."""
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in b else []
    if len(a) * len(b) <= TABLE:
        return _traced(a, b)
    half = len(a) // 2
    cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
    return _halved(a[:half], b[:cut]) + [half + k for k in _halved(a[half:], b[cut:])]


def shared(a: list, b: list) -> list[int]:
    """Positions in a of one longest common subsequence of a and b."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    mid_a, mid_b = a[head : len(a) - tail], b[head : len(b) - tail]
    both = set(mid_a) & set(mid_b)
    at_a = [k for k, x in enumerate(mid_a) if x in both]
    found = _halved([mid_a[k] for k in at_a], [x for x in mid_b if x in both])
    return [*range(head), *(head + at_a[k] for k in found), *range(len(a) - tail, len(a))]


def _url(url: str | None) -> tuple[str | None, str]:
    if url is None:
        return None, ""
    rest = re.sub(r"^[a-zA-Z][\w+.-]*:", "", url).lstrip("/")
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, _, path = rest.partition("/")
    return host.lower(), re.sub(r"\.\w{1,5}$", "", path.strip("/"))


def _read(batches):
    for batch in slices(batches):
        url = batch.column("url").to_pylist()
        key = [_url(u) for u in url]
        got = [lines(page) for page in batch.column("html").to_pylist()]
        marks = [b"".join(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=8).digest() for t, _ in x) for x in got]
        # how much each line weighs in telling copies: its length, but nothing in a frame
        weigh = [np.array([0 if r == FRAME else len(t) for t, r in x], np.uint32).tobytes() for x in got]
        sig = [hashlib.blake2b(f"{h}\0".encode("utf-8", "replace") + m, digest_size=16).digest() for (h, _), m in zip(key, marks, strict=True)]
        cols = [batch.column("uid"), batch.column("id"), batch.column("url"), pa.array([k[0] for k in key], pa.string()), pa.array([k[1] for k in key], pa.string())]
        text, role = pa.array([[t for t, _ in x] for x in got], pa.list_(pa.string())), pa.array([bytes(r for _, r in x) for x in got], pa.binary())
        yield pa.record_batch([*cols, pa.array(sig, pa.binary()), pa.array(marks, pa.binary()), pa.array(weigh, pa.binary()), text, role], ["uid", "id", "url", "host", "path", "sig", "marks", "weigh", "lines", "role"])


def _number(batches):
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        rows = batch.num_rows
        yield pa.record_batch([*batch.columns, pa.array(np.full(rows, part), pa.int32()), pa.array(np.arange(n, n + rows), pa.int64())], [*batch.schema.names, "part", "no"])
        n += rows


def _common(a: str, b: str) -> int:
    """Leading path segments that two paths share."""
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


def frame(page: tuple[list[int], list[int]], neighbours: list[tuple[list[int], list[int]]]) -> list[int]:
    """Positions of the lines that differencing deletes. Pages: (line hashes, weights), the nearest neighbour first."""
    marks, weigh = page
    votes, told = [0] * len(marks), 0
    for other, other_weigh in neighbours:
        found = shared(marks, other)
        same = sum(weigh[k] for k in found)
        # a copy, or a page that holds this one's article or is held by it
        if same and same >= COPY * min(sum(weigh), sum(other_weigh)):
            continue
        told += 1
        for k in found:
            votes[k] += 1
    return [k for k, n in enumerate(votes) if n and n >= min(VOTES, told)]


def _align(batches):
    """Rows (block, own, at, sig, host, path, marks, weigh, role) sorted by block and place: the lines of a block's own pages
    that differencing would delete, as gone outside articles, and inside as (place among the article's lines, their number, hash).

    A block has BLOCK pages of its own and those near them, so only so many are held.
    """
    held: list[dict] = []
    inner = pa.list_(pa.struct([("line", pa.int32()), ("place", pa.int32()), ("mark", pa.int64())]))

    def done() -> pa.RecordBatch:
        out: list[tuple] = []
        read = {r["at"]: (np.frombuffer(r["marks"] or b"", np.uint64).tolist(), np.frombuffer(r["weigh"] or b"", np.uint32).tolist()) for r in held}
        for r in held:
            if not r["own"]:
                continue
            around = [x for x in held if 0 < abs(x["at"] - r["at"]) <= REACH and x["host"] == r["host"]]
            near = sorted(around, key=lambda x, r=r: (-_common(r["path"], x["path"]), abs(x["at"] - r["at"]), x["at"]))[:NEAR]
            if found := frame(read[r["at"]], [read[x["at"]] for x in near]):
                place = np.cumsum(np.frombuffer(r["role"], np.uint8) == MAIN) - 1
                marks = np.frombuffer(r["marks"], np.int64)
                inside = [{"line": k, "place": int(place[k]), "mark": int(marks[k])} for k in found if r["role"][k] == MAIN]
                out.append((r["sig"], r["host"], [k for k in found if r["role"][k] != MAIN], inside, int(place[-1]) + 1))
        held.clear()
        sig, host, gone, inside, size = zip(*out, strict=True) if out else ((),) * 5
        return pa.record_batch([pa.array(sig, pa.binary()), pa.array(host, pa.string()), pa.array(gone, pa.list_(pa.int32())), pa.array(inside, inner), pa.array(size, pa.int32())], ["sig", "host", "gone", "inside", "size"])

    for batch in slices(batches):
        for r in batch.to_pylist():
            if held and held[-1]["block"] != r["block"]:
                yield done()
            held.append(r)
    if held:
        yield done()


def _numbered(pages: DataFrame) -> DataFrame:
    """pages (sorted within partitions) with `at`, their place in the whole."""
    spark = pages.sparkSession
    kinds = pages.schema.simpleString()[len("struct<") : -1]
    ranked = staged(pages.mapInArrow(_number, f"{kinds}, part int, no long"), "ranked")
    start, total = [], 0
    # one row a task
    for r in ranked.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        start.append((r["part"], total))
        total += r["n"]
    offsets = spark.createDataFrame(start or [(0, 0)], "part int, start long")
    return ranked.join(F.broadcast(offsets), "part").withColumn("at", F.col("start") + F.col("no")).drop("part", "no", "start")


def frames(read: DataFrame) -> DataFrame:
    """(sig, gone, n): the lines that differencing deletes from pages of sig, and their number. read: sig, host, path, marks, weigh, role.

    Lines outside articles go as voted. A line inside one is the article's own unless nearly all of the host's pages lose it
    too (SITE) and only such lines stand between it and the article's beginning or end.
    """
    spark = read.sparkSession
    keys = ["sig", "host", "path", "marks", "weigh", "role"]
    known = read.filter("host is not null and octet_length(marks) > 0")
    # copies have equal marks, so only the least path has to be chosen
    pages = staged(known.groupBy("sig").agg(F.min(F.struct(*keys[1:])).alias("p"), F.count("*").alias("n")).select("sig", "p.*", "n"), "keys")
    tasks = tasks_for(spark, pages.count(), SORTED)
    dealt = _numbered(pages.select("sig", "host", "path", "marks", "weigh", "role").repartitionByRange(tasks, "host", "path", "sig").sortWithinPartitions("host", "path", "sig"))
    # a page goes to the block of its place, and near a border to the block next to it too
    own, place = F.floor(F.col("at") / BLOCK), F.col("at") % BLOCK
    sides = F.array_compact(F.array(own, F.when(place < REACH, own - 1), F.when(place >= BLOCK - REACH, own + 1)))
    blocks = dealt.withColumn("block", F.explode(sides)).withColumn("own", F.col("block") == own)
    kinds = "sig binary, host string, gone array<int>, inside array<struct<line:int,place:int,mark:bigint>>, size int"
    voted = staged(blocks.repartition(tasks, "block").sortWithinPartitions("block", "at").mapInArrow(_align, kinds), "voted")
    inside = voted.select("sig", "host", "size", F.inline("inside"))
    held = inside.select("sig", "host", "mark").distinct().groupBy("host", "mark").agg(F.count("*").alias("held"))
    everywhere = held.join(pages.groupBy("host").agg(F.count("*").alias("pages")), "host").filter((F.col("held") >= SITE_PAGES) & (F.col("held") >= SITE * F.col("pages")))
    lost = inside.join(everywhere.select("host", "mark"), ["host", "mark"]).groupBy("sig", "size").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("at"))
    edges = F.expr("filter(at, (x, i) -> x.place = i or x.place = size - (size(at) - i)).line")
    gone = F.concat("gone", F.coalesce("edge", F.array().cast("array<int>"))).alias("gone")
    return voted.select("sig", "gone").join(lost.select("sig", edges.alias("edge")), "sig", "left").select("sig", gone).filter(F.size("gone") > 0).join(pages.select("sig", "n"), "sig")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", differ: bool = True) -> DataFrame:
    """Rows (id, url, lines) for each row of pages: the lines of main text in page order. Without differ markup alone decides."""
    kind = pages.schema[id_col].dataType.simpleString()
    given = pages.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    read = staged(given.mapInArrow(_read, f"uid long, id {kind}, url string, host string, path string, sig binary, marks binary, weigh binary, lines array<string>, role binary"), "pages")
    lines = read.select("sig", "id", "url", "lines", "role")
    if differ:
        gone = staged(frames(read.select("sig", "host", "path", "marks", "weigh", "role")), "gone")
        rows, held = gone.agg(F.count("*"), F.sum(F.size("gone"))).first()
        few = rows <= BROADCAST_ROWS and (held or 0) <= 4 * BROADCAST_ROWS
        lines = lines.join(F.broadcast(gone.drop("n")), "sig", "left") if few else join_skewed(lines, gone, "sig", "n", how="left")
    else:
        lines = lines.withColumn("gone", F.lit(None).cast("array<int>"))
    # of the lines left, those of the article if the page has one, and else all that markup does not mark as frame
    left = F.expr(f"""filter(transform(lines, (x, i) -> struct(x as text, conv(hex(substring(role, i + 1, 1)), 16, 10) as role, i)),
        x -> x.role = if(hex(role) rlike '^(..)*0{MAIN}', '{MAIN}', '{OTHER}') and (gone is null or not array_contains(gone, x.i))).text""")
    return lines.select(F.col("id").alias(id_col), F.col("url").alias(url_col), left.alias("lines"))


def op7(pages: DataFrame) -> DataFrame:
    text = F.array_join("lines", "\n")
    return extract(pages).select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
