"""Main text of HTML pages: nearest-URL page differencing, together with the page's own landmarks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import discard, materialize, null_safe, parts

RANGE_ROWS = 20_000

#: Elements whose content is never text of a page. Fixed values.
SKIPPED = frozenset("script style template noscript head title iframe object svg math canvas select option textarea button audio video".split())
#: Elements that are furniture wherever they stand. Fixed values.
FURNITURE = frozenset("nav footer aside form dialog menu".split())
#: Elements that run on in a line of text. Fixed values.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
#: Elements without content. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words that mark furniture as a whole class, id or role. Fixed values.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner menu navbar nav navigation breadcrumb breadcrumbs sidebar aside widget"
    " header masthead footer comment comments reply replies responses discussion disqus cookie cookies consent notice notices popup modal overlay newsletter subscribe"
    " login signup toolbar contentinfo complementary teaser teasers related recommended recommendations share sharing social".split()
)
#: Those that mark it as a part of a name too, like comment-list; the others, like header in header-image, leave it open. Fixed values.
SURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored navbar nav navigation breadcrumb breadcrumbs sidebar footer comment comments replies discussion disqus cookie cookies"
    " newsletter teaser teasers related recommended share sharing".split()
)
#: Parts of a name that turn the others round. Fixed values.
NEGATIONS = frozenset("free no non not without hide hidden un anti".split())
#: Roles of furniture. Fixed values.
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog form toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Where a block stands: in the article, in the article below an open mark, elsewhere, elsewhere below an open mark; below a sure mark, in furniture.
ARTICLE, OPEN_ARTICLE, ELSEWHERE, OPEN_ELSEWHERE, MARKED, NEVER = 1, 2, 0, -3, -2, -1
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"\s+")
#: Elements of other vocabularies, which alone may end in "/>". Fixed values.
FOREIGN = frozenset("svg math".split())
SLASH = re.compile(r"(?:^|[\s\"'])/\Z")
PARAGRAPH_ENDS = frozenset("p li dt dd tr td th option".split())


def named(rest: str) -> str:
    """What an element's class, id and role say: `never` furniture's role, `sure` furniture, `open`, or nothing.

    A class or id counts word by word. A name of several parts is sure by a part in SURE if it has three parts at most; by
    other marks it is open, and with a negation it says nothing.
    """
    said = ""
    for m in ATTRIBUTE.finditer(rest):
        kind = m[1].lower()
        for token in (m[2] or m[3] or m[4] or "").split():
            parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+", token)]
            if kind == "role":
                if token.lower() in ROLES:
                    return "never"
            elif NEGATIONS.intersection(parts) or not MARKS.intersection(parts):
                continue
            elif len(parts) == 1 or len(parts) <= 3 and SURE.intersection(parts):
                said = "sure"
            else:
                said = said or "open"
    return said


def place(tag: str, rest: str, now: int) -> int:
    """Where what an element holds stands, if the element itself stands at `now`. The page's main element is never lost in a mark around it."""
    inside = now in (ARTICLE, OPEN_ARTICLE)
    if tag == "main":
        return ARTICLE if now != NEVER else NEVER
    if now in (NEVER, MARKED) or tag in HEADINGS or tag in ("body", "html"):
        return now
    if tag in FURNITURE or tag == "header" and not inside:
        return NEVER
    said = "" if tag == "header" else named(rest)
    if said == "never":
        return NEVER
    if said == "sure":
        return MARKED
    if tag == "article":
        return ARTICLE
    if said == "open":
        return OPEN_ARTICLE if inside else OPEN_ELSEWHERE
    return now


def lines(page: str | None) -> list[tuple[str, int]]:
    """Blocks of text in page order with where they stand (see ARTICLE and the others).

    White space inside a block is one space, character references are decoded, empty blocks are left out. Unclosed and
    cut elements are allowed: furniture ends with its own end tag, or with one of an element around it. An inline element
    that is furniture is a block of its own. A "/" before ">" ends no HTML element, and may belong to an unquoted value.
    """
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []
    now, at, skipping, page = 0, 0, "", page or ""

    def close() -> None:
        block = SPACE.sub(" ", html.unescape("".join(text))).strip()
        text.clear()
        if block:
            out.append((block, now))

    for m in TOKEN.finditer(page):
        if not skipping:
            text.append(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None and not skipping:
            text.append(html.escape(m["cdata"], quote=False))
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if skipping:
            if m["end"] and tag == skipping:
                skipping = ""
            continue
        if m["end"]:
            if tag not in INLINE:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if stack[i][1] != now:
                        close()
                    now = stack[i][1]
                    del stack[i:]
                    break
            continue
        if tag in SKIPPED:
            if tag not in FOREIGN or not SLASH.search(m["rest"]):
                skipping = tag
            continue
        if tag == "br":
            text.append(" ")
        if tag not in INLINE:
            close()
        if tag in VOID:
            continue
        if tag in PARAGRAPH_ENDS and stack and stack[-1][0] == tag:  # a new paragraph ends an open one
            now = stack.pop()[1]
        then = place(tag, m["rest"], now)
        if tag in INLINE and (then == now or then not in (MARKED, NEVER)):
            continue
        stack.append((tag, now))
        if then != now:
            close()
            now = then
    if not skipping:
        text.append(page[at:])
    close()
    return out


def common_lines(a: list, b: list) -> list[bool]:
    """Which lines of a are in a longest common subsequence of a and b.

    Equal ends are matched first and lines that stand in one side only are left out; what remains is solved by rows of
    lengths kept as integers' bits (Hyyro, 2004), so time is the product of the lengths over the word size.
    """
    kept = [False] * len(a)
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        kept[head] = True
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        kept[len(a) - 1 - tail] = True
        tail += 1
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    rows = [i for i in range(head, len(a) - tail) if a[i] in both]
    columns = [j for j in range(head, len(b) - tail) if b[j] in both]
    if not rows:
        return kept
    where: dict = {}
    for bit, i in enumerate(rows):
        where[a[i]] = where.get(a[i], 0) | 1 << bit
    full = (1 << len(rows)) - 1
    v, history = full, []
    for j in columns:
        history.append(v)
        u = v & where[b[j]]
        v = (v + u | v - u) & full
    i, j = len(rows) - 1, len(columns) - 1
    history.append(v)
    while i >= 0 and j >= 0:  # a zero bit is a step of the length in that column
        if history[j + 1] >> i & 1:
            i -= 1
        elif not history[j] >> i & 1:
            j -= 1
        else:
            kept[rows[i]] = True
            i, j = i - 1, j - 1
    return kept


def shared_lines(mine: list[int], partner: list[int] | None) -> list[int]:
    """Numbers of the lines that a page shares with its partner: those of a longest common subsequence."""
    return [i for i, s in enumerate(common_lines(mine, partner)) if s] if partner is not None else []


def pick(blocks: list[tuple[str, int]], shared: list[int]) -> tuple[str, int, int]:
    """(text, blocks, blocks deleted as shared) of a page's blocks, given those that it shares with its partner.

    Elements that are furniture by their kind or by a sure mark go. The partner decides on the rest: a block below an open mark goes if
    it is shared, in the article as elsewhere, and outside the article so does every shared block. What the page's article or main element
    holds without a mark stays: two articles of a host may well have a line in common. Own blocks outside the article stay out, unless they are
    longer than what it holds: then it is a teaser. Should nothing be left, the blocks below marks that are
    not shared stay; and if all is shared, the two pages are copies, and the blocks stay that are not furniture.
    """
    gone = set(shared)
    size = lambda kept: sum(len(blocks[i][0]) for i in kept)
    at = lambda *where: [i for i, (_, mark) in enumerate(blocks) if mark in where]
    mine = lambda some: [i for i in some if i not in gone]
    declared = sorted(at(ARTICLE) + mine(at(OPEN_ARTICLE)))
    own = mine(at(ELSEWHERE, OPEN_ELSEWHERE))
    kept = sorted(declared + own) if size(own) > size(declared) else declared
    kept = kept or own or mine(at(MARKED)) or at(ELSEWHERE, OPEN_ARTICLE) or at(OPEN_ELSEWHERE)
    left = set(kept)
    return " ".join(blocks[i][0] for i in kept), len(blocks), sum(i not in left for i in gone if blocks[i][1] not in (MARKED, NEVER))


def main_text(page: str | None, partner: str | None) -> tuple[str, int, int]:
    """pick() for raw pages."""
    mine = lines(page)
    return pick(mine, shared_lines([t for t, _ in mine], [t for t, _ in lines(partner)] if partner is not None else None))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    """Path, query and fragment of a URL."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*", "")


def walk(rows: list[tuple]) -> Iterator[tuple[tuple[int, int], list[int]]]:
    """(name, shared lines) of the pages (host, path, id, name, lines, own) in order, where lines are shared.

    Equal pages in a row are one; its partner is the page before, or else after, on its host.
    """
    rows = sorted(rows, key=lambda r: r[:4])
    runs: list[list[tuple]] = []
    for r in rows:
        if runs and runs[-1][-1][0] == r[0] and runs[-1][-1][4] == r[4]:
            runs[-1].append(r)
        else:
            runs.append([r])
    for i, run in enumerate(runs):
        near = next((runs[j][0][4] for j in (i - 1, i + 1) if 0 <= j < len(runs) and runs[j][0][0] == run[0][0]), None)
        if near is not None and (shared := shared_lines(run[0][4], near)):
            for name in {r[3] for r in run if r[5]}:
                yield name, shared


def partners(named: DataFrame, page: str) -> DataFrame:
    """(name, shared): the lines that a page shares with its nearest by URL path, for pages that share any.

    Only hashes of lines move: each page's to its range of (host, path, id), so a host with a third of all pages is spread
    out; ranges grow in number with the pages. The first and last page of each range also go to the ranges beside it.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in lines(x.as_py())] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["at", "lines"])

    place = F.struct("host", "path", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "name")
    narrow = named.select(place.alias("at"), F.col(page)).mapInArrow(digests, "at struct<host:string,path:string,id:string,name:struct<x:bigint,y:bigint>>, lines array<long>")
    ranges = max(parts(named.sparkSession), named.count() // RANGE_ROWS + 1)
    placed = materialize(narrow.repartitionByRange(ranges, "at").withColumn("part", F.spark_partition_id()), "html-lines")
    row = F.struct("at", "lines")
    ends = placed.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    beside = Window.orderBy("part")  # one row a range
    ends = ends.select(F.lag("part").over(beside).alias("below"), F.lead("part").over(beside).alias("above"), "first", "last")
    ends = ends.select(F.explode(F.array(F.struct(F.col("below").alias("part"), F.col("first").alias("r")), F.struct(F.col("above").alias("part"), F.col("last").alias("r")))).alias("e"))
    ends = ends.filter("e.part IS NOT NULL").select("e.r.at", "e.r.lines", "e.part", F.lit(False).alias("own"))
    both = placed.withColumn("own", F.lit(True)).unionByName(ends)

    def compare(table: pa.Table) -> pa.Table:
        at = table["at"].to_pylist()
        rows = [(a["host"], a["path"], a["id"], (a["name"]["x"], a["name"]["y"]), said, own) for a, said, own in zip(at, table["lines"].to_pylist(), table["own"].to_pylist())]
        found = list(walk(rows))
        return pa.table({"x": pa.array([n[0] for n, _ in found], pa.int64()), "y": pa.array([n[1] for n, _ in found], pa.int64()), "shared": pa.array([s for _, s in found], pa.list_(pa.int32()))})

    shared = materialize(both.groupBy("part").applyInArrow(compare, "x long, y long, shared array<int>").dropDuplicates(["x", "y"]), "html-shared")
    discard(placed)
    return shared


def extract(pages: DataFrame, page: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """key, url, text, n_chars, n_blocks and n_shared (blocks deleted as shared) of every page.

    Each page is compared with the page nearest by URL path within its host: the one before in path order that differs
    from it, or for a host's first the one after. A first pass over whole pages leaves hashes of lines, which are put in
    order and compared; then the pages that share lines get the numbers of these, and a second pass takes their text.
    A host's only page has no partner and goes by its landmarks. Null html is empty; null URLs are one host; repeated rows
    each get their text, the same one. Pages may be of any length; a task holds one batch of pages, and the line hashes of
    one range. Should equal pages fill a range, their partner is sought in the ranges beside it only. Other columns are
    not read, so their names don't matter. An empty table gives no rows.
    """
    rows = null_safe(pages, key, url, page).toDF("id", "url", "page")
    name = F.struct(F.xxhash64("id", "url", "page").alias("x"), F.xxhash64(F.lit(7), "id", "url", "page").alias("y"))
    named = rows.withColumn("name", name).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    shared = partners(named, "page").withColumnsRenamed({"x": "nx", "y": "ny"})
    sent = named.join(shared, (F.col("name.x") == F.col("nx")) & (F.col("name.y") == F.col("ny")), "left").select("id", "url", "page", "shared")
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pick(lines(p.as_py()), s.as_py() or []) for p, s in zip(batch.column(2), batch.column(3))]
            texts, blocks, deleted = zip(*found) if found else [()] * 3
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in (map(len, texts), blocks, deleted))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, url, "text", "n_chars", "n_blocks", "n_shared"])

    return sent.mapInArrow(run, f"`{key}` {kind}, `{url}` string, text string, n_chars long, n_blocks long, n_shared long")
