"""Word, PowerPoint and Excel bodies from packages built here, and packing of sources."""

import io
import random
import zipfile
from collections import defaultdict

from quillspark.operators import batches
from quillspark.sources import files, office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def rels(**targets):
    return f"<Relationships>{''.join(f'<Relationship Id=\"{k}\" Type=\"http://x/{kind}\" Target=\"{t}\"/>' for k, (kind, t) in targets.items())}</Relationships>"


def test_docx_paragraphs_headings_and_tables():
    p = lambda text, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"
    body = p("Title", "Title") + p("One", "Heading2") + p("plain &amp; text") + p(" ") + f"<w:tbl>{row('a', 'b|c')}{row('', '')}{row('合计', '5')}{row('x', 'y')}</w:tbl>" + p("end")
    raw = package(**{"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})
    content, cut, _, warning, units = office.parse_office("docx", raw, 1000)
    assert content.split("\n") == ["# Title", "## One", "plain & text", "## Table 1", "| a | b\\|c |", "| 合计 | 5 |", "| x | y |", "end"] and not cut and warning is None
    assert [k for k, *_ in units] == ["heading", "heading", "paragraph", "heading", "table_header", "total", "table_row", "paragraph"]
    assert all(content[a:b] == line for (_, a, b), line in zip(units, content.split("\n")))
    many = office.docx_of([f"line {i}" for i in range(250)])
    assert len(office.parse_office("docx", many, 10**6)[4]) == 200 and office.parse_office("docx", many, 10**6)[1]
    assert len(office.parse_office("docx", many, 10**6, limited=False)[4]) == 250
    assert office.parse_office("docx", raw[:50], 10)[3].startswith("docx_")


def test_pptx_slides_come_in_the_order_of_the_deck():
    slide = lambda *texts: f'<p:sld xmlns:p="p" xmlns:a="a">{"".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in texts)}</p:sld>'
    raw = package(**{
        "ppt/presentation.xml": f'<p:presentation xmlns:p="p" {R}><p:sldIdLst><p:sldId r:id="b"/><p:sldId r:id="a"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(a=("slide", "slides/slide1.xml"), b=("slide", "/ppt/slides/slide2.xml")),
        "ppt/slides/slide1.xml": slide("first", " "), "ppt/slides/slide2.xml": slide("second", "more"),
        "ppt/slides/_rels/slide2.xml.rels": rels(n=("notesSlide", "../notesSlides/n.xml")), "ppt/notesSlides/n.xml": slide("note"),
    })
    assert office.parse_office("pptx", raw, 1000)[0].split("\n") == ["## Slide 1", "second", "more", "note", "## Slide 2", "first"]
    assert files.parse_one(".pptx", raw, 1000)[0].startswith("## Slide 1")


def test_sheets_come_in_the_order_of_the_workbook():
    sheet = lambda v: f"<worksheet><sheetData><row><c><v>{v}</v></c></row></sheetData></worksheet>"
    raw = package(**{
        "xl/workbook.xml": f'<workbook {R}><sheets><sheet name="b" r:id="y"/><sheet name="a" r:id="x"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels(x=("worksheet", "worksheets/sheet1.xml"), y=("worksheet", "worksheets/sheet2.xml")),
        "xl/worksheets/sheet1.xml": sheet(1), "xl/worksheets/sheet2.xml": sheet(2),
    })
    assert files.parse_xlsx(raw, 100)[0] == "2\n1"


def test_packed_sources_keep_the_limits_and_place_first_entries_first(spark):
    rng = random.Random(2)
    rows = [(f"r{i % 3}", f"s{i % 17}", "k" + str(i % 17 % 2), 0, 0) for i in range(120)]
    seen = defaultdict(int)
    for n, (r, s, k, _, _) in enumerate(rows):
        rows[n] = (r, s, k, seen[r, s], rng.randrange(1, 400))
        seen[r, s] += 1
    got = {(x.r, x.s, x.d): x.batch for x in batches.packed_sources(spark.createDataFrame(rows, "r string, s string, k string, d int, n long"), "r", "s", "k", "d", "n", 3, 1000, 5).collect()}
    size, sources = defaultdict(int), defaultdict(set)
    for r, s, _, d, n in rows:
        if got[r, s, d] is not None:
            size[r, got[r, s, d]] += n
            sources[r, got[r, s, d]].add(s)
    assert len(got) == len(rows) and max(size.values()) <= 1000 and max(map(len, sources.values())) <= 3 and max(b for b in got.values() if b is not None) <= 4
    for r in ("r0", "r1", "r2"):  # deeper entries get a place only after all firsts had theirs
        firsts = [got[r, s, 0] for q, s, _, d, _ in rows if q == r and d == 0]
        assert sum(b is not None for b in firsts) >= min(len(firsts), 5)


def test_a_reduced_batch_gives_every_source_a_unit_first():
    assert batches.reduced_batch([("a", [10, 20, 600]), ("b", [15, 30]), ("a", [5])], 50) == [20, 30, 0]
    assert batches.reduced_batch([("a", [10, 20]), ("b", [45])], 50) == [20, 0] and batches.reduced_batch([("a", []), ("b", [9])], 4) == [0, 0]
    rng = random.Random(4)
    for _ in range(200):
        entries = [(rng.choice("abc"), sorted(rng.sample(range(1, 700), rng.randrange(6)))) for _ in range(rng.randrange(6))]
        limit = rng.randrange(1, 900)
        cut = batches.reduced_batch(entries, limit)
        assert sum(cut) <= limit and all(c == 0 or c in e and (c <= 512 or c == e[0]) for c, (_, e) in zip(cut, entries))
        assert len({s for c, (s, _) in zip(cut, entries) if c}) == sum(c > 0 for c in cut)


def test_fair_rows_give_each_sheet_its_first_row_and_keep_the_room():
    rows = [("table_header", 5), ("table_row", 10), ("table_row", 10), ("total", 10)]
    assert batches.fair_rows([(4, rows), (4, rows)], 1000) == [{0, 1, 2, 3}] * 2
    assert batches.fair_rows([(4, rows), (4, rows)], 40) == [{0, 1}, {0, 1}] and batches.fair_rows([(4, rows), (4, rows)], 60) == [{0, 1, 3}, {0, 1, 3}]
    rng = random.Random(5)
    for _ in range(200):
        sheets = [(3, [(rng.choice(["table_row", "total", "table_header", "placeholder"]), rng.randrange(1, 20)) for _ in range(rng.randrange(8))]) for _ in range(rng.randrange(4))]
        room = rng.randrange(120)
        got = batches.fair_rows(sheets, room)
        assert sum(sum(r[n][1] for n in c) + (h + 1 if c else 0) for c, (h, r) in zip(got, sheets)) <= room
        assert all({m for m in range(n) if r[m][0] == "table_header"} <= c for c, (_, r) in zip(got, sheets) for n in c)
