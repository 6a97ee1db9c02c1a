"""Word and PowerPoint bodies from their XML: paragraphs, headings, table rows and slides as units with offsets."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from quillspark.functions.evidence import TOTALS

#: Limits of what is read of a document or a deck. Fixed values.
MAX_PARAGRAPHS, MAX_TABLES, MAX_TABLE_ROWS, MAX_TABLE_COLUMNS, MAX_SLIDES = 200, 20, 50, 12, 50
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def tag(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def attribute(element: ElementTree.Element, name: str) -> str:
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), "")


def text_of(paragraph: ElementTree.Element) -> str:
    """Text of a paragraph: runs joined, tabs and line breaks as such."""
    marks = {"tab": "\t", "br": "\n", "cr": "\n"}
    return "".join((e.text or "") if tag(e) == "t" else marks.get(tag(e), "") for e in paragraph.iter())


def cell_text(cell: ElementTree.Element) -> str:
    """Text of a table cell as one line, bars escaped."""
    lines = [text_of(p) for p in cell.iter() if tag(p) == "p"]
    return " ".join(" ".join(lines).split("\n")).replace("|", "\\|").strip()


def related(book: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """(kind, target) by id of what a part refers to."""
    folder, name = posixpath.split(part)
    path = f"{folder}/_rels/{name}.rels"
    if path not in book.namelist():
        return {}
    full = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
    return {e.get("Id"): (e.get("Type", "").rpartition("/")[2], full(e.get("Target", ""))) for e in ElementTree.fromstring(book.read(path))}


def ordered(book: zipfile.ZipFile, part: str, name: str) -> list[str]:
    """Parts that a presentation or workbook lists under `name` elements, in its own order."""
    links = related(book, part)
    found = [links.get(e.get(RELATION, ""), ("", ""))[1] for e in ElementTree.fromstring(book.read(part)).iter() if tag(e) == name]
    return [f for f in found if f in book.namelist()]


def docx_units(raw: bytes, limited: bool = True) -> Iterator[tuple[str, str] | None]:
    """(kind, line) of paragraphs and table rows in order; None where a limit leaves something out."""
    body = next(e for e in ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")) if tag(e) == "body")
    paragraphs = tables = 0
    for element in body:
        if tag(element) == "p":
            paragraphs += 1
            if limited and paragraphs > MAX_PARAGRAPHS:
                yield None
                continue
            style = next((attribute(e, "val") for e in element.iter() if tag(e) == "pStyle"), "").lower()
            level = 1 if style == "title" else int(style.removeprefix("heading") or 1) if style.removeprefix("heading").isdigit() else 0
            if (text := text_of(element)).strip():
                yield ("heading", "#" * level + " " + text) if level else ("paragraph", text)
        elif tag(element) == "tbl":
            tables += 1
            rows = [[cell_text(c) for c in r if tag(c) == "tc"] for r in element if tag(r) == "tr"]
            if limited and tables > MAX_TABLES:
                yield None
                continue
            yield "heading", f"## Table {tables}"
            for i, cells in enumerate(rows):
                if limited and (i >= MAX_TABLE_ROWS or len(cells) > MAX_TABLE_COLUMNS):
                    yield None
                if any(cells) and (not limited or i < MAX_TABLE_ROWS):
                    line = f"| {' | '.join(cells[:MAX_TABLE_COLUMNS] if limited else cells)} |"
                    yield ("table_header" if i == 0 else "total" if any(w in line for w in TOTALS[:2]) else "table_row"), line


def pptx_units(raw: bytes, limited: bool = True, notes: bool = True) -> Iterator[tuple[str, str] | None]:
    """(kind, line) of slides in the deck's order, notes after the slide; None where a limit leaves slides out."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    for n, slide in enumerate(ordered(book, "ppt/presentation.xml", "sldId")):
        if limited and n >= MAX_SLIDES:
            yield None
            return
        yield "heading", f"## Slide {n + 1}"
        pages = [slide, *(t for kind, t in related(book, slide).values() if notes and kind == "notesSlide" and t in book.namelist())]
        for page in pages:
            for p in ElementTree.fromstring(book.read(page)).iter():
                if tag(p) == "p" and (text := text_of(p)).strip():
                    yield "slide", text


def parsed(units: Iterator[tuple[str, str] | None], most: int) -> tuple:
    """(content, truncated, encoding, warning, units) of units joined by line ends; a unit that does not fit is left out."""
    lines, spans, at, cut = [], [], 0, False
    for unit in units:
        if unit is None or at + len(unit[1]) > most:
            cut = True
            continue
        lines.append(unit[1])
        spans.append((unit[0], at, at + len(unit[1])))
        at += len(unit[1]) + 1
    return ("\n".join(lines), cut, "utf-8", None, spans)


def parse_office(kind: str, raw: bytes, most: int, limited: bool = True) -> tuple:
    """parsed() of a docx or pptx; a broken one gives a warning."""
    try:
        return parsed((docx_units if kind == "docx" else pptx_units)(raw, limited), most)
    except (zipfile.BadZipFile, KeyError, ValueError, StopIteration, RuntimeError, ElementTree.ParseError) as e:
        return ("", False, None, f"{kind}_{type(e).__name__}", [])


def docx_of(lines: list[str]) -> bytes:
    """A minimal DOCX with a paragraph a line; control characters, which XML can't hold, are left out."""
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    root = ElementTree.Element(f"{{{space}}}document")
    body = ElementTree.SubElement(root, f"{{{space}}}body")
    for line in lines:
        run = ElementTree.SubElement(ElementTree.SubElement(body, f"{{{space}}}p"), f"{{{space}}}r")
        ElementTree.SubElement(run, f"{{{space}}}t").text = "".join(c for c in line if c >= " ")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("word/document.xml", ElementTree.tostring(root, "utf-8", xml_declaration=True))
    return out.getvalue()
