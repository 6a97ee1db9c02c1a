"""File sources: discovery with issues, bounded heads and tails, CSV and JSON previews, office containers, sheets."""

from __future__ import annotations

import codecs
import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import rules
from quillspark.sources import office

#: Read limits and preview sizes. Fixed values.
FIELD_LIMIT, PREVIEW_ROWS, MAX_SHEETS, MAX_ROWS, MAX_COLUMNS = 131_072, 3, 5, 200, 50
PIECE = 1 << 20
UNITS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text_start", T.LongType()), T.StructField("text_end", T.LongType())]))
PARSED = T.StructType([T.StructField("content", T.StringType()), T.StructField("truncated", T.BooleanType()), T.StructField("encoding", T.StringType()), T.StructField("warning", T.StringType()), T.StructField("units", UNITS)])


def discover(spark: SparkSession, root: str, extensions: tuple[str, ...], ignore: tuple[str, ...] = (), excluded: tuple[str, ...] = (), after: str | None = None, before: str | None = None) -> DataFrame:
    """(path, size_bytes, modified_at, issue) below root in path order; what a rule rejects has its issue instead.

    Only metadata is read: `content` is pruned from the scan, and time windows are pushed into the listing.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    for option, value in (("modifiedAfter", after), ("modifiedBefore", before)):
        if value:
            reader = reader.option(option, value)
    f = reader.load(root).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    name = F.element_at(F.split("path", "/"), -1)
    issue = rules.first_match(
        [(~rules.allowed_extension(name, extensions), "extension_not_allowed"), (rules.ignored(name, ignore) if ignore else F.lit(False), "ignored_pattern"), (rules.excluded_dir(F.col("path"), excluded, ()), "excluded_dir")],
        F.lit(None).cast("string"),
    )
    return f.withColumn("issue", issue).orderBy("path")


def decode_head(raw: bytes, limit: int) -> tuple[str, bool]:
    """The first bytes as UTF-8 text, without a letter that the cut broke."""
    cut = len(raw) > limit
    text = raw[:limit].removeprefix(b"\xef\xbb\xbf").decode("utf-8", "ignore" if cut else "replace")
    return text, cut


def decode_tail(raw: bytes, limit: int) -> tuple[str, bool]:
    """The last bytes as text, from the first whole letter on."""
    cut = len(raw) > limit
    part = raw[-limit:] if cut else raw
    while cut and part and part[0] & 0xC0 == 0x80:
        part = part[1:]
    return part.decode("utf-8", "replace"), cut


def csv_lines(raw: bytes) -> tuple[Iterator[str], str | None]:
    """Lines of CSV bytes, decoded a piece at a time, and the encoding; None if it is neither UTF-8 nor GB18030."""
    for encoding in ("utf-8-sig",) if raw.startswith(b"\xef\xbb\xbf") else ("utf-8", "gb18030"):
        decoder = codecs.getincrementaldecoder(encoding)()
        try:
            for at in range(0, len(raw), PIECE):
                decoder.decode(raw[at : at + PIECE])
            decoder.decode(b"", final=True)
        except UnicodeDecodeError:
            continue
        return io.TextIOWrapper(io.BytesIO(raw), encoding, newline=""), encoding
    return iter(()), None


def parse_csv(raw: bytes, most: int) -> tuple:
    """Header and three rows shown, every row audited; a lone CR, an open quote or a huge field is an error.

    Rows are read one by one from pieces of the file, and only those that are shown are kept.
    """
    text, encoding = csv_lines(raw)
    if encoding is None:
        return ("", False, None, "csv_encoding", [])
    wide = re.compile(rb"\r(?!\n)")  # neither encoding has a CR inside a letter
    if wide.search(raw):
        return ("", False, encoding, "csv_lone_cr", [])
    csv.field_size_limit(FIELD_LIMIT)
    shown, units, at, count = [], [], 0, 0
    try:
        for row in csv.reader(text, strict=True):
            if count <= PREVIEW_ROWS:
                line = " | ".join(cell.replace("\n", " ") for cell in row)
                units.append(("header" if count == 0 else "row", at, at + len(line)))
                shown.append(line)
                at += len(line) + 1
            count += 1
    except csv.Error:
        return ("", False, encoding, "csv_malformed", [])
    content = "\n".join(shown)
    return (content[:most], len(content) > most or count > len(shown), encoding, None, [u for u in units if u[2] <= most])


def parse_json(raw: bytes, most: int) -> tuple:
    """Sorted keys of an object, or kind and length; NaN and infinities are allowed; what is no JSON is text."""
    text = raw.decode("utf-8", "replace")
    try:
        value = json.loads(text)
    except ValueError:
        return (text[:most], len(text) > most, "utf-8", "json_invalid", [("text", 0, min(len(text), most))])
    if isinstance(value, dict):
        shown = "object: " + ", ".join(sorted(value))
    elif isinstance(value, list):
        shown = f"array: {len(value)}"
    else:
        shown = f"scalar: {type(value).__name__}"
    return (shown[:most], len(shown) > most, "utf-8", None, [("summary", 0, min(len(shown), most))])


def parse_text(raw: bytes, most: int, tail: bool) -> tuple:
    text, cut = decode_tail(raw, 4 * most) if tail else decode_head(raw, 4 * most)
    kept = text[-most:] if tail else text[:most]
    return (kept, cut or len(text) > most, "utf-8", None, [("text", 0, len(kept))])


def office_format(raw: bytes) -> str:
    """The one format of an office container by its signature and members, or why there is none."""
    if raw[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        return "legacy_compound"
    if raw[:4] != b"PK\x03\x04":
        return "not_an_office_container"
    try:
        names = zipfile.ZipFile(io.BytesIO(raw)).namelist()
    except zipfile.BadZipFile:
        return "broken_container"
    found = [kind for kind, part in (("docx", "word/document.xml"), ("pptx", "ppt/presentation.xml"), ("xlsx", "xl/workbook.xml")) if part in names]
    return found[0] if len(found) == 1 else "ambiguous_container" if found else "unknown_container"


def parse_xlsx(raw: bytes, most: int) -> tuple:
    """The first sheets in the workbook's order (J24), their rows and columns as bar-separated lines; only the shared strings that they need are kept."""
    try:
        book = zipfile.ZipFile(io.BytesIO(raw))
        numbered = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        try:
            sheets = office.ordered(book, "xl/workbook.xml", "sheet")
        except ElementTree.ParseError:
            sheets = []
        sheets = (sheets or numbered)[:MAX_SHEETS]
        tag = lambda e: e.tag.rpartition("}")[2]
        rows, needed = [], set()
        for sheet in sheets:
            taken = 0
            for _, row in ElementTree.iterparse(book.open(sheet)):
                if tag(row) != "row" or taken >= MAX_ROWS:
                    continue
                cells = []
                for cell in [c for c in row if tag(c) == "c"][:MAX_COLUMNS]:
                    value = next((v.text or "" for v in cell if tag(v) == "v"), "".join(t.text or "" for t in cell.iter() if tag(t) == "t"))
                    if cell.get("t") == "s":
                        needed.add(int(value))
                    cells.append((cell.get("t"), value))
                rows.append(cells)
                taken += 1
        strings = {}
        if needed:
            for i, item in enumerate(e for _, e in ElementTree.iterparse(book.open("xl/sharedStrings.xml")) if tag(e) == "si"):
                if i in needed:
                    strings[i] = "".join(t.text or "" for t in item.iter() if tag(t) == "t")
        lines = [" | ".join(strings[int(v)] if kind == "s" else v for kind, v in cells) for cells in rows]
    except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as e:
        return ("", False, None, f"xlsx_{type(e).__name__}", [])
    content, at, units = "\n".join(lines), 0, []
    for line in lines:
        units.append(("row", at, at + len(line)))
        at += len(line) + 1
    return (content[:most], len(content) > most, "utf-8", None, [u for u in units if u[2] <= most])


def parse_one(extension: str, raw: bytes | None, most: int) -> tuple:
    """(content, truncated, encoding, warning, units); formats without a parser here are named, not guessed."""
    raw = bytes(raw or b"")
    if extension == ".csv":
        return parse_csv(raw, most)
    if extension == ".json":
        return parse_json(raw, most)
    if extension in (".txt", ".md", ".log"):
        return parse_text(raw, most, extension == ".log")
    if extension in (".xlsx", ".docx", ".pptx"):
        kind = office_format(raw)
        if kind in ("docx", "pptx"):
            return office.parse_office(kind, raw, most)
        return parse_xlsx(raw, most) if kind == "xlsx" else ("", False, None, f"no_parser:{kind}", [])
    return ("", False, None, f"no_parser:{extension}", [])


def parse(files: DataFrame, path: str = "path", content: str = "content", most: int = 100_000) -> DataFrame:
    """path and the parsed fields of each file; a one-row-in function over Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [parse_one(e, raw, most) for e, raw in zip(f["extension"], f["content"])]
            out = pd.DataFrame(rows, columns=[x.name for x in PARSED])
            out["units"] = [[{"kind": k, "text_start": a, "text_end": b} for k, a, b in u] for u in out["units"]]
            out.insert(0, "path", f["path"])
            yield out

    named = files.select(F.col(path).alias("path"), F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).alias("extension"), F.col(content).alias("content"))
    return named.mapInPandas(run, T.StructType([T.StructField("path", T.StringType()), *PARSED.fields]))


def merged_notes(notes: DataFrame, key: str, texts: list[str], most: int = 2000) -> DataFrame:
    """Texts of a row joined: line ends made one kind, paragraphs distinct in order of first sight, cut at `most`."""
    joined = F.concat_ws("\n\n", *(F.regexp_replace(F.coalesce(F.col(t), F.lit("")), "\r\n?", "\n") for t in texts))
    paragraphs = F.array_distinct(F.filter(F.transform(F.split(joined, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != ""))
    return notes.select(key, F.left(F.array_join(paragraphs, "\n\n"), F.lit(most)).alias("notes"))
