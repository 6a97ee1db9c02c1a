"""Behaviour of operators on small adversarial inputs."""

import random
import zipfile
from io import BytesIO

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import diff, windows
from quillspark.plans import admission
from quillspark.sources import files as sources
from quillspark.sources import sinks
from quillspark.streaming import daily


def test_first_fit_skips_and_goes_on(spark):
    rows = [("r", i + 1, f"f{i}", c, False) for i, c in enumerate([5, 9, 2, 7, 1])]
    d = spark.createDataFrame(rows, "run_id string, rank int, file_identity string, cost long, needs_extraction boolean")
    got = {r.file_identity: r.admit_action for r in admission.first_fit(d, 10, 8).collect()}
    assert [got[f"f{i}"] == "admit" for i in range(5)] == [True, False, True, False, True]


def test_extraction_slot_is_spent_by_admission_only(spark):
    rows = [("r", 1, "a", 20, True), ("r", 2, "b", 5, True), ("r", 3, "c", 5, True)]
    d = spark.createDataFrame(rows, "run_id string, rank int, file_identity string, cost long, needs_extraction boolean")
    got = {r.file_identity: r.admit_action for r in admission.first_fit(d, 10, 1).collect()}
    assert got == {"a": "global_context_budget_exceeded", "b": "admit", "c": "pdf_text_extraction_quota_exhausted"}


def test_pdf_without_pages_costs_no_slot(spark):
    rows = [("r", 1, "a", "pdf", 9), ("r", 2, "b", "pdf", 9), ("r", 3, "c", "light_text", 1)]
    d = spark.createDataFrame(rows, "run_id string, rank int, file_identity string, route string, page_count long")
    got = {r.file_identity: r.slot_action for r in admission.candidate_slots(d, 2, 10).collect()}
    assert got == {"a": "slot", "b": "pdf_page_quota_exhausted", "c": "slot"}


@pytest.mark.parametrize("count", range(0, 12))
def test_page_sampling(spark, count):
    def want(n, most):
        limit = min(n, most)
        pages = list(range(1, min(limit, 2) + 1))
        if len(pages) < limit and n not in pages:
            pages.append(n)
        left = limit - len(pages)
        pages += [p for i in range(1, left + 1) if (p := 1 + (n - 1) * i // (left + 1)) not in pages]
        return (list(dict.fromkeys(pages)) + [p for p in range(1, n + 1) if p not in pages])[:limit]

    d = spark.range(1).select(*(text.sample_pages(F.lit(count).cast("long"), m).alias(f"m{m}") for m in (1, 2, 3, 5, 8)))
    assert list(d.first()) == [want(count, m) for m in (1, 2, 3, 5, 8)]


def test_page_sampling_example(spark):
    assert spark.range(1).select(text.sample_pages(F.lit(8).cast("long"), 5)).first()[0] == [1, 2, 8, 3, 5]


def test_head_and_tail_fits_its_limit(spark):
    rows = [("x" * n + "\n" * (n % 7) + "yz\n" * n,) for n in (0, 10, 300, 900)]
    d = spark.createDataFrame(rows, "t string").select("t", text.head_and_tail(F.col("t"), 200).alias("h"), text.log_tail(F.col("t"), 200).alias("l"))
    assert all(len(r.l) <= 200 and (len(r.t) <= 200 or len(r.h) <= 200) for r in d.collect())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=12), st.lists(st.sampled_from("abcde"), max_size=12))
def test_hunks_turn_one_version_into_the_other(a, b):
    out, at = [], 0
    for p, q, r, s in diff.hunks(a, b):
        out += a[at:p] + b[r:s]
        at = q
    assert out + a[at:] == b


def test_islands_and_cover(spark):
    random.seed(3)
    rows = [(1, s, s + random.randrange(1, 9)) for s in (random.randrange(60) for _ in range(30))]
    d = spark.createDataFrame(rows, "k int, start long, end long")
    cover = {i for _, s, e in rows for i in range(s, e)}
    assert windows.covered(d, ["k"]).first().covered == len(cover)


def test_sources(spark):
    sheet = '<worksheet><sheetData><row><c t="s"><v>1</v></c><c><v>2.5</v></c></row></sheetData></worksheet>'
    book = BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook/>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>no</t></si><si><t>name</t></si></sst>")
    cases = {
        "a.txt": "﻿hé".encode(), "b.log": ("x" * 500).encode(), "c.csv": b'h,"a\nb"\n1,2\n', "d.csv": b"a\rb", "e.csv": "名,1".encode("gb18030"), "f.json": b'{"b": NaN, "a": 1}',
        "g.json": b"{", "h.xlsx": book.getvalue(), "i.pdf": b"%PDF", "j.docx": b"nothing", "k.json": b"[1,2]", "l.txt": None,
    }
    d = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in cases.items()], "path string, content binary")
    got = {r.path: r for r in sources.parse(d, most=100).collect()}
    assert got["a.txt"].content == "hé" and got["b.log"].truncated and len(got["b.log"].content) == 100
    assert got["c.csv"].content == "h | a b\n1 | 2" and got["d.csv"].warning == "csv_lone_cr" and got["e.csv"].encoding == "gb18030"
    assert got["f.json"].content == "object: a, b" and got["g.json"].warning == "json_invalid" and got["k.json"].content == "array: 2"
    assert got["h.xlsx"].content == "name | 2.5" and got["i.pdf"].warning == "no_parser:.pdf" and got["j.docx"].warning == "no_parser:not_an_office_container" and got["l.txt"].content == ""


def test_discovery(spark, tmp_path):
    for name in ("b.txt", "a.md", "skip/x.txt", "c.bin", "~tmp.txt"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("hello")
    d = sources.discover(spark, str(tmp_path), (".txt", ".md"), ("~*",), ("skip",)).collect()
    got = {r.path.split(str(tmp_path) + "/")[1]: r.issue for r in d}
    assert got == {"b.txt": None, "a.md": None, "skip/x.txt": "excluded_dir", "c.bin": "extension_not_allowed", "~tmp.txt": "ignored_pattern"}


def test_notes_merge(spark):
    d = spark.createDataFrame([(1, "a\r\n\r\nb", "b\n\nc"), (2, None, "x")], "k int, p string, q string")
    assert {r.k: r.notes for r in sources.merged_notes(d, "k", ["p", "q"]).collect()} == {1: "a\n\nb\n\nc", 2: "x"}


def test_backup_is_verified(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "t"))
    assert sinks.backup(spark, {"t": str(tmp_path / "t")}, str(tmp_path / "out")) == {"t": True}


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    src = str(tmp_path / "in")
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartitionByRange(3, "ts").write.parquet(src)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema)
    for _ in range(2):  # the second run finds nothing new and repeats nothing
        days = daily.day_windows(daily.paged_scan(spark, src, schema), late=None)
        daily.publish_days(days, str(tmp_path / "out"), str(tmp_path / "cp"), late=True).awaitTermination()
    got = {(str(r.day), r.n, r.errors, r.centi) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.day, r.n, r.errors, r.centi) for r in daily.day_windows(e).collect()}
