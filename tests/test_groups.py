"""Folds over many small keys: one stream a partition, not a table a key."""

import time

import pytest

from quillspark import catalog
from quillspark.operators import batches, composition, groups

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["composed_matters", "packed_ranges", "fair_sheet_rows", "packed_sources", "reduced_batches"])
def test_keys_of_a_partition_are_one_stream(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "GroupsInPandas" not in plan


def test_folds_get_whole_keys_in_order_with_nulls_last(spark):
    rows = [(k if k % 50 else None, n, None if n == 3 else f"t{n}") for k in range(3000) for n in (3, 1, 2)]
    d = spark.createDataFrame(rows, "k long, n int, t string").repartition(7)
    got = {r.k: (r.all, r.n) for r in groups.folded(d, "k", ["t"], lambda g: [(g[0][0], ",".join(str(x[2]) for x in g), len(g))], "k long, all string, n int").collect()}
    assert len(got) == 2941 and all(v == ("t1,t2,None", 3) for k, v in got.items() if k is not None)
    assert got[None][1] == 180 and got[None][0].endswith("t2," + "None," * 59 + "None")
    assert groups.folded(d.filter("false"), "k", ["t"], lambda g: [(1, "", 1)], "k long, all string, n int").collect() == []


def test_reports_without_facts_and_facts_without_reports(spark):
    items = [("r", 0, 0, "detail", 0, "m", " t ", "said", ["f"]), ("q", 0, 0, "pending", 0, None, None, "open", None), (None, 0, 0, "detail", 0, None, None, "lost", ["f"])]
    items = spark.createDataFrame(items, "report string, part int, place int, slot string, matter int, matter_id string, title string, text string, fact_ids array<string>")
    facts = spark.createDataFrame([("r", "f", "m", None), ("s", "f", "m", "x"), (None, "f", "m", "x")], "report string, fact_id string, matter_id string, text string")
    got = {(r.report, r.slot, r.place, r.matter, r.matter_id, r.title, r.text, tuple(r.fact_ids)) for r in composition.merged(items, facts).collect()}
    assert got == {("r", "overview", 0, None, None, None, "said", ("f",)), ("r", "detail", 1, 0, "m", "t", "said", ("f",)), ("q", "pending", 0, None, None, None, "open", ())}


def test_fair_rows_take_time_in_proportion_to_the_rows():
    rows = [("table_header" if n % 4 == 0 else "total" if n % 7 == 0 else "table_row", 3) for n in range(40_000)]
    began = time.process_time()
    chosen = batches.fair_rows([(4, rows), (4, rows)], 180_000)
    assert time.process_time() - began < 5
    costs = [5 + 3 * len(c) for c in chosen]
    assert sum(costs) <= 180_000 < sum(costs) + 6 and all({m for m in range(max(c)) if m % 4 == 0} <= c for c in chosen)
