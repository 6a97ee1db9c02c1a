"""Steps whose cost or precision shows on large tables only."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark import catalog
from quillspark.functions import dates
from quillspark.operators import ledger, windows

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_nanoseconds_keep_their_microsecond(spark):
    micros = [1704067199999999, 1706000000999999, 0, -1, -1704067200000001, 9_000_000_000_000_000]
    d = spark.createDataFrame([(m, m * 1000 + n) for m in micros for n in (0, 1, 999)], "want long, ns long")
    assert d.filter(F.unix_micros(dates.ns_time(F.col("ns"))) != F.col("want")).count() == 0


def test_profiles_hold_numbers_and_texts(spark):
    names = {r.r_regionkey: r.r_name for r in spark.read.parquet(f"{DATA}/region.parquet").collect()}
    want = {k: hashlib.sha256(json.dumps({"a": [1, "é"], "key": k, "name": v}, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()).hexdigest() for k, v in names.items()}
    assert {r.r_regionkey: r.fingerprint for r in catalog.QUERIES["profile_fingerprints"](spark, DATA).collect()} == want


def test_reuse_joins_digests_and_not_texts(spark):
    requests = spark.createDataFrame([(1, "g", "f", "s", "x" * 9), (2, "g", "f", "s", None)], "request_id long, generation string, fingerprint string, scope string, request string")
    calls = spark.createDataFrame([(7, "g", "f", "s", hashlib.sha256(b"x" * 9).hexdigest(), hashlib.sha256(b"y").hexdigest())], "call_id long, generation string, fingerprint string, scope string, request_sha256 string, response_sha256 string")
    out = ledger.reuse(requests, calls, spark.createDataFrame([(hashlib.sha256(b"y").hexdigest(), "y")], "sha256 string, body string"))
    assert {tuple(r) for r in out.collect()} == {(1, 7, "replay"), (2, 7, "identity_mismatch")}
    assert "sha2(" not in out._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]


def test_summaries_read_each_row_once(spark):
    assert "Expand" not in plan(catalog.QUERIES["group_summaries"](spark, DATA))


@pytest.mark.parametrize("name", ["merged_ranges", "covered_chars", "call_coverage"])
def test_merged_ranges_need_no_table_of_ranges(spark, name):
    assert not [x for x in plan(catalog.QUERIES[name](spark, DATA)).splitlines() if "HashAggregate" in x and any(c in x.split("functions=")[0] for c in ("start#", "_island#"))]


@pytest.mark.parametrize("touching", [True, False])
def test_islands_of_equal_empty_and_nested_ranges(spark, touching):
    rng = random.Random(5)
    rows = [(k, s, s + rng.choice([0, 0, 1, 3, 12])) for k in range(60) for s in (rng.randrange(40) for _ in range(rng.randrange(1, 12)))] * 2
    want = set()
    for k in range(60):
        island: list = []
        for s, e in sorted({(s, e) for key, s, e in rows if key == k}):
            if island and (s <= island[1] if touching else s < island[1]):
                island[1] = max(island[1], e)
                continue
            want |= {(k, *island)} if island else set()
            island = [s, e]
        want.add((k, *island))
    got = windows.islands(spark.createDataFrame(rows, "k int, start long, end long"), ["k"], touching=touching).select("k", "start", "end").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_paragraphs_are_split_a_few_texts_at_once(spark):
    text = plan(catalog.QUERIES["paragraph_splits"](spark, DATA))
    assert "BatchEvalPython" in text and "ArrowEvalPython" not in text


def test_coverage_is_one_sort(spark):
    for name in ("covered_chars", "call_coverage"):
        text = plan(catalog.QUERIES[name](spark, DATA)).split("== Initial Plan ==")[-1]
        lines = [x.strip(" +-:*()0123456789") for x in text.splitlines()]
        assert [sum(x.startswith(k) for x in lines) for k in ("Sort ", "Window ", "SortMergeJoin", "BroadcastHashJoin")] == [1, 1, 0, 0]


def test_covered_lengths_of_chosen_ranges(spark):
    rng = random.Random(8)
    rows = [(k, s, s + rng.choice([-2, 0, 0, 1, 3, 12]), rng.choice([True, False, None])) for k in range(80) for s in (rng.randrange(40) for _ in range(rng.randrange(1, 14)))] * 2
    d = spark.createDataFrame(rows, "k int, start long, end long, ok boolean")
    want = {}
    for chosen in (False, True):
        for r in windows.islands(d.filter("ok") if chosen else d, ["k"]).collect():
            want[r.k, chosen] = want.get((r.k, chosen), 0) + r.end - r.start
    got = windows.covered(d, ["k"], some=F.col("ok")).collect()
    assert {(r.k, c): v for r in got for c, v in ((False, r.covered), (True, r.some)) if v is not None} == want and len(got) == 80
