"""Every registered query against its DuckDB counterpart on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from quillspark import catalog
from quillspark.operators import diff
from quillspark.session import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def rows(frame: pd.DataFrame) -> list:
    def plain(v):
        return None if v is None or pd.api.types.is_scalar(v) and pd.isna(v) else float(v) if isinstance(v, float) else str(v)

    return sorted(map(repr, (tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) & set(catalog.ORACLES)))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas().astype(object)
    want = duck.execute(catalog.ORACLES[name]).df().astype(object)
    norm = lambda f: f.map(lambda v: v if v is None or isinstance(v, str) or pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(norm(got)) == rows(norm(want))


def test_every_document_has_one_decision(spark):
    d = catalog.QUERIES["flagship_decisions"](spark, DATA).toPandas()
    assert len(d) == spark.read.parquet(f"{DATA}/documents.parquet").count() and d.action.notna().all() and d.reason.notna().all()
    assert (d.groupby("run_id").output_chars.sum() <= 48_000).all()


def test_version_hunks_take_long_documents(spark):
    want = set()
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        if r.doc_id % 2 and r.doc_id % 6 and r.text is not None:
            after = r.text.split("\n")
            before = "\n".join(line for i, line in enumerate(after) if (i + r.doc_id) % 5).split("\n")
            want |= {(r.doc_id, *h) for h in diff.hunks(before, after)}
    got = catalog.QUERIES["version_hunks"](spark, DATA).collect()
    assert {(r.doc_id, r.before_start, r.before_end, r.after_start, r.after_end) for r in got} == want and len(got) == len(want)
