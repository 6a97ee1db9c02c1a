"""Search, diff, verification and JSON queries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as fn
from quillspark.operators import diff, search
from quillspark.session import load
from quillspark.sources import office


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return search.fragments(d, "doc_id", F.concat_ws(" ", "source", "lang"), F.col("text"), "lang")


def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T03."""
    rows = _fragments(spark, sf_dir)
    return search.search(rows, "Thing of").select("report_key", fn.like_snippet(F.col("body"), "thing of").alias("snippet"))


def search_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T04."""
    return search.search(_fragments(spark, sf_dir), "É").select("report_key")


def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered search with its total and its first page, newest first (T05, T06). The total is a scalar subquery."""
    hits = search.search(_fragments(spark, sf_dir).filter("lang = 'en'"), "the").select("report_key")
    return search.page(hits.withColumn("total", hits.agg(F.count("*")).scalar()), 25, F.desc("report_key"))


def trigram_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T01."""
    return search.postings(_fragments(spark, sf_dir)).groupBy("gram").agg(F.count("*").alias("n"))


def benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a whole benchmark item."""
    return search.many_phrases(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text").distinct()


def _versions(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    lines = F.split("text", "\n")
    edited = F.array_join(F.filter(lines, lambda line, i: (i + F.col("doc_id")) % 5 != 0), "\n")
    before = d.filter("doc_id % 6 <> 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(edited).alias("text"))
    return before, d


def version_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents were added, continued or changed, by source parity."""
    before, after = _versions(load(spark, sf_dir, "documents").select("doc_id", "text"))
    c = diff.compare(before, after, "doc_id", "text").select("doc_id", "change").distinct()
    return c.groupBy((F.col("doc_id") % 2).alias("parity"), "change").agg(F.count("*").alias("n"))


def version_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E25."""
    before, after = _versions(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return diff.compare(before, after, "doc_id", "text").filter("change = 'hunk'")


def archive_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V03."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), "text")
    objects = d.filter("doc_id % 31 <> 0").select("digest", F.when(F.col("doc_id") % 37 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return diff.verify(d.select("doc_id", "digest"), objects, "doc_id", "digest", "text")


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whitelist of JSON fields by a fixed schema, sorted keys, and array lengths."""
    e = load(spark, sf_dir, "events")
    fixed = F.from_json("props", "k long, other string")
    doc = F.to_json(F.struct(F.col("event_type").alias("a"), F.array("user_id", "event_id").alias("ids")))
    return e.select(
        "event_id", fixed["k"].alias("k"), fixed["other"].alias("other"), F.array_join(F.json_object_keys("props"), ",").alias("keys"), F.json_array_length(F.get_json_object(doc, "$.ids")).alias("ids"),
        F.get_json_object(doc, "$.ids[1]").alias("second"), F.sha2(doc, 256).alias("canonical"),
    )


def fragment_explosion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titled fragments of each report, empty ones left out."""
    d = load(spark, sf_dir, "documents")
    parts = F.array(F.struct(F.lit("source").alias("title"), F.col("source").alias("body")), F.struct(F.lit("text").alias("title"), F.nullif("text", F.lit("")).alias("body")))
    return d.select("doc_id", F.explode(parts).alias("f")).filter("f.body IS NOT NULL").select("doc_id", "f.title", "f.body")


def docx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: every document's lines written as a DOCX and its body read back, without limits: paragraphs and their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [office.parse_office("docx", office.docx_of((t or "").split("\n")), 1 << 31, limited=False) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r[4]) for r in read], pa.int64()), pa.array([r[0] for r in read], pa.string())], names=["doc_id", "paragraphs", "body"])

    d = load(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, paragraphs long, body string")
    return d.select("doc_id", "paragraphs", F.md5("body").alias("body"))


NAMES = (docx_round_trip, search_phrase, search_short, search_page, trigram_postings, benchmark_passages, version_changes, version_hunks, archive_verify, json_fields, fragment_explosion)
QUERIES = {f.__name__: f for f in NAMES}
FRAG = """fr AS (SELECT doc_id, lang, source || ' ' || lang AS title, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS b0 FROM documents),
  f AS (SELECT *, CASE WHEN length(b0) <= 4000 THEN b0 ELSE left(b0, 3994) || '…[已截断]' END AS body FROM fr WHERE b0 <> '')"""
ORACLES = {
    "docx_round_trip": r"""WITH l AS (SELECT doc_id, list_filter(list_transform(str_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\x00-\x1F]', '', 'g')), lambda x: regexp_matches(x, '[^\s\x{85}\p{Z}]')) AS l FROM documents)
      SELECT doc_id, len(l) AS paragraphs, md5(array_to_string(l, chr(10))) AS body FROM l""",
    "search_phrase": f"""WITH {FRAG}, s AS (SELECT doc_id, body, strpos(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'thing of') AS a FROM f WHERE contains(lower(title || chr(10) || body), 'thing of'))
      SELECT doc_id AS report_key, CASE WHEN a > 0 THEN CASE WHEN a > 41 THEN '…' ELSE '' END || substr(body, greatest(a - 41, 0) + 1, a - 1 - greatest(a - 41, 0)) || '[' || substr(body, a, 8) || ']' || substr(body, a + 8, 40)
        || CASE WHEN a + 47 < length(body) THEN '…' ELSE '' END END AS snippet FROM s""",
    "search_short": f"WITH {FRAG} SELECT doc_id AS report_key FROM f WHERE contains(title || chr(10) || body, 'É')",
    "search_page": f"WITH {FRAG}, h AS (SELECT doc_id AS report_key, count(*) OVER () AS total FROM f WHERE lang = 'en' AND contains(lower(title || chr(10) || body), 'the')) SELECT * FROM h ORDER BY report_key DESC LIMIT 25",
    "trigram_postings": f"""WITH {FRAG}, g AS (SELECT DISTINCT doc_id, substr(t, CAST(i AS BIGINT), 3) AS gram FROM (SELECT doc_id, lower(title || chr(10) || body) AS t, unnest(range(1, length(lower(title || chr(10) || body)) - 1)) AS i FROM f))
      SELECT gram, count(*) AS n FROM g GROUP BY gram""",
    "benchmark_passages": "SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)",
    "version_changes": """WITH d AS (SELECT doc_id, text, array_to_string(list_filter(str_split(text, chr(10)), lambda x, i: (i - 1 + doc_id) % 5 <> 0), chr(10)) AS e FROM documents)
      SELECT doc_id % 2 AS parity, CASE WHEN doc_id % 6 = 0 THEN 'added' WHEN doc_id % 2 = 0 OR coalesce(e, '') = text THEN 'continued' ELSE 'hunk' END AS change, count(*) AS n FROM d GROUP BY 1, 2""",
    "archive_verify": """WITH d AS (SELECT doc_id, sha256(text) AS h, text FROM documents)
      SELECT doc_id, 'missing_object' AS problem FROM d WHERE h NOT IN (SELECT h FROM d WHERE doc_id % 31 <> 0)
      UNION ALL SELECT doc_id, 'digest_mismatch' FROM d WHERE h IN (SELECT h FROM d WHERE doc_id % 31 <> 0 AND doc_id % 37 = 0)""",
    "json_fields": """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.other') AS other, array_to_string(json_keys(props), ',') AS keys, CAST(2 AS INTEGER) AS ids,
      CAST(event_id AS VARCHAR) AS second, sha256('{"a":"' || event_type || '","ids":[' || user_id || ',' || event_id || ']}') AS canonical FROM events""",
    "fragment_explosion": """SELECT doc_id, 'source' AS title, source AS body FROM documents WHERE source IS NOT NULL UNION ALL SELECT doc_id, 'text', text FROM documents WHERE text <> ''""",
}
