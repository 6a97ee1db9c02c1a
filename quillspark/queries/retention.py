"""Queries of retention, storage, windows, logs and the assembly of results. Each docstring names the operators it covers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import retention
from quillspark.queries.base import FILES_SQL, files
from quillspark.session import load


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    phase = F.element_at(F.array(*(F.lit(p) for p in ("created", "prepared", "generating", "db_committed", "published", "published", "published"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "P", "running").when(phase == "published", "succeeded").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") * 31 + F.col("o_orderkey") % 5).alias("generation_id"), status.alias("status"), phase.alias("phase"), F.when(F.col("o_orderkey") % 3 == 0, "RUN_SUPERSEDED").alias("error_code"), F.col("o_orderdate").alias("finished"), (F.col("o_orderkey") % 2 == 0).alias("has_snapshot"))


def cleanup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs of generations; runs that order lines of 1995 and later still refer to, running and resumable ones are protected with their generation."""
    runs, li = _runs(spark, sf_dir), load(spark, sf_dir, "lineitem")
    references = li.filter("l_returnflag = 'R' AND l_linenumber = 7").select(F.col("l_orderkey").alias("run_id"))
    current = li.filter("l_linenumber = 6").select(F.col("l_orderkey").alias("run_id"))
    return retention.cleanup_plan(runs, references, current, "finished", F.lit("1997-01-01").cast("timestamp"), F.lit("1996-01-01").cast("timestamp"))


def storage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as stored objects, documents as their versions."""
    d = load(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"), (F.col("n_chars") % 11 == 0).alias("pruned"))
    return retention.storage_totals(d)


def latest_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as publications of a user's local day."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("scope"), retention.local_date(F.col("ts")).alias("day"), F.when(F.col("event_type") == "purchase", F.col("ts")).alias("published"), F.col("event_id").alias("run_id"))
    return retention.latest_publications(e, "scope", "day", "published").select("scope", "day", "run_id")


def window_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in local days, and in a half-open window at UTC."""
    day, utc = (dt.date(2024, 1, 5), dt.date(2024, 1, 9)), (dt.datetime(2024, 1, 5, 16), dt.datetime(2024, 1, 6, 16))
    e = load(spark, sf_dir, "events").select("event_id", retention.local_date(F.col("ts")).alias("day"), retention.in_window(F.col("ts"), day).alias("in_days"), retention.in_window(F.col("ts"), day, utc).alias("in_utc"))
    return e.filter("in_days OR in_utc")


def operation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a document's text as their message, by the file that they would be appended to; some lines have too many bytes."""
    e = load(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), "text", F.left("text", F.lit(4_000)).alias("note"))
    lines = retention.log_lines(e.join(d, "event_id"), "ts", "text", "event_id", "note")
    return lines.select("event_id", "file", F.coalesce("error", F.lit("")).alias("error"), F.octet_length("line").cast("long").alias("bytes"))


def inventory_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts on order lines against parts in the catalogue, by key."""
    return retention.inventory_mismatches(load(spark, sf_dir, "part").filter("p_partkey % 9 <> 0").select("p_partkey"), load(spark, sf_dir, "lineitem").filter("l_linenumber = 1 AND l_returnflag = 'A'").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


def assembled_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as discovered files, each with the stage that it reached."""
    f = files(spark, sf_dir)
    n = F.coalesce("n_chars", F.lit(0))
    plan = f.filter("extension <> '.bin'").select("file_identity", F.col("extension").alias("route"))
    admission = f.select("file_identity", F.when(n % 5 == 0, "candidate_quota_exhausted").otherwise("admit").alias("admit_action")).filter(n % 13 != 0)
    classified = f.filter("extension = '.pdf'").select("file_identity", (n % 2 == 0).alias("has_text"))
    parsed = f.filter(n % 17 != 0).select("file_identity", F.when(n % 7 == 0, "timeout").otherwise("success").alias("status"), n.alias("chars"))
    out = retention.assembled(f, plan, admission, classified, parsed, "file_identity")
    return out


NAMES = (cleanup_candidates, storage_totals, latest_publications, window_matches, operation_log, inventory_mismatches, assembled_results)
QUERIES = {f.__name__: f for f in NAMES}
ORACLES = {
    "cleanup_candidates": """WITH r AS (SELECT *, o_custkey * 31 + o_orderkey % 5 AS g, o_orderkey % 7 AS p FROM orders),
      s AS (SELECT g FROM r WHERE o_orderstatus = 'P' OR (p IN (1, 2, 3) AND o_orderkey % 3 <> 0) OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7)),
      a AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 6) THEN 'remove_run' WHEN o_orderdate < TIMESTAMP '1997-01-01' AND o_orderkey % 2 = 0 THEN 'prune_snapshot' END AS action FROM r WHERE g NOT IN (SELECT g FROM s))
      SELECT * FROM a WHERE action IS NOT NULL""",
    "storage_totals": """WITH l AS (SELECT text, strlen(text) AS n FROM documents WHERE coalesce(n_chars % 11 <> 0, true)) SELECT count(*) AS versions, CAST(coalesce(sum(n), 0) AS BIGINT) AS logical_bytes, CAST((SELECT coalesce(sum(n), 0) FROM (SELECT DISTINCT text, n FROM l)) AS BIGINT) AS object_bytes,
      CAST(greatest(0, coalesce(sum(n), 0) - (SELECT coalesce(sum(n), 0) FROM (SELECT DISTINCT text, n FROM l))) AS BIGINT) AS deduplicated_bytes FROM l""",
    "latest_publications": "SELECT user_id AS scope, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, arg_max(event_id, (ts, event_id)) AS run_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2",
    "window_matches": """WITH e AS (SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, ts >= TIMESTAMP '2024-01-05 16:00' AND ts < TIMESTAMP '2024-01-06 16:00' AS in_utc FROM events)
      SELECT event_id, day, day BETWEEN '2024-01-05' AND '2024-01-09' AS in_days, in_utc FROM e WHERE day BETWEEN '2024-01-05' AND '2024-01-09' OR in_utc""",
    "operation_log": """WITH j AS (SELECT event_id, ts, text, left(text, 4000) AS note FROM events JOIN documents ON doc_id = event_id), l AS (SELECT event_id, 'scheduled-' || strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') || '.jsonl' AS file,
        strlen(CAST(to_json({'at': strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), 'message': left(text, 512), 'event_id': event_id, 'note': note}) AS VARCHAR)) AS bytes FROM j)
      SELECT event_id, file, CASE WHEN bytes + 1 > 4096 THEN 'LOG_ENTRY_TOO_LARGE' ELSE '' END AS error, CASE WHEN bytes + 1 <= 4096 THEN bytes END AS bytes FROM l""",
    "inventory_mismatches": """WITH i AS (SELECT p_partkey, count(*) AS i FROM part WHERE p_partkey % 9 <> 0 GROUP BY 1), r AS (SELECT l_partkey AS p_partkey, count(*) AS r FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'A' GROUP BY 1)
      SELECT * FROM (SELECT p_partkey, CASE WHEN i IS NULL THEN 'not_in_inventory' WHEN r IS NULL THEN 'without_result' WHEN i > 1 THEN 'inventory_twice' WHEN r > 1 THEN 'result_twice' END AS problem FROM i FULL JOIN r USING (p_partkey)) WHERE problem IS NOT NULL""",
    "assembled_results": f"""WITH {FILES_SQL}, n AS (SELECT *, coalesce(n_chars, 0) AS n FROM named),
      s AS (SELECT file_identity, n, CASE WHEN extension = '.bin' THEN 'discovered' WHEN n % 13 = 0 OR n % 5 = 0 THEN 'planned' WHEN extension = '.pdf' AND n % 2 = 1 THEN 'classified' WHEN n % 17 = 0 THEN 'admitted' ELSE 'parsed' END AS stage FROM n)
      SELECT file_identity, stage, CASE stage WHEN 'discovered' THEN 'no_route' WHEN 'planned' THEN CASE WHEN n % 13 = 0 THEN 'not_admitted' ELSE 'candidate_quota_exhausted' END WHEN 'classified' THEN 'pdf_no_text_in_parse_window' WHEN 'admitted' THEN 'no_result' ELSE CASE WHEN n % 7 = 0 THEN 'timeout' END END AS reason,
        CASE WHEN stage = 'parsed' AND n % 7 <> 0 THEN n ELSE 0 END AS chars FROM s""",
}
