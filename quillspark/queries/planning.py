"""Planning queries: ranks, routes, quotas, decisions and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.plans import admission
from quillspark.queries.base import FILES_SQL, files

RANKED_SQL = (
    FILES_SQL
    + """,
prio AS (
  SELECT *, CASE WHEN contains(k, '\\.pytest_cache\\') OR contains(k, '\\data\\benchmarks\\') THEN 70 WHEN contains(k, '\\logs\\') THEN 60
     WHEN extension IN ('.docx','.pptx','.xlsx','.xls','.doc','.ppt','.pdf') THEN 20 WHEN extension IN ('.md','.txt') THEN 30 ELSE 50 END AS priority
  FROM (SELECT *, '\\' || lower(trim(replace(relative_path, '/', '\\'), '\\')) || '\\' AS k FROM named)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY priority, lower(trim(replace(relative_path, '/', '\\'), '\\')), relative_path, file_identity) AS INTEGER) AS rank,
  CASE WHEN size_bytes > 30000 THEN 'not_parsed:file_size_policy' WHEN extension IN ('.txt','.md','.csv','.json','.log') THEN 'light_text' WHEN extension = '.xlsx' THEN 'rust_xlsx'
    WHEN extension IN ('.docx','.pptx') THEN 'rust_office' WHEN extension = '.xls' THEN 'rust_xls' WHEN extension = '.pdf' THEN 'pdf'
    WHEN extension IN ('.doc','.ppt') THEN 'not_parsed:legacy_extension_disabled' ELSE 'reject:profile_route_invariant' END AS route FROM prio)"""
)
#: First-fit with slots and extractions as one recursion over ranks.
DECIDED_SQL = (
    "WITH RECURSIVE "
    + RANKED_SQL
    + """,
routed AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rank) AS k2 FROM ranked WHERE route NOT LIKE 'not_parsed:%' AND route NOT LIKE 'reject:%'),
fold AS (
  SELECT run_id, CAST(0 AS BIGINT) AS k2, CAST('' AS VARCHAR) AS file_identity, CAST(96 AS BIGINT) AS slots, CAST(80 AS BIGINT) AS pages, CAST('' AS VARCHAR) AS slot_action,
         CAST(0 AS BIGINT) AS used, CAST(8 AS BIGINT) AS ext_left, CAST(NULL AS VARCHAR) AS admit_action FROM routed GROUP BY run_id
  UNION ALL
  SELECT run_id, k2, file_identity, slots - CAST(given AS BIGINT), pages - CASE WHEN given THEN need ELSE 0 END,
         CASE WHEN short THEN 'pdf_page_quota_exhausted' WHEN NOT given THEN 'candidate_quota_exhausted' ELSE 'slot' END,
         used + CASE WHEN given AND fits AND NOT (pdf AND ext_left <= 0) THEN cost ELSE 0 END,
         ext_left - CASE WHEN given AND fits AND pdf AND ext_left > 0 THEN 1 ELSE 0 END,
         CASE WHEN NOT given THEN NULL WHEN NOT fits THEN 'global_context_budget_exceeded' WHEN pdf AND ext_left <= 0 THEN 'pdf_text_extraction_quota_exhausted' ELSE 'admit' END
  FROM (
    SELECT r.run_id, r.k2, r.file_identity, f.slots, f.pages, f.used, f.ext_left, r.route = 'pdf' AS pdf,
      CASE WHEN r.route = 'pdf' THEN least(r.page_count, 20) ELSE 0 END AS need, least(r.n_chars, 6000) AS cost,
      (r.route = 'pdf' AND least(r.page_count, 20) > f.pages) AS short,
      NOT (r.route = 'pdf' AND least(r.page_count, 20) > f.pages) AND f.slots > 0 AS given,
      f.used + least(r.n_chars, 6000) <= 48000 AS fits
    FROM fold f JOIN routed r ON r.run_id = f.run_id AND r.k2 = f.k2 + 1)),
said AS (
  SELECT r.*, f.slot_action, f.admit_action,
    CASE WHEN route LIKE 'not_parsed:%' OR route LIKE 'reject:%' THEN regexp_extract(route, ':(.*)$', 1) WHEN slot_action <> 'slot' THEN slot_action
         WHEN admit_action <> 'admit' THEN admit_action END AS why
  FROM ranked r LEFT JOIN fold f ON f.run_id = r.run_id AND f.file_identity = r.file_identity),
decided AS (
  SELECT run_id, relative_path, extension, priority, rank, route,
    CASE WHEN route LIKE 'reject:%' THEN 'error' WHEN why IS NOT NULL THEN 'omit' WHEN n_chars <= 6000 AND NOT truncated THEN 'keep' ELSE 'compress' END AS action,
    CASE WHEN why IS NOT NULL THEN why WHEN n_chars <= 6000 AND NOT truncated THEN 'small_file_keep' WHEN extension = '.log' THEN 'large_log_tail'
         WHEN extension IN ('.docx','.pptx','.xlsx','.xls','.doc','.ppt','.pdf') THEN 'large_document_summary' ELSE 'medium_text_compress' END AS reason,
    CAST(CASE WHEN why IS NULL AND route NOT LIKE 'reject:%' THEN least(n_chars, 6000) ELSE 0 END AS BIGINT) AS output_chars, CASE WHEN why IS NULL AND route NOT LIKE 'reject:%' THEN n_chars ELSE size_bytes END AS input_chars
  FROM said)
"""
)


def flagship_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B05, B10, B12, B13, J01, J07, J27, E02, E03."""
    return admission.decisions(files(spark, sf_dir))


def nominal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B08, B09, E01."""
    plan = admission.ranked(files(spark, sf_dir)).withColumn("route", rules.route(F.col("extension"), F.col("size_bytes"), 30_000))
    return plan.select("run_id", "relative_path", "priority", "rank", "route")


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G04."""
    d = flagship_decisions(spark, sf_dir)
    count = lambda c: F.count_if(c).alias
    return d.groupBy("run_id").agg(
        F.count("*").alias("files"), count(F.col("action") == "keep")("kept"), count(F.col("action") == "compress")("compressed"),
        count(F.col("action") == "omit")("omitted"), count(F.col("action") == "error")("errors"), F.sum("output_chars").alias("output_chars"),
    )


def extension_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J08, G01."""
    d = flagship_decisions(spark, sf_dir)
    return d.groupBy("extension").agg(
        F.count("*").alias("discovered"), F.count_if(F.col("action").isin("keep", "compress")).alias("parsed"), F.count_if(F.col("action") == "omit").alias("not_parsed"),
        F.sum("input_chars").alias("input_chars"), F.sum("output_chars").alias("output_chars"),
    )


def stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fixed rows a run, whatever happened."""
    d = flagship_decisions(spark, sf_dir).groupBy("run_id").agg(
        F.count("*").alias("discovery"), F.count_if(~F.col("route").rlike("^(not_parsed|reject):")).alias("planning"),
        F.count_if(F.col("action").isin("keep", "compress")).alias("parsing"), F.count_if(F.col("output_chars") > 0).alias("rendering"),
    )
    return d.unpivot("run_id", ["discovery", "planning", "parsing", "rendering"], "stage", "rows")


def omitted_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Omitted files by reason and extension; groups after the first eight of a run are one."""
    d = flagship_decisions(spark, sf_dir).filter("action = 'omit'").groupBy("run_id", "reason", "extension").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("n"), "reason", "extension"))
    d = d.withColumn("place", place)
    other = F.col("place") > 8
    d = d.groupBy("run_id", F.when(other, "other").otherwise(F.col("reason")).alias("reason"), F.when(other, "*").otherwise(F.col("extension")).alias("extension"))
    return d.agg(F.sum("n").alias("n"))


def omitted_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E04."""
    d = flagship_decisions(spark, sf_dir).filter("action = 'omit'").withColumn("cost", (F.length("relative_path") + F.length("reason") + 20) * 40)
    return admission.omitted_prefix(d, 60_000).select("run_id", "rank", "relative_path", "used")


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the books (B28, B32): rendered more than reserved, budgets exceeded, or a run's parts that do not add up.

    The books are the decisions with planted faults: some rows rendered too much, some lost their action.
    """
    d = flagship_decisions(spark, sf_dir)
    d = d.withColumn("output_chars", F.col("output_chars") + F.when(F.col("rank") % 37 == 1, 6500).otherwise(0)).withColumn("action", F.when(F.col("rank") % 41 != 2, F.col("action")))
    per_run = d.groupBy("run_id").agg(F.sum("output_chars").alias("value"), F.count("*").alias("n"), F.count_if(F.col("action").isin("keep", "compress", "omit", "error", "metadata_only")).alias("said"))
    over = per_run.filter("value > 48000").select("run_id", F.lit("budget").alias("rule"), "value")
    lost = per_run.filter("n <> said").select("run_id", F.lit("undecided").alias("rule"), (F.col("n") - F.col("said")).alias("value"))
    wide = d.filter("output_chars > 6000").groupBy("run_id").agg(F.count("*").alias("value")).select("run_id", F.lit("per_file").alias("rule"), "value")
    return over.unionByName(lost).unionByName(wide)


QUERIES = {f.__name__: f for f in (flagship_decisions, nominal_rank, run_summary, extension_metrics, stage_metrics, omitted_groups, omitted_details, reconciliation)}
ORACLES = {
    "flagship_decisions": DECIDED_SQL + "SELECT * FROM decided",
    "nominal_rank": "WITH " + RANKED_SQL + " SELECT run_id, relative_path, priority, rank, route FROM ranked",
    "run_summary": DECIDED_SQL + """SELECT run_id, count(*) AS files, count(*) FILTER (action = 'keep') AS kept, count(*) FILTER (action = 'compress') AS compressed,
        count(*) FILTER (action = 'omit') AS omitted, count(*) FILTER (action = 'error') AS errors, CAST(sum(output_chars) AS BIGINT) AS output_chars FROM decided GROUP BY run_id""",
    "extension_metrics": DECIDED_SQL + """SELECT extension, count(*) AS discovered, count(*) FILTER (action IN ('keep','compress')) AS parsed, count(*) FILTER (action = 'omit') AS not_parsed,
        CAST(sum(input_chars) AS BIGINT) AS input_chars, CAST(sum(output_chars) AS BIGINT) AS output_chars FROM decided GROUP BY extension""",
    "stage_metrics": DECIDED_SQL + """SELECT run_id, unnest(['discovery','planning','parsing','rendering']) AS stage, unnest([count(*), count(*) FILTER (route NOT LIKE 'not_parsed:%' AND route NOT LIKE 'reject:%'),
        count(*) FILTER (action IN ('keep','compress')), count(*) FILTER (output_chars > 0)]) AS "rows" FROM decided GROUP BY run_id""",
    "omitted_groups": DECIDED_SQL + """SELECT run_id, CASE WHEN place > 8 THEN 'other' ELSE reason END AS reason, CASE WHEN place > 8 THEN '*' ELSE extension END AS extension, CAST(sum(n) AS BIGINT) AS n
        FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, reason, extension) AS place FROM
          (SELECT run_id, reason, extension, count(*) AS n FROM decided WHERE action = 'omit' GROUP BY ALL)) GROUP BY 1, 2, 3""",
    "omitted_details": DECIDED_SQL + """SELECT run_id, rank, relative_path, used FROM (SELECT *, CAST(sum((length(relative_path) + length(reason) + 20) * 40) OVER (PARTITION BY run_id ORDER BY rank) AS BIGINT) AS used
        FROM decided WHERE action = 'omit') WHERE used <= 12000""",
    "reconciliation": DECIDED_SQL + """, books AS (SELECT run_id, output_chars + CASE WHEN rank % 37 = 1 THEN 6500 ELSE 0 END AS c, rank % 41 = 2 AS lost FROM decided)
        SELECT run_id, 'budget' AS rule, CAST(sum(c) AS BIGINT) AS value FROM books GROUP BY run_id HAVING sum(c) > 48000
        UNION ALL SELECT run_id, 'undecided', count(*) FILTER (lost) FROM books GROUP BY run_id HAVING bool_or(lost)
        UNION ALL SELECT run_id, 'per_file', count(*) FROM books WHERE c > 6000 GROUP BY run_id""",
}
