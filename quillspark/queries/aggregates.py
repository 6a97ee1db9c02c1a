"""Aggregation queries: metrics, coverage, budgets, gaps, percentiles, rollups, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import metrics, windows
from quillspark.queries.relational import EV, events
from quillspark.session import load

LEVELS = ("ok", "warning", "error")


def execution_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts a day; all_hit is null on days without lookups."""
    e = events(spark, sf_dir)
    t = F.col("event_type")
    hit = F.col("value") < 100
    return e.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("calls"), F.count_if(t == "error").alias("errors"), F.count_if((t == "view") & hit).alias("hits"), F.count_if((t == "view") & ~hit).alias("misses"),
        metrics.all_hit(hit, (t == "view") & (F.col("user_id") == 3)).alias("all_hit"), F.count_distinct("user_id").alias("users"),
    )


def strict_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that are null when a part is unknown, and those that are null only when all is."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = load(spark, sf_dir, "events").withColumn("k", F.when(k % 13 != 0, k))
    return e.groupBy("user_id", "event_type").agg(metrics.strict_total(F.col("k")).alias("strict"), metrics.known_total(F.col("k")).alias("known"), F.count("*").alias("n"))


def model_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens known and unknown, retries and time by stage, from JSON usage."""
    e = load(spark, sf_dir, "events").withColumn("tokens", F.get_json_object("props", "$.k").cast("long"))
    n = F.row_number().over(Window.partitionBy("user_id", "event_type", "tokens").orderBy("ts", "event_id"))
    e = e.withColumn("retry", n > 1)
    return e.groupBy("event_type").agg(
        F.count("*").alias("calls"), F.sum(F.when(F.col("tokens") > 9, F.col("tokens"))).alias("tokens"), F.count_if(F.col("tokens") <= 9).alias("unknown"), F.count_if("retry").alias("retries"),
        F.sum(F.round(F.col("value") * 100).cast("long")).alias("centi"),
    )


def budget_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call in the scopes of its run, day and job; a call of unknown cost poisons all three."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = events(spark, sf_dir).withColumn("cost", F.when(k != 1, k * 3)).withColumn("run", F.col("user_id")).withColumn("d", F.date_format("day", "yyyy-MM-dd")).withColumn("job", F.col("event_type"))
    return metrics.budget_usage(e, [("run", "run"), ("day", "d"), ("job", "job")], "cost")


def charged_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known cost if there is one, else the reserved upper bound."""
    k = F.get_json_object("props", "$.k").cast("long")
    charge = F.when(F.col("event_type") == "error", F.lit(100)).otherwise(k)
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(charge).cast("long").alias("charged"), F.count_if(F.col("event_type") == "error").alias("reserved"))


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G16."""
    e = load(spark, sf_dir, "events")
    found = metrics.inclusive_percentiles(e, "event_type", "value", [0.5, 0.9])
    return found.select("event_type", F.round("p0", 6).alias("p50"), F.round("p1", 6).alias("p90"))


def grouped_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G19."""
    d = load(spark, sf_dir, "documents")
    return metrics.headed_groups(d, ["lang"], "source", "n_chars", "doc_id", 6).select("lang", "source", "first", "labels", "n")


def gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five gap codes a source, distinct and sorted."""
    d = load(spark, sf_dir, "documents")
    codes = F.array(
        F.when(F.col("n_chars") > 5000, "PARSE_BOUNDED"), F.when(F.col("doc_id") % 6 == 0, "SOURCE_UNAVAILABLE"), F.when(F.col("n_chars") < 300, "EMPTY"), F.when(F.col("lang") != "en", "LANGUAGE"),
        F.when(F.col("text").contains("@"), "PERSONAL"),
    )
    return d.select("source", "lang", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code")).distinct()


def omission_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Omitted documents by reason with the first ten distinct paths."""
    d = load(spark, sf_dir, "documents").withColumn("reason", F.when(F.col("n_chars") > 4000, "size").when(F.col("n_chars") < 200, "empty"))
    d = d.filter("reason IS NOT NULL").select("source", "reason", "doc_id")
    shown = windows.first_rows(d.distinct(), ["source", "reason"], ["doc_id"], 10)
    shown = shown.groupBy("source", "reason").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda i: i.cast("string")), ",").alias("first"))
    g = d.groupBy(F.col("source").alias("s"), F.col("reason").alias("r")).agg(F.count("*").alias("n"))
    return g.join(shown, F.col("s").eqNullSafe(F.col("source")) & (F.col("r") == F.col("reason"))).select("source", "reason", "n", "first")


def backend_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts nested by extension class, backend and lane, as sorted JSON."""
    d = load(spark, sf_dir, "documents").withColumn("backend", F.concat(F.lit("b"), (F.col("doc_id") % 3).cast("string")))
    g = d.groupBy("lang", "backend").agg(F.count("*").alias("n"))
    return g.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "backend", F.col("n").cast("string")))), ",").alias("backends"), F.sum("n").alias("files"))


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G26, M20."""
    d = load(spark, sf_dir, "documents").select(F.md5("text").alias("h"), "doc_id", "n_chars")
    return d.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("n_chars").alias("chars")).filter("n > 1")


def summary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (text, sources) in order of first sight."""
    c = load(spark, sf_dir, "conversations").select("role", F.col("text").alias("k"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"))
    first = c.groupBy("role", "k").agg(F.min("at").alias("at"))
    return windows.running(first, ["role"], ["at", "k"]).select("role", "k", (F.col("_before") + 1).cast("int").alias("n"))


def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail folded into one row a day: runs, failures, and what was last."""
    e = events(spark, sf_dir)
    last = lambda c: F.max_by(c, F.struct("ts", "event_id"))
    return e.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("runs"), F.count_if(F.col("event_type") == "error").alias("failures"), last("event_type").alias("last_status"), last("user_id").alias("last_user"))


def health_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst of a user's checks."""
    e = load(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", F.when(F.col("value") > 50, "error").otherwise("warning")).otherwise("ok")
    return e.groupBy("user_id").agg(metrics.worst(level, LEVELS).alias("status"), F.count_if(level != "ok").alias("raised"))


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success, partial or error of each source: error if nothing is usable, partial if anything is not."""
    d = load(spark, sf_dir, "documents").withColumn("ok", F.col("n_chars") > 400)
    return d.groupBy("source", "lang").agg(F.when(~F.bool_or("ok"), "error").when(F.bool_and("ok"), "success").otherwise("partial").alias("status"), F.count_if("ok").alias("usable"))


def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents covered by labels, by language and quality, with what no label covers."""
    d, la = load(spark, sf_dir, "documents").select("doc_id", "lang"), load(spark, sf_dir, "labels")
    j = d.join(la, "doc_id", "left")
    return j.groupBy("lang").agg(F.count("*").alias("presented"), F.count("quality").alias("covered"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))


def freshness_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and newest key per table: an index is stale if they changed."""
    rows = [("documents", "doc_id"), ("conversations", "conv_id"), ("events", "event_id")]
    out = None
    for name, key in rows:
        one = load(spark, sf_dir, name).agg(F.count("*").alias("n"), F.max(key).alias("newest")).withColumn("table", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


NAMES = (
    execution_metrics, strict_totals, model_usage, budget_usage, charged_usage, percentiles, grouped_gaps, gap_rows, omission_counters, backend_summary, duplicate_groups, summary_merge, daily_rollup,
    health_status, run_status, coverage_summary, freshness_signature,
)
QUERIES = {f.__name__: f for f in NAMES}
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
ORACLES = {
    "execution_metrics": f"""WITH {EV} SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view' AND value < 100) AS hits,
      count(*) FILTER (event_type = 'view' AND value >= 100) AS misses, bool_and(value < 100) FILTER (event_type = 'view' AND user_id = 3) AS all_hit, count(DISTINCT user_id) AS users FROM ev GROUP BY 1""",
    "strict_totals": f"""SELECT user_id, event_type, CASE WHEN bool_or({K} % 13 = 0) THEN NULL ELSE CAST(sum({K}) AS BIGINT) END AS strict, CAST(sum({K}) FILTER ({K} % 13 <> 0) AS BIGINT) AS known, count(*) AS n FROM events GROUP BY 1, 2""",
    "model_usage": f"""WITH e AS (SELECT *, {K} AS k, row_number() OVER (PARTITION BY user_id, event_type, {K} ORDER BY ts, event_id) AS r FROM events)
      SELECT event_type, count(*) AS calls, CAST(sum(k) FILTER (k > 9) AS BIGINT) AS tokens, count(*) FILTER (k <= 9) AS unknown, count(*) FILTER (r > 1) AS retries, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS centi FROM e GROUP BY 1""",
    "budget_usage": f"""WITH {EV}, s AS (SELECT unnest(['run','day','job']) AS scope, unnest([CAST(user_id AS VARCHAR), strftime(day, '%Y-%m-%d'), event_type]) AS id, CASE WHEN {K} <> 1 THEN {K} * 3 END AS c FROM ev)
      SELECT scope, id, count(*) AS calls, CASE WHEN count(c) = count(*) THEN CAST(sum(c) AS BIGINT) END AS cost FROM s GROUP BY 1, 2""",
    "charged_usage": f"SELECT user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 100 ELSE {K} END) AS BIGINT) AS charged, count(*) FILTER (event_type = 'error') AS reserved FROM events GROUP BY 1",
    "percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1",
    "grouped_gaps": """WITH g AS (SELECT lang, source, min(doc_id) AS first, list_sort(list(DISTINCT n_chars)) AS l, count(*) AS n FROM documents GROUP BY 1, 2)
      SELECT lang, source, first, array_to_string(l[1:6], ', ') || CASE WHEN len(l) > 6 THEN ' +' || (len(l) - 6) ELSE '' END AS labels, n FROM g""",
    "gap_rows": """SELECT DISTINCT source, lang, code FROM (SELECT source, lang, unnest([CASE WHEN n_chars > 5000 THEN 'PARSE_BOUNDED' END, CASE WHEN doc_id % 6 = 0 THEN 'SOURCE_UNAVAILABLE' END, CASE WHEN n_chars < 300 THEN 'EMPTY' END,
      CASE WHEN lang <> 'en' THEN 'LANGUAGE' END, CASE WHEN contains(text, '@') THEN 'PERSONAL' END]) AS code FROM documents) WHERE code IS NOT NULL""",
    "omission_counters": """WITH d AS (SELECT *, CASE WHEN n_chars > 4000 THEN 'size' WHEN n_chars < 200 THEN 'empty' END AS reason FROM documents)
      SELECT source, reason, count(*) AS n, array_to_string(list_sort(list(DISTINCT doc_id))[1:10], ',') AS first FROM d WHERE reason IS NOT NULL GROUP BY 1, 2""",
    "backend_summary": """SELECT lang, string_agg(b || '=' || n, ',' ORDER BY b) AS backends, CAST(sum(n) AS BIGINT) AS files FROM (SELECT lang, 'b' || (doc_id % 3) AS b, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1""",
    "duplicate_groups": "SELECT md5(text) AS h, count(*) AS n, min(doc_id) AS first, max(n_chars) AS chars FROM documents GROUP BY text HAVING count(*) > 1",
    "summary_merge": """SELECT role, k, CAST(row_number() OVER (PARTITION BY role ORDER BY seen) AS INTEGER) AS n FROM (SELECT role, text AS k, min(conv_id * 1000 + turn) AS seen FROM conversations GROUP BY 1, 2)""",
    "daily_rollup": f"""WITH {EV} SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failures, arg_max(event_type, (ts, event_id)) AS last_status, arg_max(user_id, (ts, event_id)) AS last_user FROM ev GROUP BY 1""",
    "health_status": """SELECT user_id, CASE max(CASE WHEN event_type <> 'error' THEN 1 WHEN value > 50 THEN 3 ELSE 2 END) WHEN 3 THEN 'error' WHEN 2 THEN 'warning' ELSE 'ok' END AS status, count(*) FILTER (event_type = 'error') AS raised FROM events GROUP BY 1""",
    "run_status": "SELECT source, lang, CASE WHEN NOT bool_or(n_chars > 400) THEN 'error' WHEN bool_and(n_chars > 400) THEN 'success' ELSE 'partial' END AS status, count(*) FILTER (n_chars > 400) AS usable FROM documents GROUP BY 1, 2",
    "coverage_summary": """SELECT lang, count(*) AS presented, count(quality) AS covered, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality IS NULL) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
    "freshness_signature": """SELECT count(*) AS n, max(doc_id) AS newest, 'documents' AS "table" FROM documents UNION ALL SELECT count(*), max(conv_id), 'conversations' FROM conversations UNION ALL SELECT count(*), max(event_id), 'events' FROM events""",
}
