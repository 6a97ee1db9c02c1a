"""State, memoisation, sink and day-window queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import state
from quillspark.sources import sinks
from quillspark.streaming import daily
from quillspark.session import load

STATES = ("created", "scanning", "prepared", "generating", "db_committed", "published")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.withColumn("state", F.element_at(F.array(*(F.lit(s) for s in STATES)), (F.col("k") % 6 + 1).cast("int")))


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M07."""
    return state.run_states(_events(spark, sf_dir), "user_id", "state", ["ts", "event_id"])


def reuse_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M05."""
    g = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("k") > 3).alias("hits"), F.bool_or(F.col("k") == 77).alias("failed"), F.bool_and(F.col("k") > 9).alias("snapshot"))
    return g.select("user_id", "event_type", state.reuse_kind(F.col("failed"), F.col("snapshot"), F.col("hits"), F.col("n")).alias("reuse"))


def run_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M19."""
    e = _events(spark, sf_dir)
    attempts = e.filter("event_type <> 'signup'").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("attempt"), F.when(F.col("k") % 3 == 0, "done").when(F.col("k") % 3 == 1, "running").otherwise("failed").alias("state"), (F.col("k") % 2).alias("hash"))
    requests = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.lit(0).cast("long").alias("hash"))
    return state.started(requests, attempts)


def superseded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10."""
    e = _events(spark, sf_dir)
    runs = e.filter("event_type IN ('view', 'click')").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "view", "pending").otherwise("done").alias("state"))
    return state.superseded(runs, e.filter("event_type = 'purchase'").select("user_id", "ts"), "user_id", "ts").select("event_id", "state")


def revision_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("long").alias("q"))
    return state.revision_violations(li, "l_orderkey", "l_linenumber", "q")


def pin_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M13."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("size"), F.md5("text").alias("digest"))
    now = d.filter("doc_id % 21 <> 0").withColumn("digest", F.when(F.col("doc_id") % 23 == 0, "?").otherwise(F.col("digest")))
    return state.pin_violations(d, now, "doc_id")


def access_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M17."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    hits = load(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("user_id").alias("c_custkey"), day)
    cache = load(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "2024-01-20").otherwise("2023-12-01").alias("day"))
    return state.touched(cache, hits, "c_custkey", "day")


def snapshots_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M03."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.md5("text").alias("digest"))
    return state.snapshot_usable(d.select("doc_id", F.concat_ws("/", "source", "lang").alias("snapshot"), "digest"), d.filter("doc_id % 67 <> 0").select("doc_id", "digest"), "snapshot", "doc_id")


def claim_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B33."""
    items = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), F.when(F.col("c_custkey") % 3 == 0, "planned").otherwise("observed").alias("kind"), F.array((F.col("c_custkey") % 25).cast("int"), ((F.col("c_custkey") * 7) % 25).cast("int")).alias("source_ids"))
    sources = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source_id"), (F.col("n_nationkey") % 5 == 0).alias("unverified"))
    return state.claims(items, sources)


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K02."""
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return sinks.csv_rows(d, ["doc_id", "lang", "quality", "n_chars"])


def latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K04."""
    e = load(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    one = lambda rows: rows.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))
    return sinks.upserted(one(e.filter("event_id % 2 = 0")), one(e.filter("event_id % 2 = 1")), ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id")


def write_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K05."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    return sinks.immutable_conflicts(d, d.filter("doc_id % 2 = 0").withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))), "doc_id", "text")


def log_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as log files: past 30 days of the newest, or beyond the byte cap."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), "o_orderdate", (F.col("o_orderkey") % 5000 + 1).alias("size"))
    return sinks.log_victims(o, "o_orderdate", "size", F.lit("2001-08-01").cast("timestamp"), 90, 2 << 20).select("path")


def period_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K09."""
    c = load(spark, sf_dir, "conversations").select("conv_id", F.format_string("%03d", F.col("turn")).alias("day"), F.col("text").alias("body"))
    return sinks.period_text(c, "conv_id", "day", "body").select("conv_id", F.md5("text").alias("text"))


def rendered_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K07."""
    d = load(spark, sf_dir, "documents")
    body = sinks.rendered(F.col("source"), [("Language", F.col("lang")), ("Text", F.col("text")), ("Long", F.when(F.col("n_chars") > 3000, F.reverse("text")).otherwise(""))])
    return d.select("doc_id", F.md5(body).alias("body"))


def day_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W01."""
    return daily.day_windows(load(spark, sf_dir, "events"))


NAMES = (
    run_states, reuse_kinds, run_starts, superseded_runs, revision_violations, pin_violations, access_touches, snapshots_usable, claim_downgrade, csv_export, latest_upsert, write_conflicts, log_cleanup,
    period_texts, rendered_reports, day_windows,
)
QUERIES = {f.__name__: f for f in NAMES}
E = """e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ['created','scanning','prepared','generating','db_committed','published'][1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 6] AS state FROM events)"""
ORACLES = {
    "run_states": f"""WITH {E}, r AS (SELECT *, k % 6 - lag(k % 6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM e)
      SELECT user_id, arg_max(state, (ts, event_id)) AS state, count(*) FILTER (step NOT IN (0, 1)) AS violations FROM r GROUP BY 1""",
    "reuse_kinds": f"""WITH {E} SELECT user_id, event_type, CASE WHEN bool_or(k = 77) THEN 'none' WHEN bool_and(k > 9) THEN 'snapshot' WHEN bool_and(k > 3) THEN 'parse' ELSE 'none' END AS reuse FROM e GROUP BY 1, 2""",
    "run_starts": f"""WITH {E}, a AS (SELECT user_id, max(event_id) AS l, arg_max(k % 3, event_id) AS s, arg_max(k % 2, event_id) AS h FROM e WHERE event_type <> 'signup' GROUP BY 1),
      j AS (SELECT c_custkey AS request_id, l, CASE WHEN l IS NULL THEN 'new' WHEN h <> 0 THEN 'conflict' WHEN s = 0 THEN 'stored' WHEN s = 1 THEN 'in_progress' ELSE 'new' END AS outcome FROM customer LEFT JOIN a ON user_id = c_custkey)
      SELECT request_id, outcome, CASE WHEN outcome = 'new' THEN coalesce(l, 0) + 1 END AS attempt FROM j""",
    "superseded_runs": f"""WITH {E}, p AS (SELECT user_id, max(ts) AS m FROM e WHERE event_type = 'purchase' GROUP BY 1)
      SELECT event_id, CASE WHEN event_type = 'view' AND ts < m THEN 'cancelled' WHEN event_type = 'view' THEN 'pending' ELSE 'done' END AS state FROM e LEFT JOIN p USING (user_id) WHERE event_type IN ('view', 'click')""",
    "revision_violations": """WITH q AS (SELECT l_orderkey, l_linenumber, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2),
      r AS (SELECT *, lag(q) OVER w AS lq, lag(l_linenumber) OVER w AS ln FROM q WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)) SELECT l_orderkey, l_linenumber FROM r WHERE q < lq OR l_linenumber <> coalesce(ln, 0) + 1""",
    "pin_violations": "SELECT doc_id, CASE WHEN doc_id % 21 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 21 = 0 OR doc_id % 23 = 0",
    "access_touches": """WITH h AS (SELECT user_id, max(strftime(ts, '%Y-%m-%d')) AS d FROM events WHERE event_type = 'view' GROUP BY 1), c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '2024-01-20' ELSE '2023-12-01' END AS day FROM customer)
      SELECT c_custkey, greatest(day, coalesce(d, day)) AS day FROM c LEFT JOIN h ON user_id = c_custkey""",
    "snapshots_usable": "SELECT source || '/' || lang AS snapshot, bool_and(doc_id % 67 <> 0) AS usable FROM documents GROUP BY 1",
    "claim_downgrade": "SELECT c_custkey AS item_id, CASE WHEN c_custkey % 3 = 0 THEN 'planned' WHEN (c_custkey % 25) % 5 = 0 OR ((c_custkey * 7) % 25) % 5 = 0 THEN 'uncertain' ELSE 'observed' END AS kind FROM customer",
    "csv_export": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, coalesce(CAST(quality AS VARCHAR), 'unknown') AS quality, CAST(n_chars AS VARCHAR) AS n_chars FROM documents LEFT JOIN labels USING (doc_id)",
    "latest_upsert": "SELECT user_id, event_type, arg_max(event_id, (ts, event_id % 2, event_id)) AS event_id FROM events GROUP BY 1, 2",
    "write_conflicts": "SELECT doc_id FROM documents WHERE doc_id % 10 = 0",
    "log_cleanup": """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderdate AS d, o_orderkey % 5000 + 1 AS s FROM orders),
      k AS (SELECT *, d < TIMESTAMP '2001-08-01' - INTERVAL 90 DAY AS old, sum(CASE WHEN d >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY THEN s ELSE 0 END) OVER (ORDER BY d DESC, path DESC ROWS UNBOUNDED PRECEDING) AS c FROM o)
      SELECT path FROM k WHERE old OR c > 2097152""",
    "period_texts": "SELECT conv_id, md5(string_agg('## ' || lpad(CAST(turn AS VARCHAR), 3, '0') || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS text FROM conversations GROUP BY 1",
    "rendered_reports": """SELECT doc_id, md5('# ' || source || chr(10) || chr(10) || '## Language' || chr(10) || trim(lang) || CASE WHEN trim(text) <> '' THEN chr(10) || chr(10) || '## Text' || chr(10) || trim(text) ELSE '' END
      || CASE WHEN n_chars > 3000 AND trim(text) <> '' THEN chr(10) || chr(10) || '## Long' || chr(10) || trim(reverse(text)) ELSE '' END) AS body FROM documents""",
    "day_windows": """SELECT strftime(CAST(CAST(ts AS TIMESTAMP) + INTERVAL 8 HOUR AS DATE), '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS centi FROM events GROUP BY 1""",
}
