"""Join shapes, set operations, orders and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import joins
from quillspark.queries.base import FILES_SQL, files
from quillspark.session import load


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("day", F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "+08:00")))


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = files(spark, sf_dir)
    base = f.select("doc_id", "file_identity", F.concat(F.lit("size="), "size_bytes").alias("source_version"))
    cache = base.filter("doc_id % 3 <> 0").select(
        "file_identity", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("source_version")).alias("source_version"),
        F.when(F.col("doc_id") % 7 == 0, "p1").otherwise("p2").alias("profile"), F.when(F.col("doc_id") % 11 != 0, F.md5("file_identity")).alias("body_hash"),
    )
    return base.withColumn("profile", F.lit("p2")).withColumn("existed_before", F.col("doc_id") % 2 == 0), cache


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J03, J04, M01, M04."""
    lookups, cache = _cache(spark, sf_dir)
    return joins.cache_lookup(lookups, cache).select("doc_id", "status", "miss_reason")


def cache_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest lineitem of each order's customer with nation: four tables, one row."""
    o, c, n, li = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation", "lineitem"))
    last = joins.latest(li.select("l_orderkey", "l_linenumber", "l_shipdate"), ["l_orderkey"], F.desc("l_shipdate"), F.desc("l_linenumber"))
    out = o.join(last, o.o_orderkey == last.l_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joins.latest(out, ["c_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("c_custkey", "n_name", "o_orderkey", "l_linenumber")


def file_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels, pages and events by number: three left joins that keep every document."""
    d, la, p, e = (load(spark, sf_dir, t) for t in ("documents", "labels", "pages", "events"))
    out = d.select("doc_id", "lang").join(la, "doc_id", "left").join(p.select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left")
    return out.join(e.filter("event_type = 'error'").select(F.col("event_id").alias("doc_id"), "value"), "doc_id", "left").select("doc_id", "lang", "quality", "url", "value")


def pending_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13, L06."""
    e = events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts")
    return joins.unresolved(e.filter("event_type = 'signup'"), e.filter("event_type = 'purchase'"), "user_id").select("event_id", "user_id")


def failures_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14."""
    e = events(spark, sf_dir)
    done = e.filter("event_type = 'purchase'").groupBy("user_id", "day").agg(F.max("ts").alias("published_at"))
    out = e.filter("event_type = 'error'").join(done, ["user_id", "day"])
    return out.filter("published_at > ts").select("event_id", "user_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


def latest_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user and day, if it is an error; equal times go by number."""
    last = joins.latest(events(spark, sf_dir), ["user_id", "day"], F.desc("ts"), F.desc("event_id"))
    return last.filter("event_type = 'error'").select("event_id", "user_id")


def unfinished_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose JSON key names a job that no purchase of theirs has."""
    e = events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    jobs = e.filter("event_type = 'click'").select("user_id", "k").distinct()
    return jobs.join(e.filter("event_type = 'purchase'").select("user_id", "k").distinct(), ["user_id", "k"], "left_anti")


def missed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days between a user's first and last event on which there was none."""
    e = events(spark, sf_dir)
    days = joins.calendar(e.groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b")), ["user_id"], "a", "b")
    return days.join(e.select("user_id", "day").distinct(), ["user_id", "day"], "left_anti").select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


def range_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every weekday of a user's span with its events, 0 where there were none."""
    e = events(spark, sf_dir)
    days = joins.calendar(e.groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b")), ["user_id"], "a", "b").filter(F.dayofweek("day").between(2, 6))
    n = e.groupBy("user_id", "day").agg(F.count("*").alias("n"))
    return days.join(n, ["user_id", "day"], "left").select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def newest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two newest events of each user and type, side by side."""
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    e = load(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.lead("event_id").over(w).alias("before_id"), F.row_number().over(w).alias("n"))
    return e.filter("n = 1 AND before_id IS NOT NULL").select("user_id", "event_type", "before_id", F.col("event_id").alias("after_id"))


def citation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the sources that each user cites, by their position in the source list."""
    e = load(spark, sf_dir, "events").filter("event_type = 'view'")
    cited = e.select("user_id", (F.get_json_object("props", "$.k").cast("long") % 20).alias("i")).distinct()
    names = load(spark, sf_dir, "documents").select("source").distinct()
    labels = names.select("source", (F.row_number().over(Window.orderBy("source")) - 1).cast("long").alias("i"))  # one row a source
    out = cited.join(labels, "i").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("S%03d", F.col("i") + 1))), ", ").alias("labels"))
    return out


def unique_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand once in a document and once in the next but nineteen of its source."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    left = d.withColumn("pair", F.col("doc_id"))
    right = d.withColumn("pair", F.col("doc_id") - 20)
    out = joins.unique_anchors(left.drop("doc_id"), right.drop("doc_id"), ["pair"], "line")
    return out.select("pair", F.md5("line").alias("line"), "left_pos", "right_pos")


def receipt_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J28."""
    f = files(spark, sf_dir).select("file_identity", "extension", "size_bytes", "lang", "doc_id")
    stored = f.filter("doc_id % 97 <> 0").select(
        "file_identity", F.when(F.col("doc_id") % 89 == 0, "?").otherwise(F.col("extension")).alias("extension"), (F.col("size_bytes") + F.when(F.col("doc_id") % 83 == 0, 1).otherwise(0)).alias("size_bytes"), "lang"
    )
    return joins.receipt_mismatches(f.drop("doc_id"), stored, "file_identity", ["extension", "size_bytes", "lang"])


def retry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J22."""
    d = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return joins.retry_merge(d.filter("doc_id % 5 <> 0"), d.filter("doc_id % 7 <> 0").withColumn("n_chars", F.col("n_chars") + 1), "doc_id", "n_chars")


def shared_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small dictionary joined to large rows; a key that it lacks is an error row."""
    li = load(spark, sf_dir, "lineitem")
    names = load(spark, sf_dir, "part").filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return li.select("l_orderkey", "l_linenumber", "l_partkey").join(names, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("p_brand", F.lit("#missing")).alias("brand"))


def deduplicated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical and physical characters, and what equal contents save."""
    d = load(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), "n_chars")
    return d.groupBy("h").agg(F.count("*").alias("n"), F.first("n_chars").alias("c")).agg(
        F.sum("n").alias("versions"), F.sum(F.col("n") * F.col("c")).alias("logical"), F.sum("c").alias("physical"), F.greatest(F.lit(0), F.sum(F.col("n") * F.col("c")) - F.sum("c")).alias("saved")
    )


def content_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior against current content by hash, nulls equal."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    prior = d.filter("doc_id % 4 <> 0").select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("h")).alias("p"))
    return d.join(prior, "doc_id", "left").filter(~F.col("h").eqNullSafe(F.col("p"))).select("doc_id", F.when(F.col("p").isNull(), "unknown").otherwise("changed").alias("change"))


def history_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose normalised path is asked for, in any case and with either separator."""
    f = files(spark, sf_dir)
    asked = f.filter("doc_id % 13 = 0").select(F.translate(F.upper("relative_path"), "/", "\\").alias("p"))
    asked = asked.select(F.lower(F.translate("p", "\\", "/")).alias("p"))
    return f.join(asked, F.lower("relative_path") == asked["p"], "left_semi").select("doc_id", "run_id")


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by what they did: union, intersection and difference of sets, and exact-set equality."""
    e = load(spark, sf_dir, "events")
    sets = e.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    want = F.array(F.lit("click"), F.lit("error"), F.lit("refund"))
    return sets.select(
        "user_id", F.array_join(F.array_sort(F.array_union("types", want)), ",").alias("both"), F.array_join(F.array_sort(F.array_intersect("types", want)), ",").alias("common"),
        F.array_join(F.array_sort(F.array_except("types", want)), ",").alias("unknown"), (F.array_sort("types") == F.array_sort(want)).alias("equal"),
    )


def alias_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents with one content the first path stays; the others become issues."""
    f = files(spark, sf_dir).withColumn("h", F.md5("content"))
    f = f.select("doc_id", "relative_path", "h")
    first = f.groupBy(F.col("h").alias("of")).agg(F.min("relative_path").alias("first"))
    return f.join(first, F.col("h").eqNullSafe(F.col("of"))).select("doc_id", F.when(F.col("relative_path") == F.col("first"), "file").otherwise("issue:path_alias").alias("kind"))


def current_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17, G13, S01."""
    e = load(spark, sf_dir, "events")
    return e.filter("event_type = 'view'").select("user_id").union(e.filter("event_type = 'click' AND value > 100").select("user_id")).distinct()


def slowest_twenty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L02."""
    e = load(spark, sf_dir, "events")
    return e.select("event_id", "value").orderBy(F.desc(F.coalesce("value", F.lit(0.0))), "event_id").limit(20)


def run_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fifty runs of a day, newest first."""
    return events(spark, sf_dir).filter(F.col("day") == F.lit("2024-01-15").cast("date")).orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "user_id")


def warnings_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the first five warnings, run-level ones first; the rest folded by type."""
    e = load(spark, sf_dir, "events").withColumn("run_level", F.col("event_type") == "error")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("run_level"), "event_id"))
    e = e.withColumn("n", n)
    shown = e.filter("n <= 5").select("user_id", "event_type", F.col("event_id").alias("first_id"), F.lit(1).cast("long").alias("rows"), F.lit(False).alias("folded"))
    rest = e.filter("n > 5").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"), F.count("*").alias("rows")).withColumn("folded", F.lit(True))
    return shown.unionByName(rest)


NAMES = (
    cache_lookup, cache_provenance, file_audit, pending_runs, failures_resolved, latest_issue, unfinished_jobs, missed_dates, range_with_gaps, newest_pair, citation_labels, unique_anchors, receipt_check,
    retry_merge, shared_strings, deduplicated_bytes, content_changes, history_by_path, set_operations, alias_dedup, current_runs, slowest_twenty, run_listing, warnings_first,
)
QUERIES = {f.__name__: f for f in NAMES}
EV = "ev AS (SELECT *, CAST(CAST(ts AS TIMESTAMP) + INTERVAL 8 HOUR AS DATE) AS day FROM events)"
ORACLES = {
    "cache_lookup": f"""WITH {FILES_SQL}, b AS (SELECT doc_id, file_identity, 'size=' || size_bytes AS v FROM named),
      c AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE v END AS v2, CASE WHEN doc_id % 7 = 0 THEN 'p1' ELSE 'p2' END AS p, doc_id % 11 <> 0 AS good FROM b WHERE doc_id % 3 <> 0)
      SELECT b.doc_id, CASE WHEN c.v2 = b.v AND c.p = 'p2' AND c.good THEN 'hit' ELSE 'miss' END AS status,
        CASE WHEN c.v2 = b.v AND c.p = 'p2' AND c.good THEN NULL WHEN c.v2 = b.v AND c.p = 'p2' THEN 'cache_corrupt' WHEN c.v2 = b.v THEN 'profile_changed' WHEN c.doc_id IS NOT NULL THEN 'source_changed'
          WHEN b.doc_id % 2 = 0 THEN 'not_cached_before' ELSE 'new_file' END AS miss_reason FROM b LEFT JOIN c USING (doc_id)""",
    "cache_provenance": """SELECT c_custkey, n_name, o_orderkey, l_linenumber FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      JOIN (SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC) = 1) ON l_orderkey = o_orderkey
      QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "file_audit": """SELECT d.doc_id, d.lang, l.quality, p.url, e.value FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id
      LEFT JOIN events e ON e.event_id = d.doc_id AND e.event_type = 'error'""",
    "pending_runs": "SELECT event_id, user_id FROM events r WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = r.user_id AND p.ts > r.ts)",
    "failures_resolved": f"WITH {EV} SELECT event_id, user_id, strftime(day, '%Y-%m-%d') AS day FROM ev r WHERE event_type = 'error' AND EXISTS (SELECT 1 FROM ev p WHERE p.event_type = 'purchase' AND p.user_id = r.user_id AND p.day = r.day AND p.ts > r.ts)",
    "latest_issue": f"WITH {EV} SELECT event_id, user_id FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type = 'error'",
    "unfinished_jobs": """WITH e AS (SELECT DISTINCT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
      SELECT user_id, k FROM e WHERE event_type = 'click' EXCEPT SELECT user_id, k FROM e WHERE event_type = 'purchase'""",
    "missed_dates": f"""WITH {EV}, b AS (SELECT user_id, unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM ev GROUP BY user_id)
      SELECT user_id, strftime(d, '%Y-%m-%d') AS day FROM b WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.user_id = b.user_id AND ev.day = CAST(b.d AS DATE))""",
    "range_with_gaps": f"""WITH {EV}, b AS (SELECT user_id, unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM ev GROUP BY user_id),
      n AS (SELECT user_id, day, count(*) AS n FROM ev GROUP BY ALL)
      SELECT b.user_id, strftime(d, '%Y-%m-%d') AS day, coalesce(n.n, 0) AS n FROM b LEFT JOIN n ON n.user_id = b.user_id AND n.day = CAST(b.d AS DATE) WHERE isodow(d) <= 5""",
    "newest_pair": """WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
      SELECT a.user_id, a.event_type, b.event_id AS before_id, a.event_id AS after_id FROM r a JOIN r b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.n = 1 AND b.n = 2""",
    "citation_labels": """WITH c AS (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS i FROM events WHERE event_type = 'view'),
      s AS (SELECT row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM documents))
      SELECT user_id, string_agg('S' || lpad(CAST(i + 1 AS VARCHAR), 3, '0'), ', ' ORDER BY i) AS labels FROM c JOIN s USING (i) GROUP BY user_id""",
    "unique_anchors": """WITH l AS (SELECT doc_id, unnest(str_split(text, chr(10))) AS line, CAST(unnest(range(0, len(str_split(text, chr(10))))) AS INTEGER) AS pos FROM documents),
      u AS (SELECT doc_id, line, min(pos) AS pos FROM l GROUP BY ALL HAVING count(*) = 1)
      SELECT a.doc_id AS pair, md5(a.line) AS line, a.pos AS left_pos, b.pos AS right_pos FROM u a JOIN u b ON b.doc_id = a.doc_id + 20 AND a.line = b.line""",
    "receipt_check": f"""WITH {FILES_SQL} SELECT file_identity, CASE WHEN doc_id % 97 = 0 THEN 'missing' ELSE concat_ws(',', CASE WHEN doc_id % 89 = 0 THEN 'extension' END, CASE WHEN doc_id % 83 = 0 THEN 'size_bytes' END) END AS wrong
      FROM named WHERE doc_id % 97 = 0 OR doc_id % 89 = 0 OR doc_id % 83 = 0""",
    "retry_merge": """SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN n_chars + 1 ELSE n_chars END AS n_chars, CASE WHEN doc_id % 7 = 0 THEN 'vanished' ELSE 'ok' END AS state FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 7 <> 0""",
    "shared_strings": "SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey % 10 <> 0 THEN p_brand ELSE '#missing' END AS brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey",
    "deduplicated_bytes": """SELECT CAST(sum(n) AS BIGINT) AS versions, CAST(sum(n * c) AS BIGINT) AS logical, CAST(sum(c) AS BIGINT) AS physical, CAST(greatest(0, sum(n * c) - sum(c)) AS BIGINT) AS saved
      FROM (SELECT text, count(*) AS n, min(n_chars) AS c FROM documents GROUP BY text)""",
    "content_changes": "SELECT doc_id, 'unknown' AS change FROM documents WHERE doc_id % 4 = 0 OR doc_id % 9 = 0",
    "history_by_path": f"WITH {FILES_SQL} SELECT doc_id, run_id FROM named WHERE doc_id % 13 = 0",
    "set_operations": """WITH s AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS t FROM events GROUP BY user_id)
      SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(t, ['click','error','refund']))), ',') AS both, array_to_string(list_sort(list_filter(t, lambda x: list_contains(['click','error','refund'], x))), ',') AS common,
        array_to_string(list_sort(list_filter(t, lambda x: NOT list_contains(['click','error','refund'], x))), ',') AS unknown, t = ['click','error','refund'] AS equal FROM s""",
    "alias_dedup": f"WITH {FILES_SQL} SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY content ORDER BY relative_path) = 1 THEN 'file' ELSE 'issue:path_alias' END AS kind FROM named",
    "current_runs": "SELECT user_id FROM events WHERE event_type = 'view' UNION SELECT user_id FROM events WHERE event_type = 'click' AND value > 100",
    "slowest_twenty": "SELECT event_id, value FROM events ORDER BY coalesce(value, 0) DESC, event_id LIMIT 20",
    "run_listing": f"WITH {EV} SELECT event_id, user_id FROM ev WHERE day = DATE '2024-01-15' ORDER BY ts DESC, event_id LIMIT 50",
    "warnings_first": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error' DESC, event_id) AS n FROM events)
      SELECT user_id, event_type, event_id AS first_id, CAST(1 AS BIGINT) AS "rows", false AS folded FROM r WHERE n <= 5
      UNION ALL SELECT user_id, event_type, min(event_id), count(*), true FROM r WHERE n > 5 GROUP BY user_id, event_type""",
}
