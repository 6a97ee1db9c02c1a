"""Queries of predicates and decisions on evidence. Each docstring names the operators it covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import evidence
from quillspark.operators import windows
from quillspark.queries.base import FILES_SQL, files
from quillspark.session import load

TIMEOUTS = {".pdf": 60_000, ".docx": 30_000, ".xlsx": 30_000, ".log": 5_000}
PLANTED = (" 合计 7", " 不得", " 通过 3", "", " 12", " 节点")
ROOTS = ("work/", "work\\b", "notes")


def parse_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B11."""
    return files(spark, sf_dir).select("doc_id", evidence.timeout_ms(F.col("extension"), TIMEOUTS, 15_000).alias("ms"))


def line_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by priority; some lines carry planted words."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    planted = F.element_at(F.array(*(F.lit(w) for w in PLANTED)), ((F.col("doc_id") + F.col("pos")) % 6 + 1).cast("int"))
    kind = F.when(F.col("line").startswith("#"), "heading").when((F.col("doc_id") + F.col("pos")) % 11 == 0, "total").when(F.col("line").contains("|"), "table_row").when(F.col("pos") % 13 == 12, "unit").otherwise("text")
    d = d.select("doc_id", kind.alias("kind"), F.concat("line", planted).alias("line"))
    d = d.withColumn("priority", evidence.unit_priority(F.col("kind"), F.col("line")))
    return d.groupBy("doc_id", "priority").agg(F.count("*").alias("n"), F.count_if(evidence.useful(F.col("kind"))).alias("useful"))


def partial_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B19."""
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    counters = F.create_map(F.lit("budget"), F.count_if(F.col("k") == 7), F.lit("read_failed"), F.count_if(F.col("k") == 8), F.lit("unchanged"), F.count("*"))
    return e.groupBy("user_id").agg(evidence.partial(F.bool_or(F.col("k") == 9), counters).alias("partial"))


def sheet_row_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as rows of sheets, with headers, unit lines, totals and padding among them."""
    li = load(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey") + F.col("l_linenumber")
    cells = (
        F.when(k % 11 == 0, F.array(F.lit("Name"), F.lit("Amount"), F.lit("Date"))).when(k % 11 == 1, F.array(F.lit("单位：元"), F.lit(""), F.lit(""))).when(k % 11 == 2, F.array(F.lit("合计"), F.lit("5"), F.lit("")))
        .when(k % 11 == 3, F.array(F.lit(""), F.lit("0"), F.lit("0.0"))).otherwise(F.array(F.col("l_returnflag"), F.col("l_partkey").cast("string"), F.col("l_linestatus")))
    )
    return li.select("l_orderkey", "l_linenumber", "l_partkey", evidence.sheet_row_kind(cells, k % 2 == 1, F.col("l_suppkey") % 9 == 0).alias("kind"))


def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B23."""
    path = F.translate("relative_path", "/", "\\")
    return files(spark, sf_dir).select("doc_id", *(evidence.in_scope(path, r).alias(f"root{i}") for i, r in enumerate(ROOTS)))


def source_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose hash, range, window or reference breaks a rule; faults are planted."""
    d = load(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", F.sha2("text", 256).alias("sha"))
    sha = F.when(F.col("doc_id") % 17 == 0, F.upper("sha")).when(F.col("doc_id") % 19 == 0, F.left("sha", F.lit(60))).otherwise(F.col("sha"))
    end = F.col("n_chars") + F.when(F.col("doc_id") % 23 == 0, 1).otherwise(0)
    start = F.when(F.col("doc_id") % 29 == 0, end + 1).otherwise(F.lit(0))
    known = d.select("source").distinct().withColumn("known", ~F.col("source").startswith("a"))
    d = d.join(known, "source", "left")
    broken = F.array(
        F.when(~F.coalesce(sha, F.lit("")).rlike("^[0-9a-f]{64}$"), "hash"), F.when(end > F.col("n_chars"), "range"), F.when(start > end, "window"), F.when(~F.coalesce("known", F.lit(False)), "reference")
    )
    return d.select("doc_id", F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"))


def recovery_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B26."""
    names = ("MODEL_TIMEOUT", "PARSE_BOUNDED", "MEMORY_RESERVE", "PERSONAL_CALL_LIMIT", "SOURCE_UNAVAILABLE")
    code = F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("k") % 5 + 1).cast("int"))
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    g = e.groupBy("user_id", "day").agg(F.collect_set(F.when(F.col("event_type") == "error", code)).alias("codes"), F.count_if(F.col("k") == 3).alias("failed"), F.count_if(F.col("event_type") == "view").alias("items"), F.count("*").alias("seen"))
    return g.select("user_id", "day", F.array_join(evidence.recovery_reasons(F.col("codes"), F.col("failed"), F.col("items"), F.col("seen") - 1, F.lit("")), ",").alias("reasons"))


def unstable_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B27."""
    reasons = (None, "Source_Unstable", "hash: SOURCE_CHANGED", "source_guard_unavailable", "guard_unavailable", "source_version_changed", "timeout")
    d = files(spark, sf_dir).withColumn("reason", F.element_at(F.array(*(F.lit(r) for r in reasons)), (F.col("doc_id") % 7 + 1).cast("int")))
    return d.filter(evidence.unstable(F.col("reason"))).select("doc_id", "reason")


def active_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs, seen a while after the last."""
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    phase = F.element_at(F.array(*(F.lit(p) for p in (*evidence.ACTIVE_PHASES, "published"))), (F.col("k") % 6 + 1).cast("int"))
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    alive = evidence.active(F.when(F.col("event_type") == "purchase", "done").otherwise("running"), phase, F.when(F.col("k") % 4 == 0, F.col("ts")), F.when(F.col("event_type") == "error", "E"), F.col("ts"), now, 5 * 86_400)
    return e.filter(alive).select("event_id", phase.alias("phase"))


def exposed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by a fixed list of columns; payloads are never among them."""
    return load(spark, sf_dir, "events").select("event_id", "user_id", "event_type")


def folded_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 256 diagnostics of a run, the rest by stage, code and whether a retry may help."""
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    e = e.select("event_id", F.col("event_type").alias("run"), (F.col("k") % 4).alias("stage"), (F.col("k") % 3).alias("code"), (F.col("k") % 2 == 0).alias("retry"))
    first = windows.first_rows(e, ["run"], ["event_id"], 256).select("run", "event_id", "stage", "code", "retry", F.lit(1).cast("long").alias("n"))
    last = first.groupBy(F.col("run").alias("of")).agg(F.max("event_id").alias("last"))
    rest = e.join(last, F.col("run") == F.col("of")).filter("event_id > last").groupBy("run", "stage", "code", "retry").agg(F.count("*").alias("n"))
    return first.unionByName(rest.withColumn("event_id", F.lit(None).cast("long")))


def archive_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by status, gaps by code, and truncated files."""
    f = files(spark, sf_dir)
    status = F.when(F.col("size_bytes") > 30_000, "too_large").when(F.col("n_chars") < 300, "empty").otherwise("ok")
    codes = F.filter(F.array(F.when(F.col("truncated"), "PARSE_BOUNDED"), F.when(F.col("extension") == ".pdf", "NO_PARSER"), F.when(F.col("n_chars") < 300, "NO_TEXT")), lambda c: c.isNotNull())
    f = f.select(F.concat(F.array(F.struct(F.lit("status").alias("what"), status.alias("name"))), F.transform(codes, lambda c: F.struct(F.lit("gap").alias("what"), c.alias("name"))), F.when(F.col("truncated"), F.array(F.struct(F.lit("truncated").alias("what"), F.lit("").alias("name")))).otherwise(F.array().cast("array<struct<what:string,name:string>>"))).alias("all"))
    return f.select(F.explode("all").alias("a")).groupBy("a.what", "a.name").agg(F.count("*").alias("n"))


def work_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures with four sums, null where none was ever recorded."""
    f = files(spark, sf_dir)
    when = lambda c, x: F.sum(F.when(c, x)).cast("long")
    return f.groupBy("extension").agg(
        F.count("*").alias("files"), when(F.col("extension") != ".bin", F.col("size_bytes")).alias("bytes_read"), when(F.col("doc_id") % 3 == 0, F.col("n_chars")).alias("parse_ms"),
        when(F.col("extension").isin(".md", ".txt"), F.col("doc_id") % 7).alias("diff_ms"), when(F.col("doc_id") < 0, F.col("doc_id")).alias("queue_ms"),
    )


def group_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as identities of sheet rows: how many rows, the columns that all share, and the one that differs with its values."""
    columns = ("l_returnflag", "l_linestatus", "l_suppkey")
    field = lambda name: lambda r: r[name]
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", *columns).alias("row"))
    rows = F.array_sort(F.transform("rows", lambda r: F.struct(r["l_linenumber"].alias("l_linenumber"), *(r[c].cast("string").alias(c) for c in columns))))
    g = li.groupBy("l_orderkey").agg(F.collect_list("row").alias("rows")).filter("size(rows) >= 2").select("l_orderkey", F.size("rows").cast("long").alias("n"), rows.alias("rows"))
    g = g.select("l_orderkey", "n", *(F.array_distinct(F.filter(F.transform("rows", field(c)), lambda v: v.isNotNull())).alias(f"a_{c}") for c in columns))
    many = {c: F.size(f"a_{c}") for c in columns}
    common = F.concat_ws("；", *(F.when(many[c] == 1, F.concat(F.lit(f"{c} = "), F.get(f"a_{c}", F.lit(0)))) for c in columns))
    varied = F.filter(F.array(*(F.when(many[c] > 1, F.lit(c)) for c in columns)), lambda c: c.isNotNull())
    one = F.when(F.size(varied) == 1, varied[0])
    values = F.coalesce(*(F.when(one == c, F.array_join(F.col(f"a_{c}"), "、")) for c in columns))
    return g.select("l_orderkey", "n", common.alias("common"), one.alias("differing"), values.alias("values"))


def amount_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer each order priority with its months, if there are two or more, in lines of 480 characters at most."""
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    v = o.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first"), F.array_sort(F.collect_list(F.struct("o_orderkey", "month"))).alias("all"))
    field = F.concat(F.lit("Amount = "), F.col("o_orderpriority"), F.lit("（对应Month = "), F.array_join(F.transform("all", lambda x: x["month"]), "、"), F.lit("）；"))
    g = v.select("o_custkey", "first", field.alias("field")).groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "field"))), lambda x: x["field"]).alias("fields")).filter("size(fields) >= 2")
    prefix, suffix = F.concat(F.lit("读取窗口统计：Name = "), F.col("o_custkey").cast("string"), F.lit("；")), "统计仅指本次读取范围。"
    g = g.withColumn("room", 480 - F.length(prefix) - len(suffix))
    g = g.withColumn("fields", F.filter("fields", lambda f: F.length(f) <= F.col("room")))
    g = g.withColumn("groups", windows.greedy_groups(F.transform("fields", F.length), F.col("room"), 0))
    text = F.transform(F.sequence(F.lit(0), F.array_max("groups")), lambda n: F.concat(prefix, F.array_join(F.filter("fields", lambda f, i: F.get("groups", i) == n), ""), F.lit(suffix)))
    return g.filter("size(fields) > 0").select("o_custkey", F.posexplode(text).alias("line", "text"))


def report_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a report's sources and gap codes, and the scan's quality."""
    d = load(spark, sf_dir, "documents")
    usable, gap = F.col("n_chars") > 400, F.when(F.col("doc_id") % 6 == 0, "SOURCE_UNAVAILABLE").when(F.col("n_chars") > 20_000, "PARSE_BOUNDED")
    g = d.groupBy("source", "lang").agg(F.count("*").alias("sources_total"), F.count_if(usable).alias("sources_usable"), F.count(gap).alias("gaps_total"), F.count_distinct(gap).alias("gaps_codes"), F.bool_and(F.col("n_chars") > 3000).alias("failed"))
    return g.select("source", "lang", "sources_total", "sources_usable", (F.col("sources_total") - F.col("sources_usable")).alias("sources_failed"), "gaps_total", "gaps_codes", evidence.scan_quality(F.col("failed"), F.col("sources_total"), F.col("sources_usable"), F.col("gaps_total")).alias("quality"))


def first_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 5000 files in path order, with the number of all."""
    f = files(spark, sf_dir).select("relative_path", "doc_id")
    return f.withColumn("total", f.agg(F.count("*")).scalar()).orderBy("relative_path").limit(5000)


def issue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by path, kind and message."""
    f = files(spark, sf_dir).filter("size_bytes > 5000 OR extension = '.bin'")
    return f.select("relative_path", F.when(F.col("extension") == ".bin", "extension").otherwise("size").alias("kind"), F.col("size_bytes").cast("string").alias("message")).orderBy("relative_path", "kind", "message")


def wave_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of all waves, repeats kept."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source")
    return d.filter("doc_id % 3 = 0").unionByName(d.filter("doc_id % 2 = 0")).unionByName(d.filter("doc_id % 5 = 0"))


def facts_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that the composed report does not mention."""
    facts = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fact_id"), "o_orderstatus")
    cited = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("fact_id"))
    return facts.join(cited, "fact_id", "left_anti")


def paragraph_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14, on texts whose full stops and commas stand for 。 and ；."""
    d = load(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", evidence.paragraph_parts(F.translate("text", ".,", "。；")).alias("parts"))
    parts = F.col("parts")
    return d.select("doc_id", F.size(parts).cast("long").alias("parts"), F.array_join(F.transform(parts, F.length), ",").alias("lengths"))


def valid_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18."""
    return load(spark, sf_dir, "documents").select("doc_id", evidence.valid_chars(F.col("text")).cast("long").alias("valid"))


def usage_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token usage under both namings, and the wait before a retry."""
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    usage = F.to_json(F.struct(F.when(F.col("k") % 2 == 0, F.col("k")).alias("prompt_tokens"), F.when(F.col("k") % 2 == 1, F.col("k")).alias("input_tokens"), F.when(F.col("k") % 3 != 0, F.col("user_id")).alias("completion_tokens"), F.when(F.col("k") % 5 != 0, F.col("k") * 2).alias("total_tokens")))
    header = F.when(F.col("k") % 4 == 0, F.concat(F.lit(" "), F.col("k").cast("string"))).when(F.col("k") % 4 == 1, "soon")
    return e.select("event_id", evidence.usage_tokens(usage).alias("u"), evidence.retry_delay(header, F.col("k") % 9).alias("delay")).select("event_id", "u.incoming", "u.outgoing", "u.total", "delay")


def row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of table rows under the first header of their sheet."""
    d = load(spark, sf_dir, "documents")
    header = F.when(F.length("source") % 3 == 0, F.array(F.lit("Name"), F.lit("订单编号"), F.lit("id"))).when(F.length("source") % 3 == 1, F.array(F.lit("ID"), F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    cells = F.array(F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("lang")), F.col("n_chars").cast("string"), F.col("doc_id").cast("string"))
    return d.select("doc_id", evidence.row_key(F.col("source"), header, cells).alias("row_key"))


def report_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of a month by its prefix in order of days, with the user's note as a source of its own."""
    e = load(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).filter(F.col("day").startswith("2024-01"))
    reports = e.groupBy("day").agg(F.count("*").alias("n"), F.max("event_id").alias("newest")).withColumn("source", F.lit("report"))
    note = spark.range(1).select(F.lit("2024-01-31").alias("day"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("newest"), F.lit("user_input").alias("source"))
    return reports.unionByName(note).orderBy("day")


def rendered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as pretty JSON and as text lines."""
    c = load(spark, sf_dir, "customer")
    body = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.struct(F.col("c_mktsegment").alias("segment")).alias("of")), {"pretty": "true"})
    return c.select("c_custkey", F.md5(body).alias("json"), F.format_string("%06d  %-12s %s", "c_custkey", "c_mktsegment", "c_name").alias("line"))


NAMES = (
    parse_timeouts, line_priorities, partial_selections, sheet_row_kinds, scope_filter, source_violations, recovery_reasons, unstable_sources, active_runs, exposed_columns, folded_diagnostics, archive_coverage, work_totals,
    group_summaries, amount_series, report_headlines, first_files, issue_order, wave_union, facts_uncovered, paragraph_splits, valid_characters, usage_tokens, row_keys, report_history, rendered_rows,
)
QUERIES = {f.__name__: f for f in NAMES}
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
MARKED, QUALIFIED = evidence.any_of(evidence.MARKERS), evidence.any_of(evidence.QUALIFIERS)
ORACLES = {
    "parse_timeouts": f"WITH {FILES_SQL} SELECT doc_id, CAST(CASE extension WHEN '.pdf' THEN 60000 WHEN '.docx' THEN 30000 WHEN '.xlsx' THEN 30000 WHEN '.log' THEN 5000 ELSE 15000 END AS INTEGER) AS ms FROM named",
    "line_priorities": f"""WITH l AS (SELECT doc_id, unnest(range(0, len(str_split(text, chr(10))))) AS pos, unnest(str_split(text, chr(10))) AS line FROM documents),
      p AS (SELECT doc_id, CASE WHEN starts_with(line, '#') THEN 'heading' WHEN (doc_id + pos) % 11 = 0 THEN 'total' WHEN contains(line, '|') THEN 'table_row' WHEN pos % 13 = 12 THEN 'unit' ELSE 'text' END AS kind,
        line || [' 合计 7',' 不得',' 通过 3','',' 12',' 节点'][1 + (doc_id + pos) % 6] AS line FROM l),
      r AS (SELECT *, CASE WHEN kind = 'total' THEN 0 WHEN kind = 'table_row' AND d THEN 1 WHEN d AND regexp_matches(line, '{MARKED}') THEN 1 WHEN regexp_matches(line, '{QUALIFIED}') THEN 2 WHEN kind = 'table_row' OR kind NOT IN ('heading', 'unit') AND d THEN 3 ELSE 4 END AS priority
        FROM (SELECT *, regexp_matches(line, '[0-9]') AS d FROM p))
      SELECT doc_id, CAST(priority AS INTEGER) AS priority, count(*) AS n, count(*) FILTER (kind NOT IN ('heading', 'unit')) AS useful FROM r GROUP BY 1, 2""",
    "partial_selections": f"SELECT user_id, bool_or({K} IN (7, 8, 9)) AS partial FROM events GROUP BY 1",
    "sheet_row_kinds": """SELECT l_orderkey, l_linenumber, l_partkey, CASE k % 11 WHEN 0 THEN 'table_header' WHEN 1 THEN 'unit' WHEN 2 THEN 'total' ELSE CASE WHEN k % 11 = 3 AND k % 2 = 1 THEN 'placeholder' WHEN l_suppkey % 9 = 0 THEN 'total' ELSE 'table_row' END END AS kind
      FROM (SELECT *, l_orderkey + l_linenumber AS k FROM lineitem)""",
    "scope_filter": f"WITH {FILES_SQL} SELECT doc_id, relative_path LIKE 'work/%' AS root0, relative_path LIKE 'work/b/%' AS root1, relative_path LIKE 'notes/%' AS root2 FROM named",
    "source_violations": """SELECT doc_id, 'hash' AS rule FROM documents WHERE text IS NULL OR doc_id % 17 = 0 AND sha256(text) <> upper(sha256(text)) OR doc_id % 17 <> 0 AND doc_id % 19 = 0 UNION ALL SELECT doc_id, 'range' FROM documents WHERE doc_id % 23 = 0
      UNION ALL SELECT doc_id, 'window' FROM documents WHERE doc_id % 29 = 0 UNION ALL SELECT doc_id, 'reference' FROM documents WHERE source IS NULL OR starts_with(source, 'a')""",
    "recovery_reasons": f"""WITH e AS (SELECT *, {K} AS k, strftime(ts, '%Y-%m-%d') AS day FROM events), c AS (
        SELECT user_id, day, unnest(['MODEL_TIMEOUT', 'MEMORY_RESERVE', 'PERSONAL_CALL_LIMIT', 'PARSE_UNAVAILABLE', 'PERSONAL_SUMMARY_UNAVAILABLE']) AS code,
          unnest([bool_or(event_type = 'error' AND k % 5 = 0), bool_or(event_type = 'error' AND k % 5 = 2), bool_or(event_type = 'error' AND k % 5 = 3), bool_or(k = 3), count(*) FILTER (event_type = 'view') = 0 AND count(*) > 1]) AS has FROM e GROUP BY 1, 2)
      SELECT user_id, day, coalesce(string_agg(code, ',' ORDER BY code) FILTER (has), '') AS reasons FROM c GROUP BY 1, 2""",
    "unstable_sources": "SELECT doc_id, [NULL, 'Source_Unstable', 'hash: SOURCE_CHANGED', 'source_guard_unavailable', NULL, 'source_version_changed', NULL][1 + doc_id % 7] AS reason FROM documents WHERE doc_id % 7 IN (1, 2, 3, 5)",
    "active_runs": f"""WITH e AS (SELECT *, {K} AS k, CAST(ts AS TIMESTAMP) AS t FROM events) SELECT event_id, ['created','scanning','prepared','generating','db_committed'][1 + k % 6] AS phase FROM e
      WHERE event_type NOT IN ('purchase', 'error') AND k % 4 <> 0 AND k % 6 < 5 AND epoch(TIMESTAMP '2024-01-20') - floor(epoch(t)) >= 0 AND epoch(TIMESTAMP '2024-01-20') - floor(epoch(t)) < 432000""",
    "exposed_columns": "SELECT event_id, user_id, event_type FROM events",
    "folded_diagnostics": f"""WITH e AS (SELECT event_id, event_type AS run, {K} % 4 AS stage, {K} % 3 AS code, {K} % 2 = 0 AS retry, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events)
      SELECT run, event_id, stage, code, retry, 1 AS n FROM e WHERE i <= 256 UNION ALL SELECT run, NULL, stage, code, retry, count(*) FROM e WHERE i > 256 GROUP BY run, stage, code, retry""",
    "archive_coverage": f"""WITH {FILES_SQL}, a AS (SELECT 'status' AS what, CASE WHEN size_bytes > 30000 THEN 'too_large' WHEN n_chars < 300 THEN 'empty' ELSE 'ok' END AS name FROM named UNION ALL SELECT 'gap', 'PARSE_BOUNDED' FROM named WHERE truncated
      UNION ALL SELECT 'gap', 'NO_PARSER' FROM named WHERE extension = '.pdf' UNION ALL SELECT 'gap', 'NO_TEXT' FROM named WHERE n_chars < 300 UNION ALL SELECT 'truncated', '' FROM named WHERE truncated) SELECT what, name, count(*) AS n FROM a GROUP BY 1, 2""",
    "work_totals": f"""WITH {FILES_SQL} SELECT extension, count(*) AS files, CAST(sum(size_bytes) FILTER (extension <> '.bin') AS BIGINT) AS bytes_read, CAST(sum(n_chars) FILTER (doc_id % 3 = 0) AS BIGINT) AS parse_ms,
      CAST(sum(doc_id % 7) FILTER (extension IN ('.md', '.txt')) AS BIGINT) AS diff_ms, CAST(NULL AS BIGINT) AS queue_ms FROM named GROUP BY 1""",
    "group_summaries": """WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag) AS a, count(DISTINCT l_linestatus) AS b, count(DISTINCT l_suppkey) AS c, min(l_returnflag) AS x, min(l_linestatus) AS y, min(CAST(l_suppkey AS VARCHAR)) AS z FROM lineitem GROUP BY 1 HAVING count(*) >= 2),
      v AS (SELECT l_orderkey, string_agg(l_returnflag, '、' ORDER BY f) AS va FROM (SELECT l_orderkey, l_returnflag, min((l_linenumber, l_returnflag, l_linestatus, CAST(l_suppkey AS VARCHAR))) AS f FROM lineitem GROUP BY 1, 2) GROUP BY 1),
      w AS (SELECT l_orderkey, string_agg(l_linestatus, '、' ORDER BY f) AS vb FROM (SELECT l_orderkey, l_linestatus, min((l_linenumber, l_returnflag, l_linestatus, CAST(l_suppkey AS VARCHAR))) AS f FROM lineitem GROUP BY 1, 2) GROUP BY 1),
      u AS (SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), '、' ORDER BY f, CAST(l_suppkey AS VARCHAR)) AS vc FROM (SELECT l_orderkey, l_suppkey, min((l_linenumber, l_returnflag, l_linestatus, CAST(l_suppkey AS VARCHAR))) AS f FROM lineitem GROUP BY 1, 2) GROUP BY 1),
      o AS (SELECT *, CASE WHEN a > 1 AND b = 1 AND c = 1 THEN 'l_returnflag' WHEN a = 1 AND b > 1 AND c = 1 THEN 'l_linestatus' WHEN a = 1 AND b = 1 AND c > 1 THEN 'l_suppkey' END AS differing FROM g)
      SELECT l_orderkey, n, concat_ws('；', CASE WHEN a = 1 THEN 'l_returnflag = ' || x END, CASE WHEN b = 1 THEN 'l_linestatus = ' || y END, CASE WHEN c = 1 THEN 'l_suppkey = ' || z END) AS common, differing,
        CASE differing WHEN 'l_returnflag' THEN va WHEN 'l_linestatus' THEN vb WHEN 'l_suppkey' THEN vc END AS values FROM o JOIN v USING (l_orderkey) JOIN w USING (l_orderkey) JOIN u USING (l_orderkey)""",
    "amount_series": """WITH RECURSIVE v AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS f, string_agg(strftime(o_orderdate, '%Y-%m'), '、' ORDER BY o_orderkey, strftime(o_orderdate, '%Y-%m')) AS m FROM orders GROUP BY 1, 2),
      t AS (SELECT o_custkey, f, 'Amount = ' || o_orderpriority || '（对应Month = ' || m || '）；' AS field, count(*) OVER (PARTITION BY o_custkey) AS n, '读取窗口统计：Name = ' || o_custkey || '；' AS p FROM v),
      k AS (SELECT *, 480 - length(p) - 11 AS room, row_number() OVER (PARTITION BY o_custkey ORDER BY f) AS i FROM t WHERE n >= 2 AND length(field) <= 480 - length(p) - 11),
      r AS (SELECT o_custkey, i, p, room, field AS text, length(field) AS used, 0 AS line FROM k WHERE i = 1 UNION ALL
        SELECT k.o_custkey, k.i, k.p, k.room, CASE WHEN used + length(k.field) <= k.room THEN r.text || k.field ELSE k.field END, CASE WHEN used + length(k.field) <= k.room THEN used + length(k.field) ELSE length(k.field) END,
          CASE WHEN used + length(k.field) <= k.room THEN line ELSE line + 1 END FROM r JOIN k ON k.o_custkey = r.o_custkey AND k.i = r.i + 1)
      SELECT o_custkey, CAST(line AS INTEGER) AS line, arg_max(p || text || '统计仅指本次读取范围。', i) AS text FROM r GROUP BY o_custkey, line""",
    "report_headlines": """WITH g AS (SELECT source, lang, count(*) AS t, count(*) FILTER (n_chars > 400) AS u, count(*) FILTER (doc_id % 6 = 0 OR n_chars > 20000) AS gt, count(DISTINCT CASE WHEN doc_id % 6 = 0 THEN 1 WHEN n_chars > 20000 THEN 2 END) AS gc, bool_and(n_chars > 3000) AS f FROM documents GROUP BY 1, 2)
      SELECT source, lang, t AS sources_total, u AS sources_usable, t - u AS sources_failed, gt AS gaps_total, gc AS gaps_codes, CASE WHEN f OR u = 0 THEN 'unavailable' WHEN gt > 0 THEN 'partial' ELSE 'complete' END AS quality FROM g""",
    "first_files": f"WITH {FILES_SQL} SELECT relative_path, doc_id, (SELECT count(*) FROM named) AS total FROM named ORDER BY relative_path LIMIT 5000",
    "issue_order": f"WITH {FILES_SQL} SELECT relative_path, CASE WHEN extension = '.bin' THEN 'extension' ELSE 'size' END AS kind, CAST(size_bytes AS VARCHAR) AS message FROM named WHERE size_bytes > 5000 OR extension = '.bin'",
    "wave_union": "SELECT doc_id, source FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, source FROM documents WHERE doc_id % 5 = 0",
    "facts_uncovered": "SELECT o_orderkey AS fact_id, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "paragraph_splits": """WITH t AS (SELECT doc_id, translate(text, '.,', '。；') AS b FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, b, length(b) AS n, regexp_extract_all(b, '[^。；]*[。；]') AS s FROM t),
      u AS (SELECT doc_id, n, unnest(range(1, len(s) + 1)) AS i, unnest(list_transform(s, lambda x: length(x))) AS l FROM n WHERE n > 240),
      c AS (SELECT doc_id, n, cut, row_number() OVER (PARTITION BY doc_id ORDER BY cut) AS i, count(*) OVER (PARTITION BY doc_id) AS cuts FROM (SELECT doc_id, n, CAST(sum(l) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS cut FROM u) WHERE cut < n),
      k AS (SELECT *, least(CAST(ceil(n / 240.0) AS BIGINT), 3, cuts + 1) AS parts FROM c),
      a AS (SELECT doc_id, any_value(n) AS n, any_value(parts) AS parts, arg_min(cut, (abs(cut - n // parts), cut)) FILTER (parts = 2 OR i <= cuts - 1) AS first FROM k GROUP BY doc_id),
      b AS (SELECT k.doc_id, arg_min(cut, (abs(cut - k.n * 2 // 3), cut)) AS second FROM k JOIN a ON a.doc_id = k.doc_id AND k.parts = 3 AND cut > first GROUP BY k.doc_id)
      SELECT d.doc_id, coalesce(a.parts, 1) AS parts, CASE WHEN a.parts = 3 THEN first || ',' || (second - first) || ',' || (a.n - second) WHEN a.parts = 2 THEN first || ',' || (a.n - first) ELSE CAST(length(d.text) AS VARCHAR) END AS lengths
      FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id WHERE d.text IS NOT NULL""",
    "valid_characters": r"SELECT doc_id, length(regexp_replace(text, '[\s\p{Z}\p{Cc}\p{Cf}\p{Co}\x{FFFD}]', '', 'g')) AS valid FROM documents",
    "usage_tokens": f"""WITH e AS (SELECT event_id, {K} AS k, user_id AS o FROM events) SELECT event_id, k AS incoming, CASE WHEN k % 3 <> 0 THEN o END AS outgoing, CASE WHEN k % 3 <> 0 THEN greatest(CASE WHEN k % 5 <> 0 THEN k * 2 ELSE 0 END, k + o) WHEN k % 5 <> 0 THEN k * 2 END AS total,
      CAST(CASE WHEN k % 4 = 0 THEN k ELSE least(pow(2, k % 9), 60) END AS BIGINT) AS delay FROM e""",
    "row_keys": """SELECT doc_id, CASE WHEN v <> '' THEN sha256('["row-key","' || source || '","[\\"' || v || '\\"]"]') END AS row_key FROM (SELECT *, CASE WHEN length(source) % 3 = 0 THEN CAST(n_chars AS VARCHAR) WHEN length(source) % 3 = 1 THEN CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang END END AS v FROM documents)""",
    "report_history": """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, max(event_id) AS newest, 'report' AS source FROM events WHERE strftime(ts, '%Y-%m') = '2024-01' GROUP BY 1 UNION ALL SELECT '2024-01-31', 1, 0, 'user_input'""",
    "rendered_rows": """SELECT c_custkey, md5('{' || chr(10) || '  "id" : ' || c_custkey || ',' || chr(10) || '  "name" : "' || c_name || '",' || chr(10) || '  "of" : {' || chr(10) || '    "segment" : "' || c_mktsegment || '"' || chr(10) || '  }' || chr(10) || '}') AS json,
      lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '  ' || rpad(c_mktsegment, CAST(greatest(12, length(c_mktsegment)) AS INTEGER), ' ') || ' ' || c_name AS line FROM customer""",
}
