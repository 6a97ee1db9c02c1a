"""Queries of publication, call ledgers, composed reports, guards, fidelity, row keys and the stored index. Each docstring names the operators it covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.functions import text as fn
from quillspark.operators import batches as operators_batches
from quillspark.operators import composition, diff, ledger, search, validators
from quillspark.queries import texts
from quillspark.queries.base import FILES_SQL, files
from quillspark.session import load, settled, shared_folder
from quillspark.sources import guard
from quillspark.streaming import publication


def _publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    days = e.groupBy("day").agg(F.concat_ws(": ", F.first("day"), F.count_if(F.col("event_id") % 2 == 0).cast("string")).alias("v1"), F.concat_ws(": ", F.first("day"), F.count("*").cast("string")).alias("v2"), F.max(F.dayofmonth("ts")).alias("d"))
    edited = F.when(F.col("d") % 3 == 0, F.concat("v1", F.lit(" edited"))).when(F.col("d") % 11 == 0, F.col("v2")).otherwise(F.col("v1"))
    current = days.filter("d % 5 <> 0").select(edited.alias("body"), "day")
    log = days.filter("d % 7 <> 0").select("day", F.sha2("v1", 256).alias("sha256"), F.lit(0).cast("long").alias("batch"))
    candidates = days.select("day", F.when(F.col("d") % 13 == 0, "").otherwise(F.col("v2")).alias("body"))
    return publication.outcomes(candidates, current, log)


def publication_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report days as candidates against a target with absent, edited and current bodies, by the digests of their bytes."""
    return _publication(spark, sf_dir).select("day", "outcome", "sha256", "existing")


def publication_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a conflict keeps: the candidate, and the body that somebody else put there."""
    return _publication(spark, sf_dir).filter("outcome = 'conflict'").select("day", "body", "existing_body")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    e = e.withColumn("kind", F.when(F.col("event_type").isin("view", "click", "signup"), "reserve").otherwise("finish"))
    step = [F.col("user_id"), F.date_format("ts", "yyyy-MM-dd"), F.col("k") % 3]
    call = F.coalesce(F.last(F.when(F.col("kind") == "reserve", F.col("event_id")), ignorenulls=True).over(Window.partitionBy(*step).orderBy("ts", "event_id")), F.lit(-1))
    status = F.element_at(F.array(*(F.lit(s) for s in ("succeeded", "failed", "unknown", "lost"))), (F.col("k") % 4 + 1).cast("int"))
    return e.select(F.concat_ws("/", F.col("user_id").cast("string"), step[1]).alias("generation"), step[2].alias("step"), call.alias("call_id"), F.col("ts").alias("at"), "event_id", "kind", status.alias("status"), F.when(F.col("k") % 5 != 0, F.col("event_type")).alias("response"))


def ledger_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user's day as reservations and ends of calls, three attempts a step."""
    return ledger.outcomes(_calls(spark, sf_dir))


def ledger_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls that come of it; those open for an hour by the end of the tenth of January are unknown."""
    return ledger.ledger(_calls(spark, sf_dir), F.lit("2024-01-10").cast("timestamp"), "1 HOUR").select("call_id", "attempt", "status", "response")


def checked_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requests, with calls for most of them and a store whose bodies are hashed again."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    requests = d.select(F.col("doc_id").alias("request_id"), F.col("source").alias("generation"), F.md5("text").alias("fingerprint"), F.col("lang").alias("scope"), F.col("text").alias("request"))
    sent = F.when(F.length("text") % 11 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    calls = d.filter("length(text) % 3 <> 0").select(F.col("doc_id").alias("call_id"), F.col("source").alias("generation"), F.md5("text").alias("fingerprint"), F.col("lang").alias("scope"), F.sha2(sent, 256).alias("request_sha256"), F.sha2(F.reverse("text"), 256).alias("response_sha256"))
    stored = d.filter("length(text) % 7 <> 0").select(F.sha2(F.reverse("text"), 256).alias("sha256"), F.when(F.length("text") % 5 == 0, F.col("text")).otherwise(F.reverse("text")).alias("body"))
    return ledger.reuse(requests, calls, stored)


def guard_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as reads of its role's text; the guard is the digest of what a read gave, a turn cut short having another."""
    c = load(spark, sf_dir, "conversations").withColumn("read", F.concat_ws("/", F.col("conv_id").cast("string"), "role"))
    first = F.first("text").over(Window.partitionBy("read").orderBy("turn"))
    body = F.when(F.length("text") % 5 == 0, F.substring(first, 2, 1 << 20)).otherwise(first)
    return guard.tainted(c.withColumn("guard", F.sha2(body, 256)), "read", "guard", ["turn"]).select("conv_id", "turn", "verified")


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    words = F.element_at(F.array(*(F.lit(w) for w in ("审批 a", "回款 b", "上线 c", "会议 d", "other"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    li = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    fact = F.concat_ws(":", F.col("l_orderkey").cast("string"), (F.col("l_partkey") % 40).cast("string"))
    li = li.select(F.col("o_custkey").alias("report"), F.col("l_orderkey").alias("part"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", fact.alias("fact_id"), words.alias("text"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey").cast("string")).alias("matter_id"))
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    place = F.row_number().over(Window.partitionBy("report", "part").orderBy(*order)).cast("int")
    slot = F.when(F.col("l_linenumber") == 1, "overview").when(F.col("l_returnflag") == "R", "pending").when(F.col("l_linenumber") % 5 == 2, "background").when(F.col("l_linenumber") % 5 == 4, "status").otherwise("detail")
    items = li.select("report", "part", place.alias("place"), slot.alias("slot"), (F.col("l_suppkey") % 4).cast("int").alias("matter"), F.when(F.col("part") % 2 == 0, (F.col("l_suppkey") % 4).cast("string")).alias("matter_id"), F.concat(F.lit(" t"), (F.col("l_suppkey") % 4).cast("string"), F.lit(" ")).alias("title"), F.concat_ws(" ", "fact_id", "text").alias("text"), F.array("fact_id").alias("fact_ids"))
    facts = li.groupBy("report", "fact_id").agg(F.max("matter_id").alias("matter_id"), F.bool_or(F.col("l_linestatus") == "O").alias("pending"), F.max("text").alias("text"))
    return items, facts


def composed_matters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as the parts of a report whose matters are merged in order; tests compare it with a plain version."""
    out = composition.merged(*_facts(spark, sf_dir))
    return out.select("report", "slot", "place", "matter", "matter_id", "title", "text", F.array_join("fact_ids", ",").alias("facts"))


def uncovered_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending facts that no pending item has, and others that neither a matter nor a pending item has."""
    items, facts = _facts(spark, sf_dir)
    return composition.uncovered(facts, items)


def fact_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as facts of their source's step, which was given 25 sources; the first bound that each breaks."""
    d = load(spark, sf_dir, "documents")
    ids = F.when(F.col("doc_id") % 9 == 0, F.array().cast("array<string>")).otherwise(F.array((F.col("doc_id") % 29).cast("string"), (F.col("doc_id") % 5).cast("string")))
    lines = F.split("text", "\n")
    facts = d.select(
        F.concat_ws("/", "source", "lang", (F.col("doc_id") % 40).cast("string")).alias("step"), F.col("doc_id").alias("fact"), F.left(F.get(lines, F.lit(0)), F.lit(130)).alias("topic"), F.col("text").alias("detail"), F.when(F.col("doc_id") % 4 == 0, F.get(lines, F.lit(1))).alias("background"),
        F.lit(None).cast("string").alias("status"), F.when(F.col("doc_id") % 6 == 0, F.lit(" 　")).alias("uncertainty"), F.slice(lines, 1, 25).alias("conditions"), ids.alias("source_ids"), (F.col("doc_id") % 2 == 0).alias("pending"),
    )
    known = facts.select("step").distinct().select("step", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("n"))
    sources = known.select("step", F.col("n").cast("string").alias("source_id"), (F.col("n") % 4 == 0).alias("unverified"))
    return composition.fact_problems(facts, sources)


def fidelity_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines of every document with and without some words, compared letter by letter; tests compare it with difflib."""
    line = load(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "truth"))
    words = F.filter(F.split("truth", " "), lambda w, i: (i + F.length(w)) % 7 != 3)
    return line.select("doc_id", "line", F.round(diff.fidelity(F.array_join(words, "  "), F.col("truth")), 9).alias("ratio"))


def table_row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barred lines of documents as table rows below a header line; one source has configured columns, the others a named id or none."""
    d = load(spark, sf_dir, "documents").filter("text IS NOT NULL AND source IS NOT NULL")
    named = F.element_at(F.array(F.lit("Name | 订单编号 | id"), F.lit("ID | x | y"), F.lit("a | b | c")), (F.length("lang") + F.col("doc_id") % 3).cast("int") % 3 + 1)
    at = F.size(F.split("text", "\n")) % 3
    lines = F.split("text", "\n")
    planted = F.concat(F.slice(lines, F.lit(1), at), F.array(named), F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0))), F.array(named))
    r = d.select("doc_id", F.col("source").alias("label"), F.posexplode(planted).alias("pos", "line")).filter(F.col("line").contains("|"))
    header = F.col("line").isin("Name | 订单编号 | id", "ID | x | y", "a | b | c")
    rows = r.select("doc_id", "label", "pos", header.alias("is_header"), F.transform(F.split("line", "[|]"), lambda c: F.trim(c)).alias("cells"), F.sha2("line", 256).alias("sha256"))
    keys = load(spark, sf_dir, "region").filter("r_regionkey = 1").select(F.lit("src1").alias("label"), F.array(F.lit("b"), F.lit("a")).alias("keys"))
    return diff.keyed_rows(rows, keys, "doc_id", ["pos"]).select("doc_id", "pos", "row_key")


def indexed_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase looked up in the stored index of all fragments, and verified in those that it gives."""
    d = load(spark, sf_dir, "documents")
    rows = settled(search.fragments(d, "doc_id", F.concat_ws(" ", "source", "lang"), F.col("text")))
    index = search.stored_index(rows, f"{shared_folder(spark)}/quillspark-index")
    return search.search(rows, "Thing of", index).select("report_key", fn.like_snippet(F.col("body"), "thing of").alias("snippet"))


def source_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources whose fields are taken from their texts; the rules that each breaks."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("t"), F.coalesce("n_chars", F.lit(0)).alias("n"))
    sha, line = F.sha2("t", 256), F.get(F.split("t", "\n"), F.lit(0))
    rows = d.select(
        "doc_id", F.when(F.col("n") % 13 == 0, "user_input").when(F.col("n") % 17 == 0, F.concat(F.lit("src_"), F.upper(sha))).otherwise(F.concat(F.lit("src_"), sha)).alias("source_id"), F.when(F.col("n") % 7 == 0, "user_statement").otherwise("file").alias("source_kind"),
        F.when(line.contains("|"), "table").otherwise("success").alias("parse_status"), F.when(F.length(line) > 200, F.left(sha, F.lit(63))).otherwise(sha).alias("excerpt_sha256"), F.when(F.col("n") % 5 == 0, line).alias("content_sha256"),
        F.length("t").alias("excerpt_chars"), F.col("n").alias("model_chars"), F.concat(F.lit("2024-01-"), F.lpad((F.col("n") % 40).cast("string"), 2, "0"), F.lit("T08:00:00Z")).alias("observed_at_utc"), F.when(F.col("n") % 3 == 0, "2024-01-01T00:00:00+08:00").alias("modified_at_utc"),
        F.when(F.col("n") % 11 == 0, F.concat(F.lit("../"), "lang")).when(F.col("n") % 11 == 1, F.concat(F.lit("/"), "lang")).when(F.col("n") % 7 != 0, F.concat_ws("/", "lang", "source")).alias("relative_path"),
    )
    return validators.source_problems(rows, "doc_id").select("doc_id", "rule")


def history_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of events a day as reports, for a range of days and a list of those with the most errors in January."""
    e = load(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    reports = e.groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    bad = validators.history(reports, "day", prefix="2024-01").filter(F.col("errors") * 5 > F.col("n")).select("day")
    listed = validators.history(reports, "day", days=bad).select("day", "n", F.lit("list").alias("form"))
    return listed.unionByName(validators.history(reports, "day", between=("2024-01-05", "2024-01-20")).select("day", "n", F.lit("range").alias("form")))


def retained_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that a turn cites in its report, by the ids found at any depth of it."""
    c = load(spark, sf_dir, "conversations")
    report = F.to_json(F.struct(F.array(F.struct(F.array((F.col("conv_id") * 7 % 4001).cast("string"), F.length("text").cast("string")).alias("source_ids"))).alias("details"), F.struct(F.array(F.col("turn").cast("string")).alias("source_ids")).alias("other")))
    cited = c.select(operators_batches.nested_ids(report).alias("ids"))
    return validators.retained(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), cited, "o_orderkey", "ids")


def packed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a customer's orders as ranges of sources, urgent orders first; tests compare it with a plain version."""
    o = load(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_orderstatus")
    part = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_linenumber", "l_suppkey"))
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", part.alias("part"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_linenumber") * 30).cast("long").alias("end"))
    rows = li.join(o, "l_orderkey").select("o_custkey", "l_orderkey", "o_orderpriority", F.col("o_orderstatus").alias("path"), "part", "start", "end", (F.col("o_orderpriority") == "1-URGENT").alias("priority"))
    return operators_batches.packed_ranges(rows, "o_custkey", "l_orderkey", "o_orderpriority", "path", 3, 400, 4)


def reduced_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as requests, turns as their entries and words as their units; tests compare it with a plain version."""
    c = load(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    ends = F.transform(F.filter(F.sequence(F.lit(1), F.length("text")), lambda i: (F.substr("text", i, F.lit(1)) == " ") | (i == F.length("text"))), lambda i: i.cast("long"))
    entry = F.struct("turn", F.col("role").alias("source"), "text", ends.alias("ends"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return operators_batches.reduced_requests(g.select("conv_id", F.lit(200).cast("long").alias("fixed_bytes"), F.transform("e", lambda x: F.struct(x["source"].alias("source"), x["text"].alias("text"), x["ends"].alias("ends"))).alias("entries")), "conv_id")


def decided_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in every state that reading a file can end in, each with its one action and reason."""
    f = files(spark, sf_dir)
    n = F.coalesce("n_chars", F.lit(0))
    status = F.when(n % 19 == 0, "timeout").when(n % 23 == 0, "error").when(n % 29 == 0, "not_parsed").otherwise("success")
    reason = F.when(n % 38 == 0, "parse_timeout").when(n % 29 == 0, "ignored_pattern").when(n % 31 == 0, "pdf_no_text_in_parse_window")
    backend = F.when(F.col("extension") == ".pdf", "pdf_metadata_v2").otherwise("light_text")
    f = f.withColumn("said", rules.decision(status, reason, backend, F.col("size_bytes"), n, F.col("truncated"), F.col("extension"), 9_000, 3_000))
    return f.select("doc_id", "said.action", "said.reason")


def sheet_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as rows of a sheet: which are headers, and which formulas sum the rows above in one column."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    names = F.array(F.lit("Name"), F.lit(" amount "), F.lit("DATE"), F.lit("other"))
    cells = F.array(F.get(names, (F.col("l_partkey") % 4).cast("int")), F.get(names, (F.col("l_suppkey") % 4).cast("int")), F.when(F.col("l_returnflag") == "R", F.lit("1,234.5%")).otherwise(F.col("l_returnflag")))
    column = F.when(F.col("l_suppkey") % 3 == 0, "C").otherwise("B")
    formula = F.when(F.col("l_partkey") % 5 == 0, F.format_string("=sum($B$2:$%s$%d)", column, F.col("l_linenumber") * 3)).when(F.col("l_partkey") % 5 == 1, F.format_string("SUM(B1:%s%d)", column, F.col("l_partkey") % 14)).when(F.col("l_partkey") % 5 == 2, F.format_string("=SUM(B2:B%d)+1", F.col("l_linenumber"))).otherwise("=B2")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rules.header_row(cells, ("name", "amount", "date")).alias("header"), F.coalesce(rules.vertical_sum(formula, F.lit(12)), F.lit(False)).alias("vertical"))


def match_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the best window of a phrase in each fragment that has it; tests compare it with a full-text engine's."""
    rows = search.fragments(load(spark, sf_dir, "documents"), "doc_id", F.concat_ws(" ", "source", "lang"), F.col("text"))
    return search.snippets(search.search(rows, "and the"), "and the").select("report_key", "snippet")


NAMES = (
    match_snippets, decided_evidence, sheet_predicates, source_problems, history_of_days, retained_sources, packed_ranges, reduced_requests, publication_outcomes, publication_conflicts, ledger_outcomes, ledger_calls, checked_reuse, guard_taint, composed_matters, uncovered_facts, fact_bounds, fidelity_ratios, table_row_keys, indexed_phrase,
)
QUERIES = {f.__name__: f for f in NAMES}
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
PUBLISHED = """days AS (
    SELECT strftime(ts, '%Y-%m-%d') AS day, any_value(strftime(ts, '%Y-%m-%d')) || ': ' || count(*) FILTER (event_id % 2 = 0) AS v1, any_value(strftime(ts, '%Y-%m-%d')) || ': ' || count(*) AS v2, max(day(ts)) AS d FROM events GROUP BY 1),
  e AS (SELECT *, CASE WHEN d % 13 = 0 THEN '' ELSE v2 END AS body, CASE WHEN d % 5 <> 0 THEN CASE WHEN d % 3 = 0 THEN v1 || ' edited' WHEN d % 11 = 0 THEN v2 ELSE v1 END END AS existing_body FROM days),
  p AS (SELECT *, sha256(body) AS sha256, sha256(existing_body) AS existing, CASE WHEN body = '' THEN 'not_staged' WHEN existing_body = body THEN 'already' WHEN existing_body IS NULL OR (existing_body = v1 AND d % 7 <> 0) THEN 'publish' ELSE 'conflict' END AS outcome FROM e)"""
CALLS = f"""c AS (
    SELECT event_id, ts, user_id, strftime(ts, '%Y-%m-%d') AS day, {K} % 3 AS step, event_type IN ('view', 'click', 'signup') AS opens, ['succeeded','failed','unknown','lost'][1 + {K} % 4] AS status, CASE WHEN {K} % 5 <> 0 THEN event_type END AS response FROM events),
  n AS (SELECT *, last_value(CASE WHEN opens THEN event_id END IGNORE NULLS) OVER w AS call_id, count(*) FILTER (opens) OVER w AS nth FROM c WINDOW w AS (PARTITION BY user_id, day, step ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
  o AS (SELECT *, CASE WHEN opens THEN nth ELSE (SELECT r.nth FROM n r WHERE r.event_id = n.call_id) END AS attempt, NOT opens AND status <> 'lost' AND (status <> 'succeeded' OR response IS NOT NULL) AND call_id IS NOT NULL AS ends FROM n),
  f AS (SELECT *, attempt <= 3 AND ends AND row_number() OVER (PARTITION BY call_id, ends ORDER BY ts, event_id) = 1 AS finished FROM o)"""
FACTS = """li AS (
    SELECT o_custkey AS report, l_orderkey AS part, l_linenumber, l_returnflag, l_linestatus, l_orderkey || ':' || l_partkey % 40 AS fact_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  facts AS (SELECT report, fact_id, bool_or(l_linestatus = 'O') AS pending FROM li GROUP BY 1, 2),
  cited AS (SELECT report, fact_id, bool_or(l_linenumber <> 1 AND l_returnflag = 'R') AS as_pending, bool_or(l_linenumber <> 1 AND l_returnflag <> 'R') AS in_matter FROM li GROUP BY 1, 2)"""
ORACLES = {
    "decided_evidence": f"""WITH {FILES_SQL}, n AS (SELECT *, coalesce(n_chars, 0) AS n FROM named),
      s AS (SELECT *, CASE WHEN n % 19 = 0 THEN 'timeout' WHEN n % 23 = 0 THEN 'error' WHEN n % 29 = 0 THEN 'not_parsed' ELSE 'success' END AS status, CASE WHEN n % 38 = 0 THEN 'parse_timeout' WHEN n % 29 = 0 THEN 'ignored_pattern' WHEN n % 31 = 0 THEN 'pdf_no_text_in_parse_window' END AS why FROM n),
      a AS (SELECT *, CASE WHEN status IN ('error', 'timeout') THEN 'error' WHEN status = 'not_parsed' THEN 'omit' WHEN extension = '.pdf' AND coalesce(why, '') = 'pdf_no_text_in_parse_window' THEN 'metadata_only' WHEN size_bytes > 9000 THEN 'metadata_only' WHEN n <= 3000 AND NOT truncated THEN 'keep' ELSE 'compress' END AS action FROM s)
      SELECT doc_id, action, CASE action WHEN 'error' THEN coalesce(why, 'parse_error') WHEN 'omit' THEN why WHEN 'keep' THEN 'small_file_keep' WHEN 'metadata_only' THEN CASE WHEN extension = '.pdf' AND coalesce(why, '') = 'pdf_no_text_in_parse_window' THEN why ELSE 'file_size_policy' END
        ELSE CASE WHEN extension = '.log' THEN 'large_log_tail' WHEN extension IN ('.docx', '.xlsx', '.pdf', '.doc') THEN 'large_document_summary' ELSE 'medium_text_compress' END END AS reason FROM a""",
    "sheet_predicates": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag <> 'R' AND l_partkey % 4 <> 3 AND l_suppkey % 4 <> 3 AS header,
      CASE l_partkey % 5 WHEN 0 THEN l_suppkey % 3 <> 0 AND l_linenumber * 3 < 12 WHEN 1 THEN l_suppkey % 3 <> 0 AND l_partkey % 14 < 12 ELSE false END AS vertical FROM lineitem""",
    "source_problems": r"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, coalesce(n_chars, 0) AS n, sha256(coalesce(text, '')) AS sha, str_split(coalesce(text, ''), chr(10))[1] AS line FROM documents),
      f AS (SELECT *, CASE WHEN n % 11 = 0 THEN '../' || lang WHEN n % 11 = 1 THEN '/' || lang WHEN n % 7 <> 0 THEN concat_ws('/', lang, source) END AS path FROM d)
      SELECT doc_id, unnest(list_filter([CASE WHEN n % 13 <> 0 AND n % 17 = 0 AND upper(sha) <> sha THEN 'id' END, CASE WHEN contains(line, '|') THEN 'status' END, CASE WHEN length(line) > 200 THEN 'excerpt_hash' END, CASE WHEN n % 5 = 0 AND NOT regexp_full_match(line, '[0-9a-f]{64}') THEN 'content_hash' END,
        CASE WHEN n > length(t) THEN 'chars' END, CASE WHEN n % 40 = 0 OR n % 40 > 31 THEN 'observed_at' END, CASE WHEN n % 3 = 0 THEN 'modified_at' END, CASE WHEN n % 7 <> 0 AND (n % 13 = 0 OR n % 11 IN (0, 1) OR path = '') THEN 'file' END, CASE WHEN n % 7 = 0 AND (n % 13 <> 0 OR path IS NOT NULL) THEN 'statement' END], lambda r: r IS NOT NULL)) AS rule FROM f""",
    "history_of_days": """WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)
      SELECT day, n, 'list' AS form FROM r WHERE starts_with(day, '2024-01') AND errors * 5 > n UNION ALL SELECT day, n, 'range' FROM r WHERE day BETWEEN '2024-01-05' AND '2024-01-20'""",
    "retained_sources": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT conv_id * 7 % 4001 FROM conversations UNION SELECT length(text) FROM conversations UNION SELECT turn FROM conversations)",
    "publication_outcomes": f"WITH {PUBLISHED} SELECT day, outcome, sha256, existing FROM p",
    "publication_conflicts": f"WITH {PUBLISHED} SELECT day, body, existing_body FROM p WHERE outcome = 'conflict'",
    "ledger_outcomes": f"""WITH {CALLS} SELECT event_id, coalesce(call_id, -1) AS call_id, CAST(CASE WHEN attempt <= 3 THEN attempt END AS INTEGER) AS attempt,
      CASE WHEN opens THEN CASE WHEN nth <= 3 THEN 'reserved' ELSE 'attempts_exhausted' END WHEN finished THEN 'finished' ELSE 'state_invalid' END AS outcome FROM f""",
    "ledger_calls": f"""WITH {CALLS} SELECT a.event_id AS call_id, CAST(a.nth AS INTEGER) AS attempt, coalesce(b.status, CASE WHEN a.ts + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-10' THEN 'unknown' ELSE 'reserved' END) AS status, b.response
      FROM f a LEFT JOIN f b ON b.finished AND b.call_id = a.event_id WHERE a.opens AND a.nth <= 3""",
    "checked_reuse": """WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text, lang, length(coalesce(text, '')) AS n FROM documents),
      c AS (SELECT source, text, max(doc_id) AS call_id, arg_max(lang, doc_id) AS lang FROM d WHERE n % 3 <> 0 GROUP BY 1, 2)
      SELECT d.doc_id AS request_id, c.call_id, CASE WHEN c.call_id IS NULL THEN 'call' WHEN c.lang IS DISTINCT FROM d.lang OR n % 11 = 0 THEN 'identity_mismatch' WHEN n % 7 = 0 AND reverse(d.text) NOT IN (SELECT reverse(text) FROM d WHERE n % 7 <> 0) THEN 'missing'
        WHEN n % 5 = 0 AND reverse(d.text) <> d.text THEN 'corrupt' ELSE 'replay' END AS outcome FROM d LEFT JOIN c ON c.source = d.source AND c.text = d.text""",
    "guard_taint": """WITH r AS (SELECT *, first_value(text) OVER w AS t FROM conversations WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn)), g AS (SELECT *, CASE WHEN length(text) % 5 = 0 THEN substr(t, 2) ELSE t END AS b FROM r)
      SELECT conv_id, turn, coalesce(bool_and(coalesce(b = f, false)) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS UNBOUNDED PRECEDING), false) AS verified FROM (SELECT *, first_value(b) OVER (PARTITION BY conv_id, role ORDER BY turn) AS f FROM g)""",
    "uncovered_facts": f"WITH {FACTS} SELECT report, fact_id, pending FROM facts JOIN cited USING (report, fact_id) WHERE NOT (as_pending OR NOT pending AND in_matter)",
    "fact_bounds": r"""WITH d AS (SELECT *, concat_ws('/', source, lang, CAST(doc_id % 40 AS VARCHAR)) AS step, str_split(text, chr(10)) AS l, CASE WHEN doc_id % 9 = 0 THEN [] ELSE list_distinct([doc_id % 29, doc_id % 5]) END AS ids FROM documents),
      m AS (SELECT *, count(*) OVER (PARTITION BY step) AS many, CASE WHEN doc_id % 4 = 0 THEN l[2] END AS background FROM d),
      p AS (SELECT step, doc_id AS fact, CASE WHEN many > 64 THEN 'too_many_facts' WHEN coalesce(trim(left(l[1], 130), E' \t\r 　') = '' OR length(l[1]) > 120, true) THEN 'topic' WHEN coalesce(regexp_full_match(text, '\s*') OR length(text) > 4000, true) THEN 'detail'
        WHEN background IS NOT NULL AND (regexp_full_match(background, '\s*') OR length(background) > 2000) THEN 'background' WHEN doc_id % 6 = 0 THEN 'uncertainty' WHEN len(l[1:25]) > 20 THEN 'too_many_conditions'
        WHEN len(list_filter(l[1:25], lambda c: regexp_full_match(c, '\s*') OR length(c) > 1000)) > 0 THEN 'condition' WHEN len(ids) = 0 THEN 'sources' WHEN len(list_filter(ids, lambda i: i > 24)) > 0 THEN 'unknown_source'
        WHEN doc_id % 2 = 1 AND len(list_filter(ids, lambda i: i % 4 = 0)) > 0 THEN 'unverified_source' END AS problem FROM m)
      SELECT * FROM p WHERE problem IS NOT NULL""",
    "table_row_keys": """WITH d AS (SELECT doc_id, source AS label, str_split(text, chr(10)) AS l, ['Name | 订单编号 | id', 'ID | x | y', 'a | b | c'][1 + (length(lang) + doc_id % 3) % 3] AS h FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
      p AS (SELECT doc_id, label, h, len(l) % 3 AS spot, list_concat(l[1:len(l) % 3], [h], l[len(l) % 3 + 1:], [h]) AS l FROM d),
      r AS (SELECT doc_id, label, h, spot, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM p),
      c AS (SELECT *, list_transform(str_split(line, '|'), lambda x: trim(x)) AS cells, list_transform(str_split(h, '|'), lambda x: trim(x)) AS header FROM r WHERE contains(line, '|')),
      v AS (SELECT *, CASE WHEN pos < spot THEN NULL WHEN label = 'src1' THEN CASE WHEN h = 'a | b | c' THEN [cells[2], cells[1]] END WHEN h = 'a | b | c' THEN NULL WHEN header[1] = 'ID' THEN [cells[1]] ELSE [cells[2]] END AS v FROM c)
      SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN v IS NULL OR len(list_filter(v, lambda x: x IS NULL OR x = '')) > 0 THEN sha256(line) ELSE sha256(CAST(to_json(['row-key', label, CAST(to_json(v) AS VARCHAR)]) AS VARCHAR)) END AS row_key FROM v""",
}
ORACLES["indexed_phrase"] = texts.ORACLES["search_phrase"]  # the index changes the plan, not the rows
