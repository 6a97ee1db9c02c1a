"""Rank, window and fold queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import windows
from quillspark.queries.base import FILES_SQL, files
from quillspark.session import load


def fair_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E07."""
    d = load(spark, sf_dir, "documents").select("source", "lang", "doc_id")
    return windows.interleave(d, ["source"], "lang", ["doc_id"]).select("source", "doc_id", "turn", "place")


def rank_alternation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantitative and other turns of a conversation alternate."""
    c = load(spark, sf_dir, "conversations").withColumn("quantitative", F.length("text") % 2 == 0)
    c = c.select("conv_id", "turn", F.when(F.col("quantitative"), 0).otherwise(1).alias("kind"))
    return windows.interleave(c.withColumnRenamed("turn", "line"), ["conv_id"], "kind", ["line"]).select("conv_id", "line", "place")


def eviction_victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E12."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", (F.col("o_orderkey") % 1000 + 1).alias("size"))
    return windows.evicted(o, ["o_orderstatus"], ["o_orderdate", "o_orderkey"], "size", 1_000_000).select("o_orderkey", "o_orderstatus")


def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs past the age cut, then the oldest over the count cap; protected ones are skipped."""
    e = load(spark, sf_dir, "events").withColumn("protected", F.col("event_type") == "purchase")
    free = e.filter("NOT protected")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    old = F.col("ts") < F.lit("2024-01-08").cast("timestamp")
    return free.withColumn("n", n).select("event_id", F.when(old, "age").when(F.col("n") > 20, "count").alias("cause")).filter("cause IS NOT NULL")


def report_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E14."""
    d = load(spark, sf_dir, "documents")
    return windows.kept_tail(d, ["source"], [F.col("n_chars"), F.col("doc_id")], "n_chars", 9000, 10).select("source", "doc_id")


def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E18."""
    li = load(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") * 10).alias("start"), (F.col("l_partkey") * 10 + F.col("l_linenumber") * 6).cast("long").alias("end"))
    return windows.islands(li, ["l_suppkey"])


def covered_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G25."""
    li = load(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") * 10).alias("start"), (F.col("l_partkey") * 10 + F.col("l_linenumber") * 6).cast("long").alias("end"))
    return windows.covered(li, ["l_suppkey"])


def header_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest user turn above each turn."""
    c = load(spark, sf_dir, "conversations")
    header = windows.last_seen(F.when(F.col("role") == "user", F.md5("text")), ["conv_id"], ["turn"])
    return c.select("conv_id", "turn", header.alias("header"))


def adjacent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn right after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lead("role").over(w).alias("r"), F.lead("turn").over(w).alias("t"))
    return c.filter("role = 'user' AND r = 'assistant' AND t = turn + 1").select("conv_id", "turn")


def unit_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E26."""
    c = load(spark, sf_dir, "conversations")
    return windows.offsets(c, ["conv_id"], ["turn"], F.length("text"), 2).select("conv_id", "turn", "text_start", "text_end")


def audit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that overlap the one before, or leave their text."""
    c = windows.offsets(load(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.length("text"), 2)
    c = c.withColumn("text_end", F.col("text_end") + F.when(F.col("turn") % 3 == 0, 5).otherwise(0))
    before = F.lag("text_end").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("before", before).filter("text_start < before").select("conv_id", "turn", (F.col("before") - F.col("text_start")).alias("overlap"))


def attempt_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E27."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return load(spark, sf_dir, "events").select("event_id", F.row_number().over(w).alias("attempt"))


def greedy_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation joined into sections of 600 characters at most."""
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n")))).alias("t"))
    groups = windows.greedy_groups(F.transform("t", lambda x: x["n"]), 600, 1)
    return c.select("conv_id", F.array_join(F.transform(groups, lambda g: g.cast("string")), ",").alias("sections"))


def newest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E29."""
    d = load(spark, sf_dir, "documents")
    kept = windows.newest_that_fit(F.split("text", "\n"), 400)
    return d.select("doc_id", F.size(kept).cast("long").alias("lines"), F.md5(F.array_join(kept, "\n")).alias("body"))


def overview_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the first events whose type or key is new, five at most."""
    key = F.array(F.col("event_type"), (F.get_json_object("props", "$.k").cast("long") % 5).cast("string"))
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", key.alias("k")))).alias("all"))
    at = windows.distinct_overview(F.transform("all", lambda x: x["k"]), 5)
    return e.select("user_id", F.array_join(F.transform(at, lambda i: F.get("all", i)["event_id"].cast("string")), ",").alias("events"))


NAMES = (
    fair_interleave, rank_alternation, eviction_victims, retention_plan, report_prefix, merged_ranges, covered_chars, header_above, adjacent_rows, unit_offsets, audit_violations, attempt_numbers,
    greedy_sections, newest_lines, overview_five,
)
QUERIES = {f.__name__: f for f in NAMES}
ISLANDS = """r AS (SELECT DISTINCT l_suppkey, l_partkey * 10 AS s, l_partkey * 10 + l_linenumber * 6 AS e FROM lineitem),
  m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS a FROM r),
  i AS (SELECT *, sum(a) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m),
  isl AS (SELECT l_suppkey, min(s) AS "start", max(e) AS "end" FROM i GROUP BY l_suppkey, g)"""
OFFSETS = """o AS (SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS text_start, length(text) AS n FROM conversations)"""
ORACLES = {
    "fair_interleave": """SELECT source, doc_id, CAST(turn AS INTEGER) AS turn, CAST(row_number() OVER (PARTITION BY source ORDER BY turn, lang, doc_id) AS INTEGER) AS place
      FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS turn FROM documents)""",
    "rank_alternation": """SELECT conv_id, line, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY t, kind, line) AS INTEGER) AS place FROM (SELECT conv_id, turn AS line, length(text) % 2 AS kind,
      row_number() OVER (PARTITION BY conv_id, length(text) % 2 ORDER BY turn) AS t FROM conversations)""",
    "eviction_victims": """SELECT o_orderkey, o_orderstatus FROM (SELECT *, sum(o_orderkey % 1000 + 1) OVER (PARTITION BY o_orderstatus)
      - coalesce(sum(o_orderkey % 1000 + 1) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM orders) WHERE l > 1000000""",
    "retention_plan": """SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 'age' ELSE 'count' END AS cause FROM
      (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'purchase') WHERE ts < TIMESTAMP '2024-01-08' OR n > 20""",
    "report_prefix": """SELECT source, doc_id FROM (SELECT *, row_number() OVER w AS n, sum(n_chars) OVER w AS s FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING)) WHERE n <= 10 AND s <= 9000""",
    "merged_ranges": f'WITH {ISLANDS} SELECT l_suppkey, "start", CAST("end" AS BIGINT) AS "end" FROM isl',
    "covered_chars": f'WITH {ISLANDS} SELECT l_suppkey, CAST(sum("end" - "start") AS BIGINT) AS covered FROM isl GROUP BY l_suppkey',
    "header_above": """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS header FROM conversations""",
    "adjacent_rows": "SELECT a.conv_id, a.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'",
    "unit_offsets": f"WITH {OFFSETS} SELECT conv_id, turn, text_start, text_start + n AS text_end FROM o",
    "audit_violations": f"""WITH {OFFSETS}, p AS (SELECT conv_id, turn, text_start, lag(text_start + n + CASE WHEN turn % 3 = 0 THEN 5 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM o)
      SELECT conv_id, turn, b - text_start AS overlap FROM p WHERE text_start < b""",
    "attempt_numbers": "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS INTEGER) AS attempt FROM events",
    "greedy_sections": """WITH RECURSIVE t AS (SELECT conv_id, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
      f AS (SELECT conv_id, k, n AS used, 0 AS g FROM t WHERE k = 1 UNION ALL
        SELECT t.conv_id, t.k, CASE WHEN f.used + 1 + t.n <= 600 THEN f.used + 1 + t.n ELSE t.n END, CASE WHEN f.used + 1 + t.n <= 600 THEN f.g ELSE f.g + 1 END FROM f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k + 1)
      SELECT conv_id, string_agg(CAST(g AS VARCHAR), ',' ORDER BY k) AS sections FROM f GROUP BY conv_id""",
    "newest_lines": """WITH RECURSIVE d AS (SELECT doc_id, str_split(text, chr(10)) AS l FROM documents),
      n AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM d),
      f AS (SELECT doc_id, len(l) AS i, CAST(0 AS BIGINT) AS used, CAST([] AS VARCHAR[]) AS kept FROM d UNION ALL
        SELECT f.doc_id, f.i - 1, CASE WHEN used + length(line) + 1 <= 400 THEN used + length(line) + 1 ELSE used END, CASE WHEN used + length(line) + 1 <= 400 THEN list_prepend(line, kept) ELSE kept END
        FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i WHERE f.i > 0)
      SELECT doc_id, CAST(len(kept) AS BIGINT) AS lines, md5(coalesce(array_to_string(kept, chr(10)), '')) AS body FROM f WHERE i = 0""",
    "overview_five": """WITH RECURSIVE e AS (SELECT user_id, event_id, [event_type, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS VARCHAR)] AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
      f AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS seen, CAST([] AS VARCHAR[]) AS kept FROM e GROUP BY user_id UNION ALL
        SELECT f.user_id, e.i, list_concat(seen, e.k), CASE WHEN len(list_filter(e.k, lambda x: NOT list_contains(seen, x))) > 0 THEN list_append(kept, CAST(event_id AS VARCHAR)) ELSE kept END
        FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
      SELECT user_id, array_to_string(arg_max(kept, i)[1:5], ',') AS events FROM f GROUP BY user_id""",
}
