"""Queries of packing under limits, of nested JSON, and of memoised state. Each docstring names the operators it covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import batches, joins, state, windows
from quillspark.queries.base import FILES_SQL, files
from quillspark.session import load
from quillspark.sources import sinks


def unit_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as units; every fourth is structure."""
    c = windows.offsets(load(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.length("text"), 2)
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text_start").alias("start"), F.col("text_end").alias("end"), (F.col("turn") % 4 != 0).alias("useful")))).alias("units"))
    return g.select("conv_id", F.explode(batches.unit_chunks(F.col("units"))).alias("c")).select("conv_id", "c.start", "c.end")


def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines of a supplier as rows of a table."""
    row = F.concat(F.lit("| "), F.col("l_orderkey").cast("string"), F.lit(" | "), F.col("l_partkey").cast("string"), F.lit(" |"))
    g = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", row.alias("row")).groupBy("l_suppkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "row"))), lambda x: x["row"]).alias("rows"))
    chunk = batches.table_chunks(F.col("rows"), F.array(F.lit("| order | part |"), F.lit("| --- | --- |")))
    z = g.select("l_suppkey", F.explode(F.arrays_zip(F.col("rows"), chunk.alias("chunk"))).alias("z"))
    return z.groupBy("l_suppkey", "z.chunk").agg(F.count("*").alias("rows"), F.sum(F.length("z.rows")).alias("chars"))


def fitting_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation appended while they fit 900 characters."""
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n")))).alias("t"))
    kept = batches.fitting_sections(F.transform("t", lambda x: x["n"]), 900)
    return c.select("conv_id", F.array_join(F.transform(kept, lambda i: i.cast("string")), ",").alias("kept"))


def labelled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric cells of orders' lines under the nearest header above, in short lines."""
    li = load(spark, sf_dir, "lineitem")
    header = F.when(F.col("l_linenumber") == 1, F.array(*(F.concat(F.lit(f"{c}_"), F.col("l_suppkey").cast("string")) for c in ("part", "flag", "line"))))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    li = li.select("l_orderkey", *order, "l_returnflag", windows.last_seen(header, ["l_orderkey"], order).alias("labels"))
    cells = F.array(F.col("l_partkey").cast("string"), F.col("l_returnflag"), F.col("l_linenumber").cast("string"))
    lines = batches.labelled_lines(F.col("labels"), cells, F.lit("row: "), 24)
    return li.filter("labels IS NOT NULL").select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(lines, "\n").alias("lines"))


def dropped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as items; urgent ones are never dropped."""
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", (F.col("o_orderkey") % 900 + 100).alias("chars"))
    return batches.dropped_items(o, ["o_custkey"], [F.desc("o_orderpriority"), F.desc("o_orderkey")], "chars", F.col("o_orderpriority") != "1-URGENT", 3_000).select("o_custkey", "o_orderkey")


def ranked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best items of a customer, in rank order, while their number and characters fit."""
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", (F.col("o_orderkey") % 900 + 100).alias("chars"))
    return windows.kept_tail(o, ["o_custkey"], ["o_orderpriority", "o_orderkey"], "chars", 3_000, 5).select("o_custkey", "o_orderkey")


def packed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines of a customer's orders as entries; tests compare it with stated properties."""
    o = load(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    depth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    e = load(spark, sf_dir, "lineitem").select("l_orderkey", depth.alias("depth"), (F.col("l_partkey") % 300 + 50).cast("long").alias("size"))
    return batches.packed_sources(e.join(o, "l_orderkey"), "o_custkey", "l_orderkey", "o_orderpriority", "depth", "size", 3, 1_000, 4)


def reduced_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as entries of one request, order lines as their units; tests compare it with a plain version."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", F.sum(F.col("l_partkey") % 90 + 10).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("end"))
    e = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("end")).alias("ends")).join(o, "l_orderkey")
    return batches.reduced_batches(e.withColumn("n", F.col("l_orderkey")), "o_custkey", "l_orderkey", "n", "ends").select("o_custkey", "l_orderkey", "end")


def fair_sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as rows of a sheet a priority; tests compare it with stated properties."""
    o = load(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 7 == 0, "table_header").when(F.col("o_orderkey") % 5 == 0, "total").otherwise("table_row")
    rows = o.select("o_custkey", "o_orderpriority", "o_orderkey", kind.alias("kind"), F.concat_ws(" | ", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("text"))
    return batches.fair_sheet_rows(rows, "o_custkey", "o_orderpriority", "o_orderkey", "kind", "text", 90)


def clipped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N06."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") * 100).alias("start"), (F.col("l_partkey") * 100 + F.col("l_linenumber") * 9).alias("end"))
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return g.select("l_orderkey", F.posexplode(batches.clipped_spans(F.col("spans"), F.lit(60))).alias("n", "s")).select("l_orderkey", "n", "s.start", "s.end")


def call_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each source that calls covered and tried, and whether any is left."""
    li = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", (F.col("l_partkey") * 10).alias("start"), (F.col("l_partkey") * 10 + F.col("l_linenumber") * 6).cast("long").alias("end"))
    done = F.col("l_suppkey").isNotNull() & (F.col("l_returnflag") != "R")  # no key joins null
    out = windows.covered(li, ["l_suppkey"], some=done).withColumn("some", F.coalesce("some", F.lit(0)).cast("long"))
    return out.select("l_suppkey", F.col("covered").alias("attempted"), F.col("some").alias("covered"), (F.col("some") < F.col("covered")).alias("bounded"))


def _report(c: F.Column) -> F.Column:
    item = lambda text, ids: F.struct(F.col(text).alias("text"), ids.alias("source_ids"))
    ids = lambda *names: F.array(*(F.col(n).cast("string") for n in names))
    return F.to_json(F.struct(F.col("role").alias("title"), F.array(item("text", ids("turn", "conv_id")), item("role", ids("conv_id"))).alias("details"), F.struct(F.array(item("text", ids("turn"))).alias("deep")).alias("other"), c.alias("message")))


def nested_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports made of turns as JSON; what stands below other fields is not text."""
    c = load(spark, sf_dir, "conversations").withColumn("report", _report(F.lit("end")))
    return c.select("conv_id", "turn", F.md5(batches.nested_texts("report")).alias("texts"))


def nested_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source ids that a report cites at any depth."""
    c = load(spark, sf_dir, "conversations").withColumn("report", _report(F.lit("end")))
    return c.select("conv_id", "turn", batches.nested_ids("report").alias("ids"))


def archive_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document as units with byte and character offsets and digests; long lines in parts of 64 Ki characters, so none has more than 256 KiB."""
    lines = F.filter(F.split("text", "(?<=\n)"), lambda x: x != "")
    parts = F.flatten(F.transform(lines, lambda x: F.when(F.length(x) <= 65_536, F.array(x)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / 65_536).cast("int")), lambda i: F.substr(x, i * 65_536 + 1, F.lit(65_536))))))
    d = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("unit", "body"))
    w = Window.partitionBy("doc_id").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda size: F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long")
    return d.select("doc_id", "unit", at(F.octet_length("body")).alias("byte_start"), at(F.length("body")).alias("text_start"), F.octet_length("body").cast("long").alias("bytes"), F.sha2("body", 256).alias("sha256"))


def profile_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as settings; the fingerprint is that of their sorted canonical JSON."""
    r = load(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("name"), F.col("r_regionkey").alias("key"), F.parse_json(F.lit('[1,"é"]')).alias("a"))
    return r.select("r_regionkey", state.profile_fingerprint("name", "key", "a").alias("fingerprint"))


def source_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of a source after, and with, the first that does not match its guard."""
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("tainted", F.max(F.col("k") == 7).over(w)).filter("tainted").select("event_id")


def call_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by step with their attempt; the fourth and later are refused, those without an end are unknown."""
    e = load(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    attempt = F.row_number().over(Window.partitionBy("user_id", "event_type", "day").orderBy("ts", "event_id"))
    said = F.when(F.col("attempt") > 3, "refused").when(F.col("value") > 60, "unknown").otherwise("finished")
    return e.withColumn("attempt", attempt).select("event_id", "attempt", said.alias("state"))


def fact_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts numbered by step; uncertain ones are pending, and a confirmed one may not rest on an unverified source."""
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 25).cast("int").alias("source_id"))
    bad = load(spark, sf_dir, "nation").filter("n_nationkey % 5 = 0").select(F.col("n_nationkey").cast("int").alias("source_id"), F.lit(True).alias("unverified"))
    pending = F.col("o_orderstatus") == "P"
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(pending, "o_orderkey")) - 1
    out = o.join(bad, "source_id", "left").select("o_custkey", "o_orderkey", pending.alias("pending"), (~pending & F.coalesce("unverified", F.lit(False))).alias("invalid"), n.alias("n"))
    return out.select("o_orderkey", F.concat(F.col("o_custkey").cast("string"), F.lit(":"), F.lpad(F.col("n").cast("string"), 3, "0")).alias("fact_id"), "pending", "invalid")


def matter_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matters of all parts merged by their id, with what all parts say of them and the best rank."""
    li = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("matter_id"), F.col("l_orderkey").alias("fact_id"), F.ascii("l_returnflag").alias("rank"))
    return li.groupBy("matter_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("fact_id")), lambda i: i.cast("string")), ",").alias("facts"), F.min("rank").alias("rank"))


def rebuilt_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of the snapshots all of whose bodies still have their digest."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("snapshot"), F.md5("text").alias("digest"))
    usable = state.snapshot_usable(d.select("doc_id", "snapshot", "digest"), d.filter("doc_id % 67 <> 0").select("doc_id", "digest"), "snapshot", "doc_id").filter("usable")
    return d.join(usable, "snapshot", "left_semi").select("doc_id", "snapshot")


def post_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that changed while they were read have their excerpt cleared and an error."""
    f = files(spark, sf_dir).select("doc_id", "size_bytes", F.md5("content").alias("guard"), "content")
    after = f.select("doc_id", (F.col("size_bytes") + F.when(F.col("doc_id") % 31 == 0, 1).otherwise(0)).alias("size2"), F.when(F.col("doc_id") % 37 == 0, "?").otherwise(F.col("guard")).alias("guard2"))
    j = f.join(after, "doc_id")
    same = F.col("size_bytes").eqNullSafe(F.col("size2")) & F.col("guard").eqNullSafe(F.col("guard2"))
    return j.select("doc_id", F.when(same, "success").otherwise("error").alias("status"), F.md5(F.when(same, F.col("content")).otherwise("")).alias("excerpt"))


def collected_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries past seven days, then the oldest of the rest over the cap."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", (F.col("o_orderkey") % 1000 + 1).alias("size"))
    old = F.col("o_orderdate") <= F.lit("2000-01-01").cast("timestamp") - F.expr("interval 7 days")
    rest = windows.evicted(o.filter(~old), ["o_orderstatus"], ["o_orderdate", "o_orderkey"], "size", 100_000).select("o_orderkey", F.lit("cap").alias("cause"))
    return o.filter(old).select("o_orderkey", F.lit("age").alias("cause")).unionByName(rest)


def call_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with a successful call of the same generation and fingerprint: replayed if the stored bytes have their hash."""
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    done = e.filter("event_type = 'view'").groupBy(F.col("user_id").alias("generation"), "k").agg(F.max("event_id").alias("call_id"))
    asked = e.filter("event_type = 'click'").select("event_id", F.col("user_id").alias("generation"), "k")
    said = F.when(F.col("call_id").isNull(), "call").when(F.col("call_id") % 10 == 0, "corrupt").otherwise("replay")
    return asked.join(done, ["generation", "k"], "left").select("event_id", said.alias("outcome"))


def classification_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As for parsed bodies, by the classifier's build and settings."""
    d = files(spark, sf_dir).select("doc_id", "file_identity", F.col("size_bytes").cast("string").alias("source_version"), F.lit("b2").alias("profile"), (F.col("doc_id") % 2 == 0).alias("existed_before"))
    cache = d.filter("doc_id % 5 <> 0").select("file_identity", F.when(F.col("doc_id") % 7 == 0, "0").otherwise(F.col("source_version")).alias("source_version"), F.when(F.col("doc_id") % 3 == 0, "b1").otherwise("b2").alias("profile"), F.lit("h").alias("body_hash"))
    return joins.cache_lookup(d, cache).select("doc_id", "status", "miss_reason")


def migrated_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K08."""
    c = load(spark, sf_dir, "customer")
    old = c.select(F.col("c_name").alias("week_label"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("overview"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_name")).alias("completed_work"), F.lit("s").alias("work_summary"), F.lit("p").alias("next_plan"))
    return sinks.migrated_weekly(old)


NAMES = (
    unit_chunks, table_chunks, fitting_sections, labelled_fields, dropped_items, ranked_items, packed_sources, reduced_batches, fair_sheet_rows, clipped_spans, call_coverage, nested_texts, nested_ids, archive_units, profile_fingerprints, source_taint, call_ledger,
    fact_selection, matter_merge, rebuilt_sources, post_read, collected_garbage, call_reuse, classification_lookup, migrated_weekly,
)
QUERIES = {f.__name__: f for f in NAMES}
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
COVERED = """SELECT l_suppkey, CAST(sum(e - s) AS BIGINT) AS c FROM (SELECT l_suppkey, min(s) AS s, max(e) AS e FROM (SELECT *, sum(a) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM
  (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS a FROM (SELECT DISTINCT l_suppkey, l_partkey * 10 AS s, l_partkey * 10 + l_linenumber * 6 AS e FROM lineitem WHERE {0}))) GROUP BY l_suppkey, g) GROUP BY 1"""
ORACLES = {
    "unit_chunks": """WITH RECURSIVE o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn % 4 <> 0 AS u, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + length(text) AS e FROM conversations),
      f AS (SELECT conv_id, i, CAST(0 AS BIGINT) AS cursor, e, u AS stated, CAST([] AS STRUCT(s BIGINT, e BIGINT)[]) AS out FROM o WHERE i = 1 UNION ALL
        SELECT o.conv_id, o.i, CASE WHEN NOT stated OR o.e - cursor <= 512 THEN cursor ELSE f.e END, o.e, stated OR o.u, CASE WHEN NOT stated OR o.e - cursor <= 512 THEN out ELSE list_append(out, struct_pack(s := cursor, e := f.e)) END FROM f JOIN o ON o.conv_id = f.conv_id AND o.i = f.i + 1),
      l AS (SELECT conv_id, arg_max(list_append(out, struct_pack(s := cursor, e := e)), i) AS out, bool_or(stated) AS stated FROM f GROUP BY 1)
      SELECT conv_id, x.s AS "start", x.e AS "end" FROM (SELECT conv_id, unnest(out) AS x FROM l WHERE stated)""",
    "table_chunks": """WITH RECURSIVE r AS (SELECT l_suppkey, length('| ' || l_orderkey || ' | ' || l_partkey || ' |') AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS i FROM lineitem),
      f AS (SELECT l_suppkey, i, n, n + 1 AS used, 0 AS chunk FROM r WHERE i = 1 UNION ALL
        SELECT r.l_suppkey, r.i, r.n, CASE WHEN used + r.n + 1 <= 481 THEN used + r.n + 1 ELSE r.n + 1 END, CASE WHEN used + r.n + 1 <= 481 THEN chunk ELSE chunk + 1 END FROM f JOIN r ON r.l_suppkey = f.l_suppkey AND r.i = f.i + 1)
      SELECT l_suppkey, CAST(chunk AS INTEGER) AS chunk, count(*) AS rows, CAST(sum(n) AS BIGINT) AS chars FROM f GROUP BY 1, 2""",
    "fitting_sections": """WITH RECURSIVE t AS (SELECT conv_id, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
      f AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST([] AS VARCHAR[]) AS kept FROM t GROUP BY 1 UNION ALL
        SELECT t.conv_id, t.i, CASE WHEN used + n + CASE WHEN len(kept) > 0 THEN 2 ELSE 0 END <= 900 THEN used + n + CASE WHEN len(kept) > 0 THEN 2 ELSE 0 END ELSE used END,
          CASE WHEN used + n + CASE WHEN len(kept) > 0 THEN 2 ELSE 0 END <= 900 THEN list_append(kept, CAST(t.i - 1 AS VARCHAR)) ELSE kept END FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1)
      SELECT conv_id, array_to_string(arg_max(kept, i), ',') AS kept FROM f GROUP BY 1""",
    "labelled_fields": """WITH l AS (SELECT *, last_value(CASE WHEN l_linenumber = 1 THEN l_suppkey END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM lineitem),
      f AS (SELECT *, 'part_' || h || ' = ' || l_partkey || '；' AS a, 'line_' || h || ' = ' || l_linenumber || '；' AS b FROM l WHERE h IS NOT NULL)
      SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN length(a) > 19 THEN CASE WHEN length(b) > 19 THEN '' ELSE 'row: ' || b END WHEN length(b) > 19 THEN 'row: ' || a WHEN length(a) + length(b) <= 19 THEN 'row: ' || a || b ELSE 'row: ' || a || chr(10) || 'row: ' || b END AS lines FROM f""",
    "dropped_items": """WITH o AS (SELECT *, o_orderkey % 900 + 100 AS c, o_orderpriority <> '1-URGENT' AS r FROM orders), s AS (SELECT *, sum(c) OVER (PARTITION BY o_custkey) AS t FROM o),
      d AS (SELECT *, t - coalesce(sum(c) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_orderkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM s WHERE r) SELECT o_custkey, o_orderkey FROM d WHERE l > 3000""",
    "ranked_items": """SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER w AS n, sum(o_orderkey % 900 + 100) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey ROWS UNBOUNDED PRECEDING)) WHERE n <= 5 AND s <= 3000""",
    "clipped_spans": """WITH s AS (SELECT l_orderkey, l_partkey * 100 AS s, l_linenumber * 9 AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS i FROM lineitem),
      c AS (SELECT *, 60 - (i - 1) - coalesce(sum(n) OVER (PARTITION BY l_orderkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM s)
      SELECT l_orderkey, CAST(i - 1 AS INTEGER) AS n, s AS "start", CAST(s + least(n, room) AS BIGINT) AS "end" FROM c WHERE room > 0""",
    "call_coverage": f"""WITH a AS ({COVERED.format("true")}), o AS ({COVERED.format("l_returnflag <> 'R'")}) SELECT a.l_suppkey, a.c AS attempted, coalesce(o.c, 0) AS covered, coalesce(o.c, 0) < a.c AS bounded FROM a LEFT JOIN o ON o.l_suppkey = a.l_suppkey""",
    "nested_texts": "SELECT conv_id, turn, md5(concat_ws(chr(10), role, text, role, 'end')) AS texts FROM conversations",
    "nested_ids": "SELECT conv_id, turn, CASE WHEN turn = conv_id THEN CAST(turn AS VARCHAR) ELSE array_to_string(list_sort([CAST(turn AS VARCHAR), CAST(conv_id AS VARCHAR)]), ',') END AS ids FROM conversations",
    "archive_units": """WITH l AS (SELECT doc_id, unnest(range(0, len(s))) AS unit, unnest(s) AS body FROM (SELECT doc_id, list_concat(list_transform(str_split(text, chr(10))[1:-2], lambda x: x || chr(10)), list_filter(str_split(text, chr(10))[-1:], lambda x: x <> '')) AS s FROM documents))
      SELECT doc_id, CAST(unit AS INTEGER) AS unit, CAST(coalesce(sum(strlen(body)) OVER w, 0) AS BIGINT) AS byte_start, CAST(coalesce(sum(length(body)) OVER w, 0) AS BIGINT) AS text_start, strlen(body) AS bytes, sha256(body) AS sha256
      FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "profile_fingerprints": """SELECT r_regionkey, sha256('{"a":[1,"é"],"key":' || r_regionkey || ',"name":"' || r_name || '"}') AS fingerprint FROM region""",
    "source_taint": f"SELECT event_id FROM (SELECT event_id, bool_or({K} = 7) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS t FROM events) WHERE t",
    "call_ledger": """SELECT event_id, CAST(a AS INTEGER) AS attempt, CASE WHEN a > 3 THEN 'refused' WHEN value > 60 THEN 'unknown' ELSE 'finished' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS a FROM events)""",
    "fact_selection": """SELECT o_orderkey, o_custkey || ':' || lpad(CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'P', o_orderkey) - 1 AS VARCHAR), 3, '0') AS fact_id, o_orderstatus = 'P' AS pending, o_orderstatus <> 'P' AND (o_orderkey % 25) % 5 = 0 AS invalid FROM orders""",
    "matter_merge": "SELECT l_partkey AS matter_id, array_to_string(list_sort(list(DISTINCT l_orderkey)), ',') AS facts, CAST(min(ascii(l_returnflag)) AS INTEGER) AS rank FROM lineitem GROUP BY 1",
    "rebuilt_sources": "SELECT doc_id, concat_ws('/', source, lang) AS snapshot FROM documents WHERE concat_ws('/', source, lang) NOT IN (SELECT concat_ws('/', source, lang) FROM documents WHERE doc_id % 67 = 0)",
    "post_read": "SELECT doc_id, CASE WHEN doc_id % 31 = 0 OR doc_id % 37 = 0 THEN 'error' ELSE 'success' END AS status, md5(CASE WHEN doc_id % 31 = 0 OR doc_id % 37 = 0 THEN '' ELSE text END) AS excerpt FROM documents",
    "collected_garbage": """WITH o AS (SELECT *, o_orderdate <= TIMESTAMP '2000-01-01' - INTERVAL 7 DAY AS old, o_orderkey % 1000 + 1 AS s FROM orders) SELECT o_orderkey, 'age' AS cause FROM o WHERE old UNION ALL SELECT o_orderkey, 'cap' FROM
      (SELECT o_orderkey, sum(s) OVER (PARTITION BY o_orderstatus) - coalesce(sum(s) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM o WHERE NOT old) WHERE l > 100000""",
    "call_reuse": f"""WITH e AS (SELECT *, {K} AS k FROM events), d AS (SELECT user_id, k, max(event_id) AS c FROM e WHERE event_type = 'view' GROUP BY 1, 2)
      SELECT event_id, CASE WHEN c IS NULL THEN 'call' WHEN c % 10 = 0 THEN 'corrupt' ELSE 'replay' END AS outcome FROM e LEFT JOIN d USING (user_id, k) WHERE event_type = 'click'""",
    "classification_lookup": f"""WITH {FILES_SQL} SELECT doc_id, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 3 <> 0 THEN 'hit' ELSE 'miss' END AS status,
      CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'not_cached_before' ELSE 'new_file' END WHEN doc_id % 7 = 0 THEN 'source_changed' WHEN doc_id % 3 = 0 THEN 'profile_changed' END AS miss_reason FROM named""",
    "migrated_weekly": """SELECT c_name AS week_label, concat_ws(chr(10), CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, CASE WHEN c_custkey % 5 <> 0 THEN c_name END) AS completed_work, 's' AS work_summary, 'p' AS next_plan, '' AS self_growth, '' AS improvement_actions, '' AS support_needed FROM customer""",
}
