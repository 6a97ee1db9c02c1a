"""Scalar functions over documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import dates, rules, text
from quillspark.queries.base import FILES_SQL, files
from quillspark.session import load


def text_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts by head and tail, log tail, fragments, notes, token estimates."""
    d = files(spark, sf_dir)
    t = F.col("content")
    return d.select(
        "doc_id", F.length(t).cast("long").alias("chars"), F.md5(text.compressed(t, F.col("extension"), 1000)).alias("compressed"), F.md5(text.bounded(t)).alias("bounded"),
        F.md5(text.truncated(t, 500)).alias("truncated"), text.token_estimate(t).alias("tokens"), F.md5(text.squeezed(t)).alias("squeezed"),
    )


def text_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escapes for markdown, table cells and LIKE; table cells and separators; sentences."""
    d = load(spark, sf_dir, "documents")
    t = F.col("text")
    return d.select(
        "doc_id", F.md5(text.markdown_escaped(t)).alias("markdown"), F.md5(text.cell_escaped(t)).alias("cell"), F.md5(text.like_escaped(t)).alias("escaped"),
        F.size(text.cells(t)).cast("long").alias("cells"), text.markdown_separator(F.lit("| --- | :---: |")).alias("separator"), F.size(text.sentences(t)).cast("long").alias("sentences"),
        F.round(text.printable_ratio(t), 6).alias("printable"),
    )


def text_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F08."""
    d = load(spark, sf_dir, "documents").select("doc_id", text.like_snippet(F.col("text"), "Thing").alias("snippet"))
    return d.filter("snippet IS NOT NULL")


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities, labels, versions, cell columns, costs and page samples."""
    d = files(spark, sf_dir)
    version = rules.source_version(F.col("doc_id") * 1000 + 7, F.col("size_bytes"))
    letters = F.concat(F.chr(F.lit(65) + F.col("doc_id") % 26), F.chr(F.lit(65) + F.floor(F.col("doc_id") / 26) % 26), F.lit("12"))
    return d.select(
        "doc_id", text.source_id(F.col("relative_path")).alias("source_id"), text.identity(F.col("run_id"), F.col("extension")).alias("identity"),
        text.domain_hash("parse\n", F.col("relative_path")).alias("domain_hash"), text.source_label(F.col("doc_id") % 1000).alias("label"), version.alias("version"),
        rules.version_parts(version)["size"].alias("version_size"), text.column_index(letters).alias("column"), text.cost_microunits(F.col("n_chars"), F.col("doc_id"), 3, 15).alias("cost"),
        text.files_per_second(F.col("doc_id"), F.col("n_chars")).alias("rate"), F.array_join(text.sample_pages(F.col("page_count"), 5), ",").alias("pages"),
        rules.relative_path(F.concat(F.lit("C:\\work\\"), F.translate("relative_path", "/", "\\")), "C:/work").alias("below"),
        text.usage_total(F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")), F.col("doc_id"), F.lit(5)).cast("long").alias("usage"),
    )


def rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters and predicates on paths, cells and facts."""
    d = files(spark, sf_dir)
    name = F.element_at(F.split("relative_path", "/"), -1)
    fact = F.concat("content", F.element_at(F.array(*(F.lit(w) for w in ("审批", "金额", "完成", "截止", "无"))), (F.col("doc_id") % 5 + 1).cast("int")))
    cells = F.array(F.lit("Name"), F.when(F.col("doc_id") % 2 == 0, "Amount").otherwise("12.5"), F.lit("Date"))
    coverage = rules.coverage(
        F.when(F.col("doc_id") % 7 == 0, "not_parsed").when(F.col("doc_id") % 7 == 1, "timeout").otherwise("success"), F.when(F.col("doc_id") % 7 == 3, 0).otherwise(F.col("n_chars")),
        F.when(F.col("doc_id") % 11 != 0, F.col("run_id")), F.when(F.col("doc_id") % 14 == 0, "file_size_policy"), F.col("extension"), F.col("n_chars") > 3000,
    )
    return d.select(
        "doc_id", rules.allowed_extension(name, (".TXT", ".md", ".csv")).alias("allowed"), rules.ignored(name, ("doc1*.txt", "*9?.md")).alias("ignored"),
        rules.excluded_dir(F.col("relative_path"), ("Logs",), ("work/A",)).alias("excluded"), rules.fact_priority(fact).alias("fact"),
        rules.header_row(cells, ("name", "amount", "date")).alias("header"), rules.vertical_sum(F.format_string("=SUM(B2:B%d)", F.col("doc_id") % 20 + 2), F.lit(12)).alias("vertical"),
        rules.usable(F.lit("success"), F.col("n_chars"), F.col("run_id")).alias("usable"), coverage["status"].alias("cover"), coverage["primary"].alias("cover_reason"), F.array_join(coverage["tags"], ",").alias("tags"),
    )


def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report days, windows, weeks and months of events."""
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = dates.local_date(F.col("ts"))
    ymd = lambda c: F.date_format(c, "yyyy-MM-dd")
    return e.select(
        "event_id", ymd(day).alias("day"), F.date_format(dates.day_window(day)["start"], "yyyy-MM-dd HH:mm").alias("start"), ymd(dates.target_date(F.col("ts"), 9)).alias("target"),
        dates.week_label(day).alias("week"), ymd(dates.week_start(day)).alias("monday"), ymd(dates.month_bounds(day)["first"]).alias("first"), ymd(dates.month_bounds(day)["last"]).alias("last"),
        dates.utc_bucket(F.unix_millis("ts")).alias("bucket"), dates.local_text(F.col("ts")).alias("local"), dates.historical(F.col("ts") + F.expr("interval 40 hours"), day).alias("historical"),
        ymd(dates.strict_date(F.concat(F.lit("2024-02-"), F.format_string("%02d", (F.col("event_id") % 31 + 1).cast("int"))))).alias("strict"),
        F.date_format(dates.ns_time(F.unix_micros("ts") * 1000 + 999), "yyyy-MM-dd HH:mm:ss").alias("from_ns"),
    )


QUERIES = {f.__name__: f for f in (text_bounds, text_escapes, text_snippets, text_keys, rule_flags, date_functions)}
HT = """head_room AS (SELECT *, left(content, 374) AS h, right(content, 562) AS e FROM named),
cutted AS (SELECT *, CASE WHEN contains(h, chr(10)) THEN left(h, length(h) - strpos(reverse(h), chr(10)) + 1) ELSE h END AS h2,
  CASE WHEN contains(e, chr(10)) THEN substr(e, strpos(e, chr(10)) + 1) ELSE e END AS e2 FROM head_room)"""
ORACLES = {
    "text_bounds": f"""WITH {FILES_SQL}, {HT} SELECT doc_id, length(content) AS chars,
      md5(CASE WHEN length(content) <= 1000 THEN content WHEN extension = '.log' THEN '…（已省略头部约 ' || (length(content) - 936) || ' 字符）…' || right(content, 936)
        ELSE h2 || '…（已省略中部约 ' || (length(content) - length(h2) - length(e2)) || ' 字符）…' || e2 END) AS compressed,
      md5(CASE WHEN length(content) <= 4000 THEN content ELSE left(content, 3994) || '…[已截断]' END) AS bounded,
      md5(CASE WHEN length(content) <= 500 THEN content ELSE left(content, 500) || chr(10) || chr(10) || '[内容已截断]' END) AS truncated,
      length(content) // 4 AS tokens, md5(trim(regexp_replace(content, '\\s+', ' ', 'g'))) AS squeezed FROM cutted""",
    "text_escapes": """WITH e AS (SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS x FROM documents)
      SELECT doc_id, md5(translate(regexp_replace(regexp_replace(x, '([\\\\`*_|])', '\\\\\\1', 'g'), '\\A#', '\\\\#'), chr(13) || chr(10), '  ')) AS markdown,
      md5(replace(translate(text, chr(13) || chr(10), '  '), '|', '\\|')) AS cell, md5(regexp_replace(text, '([\\\\%_])', '\\\\\\1', 'g')) AS escaped,
      CAST(len(str_split(regexp_replace(regexp_replace(trim(text), '^\\|', ''), '\\|$', ''), '|')) AS BIGINT) AS cells, true AS separator,
      CAST(len(list_filter(str_split_regex(replace(replace(regexp_replace(text, '([\\n。！？])', '\\1' || chr(1), 'g'), '. ', '. ' || chr(1)), chr(2), ''), chr(1)), lambda s: trim(s) <> '')) AS BIGINT) AS sentences,
      round(CASE WHEN length(text) = 0 THEN 0.0 ELSE length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]|\\x{FFFD}', '', 'g')) / length(text) END, 6) AS printable FROM e""",
    "text_snippets": """WITH s AS (SELECT doc_id, text, strpos(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'thing') AS a FROM documents)
      SELECT doc_id, CASE WHEN a > 41 THEN '…' ELSE '' END || substr(text, greatest(a - 41, 0) + 1, a - 1 - greatest(a - 41, 0)) || '[' || substr(text, a, 5) || ']' || substr(text, a + 5, 40)
        || CASE WHEN a + 44 < length(text) THEN '…' ELSE '' END AS snippet FROM s WHERE a > 0""",
    "text_keys": f"""WITH {FILES_SQL}, p AS (SELECT *, least(page_count, 5) AS n FROM named),
      w AS (SELECT *, CASE WHEN n >= 2 THEN [1, 2] WHEN n = 1 THEN [1] ELSE [] END AS hd FROM p),
      en AS (SELECT *, CASE WHEN len(hd) < n AND NOT list_contains(hd, page_count) THEN list_concat(hd, [page_count]) ELSE hd END AS en FROM w),
      sp AS (SELECT *, list_concat(en, list_transform(range(1, n - len(en) + 1), lambda i: 1 + ((page_count - 1) * i) // (n - len(en) + 1))) AS sp FROM en)
      SELECT doc_id, 'src_' || sha256(relative_path) AS source_id, sha256('["' || run_id || '","' || extension || '"]') AS identity, sha256('parse' || chr(10) || relative_path) AS domain_hash,
        'S' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') AS label, 'mtime_ns=' || (doc_id * 1000 + 7) || ':size=' || size_bytes AS version, size_bytes AS version_size,
        (doc_id % 26 + 1) * 26 + (doc_id // 26) % 26 AS "column", (n_chars * 3 + doc_id * 15 + 999999) // 1000000 AS cost,
        CASE WHEN n_chars <= 0 THEN 0.0 ELSE round(doc_id * 1000 / n_chars, 3) END AS rate,
        array_to_string(list_transform(range(0, n), lambda i: list_concat(list_distinct_keep, list_filter(range(1, page_count + 1), lambda x: NOT list_contains(list_distinct_keep, x)))[i + 1]), ',') AS pages,
        relative_path AS below, greatest(CASE WHEN doc_id % 3 = 0 THEN n_chars ELSE 0 END, doc_id + 5) AS usage
      FROM (SELECT *, list_filter(sp, lambda x, i: list_position(sp, x) = i) AS list_distinct_keep FROM sp)""",
    "rule_flags": f"""WITH {FILES_SQL}, b AS (SELECT *, string_split(relative_path, '/')[-1] AS name,
        CASE WHEN doc_id % 7 = 0 THEN 'not_parsed' WHEN doc_id % 7 = 1 OR doc_id % 11 = 0 AND doc_id % 7 <> 3 AND n_chars > 0 THEN 'parse_failed' WHEN doc_id % 7 <> 3 AND n_chars > 0 THEN 'usable_excerpt' ELSE 'empty_excerpt' END AS cover FROM named)
      SELECT doc_id, extension IN ('.txt','.md','.csv') AS allowed, regexp_matches(lower(name), '^doc1.*\\.txt$|^.*9.\\.md$') AS ignored,
        (relative_path LIKE 'Logs/%' OR relative_path LIKE 'work/A/%') AS excluded, CAST(doc_id % 5 AS INTEGER) AS fact, doc_id % 2 = 0 AS header, doc_id % 20 + 2 < 12 AS vertical, n_chars > 0 AS usable, cover,
        CASE WHEN cover = 'not_parsed' THEN CASE WHEN doc_id % 14 = 0 THEN 'file_too_large' ELSE 'unknown' END WHEN cover = 'parse_failed' THEN CASE WHEN doc_id % 7 = 1 THEN 'parse_timeout' ELSE 'parser_failed' END
          WHEN cover = 'empty_excerpt' THEN CASE WHEN n_chars > 3000 THEN 'excerpt_character_budget' ELSE 'no_business_content' END END AS cover_reason,
        concat_ws(',', CASE WHEN n_chars > 3000 OR cover = 'empty_excerpt' THEN 'EXCERPT_BOUNDED' END, CASE WHEN extension = '.csv' THEN 'PARSE_BOUNDED' END, CASE WHEN doc_id % 7 IN (0, 1) THEN 'SOURCE_UNAVAILABLE' END) AS tags FROM b""",
    "date_functions": """WITH e AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, CAST(CAST(ts AS TIMESTAMP) + INTERVAL 8 HOUR AS DATE) AS day, CAST(ts AS TIMESTAMP) + INTERVAL 8 HOUR AS l FROM events)
      SELECT event_id, strftime(day, '%Y-%m-%d') AS day, strftime(CAST(day AS TIMESTAMP) - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS start, strftime(day - CASE WHEN hour(l) < 9 THEN 2 ELSE 1 END, '%Y-%m-%d') AS target,
        strftime(day, '%G-W%V') AS week, strftime(date_trunc('week', day), '%Y-%m-%d') AS monday, strftime(date_trunc('month', day), '%Y-%m-%d') AS first, strftime(last_day(day), '%Y-%m-%d') AS last,
        strftime(ts, '%Y-%m-%d') AS bucket, strftime(l, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS local, CAST(l + INTERVAL 40 HOUR AS DATE) > day + 1 AS historical,
        CASE WHEN event_id % 31 + 1 <= 29 THEN '2024-02-' || lpad(CAST(event_id % 31 + 1 AS VARCHAR), 2, '0') END AS strict, strftime(ts, '%Y-%m-%d %H:%M:%S') AS from_ns FROM e""",
}
