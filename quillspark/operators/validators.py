"""Validators of sources and reports as rows of broken rules (B24). A row that keeps all rules doesn't come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What fields may hold. Fixed values.
STATUSES = ("success", "error", "timeout", "not_parsed")
STAGES = ("discovery", "parse", "excerpt", "model", "schedule")
QUALITIES = ("complete", "partial", "no_changes")
VERSIONS, ALIAS, NOTES = (3, 4), 64, 65_536
USER = "user_input"


def holds(condition: Column) -> Column:
    """A condition whose null is a breach."""
    return F.coalesce(condition, F.lit(False))


def is_sha256(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def is_utc(text: Column) -> Column:
    """An RFC 3339 time at UTC."""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|\+00:00)$") & F.try_to_timestamp(F.left(text, F.lit(19)), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull()


def is_relative(path: Column) -> Column:
    """A path that stays below its root: not empty, no drive, no leading separator, no step up."""
    return (F.length(path) > 0) & ~path.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")


def listed(rules: list[tuple[Column, str]]) -> Column:
    """Names of the rules whose condition does not hold."""
    return F.array_compact(F.array(*(F.when(~holds(c), name) for c, name in rules)))


def source_problems(sources: DataFrame, *keys: str) -> DataFrame:
    """keys, source_id and rule of each breach of a source.

    sources: source_id, source_kind, parse_status, excerpt_sha256, content_sha256, excerpt_chars, model_chars, observed_at_utc, modified_at_utc, relative_path.
    A file has a hashed id and a path below its root; a user's statement has the user's id and no path.
    """
    c = F.col
    user = holds(c("source_id") == USER)
    rules = [
        (user | (c("source_id").startswith("src_") & is_sha256(F.substr(c("source_id"), F.lit(5)))), "id"),
        (c("parse_status").isin(*STATUSES), "status"),
        (is_sha256(c("excerpt_sha256")), "excerpt_hash"),
        (c("content_sha256").isNull() | is_sha256(c("content_sha256")), "content_hash"),
        (c("model_chars") <= c("excerpt_chars"), "chars"),
        (is_utc(c("observed_at_utc")), "observed_at"),
        (c("modified_at_utc").isNull() | is_utc(c("modified_at_utc")), "modified_at"),
        ((c("source_kind") != "file") | (~user & holds(is_relative(c("relative_path")))), "file"),
        ((c("source_kind") != "user_statement") | (user & c("relative_path").isNull()), "statement"),
    ]
    return sources.select(*keys, "source_id", F.explode(listed(rules)).alias("rule"))


def report_problems(reports: DataFrame, sources: DataFrame, gaps: DataFrame, facts: DataFrame) -> DataFrame:
    """day and rule of each breach of a report, a row a rule whatever the number of its sources, gaps and facts that break it.

    reports: day, schema_version, report_kind, scope_id, timezone, root_alias, window_start_utc, window_end_utc, generated_at, user_notes, quality, has_content;
    sources: day, source_id, usable, unverified, parse_status, truncated; gaps: day, source_id, code, message, stage; facts: day, fact_id, pending, source_ids.
    The window is the day at UTC+8. A complete report has no gap, and each source whole and verified; one of a day without changes has nothing at all.
    """
    c = F.col
    start = F.try_to_timestamp(F.concat(c("day"), F.lit(" 00:00:00"))) - F.expr("INTERVAL 8 HOURS")
    at = lambda name: F.try_to_timestamp(F.left(c(name), F.lit(19)), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    kept = sources.groupBy("day", "source_id").agg(F.count("*").alias("n"), F.bool_or("usable").alias("usable"), F.bool_or("unverified").alias("unverified"), F.bool_and(holds((c("parse_status") == "success") & ~c("truncated") & ~c("unverified"))).alias("whole"))
    s = kept.groupBy("day").agg(F.max("n").alias("same"), F.count_if("usable").alias("usable"), F.bool_and("whole").alias("whole"), F.count("*").alias("sources"))
    known = kept.select(c("day").alias("_day"), c("source_id").alias("_id"), c("usable").alias("_usable"), c("unverified").alias("_unverified"))
    g = gaps.join(known, (c("day") == c("_day")) & (c("source_id") == c("_id")), "left")
    fine = holds(c("code").rlike("^[A-Za-z0-9_]{1,128}$") & (F.length("message") > 0) & c("stage").isin(*STAGES)) & (c("source_id").isNull() | c("_id").isNotNull())
    g = g.groupBy("day").agg(F.count("*").alias("gaps"), F.bool_and(fine).alias("gaps_fine"))
    cited = facts.select("day", "fact_id", F.coalesce("pending", F.lit(False)).alias("pending"), F.explode_outer("source_ids").alias("source_id")).join(known, (c("day") == c("_day")) & (c("source_id") == c("_id")), "left")
    rests = holds(c("_usable") & (c("pending") | ~c("_unverified")))
    f = cited.groupBy("day").agg(F.bool_and(rests).alias("facts_fine")).join(facts.groupBy("day").agg(F.count("*").alias("facts"), F.count_distinct("fact_id").alias("names")), "day")
    j = reports
    for other in (s, g, f):
        j = j.join(other, "day", "left")
    count = lambda name: F.coalesce(c(name), F.lit(0))
    rules = [
        (c("schema_version").isin(*VERSIONS) & (c("report_kind") == "file_evidence") & (c("scope_id") == "personal_work") & (c("timezone") == "Asia/Shanghai"), "kind"),
        (F.length("root_alias").between(1, ALIAS), "alias"),
        ((at("window_start_utc") == start) & (at("window_end_utc") == start + F.expr("INTERVAL 1 DAY")), "window"),
        (is_utc(c("generated_at")), "generated_at"),
        (F.length(F.coalesce("user_notes", F.lit(""))) <= NOTES, "notes"),
        (c("quality").isin(*QUALITIES), "quality"),
        (F.coalesce("same", F.lit(1)) == 1, "source_twice"),
        (F.coalesce("gaps_fine", F.lit(True)), "gap"),
        ((c("quality") != "no_changes") | ((count("sources") + count("facts") + count("gaps") == 0) & ~c("has_content")), "not_without_changes"),
        ((c("schema_version") != 3) | (c("quality") == "no_changes") | (count("usable") > 0), "nothing_usable"),
        ((c("quality") != "complete") | ((count("gaps") == 0) & F.coalesce("whole", F.lit(True))), "not_complete"),
        (count("facts") == count("names"), "fact_twice"),
        (F.coalesce("facts_fine", F.lit(True)), "fact"),
        (c("has_content") == (count("facts") > 0), "content"),
    ]
    return j.select("day", F.explode(listed(rules)).alias("rule"))


def history(reports: DataFrame, day: str, prefix: str | None = None, between: tuple[str, str] | None = None, days: DataFrame | None = None) -> DataFrame:
    """Reports of days with a prefix, from one day to another (both in), or of a list of days, a column `day`; any of these together."""
    out = reports
    if prefix is not None:
        out = out.filter(F.col(day).startswith(prefix))
    if between is not None:
        out = out.filter(F.col(day).between(*between))
    if days is not None:
        wanted = days.select(F.col("day").alias("_day")).distinct()
        out = out.join(wanted, F.col(day) == F.col("_day"), "left_semi")
    return out


def retained(sources: DataFrame, reports: DataFrame, key: str, ids: str) -> DataFrame:
    """Sources that a report cites at any depth; reports have the comma-separated ids that nested_ids() finds."""
    cited = reports.select(F.explode(F.split(ids, ",")).alias("_cited")).filter("_cited <> ''").distinct()
    return sources.join(cited, F.col(key).cast("string") == F.col("_cited"), "left_semi")
