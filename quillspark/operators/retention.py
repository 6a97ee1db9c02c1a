"""What is kept: protected runs and clean-up plans (E14), storage totals (G09), latest publications (G13), date windows (B04, D07), log lines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phases that a run can be resumed from; longest message in characters and longest log line in bytes. Fixed values.
RESUMABLE = ("prepared", "generating", "db_committed")
MESSAGE, LINE_BYTES = 512, 4096


def protected_runs(runs: DataFrame, references: DataFrame) -> DataFrame:
    """run_id of the runs that no clean-up may touch.

    runs: run_id, generation_id, status, phase, error_code; references: run_id, those that budgets, unfinished jobs or inputs of other runs name. Protected
    are running and resumable runs and referenced ones, and with each all runs of its generation, whose calls it may reuse.
    """
    resumable = F.col("phase").isin(*RESUMABLE) & (F.col("status") != "succeeded") & (F.coalesce("error_code", F.lit("")) != "RUN_SUPERSEDED")
    seeds = runs.filter((F.col("status") == "running") | resumable).select("run_id", "generation_id")
    named = runs.join(references.select("run_id").distinct(), "run_id", "left_semi").select("run_id", "generation_id")
    generations = seeds.unionByName(named).select("generation_id").distinct()
    return runs.join(generations, "generation_id", "left_semi").select("run_id")


def cleanup_plan(runs: DataFrame, references: DataFrame, current: DataFrame, finished: str, files_before: Column, runs_before: Column) -> DataFrame:
    """run_id and action of each run that a clean-up would touch: nothing is deleted here.

    A finished run that isn't protected loses its input snapshot once it is older than the one limit; past the other, one that is
    not published (current, or the one before a current) goes as a whole. current: run_id.
    """
    kept = current.select("run_id").distinct().withColumn("_published", F.lit(True))
    free = runs.join(protected_runs(runs, references), "run_id", "left_anti").join(kept, "run_id", "left")
    action = F.when((F.col(finished) < runs_before) & F.col("_published").isNull(), "remove_run").when((F.col(finished) < files_before) & F.col("has_snapshot"), "prune_snapshot")
    return free.select("run_id", action.alias("action")).filter("action IS NOT NULL")


def storage_totals(versions: DataFrame) -> DataFrame:
    """versions, logical_bytes, object_bytes and deduplicated_bytes of what is not pruned; versions: sha256, size_bytes, pruned. An object counts once."""
    live = versions.filter(~F.coalesce("pruned", F.lit(False)))
    objects = live.groupBy("sha256").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("all"), F.max("size_bytes").alias("one"))
    total = objects.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("versions"), F.coalesce(F.sum("all"), F.lit(0)).alias("logical_bytes"), F.coalesce(F.sum("one"), F.lit(0)).alias("object_bytes"))
    return total.withColumn("deduplicated_bytes", F.greatest(F.lit(0), F.col("logical_bytes") - F.col("object_bytes")))


def latest_publications(runs: DataFrame, scope: str, day: str, published: str) -> DataFrame:
    """scope, day, the time of the last publication and its run. Runs that were never published don't count."""
    return runs.filter(F.col(published).isNotNull()).groupBy(scope, day).agg(F.max(F.struct(F.col(published).alias("at"), "run_id")).alias("l")).select(scope, day, F.col("l.at").alias("published_at"), F.col("l.run_id").alias("run_id"))


def local_date(at: Column, hours: int = 8) -> Column:
    """The date at a fixed offset, as text."""
    return F.date_format(at + F.expr(f"INTERVAL {hours} HOURS"), "yyyy-MM-dd")


def in_window(modified: Column, days: tuple[dt.date, dt.date] | None = None, utc: tuple[dt.datetime, dt.datetime] | None = None, hours: int = 8) -> Column:
    """Whether a time lies in local days, both in, or in a half-open window at UTC, which counts if both are given. An empty or reversed window is an error."""
    if utc is not None:
        if not utc[0] < utc[1]:
            raise ValueError("invalid scan window")
        return (modified >= F.lit(utc[0])) & (modified < F.lit(utc[1]))
    if days is None or days[0] > days[1]:
        raise ValueError("invalid scan window")
    return local_date(modified, hours).between(str(days[0]), str(days[1]))


def log_lines(events: DataFrame, at: str, message: str, *fields: str) -> DataFrame:
    """File and line of each event, to be appended to the file of its local day; a line of too many bytes has no line but the error LOG_ENTRY_TOO_LARGE."""
    body = F.to_json(F.struct(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), F.left(F.col(message), F.lit(MESSAGE)).alias("message"), *fields))
    fits = F.octet_length(body) + 1 <= LINE_BYTES
    return events.select(F.concat(F.lit("scheduled-"), local_date(F.col(at)), F.lit(".jsonl")).alias("file"), F.when(fits, body).alias("line"), F.when(~fits, "LOG_ENTRY_TOO_LARGE").alias("error"), *fields)


def inventory_mismatches(inventory: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Keys that break the one-to-one match of inventory and results: twice on a side, or on one side only."""
    sides = inventory.groupBy(key).agg(F.count("*").alias("i")).join(results.groupBy(key).agg(F.count("*").alias("r")), key, "full")
    said = F.when(F.col("i").isNull(), "not_in_inventory").when(F.col("r").isNull(), "without_result").when(F.col("i") > 1, "inventory_twice").when(F.col("r") > 1, "result_twice")
    return sides.select(key, said.alias("problem")).filter("problem IS NOT NULL")


def assembled(discovered: DataFrame, plan: DataFrame, admission: DataFrame, classified: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """One row a discovered file: how far it came, and why no further.

    plan: key, route (null: none); admission: key, admit_action; classified: key, has_text; parsed: key, status, chars. Each stage says only what
    the one before let through.
    """
    j = discovered.select(key).join(plan.select(key, "route"), key, "left").join(admission.select(key, "admit_action"), key, "left").join(classified.select(key, "has_text"), key, "left").join(parsed.select(key, F.col("status").alias("_status"), "chars"), key, "left")
    stage = F.when(F.col("route").isNull(), "discovered").when(F.coalesce("admit_action", F.lit("")) != "admit", "planned").when(~F.coalesce("has_text", F.lit(True)), "classified").when(F.col("_status").isNull(), "admitted").otherwise("parsed")
    why = F.when(stage == "discovered", "no_route").when(stage == "planned", F.coalesce("admit_action", F.lit("not_admitted"))).when(stage == "classified", "pdf_no_text_in_parse_window").when(stage == "admitted", "no_result").when(F.col("_status") != "success", F.col("_status"))
    return j.select(key, stage.alias("stage"), why.alias("reason"), F.when((stage == "parsed") & (F.col("_status") == "success"), F.coalesce("chars", F.lit(0))).otherwise(0).cast("long").alias("chars"))
