"""Sinks: quoted CSV, upserts by key, immutable JSON, backups with a manifest, bounded logs, rendered periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def csv_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fixed columns as text, null as unknown; to be written with every cell quoted."""
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in columns))


def write_csv(df: DataFrame, columns: list[str], path: str) -> None:
    csv_rows(df, columns).write.mode("errorifexists").option("header", True).option("quoteAll", True).csv(path)


def upserted(stored: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Insert or update by key: of equal keys the newest row stays, new rows winning ties."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("_new")))
    return both.withColumn("_n", n).filter("_n = 1").drop("_n", "_new")


def immutable_conflicts(stored: DataFrame, new: DataFrame, key: str, body: str) -> DataFrame:
    """Keys written again with other bytes."""
    return new.select(key, F.sha2(body, 256).alias("_h")).join(stored.select(key, F.sha2(body, 256).alias("_s")), key).filter("_h <> _s").select(key)


def manifest(df: DataFrame, key: str) -> DataFrame:
    """One digest of a table that any order of rows gives, with its count: equal after a faithful copy."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    return df.agg(F.count("*").alias("rows"), F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest"), F.min(key).cast("string").alias("first"), F.max(key).cast("string").alias("last"))


def backup(spark: SparkSession, tables: dict[str, str], target: str) -> dict[str, bool]:
    """Copy tables and read them back: whether each copy's manifest equals its source's."""
    verified = {}
    for name, path in tables.items():
        source = spark.read.parquet(path)
        source.write.mode("errorifexists").parquet(f"{target}/{name}")
        key = source.columns[0]
        verified[name] = manifest(source, key).first() == manifest(spark.read.parquet(f"{target}/{name}"), key).first()
    return verified


def log_victims(logs: DataFrame, at: str, size: str, now: Column, days: int = 30, cap: int = 2 << 20) -> DataFrame:
    """Log files to drop: those past their days, then the oldest until the rest fits the cap. Rows are files of one log.

    The running sum is taken within each day, and over one row a day for the days after it, so no task gets all files.
    """
    old = F.col(at) < now - F.make_dt_interval(F.lit(days))
    rows = logs.withColumn("_day", F.to_date(at)).withColumn("_size", F.when(~old, F.col(size)).otherwise(0))
    newer = F.coalesce(F.sum("_all").over(Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = rows.groupBy("_day").agg(F.sum("_size").alias("_all")).select("_day", newer.alias("_newer"))
    inside = F.sum("_size").over(Window.partitionBy("_day").orderBy(F.desc(at), F.desc("path")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(totals, "_day").withColumn("_kept", F.col("_newer") + inside).filter(old | (F.col("_kept") > cap)).drop("_day", "_size", "_newer", "_kept")


def period_text(reports: DataFrame, period: str, day: str, body: str) -> DataFrame:
    """Reports of a period as sectioned text in order of their days."""
    parts = F.array_sort(F.collect_list(F.struct(day, body)))
    return reports.groupBy(period).agg(F.array_join(F.transform(parts, lambda p: F.concat(F.lit("## "), p[day], F.lit("\n"), p[body])), "\n\n").alias("text"))


def rendered(title: Column, sections: list[tuple[str, Column]]) -> Column:
    """Markdown of a title and the sections that have text."""
    shown = [F.when(F.length(F.trim(body)) > 0, F.concat(F.lit(f"## {name}\n"), F.trim(body))) for name, body in sections]
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), *shown)


def migrated_weekly(rows: DataFrame) -> DataFrame:
    """Old four-field weekly rows in the seven-field form: the overview goes before the completed work."""
    return rows.select(
        "week_label", F.concat_ws("\n", F.nullif("overview", F.lit("")), F.nullif("completed_work", F.lit(""))).alias("completed_work"), "work_summary", "next_plan",
        *(F.lit("").alias(c) for c in ("self_growth", "improvement_actions", "support_needed")),
    )
