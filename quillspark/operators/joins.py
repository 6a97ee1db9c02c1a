"""The join shapes of the pipeline: caches with miss reasons, anti joins with an order, calendars, anchors, receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CACHE_KEY = ("file_identity", "source_version", "profile")


def cache_lookup(lookups: DataFrame, cache: DataFrame) -> DataFrame:
    """status and miss_reason of each lookup, most specific first: profile changed, source changed, cached before, new.

    One equi join a level against that level's distinct keys; nothing is looked up row by row, and input rows all stay.
    """
    exact = cache.select(*CACHE_KEY, F.col("body_hash"), F.lit(True).alias("exact"))
    same_source = cache.select("file_identity", "source_version").distinct().withColumn("same_source", F.lit(True))
    same_file = cache.select("file_identity").distinct().withColumn("same_file", F.lit(True))
    out = lookups.join(exact, list(CACHE_KEY), "left").join(same_source, ["file_identity", "source_version"], "left").join(same_file, "file_identity", "left")
    intact = F.col("exact") & F.col("body_hash").isNotNull()
    reason = (
        F.when(intact, F.lit(None).cast("string")).when(F.col("exact"), "cache_corrupt").when(F.col("same_source"), "profile_changed").when(F.col("same_file"), "source_changed")
        .when(F.col("existed_before"), "not_cached_before").otherwise("new_file")
    )
    return out.select(*lookups.columns, F.when(intact, "hit").otherwise("miss").alias("status"), reason.alias("miss_reason"))


def unresolved(rows: DataFrame, resolving: DataFrame, on: str, at: str = "ts") -> DataFrame:
    """rows without a later resolving row of the same key: an anti join by the newest of each key."""
    newest = resolving.groupBy(on).agg(F.max(at).alias("_newest"))
    return rows.join(newest, (rows[on] == newest[on]) & (newest["_newest"] > rows[at]), "left_anti")


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def calendar(bounds: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """A row per key and day between two dates."""
    return bounds.select(*keys, F.explode(F.sequence(first, last)).alias("day"))


def unique_anchors(left: DataFrame, right: DataFrame, pair: list[str], key: str) -> DataFrame:
    """Rows whose key is unique on both sides of a pair."""
    def once(side: DataFrame, position: str) -> DataFrame:
        return side.groupBy(*pair, key).agg(F.count("*").alias("_n"), F.first("pos").alias(position)).filter("_n = 1").drop("_n")

    return once(left, "left_pos").join(once(right, "right_pos"), [*pair, key])


def receipt_mismatches(discovered: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose stored row is missing or differs in any column, nulls being equal."""
    other = stored.select(key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_there"))
    joined = discovered.join(other, key, "left")
    wrong = [F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns]
    out = joined.withColumn("wrong", F.when(F.col("_there"), F.concat_ws(",", *wrong)).otherwise("missing"))
    return out.filter("wrong <> ''").select(key, "wrong")


def retry_merge(first: DataFrame, second: DataFrame, key: str, column: str) -> DataFrame:
    """The second scan wins; what it no longer sees is kept as an error."""
    a, b = first.select(key, F.col(column).alias("_a")), second.select(key, F.col(column).alias("_b"))
    out = a.join(b, key, "full_outer")
    return out.select(key, F.coalesce("_b", "_a").alias(column), F.when(F.col("_b").isNull(), "vanished").otherwise("ok").alias("state"))
