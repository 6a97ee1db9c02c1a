"""Memoised results and state transitions as joins and folds over event tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Allowed steps of a run. Fixed values.
STEPS = (("created", "scanning"), ("scanning", "prepared"), ("prepared", "generating"), ("generating", "db_committed"), ("db_committed", "published"))


def run_states(events: DataFrame, run: str, state: str, order: list) -> DataFrame:
    """The latest state of each run, and how many of its steps were not allowed."""
    w = Window.partitionBy(run).orderBy(*order)
    before = F.lag(state).over(w)
    allowed = reduce(lambda a, b: a | b, ((F.col("_before") == x) & (F.col(state) == y) for x, y in STEPS)) | F.col("_before").isNull() | (F.col("_before") == F.col(state))
    rows = events.withColumn("_before", before).withColumn("_bad", ~allowed)
    return rows.groupBy(run).agg(F.max_by(state, F.struct(*order)).alias("state"), F.count_if("_bad").alias("violations"))


def reuse_kind(failed: Column, snapshot: Column, hits: Column, lookups: Column) -> Column:
    """How much of a run was reused: nothing after an error, all by a snapshot, the parses if every lookup hit."""
    return F.when(failed, "none").when(snapshot, "snapshot").when((lookups > 0) & (hits == lookups), "parse").otherwise("none")


def profile_fingerprint(*settings: str) -> Column:
    """Fingerprint of every setting (a column each) that changes content: compact JSON with sorted keys, null settings kept."""
    return F.sha2(F.to_json(F.struct(*(F.col(s).alias(s) for s in sorted(settings))), {"ignoreNullFields": "false"}), 256)


def started(requests: DataFrame, attempts: DataFrame) -> DataFrame:
    """Outcome of each request to start: a stored result, one in progress, a conflict of hashes, or a new attempt number."""
    known = attempts.groupBy("request_id").agg(F.max("attempt").alias("last"), F.max_by("state", "attempt").alias("state"), F.max_by("hash", "attempt").alias("stored_hash"))
    j = requests.join(known, "request_id", "left")
    said = F.when(F.col("last").isNull(), "new").when(F.col("stored_hash") != F.col("hash"), "conflict").when(F.col("state") == "done", "stored").when(F.col("state") == "running", "in_progress").otherwise("new")
    return j.select("request_id", said.alias("outcome"), F.when(said == "new", F.coalesce("last", F.lit(0)) + 1).alias("attempt"))


def superseded(runs: DataFrame, published: DataFrame, scope: str, created: str) -> DataFrame:
    """Runs with pending siblings cancelled by a later publication of their scope."""
    last = published.groupBy(scope).agg(F.max(created).alias("_at"))
    return runs.join(last, scope, "left").withColumn("state", F.when((F.col("state") == "pending") & (F.col(created) < F.col("_at")), "cancelled").otherwise(F.col("state"))).drop("_at")


def revision_violations(revisions: DataFrame, job: str, number: str, limit: str) -> DataFrame:
    """Revisions that lower a limit or skip a number: increases must be authorised in turn."""
    w = Window.partitionBy(job).orderBy(number)
    r = revisions.withColumn("_l", F.lag(limit).over(w)).withColumn("_n", F.lag(number).over(w))
    return r.filter((F.col(limit) < F.col("_l")) | (F.col(number) != F.coalesce(F.col("_n"), F.lit(0)) + 1)).select(job, number)


def pin_violations(pins: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Pinned files whose size or digest changed, or that are gone."""
    n = now.select(key, F.col("size").alias("_s"), F.col("digest").alias("_d"))
    j = pins.join(n, key, "left")
    return j.filter(~(F.col("size").eqNullSafe(F.col("_s")) & F.col("digest").eqNullSafe(F.col("_d")))).select(key, F.when(F.col("_s").isNull(), "missing").otherwise("changed").alias("problem"))


def touched(cache: DataFrame, hits: DataFrame, key: str, bucket: str) -> DataFrame:
    """Access days moved on by hits, at most once a day and never back."""
    h = hits.groupBy(key).agg(F.max(bucket).alias("_b"))
    return cache.join(h, key, "left").withColumn(bucket, F.greatest(bucket, F.coalesce("_b", bucket))).drop("_b")


def snapshot_usable(sources: DataFrame, now: DataFrame, snapshot: str, key: str) -> DataFrame:
    """Snapshots all of whose cached bodies still have their digest."""
    j = sources.join(now.select(key, F.col("digest").alias("_d")), key, "left")
    return j.groupBy(snapshot).agg(F.bool_and(F.col("digest").eqNullSafe(F.col("_d"))).alias("usable"))


def claims(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Observed items that cite any unverified source become uncertain."""
    cited = items.select("item_id", F.explode("source_ids").alias("source_id")).join(sources, "source_id", "left")
    bad = cited.groupBy("item_id").agg(F.bool_or(F.coalesce("unverified", F.lit(True))).alias("_bad"))
    return items.join(bad, "item_id", "left").select("item_id", F.when((F.col("kind") == "observed") & F.coalesce("_bad", F.lit(False)), "uncertain").otherwise(F.col("kind")).alias("kind"))
