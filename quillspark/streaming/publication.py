"""Publication of report bodies (K01, W04): staged candidates, digests expected of the target, conflicts kept as rows, a commit log.

Below one root lie `days` (what is published, a partition a day), `log` (what was committed), `staged` (decisions), `conflicts` (bodies that
met an edited target) and `replaced` (bodies that a revision took the place of); all but the first have a partition a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BODIES, LOG = "body string, day string", "day string, sha256 string, batch long"
DECIDED = "day string, body string, sha256 string, existing_body string, existing string, outcome string"


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the root, without rows as long as nobody wrote it."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def outcomes(candidates: DataFrame, current: DataFrame, log: DataFrame, revise: bool = True) -> DataFrame:
    """day, body, sha256, existing_body, existing (digest) and outcome of each day's candidate.

    A body that is null or empty is `not_staged`. A target that holds the candidate already is `already`: only the log may lack it. An absent
    target, and one with the digest that was last committed, is free: `publish`. Any other target was edited by somebody else: `conflict`.
    Without `revise` a day that has a commit is not published again: `committed`. Of several candidates of a day the
    greatest digest is taken, so reruns agree.
    """
    sha = F.sha2(F.col("body"), 256)
    new = candidates.filter("day IS NOT NULL").select(F.col("day").cast("string").alias("day"), "body", sha.alias("sha256"))
    new = new.groupBy("day").agg(F.max(F.struct("sha256", "body")).alias("c")).select("day", "c.body", "c.sha256")
    now = current.groupBy("day").agg(F.max(F.struct(sha.alias("existing"), F.col("body").alias("existing_body"))).alias("t")).select("day", "t.existing", "t.existing_body")
    last = log.groupBy("day").agg(F.max_by("sha256", F.struct("batch", "sha256")).alias("committed"))
    j = new.join(now, "day", "left").join(last, "day", "left")
    said = F.when(F.coalesce(F.length("body"), F.lit(0)) == 0, "not_staged").when(F.col("existing") == F.col("sha256"), "already")
    if not revise:
        said = said.when(F.col("committed").isNotNull(), "committed")
    said = said.when(F.col("existing").isNull() | (F.col("existing") == F.col("committed")), "publish").otherwise("conflict")
    return j.select("day", "body", "sha256", "existing_body", "existing", said.alias("outcome"))


def publish(candidates: DataFrame, root: str, batch: int, revise: bool = True, after: Callable[[str], None] = lambda step: None) -> DataFrame:
    """Publish one batch and return its decisions, conflicts found late among them.

    Decisions are written before anything else changes, and a batch that comes again goes on from them: every later step overwrites
    that batch's own rows, so a run that was killed anywhere ends as one that was not. Before days are written the target
    is looked at once more, and a day that changed since the decision becomes a conflict. A store without compare-and-swap leaves the moment of the
    write itself open. `after` is called with each step's name.
    """
    spark = candidates.sparkSession
    of_batch = lambda name: f"{root}/{name}/batch={batch}"
    decided = stored(spark, of_batch("staged"), DECIDED)
    try:
        spark.read.text(f"{of_batch('staged')}/_SUCCESS")
    except AnalysisException:
        log = stored(spark, f"{root}/log", LOG)
        outcomes(candidates, stored(spark, f"{root}/days", BODIES), log.filter(F.col("batch") < batch), revise).write.mode("overwrite").parquet(of_batch("staged"))
        decided = stored(spark, of_batch("staged"), DECIDED)
    after("staged")
    now = stored(spark, f"{root}/days", BODIES).groupBy("day").agg(F.max(F.sha2("body", 256)).alias("now"))
    late = (F.col("outcome") == "publish") & ~F.col("now").eqNullSafe(F.col("existing")) & ~F.col("now").eqNullSafe(F.col("sha256"))
    final = decided.join(now, "day", "left").withColumn("outcome", F.when(late, "conflict").otherwise(F.col("outcome"))).drop("now")
    final.write.mode("overwrite").parquet(of_batch("final"))  # what is read here is changed below
    final = stored(spark, of_batch("final"), DECIDED)
    final.filter("outcome = 'conflict'").select("day", "body", "sha256", "existing").write.mode("overwrite").parquet(of_batch("conflicts"))
    free = final.filter("outcome = 'publish'")
    free.filter("existing IS NOT NULL").select("day", F.col("existing_body").alias("body"), F.col("existing").alias("sha256")).write.mode("overwrite").parquet(of_batch("replaced"))
    after("kept")
    free.select("body", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{root}/days")
    after("days")
    final.filter("outcome IN ('publish', 'already')").select("day", "sha256").write.mode("overwrite").parquet(of_batch("log"))
    after("log")
    return final


def publish_days(days: DataFrame, body: F.Column, root: str, checkpoint: str, revise: bool = False, after: Callable[[str], None] = lambda step: None):
    """Publish each closed report day of a stream once. A restart repeats its last batch, which publish() takes up where it stopped.

    Without `revise` a day with a commit stays as it is, even if its rows come again with a new checkpoint.
    """

    def write(rows: DataFrame, batch: int) -> None:
        publish(rows.select("day", body.alias("body")), root, batch, revise, after)

    return days.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed_days(spark: SparkSession, root: str) -> DataFrame:
    """day, sha256 and batch of the last commit of each day, and whether the target still holds it."""
    log = stored(spark, f"{root}/log", LOG).groupBy("day").agg(F.max(F.struct("batch", "sha256")).alias("l")).select("day", "l.sha256", "l.batch")
    now = stored(spark, f"{root}/days", BODIES).groupBy("day").agg(F.max(F.sha2("body", 256)).alias("now"))
    return log.join(now, "day", "left").select("day", "sha256", "batch", F.col("now").eqNullSafe(F.col("sha256")).alias("intact"))
