"""Report days as a stream: tumbling windows at UTC+8 midnight, late rows apart, one idempotent write a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OFFSET, LATE = "16 hours", "2 days"  # 16:00 UTC is midnight at UTC+8


def day_windows(events: DataFrame, ts: str = "ts", late: str | None = LATE) -> DataFrame:
    """Counts a report day. On a stream the watermark closes a day; what comes later is dropped from it (see late_rows)."""
    if late and events.isStreaming:
        events = events.withWatermark(ts, late)
    w = F.window(ts, "1 day", "1 day", OFFSET)
    g = events.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("centi"))
    return g.select(F.date_format(F.from_utc_timestamp("w.start", "+08:00"), "yyyy-MM-dd").alias("day"), "n", "errors", "centi")


def paged_scan(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """A restartable scan of a folder, some files at a time; the checkpoint is its cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def publish_days(days: DataFrame, target: str, checkpoint: str, late: bool = False):
    """Write each closed day once: a batch that comes again overwrites its own days only, so a restart repeats nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(target)

    return days.writeStream.outputMode("append" if not late else "update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
