"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions. SQL only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, materialize, null_safe, private

WEIGHTS, EPOCHS, SHARE, SEED, LANES = (5, 2, 1), 2, 1.5, 11, 1024
SPACES = " \t\n\x0b\x0c\r"


def words(text: str) -> F.Column:
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total: F.Column, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Targets for a table (source, source_size): shares of total by weight, none above epochs x its size.

    Clamping and resharing until none is above ends at one water level: sources in order of cap / weight are clamped
    while the level that the rest would share lies above their own. The level comes from running sums, so no loop is
    needed. The table has one row a source. Sources take the weights in turn by code point, null last; sizes of 0 give 0.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * epochs
    s = sources.withColumn("w", weight.cast("long")).withColumn("cap", cap).withColumn("total", total)
    by_fill = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    below = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("used", F.coalesce(F.sum("cap").over(below), F.lit(0))).withColumn(
        "rest", F.sum("w").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    )
    # the level if all sources before this one are clamped; the first that it does not clamp sets it for good
    s = s.withColumn("level", (F.col("total") - F.col("used")) / F.col("rest"))
    free = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    s = s.withColumn("water", F.first(free, ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("water") * F.col("w"), F.col("cap").cast("double")))
    return s.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", *, weights: tuple[int, ...] = WEIGHTS,
    epochs: int = EPOCHS, share: float = SHARE, seed: int = SEED, lanes: int = LANES,
) -> DataFrame:
    """key, source, size, source_size, target and taken (words the mix takes, repeats counted) of each document.

    Every document is taken whole floor(target / source_size) times. What is then missing is taken from the source's
    documents in a seeded random order until the target is met, the last of them in part; so each source meets its
    rounded target to the word and no document exceeds its repetitions plus one. The order is a digest of seed and key,
    so reruns agree. The running sum over that order is kept in `lanes` digest ranges a source: a hot source is spread
    over that many groups. Only (key, source, size) is shuffled; the texts are scanned once. Null texts have size 0.
    """
    sized = materialize(
        null_safe(docs, key, source, text).select(F.col(f"`{key}`").alias("id"), F.col(f"`{source}`").alias("source"), words(text).alias("size")), "mix-sizes"
    )
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    targets = materialize(water_fill(sums, total, weights, epochs), "mix-targets")
    ticket = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    lane = F.pmod(F.conv(F.substring("ticket", 1, 6), 16, 10).cast("long"), F.lit(lanes))
    drawn = sized.withColumn("ticket", ticket).withColumn("lane", lane)
    lane_sums = drawn.groupBy("source", "lane").agg(F.sum("size").alias("lane_size"))
    earlier = Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lane_sums = materialize(
        lane_sums.withColumn("before", F.coalesce(F.sum("lane_size").over(earlier), F.lit(0))).withColumnRenamed("source", "s").withColumnRenamed("lane", "l").drop("lane_size"),
        "mix-lanes",
    )
    inside = Window.partitionBy("source", "lane").orderBy("ticket", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(lane_sums, placed["source"].eqNullSafe(lane_sums["s"]) & (placed["lane"] == lane_sums["l"])).drop("s", "l")
    targets = targets.withColumnRenamed("source", "t")
    out = placed.join(targets, placed["source"].eqNullSafe(targets["t"]))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    missing = F.round("target").cast("long") - whole * F.col("source_size")
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), missing - F.col("before") - F.col("inside")))
    return out.select(F.col("id").alias(key), "source", "size", "source_size", "target", (whole * F.col("size") + extra).alias("taken"))


def take(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options: object) -> DataFrame:
    """docs as the mixture takes them: each row repeated as often as it is taken whole, then its first words if in part.

    Options go to mix(). Rows not taken, and those without words, do not come. Rows are told apart by key and text; equal
    rows share what is taken from them, whichever of them it is. A part keeps the white space between its words.
    """
    row, size, taken, copy = private(docs, "row", "words", "taken", "copy")
    name = F.concat_ws(":", F.col(f"`{key}`").cast("string"), F.xxhash64(f"`{text}`").cast("string"), F.xxhash64(F.lit(7), f"`{text}`").cast("string"))
    named = docs.withColumn(row, name)
    mixed = mix(named.select(row, source, text), text, source, row, **options).filter("taken > 0")
    number = Window.partitionBy(row)
    # which of some equal keys and texts is which must not change when a task runs again; a map has no order, but its JSON has
    kinds = [F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns if c != text]
    mixed = mixed.select(row, F.col("size").alias(size), F.col("taken").alias(taken), F.row_number().over(number.orderBy(F.desc("taken"))).alias(copy))
    rows = named.withColumn(copy, F.row_number().over(number.orderBy(F.xxhash64(*kinds), *kinds))).join(materialize(mixed, "mix-taken"), [row, copy])
    part = F.pmod(F.col(taken), F.col(size)).cast("int")
    words_kept = F.split(F.ltrim(F.col(f"`{text}`"), F.lit(SPACES)), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    first = F.rtrim(F.array_join(F.slice(words_kept, 1, part), ""), F.lit(SPACES))
    times = F.floor(F.col(taken) / F.col(size)).cast("int")
    texts = F.concat(F.array_repeat(F.col(f"`{text}`"), times), F.when(part > 0, F.array(first)).otherwise(F.array().cast("array<string>")))
    rest = [c for c in docs.columns if c != text]
    out = rows.select(*(F.col(f"`{c}`") for c in rest), F.explode(texts).alias(text))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws(':', '{SEED}', CAST(doc_id AS VARCHAR))) AS ticket FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS w,
         source_size * 2 AS cap, CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE) AS total FROM sums),
filled AS (
  SELECT *, (total - coalesce(CAST(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
            / CAST(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM weighed),
water AS (SELECT min_by(level, (cap / w, source)) AS water FROM filled WHERE level * w <= cap),
targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(water.water * w, CAST(cap AS DOUBLE))) AS target FROM filled, water),
ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY CAST('0x' || substr(s.ticket, 1, 6) AS BIGINT) % {LANES}, s.ticket, s.doc_id, s.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       whole * size + greatest(CAST(0 AS BIGINT), least(size, CAST(round(target) AS BIGINT) - whole * source_size - before)) AS taken
FROM ranked
"""
