"""Ranking, prefix and fold operators: fair interleave, eviction, islands, carries, offsets, greedy packing of lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import settled


def running(rows: DataFrame, keys: list[str], order: list, value: Column | int = 1) -> DataFrame:
    """rows with _before, the sum of value over the rows before in order, and _total, that of all rows of the keys.

    One key may hold most rows, so rows are dealt to ranges of (keys, order) and summed within each; the sums of whole ranges,
    a few rows a range, give what came before. Give it narrow rows: they are written once, so that both sums see the same ranges.
    """
    value = F.lit(value) if isinstance(value, int) else value
    placed = settled(rows.withColumn("_value", value).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = placed.withColumn("_inside", before("_value", Window.partitionBy(*keys, "_part").orderBy(*order)))
    sums = placed.groupBy(*keys, "_part").agg(F.sum("_value").alias("_all"))
    w = Window.partitionBy(*keys)
    sums = sums.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_part").alias("_range"), before("_all", w.orderBy("_part")).alias("_earlier"), F.sum("_all").over(w).alias("_total"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys), F.col("_part") == F.col("_range"))
    out = inside.join(sums, same).withColumn("_before", F.col("_earlier") + F.col("_inside"))
    return out.select(*rows.columns, "_before", "_total")


def interleave(rows: DataFrame, run: list[str], by: str, order: list) -> DataFrame:
    """turn and place: the i-th row of each `by` in turn, so that no class starves another. Rows are narrow."""
    turns = running(rows, [*run, by], order).withColumn("turn", (F.col("_before") + 1).cast("int")).drop("_before", "_total")
    return running(turns, run, ["turn", by, *order]).withColumn("place", (F.col("_before") + 1).cast("int")).drop("_before", "_total")


def evicted(entries: DataFrame, keys: list[str], order: list, size: str, cap: int) -> DataFrame:
    """Entries to drop, in order, until what is left fits the cap.

    Dropping only removes, so a running sum is exact: a row goes if everything from it on is still too much.
    """
    return running(entries, keys, order, F.col(size)).filter(F.col("_total") - F.col("_before") > cap).drop("_before", "_total")


def first_rows(rows: DataFrame, keys: list[str], order: list[str], most: int, salts: int = 64) -> DataFrame:
    """The first `most` rows of each key in order, with their number as _n. Each of some salts of a key is cut before one task sees what is left."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    some = salted.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).filter(F.col("_n") <= most)
    return some.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= most).drop("_salt")


def kept_tail(rows: DataFrame, keys: list[str], order: list, size: str, cap: int, most: int) -> DataFrame:
    """The prefix in order that keeps within a number of rows and a sum of sizes. Only the first rows of a key, by a rank cut before the shuffle, are summed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    return first.withColumn("_sum", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_sum") <= cap).drop("_n", "_sum")


def islands(ranges: DataFrame, keys: list[str], start: str = "start", end: str = "end", touching: bool = True) -> DataFrame:
    """Merged ranges: overlapping ones, and if `touching` those that meet. Equal ranges count once.

    One sort serves all: each merged range is read off its last row, where the largest end of its island is known.
    """
    w = Window.partitionBy(*keys).orderBy(start, end)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    again = F.lag(start).over(w).eqNullSafe(F.col(start)) & F.lag(end).over(w).eqNullSafe(F.col(end)) & (F.row_number().over(w) > 1)
    apart = F.when(~again & (seen.isNull() | (F.col(start) > seen if touching else F.col(start) >= seen)), 1).otherwise(0)
    marked = ranges.select(*keys, start, end, apart.alias("_apart"), F.lag(start).over(w).isNull().alias("_first"))
    marked = marked.withColumn("_island", F.sum("_apart").over(so_far)).withColumn("_last", F.coalesce(F.lead("_apart").over(w), F.lit(1)) == 1)
    opened = F.last(F.when((F.col("_apart") == 1) | F.col("_first"), F.col(start)), ignorenulls=True).over(so_far)
    marked = marked.withColumn("_start", opened).withColumn("_top", F.max(F.struct(F.col("_island"), F.col(end).alias("_end"))).over(so_far))
    return marked.filter("_last").select(*keys, F.col("_start").alias(start), F.col("_top._end").alias(end))


def covered(ranges: DataFrame, keys: list[str], start: str = "start", end: str = "end", some: Column | None = None) -> DataFrame:
    """Total length of the union of ranges, and as `some` that of the ranges for which a condition holds.

    One sort of bare ranges serves both: a range adds what lies beyond the largest end before it, so no merged ranges are made. Equal
    ranges count once.
    """
    ends = {"covered": end} if some is None else {"covered": end, "some": "_some"}
    rows = ranges if some is None else ranges.withColumn("_some", F.when(some, F.col(end)))
    w = Window.partitionBy(*keys).orderBy(start, end, *(F.desc_nulls_last(e) for e in list(ends.values())[1:]))
    same = F.lag(start).over(w).eqNullSafe(F.col(start)) & F.lag(end).over(w).eqNullSafe(F.col(end))
    added = []
    for name, e in ends.items():
        seen = F.max(e).over(w.rowsBetween(Window.unboundedPreceding, -1))
        beyond = F.when(seen.isNull() | (F.col(start) > seen), F.col(e) - F.col(start)).otherwise(F.greatest(F.lit(0), F.col(e) - seen))
        added.append(F.when(F.col(e).isNotNull() & ~(same & F.lag(e).over(w).isNotNull()), beyond).alias(name))
    return rows.select(*keys, start, end, *list(ends.values())[1:]).select(*keys, *added).groupBy(*keys).agg(*(F.sum(name).alias(name) for name in ends))


def last_seen(value: Column, keys: list[str], order: list) -> Column:
    """The nearest earlier value that is not null."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def offsets(rows: DataFrame, keys: list[str], order: list, size: Column, separator: int) -> DataFrame:
    """text_start and text_end of each part in the text that joins them with a separator."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size + separator).over(w), F.lit(0))
    return rows.withColumn("text_start", start).withColumn("text_end", F.col("text_start") + size)


def greedy_groups(sizes: Column, limit: int, separator: int = 0) -> Column:
    """Group number of each element: one joins the group while it fits, else it opens the next. Arrays are short."""
    start = F.struct(F.lit(-1).alias("group"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(s, x):
        joins = (s["group"] >= 0) & (s["used"] + separator + x <= limit)
        group = F.when(joins, s["group"]).otherwise(s["group"] + 1)
        return F.struct(group.alias("group"), F.when(joins, s["used"] + separator + x).otherwise(x).cast("long").alias("used"), F.concat(s["out"], F.array(group)).alias("out"))

    return F.aggregate(sizes, start, step)["out"]


def newest_that_fit(lines: Column, limit: int) -> Column:
    """Lines from the last backwards that still fit, long ones being skipped, in their own order."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("out"))

    def step(s, x):
        size = F.length(x) + 1
        fits = s["used"] + size <= limit
        return F.struct(F.when(fits, s["used"] + size).otherwise(s["used"]).cast("long").alias("used"), F.when(fits, F.concat(F.array(x), s["out"])).otherwise(s["out"]).alias("out"))

    return F.aggregate(F.reverse(lines), start, step)["out"]


def distinct_overview(keys: Column, most: int) -> Column:
    """Indexes of the first elements (arrays of keys) that add a key not seen yet, `most` at most."""
    start = F.struct(F.lit(0).alias("i"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<int>").alias("out"))

    def step(s, x):
        new = F.size(F.array_except(x, s["seen"])) > 0
        return F.struct((s["i"] + 1).alias("i"), F.array_union(s["seen"], x).alias("seen"), F.when(new, F.concat(s["out"], F.array(s["i"]))).otherwise(s["out"]).alias("out"))

    return F.slice(F.aggregate(keys, start, step)["out"], 1, most)
