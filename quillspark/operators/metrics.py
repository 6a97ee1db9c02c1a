"""Aggregations that must tell unknown from zero, and usage budgets that one unknown poisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import windows


def strict_total(value: Column) -> Column:
    """The sum, or null if any row lacks the value."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def known_total(value: Column) -> Column:
    """The sum of what is known; null if nothing ever was."""
    return F.sum(value)


def all_hit(hit: Column, looked_up: Column) -> Column:
    """Whether every lookup hit; null without lookups."""
    return F.when(F.count_if(looked_up) > 0, F.count_if(looked_up & hit) == F.count_if(looked_up))


def budget_usage(calls: DataFrame, scopes: list[tuple[str, str]], cost: str) -> DataFrame:
    """Usage per scope, each call counted in all of its scopes; one call of unknown cost makes a scope's cost unknown."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("scope"), F.col(column).cast("string").alias("id")) for name, column in scopes)))
    out = calls.select(each.alias("s"), cost).groupBy("s.scope", "s.id")
    return out.agg(F.count("*").alias("calls"), strict_total(F.col(cost)).alias("cost"))


def headed_groups(rows: DataFrame, keys: list[str], code: str, label: str, order: str, most: int) -> DataFrame:
    """Groups by code in order of first sight, with their distinct labels, shortened beyond `most`."""
    by = [*keys, code]
    some = rows.groupBy(*by, label).agg(F.min(order).alias("first"), F.count("*").alias("n"))
    g = some.groupBy(*by).agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.count(label).alias("_distinct"))
    shown = windows.first_rows(some.filter(F.col(label).isNotNull()).select(*by, label), by, [label], most)
    shown = shown.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(label)), lambda x: x.cast("string")), ", ").alias("labels"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by))
    j = g.join(shown.select(*(F.col(k).alias(f"_{k}") for k in by), "labels"), same, "left")
    more = F.when(F.col("_distinct") > most, F.concat(F.lit(" +"), (F.col("_distinct") - most).cast("string"))).otherwise("")
    return j.select(*by, "first", F.concat(F.coalesce("labels", F.lit("")), more).alias("labels"), "n")


def inclusive_percentiles(rows: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """Exact percentiles of each key with linear interpolation, as columns p0, p1 and so on; nulls don't count.

    The order statistics around each share are found by counts of ranges, so a key's values are never in one task.
    """
    placed = windows.running(rows.filter(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("_x")), [key], ["_x"])
    out = []
    for q in shares:
        at = (F.col("_total") - 1) * F.lit(q)
        low, part = F.max(F.when(F.col("_before") == F.floor(at), F.col("_x"))), F.max(at - F.floor(at))
        high = F.max(F.when(F.col("_before") == F.ceil(at), F.col("_x")))
        out.append((low + (high - low) * part).alias(f"p{len(out)}"))
    return placed.groupBy(key).agg(*out)


def worst(level: Column, order: tuple[str, ...]) -> Column:
    """The gravest of a group's levels, order being from good to bad."""
    return F.element_at(F.array(*(F.lit(x) for x in order)), F.max(F.array_position(F.array(*(F.lit(x) for x in order)), level)).cast("int"))
