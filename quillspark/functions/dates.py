"""Report days, weeks and months as Column expressions. A report day is a calendar day at UTC+8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "+08:00"


def local_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def day_window(day: Column) -> Column:
    """[start, end) of a report day in UTC."""
    start = F.to_utc_timestamp(day.cast("timestamp"), ZONE)
    return F.struct(start.alias("start"), F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), ZONE).alias("end"))


def target_date(now: Column, due_hour: int) -> Column:
    """The day a scheduled run is for: yesterday, or the day before that until the due hour."""
    local = F.from_utc_timestamp(now, ZONE)
    return F.date_sub(F.to_date(local), F.when(F.hour(local) < due_hour, 2).otherwise(1))


def strict_date(text: Column) -> Column:
    """YYYY-MM-DD and nothing else; null otherwise."""
    day = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(F.date_format(day, "yyyy-MM-dd") == text, day)


def week_label(day: Column) -> Column:
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))


def week_start(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day))


def month_bounds(day: Column) -> Column:
    return F.struct(F.trunc(day, "month").alias("first"), F.last_day(day).alias("last"))


def utc_bucket(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def local_text(ts: Column) -> Column:
    return F.concat(F.date_format(F.from_utc_timestamp(ts, ZONE), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(ZONE))


def ns_time(ns: Column) -> Column:
    """The microsecond that a number of nanoseconds lies in, by whole numbers: a quotient of doubles can be off by one."""
    return F.timestamp_micros(F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000)))


def historical(generated: Column, report_day: Column) -> Column:
    return local_date(generated) > F.date_add(report_day, 1)
