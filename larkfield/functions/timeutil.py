"""Instants, local days and ages. Every function takes its instant; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = (("year", 365 * 86_400), ("month", 30 * 86_400), ("day", 86_400), ("hour", 3_600), ("minute", 60))


def zoned_parts(at: Column, zone: Column) -> Column:
    """struct(year, month, day, hour, minute, weekday) of an instant in a zone; weekday 0 is Sunday."""
    local = F.from_utc_timestamp(at, zone)
    return F.struct(F.year(local).alias("year"), F.month(local).alias("month"), F.day(local).alias("day"), F.hour(local).alias("hour"), F.minute(local).alias("minute"), (F.dayofweek(local) - 1).alias("weekday"))


def minutes_of_day(at: Column, zone: Column) -> Column:
    local = F.from_utc_timestamp(at, zone)
    return F.hour(local) * 60 + F.minute(local)


def start_of_local_day(at: Column, zone: Column) -> Column:
    """The instant at which the local day began."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(at, zone)), zone)


def start_of_utc_day(at: Column) -> Column:
    return F.date_trunc("day", at)


def days_before(at: Column, days: int) -> Column:
    return at - F.make_dt_interval(F.lit(days))


def relative_age(ts: Column, at: Column) -> Column:
    """struct(unit, count): the largest unit that fits, rounded; never for null, now under a minute."""
    seconds = (F.unix_millis(at) - F.unix_millis(ts)) / 1000.0
    unit, count = F.lit("now"), F.lit(0).cast("long")
    for name, size in reversed(UNITS):
        unit = F.when(F.abs(seconds) >= size, name).otherwise(unit)
        count = F.when(F.abs(seconds) >= size, F.floor(seconds / size + 0.5)).otherwise(count)
    return F.struct(F.when(ts.isNull(), "never").otherwise(unit).alias("unit"), F.when(ts.isNotNull(), count).alias("count"))
