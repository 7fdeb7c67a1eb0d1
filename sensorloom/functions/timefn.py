"""Time column expressions. Record times are LONG epoch micros named ``us``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def micros(ts: Column) -> Column:
    """Epoch micros of a naive or zoned timestamp (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def from_epoch_ms(ms: Column, shift_hours: int = 0) -> Column:
    """Timestamp of an epoch-millisecond value, optionally shifted by whole hours."""
    return F.timestamp_millis((ms + F.lit(shift_hours * 3_600_000)).cast("long"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)


def to_local(us: Column, zone: Column) -> Column:
    """Naive local time of an instant in the row's own IANA zone."""
    return F.from_utc_timestamp(F.timestamp_micros(us), zone)


def hour_of(us: Column) -> Column:
    return F.hour(F.timestamp_micros(us))


def day_number(us: Column) -> Column:
    """Days since the epoch (UTC), exact for negative values as well."""
    from sensorloom.functions.scalars import floor_div

    return floor_div(us, DAY)


def weekday_of(us: Column) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.weekday(F.timestamp_micros(us))


def time_of_day(hour: Column) -> Column:
    """Day part of an hour: 0-5 night, 6-11 morning, 12-17 afternoon, 18-23 evening."""
    return (
        F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")
    )


def day_kind(weekday: Column) -> Column:
    return F.when(weekday >= 5, "weekend").otherwise("weekday")


def decimal_hour(us: Column) -> Column:
    """Hour of day with the minutes as a fraction."""
    ts = F.timestamp_micros(us)
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def decimal_hour_of_text(hhmm: Column) -> Column:
    """Decimal hour of an ``HH:MM`` text; NULL when it is not one."""
    parts = F.split(hhmm, ":")
    return F.try_divide(F.get(parts, F.lit(1)).try_cast("double"), F.lit(60.0)) + F.get(
        parts, F.lit(0)
    ).try_cast("double")


def seconds_between(start_us: Column, end_us: Column) -> Column:
    return (end_us - start_us) / F.lit(float(SECOND))
