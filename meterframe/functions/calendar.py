"""Local days, hours and periods in a named zone, independent of the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def utc_time(ms: Column) -> Column:
    """The UTC wall clock of epoch milliseconds."""
    return F.timestamp_add("MILLISECOND", ms, F.expr(_EPOCH))


def local_time(ms: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc_time(ms))


def local_day(ms: Column, zone: str) -> Column:
    return F.to_date(local_time(ms, zone))


def local_hour(ms: Column, zone: str) -> Column:
    return F.hour(local_time(ms, zone))


def local_weekday(ms: Column, zone: str) -> Column:
    """ISO weekday, Monday being 1."""
    return F.weekday(local_time(ms, zone)) + 1


def offset_seconds(ms: Column, zone: str) -> Column:
    return F.timestamp_diff("SECOND", utc_time(ms), local_time(ms, zone))


def _instant_ms(day: Column, zone: str) -> Column:
    """Epoch milliseconds of a local day's first instant."""
    midnight = F.convert_timezone(F.lit(zone), F.lit("UTC"), day.cast("timestamp_ntz"))
    return F.timestamp_diff("MILLISECOND", F.expr(_EPOCH), midnight)


def day_start_ms(day: Column, zone: str) -> Column:
    return _instant_ms(day, zone)


def day_end_ms(day: Column, zone: str) -> Column:
    """Past the day's last instant: 23, 24 or 25 hours after its first."""
    return _instant_ms(F.date_add(day, 1), zone)


def month_start_ms(day: Column, zone: str) -> Column:
    return _instant_ms(F.trunc(day, "month"), zone)


def month_end_ms(day: Column, zone: str) -> Column:
    return _instant_ms(F.add_months(F.trunc(day, "month"), 1), zone)


def week_start(day: Column, sunday: bool = False) -> Column:
    return F.date_sub(day, F.dayofweek(day) - 1) if sunday else F.date_sub(day, F.weekday(day))


def week_label(day: Column, sunday: bool = False) -> Column:
    """ISO ``YYYY-Www``; a week that begins on Sunday is named by its first day."""
    if sunday:
        return F.date_format(week_start(day, True), "yyyy-MM-dd")
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def hour_label(day: Column, hour: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":00"))


def retention_cutoff(today: Column, days: int) -> Column:
    """The first day that is kept of ``days`` days up to today."""
    return F.date_sub(today, days - 1)
