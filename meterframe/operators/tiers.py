"""Tiered retention of stored tables: sealing with its terms, limits of each tier in turn, and skipping what has not changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterframe.functions import calendar as cal
from meterframe.operators.intervals import WEEK_DAYS, WEEK_MS, days, within
from meterframe.operators.archives import materialise_periods, protected_day

FIELD_VERSION = 1
MOST_DAYS = 750


@dataclass
class Policy:
    """Days that each tier is kept; None keeps years for ever."""

    events: int
    hourly: int
    daily: int
    weekly: int
    monthly: int
    yearly: int | None = None


def _cutoff(today: str, days: int) -> Column:
    return F.date_sub(F.lit(today).cast("date"), days - 1)


def seal(days: DataFrame, events: DataFrame, diagnostics: DataFrame, cutoff: Column, zone: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rollup days with ``sealed``, ``seal_zone``, ``seal_fields`` and ``seal_sources``, detail kept, diagnostics kept).

    Days before the cutoff are sealed as they stand, with the sources that they were made from; their detail goes.
    """
    expired = F.col("local_day") < cutoff
    sources = days.where(expired).groupBy("local_day").agg(F.array_sort(F.collect_set("source_instance_id")).alias("sources_"))  # a row a day, of as many as there are sources
    marked = days.join(F.broadcast(sources), "local_day", "left").withColumns({
        "sealed": expired, "seal_zone": F.when(expired, zone), "seal_fields": F.when(expired, FIELD_VERSION), "seal_sources": F.when(expired, F.col("sources_")),
    }).drop("sources_")
    return marked, events.where(~expired), diagnostics.where(~expired)


def enforce(tables: dict[str, DataFrame], policy: Policy, today: str, floor: str) -> dict[str, DataFrame]:
    """The tables after every tier in its order: detail and diagnostics, hours, periods made, days, then periods.

    ``tables``: events, diagnostics, hourly, daily, periods, costs. Daily and cost rows are sealed when their detail goes,
    and go together, never past the protected boundary; periods are made from daily rows before these go.
    """
    detail = _cutoff(today, policy.events)
    out = dict(tables)
    out["events"], out["diagnostics"] = (tables[t].where(F.col("local_day") >= detail) for t in ("events", "diagnostics"))
    sealed = F.col("sealed") | (F.col("local_day") < detail)
    out["daily"], out["costs"] = (tables[t].withColumn("sealed", sealed) for t in ("daily", "costs"))
    out["hourly"] = tables["hourly"].where(F.col("local_day") >= _cutoff(today, policy.hourly))
    made = materialise_periods(out["daily"].drop("sealed"), today, floor)
    keys = ["grain", "label", "source_instance_id"]
    held = tables["periods"].join(made.select(*keys).distinct(), keys, "left_anti")
    periods = held.unionByName(made)
    daily = F.least(_cutoff(today, policy.daily), protected_day(F.lit(today).cast("date")))
    out["daily"], out["costs"] = (out[t].where(F.col("local_day") >= daily) for t in ("daily", "costs"))
    limits = {"week": policy.weekly, "month": policy.monthly} | ({"year": policy.yearly} if policy.yearly else {})
    gone = F.lit(False)
    for grain, days in limits.items():
        gone |= (F.col("grain") == grain) & (F.date_sub("end_day", 1) < _cutoff(today, days))
    out["periods"] = periods.where(~gone)
    return out


def hard_limit(rows: DataFrame, first: str, last: str, cutoff: Column) -> DataFrame:
    """Rows whose span [first, last] does not reach behind the cutoff; one that crosses it goes as well."""
    return rows.where((F.col(first) >= cutoff) & (F.col(last) >= cutoff))


def completed_before(today: str) -> Column:
    """Every day of a completed period lies before this one."""
    day = F.lit(today).cast("date")
    return F.greatest(cal.week_start(day), F.trunc(day, "month"), F.trunc(day, "year"))


def fingerprint(daily: DataFrame, periods: DataFrame, today: str, scope: str) -> DataFrame:
    """One row of what periods were made from: counts and greatest revisions of completed days and of periods."""
    days = daily.where(F.col("local_day") < completed_before(today)).agg(F.count("*").alias("daily_rows"), F.coalesce(F.max("revision"), F.lit(0)).alias("daily_revision"))
    made = periods.agg(F.count("*").alias("period_rows"), F.coalesce(F.max("revision"), F.lit(0)).alias("period_revision"))
    return days.crossJoin(made).withColumn("scope", F.lit(scope))  # one row each


def unchanged(saved: DataFrame, now: DataFrame) -> DataFrame:
    """One row, ``unchanged``: whether periods need not be made again since the saved row (with its ``revision``)."""
    s, n = saved.alias("s"), now.alias("n")
    same = (F.col("s.daily_rows") == F.col("n.daily_rows")) & (F.col("s.period_rows") == F.col("n.period_rows"))
    same &= (F.col("n.daily_revision") <= F.col("s.revision")) & (F.col("n.period_revision") <= F.col("s.revision"))
    found = n.join(s, F.col("s.scope") == F.col("n.scope"), "left")
    return found.select(F.coalesce(same, F.lit(False)).alias("unchanged"))


def recompute_range(events: DataFrame, stored: DataFrame, roll, first: str, last: str, zone: str) -> DataFrame:
    """Stored rollup rows with those of the days [first, last] made anew from detail in a zone; sealed ones stay.

    ``roll`` makes the rollup of events with their local day. At most ``MOST_DAYS`` days.
    """
    import datetime

    days = (datetime.date.fromisoformat(last) - datetime.date.fromisoformat(first)).days + 1
    if not 1 <= days <= MOST_DAYS:
        raise ValueError(f"a range has 1 to {MOST_DAYS} days, not {days}")
    inside = F.col("local_day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    local = cal.local_time(F.col("occurred_at_ms"), zone)
    from_ms, to_ms = cal.day_start_ms(F.lit(first).cast("date"), zone), cal.day_end_ms(F.lit(last).cast("date"), zone)
    near = events.where((F.col("occurred_at_ms") >= from_ms) & (F.col("occurred_at_ms") < to_ms)).withColumns({"local_day": F.to_date(local), "local_hour": F.hour(local)})
    frozen = stored.where("sealed").select("local_day", "source_instance_id").distinct()
    fresh = roll(near).join(frozen, ["local_day", "source_instance_id"], "left_anti").withColumn("sealed", F.lit(False))
    return stored.where(~inside | F.col("sealed")).unionByName(fresh.where(inside).select(*stored.columns))


def replaced_days(daily: DataFrame, archive: DataFrame, keys: list[str]) -> DataFrame:
    """Daily rows that no archived row of their dimensions holds: one whose days include them and whose revision is not older."""
    fresh = F.col("s.revision") >= F.col("r.revision")
    return within(daily, archive.select(*keys, "first_day", "end_day", "revision"), keys, days("local_day"), days("first_day"), days("end_day"), WEEK_DAYS, "left_anti", fresh)


def unarchived_detail(events: DataFrame, archive: DataFrame, keys: list[str]) -> DataFrame:
    """Events that no archive row of their six dimensions covers: in [start_ms, end_ms), and in its hour where it has one."""
    hour = F.col("s.hour").isNull() | (F.col("s.hour") == F.col("r.local_hour"))
    return within(events, archive, keys, F.col("occurred_at_ms"), F.col("start_ms"), F.col("end_ms"), WEEK_MS, "left_anti", hour)


def changed_days(days: DataFrame, saved: DataFrame) -> DataFrame:
    """Days that are not sealed and whose revision is newer than the one saved with their costs; days without costs too."""
    held = saved.select("local_day", F.col("revision").alias("saved_"))
    return days.where("not sealed").join(held, "local_day", "left").where(F.coalesce(F.col("revision") > F.col("saved_"), F.lit(True))).drop("saved_")
