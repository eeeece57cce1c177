"""Quota observations and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def observations(events: DataFrame) -> DataFrame:
    """(user_id, event_id, observed_ms, day, used): a user's value as the used part of a quota."""
    ms = F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz"))
    return events.select("user_id", "event_id", ms.alias("observed_ms"), F.to_date("ts").alias("day"), F.col("value").alias("used"))


def latest(seen: DataFrame, *keys: str) -> DataFrame:
    keys = keys or ("user_id",)
    return seen.groupBy(*keys).agg(F.max_by("used", F.struct("observed_ms", "event_id")).alias("used"), F.max("observed_ms").alias("observed_ms"))


def daily_series(seen: DataFrame) -> DataFrame:
    """The last observation of each day."""
    return latest(seen, "user_id", "day")


def budget_status(rows: DataFrame, keys: list[Column], threshold: int) -> DataFrame:
    """Known tokens against a threshold; limited coverage means that the true use may be higher."""
    used = F.sum("total_sum")
    return rows.groupBy(*keys).agg(used.alias("used"), F.lit(threshold).alias("threshold"), (F.sum("total_unknown") > 0).alias("coverage_limited"), F.coalesce(used >= threshold, F.lit(False)).alias("exceeded"))
