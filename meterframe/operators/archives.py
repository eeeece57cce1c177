"""Retention and archives: periods from days, sealing, floors, and one representation of each partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterframe.functions import calendar as cal
from meterframe.operators.intervals import WEEK_DAYS, days, within
from meterframe.operators.rollups import DIMENSIONS, MEASURES, rollup_with_detail


def materialise_periods(rows: DataFrame, today: str, floor: str) -> DataFrame:
    """Every completed week, month and year of the daily rows, one a day and dimensions, from the floor on; sessions stay unknown."""
    day = F.col("local_day")
    week, month, year = cal.week_start(day), F.trunc(day, "month"), F.trunc(day, "year")
    spans = F.array(
        F.struct(F.lit("week").alias("grain"), cal.week_label(day).alias("label"), week.alias("first_day"), F.date_add(week, 7).alias("end_day")),
        F.struct(F.lit("month").alias("grain"), cal.month_label(day).alias("label"), month.alias("first_day"), F.add_months(month, 1).alias("end_day")),
        F.struct(F.lit("year").alias("grain"), F.date_format(day, "yyyy").alias("label"), year.alias("first_day"), F.add_months(year, 12).alias("end_day")),
    )
    spread = rows.select("*", F.explode(spans).alias("p")).select("*", "p.*").where((F.col("end_day") <= F.lit(today).cast("date")) & (F.col("first_day") >= F.lit(floor).cast("date")))
    sums = [F.sum(m).alias(m) for m in MEASURES]
    return spread.groupBy("grain", "label", "first_day", "end_day", *DIMENSIONS).agg(F.count("*").alias("active_days"), *sums)


def protected_day(today: Column) -> Column:
    """The day up to which daily rows may go: not past the current year's, month's or week's start, and whole ISO weeks only."""
    least = F.least(F.trunc(today, "year"), F.trunc(today, "month"), cal.week_start(today))
    return cal.week_start(least)


def advance_floor(persisted: Column, asked: Column) -> Column:
    """A floor only moves forward."""
    return F.greatest(persisted, asked)


def seal(rows: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """(days before the cutoff as sealed rows, the days that stay open)."""
    expired = F.col("local_day") < F.lit(cutoff).cast("date")
    return rows.where(expired).withColumn("sealed", F.lit(True)), rows.where(~expired).withColumn("sealed", F.lit(False))


def recompute(events_rollup: DataFrame, stored: DataFrame) -> DataFrame:
    """Recomputed rows for partitions that are not sealed, and the stored rows of those that are."""
    sealed = stored.where("sealed").select("local_day", "source_instance_id").distinct()
    fresh = events_rollup.join(sealed, ["local_day", "source_instance_id"], "left_anti")
    return fresh.withColumn("sealed", F.lit(False)).unionByName(stored.where("sealed"))


def retained(daily: DataFrame, archive: DataFrame) -> DataFrame:
    """Daily rows united with archived periods: a day that an archived row of its dimensions covers is not counted again,
    unless the daily row is of a newer revision, where both have one."""
    keys = list(DIMENSIONS)
    guarded = "revision" in daily.columns and "revision" in archive.columns
    spans = archive.select(*keys, "first_day", "end_day", *(["revision"] if guarded else [])).distinct()
    not_older = F.col("s.revision") >= F.col("r.revision") if guarded else None
    open_days = within(daily, spans, keys, days("local_day"), days("first_day"), days("end_day"), WEEK_DAYS, "left_anti", not_older)
    columns = ["source", "first_day", *keys, *MEASURES]
    return open_days.select(F.lit("daily").alias("source"), F.col("local_day").alias("first_day"), *keys, *MEASURES).unionByName(archive.select(F.lit("archive").alias("source"), *columns[1:]))


def unassigned_days(daily: DataFrame, archive: DataFrame, first: str, last: str, floor: str) -> DataFrame:
    """The days of [first, last] whose usage an archived period holds alone, as it cannot be told by day.

    That is a period from before the floor, or one without a daily row of its dimensions, unless such a row is newer.
    """
    keys = list(DIMENSIONS)
    near = archive.where((F.col("first_day") <= F.lit(last).cast("date")) & (F.col("end_day") > F.lit(first).cast("date")))
    spans = near.select(*keys, "grain", "first_day", "end_day", "revision")
    # a period is a year at most: rows further off lie in none of these
    close = daily.where(F.col("local_day").between(F.date_sub(F.lit(first).cast("date"), 366), F.date_add(F.lit(last).cast("date"), 366)))
    met = within(close.select(*keys, "local_day", F.col("revision").alias("newest")), spans, keys, days("local_day"), days("first_day"), days("end_day"), WEEK_DAYS, "inner")
    held = met.groupBy(*[F.col(f"s.{c}") for c in (*keys, "grain", "first_day", "end_day")]).agg(F.max("newest").alias("newest"))
    known = spans.join(held, [*keys, "grain", "first_day", "end_day"], "left")
    alone = known.where(((F.col("first_day") < F.lit(floor).cast("date")) | F.col("newest").isNull()) & F.coalesce(F.col("newest") <= F.col("revision"), F.lit(True)))
    span = F.sequence(F.greatest("first_day", F.lit(first).cast("date")), F.least(F.date_sub("end_day", 1), F.lit(last).cast("date")))
    return alone.select("first_day", "end_day").distinct().select(F.explode(span).alias("day")).distinct()


#: What the detail of an hour still tells beside its calls.
RECOVERED = ("input_known", "input_unknown", "uncached_sum", "uncached_known", "output_known", "output_unknown", "total_known", "total_unknown", "ratio_input", "ratio_read", "ratio_samples")


def enrich_hours(hours: DataFrame, detail: DataFrame, sealed: DataFrame) -> DataFrame:
    """A3: hourly rows with the counts and sums that their detail still gives (``detail``: its rollup), for partitions that are not sealed."""
    keys = ["local_day", "local_hour", *DIMENSIONS]
    found = detail.select(*keys, *[F.col(m).alias(f"detail_{m}") for m in RECOVERED])
    frozen = sealed.select("local_day", "source_instance_id").distinct().withColumn("frozen", F.lit(True))
    joined = hours.join(found, keys, "left").join(frozen, ["local_day", "source_instance_id"], "left")
    return joined.select(*keys, "events", *[F.when(F.col("frozen").isNull(), F.col(f"detail_{m}")).alias(f"detail_{m}") for m in RECOVERED])


def hours_with_detail(events: DataFrame, kept: Column, sealed: Column) -> DataFrame:
    """A3 where hours come from the same events as what is left of their detail: both in one pass.

    ``kept``: of an event, whether its detail is still there; ``sealed``: of a source and day.
    """
    rows = rollup_with_detail(events, kept, RECOVERED, "local_day", "local_hour")
    told = (F.col("kept") > 0) & ~F.coalesce(sealed, F.lit(False))
    return rows.select("local_day", "local_hour", *DIMENSIONS, "events", *[F.when(told, F.col(m)).alias(f"detail_{m}") for m in RECOVERED])
