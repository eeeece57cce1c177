"""Sessions, series, heat maps, shares, pages and streaks over events and rollup rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def session_days(events: DataFrame) -> DataFrame:
    """(local_day, instance, session): its events and their durations, and those of its model calls."""
    calls = F.col("record_kind") == "model_call"
    return events.groupBy("local_day", "source_instance_id", "session_id").agg(
        F.count("*").alias("events"), F.sum("duration_ms").alias("duration"), F.count_if(calls).alias("calls"), F.sum(F.when(calls, F.col("duration_ms"))).alias("call_duration"), F.count(F.when(calls, F.col("duration_ms"))).alias("call_samples")
    )


def sessions(days: DataFrame, period: Column) -> DataFrame:
    """Of ``session_days``: distinct sessions of each period and overall, unknown as soon as one call has none; active days; durations where known.

    A session counts with its first day of a period, and overall with its first of all, so that nothing is copied for each grouping.
    """
    own = Window.partitionBy("source_instance_id", "session_id").orderBy("period", "local_day")
    marked = days.withColumn("period", period).withColumns({"turn_": F.row_number().over(own), "before_": F.lag("period").over(own)})
    opens = (F.col("turn_") == 1) | ~F.col("before_").eqNullSafe(F.col("period"))
    known = F.col("session_id").isNotNull() & F.col("source_instance_id").isNotNull()  # as a distinct count of both has it
    daily = marked.groupBy("period", "local_day").agg(
        F.count_if(opens & known).alias("in_period"), F.count_if((F.col("turn_") == 1) & known).alias("in_all"), F.bool_or(F.col("session_id").isNull()).alias("unknown"),
        F.sum("call_duration").alias("duration"), F.sum("call_samples").alias("samples"),
    )
    overall = F.grouping("period") == 1
    found = daily.rollup("period").agg(
        overall.alias("overall"),
        F.when(~F.bool_or("unknown"), F.when(overall, F.sum("in_all")).otherwise(F.sum("in_period"))).alias("sessions"),
        F.bool_or("unknown").alias("unknown_session"),
        F.count_distinct("local_day").alias("active_days"),
        F.sum("duration").alias("duration"),
        F.sum("samples").alias("samples"),
    )
    return found.withColumn("mean", F.when(F.col("samples") > 0, F.col("duration") / F.col("samples")))


def heatmap(rows: DataFrame, first: str, last: str, floor: str, unassigned: DataFrame | None = None) -> DataFrame:
    """One row for each calendar day, with or without usage.

    Days before the floor, and ``unassigned`` ones, whose usage an archived period holds, are not available; they are
    partial, and available, where daily rows tell some of it.
    """
    days = rows.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    sums = rows.where(F.col("local_day").between(first, last)).groupBy(F.col("local_day").alias("day")).agg(F.sum("calls").alias("calls"), F.sum("total_sum").alias("tokens"), F.lit(True).alias("told"))
    joined = days.join(sums, "day", "left")
    gone = F.col("day") < F.lit(floor).cast("date")
    if unassigned is not None:
        joined = joined.join(unassigned.select("day", F.lit(True).alias("held")), "day", "left")
        gone |= F.coalesce("held", F.lit(False))
    told = F.coalesce("told", F.lit(False))
    return joined.select("day", (F.weekday("day") + 1).alias("weekday"), F.coalesce("calls", F.lit(0)).alias("calls"), "tokens", (~gone | told).alias("available"), (gone & told).alias("partial"))


def series(rows: DataFrame, period: Column, by: str) -> DataFrame:
    name = {"total": F.lit("total"), "model": F.col("model"), "agent": F.col("agent"), "agent_model": F.concat_ws(" / ", "agent", "model")}[by]
    return rows.groupBy(period.alias("period"), name.alias("series")).agg(F.sum("calls").alias("calls"), F.sum("total_sum").alias("tokens"))


def shares(rows: DataFrame, name: str) -> DataFrame:
    """Each name's share of the known tokens, and the names without any as unknown; names that differ only in case are one."""
    sums = rows.groupBy(F.lower(name).alias("name")).agg(F.sum("total_sum").alias("tokens"))
    known = F.coalesce(F.col("tokens") > 0, F.lit(False))
    total = F.sum(F.when(known, F.col("tokens"))).over(Window.partitionBy())
    return sums.select("name", "tokens", F.when(known, F.col("tokens") / total).alias("share"), (~known).alias("unknown"))


def ordered(rows: DataFrame, named: dict[str, Column], value: str) -> DataFrame:
    """(axis, name, tokens, by_name, by_value): a breakdown by each axis with its places by name and by falling value, ties by name."""
    each = F.explode(F.array(*[F.struct(F.lit(axis).alias("axis"), name.alias("name")) for axis, name in named.items()]))
    out = rows.select(each.alias("p"), F.col(value).alias("value")).groupBy("p.name", "p.axis").agg(F.sum("value").alias("tokens"))  # one pass for all axes
    place = lambda *order: F.row_number().over(Window.partitionBy("axis").orderBy(*order))
    return out.withColumns({"by_name": place("name"), "by_value": place(F.desc_nulls_last("tokens"), "name")})


def exclusive_totals(intervals: DataFrame) -> DataFrame:
    """Known sums of the intervals that overlap no other; the rest are only counted."""
    only = F.col("coverage") == "exclusive"
    counts = [F.count_if(F.col("coverage") == c).alias(f"{c}_rows") for c in ("exclusive", "duplicate", "overlap_unknown")]
    return intervals.groupBy("source_instance_id").agg(*counts, *[F.sum(F.when(only, F.col(f"known_{t}"))).alias(t) for t in ("input_total", "output_total", "total_tokens")])


def page(events: DataFrame | Callable[[str | None], DataFrame], counts: DataFrame, ties: list[str], size: int, offset: int) -> DataFrame:
    """One page of 1 to 500 rows, newest first, ties by these columns, with a label to show and the number of all rows.

    ``counts``: (local_day, n) of the same rows, from a rollup. They tell the number of all rows, and the latest days that
    hold the page: only these are read, which in a table by ranges of days skips all files before them. ``events`` may be a
    function of the first of these days.
    """
    size = max(1, min(500, size))
    days = counts.groupBy("local_day").agg(F.sum("n").alias("n")).where("n > 0")
    newer = F.sum("n").over(Window.orderBy(F.desc("local_day")).rowsBetween(Window.unboundedPreceding, -1))  # one row a day
    first = F.min(F.when(F.coalesce("newer", F.lit(0)) < offset + size, F.col("local_day")))
    held = days.withColumn("newer", newer).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), first.alias("first")).first()
    rows = events(held.first and str(held.first)) if callable(events) else events
    rows = rows.where(F.col("local_day") >= F.lit(held.first)).orderBy(F.desc("occurred_at_ms"), *ties).offset(offset).limit(size)
    return rows.withColumns({"label": F.coalesce(F.nullif(F.trim("model_raw"), F.lit("")), F.lit("unknown")), "total": F.lit(held.total)})


def recent(rows: DataFrame, kind: str, code: str | None, limit: int, time: str, tie: str) -> DataFrame:
    rows = rows.where(F.col(kind) == code) if code else rows
    return rows.orderBy(F.desc(time), tie).limit(max(1, min(500, limit)))


def streaks(rows: DataFrame) -> DataFrame:
    """Active days, the longest run of consecutive ones, and the first of the busiest days, by instance."""
    days = rows.groupBy("source_instance_id", "local_day").agg(F.sum("calls").alias("calls")).where("calls > 0")
    turn = F.row_number().over(Window.partitionBy("source_instance_id").orderBy("local_day"))
    runs = days.withColumn("island", F.date_sub("local_day", turn)).groupBy("source_instance_id", "island").agg(F.count("*").alias("run"), F.sum("calls").alias("n"), F.max_by("local_day", F.struct("calls", -F.unix_date("local_day"))).alias("peak"), F.max("calls").alias("most"))
    return runs.groupBy("source_instance_id").agg(F.sum("run").alias("active_days"), F.max("run").alias("longest_run"), F.max_by("peak", F.struct("most", -F.unix_date("peak"))).alias("peak_day"), F.max("most").alias("peak_calls"))
