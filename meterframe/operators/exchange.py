"""Exchange of usage between stores: export and import of details and of aggregated partitions, intervals and snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterframe.operators.merging import upsert

SOURCE_DAY = ("source_instance_id", "local_day")


def source_days(events: DataFrame, stored: DataFrame) -> DataFrame:
    """(source, day, details, counted, complete): a day is complete if its details are as many as its rollup counts."""
    details = events.groupBy(*SOURCE_DAY).agg(F.count("*").alias("details"))
    counted = stored.groupBy(*SOURCE_DAY).agg(F.sum("events").alias("counted"))
    return details.join(counted, list(SOURCE_DAY), "left").withColumn("complete", F.coalesce(F.col("details") == F.col("counted"), F.lit(False)))


def export_details(events: DataFrame, stored: DataFrame, archives: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records as JSON text, archive rows without the source-days that are live, the source-days that are not complete)."""
    days = source_days(events, stored)
    whole = days.where("complete").select(*SOURCE_DAY)
    # a row a source and day, to which the wide events are not moved
    records = events.join(F.broadcast(whole), list(SOURCE_DAY), "left_semi").select(*SOURCE_DAY, F.to_json(F.struct(*[c for c in events.columns if c != "local_hour"])).alias("record"))
    return records, archives.join(F.broadcast(days.select(*SOURCE_DAY)), list(SOURCE_DAY), "left_anti"), days.where("not complete")


def import_details(target: DataFrame, package: DataFrame, archived: DataFrame, keys: list[str], valid: Column) -> DataFrame:
    """Every row's ``outcome``: ``rejected`` for all rows of a package with an invalid row, an identity twice, or a
    source-day that is archived; else what the arbitration with the stored row says. Rows of the target alone are kept.

    Where both sides have a ``conflict`` flag, a row that stands is flagged if the stored one was and has not been
    updated, if it comes flagged and is taken, or if this import is in conflict with it.
    """
    twice = F.count("*").over(Window.partitionBy("package", *keys)) > 1
    frozen = F.broadcast(archived.select(*SOURCE_DAY).distinct().withColumn("frozen_", F.lit(True)))  # a row a source and day
    checked = package.join(frozen, list(SOURCE_DAY), "left").withColumn("fault_", ~F.coalesce(valid, F.lit(False)) | twice | F.coalesce("frozen_", F.lit(False)))
    verdicts = checked.groupBy("package").agg(F.bool_or("fault_").alias("rejected_"))
    # a row a package is sent to the rows, which meet the target in one join whatever becomes of them
    judged = package.join(F.broadcast(verdicts), "package")
    columns = [*keys, *[c for c in target.columns if c not in keys]]
    merged = upsert(target.select(*columns), judged.select(*columns, "rejected_"), keys, "rejected_").select(*columns, "outcome")
    if "conflict" in columns:
        flag = F.coalesce("conflict", F.lit(False)) | (F.col("outcome") == "conflict")
        merged = merged.withColumn("conflict", F.when(F.col("outcome") == "rejected", F.col("conflict")).otherwise(flag))
    return merged


def rebuilt_costs(stored: DataFrame, merged: DataFrame, target: DataFrame, keys: list[str], costs: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cost rows by source-day after an import: those of the days that it has touched made anew, the others as stored.

    An update touches the day that it takes a row from as well as the one that it takes it to. ``costs`` makes the rows of
    given source-days.
    """
    changed = merged.where("outcome in ('added', 'updated')")
    moved = target.select(*dict.fromkeys([*keys, *SOURCE_DAY])).join(changed.where("outcome = 'updated'").select(*keys), keys, "left_semi")
    days = changed.select(*SOURCE_DAY).unionByName(moved.select(*SOURCE_DAY)).distinct()
    kept = stored.join(days, list(SOURCE_DAY), "left_anti").withColumn("rebuilt", F.lit(False))
    return kept.unionByName(costs(days).withColumn("rebuilt", F.lit(True)))


def export_partitions(daily: DataFrame, hourly: DataFrame, periods: DataFrame, hosts: DataFrame, first: str, end: str, with_hosts: bool) -> dict[str, DataFrame]:
    """The sources, days, hours and periods that lie in [first, end) as a whole; host names only if asked for."""
    a, z = F.lit(first).cast("date"), F.lit(end).cast("date")
    inside = (F.col("local_day") >= a) & (F.col("local_day") < z)
    out = {"daily": daily.where(inside), "hourly": hourly.where(inside), "period": periods.where((F.col("first_day") >= a) & (F.col("end_day") <= z))}
    used = out["daily"].select("source_instance_id").unionByName(out["hourly"].select("source_instance_id")).unionByName(out["period"].select("source_instance_id")).distinct()
    return {"sources": hosts.join(used, "source_instance_id", "left_semi").withColumn("host", F.col("host") if with_hosts else F.lit(None).cast("string"))} | out


def write_package(tables: dict[str, DataFrame], path: str) -> None:
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/{name}")


def partition_faults(rows: DataFrame, sources: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Package rows with ``fault``, the first rule that a row breaks, and ``rejected``: whether any row of its package does."""
    known = sources.select("package", "source_instance_id", F.col("agent").alias("declared_"))
    negative = F.lit(False)
    for v in values:
        negative |= F.coalesce(F.col(v) < 0, F.lit(False))
    grain = F.col("granularity").isin("day", "hour", "week", "month", "year")
    hour = F.when(F.col("granularity") == "hour", F.col("local_hour").between(0, 23)).otherwise(F.col("local_hour").isNull())
    fault = (
        F.when(F.col("declared_").isNull(), "undeclared_source")
        .when(F.col("declared_") != F.col("agent"), "other_agent")
        .when(negative, "negative_value")
        .when((F.col("calls") > F.col("events")) | (F.col("conflicts") > F.col("events")), "more_than_events")
        .when(~grain | ~F.coalesce(hour, F.lit(False)), "granularity")
    )
    marked = rows.join(known, ["package", "source_instance_id"], "left").withColumn("fault", fault).drop("declared_")
    # a package is told by a grouped verdict, so that its rows are not gathered in one task
    verdicts = marked.groupBy("package").agg(F.bool_or(F.col("fault").isNotNull()).alias("rejected"))
    return marked.join(verdicts, "package")


def merge_packages(stored: DataFrame, incoming: DataFrame, live: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """U8: ``outcome`` of each package row against the stored one; a package that overlaps live detail is rejected whole."""
    from meterframe.operators.merging import merge_partitions

    touched = incoming.join(live.select(*SOURCE_DAY).distinct(), list(SOURCE_DAY), "left_semi").select("package").distinct()
    sound = incoming.join(touched, "package", "left_anti")
    merged = merge_partitions(stored, sound, keys, values)
    return merged.unionByName(incoming.join(touched, "package", "left_semi").select(*keys, F.lit("overlaps_detail").alias("outcome")))


def upsert_intervals(stored: DataFrame, incoming: DataFrame, keys: list[str], floor_ms: int = 0) -> DataFrame:
    """Native intervals by key: below the floor or of equal content unchanged, an older revision ignored, a newer one
    replaces; an equal or missing revision with other content is a conflict, and the old interval stands."""
    o, n = stored.alias("o"), incoming.alias("n")
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"o.{k}") == F.col(f"n.{k}")
    newer, older = F.col("n.revision") > F.col("o.revision"), F.col("n.revision") < F.col("o.revision")
    low = F.coalesce(F.least("n.start_ms", "n.end_ms") < floor_ms, F.lit(False)) | F.col("n.start_ms").isNull()
    outcome = (
        F.when(F.col("n.content").isNull(), "kept").when(low, "below_floor").when(F.col("o.content").isNull(), "added").when(F.col("o.content") == F.col("n.content"), "unchanged")
        .when(F.coalesce(older, F.lit(False)), "ignored").when(F.coalesce(newer, F.lit(False)), "replaced").otherwise("conflict")
    )
    takes = outcome.isin("added", "replaced")
    columns = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys] + [F.when(takes, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in stored.columns if c not in keys]
    return o.join(n, on, "full_outer").select(*columns, outcome.alias("outcome"))


def replace_days(stored: DataFrame, snapshot: DataFrame, floor: Column, complete: Column | None = None) -> DataFrame:
    """The days that an authoritative snapshot holds from end to end take its rows, whole; others keep the stored ones.

    A source's first and last day in the snapshot may be cut off and are left alone, as are days before the floor.
    """
    spans = snapshot.groupBy("source_instance_id").agg(F.min("local_day").alias("first_"), F.max("local_day").alias("last_"))
    inside = (F.col("local_day") > F.col("first_")) & (F.col("local_day") < F.col("last_")) & (F.col("local_day") >= floor)
    held = snapshot.join(spans, "source_instance_id").where(inside if complete is None else inside & complete)
    fresh = held.drop("first_", "last_")
    kept = stored.join(spans, "source_instance_id", "left").where(~F.coalesce(inside, F.lit(False))).drop("first_", "last_")
    return kept.withColumn("origin", F.lit("stored")).unionByName(fresh.withColumn("origin", F.lit("snapshot")))


def import_snapshots(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(snapshot_id, outcome): a known snapshot of the same content is skipped, of other content rejected; the rest is added."""
    known = stored.select("snapshot_id", F.col("content").alias("held_"))
    outcome = F.when(F.col("held_").isNull(), "added").when(F.col("held_") == F.col("content"), "skipped").otherwise("rejected")
    return incoming.join(known, "snapshot_id", "left").select("snapshot_id", outcome.alias("outcome"))


def snapshot_content(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(snapshot_id, content, rows): a hash of each snapshot's rows that does not depend on their order."""
    each = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]))
    # the sum of the rows' hashes, so that no snapshot is gathered in one place
    part = F.conv(F.substring(each, 1, 12), 16, 10).cast("decimal(20,0)")
    return rows.groupBy("snapshot_id").agg(F.sum(part).cast("string").alias("content"), F.count("*").alias("rows"))
