"""Streams of usage records: late and corrected records merged by identity, and counters with keyed state.

Records are merged into a stored table of versions, of which a batch reads and writes the days of its own identities alone;
their rollups are switched in with them. A replay changes nothing: identity and content decide, not how often a record arrives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from meterframe.functions import calendar
from meterframe.operators import rollups
from meterframe.sources import lines
from meterframe.sources.stored import checkpointed
from meterframe.streaming.versions import Versions


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table in ``path``, or None before its first batch."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def merge_batch(table: Versions, floor_ms: int = 0) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges records into ``table`` by identity.

    Records before the floor, and those without a time, go to a table of their own, merged in the same way: ``rejected``.
    """

    def write(batch: DataFrame, number: int) -> None:
        accepted = F.coalesce(F.col("occurred_at_ms") >= floor_ms, F.lit(False))
        batch.persist()  # a merge reads it several times
        try:
            rejected(table).merge(batch.where(~accepted))
            table.merge(batch.where(accepted))
        finally:
            batch.unpersist()

    return write


def rejected(table: Versions) -> Versions:
    """The table of the records that ``merge_batch`` does not accept."""
    return Versions(table.spark, f"{table.path}-rejected", table.keys, table.order, table.day)


def once(records: DataFrame, identity: list[str], kept: str = "1 day") -> DataFrame:
    """A stream of records without those that repeat one of the last ``kept``, so that no repeat reaches the merge.

    The watermark is on the time of arrival: a late record is late in its own time alone, and is let through. State ends
    with the watermark; a repeat that comes after it is left to the merge, which changes nothing for it.
    """
    arrived = records.withColumn("arrived_", F.current_timestamp()).withWatermark("arrived_", kept)
    return arrived.dropDuplicatesWithinWatermark(identity).drop("arrived_")


def by_local_hour(zone: str) -> Callable[[DataFrame], DataFrame]:
    """A rollup by local day and hour for ``Versions``; rows have the columns of an event, its time in ``occurred_at_ms``."""

    def roll(rows: DataFrame) -> DataFrame:
        local = calendar.local_time(F.col("occurred_at_ms"), zone)
        placed = rows.drop("local_day", "local_hour").withColumns({"local_day": F.to_date(local), "local_hour": F.hour(local)})
        return rollups.rollup(placed, "local_day", "local_hour")

    return roll


def local_day(zone: str) -> Column:
    return F.to_date(calendar.local_time(F.col("occurred_at_ms"), zone))


def claim_notices(spark: SparkSession, path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that stores each exceeded budget's key once; ``exceeded`` rows come with ``batch`` as they are claimed.

    A notice stays claimed: rows whose key the table holds are not written again, in whichever batch they come.
    """

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.where("exceeded").dropDuplicates(keys)
        held = stored(spark, path)
        if held is not None:
            # a null part of a key is a value like any other
            same = F.lit(True)
            for k in keys:
                same &= F.col(f"f.{k}").eqNullSafe(F.col(f"h.{k}"))
            fresh = fresh.alias("f").join(held.alias("h"), same, "left_anti")
        checkpointed(fresh.withColumn("batch", F.lit(number))).write.mode("append").parquet(path)

    return write


OVERLAP_MS = 60_000


def poll(source: DataFrame, control: str, updated: str, sink: Callable[[DataFrame, int], None], overlap_ms: int = OVERLAP_MS) -> int | None:
    """Gives ``sink`` the rows of an application table that have changed since the last poll, and saves how far it came.

    Rows of the last ``overlap_ms`` before the saved mark are read again, as writers commit late; the sink merges by
    identity. A table whose columns have changed is read from its beginning. Returns the new mark.
    """
    spark = source.sparkSession
    shape = ",".join(sorted(f"{f.name}:{f.dataType.simpleString()}" for f in source.schema.fields))
    held = stored(spark, control)
    saved = held.orderBy(F.desc("number")).first() if held is not None else None
    since = saved.mark - overlap_ms if saved and saved.mark is not None and saved.shape == shape else None
    fresh = checkpointed(source if since is None else source.where(F.col(updated) >= since))  # the mark is that of the rows the sink gets
    number = saved.number + 1 if saved else 0
    sink(fresh, number)
    top = fresh.agg(F.max(updated)).first()[0]
    mark = top if since is None or top is None else max(top, saved.mark)
    mark = saved.mark if mark is None and saved and saved.shape == shape else mark
    spark.createDataFrame([(number, mark, shape)], "number long, mark long, shape string").coalesce(1).write.mode("append").parquet(control)
    return mark


#: Line totals of so many batches are folded into one table.
FOLD = 64


def line_totals(spark: SparkSession, state: str, number: int) -> DataFrame | None:
    """(file, total): how many lines of each file the batches before ``number`` have read."""
    parts = [stored(spark, f"{state}/totals/{k}") for k in range(max(0, (number - 1) // FOLD * FOLD), number)]
    found = [p.withColumn("batch", F.lit(k)) for k, p in enumerate(parts) if p is not None]
    if not found:
        return None
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("file").agg(F.max_by("total", "batch").alias("total"))


def store_totals(spark: SparkSession, state: str, number: int, rows: DataFrame, before: DataFrame | None) -> None:
    """Totals of the files that a batch has read; every ``FOLD``-th batch stores those of all files, and what is older is no longer read."""
    fresh = lines.totals(rows, before)
    if number % FOLD == 0 and before is not None:
        fresh = before.join(fresh, "file", "left_anti").unionByName(fresh)
    fresh.write.mode("overwrite").parquet(f"{state}/totals/{number}")


def ingest_lines(spark: SparkSession, path: str, state: str, sink: Callable[[DataFrame, int], None], **options: object) -> DataStreamWriter:
    """A stream that gives ``sink`` the new whole lines (file, line, offset, value, fault) of the files under ``path``.

    ``state`` holds Spark's offsets and, by batch, how many lines were read of each file. A batch that is run again reads
    the same bytes and the totals from before it, so that lines keep their numbers; the sink merges by identity.
    """
    stream = lines.registered(spark).readStream.format("whole_lines").options(path=path, **options).load()

    def write(batch: DataFrame, number: int) -> None:
        before = line_totals(spark, state, number)
        batch.persist()  # read once for the counts and once for the sink
        try:
            sink(lines.readable(lines.numbered(batch, before)).select("file", "line", "offset", "value", "fault"), number)
            store_totals(spark, state, number, batch, before)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{state}/stream")
