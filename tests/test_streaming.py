"""Streams give what one batch gives, and a replay changes nothing."""

from pyspark.sql import functions as F

from meterframe.operators import ordered
from meterframe.streaming import ingest, state
from meterframe.streaming.versions import Versions



def versions_of(spark, path):
    return Versions(spark, path, ["key"], ["occurred_at_ms"], F.col("day"))


VERSION = "key string, occurred_at_ms long, source_revision long, lifecycle_rank int, content string, day string"


def test_merged_stream_equals_batch_and_replay(spark, tmp_path):
    rows = [(f"k{i % 7}", 1000 + i, i if i % 3 else None, i % 3, f"c{i % 5}", f"d{i % 2}") for i in range(60)] + [("late", 5, 1, 0, "x", "d0")]
    source, path = f"{tmp_path}/in", f"{tmp_path}/table"
    for part in range(3):
        spark.createDataFrame(rows[part::3], VERSION).coalesce(1).write.mode("append").parquet(source)
    for run in range(2):  # the second run sees every file again
        stream = spark.readStream.schema(VERSION).option("maxFilesPerTrigger", 1).parquet(source)
        write = ingest.merge_batch(versions_of(spark, path), floor_ms=100)
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/state{run}").trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.key, r.content, r.conflict, r.versions) for r in versions_of(spark, path).current().collect()}
    from meterframe.operators.merging import arbitrate

    want = {(r.key, r.content, r.conflict, r.versions) for r in arbitrate(spark.createDataFrame(rows[:-1], VERSION), ["key"], ["occurred_at_ms"]).collect()}
    assert got == want


def test_counter_state_equals_fold(spark, tmp_path):
    seen = [(i % 3, i, 10 * i, (i * 37) % 50 + i, i % 11 == 0) for i in range(90)]
    schema = "key long, tie long, at long, value long, reset boolean"
    for k, part in enumerate((seen[:40], seen[40:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"{tmp_path}/in")
    query = state.counter_stream(stream).writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.key, r.tie, r.outcome, r.amount) for r in spark.table("counted").collect()}
    fold = ordered.counter_deltas(spark.createDataFrame(seen, schema), "key", "at", "value", "reset", "tie")
    assert got == {(r.key, r.tie, r.outcome, r.amount) for r in fold.select("key", F.col("tie"), "outcome", "amount").collect()}


def test_final_record_replaces_its_partial_one_and_late_rows_are_reported(spark, tmp_path):
    rows = [("a", 1000, None, 0, "same", "d0"), ("a", 1000, None, 2, "same", "d0"), ("b", 1000, 1, 0, "same", "d0"), ("b", 1000, 2, 0, "same", "d0"), ("late", 5, 1, 0, "x", "d0")]
    path = f"{tmp_path}/table"
    write = ingest.merge_batch(versions_of(spark, path), floor_ms=100)
    for number in range(2):  # a replay changes nothing
        write(spark.createDataFrame(rows, VERSION), number)
    stands = {r.key: (r.source_revision, r.lifecycle_rank, r.versions) for r in versions_of(spark, path).current().collect()}
    assert stands == {"a": (None, 2, 2), "b": (2, 0, 2)}
    assert [r.key for r in ingest.rejected(versions_of(spark, path)).read().collect()] == ["late"]


def test_context_is_carried_across_batches(spark, tmp_path):
    rows = [("f1", 1, "m1", None), ("f1", 2, None, "p1"), ("f2", 1, None, None), ("f1", 3, None, None), ("f1", 4, "m2", None), ("f2", 2, "m9", None), ("f2", 3, None, None)]
    schema = "file string, line long, model string, parent string"
    for k, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = state.context_stream(stream, "file", "line", ["model", "parent"]).writeStream.format("memory").queryName("carried").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.file, r.line): (r.model, r.parent) for r in spark.table("carried").collect()}
    assert got == {("f1", 1): ("m1", None), ("f1", 2): ("m1", "p1"), ("f1", 3): ("m1", "p1"), ("f1", 4): ("m2", "p1"), ("f2", 1): (None, None), ("f2", 2): ("m9", None), ("f2", 3): ("m9", None)}


EVENT = VERSION + ", record_kind string, attribution_status string, source_instance_id string, agent string, provider_id string, model_raw string, call_category string, quality_bucket string, " + ", ".join(f"known_{t} long" for t in ("input_total", "input_uncached", "input_cache_read", "input_cache_write", "output_total", "total_tokens"))


def test_a_moved_record_recomputes_both_days(spark, tmp_path):
    from meterframe.functions import calendar
    from meterframe.operators import rollups

    hour, day = 3_600_000, 86_400_000
    start = 1_704_067_200_000  # 2024-01-01 in UTC, the evening before in New York

    def event(key, at, revision, tokens):
        return (key, at, revision, 1, f"c{tokens}", f"d{at // day}", "model_call", "verified", "i", "a", None, "m", "main", "complete", tokens, None, None, None, None, tokens)

    batches = [[event("a", start + 2 * hour, 1, 10), event("b", start + 3 * hour, 1, 20), event("only", start + 40 * hour, 1, 5)], [event("a", start + 30 * hour, 2, 11), event("only", start + 6 * hour, 2, 6)]]
    zone = "America/New_York"
    table = Versions(spark, f"{tmp_path}/events", ["key"], ["occurred_at_ms"], ingest.local_day(zone), ingest.by_local_hour(zone))
    write = ingest.merge_batch(table)
    for number, rows in enumerate([*batches, batches[1]]):  # the last batch is run again
        write(spark.createDataFrame(rows, EVENT), number)
    stands = spark.createDataFrame([batches[0][1], *batches[1]], EVENT)
    local = calendar.local_time(F.col("occurred_at_ms"), "America/New_York")
    want = rollups.rollup(stands.withColumns({"local_day": F.to_date(local), "local_hour": F.hour(local)}), "local_day", "local_hour")
    key = lambda rows: sorted((str(r.local_day), r.local_hour, r.events, r.total_sum) for r in rows.collect())
    assert key(table.rolled()) == key(want)


def test_alerts_are_claimed_once(spark, tmp_path):
    keys = ["user_id", "zone", "period", "first_day", "metric", "currency", "threshold"]
    schema = "user_id long, zone string, period string, first_day string, metric string, currency string, threshold long, exceeded boolean"
    row = lambda user, exceeded, threshold=5: (user, "UTC", "day", "2024-01-01", "tokens", None, threshold, exceeded)
    write = ingest.claim_notices(spark, f"{tmp_path}/notices", keys)
    batches = [[row(1, True), row(1, True), row(2, False)], [row(1, True), row(2, True), row(1, True, 9)], [row(2, True)]]
    for number, rows in enumerate([*batches, batches[-1]]):
        write(spark.createDataFrame(rows, schema), number)
    got = [(r.user_id, r.threshold, r.batch) for r in spark.read.parquet(f"{tmp_path}/notices").collect()]
    assert sorted(got) == [(1, 5, 0), (1, 9, 1), (2, 5, 1)]


def test_polls_overlap_and_start_anew_with_other_columns(spark, tmp_path):
    seen = []
    sink = lambda rows, number: seen.append(sorted(r.id for r in rows.collect()))
    rows = [(1, 1_000_000), (2, 1_050_000), (3, 1_100_000)]
    table = lambda some: spark.createDataFrame(some, "id long, updated_at long")
    control = f"{tmp_path}/control"
    assert ingest.poll(table(rows), control, "updated_at", sink) == 1_100_000
    assert ingest.poll(table([*rows, (4, 1_200_000)]), control, "updated_at", sink) == 1_200_000
    assert ingest.poll(table(rows), control, "updated_at", sink) == 1_200_000
    assert ingest.poll(table(rows).withColumn("new", F.lit(1)), control, "updated_at", sink) == 1_100_000
    assert seen == [[1, 2, 3], [2, 3, 4], [], [1, 2, 3]]


def test_an_ended_counter_does_not_add_its_total_again(spark, tmp_path):
    """What follows is told apart, of unknown amount, and the counter goes on from there."""
    import time

    schema = "key long, tie long, at long, value long, reset boolean"
    batches = [[(1, 0, 0, 900, False)], [(1, 1, 10, 1000, False), (1, 2, 20, 1010, False), (2, 3, 20, 7, False)]]
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for part, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
            out = state.counter_stream(stream, ttl_ms=1).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
            out.outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
            time.sleep(0.1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = [(r.outcome, r.amount) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("tie").collect()]
    assert got == [("first", 900), ("expired", None), ("delta", 10), ("first", 7)]


def test_a_batch_reads_its_own_days_however_long_the_history_is(spark, tmp_path, monkeypatch):
    """Days and index files that are read stay as few as history grows; a crash before the switch loses and shows nothing."""
    import pytest

    from meterframe.operators.merging import arbitrate
    from meterframe.streaming import versions

    monkeypatch.setattr(versions, "INDEX_ROWS", 8)
    table = versions_of(spark, f"{tmp_path}/table")
    row = lambda key, day, revision, content: (key, 1000 + day, revision, 0, content, f"d{day:02}")
    history = [row(f"k{i}", i % 20, 1, f"c{i}") for i in range(60)] + [row(None, 3, None, "none"), row("", 4, 2, "empty")]
    table.merge(spark.createDataFrame(history, VERSION))
    assert len(table.manifest()["index"]) >= 4 and len(table.manifest()["days"]) == 20
    update = [row("k7", 9, 2, "moved")]
    assert table.merge(spark.createDataFrame(update, VERSION)) == ["d07", "d09"]
    assert len({f for f in table.read_folders}) <= 4
    longer = [row(f"n{i}", 20 + i % 20, 1, "c") for i in range(60)]
    table.merge(spark.createDataFrame(longer, VERSION))
    back = [row("k7", 7, 3, "back"), row("k7", 7, 3, "back")]
    assert table.merge(spark.createDataFrame(back, VERSION)) == ["d07", "d09"] and len(set(table.read_folders)) <= 4

    def told():
        return sorted((str(r.key), r.content, r.conflict, r.versions) for r in table.current().collect())

    every = [*history, *update, *longer, back[0]]
    want = sorted((str(r.key), r.content, r.conflict, r.versions) for r in arbitrate(spark.createDataFrame(every, VERSION), ["key"], ["occurred_at_ms"]).collect())
    assert told() == want
    monkeypatch.setattr(table.table, "switch", lambda manifest: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError, match="crash"):
        table.merge(spark.createDataFrame([row("k1", 2, 9, "lost?")], VERSION))
    assert told() == want
    monkeypatch.undo()
    assert len(versions_of(spark, f"{tmp_path}/table").vacuum(keep=1)) >= 1 and told() == want
    table.merge(spark.createDataFrame([row("k1", 2, 9, "not lost")], VERSION))
    assert ("k1", "not lost", False, 2) in told()


def test_a_replay_writes_nothing_and_a_large_batch_is_merged_in_slices(spark, tmp_path, monkeypatch):
    """what is stored is known by its index; slices of a batch, and days of many folders, tell the same table."""
    from meterframe.operators.merging import arbitrate
    from meterframe.streaming import versions

    for name, value in (("SLICE_ROWS", 24), ("SEGMENTS", 0), ("INDEX_ROWS", 16)):
        monkeypatch.setattr(versions, name, value)
    before = spark.conf.get(versions._CLEANUP, None)
    table = versions_of(spark, f"{tmp_path}/table")
    row = lambda key, day, revision, content: (key, 1000 + day, revision, revision or 0, content, f"d{day:02}")
    first = [row(f"k{i}", i % 5, 1 if i % 3 else None, "c") for i in range(40)] + [row(None, 3, 1, "none")]
    second = [row(f"k{i}", i % 4, i % 3, f"c{i}") for i in range(0, 40, 4)] + [row(f"n{i}", i % 5, 1, "c") for i in range(30)] + [row(None, 1, 2, "moved")]
    for batch in (first, second):
        assert table.merge(spark.createDataFrame(batch, VERSION)) and table.merge(spark.createDataFrame(batch, VERSION)) == []
    assert table.manifest()["number"] == 1 and table.manifest()["versions"] == len({*first, *second})
    assert table.merge(spark.createDataFrame([row("late", 9, 1, "c"), second[0]], VERSION)) and len(table.manifest()["days"]["d09"]) == 1
    assert table.merge(spark.createDataFrame([row("later", 9, 1, "c")], VERSION)) == ["d09"]
    key = lambda found: sorted((str(r.key), r.content, r.conflict, r.versions, r.replaced) for r in found.collect())
    every = {*first, *second, row("late", 9, 1, "c"), row("later", 9, 1, "c")}
    assert key(table.current()) == key(arbitrate(spark.createDataFrame(list(every), VERSION), ["key"], ["occurred_at_ms"]))
    index = spark.read.parquet(*[f"{tmp_path}/table/{f}" for f in table.manifest()["index"].values()])
    assert index.count() == len(every) and {r.home_ for r in index.select("home_").distinct().collect()} == set(table.manifest()["days"])
    table.vacuum(keep=1)
    assert table.read().count() == len(every) and spark.conf.get(versions._CLEANUP, None) == before


def test_repeats_do_not_reach_the_merge(spark, tmp_path):
    rows = [("a", 1000, 1, 0, "x", "d0"), ("b", 1000, 1, 0, "x", "d0"), ("a", 1000, 1, 0, "x", "d0"), ("a", 5, 2, 0, "y", "d0"), ("b", 1000, 1, 0, "x", "d0")]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        seen = []
        for part in (rows[:2], rows[2:]):
            spark.createDataFrame(part, VERSION).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = ingest.once(spark.readStream.schema(VERSION).parquet(f"{tmp_path}/in"), ["key", "occurred_at_ms", "source_revision", "lifecycle_rank", "content"])
            write = lambda batch, number: seen.append(sorted((r.key, r.occurred_at_ms) for r in batch.collect()))
            stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [x for x in seen if x] == [[("a", 1000), ("b", 1000)], [("a", 5)]]
