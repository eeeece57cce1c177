"""Stored rollups stand for the state of their inputs."""

from meterframe.sources import stored


def test_a_changed_input_gives_another_state(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a.parquet")
    before = stored.state(spark, str(tmp_path), ("a",))
    assert before == stored.state(spark, str(tmp_path), ("a",))
    spark.range(4).write.mode("append").parquet(f"{tmp_path}/a.parquet")
    assert before != stored.state(spark, str(tmp_path), ("a",))


def test_new_files_are_seen_in_folders_below(spark, tmp_path):
    spark.range(3).withColumn("p", stored.F.lit(1)).write.partitionBy("p").parquet(f"{tmp_path}/a.parquet")
    before = stored.state(spark, str(tmp_path), ("a",))
    spark.range(4).write.parquet(f"{tmp_path}/more")
    next((tmp_path / "more").glob("part-*")).rename(tmp_path / "a.parquet" / "p=1" / "new.parquet")
    assert before != stored.state(spark, str(tmp_path), ("a",))


def test_only_changed_days_are_made_anew(spark, tmp_path, monkeypatch):
    """A new file of facts makes its days, beside the rest; another change makes all; readers of two jobs see one table."""
    F = stored.F
    monkeypatch.setattr(stored, "INPUTS", ("facts", "names"))
    monkeypatch.setattr(stored, "FACTS", ("facts",))
    day = F.expr("date_add(DATE'2024-01-01', CAST(id % 10 AS INT))").alias("local_day")
    facts, made = f"{tmp_path}/facts.parquet", []
    spark.range(100).coalesce(1).write.parquet(facts)
    spark.range(1).write.parquet(f"{tmp_path}/names.parquet")

    def make(first, last):
        made.append((first, last))
        return spark.read.parquet(facts).select(day).groupBy("local_day").agg(F.count("*").alias("n"))

    def touched(added):
        assert list(added) == ["facts"]
        return [str(r[0]) for r in spark.read.parquet(*added["facts"]).select(day).distinct().collect()]

    def table():
        return stored.stored(spark, str(tmp_path), "t", "local_day", make, touched)

    def counts():
        return {r.local_day.day: r.n for r in table().collect()}

    assert counts() == dict.fromkeys(range(1, 11), 10) and counts() and made == [(None, None)]
    for more in range(1, 12):
        spark.createDataFrame([(3,), (4,)], "id long").coalesce(1).write.mode("append").parquet(facts)
        assert counts() == {k: 10 + (more if k in (4, 5) else 0) for k in range(1, 11)}
    assert made[1:] == [("2024-01-04", "2024-01-05")] * 11
    spark.range(2).write.mode("append").parquet(f"{tmp_path}/names.parquet")
    assert counts()[1] == 10 and made[-1] == (None, None)
    assert table().where("local_day = DATE'2024-01-03'").count() == 1
    monkeypatch.setattr(stored, "version", lambda: "another")
    assert counts()[1] == 10 and len(made) == 14


def test_pages_read_the_days_that_hold_them(spark):
    from meterframe.operators import activity

    rows = [(f"2024-01-{d:02}", d * 100 + i, f"m{i}" if i else " ") for d in range(1, 29) for i in range(d % 3)]
    events = spark.createDataFrame(rows, "d string, occurred_at_ms long, model_raw string").withColumn("local_day", stored.F.col("d").cast("date"))
    counts = events.groupBy("local_day").agg(stored.F.count("*").alias("n"))
    order = sorted((r[1] for r in rows), reverse=True)
    for size, offset in ((5, 0), (5, 3), (500, 0), (3, len(rows) - 1), (5, 400)):
        page = activity.page(events, counts, ["model_raw"], size, offset).collect()
        assert [r.occurred_at_ms for r in page] == order[offset : offset + size] and all(r.total == len(rows) for r in page)
    assert activity.page(events.limit(0), counts.limit(0), ["model_raw"], 5, 0).count() == 0
