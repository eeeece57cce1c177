"""Rows that the given tables hold few of or none: equal asks, whole milliseconds, costs of zero, intervals across the first plausible time."""

import re

from pyspark.sql import functions as F

from meterframe import registry
from meterframe.operators import aliases, buckets


def test_equal_ranges_and_rules_meet_once(spark):
    """4,000 ranges that ask one thing and 4,000 rules that begin at once are joined as one row each."""
    ranges = spark.range(4000).select("id", F.lit("M").alias("raw"), F.lit("A").alias("agent"), F.lit(None).cast("string").alias("provider_id"), F.lit(10).cast("long").alias("from_ms"), F.lit(20).cast("long").alias("to_ms"))
    rules = spark.range(4000).select(F.lit("a").alias("agent"), F.lit("m").alias("key"), F.lit(None).cast("string").alias("provider_id"), F.lit("L").alias("label"), F.lit(5).cast("long").alias("from_ms"), F.when(F.col("id") > 0, 100).alias("until_ms"))
    named = aliases.labels(ranges, aliases.candidates(rules))
    named.write.format("noop").mode("overwrite").save()
    assert {r.label for r in named.select("label").distinct().collect()} == {"L"}
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 1
    below = plan[plan.index("Join Inner") :]
    assert below.count("Aggregate") == 2


def test_whole_milliseconds_keep_their_last(spark):
    """A quotient in doubles of these nanoseconds falls a millisecond short."""
    wanted = [1_706_303_126_426, 1_705_931_300_226]
    read = spark.createDataFrame([(w * 1_000_000,) for w in wanted], "ns long").select(buckets.instant_ms(F.col("ns")).alias("ms"))
    assert [r.ms for r in read.collect()] == wanted


def _against_sql(spark, name, folder, tables):
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for table, sql in tables.items():
        con.sql(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found, wanted = registry.QUERIES[name](spark, str(folder)), con.sql(registry.ORACLES[name])
    rows = sorted((tuple(r[c] for c in wanted.columns) for r in found.collect()), key=str)
    assert rows == sorted(wanted.fetchall(), key=str)
    return rows


def test_a_cost_of_zero_is_no_negative_one(spark, tmp_path):
    rows = _against_sql(spark, "n14_n16_times_and_costs", tmp_path, {"events": "SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-01' AS ts, 1::BIGINT AS user_id, 'view' AS event_type, CASE WHEN i = 1 THEN 0.0 ELSE i / 7 END::DOUBLE AS value FROM (SELECT unnest([5, 10, 1, 2]) AS i) UNION ALL SELECT 15, TIMESTAMP '2024-01-01', 1, 'view', 0.0"})
    assert {r[0]: r[3] for r in rows} == {5: None, 10: None, 15: 0, 1: 0, 2: 285714}


def test_an_interval_that_ends_before_the_first_plausible_time(spark, tmp_path):
    """It begins at that very time and ends a millisecond earlier: its time comes before its order."""
    rows = _against_sql(
        spark, "p7_event_validation", tmp_path,
        {
            "lineitem": "SELECT 1::BIGINT AS l_orderkey, 1272::BIGINT AS l_partkey, 0::BIGINT AS l_suppkey, 1 AS l_linenumber, 2.0 AS l_quantity, 100.0 AS l_extendedprice, 0.1 AS l_discount, 0.02 AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP '2000-01-05' AS l_shipdate",
            "orders": "SELECT 1::BIGINT AS o_orderkey, 1::BIGINT AS o_custkey, 'O' AS o_orderstatus, 1.0 AS o_totalprice, TIMESTAMP '2000-01-01' AS o_orderdate, '5-LOW' AS o_orderpriority",
            "part": "SELECT 1272::BIGINT AS p_partkey, 'n' AS p_name, 'Brand#11' AS p_brand, 'SMALL' AS p_type, 3 AS p_size, 1.0 AS p_retailprice",
            "supplier": "SELECT 0::BIGINT AS s_suppkey, 's' AS s_name, 0 AS s_nationkey, 1.0 AS s_acctbal",
            "nation": "SELECT 0 AS n_nationkey, 'CHINA' AS n_name, 0 AS n_regionkey",
        },
    )
    assert rows == [("implausible_time", 1)]


SMALL = "/root/testdata/sf0.001"


def test_one_answer_makes_no_stored_table(spark, monkeypatch, tmp_path):
    """Shares, breakdowns, pages and periods are told from events where no rollup is stored, and from it where one is."""
    from meterframe.plans import summaries
    from meterframe.sources import stored

    monkeypatch.setattr(stored, "folder", lambda spark: str(tmp_path))
    names = ("a13_token_share", "o4_ordered_breakdown", "o1_detail_page", "a4_periods", "r1_seal_and_delete")
    rows = lambda: {n: sorted(map(str, registry.QUERIES[n](spark, SMALL).collect())) for n in names}
    before = rows()
    assert not list(tmp_path.rglob("*.parquet"))
    assert summaries.daily(spark, SMALL).count() and summaries.details(spark, SMALL).count()
    assert rows() == before
    plan = registry.QUERIES["a13_token_share"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def _exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_periods_and_breakdowns_take_one_shuffle(spark):
    from meterframe.operators import activity, archives, rollups

    sums = {m: F.lit(1).cast("long") for m in rollups.MEASURES}
    days = spark.range(60).select(F.expr("date_add(DATE'2024-01-01', CAST(id AS INT))").alias("local_day"), *[F.lit("x").alias(d) for d in rollups.DIMENSIONS], *[c.alias(m) for m, c in sums.items()])
    periods = archives.materialise_periods(days, "2024-03-01", "2024-01-01")
    assert _exchanges(periods) == 1
    assert {r.label: r.active_days for r in periods.where("grain = 'month'").collect()} == {"2024-01": 31, "2024-02": 29}
    broken = activity.ordered(days, {"agent": F.col("agent"), "model": F.col("model")}, "total_sum")
    assert broken._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
    assert {(r.axis, r.name, r.tokens) for r in broken.collect()} == {("agent", "x", 60), ("model", "x", 60)}


def test_whole_days_are_sent_to_the_events(spark):
    """An export does not shuffle events, of all columns, to meet a row a source and day."""
    from meterframe.operators import exchange

    events = spark.range(100000).select(F.lit("s").alias("source_instance_id"), F.expr("date_add(DATE'2024-01-01', CAST(id % 10 AS INT))").alias("local_day"), F.col("id").alias("wide"))
    stored = events.groupBy("source_instance_id", "local_day").agg(F.count("*").alias("events"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records, archived, partial = exchange.export_details(events, stored, stored)
        assert "LeftSemi, BuildRight" in records._jdf.queryExecution().executedPlan().toString() and records.count() == 100000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not archived.count() and not partial.count()


def test_standing_versions_are_found_in_one_shuffle(spark, tmp_path):
    """All versions of an identity are brought together once, to drop repeats, to be ranked and to be marked."""
    from meterframe.streaming.versions import Versions

    table = Versions(spark, str(tmp_path), ["key"], ["occurred_at_ms"], F.col("day"))
    rows = [("a", 1, None, 0, "x", "d1"), ("a", 2, None, 1, "y", "d2"), ("a", 2, None, 1, "y", "d2"), (None, 3, 5, 0, "z", "d3")]
    spark.createDataFrame(rows, "key string, occurred_at_ms long, source_revision long, lifecycle_rank int, content string, day string").write.parquet(f"{tmp_path}/rows")
    standing = table._standing(table._hashed(spark.read.parquet(f"{tmp_path}/rows")))
    found = sorted((str(r.key), r.content, r.stands_, r.home_) for r in standing.collect())
    assert found == [("None", "z", True, "d3"), ("a", "x", False, "d2"), ("a", "y", True, "d2")]
    plan = standing._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert lines and all(re.search(r"hashpartitioning\(h_#\d+L, g_#\d+L, \d+\)", line) for line in lines)
