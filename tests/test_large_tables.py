"""What the queries read and move, which grows with their tables."""

from pyspark.sql import functions as F

from meterframe import registry

SMALL = "/root/testdata/sf0.001"


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def _whole(frame):
    """How often the orders of all days are scanned."""
    scans = [line for line in _plan(frame).splitlines() if "FileScan parquet" in line and "o_orderkey" in line]
    return sum("(o_orderdate," not in line.replace("IsNotNull(o_orderdate)", "") for line in scans)


def test_an_export_joins_the_orders_of_its_days(spark):
    """only the host names are told from all events."""
    assert _whole(registry.QUERIES["s11_aggregate_export"](spark, SMALL)) == 1


def test_tariffs_are_chosen_in_one_pass_over_the_events(spark):
    """the models and providers are told from parts and nations; F18: so are substitutes, for whole spans of time."""
    assert _whole(registry.QUERIES["j13_costs_by_display_period"](spark, SMALL)) == 1
    assert _whole(registry.QUERIES["j3_substitute_prices"](spark, SMALL)) == 1
    assert _whole(registry.QUERIES["a20_cost_bounds"](spark, SMALL)) == 2  # days that are archived or not


def test_events_do_not_search_the_display_periods(spark):
    """of 28 periods each day looks for its own, not each event."""
    plan = registry.QUERIES["j13_costs_by_display_period"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "1995-01-01" not in plan.split("Aggregate [local_day")[1]


def test_substitutes_by_combinations(spark):
    """names that are given or read from the events tell the same; what has no known usage has no substitute."""
    from meterframe.operators import pricing

    book = [("p1", "p", "m", "eu", "api", False, "USD", 0, 1, 1000, None, 7, 7, 7, 7)]
    columns = "price_id string, provider string, model string, region string, channel string, official boolean, currency string, threshold long, priority int, from_ms long, to_ms long, input_rate long, read_rate long, write_rate long, output_rate long"
    calls = [(1, "m-preview", "p", 2000, 5), (2, "m-preview", "p", 999, 5), (3, "m-preview", "p", 2000, None), (4, "m", "p", 2000, 5), (5, None, "p", 2000, 5), (6, "m-preview", None, 2000, 5)]
    shape = "id int, model_raw string, provider_id string, occurred_at_ms long, input_uncached long"
    unknown = [F.lit(None).cast("long").alias(c) for c in ("input_cache_read", "input_cache_write", "input_total", "output_total")]
    events = spark.createDataFrame(calls, shape).select("*", *unknown)
    told = [pricing.substituted(events, spark.createDataFrame(book, columns), {"p": ("eu", "api")}, names=n) for n in (None, events.select("model_raw", "provider_id"))]
    for found in told:
        rows = {r.id: (r.reason, r.tariff and r.tariff.price_id, r.substitute) for r in found.collect()}
        assert rows == {1: (None, "p1", "m"), 2: ("no_price_row", None, None), 3: ("no_known_usage", None, None), 4: (None, "p1", None), 5: ("no_model", None, None), 6: ("no_provider", None, None)}


def test_tiers_read_the_days_that_they_keep(spark):
    """detail, hours, days and costs are each made from a first day on."""
    assert _whole(registry.QUERIES["r2_r6_tiered_retention"](spark, SMALL)) == 0


def test_hours_and_their_detail_come_from_one_pass(spark):
    """F13."""
    assert _whole(registry.QUERIES["a3_hourly_enrichment"](spark, SMALL)) == 1


def test_a_text_is_not_written_again_to_be_filtered(spark):
    """F15."""
    plan = registry.QUERIES["x2_source_specifications"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "2024-01-01T00:00:00Z" in line]


def test_records_are_sorted_once(spark):
    """F16: for repeats and for the target together."""
    from meterframe.sources import feeds

    rows = spark.createDataFrame([("a", 1, 1, 5), ("a", 1, 1, 4), ("a", 2, 1, 3), ("a", 3, 1, 1), ("b", 3, 1, 2)], "kind string, k int, n int, o int")
    held = spark.createDataFrame([(2,)], "k int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = feeds.insert_or_ignore(rows, "kind", {"b": "left_out"}, held, ["k"], ["k", "n"], ["o"])
        assert _plan(found).count("Sort [") == 2
        assert sorted((r.k, r.o, r.outcome) for r in found.collect()) == [(1, 4, "added"), (1, 5, "repeated"), (2, 3, "held"), (3, 1, "added"), (3, 2, "left_out")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_import_meets_its_target_in_one_join(spark):
    """sound and rejected rows are not told apart by reading the package for each."""
    assert _whole(registry.QUERIES["u9_detail_import"](spark, SMALL)) == 4


def test_sessions_are_not_copied_to_be_counted(spark):
    """what is expanded is a row a day."""
    plan = registry.QUERIES["a7_sessions_and_durations"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan.split("Expand")[-1]


def test_a_range_is_made_anew_from_its_own_days(spark):
    """beside the stored rows and the sealed ones among them."""
    assert _whole(registry.QUERIES["r8_recompute_range"](spark, SMALL)) == 2
