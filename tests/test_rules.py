"""Fixed cases with expectations written by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterframe.functions import calendar as cal
from meterframe.functions import scalars as sc
from meterframe.operators import activity, archives, filters, merging, ordered, pricing, rollups
from meterframe.sources import prices


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize(("name", "key"), [(" GPT_5  mini ", "gpt-5-mini"), ("claude-opus-4.8", "claude-opus-4-8"), ("gpt-4.1", "gpt-4.1"), ("--a__b--", "a-b"), ("", "")])
def test_model_key(spark, name, key):
    assert one(spark, sc.model_key(F.col("m")), m=name) == key


@pytest.mark.parametrize(
    ("model", "provider", "at", "want"),
    [("openai/gpt-5.5-2026-04-23", "x", 0, "gpt-5.5"), ("mine/k3", "mine", 0, "kimi-k3"), ("mine/k3", "other", 0, "mine/k3"), ("any/gpt-5", "github-copilot", 0, "gpt-5"), ("kimi-for-coding", "x", 1_789_084_799_999, "kimi-for-coding"), ("kimi-for-coding", "x", 1_789_084_800_000, "kimi-k2.8-preview")],
)
def test_reference_model(spark, model, provider, at, want):
    assert one(spark, sc.reference_model(F.col("m"), F.col("p"), F.col("a")), m=model, p=provider, a=at) == want


def test_money_is_rounded_half_up_once(spark):
    assert one(spark, sc.component_amount(F.col("t"), F.col("r")), t=1, r=50_000_000) == 1
    assert one(spark, sc.component_amount(F.col("t"), F.col("r")), t=1, r=49_999_999) == 0
    assert one(spark, sc.component_amount(F.col("t"), F.col("r")), t=1 << 61, r=100_000_000) == 1 << 61
    exact = spark.createDataFrame([(1, 30_000_000)] * 4, "t long, r long").select((F.col("t").cast("decimal(19,0)") * F.col("r")).cast("decimal(38,0)").alias("e"))
    assert exact.agg(pricing.rounded(F.sum("e").cast("decimal(38,0)")).alias("x")).first().x == 1


def test_days_of_23_and_25_hours(spark):
    hours = lambda day: one(spark, (cal.day_end_ms(F.col("d").cast("date"), "America/New_York") - cal.day_start_ms(F.col("d").cast("date"), "America/New_York")) / 3_600_000, d=day)
    assert (hours("2024-03-10"), hours("2024-11-03"), hours("2024-06-01")) == (23, 25, 24)
    assert one(spark, cal.week_label(F.col("d").cast("date")), d="2024-12-30") == "2025-W01"
    assert one(spark, cal.local_hour(F.col("m"), "America/New_York"), m=1_730_611_800_000) == one(spark, cal.local_hour(F.col("m"), "America/New_York"), m=1_730_615_400_000) == 1


def test_versions_compare(spark):
    found = spark.createDataFrame([("1.9.0",), ("1.10.0",), ("1.2",)], "v string").agg(F.max_by("v", sc.version_parts(F.col("v"))).alias("x")).first().x
    assert found == "1.10.0"


EVENT = dict(source_instance_id="i", agent="a", provider_id="p", model_raw="m", call_category="main", attribution_status="verified", record_kind="model_call", session_id="s", local_day=dt.date(2024, 1, 1), duration_ms=5)
TYPES = "source_instance_id string, agent string, provider_id string, model_raw string, call_category string, attribution_status string, record_kind string, session_id string, local_day date, duration_ms long, quality_bucket string"


def events(spark, rows):
    tokens = ("input_total", "input_uncached", "input_cache_read", "input_cache_write", "output_total", "total_tokens")
    schema = TYPES + "".join(f", known_{t} long" for t in tokens)
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple({**EVENT, "quality_bucket": "complete", **{f"known_{k}": v for k, v in r.items() if k in tokens}, **{k: v for k, v in r.items() if k not in tokens}}.get(n) for n in names) for r in rows], schema)


def test_unknown_is_not_zero(spark):
    rows = [{"input_total": 10, "input_cache_read": 4}, {"output_total": 3}, {"quality_bucket": "unknown"}, {"record_kind": "transport_attempt", "input_total": 99}, {"attribution_status": "excluded", "input_total": 7}]
    r = rollups.resum(rollups.rollup(events(spark, rows), "local_day"), "agent").first()
    assert (r.events, r.calls, r.attempts) == (4, 3, 1)
    assert (r.input_sum, r.input_known, r.input_unknown) == (10, 1, 1) and (r.output_sum, r.output_unknown) == (3, 1)
    assert r.total_sum is None and (r.ratio_read, r.ratio_input, r.ratio_samples) == (4, 10, 1)


def test_sessions_count_once_a_period(spark):
    rows = [{"session_id": "s1"}, {"session_id": "s1", "local_day": dt.date(2024, 1, 2)}, {"session_id": "s1", "source_instance_id": "j"}]
    days = lambda some: activity.session_days(events(spark, some))
    r = activity.sessions(days(rows), F.lit("p").alias("period")).first()
    assert (r.sessions, r.active_days, r.duration, r.samples) == (2, 2, 15, 3)
    assert activity.sessions(days([*rows, {"session_id": None}]), F.lit("p").alias("period")).first().sessions is None


def test_arbitration_keeps_the_old_on_conflict(spark):
    def stands(*versions):
        frame = spark.createDataFrame([("k", i, r, rank, c) for i, (r, rank, c) in enumerate(versions)], "key string, at int, source_revision int, lifecycle_rank int, content string")
        r = merging.arbitrate(frame, ["key"], ["at"]).first()
        return r.content, r.conflict

    assert stands((1, 0, "a"), (2, 0, "b")) == ("b", False)
    assert stands((2, 0, "a"), (1, 2, "b")) == ("a", False)
    assert stands((1, 0, "a"), (1, 2, "b")) == ("a", True)
    assert stands((None, 1, "a"), (5, 1, "b")) == ("a", True)
    assert stands((None, 0, "a"), (5, 1, "b"), (None, 2, "c"), (6, 0, "d")) == ("c", False)
    assert stands((1, 1, "a"), (1, 1, "a")) == ("a", False)


def test_counter_regression_keeps_the_baseline(spark):
    seen = [(0, 100, False), (1, 130, False), (2, 90, False), (3, 140, False), (3, 150, False), (4, 5, True), (5, 5, False)]
    frame = spark.createDataFrame([(1, i, at, v, r) for i, (at, v, r) in enumerate(seen)], "k long, i long, at long, v long, r boolean")
    got = [(r.outcome, r.amount) for r in ordered.counter_deltas(frame, "k", "at", "v", "r", "i").orderBy("i").collect()]
    assert got == [("first", 100), ("delta", 30), ("regression", None), ("delta", 10), ("out_of_order", None), ("reset", 5), ("delta", 0)]


def test_active_path_drops_branches_and_stops_at_cycles(spark):
    nodes = [(1, 0, None), (1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 3), (2, 0, 1), (2, 1, 0)]
    got = ordered.active_path(spark.createDataFrame(nodes, "t long, n long, p long"), "t", "n", "p", "n").collect()
    assert sorted((r.t, r.n) for r in got) == [(1, 0), (1, 1), (1, 3), (1, 4), (2, 0), (2, 1)]


def test_floors_and_instances(spark):
    frame = spark.createDataFrame([("a", 5), ("b", 15)], "source_instance_id string, occurred_at_ms long")
    kept, dropped = filters.apply_floor(frame, 10, 3)
    assert (kept.count(), dropped.count()) == (1, 1)
    assert frame.where(filters.Filters(instances=[]).condition()).count() == 0 and frame.where(filters.Filters().condition()).count() == 2
    with pytest.raises(ValueError, match="after"):
        filters.between_labels(F.col("x"), "b", "a")
    assert one(spark, archives.protected_day(F.col("d").cast("date")), d="2024-01-03") == dt.date(2024, 1, 1)


BOOK = "priority int, from_ms long, to_ms long, price_id string, provider string, model string, region string, channel string, official boolean, currency string, threshold long, input_rate long, read_rate long, write_rate long, output_rate long"
CALL = "provider_id string, model_raw string, occurred_at_ms long, input_uncached long, input_cache_read long, input_cache_write long, input_total long, output_total long"


@pytest.mark.parametrize(
    ("call", "price", "reason"),
    [
        (("P", "M-1", 50, 10, 0, 0, 10, 1), "own", None),
        (("P", "m_1", 50, 10, 0, 0, 900, 1), "own-long", None),
        (("other", "M-1", 50, 10, 0, 0, 10, 1), "vendor", None),
        (("P", "M-1", 500, 10, 0, 0, 10, 1), None, "no_price_row"),
        (("P", None, 50, 10, 0, 0, 10, 1), None, "no_model"),
        (("P", "M-1", 50, None, None, None, None, None), None, "no_known_usage"),
        (("P", "M-1", 50, 10, 8, 8, 10, 1), None, "token_anomaly"),
        (("P", "M-1", 50, None, 1, None, None, 1), None, "tier_ambiguous"),
        (("", "M-9", 50, 10, 0, 0, 10, 1), None, "no_provider"),
        (("zz", "M-9", 50, 10, 0, 0, 10, 1), None, "channel_unknown"),
    ],
)
def test_tariff_choice(spark, call, price, reason):
    book = [
        (0, 0, 100, "own", "p", "m-1", "eu", "api", False, "USD", 0, 100, 10, 20, 300), (0, 0, 100, "own-long", "p", "m-1", "eu", "api", False, "USD", 500, 200, 10, 20, 600),
        (0, 0, 100, "vendor", "v", "m-1", "global", "api", True, "USD", 0, 1, 1, 1, 1), (1, 0, None, "older", "v", "m-1", "global", "api", True, "EUR", 0, 1, 1, 1, 1), (0, 0, 100, "plan", "v", "m-1", "global", "plan", True, "USD", 0, 1, 1, 1, 1),
    ]
    book = [b for b in book if not (b[3] == "older" and reason == "no_price_row")]
    r = pricing.choose(spark.createDataFrame([call], CALL), spark.createDataFrame(book, BOOK), {"p": ("eu", "api")}).select("reason", "tariff.price_id").first()
    assert (r.price_id, r.reason) == (price, reason)


def test_community_catalogue(spark):
    text = '{"acme": {"models": {"x": {"cost": {"input": 1.5, "output": 0, "tiers": [{"size": 200, "input": 3}, {"size": 200, "input": 9}]}}}}, "acme-cn": {"models": {"y": {"cost": {"input": 2}}}}, "odd": {"models": {"z": {"cost": {"input": 1}}}}}'
    rows = prices.community_prices(spark.createDataFrame([(text,)], "json string"), {"acme": "acme", "acme-cn": "acme"}).collect()
    assert sorted((r.model, r.region, r.threshold, r.input_rate, r.output_rate) for r in rows) == [("x", "global", 0, 15000, None), ("x", "global", 200, 30000, None), ("y", "cn", 0, 20000, None)]


def test_costs_of_touched_days_are_rebuilt(spark):
    from meterframe.operators import exchange

    shape = "source_instance_id string, source_record_key string, local_day date, content string, source_revision long, lifecycle_rank int, conflict boolean"
    day = lambda d: dt.date(2024, 1, d)
    target = spark.createDataFrame([("i", "same", day(1), "a", 1, 0, True), ("i", "moves", day(2), "a", 1, 0, True), ("i", "clash", day(3), "a", 1, 0, False), ("j", "kept", day(4), "a", 1, 0, False)], shape)
    package = spark.createDataFrame([("i", "same", day(1), "a", 1, 0, False, "p"), ("i", "moves", day(5), "b", 2, 0, False, "p"), ("i", "clash", day(3), "b", 1, 0, False, "p"), ("j", "new", day(6), "c", 1, 0, True, "p")], shape + ", package string")
    keys = ["source_instance_id", "source_record_key"]
    merged = exchange.import_details(target, package, target.limit(0), keys, F.lit(True))
    assert {r.source_record_key: (r.outcome, r.conflict) for r in merged.collect()} == {"same": ("unchanged", True), "moves": ("updated", False), "clash": ("conflict", True), "kept": ("kept", False), "new": ("added", True)}
    stored = spark.createDataFrame([("i", day(d), 1) for d in range(1, 7)] + [("j", day(6), 1)], "source_instance_id string, local_day date, amount int")
    rows = exchange.rebuilt_costs(stored, merged, target, keys, lambda days: days.withColumn("amount", F.lit(2))).collect()
    assert {(r.source_instance_id, r.local_day.day): r.amount for r in rows} == {("i", 1): 1, ("i", 2): 2, ("i", 3): 1, ("i", 4): 1, ("i", 5): 2, ("i", 6): 1, ("j", 6): 2}
    assert all(r.rebuilt == (r.amount == 2) for r in rows)
