"""Cost queries: tariff choice, exact amounts, daily costs and summaries, and the checks of price books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterframe.operators import archives, pricing
from meterframe.operators.intervals import WEEK_DAYS, days, within
from meterframe.operators.rollups import DIMENSIONS, eligible
from meterframe.plans.retention import FLOOR, PERIODS, TODAY
from meterframe.plans.summaries import DIMS, MEASURES, read_daily
from meterframe.registry import query
from meterframe.sources.prices import PRICES, faults, overlaps, price_rows
from meterframe.sources.usage import EVENTS, event_names, usage_events

CONFIGURED = {"china": ("global", "api"), "france": ("eu", "api"), "germany": ("cn", "plan")}
TTL = {"china": 5, "france": 60}
_KEY = r"regexp_replace(regexp_replace(lower({0}), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g')"
_FIRST = "list_filter({0}, lambda r: {1})"
_CONF = " OR ".join(f"(provider_ = '{p}' AND lower(r.region) = '{a}' AND lower(r.channel) = '{b}')" for p, (a, b) in CONFIGURED.items())
_SAME = lambda rows, *names: f"list_filter({rows}, lambda r: {' AND '.join(f'lower(CAST(r.{n} AS VARCHAR)) = lower(CAST({rows}[1].{n} AS VARCHAR))' for n in names)})"
CHOSEN = f"""{EVENTS}, {PRICES}, book AS (SELECT {_KEY.format('model')} AS model_key, list(struct_pack(priority := priority, later := -from_ms, price_id := price_id, to_ms := to_ms, provider := provider, model := model,
   region := region, channel := channel, official := official, currency := currency, threshold := threshold, input_rate := input_rate, read_rate := read_rate, write_rate := write_rate, output_rate := output_rate, from_ms := from_ms)
   ORDER BY priority, -from_ms, price_id) AS tariffs FROM prices GROUP BY 1),
 e0 AS MATERIALIZED (SELECT *, {_KEY.format('model_raw')} AS mk, coalesce(lower(trim(provider_id)), '') AS provider_ FROM events_ WHERE attribution_status = 'verified' AND record_kind <> 'transport_attempt'),
 e1 AS MATERIALIZED (SELECT e0.*, list_filter(coalesce(tariffs, []), lambda r: r.from_ms <= occurred_at_ms AND (r.to_ms IS NULL OR occurred_at_ms < r.to_ms)) AS valid FROM e0 LEFT JOIN book ON mk = model_key),
 e2 AS MATERIALIZED (SELECT *, list_filter(valid, lambda r: lower(r.provider) = provider_ AND ({_CONF})) AS direct, list_filter(valid, lambda r: r.official) AS official FROM e1),
 e3 AS MATERIALIZED (SELECT *, list_filter(official, lambda r: {_CONF}) AS preferred, list_filter(official, lambda r: lower(r.region) = 'global') AS worldwide FROM e2),
 e4 AS MATERIALIZED (SELECT *, CASE WHEN len(preferred) > 0 THEN preferred WHEN len(worldwide) > 0 THEN worldwide ELSE official END AS picked FROM e3),
 e5 AS MATERIALIZED (SELECT *, {_SAME('picked', 'priority')} AS f0 FROM e4),
 e6 AS MATERIALIZED (SELECT *, CASE WHEN len(preferred) = 0 AND len(worldwide) > 0 AND len(list_filter(f0, lambda r: lower(r.channel) = 'api')) > 0 THEN list_filter(f0, lambda r: lower(r.channel) = 'api') ELSE f0 END AS fallback FROM e5),
 e7 AS MATERIALIZED (SELECT *, len(direct) = 0 AND len(fallback) <> len({_SAME('fallback', 'currency', 'region', 'channel')}) AS mixed, CASE WHEN len(direct) > 0 THEN direct ELSE {_SAME('fallback', 'provider', 'region', 'channel', 'currency')} END AS rows_ FROM e6),
 e8 AS MATERIALIZED (SELECT *, CASE WHEN len(list_filter(rows_, lambda r: lower(r.model) = lower(trim(model_raw)))) > 0 THEN list_filter(rows_, lambda r: lower(r.model) = lower(trim(model_raw)))
   WHEN len(list_filter(rows_, lambda r: lower(r.model) = mk)) > 0 THEN list_filter(rows_, lambda r: lower(r.model) = mk) ELSE rows_ END AS spelled FROM e7),
 e9 AS MATERIALIZED (SELECT *, {_SAME('spelled', 'priority')} AS tiers, len(spelled) <> len({_SAME('spelled', 'model')}) AS ambiguous, coalesce(input_total, input_uncached + input_cache_read + input_cache_write) AS size FROM e8),
 e10 AS MATERIALIZED (SELECT *, CASE WHEN size IS NULL THEN tiers ELSE list_filter(tiers, lambda r: r.threshold <= size) END AS reached FROM e9),
 e11 AS MATERIALIZED (SELECT *, list_filter(reached, lambda r: r.threshold = list_max(list_transform(reached, lambda x: x.threshold)))[1] AS tariff_, CASE WHEN coalesce(mk, '') = '' THEN 'no_model' WHEN coalesce(input_uncached, input_cache_read, input_cache_write, input_total, output_total) IS NULL THEN 'no_known_usage'
   WHEN coalesce(input_cache_read + input_cache_write > input_total, false) THEN 'token_anomaly' WHEN mixed THEN 'channel_unknown' WHEN len(rows_) = 0 THEN CASE WHEN provider_ = '' THEN 'no_provider' WHEN provider_ NOT IN ('china', 'france', 'germany') THEN 'channel_unknown' ELSE 'no_price_row' END
   WHEN ambiguous THEN 'model_ambiguous' WHEN size IS NULL AND len(list_filter(tiers, lambda r: r.threshold <> 0)) > 0 THEN 'tier_ambiguous' END AS why FROM e10),
 chosen AS MATERIALIZED (SELECT *, CASE WHEN why IS NULL AND tariff_ IS NULL THEN 'no_price_row' ELSE why END AS reason, CASE WHEN why IS NULL THEN tariff_ END AS tariff, why IS NULL AND tariff_ IS NOT NULL AND len(direct) = 0 AS official_fallback FROM e11)"""
_EXACT = {
    "input": "CAST(coalesce(input_uncached, input_total - input_cache_read - input_cache_write) AS HUGEINT) * tariff.input_rate",
    "read": "CAST(input_cache_read AS HUGEINT) * tariff.read_rate",
    "write": "CAST(input_cache_write AS HUGEINT) * CASE WHEN tariff IS NULL THEN NULL WHEN input_cache_write = 0 THEN 0 WHEN provider_ IN ('china', 'france') THEN tariff.write_rate END",
    "output": "CAST(output_total AS HUGEINT) * tariff.output_rate",
}
EXACT = "exact AS MATERIALIZED (SELECT *, " + ", ".join(f"{e} AS {n}_exact" for n, e in _EXACT.items()) + " FROM chosen)"
_ROUND = "CAST(({0} + 50000000) // 100000000 AS BIGINT)"
_IDS = "source_instance_id, source_record_key, part_key, supplier_key"


def priced(spark: SparkSession, sf_dir: str, first: str | None = None) -> DataFrame:
    """``first`` as in ``raw_events``."""
    events = eligible(usage_events(spark, sf_dir, first)).where("record_kind <> 'transport_attempt'")
    return pricing.amounts(pricing.choose(events, price_rows(spark, sf_dir), CONFIGURED, names=event_names(spark, sf_dir)), TTL)


@query(f"WITH {CHOSEN} SELECT {_IDS}, reason, tariff.price_id AS price_id, official_fallback FROM chosen")
def j1_j2_j4_w10_w12_tariff_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(spark, sf_dir).select(*_IDS.split(", "), "reason", F.col("tariff.price_id").alias("price_id"), "official_fallback")


@query(f"WITH {CHOSEN}, {EXACT} SELECT {_IDS}, " + ", ".join(f"{_ROUND.format(n + '_exact')} AS {n}_amount" for n in pricing.SLOTS) + " FROM exact WHERE tariff IS NOT NULL")
def f17_event_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(spark, sf_dir).where("tariff is not null").select(*_IDS.split(", "), *[f"{n}_amount" for n in pricing.SLOTS])


_COSTS = f"costs AS (SELECT local_day, source_instance_id, coalesce(tariff.currency, '') AS currency, count(*) AS events, count(*) FILTER (official_fallback) AS fallbacks, {', '.join(f'sum({n}_exact) AS {n}_exact' for n in pricing.SLOTS)} FROM exact GROUP BY ALL)"


@query(f"WITH {CHOSEN}, {EXACT}, {_COSTS} SELECT local_day, source_instance_id, currency, events, fallbacks, " + ", ".join(f"{_ROUND.format(n + '_exact')} AS {n}_amount" for n in pricing.SLOTS) + " FROM costs")
def a16_a17_daily_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.cost_rows(priced(spark, sf_dir), "local_day", "source_instance_id")


@query(f"WITH {CHOSEN}, {EXACT} SELECT lower(agent) AS agent, coalesce(tariff.currency, '') AS currency, reason, count(*) AS events, count(DISTINCT tariff.price_id) AS bases, {_ROUND.format('sum(coalesce(input_exact, 0) + coalesce(output_exact, 0))')} AS amount FROM exact GROUP BY ALL")
def a18_cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum(F.coalesce("input_exact", F.lit(0)) + F.coalesce("output_exact", F.lit(0))).cast("decimal(38,0)")
    return priced(spark, sf_dir).groupBy(F.lower("agent").alias("agent"), F.coalesce("tariff.currency", F.lit("")).alias("currency"), "reason").agg(F.count("*").alias("events"), F.count_distinct("tariff.price_id").alias("bases"), pricing.rounded(total).alias("amount"))


_TOTAL = " + ".join(f"coalesce({n}_exact, 0)" for n in pricing.SLOTS)


@query(
    f"""WITH {CHOSEN}, {EXACT}, m AS (SELECT local_day, coalesce(lower(model_raw), '') AS model, reason, part_key, 'estimate' AS mode, coalesce(tariff.currency, '') AS currency, {_TOTAL} AS exact, tariff.price_id AS basis FROM exact
      UNION ALL SELECT local_day, coalesce(lower(model_raw), ''), reason, part_key, CASE WHEN part_key % 8 = 0 THEN 'source_reported' ELSE 'source_estimated' END, 'USD', CAST(floor(part_key % 50 * 1000.0 + 0.5) AS HUGEINT) * 10000, NULL FROM exact WHERE part_key % 4 = 0)
    SELECT mode, currency, CASE WHEN grouping(reason) = 0 THEN 'reason' WHEN grouping(model) = 0 THEN 'model' WHEN grouping(local_day) = 0 THEN 'day' ELSE 'total' END AS axis, reason, model, local_day, count(*) AS events, count(DISTINCT basis) AS bases, max(part_key) AS revision,
      {_ROUND.format('sum(exact)')} AS amount FROM m GROUP BY GROUPING SETS ((mode, currency), (mode, currency, reason), (mode, currency, model), (mode, currency, local_day))"""
)
def a16_a18_cost_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates beside the costs that sources name: a quarter of the events has one, half of these billed."""
    from meterframe.operators.buckets import cost_kind

    micro, kind = cost_kind(F.when(F.col("part_key") % 4 == 0, (F.col("part_key") % 50) / F.lit(1000.0)), F.col("part_key") % 8 == 0)
    rows = priced(spark, sf_dir).withColumn("model", F.coalesce(F.lower("model_raw"), F.lit("")))
    return pricing.cost_summary(pricing.cost_modes(rows, micro, kind), "part_key").select("mode", "currency", "axis", "reason", "model", "local_day", "events", "bases", "revision", "amount")


def _edge(slot: str, pick: str) -> str:
    rates = f"list_transform(tiers, lambda r: r.{slot}_rate)"
    rate = f"CASE WHEN aggregate THEN CASE WHEN len(list_filter(tiers, lambda r: r.{slot}_rate IS NULL)) = 0 THEN list_{pick}({rates}) END ELSE tariff.{slot}_rate END"
    return f"CASE WHEN input_cache_write = 0 THEN 0 WHEN provider_ IN ('china', 'france') THEN {rate} END" if slot == "write" else rate


_SLOT_TOKENS = {"input": "coalesce(input_uncached, input_total - input_cache_read - input_cache_write)", "read": "input_cache_read", "write": "input_cache_write", "output": "output_total"}
_EDGES = ", ".join(f"CASE WHEN priced THEN {' + '.join(f'coalesce(CAST({t} AS HUGEINT) * {_edge(n, pick)}, 0)' for n, t in _SLOT_TOKENS.items())} END AS {name}" for name, pick in (("low", "min"), ("high", "max")))
_BOTH = "model_raw, provider_id, occurred_at_ms, input_uncached, input_cache_read, input_cache_write, input_total, output_total"


@query(
    f"""WITH {EVENTS}, roll AS (SELECT local_day, {DIMS}, {MEASURES} FROM events_ WHERE attribution_status = 'verified' GROUP BY ALL), {PERIODS}, archived AS (SELECT * FROM periods WHERE grain = 'month' AND first_day < DATE '1997-01-01'),
    both_ AS MATERIALIZED (SELECT 'verified' AS attribution_status, record_kind, {_BOTH}, false AS aggregate, 1 AS calls FROM events_ e WHERE attribution_status = 'verified' AND record_kind <> 'transport_attempt' AND NOT EXISTS (SELECT 1 FROM archived a
        WHERE a.source_instance_id = e.source_instance_id AND a.agent = e.agent AND a.provider = coalesce(e.provider_id, '') AND a.model = coalesce(e.model_raw, '') AND a.call_category = e.call_category AND a.quality_bucket = e.quality_bucket AND local_day >= first_day AND local_day < end_day)
      UNION ALL SELECT 'verified', 'model_call', nullif(model, ''), nullif(provider, ''), epoch_ms(CAST(first_day AS TIMESTAMP)), uncached_sum, read_sum, write_sum, input_sum, output_sum, true, events - attempts FROM archived),
    {CHOSEN.replace(EVENTS + ", ", "").replace("FROM events_ WHERE", "FROM both_ WHERE")},
    b AS (SELECT *, CASE WHEN aggregate THEN len(tiers) > 0 AND coalesce(reason IN ('tier_ambiguous', 'no_price_row'), true) AND len(list_filter(tiers, lambda r: r.threshold = 0)) > 0 ELSE tariff IS NOT NULL END AS priced FROM chosen),
    c AS (SELECT coalesce(lower(model_raw), '') AS model, aggregate, priced, calls, {_EDGES} FROM b)
    SELECT model, aggregate, CAST(coalesce(sum(calls) FILTER (priced), 0) AS BIGINT) AS priced, CAST(coalesce(sum(calls) FILTER (NOT priced), 0) AS BIGINT) AS unpriced, {_ROUND.format('sum(low)')} AS low_amount, {_ROUND.format('sum(high)')} AS high_amount FROM c GROUP BY model, aggregate"""
)
def a20_cost_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months before 1997 are archived: their rows stand for the calls of their dimensions, whose sizes are lost."""
    until = "1996-12-31"  # the last day of the archived months
    archive = archives.materialise_periods(read_daily(spark, sf_dir, FLOOR, until), TODAY, FLOOR).where("grain = 'month' AND first_day < DATE'1997-01-01'")
    names = {"provider": F.coalesce("provider_id", F.lit("")), "model": F.coalesce("model_raw", F.lit(""))}
    events = eligible(usage_events(spark, sf_dir)).where("record_kind <> 'transport_attempt'").withColumns(names)
    spans = archive.select(*DIMENSIONS, "first_day", "end_day")
    near = F.coalesce(F.col("local_day").between(FLOOR, until), F.lit(False))
    # days that no archived month can hold are not moved to meet one
    detail = within(events.where(near), spans, list(DIMENSIONS), days("local_day"), days("first_day"), days("end_day"), WEEK_DAYS, "left_anti").unionByName(events.where(~near))
    shape = _BOTH.split(", ")
    sums = {"model_raw": F.nullif("model", F.lit("")), "provider_id": F.nullif("provider", F.lit("")), "occurred_at_ms": F.unix_date("first_day").cast("long") * 86_400_000}
    sums |= dict(zip(shape[3:], (F.col(f"{n}_sum") for n in ("uncached", "read", "write", "input", "output")), strict=True))
    rows = detail.select(*shape, F.lit(False).alias("aggregate"), F.lit(1).cast("long").alias("calls"))
    rows = rows.unionByName(archive.select(*[c.alias(n) for n, c in sums.items()], F.lit(True).alias("aggregate"), (F.col("events") - F.col("attempts")).alias("calls")))
    found = pricing.simulated(pricing.choose(rows, price_rows(spark, sf_dir), CONFIGURED, names=event_names(spark, sf_dir)), TTL, "aggregate")
    return pricing.bounds(found.withColumn("model", F.coalesce(F.lower("model_raw"), F.lit(""))), "model", "aggregate")


@query(
    f"""WITH {PRICES} SELECT price_id FROM (SELECT *, max(coalesce(to_ms, 4611686018427387904)) OVER (PARTITION BY provider, model, region, channel, threshold ORDER BY from_ms, price_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM prices) WHERE from_ms < reach"""
)
def w9_interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(price_rows(spark, sf_dir), ("provider", "model", "region", "channel", "threshold")).select("price_id")


_BAD = {"input_rate": "CASE WHEN threshold = 2500 AND region = 'eu' THEN -1 ELSE input_rate END", "currency": "CASE WHEN region = 'cn' AND threshold = 5000 THEN 'XXX' ELSE currency END"}


@query(
    f"""WITH {PRICES}, bad AS (SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in _BAD.items())}) FROM prices)
    SELECT price_id, CASE WHEN input_rate < 0 THEN 'negative_rate' ELSE 'unknown_currency' END AS fault FROM bad WHERE input_rate < 0 OR currency NOT IN ('USD', 'CNY', 'EUR')"""
)
def s6_price_book_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults(price_rows(spark, sf_dir).withColumns({c: F.expr(e) for c, e in _BAD.items()}))


@query(
    f"""WITH {CHOSEN}, {EXACT}, days AS (SELECT local_day, {_ROUND.format('sum(coalesce(output_exact, 0))')} AS amount FROM exact WHERE tariff.currency = 'USD' GROUP BY 1),
    periods AS (SELECT CAST(d AS DATE) AS first_day, CAST(d + INTERVAL 3 MONTH AS DATE) AS end_day FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-10-01', INTERVAL 3 MONTH)) AS d))
    SELECT first_day, count(*) AS days, CAST(sum(amount) AS BIGINT) AS amount FROM periods JOIN days ON local_day >= first_day AND local_day < end_day GROUP BY 1"""
)
def j13_costs_by_display_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = priced(spark, sf_dir).where("tariff.currency = 'USD'").groupBy("local_day").agg(pricing.rounded(F.sum(F.coalesce("output_exact", F.lit(0))).cast("decimal(38,0)")).alias("amount"))
    firsts = F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-10-01").cast("date"), F.expr("INTERVAL 3 MONTH"))
    periods = spark.range(1).select(F.explode(firsts).alias("first_day")).withColumn("end_day", F.add_months("first_day", 3))
    # joined with the days' sums: a filter on a day's period would be pushed to the events, each of which would search them all
    found = days.join(F.broadcast(periods), (F.col("local_day") >= F.col("first_day")) & (F.col("local_day") < F.col("end_day")))
    return found.groupBy("first_day").agg(F.count("*").alias("days"), F.sum("amount").alias("amount"))


@query(
    f"""WITH {CHOSEN}, {EXACT}, costs AS (SELECT lower(coalesce(provider_id, '')) AS provider, coalesce({_KEY.format('model_raw')}, '') AS model, {_ROUND.format('sum(coalesce(input_exact, 0))')} AS amount FROM exact WHERE tariff IS NOT NULL GROUP BY ALL),
    used AS (SELECT lower(coalesce(provider_id, '')) AS provider, coalesce({_KEY.format('model_raw')}, '') AS model, CAST(sum(known_total_tokens) AS BIGINT) AS tokens FROM events_ WHERE attribution_status = 'verified' GROUP BY ALL)
    SELECT provider, model, tokens, amount FROM used LEFT JOIN costs USING (provider, model)"""
)
def j14_costs_beside_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meterframe.functions.scalars import model_key

    keys = [F.lower(F.coalesce("provider_id", F.lit(""))).alias("provider"), F.coalesce(model_key(F.col("model_raw")), F.lit("")).alias("model")]
    costs = priced(spark, sf_dir).where("tariff is not null").groupBy(*keys).agg(pricing.rounded(F.sum(F.coalesce("input_exact", F.lit(0))).cast("decimal(38,0)")).alias("amount"))
    used = eligible(usage_events(spark, sf_dir)).groupBy(*keys).agg(F.sum("known_total_tokens").alias("tokens"))
    return used.join(costs, ["provider", "model"], "left")


@query(f"WITH {PRICES} SELECT priority, count(*) AS rows, count(DISTINCT model) AS models, min(from_ms) AS first_ms, bool_or(to_ms IS NULL) AS open_ended, row_number() OVER (ORDER BY priority) AS place FROM prices GROUP BY priority")
def o3_price_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = price_rows(spark, sf_dir).groupBy("priority").agg(F.count("*").alias("rows"), F.count_distinct("model").alias("models"), F.min("from_ms").alias("first_ms"), F.bool_or(F.col("to_ms").isNull()).alias("open_ended"))
    return found.withColumn("place", F.row_number().over(Window.orderBy("priority")))
