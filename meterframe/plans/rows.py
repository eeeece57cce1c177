"""Row-level queries: names, times, totals, qualities, filters and validation of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.functions import calendar as cal
from meterframe.functions import scalars as sc
from meterframe.operators import filters
from meterframe.registry import query
from meterframe.sources.usage import EVENTS, ZONE, table, usage_events

WITH = f"WITH {EVENTS} "
_KEY = r"regexp_replace(regexp_replace(lower({0}), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g')"
_AT = "CAST(make_timestamp(occurred_at_ms * 1000) AS TIMESTAMP)"
_TO = "(({0}) AT TIME ZONE 'UTC') AT TIME ZONE '" + ZONE + "'"
_FROM = "(({0}) AT TIME ZONE '" + ZONE + "') AT TIME ZONE 'UTC'"


def _models() -> str:
    """Serving names as users write them, made of the part table: families by brand, spelled in several ways."""
    return """CASE p_partkey % 12 WHEN 0 THEN 'openai/gpt-5.5-2026-04-23' WHEN 1 THEN concat('Claude Opus_', p_size, '.', p_partkey % 7) WHEN 2 THEN 'k3-256k' WHEN 3 THEN 'kimi-for-coding'
      WHEN 4 THEN concat('gemini_', p_size, '-preview') WHEN 5 THEN 'hy-4-preview' WHEN 6 THEN concat('github/o', p_size % 5) WHEN 7 THEN 'codex-auto-review' WHEN 8 THEN concat('alibaba/qwen', p_size)
      WHEN 9 THEN 'k28-agent-preview' WHEN 10 THEN concat(' glm  -', p_size, '__x ') ELSE concat(lower(p_brand), '/', p_type) END"""


_PROVIDER = "CASE p_partkey % 5 WHEN 0 THEN 'OpenAI ' WHEN 1 THEN 'github-copilot' WHEN 2 THEN NULL ELSE lower(p_brand) END"
_SINCE = "1789084800000 + (p_partkey % 3 - 1) * 1000"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_models()).alias("model"), F.expr(_PROVIDER).alias("provider"), F.expr(_SINCE).cast("long").alias("at_ms"))


_NAMED = f"named AS (SELECT p_partkey, {_models()} AS model, {_PROVIDER} AS provider, CAST({_SINCE} AS BIGINT) AS at_ms FROM part)"
_MODEL_KEY = "CASE WHEN starts_with(k, 'claude-') THEN replace(k, '.', '-') ELSE k END"
_REFERENCE = f"""keyed AS (SELECT *, {_KEY.format('model')} AS k, {_KEY.format('provider')} AS pk FROM named),
 clean AS (SELECT *, {_MODEL_KEY} AS model_key FROM keyed),
 bare AS (SELECT *, CASE WHEN contains(model_key, '/') AND (coalesce(pk = split_part(model_key, '/', 1), false) OR coalesce(lower(trim(provider)) = 'github-copilot', false))
   THEN substr(model_key, strpos(model_key, '/') + 1) ELSE model_key END AS own FROM clean),
 named_ AS (SELECT *, {_KEY.format("regexp_replace(own, '^(" + "|".join(sc.NAMESPACES) + ")', '')")} AS leaf FROM bare),
 referred AS (SELECT *, CASE {' '.join(f"WHEN leaf = '{a}' THEN '{b}'" for a, b in sc.ALIASES.items())}
   WHEN leaf = 'kimi-for-coding' AND at_ms >= 1789084800000 THEN 'kimi-k2.8-preview' ELSE leaf END AS reference FROM named_)"""


@query(f"WITH {_NAMED}, {_REFERENCE} SELECT p_partkey, model_key, reference FROM referred")
def f1_f3_model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = sc.reference_model(F.col("model"), F.col("provider"), F.col("at_ms"))
    return _named(spark, sf_dir).select("p_partkey", sc.model_key(F.col("model")).alias("model_key"), reference.alias("reference"))


@query(
    f"""WITH {_NAMED}, {_REFERENCE} SELECT p_partkey, CASE WHEN regexp_matches(reference, '^gpt-|^o[134](-|$)') THEN 'openai' WHEN starts_with(reference, 'claude-') THEN 'anthropic'
    WHEN starts_with(reference, 'gemini-') THEN 'google' WHEN regexp_matches(reference, '^(kimi|moonshot)-|^k3(-256k)?$') THEN 'moonshot,moonshotai,moonshotai-cn' WHEN starts_with(reference, 'glm-') THEN 'zai,zhipuai'
    WHEN starts_with(reference, 'deepseek-') THEN 'deepseek' WHEN starts_with(reference, 'hy4-') THEN 'tencent,tencent-cloud' WHEN starts_with(reference, 'qwen') THEN 'alibaba,alibaba-cn' ELSE '' END AS vendors,
    concat_ws(',', CASE WHEN ends_with(reference, '-preview') THEN left(reference, length(reference) - 8) END, CASE WHEN reference = 'kimi-k2.8-preview' THEN 'kimi-k2.7-code' END,
      CASE WHEN reference = 'codex-auto-review' AND lower(trim(provider)) = 'openai' THEN 'gpt-5.6-luna' END) AS substitutes FROM referred"""
)
def f4_f5_vendors_and_substitutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    referred = _named(spark, sf_dir).withColumn("reference", sc.reference_model(F.col("model"), F.col("provider"), F.col("at_ms")))
    substitutes = sc.price_substitutes(F.col("reference"), F.col("provider"))
    return referred.select("p_partkey", F.array_join(sc.official_providers(F.col("reference")), ",").alias("vendors"), F.array_join(substitutes, ",").alias("substitutes"))


@query(WITH + "SELECT lower(agent) AS agent_key, count(*) AS n, count(DISTINCT concat(source_instance_id, '#', replace(replace(source_record_key, '%', '%25'), '#', '%23'))) AS identities FROM events_ GROUP BY 1")
def f2_f6_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    identity = sc.event_id(F.col("source_instance_id"), F.col("source_record_key"))
    return usage_events(spark, sf_dir).groupBy(sc.fold_name(F.col("agent")).alias("agent_key")).agg(F.count("*").alias("n"), F.count_distinct(identity).alias("identities"))


_CONTENT = ("record_kind", "lifecycle", "input_total", "output_total", "session_id", "duration_ms")


@query(
    WITH
    + f"""SELECT source_instance_id, source_record_key, count(*) AS versions, count(DISTINCT md5(concat_ws('|', {', '.join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in _CONTENT)}))) AS contents
    FROM events_ GROUP BY 1, 2 HAVING count(*) > 1"""
)
def f7_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = usage_events(spark, sf_dir).select("source_instance_id", "source_record_key", sc.content_hash(list(_CONTENT)).alias("hash"))
    return hashed.groupBy("source_instance_id", "source_record_key").agg(F.count("*").alias("versions"), F.count_distinct("hash").alias("contents")).where("versions > 1")


@query(
    f"""SELECT local_day, local_hour, weekday, offset_s, count(*) AS n FROM (SELECT CAST({_TO.format(_AT)} AS DATE) AS local_day, CAST(hour({_TO.format(_AT)}) AS INTEGER) AS local_hour,
    CAST(isodow({_TO.format(_AT)}) AS INTEGER) AS weekday, CAST(epoch_ms({_TO.format(_AT)}) / 1000 - occurred_at_ms / 1000 AS BIGINT) AS offset_s FROM (WITH {EVENTS} SELECT * FROM events_)) GROUP BY ALL"""
)
def f8_local_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("occurred_at_ms")
    named = usage_events(spark, sf_dir).select(cal.local_day(at, ZONE).alias("local_day"), cal.local_hour(at, ZONE).alias("local_hour"), cal.local_weekday(at, ZONE).alias("weekday"), cal.offset_seconds(at, ZONE).alias("offset_s"))
    return named.groupBy("local_day", "local_hour", "weekday", "offset_s").agg(F.count("*").alias("n"))


_DAYS = "days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)"
_START = "epoch_ms(" + _FROM.format("CAST({0} AS TIMESTAMP)") + ")"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()


@query(
    f"""WITH {_DAYS} SELECT day, {_START.format('day')} AS day_start, {_START.format("day + INTERVAL 1 DAY")} AS day_end, ({_START.format("day + INTERVAL 1 DAY")} - {_START.format('day')}) // 3600000 AS hours,
    {_START.format("date_trunc('month', day)")} AS month_start, {_START.format("date_trunc('month', day) + INTERVAL 1 MONTH")} AS month_end FROM days"""
)
def f9_day_and_month_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("day")
    start, end = cal.day_start_ms(day, ZONE), cal.day_end_ms(day, ZONE)
    hours = ((end - start) / 3_600_000).cast("long")
    return _days(spark, sf_dir).select("day", start.alias("day_start"), end.alias("day_end"), hours.alias("hours"), cal.month_start_ms(day, ZONE).alias("month_start"), cal.month_end_ms(day, ZONE).alias("month_end"))


@query(
    f"""WITH {_DAYS} SELECT day, CAST(day - CAST(isodow(day) - 1 AS INTEGER) AS DATE) AS monday, CAST(day - CAST(dayofweek(day) AS INTEGER) AS DATE) AS sunday,
    concat(isoyear(day), '-W', lpad(CAST(week(day) AS VARCHAR), 2, '0')) AS iso_week, strftime(day - CAST(dayofweek(day) AS INTEGER), '%Y-%m-%d') AS sunday_week,
    strftime(day, '%Y-%m') AS month, concat(strftime(day, '%Y-%m-%d'), ' 07:00') AS hour, CAST(day - 29 AS DATE) AS cutoff FROM days"""
)
def f10_f12_period_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("day")
    return _days(spark, sf_dir).select(
        "day", cal.week_start(day).alias("monday"), cal.week_start(day, sunday=True).alias("sunday"), cal.week_label(day).alias("iso_week"), cal.week_label(day, sunday=True).alias("sunday_week"),
        cal.month_label(day).alias("month"), cal.hour_label(day, F.lit(7)).alias("hour"), cal.retention_cutoff(day, 30).alias("cutoff"),
    )


@query(WITH + "SELECT order_key, part_key, supplier_key, line_number, input_uncached + input_cache_read + input_cache_write AS parts, input_total, q_input_total, total_tokens, q_total_tokens FROM events_")
def f13_f14_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = usage_events(spark, sf_dir).withColumns({"input_total": F.col("reported_input"), "q_input_total": F.when(F.col("reported_input").isNull(), "unknown").otherwise("reported"), "total_tokens": F.lit(None).cast("long"), "q_total_tokens": F.lit("unknown")})
    (value, kind), (total, total_kind) = sc.input_total(), sc.total_tokens()
    parts = sc.checked_sum(F.col("input_uncached"), F.col("input_cache_read"), F.col("input_cache_write"))
    return events.select("order_key", "part_key", "supplier_key", "line_number", parts.alias("parts"), value.alias("input_total"), kind.alias("q_input_total"), total.alias("total_tokens"), total_kind.alias("q_total_tokens"))


_ODD = {"input_total": "CASE WHEN part_key % 8 = 0 THEN input_cache_read - 1 ELSE input_total END", "output_reasoning": "CASE WHEN part_key % 10 = 1 THEN output_total + 1 ELSE output_reasoning END"}


_READ, _WRITE, _SUM = "input_cache_read", "input_cache_write", "coalesce(normal, total_tokens)"
_CHECKS = (
    ("cache_read_exceeds_input_total", "input_cache_read", f"{_READ} > input_total", f"concat('cache_read ', {_READ}, ' > input_total ', input_total)"),
    ("cache_write_exceeds_input_total", "input_cache_write", f"{_WRITE} > input_total", f"concat('cache_write ', {_WRITE}, ' > input_total ', input_total)"),
    ("cache_sum_exceeds_input_total", "input_total", f"{_READ} + {_WRITE} > input_total", f"concat('cache_read ', {_READ}, ' + cache_write ', {_WRITE}, ' > input_total ', input_total)"),
    ("reasoning_exceeds_output_total", "output_reasoning", "output_reasoning > output_total", "concat('reasoning ', output_reasoning, ' > output_total ', output_total)"),
    ("uncached_exceeds_input_total", "input_uncached", "input_uncached > input_total", "concat('uncached ', input_uncached, ' > input_total ', input_total)"),
    ("source_total_mismatch", "source_total", f"source_total <> {_SUM}", f"concat('source_total ', source_total, ' != normalized total ', {_SUM})"),
)


@query(
    f"""WITH {EVENTS}, odd AS (SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in _ODD.items())}), CASE WHEN part_key % 9 = 2 THEN total_tokens + 5 ELSE NULL END AS source_total FROM events_),
    tests AS (SELECT *, coalesce(input_uncached + input_cache_read + input_cache_write, input_total) + output_total AS normal FROM odd),
    codes AS (SELECT unnest([{', '.join(f"CASE WHEN {test} THEN struct_pack(code := '{code}', field := '{name}', detail := {detail}) END" for code, name, test, detail in _CHECKS)}]) AS c, agent FROM tests)
    SELECT agent, c.code AS code, c.field AS field, count(*) AS n, max(c.detail) AS detail FROM codes WHERE c IS NOT NULL GROUP BY ALL"""
)
def f15_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = usage_events(spark, sf_dir).withColumns({c: F.expr(e) for c, e in _ODD.items()} | {"source_total": F.expr("CASE WHEN part_key % 9 = 2 THEN total_tokens + 5 END")})
    return odd.select("agent", F.explode(sc.contradictions()).alias("c")).groupBy("agent", "c.code", "c.field").agg(F.count("*").alias("n"), F.max("c.detail").alias("detail"))


@query(WITH + "SELECT quality_bucket, record_kind, count(*) AS n FROM events_ GROUP BY ALL")
def f16_quality_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_events(spark, sf_dir).groupBy(filters.quality_bucket().alias("quality_bucket"), "record_kind").agg(F.count("*").alias("n"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST((CAST(floor(l_extendedprice) AS HUGEINT) * CAST(round(l_tax * 1000000) AS HUGEINT) + 50000000) // 100000000 AS BIGINT) AS amount,
    CASE WHEN l_discount > 0 THEN CAST(floor(l_discount * 10000 + 0.5) AS BIGINT) END AS hundredths FROM lineitem"""
)
def f17_f18_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = sc.component_amount(F.floor("l_extendedprice").cast("long"), F.round(F.col("l_tax") * 1_000_000).cast("long"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", amount.alias("amount"), sc.usd_to_hundredths(F.col("l_discount")).alias("hundredths"))


@query(
    WITH
    + """SELECT agent, coalesce(total, greatest(input, output)) AS shown, total IS NULL AS is_bound, CASE WHEN calls <= 0 THEN 0 ELSE greatest(1, least(4, CAST(ceil(calls * 4 / max(calls) OVER ()) AS INTEGER))) END AS level,
    CASE WHEN read + fresh = 0 THEN 0.0 ELSE round(100.0 * read / (read + fresh), 2) END AS hit_rate, CASE WHEN samples = n - attempts THEN CAST(known AS DOUBLE) / n END AS known_ratio
    FROM (SELECT agent, CASE WHEN count(known_total_tokens) = count(*) THEN CAST(sum(known_total_tokens) AS BIGINT) END AS total, CAST(sum(known_input_total) AS BIGINT) AS input, CAST(sum(known_output_total) AS BIGINT) AS output,
      count(*) FILTER (record_kind = 'model_call') AS calls, CAST(coalesce(sum(known_input_cache_read), 0) AS BIGINT) AS read, CAST(coalesce(sum(known_input_uncached), 0) AS BIGINT) AS fresh,
      count(*) AS n, count(*) FILTER (record_kind = 'transport_attempt') AS attempts, count(*) FILTER (record_kind <> 'transport_attempt') AS samples, count(known_total_tokens) AS known FROM events_ GROUP BY agent)"""
)
def f19_f22_display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    known = lambda n: F.sum(f"known_{n}")
    by_agent = usage_events(spark, sf_dir).groupBy("agent").agg(
        F.when(F.count("known_total_tokens") == F.count("*"), known("total_tokens")).alias("total"), known("input_total").alias("input"), known("output_total").alias("output"),
        F.count_if(F.col("record_kind") == "model_call").alias("calls"), F.coalesce(known("input_cache_read"), F.lit(0)).alias("read"), F.coalesce(known("input_uncached"), F.lit(0)).alias("fresh"),
        F.count("*").alias("n"), F.count_if(F.col("record_kind") == "transport_attempt").alias("attempts"), F.count_if(F.col("record_kind") != "transport_attempt").alias("samples"), F.count("known_total_tokens").alias("known"),
    )
    shown, bound = sc.display_bound(F.col("total"), F.col("input"), F.col("output"))
    most = F.max("calls").over(Window.partitionBy())
    ratio = F.when(F.col("samples") == F.col("n") - F.col("attempts"), F.col("known") / F.col("n"))
    return by_agent.select("agent", shown.alias("shown"), bound.alias("is_bound"), sc.heat_level(F.col("calls"), most).alias("level"), sc.hit_rate(F.col("read"), F.col("fresh")).alias("hit_rate"), ratio.alias("known_ratio"))


@query(
    """WITH v AS (SELECT p_brand, concat(p_size % 4, '.', p_size, '.', p_partkey % 100, '-b') AS version, [p_size % 4, p_size, p_partkey % 100] AS parts FROM part)
    SELECT p_brand, max(parts)[1] AS major, max(parts)[2] AS minor, max(parts)[3] AS patch FROM v GROUP BY p_brand"""
)
def f23_version_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.expr("concat(p_size % 4, '.', p_size, '.', p_partkey % 100, '-b')")
    top = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max(sc.version_parts(version)).alias("top"))
    return top.select("p_brand", *[F.col("top")[i].cast("long").alias(n) for i, n in enumerate(("major", "minor", "patch"))])


_REQUEST = filters.Filters(agents=["BRAND#11", "brand#23", "Brand#32"], providers=["china", "unknown", "FRANCE"], models=["Promo_V1", "economy-v1", "unknown", "standard v1", "STANDARD"], instances=[f"inst-{i}" for i in range(12)])


@query(
    WITH
    + f"""SELECT source_instance_id, source_record_key, occurred_at_ms, agent, provider_id, model_raw FROM events_ WHERE lower(agent) IN ('brand#11', 'brand#23', 'brand#32')
    AND (lower(provider_id) IN ('china', 'france') OR coalesce(lower(provider_id), '') IN ('', 'unknown')) AND ({_KEY.format('model_raw')} IN ('promo-v1', 'economy-v1', 'standard-v1', 'standard') OR coalesce(lower(model_raw), '') IN ('', 'unknown'))
    AND source_instance_id IN ({', '.join(f"'inst-{i}'" for i in range(12))})"""
)
def p1_p3_dimension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_events(spark, sf_dir).where(_REQUEST.condition()).select("source_instance_id", "source_record_key", "occurred_at_ms", "agent", "provider_id", "model_raw")


@query(WITH + "SELECT strftime(local_day, '%Y-%m') AS period, count(*) AS n FROM events_ WHERE strftime(local_day, '%Y-%m') BETWEEN '1996-03' AND '1998-11' GROUP BY 1")
def p4_period_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = cal.month_label(F.col("local_day"))
    return usage_events(spark, sf_dir, "1996-03-01", "1998-11-30").where(filters.between_labels(label, "1996-03", "1998-11")).groupBy(label.alias("period")).agg(F.count("*").alias("n"))


@query(WITH + "SELECT record_kind, count(*) AS n, count(known_input_total) AS inputs, CAST(sum(known_total_tokens) AS BIGINT) AS tokens FROM events_ WHERE attribution_status = 'verified' GROUP BY 1")
def p5_p6_eligible_known_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meterframe.operators.rollups import eligible

    masked = eligible(usage_events(spark, sf_dir)).withColumns({f"m_{t}": filters.known_value(t) for t in ("input_total", "total_tokens")})
    return masked.groupBy("record_kind").agg(F.count("*").alias("n"), F.count("m_input_total").alias("inputs"), F.sum("m_total_tokens").alias("tokens"))


_BROKEN = {"output_total": "CASE WHEN part_key % 41 = 0 THEN -1 ELSE output_total END", "q_input_total": "CASE WHEN part_key % 37 = 0 THEN 'unknown' ELSE q_input_total END", "record_kind": "CASE WHEN part_key % 43 = 0 THEN 'quota' ELSE record_kind END", "occurred_at_ms": "CASE WHEN part_key % 47 = 0 THEN 900000000 ELSE occurred_at_ms END"}


@query(
    f"""WITH {EVENTS}, broken AS (SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in _BROKEN.items())}), occurred_at_ms AS started, occurred_at_ms + part_key % 53 - 1 AS ended FROM events_)
    SELECT CASE WHEN output_total < 0 THEN 'token_out_of_range' WHEN (q_input_total = 'unknown') <> (input_total IS NULL) OR (q_output_total = 'unknown') <> (output_total IS NULL) THEN 'quality_mismatch'
      WHEN record_kind NOT IN ('model_call', 'transport_attempt', 'usage_observation') THEN 'kind_not_allowed' WHEN least(occurred_at_ms, started, ended) < 946684800000 THEN 'implausible_time' WHEN ended < started THEN 'interval_reversed' ELSE 'ok' END AS verdict, count(*) AS n
    FROM broken GROUP BY 1"""
)
def p7_event_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event; most of these tables' times lie before the first plausible one, and are found to."""
    broken = usage_events(spark, sf_dir).withColumns({c: F.expr(e) for c, e in _BROKEN.items()} | {"interval_start_ms": F.col("occurred_at_ms"), "interval_end_ms": F.expr("occurred_at_ms + part_key % 53 - 1")})
    return broken.groupBy(F.coalesce(filters.event_fault(), F.lit("ok")).alias("verdict")).agg(F.count("*").alias("n"))


@query(WITH + "SELECT CASE WHEN occurred_at_ms >= 880000000000 THEN 'kept' ELSE 'before_retention' END AS outcome, count(*) AS n FROM events_ GROUP BY 1")
def p8_retention_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, dropped = filters.apply_floor(usage_events(spark, sf_dir), 870_000_000_000, 880_000_000_000)
    return kept.groupBy(F.lit("kept").alias("outcome")).agg(F.count("*").alias("n")).unionByName(dropped.groupBy(F.lit("before_retention").alias("outcome")).agg(F.count("*").alias("n")))


@query(WITH + "SELECT coalesce(exclusion_reason, 'unverified') AS reason, count(*) AS n FROM events_ WHERE attribution_status <> 'verified' AND occurred_at_ms >= 850000000000 GROUP BY 1")
def p9_excluded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.excluded(usage_events(spark, sf_dir).where("occurred_at_ms >= 850000000000")).groupBy("reason").agg(F.count("*").alias("n"))


@query(WITH + "SELECT local_day, bool_or(coalesce(exclusion_reason = 'source_authority', false)) AS gap FROM events_ GROUP BY 1")
def p10_coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap: Column = F.bool_or(F.coalesce(F.col("exclusion_reason").isin(*filters.AUTHORITY_REASONS), F.lit(False)))
    return usage_events(spark, sf_dir).groupBy("local_day").agg(gap.alias("gap"))
