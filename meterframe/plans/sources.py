"""Queries by source specification, SQL functions, substitute prices and cost budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.functions import calendar as cal
from meterframe.functions import sql
from meterframe.operators import pricing
from meterframe.operators.rollups import eligible
from meterframe.plans.costs import _IDS, _ROUND, CHOSEN, CONFIGURED, EXACT, priced
from meterframe.registry import query
from meterframe.sources.prices import price_rows
from meterframe.sources.specs import SPECS, read
from meterframe.sources.usage import event_names, table, usage_events

_NAMES = ("codex", "claude-code", "gemini", "qwen", "pi", "kimi-code", "otel")


def _texts(lines: DataFrame) -> DataFrame:
    """(file, line, source, value): each line item as a record of one of the sources; some are placeholders, lack a count or are broken."""
    i, r, w, o, g = F.floor("l_quantity"), F.floor(F.col("l_discount") * 100), F.floor(F.col("l_tax") * 100), F.floor(F.col("l_extendedprice") / 100), F.col("l_linenumber")
    whole = i + r + w
    lacking = F.col("l_partkey") % 29 == 0
    out = F.when(~lacking, o)
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    model = F.when(F.col("l_partkey") % 31 == 0, "<synthetic>").otherwise("a-model")
    at = F.lit("2024-01-01T00:00:00Z")

    def text(**parts: Column) -> Column:
        return F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()]))

    def usage(**parts: Column) -> Column:
        return F.struct(*[c.alias(n) for n, c in parts.items()])

    spans = F.create_map(F.lit("gen_ai.usage.input_tokens"), whole.cast("string"), F.lit("usage.output_tokens"), out.cast("string"), F.lit("usage.cache_read_input_tokens"), r.cast("string"), F.lit("gen_ai.usage.cache_creation.input_tokens"), w.cast("string"), F.lit("gen_ai.request.model"), model)
    values = [
        text(type=F.lit("token_usage_record"), timestamp=at, payload=usage(response_id=key, model=model, usage=usage(input_tokens=whole, cached_input_tokens=r, cache_write_input_tokens=w, output_tokens=out, reasoning_output_tokens=g))),
        text(type=F.lit("assistant"), timestamp=at, requestId=key, isSidechain=g == 3, message=usage(model=model, usage=usage(input_tokens=i, cache_read_input_tokens=r, cache_creation_input_tokens=w, output_tokens=out))),
        F.to_json(F.struct(F.array(F.struct(F.lit("gemini").alias("type"), F.when(r != 7, key).alias("id"), at.alias("timestamp"), model.alias("model"), usage(input=i, cached=r, output=out, thoughts=g).alias("tokens"))).alias("messages"), key.alias("sessionId"))),
        text(type=F.lit("assistant"), timestamp=at, uuid=F.when(r != 7, key), sessionId=key, model=model, agentId=F.when(g == 3, "x"), usageMetadata=usage(promptTokenCount=i, cachedContentTokenCount=r, candidatesTokenCount=out, thoughtsTokenCount=g)),
        text(type=F.lit("message"), timestamp=at, id=key, message=usage(model=model, usage=usage(input=i, cacheRead=r, cacheWrite=w, output=out, reasoning=g))),
        text(type=F.lit("usage.record"), time=F.lit(1_704_067_200_000) + F.col("l_orderkey"), model=model, usage=usage(inputOther=i, inputCacheRead=r, inputCacheCreation=w, output=out)),
        text(name=F.lit("chat"), spanId=key, startTime=at, attributes=spans),
    ]
    picked = F.lit(None).cast("string")
    for k, value in enumerate(values):
        picked = F.when(F.col("l_suppkey") % 7 == k, value).otherwise(picked)
    picked = F.when(F.col("l_orderkey") % 37 == 0, F.concat(F.lit("["), picked)).otherwise(picked)
    file = F.concat(F.lit("logs/"), F.when(g == 5, "subagents/").otherwise(""), F.lit("f.jsonl"))
    # behind a generator, so that no filter on the text writes it again
    return lines.select(file.alias("file"), (F.col("l_orderkey") * 8 + g).alias("line"), (F.col("l_suppkey") % 7).alias("source"), F.inline(F.array(F.struct(picked.alias("value")))))


@query(
    """WITH l AS (SELECT *, l_suppkey % 7 AS k, CAST(floor(l_quantity) AS BIGINT) AS i, CAST(floor(l_discount * 100) AS BIGINT) AS r, CAST(floor(l_tax * 100) AS BIGINT) AS w, CAST(floor(l_extendedprice / 100) AS BIGINT) AS o, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id FROM lineitem),
    n AS (SELECT *, ['codex', 'claude-code', 'gemini', 'qwen', 'pi', 'kimi-code', 'otel'][k + 1] AS agent, CASE WHEN l_orderkey % 37 = 0 THEN CASE k WHEN 2 THEN 'not_a_document' ELSE 'not_an_object' END WHEN l_partkey % 31 = 0 THEN 'placeholder' WHEN l_partkey % 29 = 0 THEN 'required_missing' END AS fault,
      CASE k WHEN 2 THEN CASE WHEN r = 7 THEN concat('gemini:', id, ':idx-0') ELSE concat('gemini:', id, ':', id) END WHEN 3 THEN CASE WHEN r = 7 THEN concat('seq:', id, ':', l_orderkey * 8 + l_linenumber) ELSE concat('qwen:', id) END WHEN 5 THEN NULL ELSE id END AS key,
      CASE WHEN l_linenumber = 5 OR l_linenumber = 3 AND k IN (1, 3) THEN 'sub_agent' ELSE 'main' END AS category FROM l)
    SELECT agent, fault, CASE WHEN fault IS NULL THEN category END AS call_category, count(*) AS n, CAST(CASE WHEN fault IS NULL THEN CASE WHEN k = 5 THEN count(*) ELSE count(DISTINCT key) END END AS BIGINT) AS keys, CAST(sum(CASE WHEN fault IS NULL AND k NOT IN (2, 3) THEN i END) AS BIGINT) AS uncached,
      CAST(sum(CASE WHEN fault IS NULL THEN CASE WHEN k IN (2, 3) THEN i ELSE i + r + w END END) AS BIGINT) AS input, CAST(sum(CASE WHEN fault IS NULL THEN o END) AS BIGINT) AS output,
      CAST(sum(CASE WHEN fault IS NULL AND k NOT IN (2, 3) THEN i + r + w + o END) AS BIGINT) AS total FROM n GROUP BY agent, fault, CASE WHEN fault IS NULL THEN category END, k"""
)
def x2_source_specifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(table(spark, sf_dir, "lineitem"))
    out = None
    for k, name in enumerate(_NAMES):
        events, faults = read(texts.where(F.col("source") == k), SPECS[name])
        counted = events.groupBy("agent", "call_category").agg(F.count("*").alias("n"), F.count_distinct("record_key").alias("keys"), F.sum("input_uncached").alias("uncached"), F.sum("input_total").alias("input"), F.sum("output_total").alias("output"), F.sum("total_tokens").alias("total")).withColumn("fault", F.lit(None).cast("string"))
        missed = faults.groupBy("agent", "fault").agg(F.count("*").alias("n"))
        one = counted.unionByName(missed, allowMissingColumns=True)
        out = one if out is None else out.unionByName(one)
    return out.select("agent", "fault", "call_category", "n", "keys", "uncached", "input", "output", "total")


@query(r"SELECT p_partkey, lower(p_name) AS name, regexp_replace(regexp_replace(lower(concat(' ', p_name, '_', p_type, ' ')), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS key FROM part")
def x1_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    return spark.sql("SELECT p_partkey, fold_name(p_name) AS name, model_key(concat(' ', p_name, '_', p_type, ' ')) AS key FROM {part}", part=table(spark, sf_dir, "part"))


_BASE = "split_part(lower(trim(replace(model_raw, '_', '-'))), '-', 1)"
_PLAIN = CHOSEN.replace("FROM events_ WHERE attribution_status = 'verified'", f"FROM (SELECT * REPLACE ({_BASE} || '-v1' AS model_raw) FROM events_) WHERE attribution_status = 'verified'")
_MISSING = "CASE WHEN provider_ = '' THEN 'no_provider' WHEN provider_ NOT IN ('china', 'france', 'germany') THEN 'channel_unknown' ELSE 'no_price_row' END"


@query(
    f"""WITH {_PLAIN}, found AS (SELECT *, coalesce(why IN ('no_model', 'no_known_usage', 'token_anomaly'), false) AS unreadable FROM chosen)
    SELECT {_IDS}, CASE WHEN unreadable THEN why WHEN len(direct) = 0 THEN {_MISSING} ELSE reason END AS reason, CASE WHEN NOT unreadable AND len(direct) > 0 THEN tariff.price_id END AS price_id, CASE WHEN NOT unreadable AND len(direct) > 0 THEN mk END AS substitute FROM found"""
)
def j3_substitute_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model as a preview that no price list has: its own provider's price without the ending stands in."""
    events = eligible(usage_events(spark, sf_dir)).where("record_kind <> 'transport_attempt'")
    base = F.substring_index(F.lower(F.trim(F.replace("model_raw", F.lit("_"), F.lit("-")))), "-", 1)
    preview = lambda rows: rows.withColumn("model_raw", F.concat(base, F.lit("-v1-preview")))
    found = pricing.substituted(preview(events), price_rows(spark, sf_dir), CONFIGURED, names=preview(event_names(spark, sf_dir)))
    return found.select(*_IDS.split(", "), "reason", F.col("tariff.price_id").alias("price_id"), "substitute")


@query(
    f"""WITH {CHOSEN}, {EXACT}, m AS (SELECT strftime(local_day, '%Y-%m') AS period, agent, {_ROUND.format("coalesce(sum(coalesce(input_exact, 0) + coalesce(output_exact, 0)) FILTER (tariff.currency = 'USD'), 0)")} AS spent, bool_or(tariff IS NULL OR tariff.currency <> 'USD') AS coverage_limited FROM exact GROUP BY ALL)
    SELECT *, spent >= 100000 AS exceeded FROM m"""
)
def a24_cost_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget in one currency: what is unpriced or of another currency limits what it can tell."""
    dollars = F.coalesce(F.col("tariff.currency") == "USD", F.lit(False))
    exact = F.sum(F.when(dollars, F.coalesce("input_exact", F.lit(0)) + F.coalesce("output_exact", F.lit(0))).otherwise(0)).cast("decimal(38,0)")
    months = priced(spark, sf_dir).groupBy(cal.month_label(F.col("local_day")).alias("period"), "agent").agg(pricing.rounded(exact).alias("spent"), F.bool_or(~dollars).alias("coverage_limited"))
    return months.withColumn("exceeded", F.col("spent") >= 100_000)
