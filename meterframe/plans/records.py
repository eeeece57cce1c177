"""Normalisation queries: each token rule, identities, times and costs of raw records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.operators import buckets
from meterframe.registry import query
from meterframe.sources.usage import table

COUNTS = {
    "input": "CASE WHEN l_partkey % 11 <> 0 THEN CAST(floor(l_quantity * 10) AS BIGINT) END",
    "read": "CASE WHEN l_partkey % 7 <> 0 THEN CAST(floor(l_discount * 1000) AS BIGINT) END",
    "write": "CASE WHEN l_partkey % 5 <> 0 THEN CAST(floor(l_tax * 1000) AS BIGINT) END",
    "output": "CASE WHEN l_partkey % 19 <> 0 THEN CAST(floor(l_extendedprice / 10) AS BIGINT) - CASE WHEN l_partkey % 83 = 0 THEN 100000 ELSE 0 END END",
    "reasoning": "CASE WHEN l_partkey % 3 <> 0 THEN l_suppkey END",
}
RAW = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
C = "c AS (SELECT " + RAW + ", " + ", ".join(f"{e} AS {k}" for k, e in COUNTS.items()) + ", CASE l_suppkey % 3 WHEN 0 THEN 'OpenAI' WHEN 1 THEN 'anthropic' ELSE 'other' END AS provider_id FROM lineitem)"
_SOUND = "sound AS (SELECT *, coalesce(input < 0 OR read < 0 OR write < 0 OR output < 0 OR reasoning < 0, false) OR coalesce(output < 0, false) AS bad FROM {0})"
_KEEP = "kept AS (SELECT " + RAW + ", provider_id, bad, " + ", ".join(f"CASE WHEN NOT bad THEN {p} END AS {p}" for p in buckets.PARTS) + " FROM sound)"
_NAMES = ("input_uncached", "input_cache_read", "input_cache_write", "input_total", "output_total", "output_reasoning", "total_tokens")
_RULES = {
    "exclusive": ("input", "read", "write", "input + read + write", "output", "reasoning", "input + read + write + output"),
    "inclusive": ("CASE WHEN input >= read + write THEN input - (read + write) END", "read", "write", "input", "output", "reasoning", "input + output"),
    "five": ("input", "read", "write", "input + read + write", "output + reasoning", "reasoning", "input + read + write + output + reasoning"),
    "independent": ("NULL", "read", "write", "input", "output", "reasoning", "NULL"),
}


def _sql(rule: str, base: str = "c", diagnostic: str = "CASE WHEN bad THEN 'out_of_range' END", before: str = "") -> str:
    columns = ", ".join(f"CAST({e} AS BIGINT) AS {n}" for e, n in zip(_RULES[rule], _NAMES, strict=True))
    return f"WITH {C}, {before}{_SOUND.format(base)}, {_KEEP} SELECT {RAW}, {columns}, {diagnostic} AS diagnostic FROM kept"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = "CASE l_suppkey % 3 WHEN 0 THEN 'OpenAI' WHEN 1 THEN 'anthropic' ELSE 'other' END"
    return table(spark, sf_dir, "lineitem").select(*RAW.split(", "), *[F.expr(e).alias(k) for k, e in COUNTS.items()], F.expr(provider).alias("provider_id"))


def _run(spark: SparkSession, sf_dir: str, rule: str, **more) -> DataFrame:
    source = buckets.Source({p: p for p in buckets.PARTS}, rule, ["concat('req:', l_orderkey)"], **more)
    return buckets.normalise(_records(spark, sf_dir), source).select(*RAW.split(", "), *_NAMES, "diagnostic")


@query(_sql("exclusive"))
def n1_exclusive_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "exclusive")


@query(_sql("inclusive", diagnostic="CASE WHEN bad THEN 'out_of_range' WHEN read + write > input THEN 'cache_exceeds_input' END"))
def n2_inclusive_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "inclusive")


_ZERO = "z AS (SELECT " + RAW + ", provider_id, " + ", ".join(f"CASE WHEN {p} > 0 THEN {p} END AS {p}" for p in buckets.PARTS) + " FROM c), "


@query(_sql("exclusive", "z", before=_ZERO))
def n3_zero_is_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "exclusive", zero_unknown=True)


@query(_sql("five"))
def n4_five_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "five")


@query(_sql("independent"))
def n5_independent_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "independent")


_BY = ", ".join(f"CAST(CASE lower(provider_id) WHEN 'openai' THEN {a} WHEN 'anthropic' THEN {b} ELSE {c} END AS BIGINT) AS {n}" for a, b, c, n in zip(_RULES["inclusive"], _RULES["exclusive"], _RULES["independent"], _NAMES, strict=True))


@query(f"WITH {C}, {_SOUND.format('c')}, {_KEEP} SELECT {RAW}, {_BY}, CASE WHEN bad THEN 'out_of_range' END AS diagnostic FROM kept")
def n6_rule_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "independent", by_provider={"openai": "inclusive", "anthropic": "exclusive"})


_DUAL = "d AS (SELECT " + RAW + ", provider_id, coalesce(input, l_suppkey) AS input, read, write, output, reasoning FROM c), "


@query(_sql("exclusive", "d", "CASE WHEN bad THEN 'out_of_range' WHEN l_partkey % 11 <> 0 AND input <> l_suppkey THEN 'views_disagree' END", _DUAL))
def n7_dual_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "exclusive", secondary={"input": "l_suppkey"})


@query("SELECT l_orderkey, count(*) AS n, count(DISTINCT CASE WHEN l_partkey % 4 = 0 THEN concat('req:', l_partkey) WHEN l_partkey % 4 = 1 THEN concat('msg:', l_suppkey) ELSE concat('line:', l_orderkey, ':', l_linenumber) END) AS identities FROM lineitem GROUP BY 1")
def n9_identity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = ["CASE WHEN l_partkey % 4 = 0 THEN concat('req:', l_partkey) END", "CASE WHEN l_partkey % 4 = 1 THEN concat('msg:', l_suppkey) END", "concat('line:', l_orderkey, ':', l_linenumber)"]
    keyed = buckets.normalise(_records(spark, sf_dir), buckets.Source({"input": "input"}, "independent", chain))
    return keyed.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("record_key").alias("identities"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY NOT bool_or(l_returnflag = 'R' AND l_partkey % 13 = 0) OVER (PARTITION BY l_orderkey)")
def n13_fail_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return buckets.fail_closed(lines, "l_orderkey", (F.col("l_returnflag") == "R") & (F.col("l_partkey") % 13 == 0)).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE epoch_us(ts) // 1000000 * 1000 END AS at_ms, CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN value * 1000 ELSE CASE WHEN value < 50 THEN value * 1000 ELSE value END END AS latency,
    CASE WHEN cost >= 0 AND NOT isnan(cost) AND cost < 9e12 THEN CAST(floor(cost * 1000000 + 0.5) AS BIGINT) END AS micros FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN -value ELSE value END AS cost FROM events)"""
)
def n14_n16_times_and_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz"))
    kind, value = F.col("event_id") % 4, F.col("value")
    raw = F.when(kind == 0, seconds).when(kind == 1, seconds * 1000).when(kind == 2, seconds * 1_000_000_000).otherwise(F.lit(12345))
    third = F.col("event_id") % 3
    latency = buckets.latency_ms(F.when(third == 0, value), F.when(third == 1, value), value, 50.0)
    return table(spark, sf_dir, "events").select("event_id", buckets.instant_ms(raw).alias("at_ms"), latency.alias("latency"), buckets.micro_units(F.when(F.col("event_id") % 5 == 0, -value).otherwise(value)).alias("micros"))
