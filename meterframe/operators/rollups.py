"""Rollups of events: counts, known sums and counts of unknowns, which are never added as zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("model_call", "transport_attempt", "usage_observation")
DIMENSIONS = ("source_instance_id", "agent", "provider", "model", "call_category", "quality_bucket")
#: The sums of a rollup row, in the order of its columns.
MEASURES = (
    "events", "calls", "attempts", "observations", "input_sum", "input_known", "input_unknown", "uncached_sum", "uncached_known", "read_sum", "read_known",
    "write_sum", "write_known", "output_sum", "output_known", "output_unknown", "total_sum", "total_known", "total_unknown", "ratio_input", "ratio_read", "ratio_samples",
)


def eligible(events: DataFrame) -> DataFrame:
    """Verified events of a kind that counts."""
    return events.where((F.col("attribution_status") == "verified") & F.col("record_kind").isin(*KINDS))


def _measures(kept: Column | None = None) -> list[Column]:
    """``kept``: a condition on the events that known sums and counts of samples are told from."""
    counts = F.col("record_kind") != "transport_attempt"
    counts = counts if kept is None else counts & kept
    observed = counts & (F.col("quality_bucket") != "unknown")

    def total(name: str) -> list[tuple[str, Column]]:
        known = F.col(f"known_{name}")
        short = {"input_uncached": "uncached", "input_cache_read": "read", "input_cache_write": "write"}.get(name, name.split("_")[0])
        out = [(f"{short}_sum", F.sum(F.when(counts, known))), (f"{short}_known", F.count_if(counts & known.isNotNull()))]
        return out + ([(f"{short}_unknown", F.count_if(observed & known.isNull()))] if name in ("input_total", "output_total", "total_tokens") else [])

    both = counts & F.col("known_input_total").isNotNull() & F.col("known_input_cache_read").isNotNull()
    found = [("events", F.count("*")), *[(n, F.count_if(F.col("record_kind") == k)) for n, k in zip(("calls", "attempts", "observations"), KINDS, strict=True)]]
    for name in ("input_total", "input_uncached", "input_cache_read", "input_cache_write", "output_total", "total_tokens"):
        found += total(name)
    found += [("ratio_input", F.sum(F.when(both, F.col("known_input_total")))), ("ratio_read", F.sum(F.when(both, F.col("known_input_cache_read")))), ("ratio_samples", F.count_if(both))]
    return [c.alias(n) for n, c in found]


def named(events: DataFrame) -> DataFrame:
    """Eligible events with the dimensions of a rollup."""
    return eligible(events).withColumns({"provider": F.coalesce("provider_id", F.lit("")), "model": F.coalesce("model_raw", F.lit(""))})


def rollup(events: DataFrame, *grain: str) -> DataFrame:
    """One row for each value of the grain and the dimensions; an unknown provider or model is an empty name."""
    return named(events).groupBy(*grain, *DIMENSIONS).agg(*_measures())


def rollup_with_detail(events: DataFrame, kept: Column, told: tuple[str, ...], *grain: str) -> DataFrame:
    """One row for each value of the grain and the dimensions: its ``events``, and of those ``kept`` their number and the measures ``told``."""
    measures = dict(zip(MEASURES, _measures(kept), strict=True))
    return named(events).groupBy(*grain, *DIMENSIONS).agg(F.count("*").alias("events"), F.count_if(kept).alias("kept"), *[measures[m] for m in told])


def resum(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """Rollup rows added up by other keys; a sum without any known sample stays null."""
    return rows.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in MEASURES])


def cache_ratio() -> Column:
    """Ratio of sums over the rows that know both sides."""
    return F.when(F.col("ratio_input") > 0, F.col("ratio_read") / F.col("ratio_input"))


def summary(rows: DataFrame) -> DataFrame:
    """Totals by period, by model, by agent and overall, from one pass over the rollup rows."""
    axis = F.when(F.grouping("local_day") == 0, "period").when(F.grouping("model") == 0, "model").when(F.grouping("agent") == 0, "agent").otherwise("total")
    sets = [[F.col("local_day")], [F.col("provider"), F.col("model")], [F.col("agent")], []]
    keys = [F.col(c) for c in ("local_day", "provider", "model", "agent")]
    return rows.groupingSets(sets, *keys).agg(axis.alias("axis"), *[F.sum(m).alias(m) for m in MEASURES]).select("axis", "local_day", "provider", "model", "agent", *MEASURES)


def axes(rows: DataFrame, named: dict[str, tuple[str, ...]]) -> DataFrame:
    """One table of several groupings, each by instance and its own keys; ``axis`` names the grouping."""
    keys = ("local_day", "provider", "model", "agent")
    bits = {name: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in held) for name, held in named.items()}
    name = F.lit(None).cast("string")
    for axis, value in bits.items():
        name = F.when(F.col("gid") == value, axis).otherwise(name)
    sets = [[F.col("source_instance_id"), *map(F.col, held)] for held in named.values()]
    gid = F.grouping_id("source_instance_id", *keys).alias("gid")
    found = rows.groupingSets(sets, F.col("source_instance_id"), *map(F.col, keys)).agg(gid, F.sum("events").alias("events"), F.sum("calls").alias("calls"), F.sum("total_sum").alias("total_sum"))
    return found.select(name.alias("axis"), "source_instance_id", *keys, "events", "calls", "total_sum")
