"""Dimension filters, validation and exclusion of events."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterframe.functions.scalars import fold_name, model_key

FIRST_MS = 946_684_800_000  # 2000-01-01
MAX_TOKENS = 1 << 62
AUTHORITY_REASONS = ("source_authority",)
_FIELDS = ("input_uncached", "input_cache_read", "input_cache_write", "input_total", "output_total", "output_reasoning", "total_tokens")


@dataclass
class Filters:
    """All fields must hold, any value of a field is enough, an empty list leaves a field open.

    ``unknown`` stands for null, empty or literally unknown providers and models. Instances are an allow-list: None is
    all, an empty list is none.
    """

    agents: list[str] = field(default_factory=list)
    providers: list[str] = field(default_factory=list)
    models: list[str] = field(default_factory=list)
    instances: list[str] | None = None

    def condition(self) -> Column:
        out = F.lit(True)
        if self.agents:
            out &= fold_name(F.col("agent")).isin([a.lower() for a in self.agents])
        for names, column, key in ((self.providers, "provider_id", fold_name), (self.models, "model_raw", model_key)):
            if names:
                wanted = F.array(*[key(F.lit(n)) for n in names])
                hit = F.coalesce(F.array_contains(wanted, key(F.col(column))), F.lit(False))
                if any(n.lower() == "unknown" for n in names):
                    hit |= F.coalesce(F.lower(column), F.lit("")).isin("", "unknown")
                out &= hit
        if self.instances is not None:
            out &= F.col("source_instance_id").isin(self.instances) if self.instances else F.lit(False)
        return out


def between_labels(label: Column, first: str, last: str) -> Column:
    if first > last:
        raise ValueError("the first label is after the last")
    return label.between(first, last)


def known_value(name: str) -> Column:
    """The value where it was reported or derived; estimates are not known."""
    return F.when(F.col(f"q_{name}").isin("reported", "derived"), F.col(name))


def quality_bucket() -> Column:
    estimated, known = F.lit(False), F.lit(False)
    for name in _FIELDS:
        estimated |= F.col(f"q_{name}") == "estimated"
        known |= F.col(name).isNotNull()
    complete = F.col("input_total").isNotNull() & F.col("output_total").isNotNull()
    return F.when(estimated, "estimated").when(~known, "unknown").when(complete, "complete").otherwise("partial")


def event_fault() -> Column:
    """The first rule that an event breaks, or null."""
    bad_token, mismatch, bad_time = F.lit(False), F.lit(False), F.lit(False)
    for name in _FIELDS:
        bad_token |= F.coalesce(~F.col(name).between(0, MAX_TOKENS), F.lit(False))
        mismatch |= (F.col(f"q_{name}") == "unknown") != F.col(name).isNull()
    for name in ("occurred_at_ms", "interval_start_ms", "interval_end_ms"):
        bad_time |= F.coalesce(F.col(name) < FIRST_MS, F.lit(False))
    return (
        F.when(bad_token, "token_out_of_range")
        .when(mismatch, "quality_mismatch")
        .when(~F.col("record_kind").isin("model_call", "transport_attempt", "usage_observation"), "kind_not_allowed")
        .when(bad_time, "implausible_time")
        .when(F.col("interval_end_ms") < F.col("interval_start_ms"), "interval_reversed")
    )


def apply_floor(events: DataFrame, requested_ms: int, persisted_ms: int | None) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) by the later of the requested and the persisted floor."""
    floor = max(requested_ms, persisted_ms or requested_ms)
    return events.where(F.col("occurred_at_ms") >= floor), events.where(F.col("occurred_at_ms") < floor)


def excluded(events: DataFrame) -> DataFrame:
    return events.where("attribution_status <> 'verified'").withColumn("reason", F.coalesce("exclusion_reason", F.lit("unverified")))
