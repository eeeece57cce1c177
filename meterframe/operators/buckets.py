"""Token interpretations of raw usage records: one projection job, driven by a specification of each source.

A record has up to five counts: input, read, write, output and reasoning. What they mean depends on the writer; the
rules below turn them into exclusive buckets and totals, and leave unknown what cannot be told.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = ("input", "read", "write", "output", "reasoning")
COLUMNS = ("input_uncached", "input_cache_read", "input_cache_write", "input_total", "output_total", "output_reasoning", "total_tokens")


def _sum(*parts: Column) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = F.try_add(out, p)
    return out


def exclusive(c: dict[str, Column]) -> dict[str, Column]:
    """The three input buckets do not overlap."""
    total = _sum(c["input"], c["read"], c["write"])
    return _row(c["input"], c["read"], c["write"], total, c["output"], c["reasoning"], _sum(total, c["output"]))


def inclusive(c: dict[str, Column]) -> dict[str, Column]:
    """The input holds both cache parts; where one is missing or they exceed it, what was not cached stays unknown."""
    cached = _sum(c["read"], c["write"])
    fresh = F.when(c["input"] >= cached, c["input"] - cached)
    return _row(fresh, c["read"], c["write"], c["input"], c["output"], c["reasoning"], _sum(c["input"], c["output"]))


def five_buckets(c: dict[str, Column]) -> dict[str, Column]:
    """Reasoning stands beside the visible output, and belongs to the output in total."""
    total, output = _sum(c["input"], c["read"], c["write"]), _sum(c["output"], c["reasoning"])
    return _row(c["input"], c["read"], c["write"], total, output, c["reasoning"], _sum(total, output))


def independent(c: dict[str, Column]) -> dict[str, Column]:
    """Nothing is known of what includes what, so nothing is derived."""
    none = F.lit(None).cast("long")
    return _row(none, c["read"], c["write"], c["input"], c["output"], c["reasoning"], none)


def _row(*values: Column) -> dict[str, Column]:
    return dict(zip(COLUMNS, values, strict=True))


RULES = {"exclusive": exclusive, "inclusive": inclusive, "five": five_buckets, "independent": independent}


@dataclass
class Source:
    """What a source's records look like: where its counts are, by which rule they are read, and what names a record.

    ``zero_unknown`` (N3): the writer fills in zeros, so a zero count is unknown. ``by_provider`` (N6) reads a record by
    another rule for some providers. ``secondary`` (N7) is a second place of each count, used where the first has none.
    """

    counts: dict[str, str]
    rule: str
    identity: list[str]
    zero_unknown: bool = False
    by_provider: dict[str, str] = field(default_factory=dict)
    secondary: dict[str, str] = field(default_factory=dict)
    provider: str = "provider_id"


def normalise(records: DataFrame, source: Source) -> DataFrame:
    """Records with the token columns, ``record_key``, and ``diagnostic``: why a value could not be taken as it stands."""
    counts, differs = {}, F.lit(False)
    for part in PARTS:
        value = F.expr(source.counts[part]).cast("long") if part in source.counts else F.lit(None).cast("long")
        if part in source.secondary:
            other = F.expr(source.secondary[part]).cast("long")
            differs |= F.coalesce(value != other, F.lit(False))
            value = F.coalesce(value, other)
        counts[part] = F.when(value > 0, value) if source.zero_unknown else value
    out_of_range = F.lit(False)
    for value in counts.values():
        out_of_range |= F.coalesce(value < 0, F.lit(False))
    kept = {p: F.when(~out_of_range, v) for p, v in counts.items()}
    rows = RULES[source.rule](kept)
    for provider, rule in source.by_provider.items():
        other = RULES[rule](kept)
        rows = {k: F.when(F.lower(source.provider) == provider, other[k]).otherwise(v) for k, v in rows.items()}
    exceeded = F.coalesce(_sum(kept["read"], kept["write"]) > kept["input"], F.lit(False)) if source.rule == "inclusive" else F.lit(False)
    key = F.coalesce(*[F.expr(i) for i in source.identity])
    diagnostic = F.when(out_of_range, "out_of_range").when(differs, "views_disagree").when(exceeded, "cache_exceeds_input")
    return records.withColumns(rows).withColumns({"record_key": key, "diagnostic": diagnostic})


def instant_ms(value: Column) -> Column:
    """Epoch seconds, milliseconds or nanoseconds, told apart by size; implausible instants are null."""
    nanos = F.call_function("div", value, F.lit(1_000_000).cast("long"))  # a quotient in floating point may fall below a whole millisecond
    ms = F.when(value >= 100_000_000_000_000_000, nanos).when(value < 100_000_000_000, value * 1000).otherwise(value).cast("long")
    return F.when(ms >= 946_684_800_000, ms)


def latency_ms(ms: Column, seconds: Column, unmarked: Column, threshold: float = 1000.0) -> Column:
    """A field in milliseconds, else one in seconds, else an unmarked one, small values of which are seconds."""
    return F.coalesce(ms, seconds * 1000, F.when(unmarked < threshold, unmarked * 1000).otherwise(unmarked))


def micro_units(cost: Column) -> Column:
    """A native cost as integer micro-units; what is negative or no number is dropped."""
    return F.when((cost >= 0) & ~F.isnan(cost) & (cost < 9e12), F.floor(cost * 1_000_000 + 0.5).cast("long"))


def fail_closed(records: DataFrame, file: str, bad: Column) -> DataFrame:
    """One record of an unsupported kind rejects every record of its file."""
    from pyspark.sql import Window

    return records.withColumn("rejected", F.bool_or(bad).over(Window.partitionBy(file))).where("not rejected").drop("rejected")


def instant(iso: Column, epoch: Column, seconds: Column, nanos: Column) -> Column:
    """Milliseconds from ISO text, else an epoch number of any unit, else a (seconds, nanoseconds) pair; implausible ones are null."""
    pair = seconds * 1000 + F.floor(F.coalesce(nanos, F.lit(0)) / 1_000_000).cast("long")
    text = F.unix_millis(F.try_to_timestamp(iso))
    return F.coalesce(F.when(text >= 946_684_800_000, text), instant_ms(epoch), F.when(pair >= 946_684_800_000, pair))


def cost_kind(cost: Column, by_source: Column) -> tuple[Column, Column]:
    """(micro-units, kind): a cost that its source has billed is reported, one that it worked out is estimated."""
    units = micro_units(cost)
    return units, F.when(units.isNotNull(), F.when(by_source, "reported").otherwise("estimated"))


def call_category(sidechain: Column, parent: Column, path: Column, purpose: Column) -> Column:
    """Calls of sub-agents by flag, parent session or thread, or path; auxiliary ones by a purpose or scope other than the turn's."""
    sub = F.coalesce(sidechain, F.lit(False)) | parent.isNotNull() | F.coalesce(path.rlike("(^|/)subagents?(/|$)"), F.lit(False))
    return F.when(sub, "sub_agent").when(purpose.isNotNull() & ~purpose.isin("turn", "main"), "auxiliary").otherwise("main")


def shape_fault(model: Column, required: dict[str, Column], most: int = 1 << 53) -> Column:
    """Why a record is not read: a placeholder of the writer, or a required count missing or out of range; null if it is."""
    missing, beyond = F.lit(False), F.lit(False)
    for value in required.values():
        missing |= value.isNull()
        beyond |= F.coalesce(~value.between(0, most), F.lit(False))
    return F.when(F.coalesce(F.lower(model) == "<synthetic>", F.lit(False)), "placeholder").when(missing, "required_missing").when(beyond, "out_of_range")
