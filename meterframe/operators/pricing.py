"""Pricing of events against versioned tariffs, in exact integers.

Tariffs are chosen once for each combination of model, provider and span of time; events are joined with what they are
offered, and only settle their tier.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterframe.functions.scalars import DATED_ALIASES, component_amount, model_key, official_providers, price_substitutes, reference_model

UNIT = 100_000_000
_ROW = ("priority", "from_ms", "price_id", "to_ms", "provider", "model", "model_key", "region", "channel", "official", "currency", "threshold", "input_rate", "read_rate", "write_rate", "output_rate")
SLOTS = ("input", "read", "write", "output")


def book(prices: DataFrame) -> DataFrame:
    """(model_key, tariffs): in the order in which snapshots have precedence, later starts first."""
    keyed = prices.withColumn("model_key", model_key(F.col("model")))
    row = F.struct(F.col("priority"), (-F.col("from_ms")).alias("later"), *[F.col(c) for c in _ROW[2:]], F.col("from_ms"))
    return keyed.groupBy("model_key").agg(F.array_sort(F.collect_list(row)).alias("tariffs"))


def _some(rows: Column, test) -> Column:
    """The rows that pass the test, or all of them if none does."""
    passed = F.filter(rows, test)
    return F.when(F.size(passed) > 0, passed).otherwise(rows)


def _same(rows: Column, *names: str) -> Column:
    """The rows that agree with the first one."""

    def test(r: Column) -> Column:
        out = F.lit(True)
        for n in names:
            out &= F.lower(r[n].cast("string")) == F.lower(F.try_element_at(rows, F.lit(1))[n].cast("string"))
        return out

    return F.filter(rows, test)


def _settled(df: DataFrame, *columns: str) -> DataFrame:
    """These columns worked out once: the optimizer does not copy their expressions into all that refers to them."""
    held = F.explode(F.array(F.struct(*columns))).alias("settled_")
    return df.select(*[c for c in df.columns if c not in columns], held).select("*", "settled_.*").drop("settled_")


#: What ``_offers`` tells of a combination, and ``_tariffs`` settles for an event.
_OFFER = ("tiers", "provider_", "mixed_", "fell_", "empty_", "ambiguous_", "missing_", "model_key_")
_KEYS = ("model_raw", "provider_id", "segment_", "dated_")


def choose(events: DataFrame, prices: DataFrame, configured: dict[str, tuple[str, str]], at_ms: Column | None = None, names: DataFrame | None = None) -> DataFrame:
    """Events with ``tariff`` (null if there is none), ``reason`` (why not), ``official_fallback``, and ``tiers``.

    A tariff of the event's own provider counts in its configured region and channel. Otherwise the official vendors'
    tariffs of the same model are a reference, unless they disagree. The tier is the highest that the input reaches.

    What depends on the model, the provider and the time alone is worked out once for each of their combinations, time
    being cut where any tariff begins or ends; events are joined with that small table, which is sent to them, and settle
    their tier. ``names``: all (model_raw, provider_id) that the events can have; without it the events are read for these.
    """
    named, combos = _combinations(events, prices, at_ms, names)
    return _tariffs(named, _offers(combos, prices, configured).select(*_KEYS, *_OFFER), events.columns)


def _combinations(events: DataFrame, prices: DataFrame, at_ms: Column | None, names: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(events with the span of time that they lie in, the combinations of model, provider and span that they can have)."""
    at = F.col("occurred_at_ms") if at_ms is None else at_ms
    ends = sorted({t for r in prices.select(F.explode(F.array("from_ms", "to_ms")).alias("t")).where("t is not null").distinct().collect() for t in r})
    dated = max((since for since, _ in DATED_ALIASES.values()), default=0)
    named = events.withColumns({"segment_": _segment(at, ends), "dated_": F.coalesce(F.col("occurred_at_ms") >= dated, F.lit(False))})
    starts = F.lit([ends[0] - 1 if ends else 0, *ends])
    if names is None:
        found = named.select(*_KEYS).distinct()
    else:
        spans = [(i, late) for i in range(len(ends) + 1) for late in (False, True) if at_ms is not None or (i == len(ends) or ends[i] > dated if late else i == 0 or ends[i - 1] < dated)]
        span = F.array(*[F.struct(F.lit(i).alias("segment_"), F.lit(late).alias("dated_")) for i, late in spans])
        found = names.select("model_raw", "provider_id").distinct().select("*", F.inline(span))
    # few bytes and much work: by number, so that they are not put together into a few tasks
    found = found.repartition(max(8, events.sparkSession.sparkContext.defaultParallelism))
    return named, found.withColumns({"occurred_at_ms": F.when(F.col("dated_"), dated).otherwise(0).cast("long"), "at_": starts[F.col("segment_")]})


def _tariffs(named: DataFrame, offers: DataFrame, columns: list[str]) -> DataFrame:
    """Each event's tariff, or why it has none, by what its combination is offered."""
    same = F.lit(True)
    for k in _KEYS:
        same &= F.col(k).eqNullSafe(F.col(f"k_{k}"))
    held = offers.select(*[F.col(c).alias(f"k_{c}") if c in _KEYS else F.col(c) for c in offers.columns])
    out = named.join(F.broadcast(held), same, "left").drop(*[f"k_{k}" for k in _KEYS])

    size = F.coalesce("input_total", F.col("input_uncached") + F.col("input_cache_read") + F.col("input_cache_write"))
    reached = F.when(size.isNotNull(), F.filter("tiers", lambda r: r.threshold <= size)).otherwise(F.col("tiers"))
    # the greatest threshold reached; of equal ones the first
    best = F.aggregate(reached, F.lit(None).cast(_element(out, "tiers")), lambda a, r: F.when(a.isNull() | (r.threshold > a.threshold), r).otherwise(a))
    tokens = [F.col(c) for c in ("input_uncached", "input_cache_read", "input_cache_write", "input_total", "output_total")]
    negative = F.lit(False)
    for t in tokens:
        negative |= F.coalesce(t < 0, F.lit(False))
    anomaly = negative | F.coalesce(F.col("input_cache_read") + F.col("input_cache_write") > F.col("input_total"), F.lit(False))
    tiered = F.exists("tiers", lambda r: r.threshold != 0)
    reason = (
        F.when(F.coalesce("model_key_", F.lit("")) == "", "no_model")
        .when(F.coalesce(*tokens).isNull(), "no_known_usage")
        .when(anomaly, "token_anomaly")
        .when(F.col("mixed_"), "channel_unknown")
        .when(F.col("empty_"), F.col("missing_"))
        .when(F.col("ambiguous_"), "model_ambiguous")
        .when(size.isNull() & tiered, "tier_ambiguous")
    )
    out = _settled(out.withColumns({"why_": reason, "tariff_": best}), "why_", "tariff_")
    out = out.withColumn("reason", F.coalesce("why_", F.when(F.col("tariff_").isNull(), "no_price_row")))
    more = [c for c in offers.columns if c not in (*_KEYS, *_OFFER)]
    return out.select(*columns, "reason", F.when(F.col("reason").isNull(), F.col("tariff_")).alias("tariff"), (F.col("reason").isNull() & F.col("fell_")).alias("official_fallback"), "tiers", "provider_", *more)


def _element(df: DataFrame, column: str):
    return df.schema[column].dataType.elementType


def _segment(at: Column, ends: list[int]) -> Column:
    """How many of the sorted instants have come: by groups of them first, then inside the group."""
    if not ends:
        return F.lit(0)
    step = math.isqrt(len(ends) - 1) + 1
    groups = [ends[i : i + step] for i in range(0, len(ends), step)]
    group = F.size(F.filter(F.lit([g[-1] for g in groups]), lambda e: e <= at))
    inside = F.try_element_at(F.array(*[F.lit(g) for g in groups]), group + 1)
    return F.coalesce(F.least(group * step + F.coalesce(F.size(F.filter(inside, lambda e: e <= at)), F.lit(0)), F.lit(len(ends))), F.lit(0))


def _offers(combos: DataFrame, prices: DataFrame, configured: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows of (model_raw, provider_id, occurred_at_ms, at_) with the tiers that are offered, and what stands against them."""
    at = F.col("at_")
    provider = F.coalesce(F.lower(F.trim("provider_id")), F.lit(""))
    places = F.create_map(*[x for name, (region, channel) in configured.items() for x in (F.lit(name), F.struct(F.lit(region).alias("region"), F.lit(channel).alias("channel")))])
    keyed = combos.withColumns({"model_key_": model_key(F.col("model_raw")), "provider_": provider})
    keyed = keyed.withColumn("reference_", reference_model(F.col("model_raw"), F.col("provider_id"), F.col("occurred_at_ms")))
    keyed = keyed.withColumns({"place_": F.try_element_at(places, F.col("provider_")), "vendors_": official_providers(F.col("reference_"))})
    known = book(prices)
    joined = keyed.join(known.withColumnRenamed("tariffs", "own_"), keyed.model_key_ == known.model_key, "left").drop("model_key")
    joined = joined.join(known.withColumnRenamed("tariffs", "ref_"), joined.reference_ == known.model_key, "left").drop("model_key")

    def placed(r: Column) -> Column:
        return F.coalesce((F.lower(r.region) == F.col("place_.region")) & (F.lower(r.channel) == F.col("place_.channel")), F.lit(False))

    none = F.filter("own_", lambda r: F.lit(False))
    valid = lambda r: (r.from_ms <= at) & (r.to_ms.isNull() | (at < r.to_ms))
    mine = lambda rows: F.filter(rows, lambda r: valid(r) & (F.lower(r.provider) == F.col("provider_")) & placed(r))
    own, ref = F.coalesce(mine("own_"), F.array()), F.coalesce(mine("ref_"), F.array())
    out = joined.withColumn("direct_", F.when(F.size(own) > 0, own).otherwise(ref))
    vendor = lambda r: (F.size("vendors_") == 0) | F.array_contains("vendors_", F.lower(r.provider))
    out = out.withColumn("official_", F.coalesce(F.filter("ref_", lambda r: valid(r) & r.official & vendor(r)), none))
    out = _settled(out.drop("own_"), "direct_", "official_")
    preferred, worldwide = F.filter("official_", placed), F.filter("official_", lambda r: F.lower(r.region) == "global")
    out = out.withColumns({"preferred_": preferred, "global_": worldwide})
    picked = F.when(F.size("preferred_") > 0, F.col("preferred_")).when(F.size("global_") > 0, F.col("global_")).otherwise(F.col("official_"))
    api_first = (F.coalesce(F.size("preferred_"), F.lit(0)) <= 0) & (F.size("global_") > 0)
    out = out.withColumn("fallback_", _same(picked, "priority")).withColumn("fallback_", F.when(api_first, _some(F.col("fallback_"), lambda r: F.lower(r.channel) == "api")).otherwise(F.col("fallback_")))
    direct = F.size("direct_") > 0
    mixed = F.coalesce(F.size(_same(F.col("fallback_"), "currency", "region", "channel")) != F.size("fallback_"), F.lit(False))
    out = out.withColumns({"fell_": ~direct & (F.coalesce(F.size("fallback_"), F.lit(0)) > 0), "mixed_": ~direct & mixed})
    out = out.withColumn("rows_", F.when(direct, F.col("direct_")).otherwise(_same(F.col("fallback_"), "provider", "region", "channel", "currency")))
    out = _settled(out.drop("official_", "preferred_", "global_", "fallback_", "direct_", "ref_"), "fell_", "mixed_", "rows_")
    raw = F.lower(F.trim("model_raw"))
    exact, by_reference = F.filter("rows_", lambda r: F.lower(r.model) == raw), F.filter("rows_", lambda r: F.lower(r.model) == F.col("reference_"))
    out = out.withColumns({"exact_": exact, "byref_": by_reference})
    out = out.withColumn("spelled_", F.when(F.size("exact_") > 0, F.col("exact_")).when(F.size("byref_") > 0, F.col("byref_")).otherwise(F.col("rows_")))
    out = out.withColumn("ambiguous_", F.size(_same(F.col("spelled_"), "model")) != F.size("spelled_")).withColumn("tiers", _same(F.col("spelled_"), "priority"))
    out = _settled(out.drop("exact_", "byref_", "spelled_"), "ambiguous_", "tiers")
    missing = F.when(F.size("vendors_") > 0, "no_price_row").when(F.col("provider_") == "", "no_provider").when(F.col("place_").isNull(), "channel_unknown").otherwise("no_price_row")
    return out.withColumns({"empty_": F.coalesce(F.size("rows_"), F.lit(0)) <= 0, "missing_": missing})


def substituted(events: DataFrame, prices: DataFrame, configured: dict[str, tuple[str, str]], at_ms: Column | None = None, names: DataFrame | None = None) -> DataFrame:
    """``choose`` for current reference prices: an event without a price row takes the first substitute model that has one.

    ``substitute`` names it. Of a substitute only official vendors' tariffs count; where it is the model itself without
    ``-preview``, its provider's configured ones as well. Substitutes too are found for combinations, not for events.
    """
    named, combos = _combinations(events, prices, at_ms, names)
    first = _offers(combos, prices, configured)
    lacking = (F.size(F.coalesce("tiers", F.array())) <= 0) & (F.coalesce("model_key_", F.lit("")) != "")
    asked = first.where(lacking).select(*_KEYS, "at_", "occurred_at_ms", "reference_", F.posexplode(price_substitutes(F.col("reference_"), F.col("provider_id"))).alias("place_", "substitute"))
    known = prices.withColumns({"key_": model_key(F.col("model")), "provider_key_": F.lower("provider")})
    provider = F.coalesce(F.lower(F.trim("provider_id")), F.lit(""))
    spots = F.array(*[F.lit(f"{n}|{r}|{c}") for n, (r, c) in configured.items()]) if configured else F.array().cast("array<string>")
    at_home = (F.col("provider_key_") == provider) & F.array_contains(spots, F.concat_ws("|", "provider_key_", F.lower("region"), F.lower("channel"))) & (F.concat(F.col("substitute"), F.lit("-preview")) == F.col("reference_"))
    vendors = official_providers(F.col("substitute"))
    sold = F.col("official") & F.array_contains(vendors, F.col("provider_key_"))
    offered = asked.join(known, F.col("substitute") == F.col("key_")).where((F.col("from_ms") <= F.col("at_")) & (F.col("to_ms").isNull() | (F.col("at_") < F.col("to_ms"))) & (at_home | sold))
    best = offered.groupBy(*_KEYS, "at_", "occurred_at_ms").agg(F.min_by("substitute", "place_").alias("substitute"))
    again = _offers(best.withColumns({"raw_": F.col("model_raw"), "model_raw": F.col("substitute")}), prices, configured).withColumn("model_raw", F.col("raw_"))
    held = first.select(*_KEYS, *_OFFER).alias("f").join(again.select(*_KEYS, "substitute", *_OFFER).alias("s"), _equal("f", "s"), "left")
    taken = [F.when(F.col("substitute").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"f.{c}")).alias(c) for c in _OFFER]
    found = _tariffs(named, held.select(*[F.col(f"f.{k}") for k in _KEYS], *taken, "substitute", F.col("f.tiers").alias("own_tiers_")), events.columns)
    # an event that no price would help has no substitute
    spoilt = F.coalesce(F.col("substitute").isNotNull() & F.col("reason").isin("no_known_usage", "token_anomaly"), F.lit(False))
    kept = {"tiers": F.when(spoilt, F.col("own_tiers_")).otherwise(F.col("tiers")), "substitute": F.when(~spoilt, F.col("substitute"))}
    return found.withColumns(kept).drop("own_tiers_")


def _equal(a: str, b: str) -> Column:
    same = F.lit(True)
    for k in _KEYS:
        same &= F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return same


def amounts(priced: DataFrame, ttl: dict[str, int]) -> DataFrame:
    """Adds each component's exact numerator and rounded amount; a component without tokens or rate stays null.

    Cache writes need a configured lifetime, but none if nothing was written.
    """
    minutes = F.try_element_at(F.create_map(*[F.lit(x) for kv in ttl.items() for x in kv]), F.col("provider_"))
    uncached = F.coalesce("input_uncached", F.col("input_total") - F.col("input_cache_read") - F.col("input_cache_write"))
    write_rate = F.when(F.col("input_cache_write") == 0, F.lit(0)).when(minutes.isNotNull(), F.col("tariff.write_rate"))
    parts = {"input": (uncached, F.col("tariff.input_rate")), "read": (F.col("input_cache_read"), F.col("tariff.read_rate")), "write": (F.col("input_cache_write"), write_rate), "output": (F.col("output_total"), F.col("tariff.output_rate"))}
    exact = {f"{n}_exact": F.when(F.col("tariff").isNotNull(), t.cast("decimal(19,0)") * r.cast("decimal(18,0)")).cast("decimal(38,0)") for n, (t, r) in parts.items()}
    rounded = {f"{n}_amount": F.when(F.col("tariff").isNotNull(), component_amount(t, r)) for n, (t, r) in parts.items()}
    return priced.withColumns(exact | rounded)


def rounded(total: Column) -> Column:
    """An exact numerator in minor units, rounded half up once."""
    return F.call_function("div", total + F.lit(UNIT // 2).cast("decimal(38,0)"), F.lit(UNIT).cast("decimal(38,0)"))


def cost_rows(priced: DataFrame, *keys: str) -> DataFrame:
    """Estimates by keys and currency from exact sums, each component rounded once; what is unpriced is counted by reason under an empty currency."""
    currency = F.coalesce("tariff.currency", F.lit(""))
    grouped = priced.withColumn("currency", currency).groupBy(*keys, "currency").agg(F.count("*").alias("events"), F.count_if(F.col("official_fallback")).alias("fallbacks"), *[F.sum(f"{n}_exact").alias(f"{n}_exact") for n in SLOTS])
    return grouped.select(*keys, "currency", "events", "fallbacks", *[rounded(F.col(f"{n}_exact").cast("decimal(38,0)")).alias(f"{n}_amount") for n in SLOTS])


def cost_modes(priced: DataFrame, micro: Column, kind: Column) -> DataFrame:
    """One row for an event's estimate and one for the cost that its source names, reported or estimated by it.

    ``exact`` is the numerator of minor units; unpriced events are estimates under an empty currency.
    """
    estimate = F.lit(0).cast("decimal(38,0)")
    for slot in SLOTS:
        estimate = estimate + F.coalesce(f"{slot}_exact", F.lit(0))
    row = lambda mode, currency, exact, basis: F.struct(mode.alias("mode"), currency.alias("currency"), exact.cast("decimal(38,0)").alias("exact"), basis.alias("basis"))
    own = row(F.lit("estimate"), F.coalesce("tariff.currency", F.lit("")), estimate, F.col("tariff.price_id"))
    native = F.when(micro.isNotNull(), row(F.concat(F.lit("source_"), kind), F.lit("USD"), micro * (UNIT // 10_000), F.lit(None).cast("string")))
    return priced.select("*", F.explode(F.array_compact(F.array(own, native))).alias("c")).select(*priced.columns, "c.*")


def cost_summary(modes: DataFrame, revision: str) -> DataFrame:
    """Amounts, events, bases and the latest revision by mode and currency, and beside these by reason, model or day."""
    axis = F.when(F.grouping("reason") == 0, "reason").when(F.grouping("model") == 0, "model").when(F.grouping("local_day") == 0, "day").otherwise("total")
    keys = [F.col(c) for c in ("mode", "currency", "reason", "model", "local_day")]
    sets = [[*keys[:2], *more] for more in ([], keys[2:3], keys[3:4], keys[4:5])]
    total = rounded(F.sum("exact").cast("decimal(38,0)"))
    return modes.groupingSets(sets, *keys).agg(axis.alias("axis"), F.count("*").alias("events"), F.count_distinct("basis").alias("bases"), F.max(revision).alias("revision"), total.alias("amount"))


def simulated(priced: DataFrame, ttl: dict[str, int], aggregate: str) -> DataFrame:
    """Rows with ``low`` and ``high``, the exact cost where a request's tier is known and its bounds where it is lost.

    Rows for which ``aggregate`` holds are sums of calls, of which no size is known: each of their rates lies between the
    least and the greatest of the tariff's tiers, or is unknown if a tier has none. They are not priced if the tariff has no
    base tier, and a sum's own size chooses none. ``why``: the reason of what is not priced.
    """
    lost = F.coalesce(F.col(aggregate), F.lit(False))
    offered = F.size(F.coalesce("tiers", F.array())) > 0
    base = F.exists("tiers", lambda r: r.threshold == 0)
    settled = ~F.coalesce(F.col("reason").isin("tier_ambiguous", "no_price_row"), F.lit(True))  # a reason that no tier could change
    why = F.when(~lost | settled | ~offered, F.col("reason")).when(~base, "tier_ambiguous")

    def edge(pick) -> Column:
        def rate(slot: str) -> Column:
            rates = F.transform("tiers", lambda r: r[f"{slot}_rate"])
            return F.when(~F.exists(rates, lambda x: x.isNull()), pick(rates))

        one = F.try_element_at("tiers", F.lit(1))
        for slot in SLOTS:
            one = one.withField(f"{slot}_rate", rate(slot))
        return F.when(lost & offered & why.isNull(), one).when(~lost, F.col("tariff"))

    out = priced.withColumns({"why": why, "low_": edge(F.array_min), "high_": edge(F.array_max)})
    held = [c for c in out.columns if c not in ("low_", "high_", "tariff")]
    for name in ("low", "high"):
        found = amounts(out.withColumn("tariff", F.col(f"{name}_")), ttl)
        total = F.lit(0).cast("decimal(38,0)")
        for slot in SLOTS:
            total = total + F.coalesce(f"{slot}_exact", F.lit(0))
        out = found.withColumn(name, F.when(F.col("tariff").isNotNull(), total.cast("decimal(38,0)"))).select(*held, "low_", "high_", *[n for n in ("low", "high") if n == name or n in out.columns])
    return out.drop("low_", "high_")


def bounds(simulated: DataFrame, *keys: str) -> DataFrame:
    """Calls priced and not, and the lower and upper cost, of rows with how many ``calls`` they hold."""
    priced = F.col("low").isNotNull()
    sums = [rounded(F.sum(n).cast("decimal(38,0)")).alias(f"{n}_amount") for n in ("low", "high")]
    return simulated.groupBy(*keys).agg(F.sum(F.when(priced, F.col("calls")).otherwise(0)).alias("priced"), F.sum(F.when(~priced, F.col("calls")).otherwise(0)).alias("unpriced"), *sums)
