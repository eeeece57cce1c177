"""Display names of models: alias catalogues, their precedence, and labels that hold over a whole time range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterframe.functions.scalars import model_key, reference_model

LATEST = 253_402_300_800_000
_RULE = "struct<agent:string,key:string,displayName:string,providerId:string,effectiveFrom:string,effectiveUntil:string,basis:string>"
CATALOGUE = f"schemaVersion int, ruleVersion string, publishedAt string, aliases array<{_RULE}>"
BASES = ("user_override", "catalogue", "native_snapshot")
MOST_RULES = 2000


def _instant(text: Column) -> Column:
    """Milliseconds of an instant in UTC; null if it is none."""
    return F.when(text.endswith("Z") & (F.length(text) <= 35), F.unix_millis(F.try_to_timestamp(text)))


def _text(value: Column, most: int) -> Column:
    return F.coalesce((F.length(value) > 0) & (F.octet_length(value) <= most) & (F.trim(value) == value) & ~value.rlike(r"\p{Cntrl}"), F.lit(False))


def _scope(value: Column) -> Column:
    return _text(value, 160) & F.coalesce(value.rlike(r"^[A-Za-z0-9/_.:-]+$"), F.lit(False))


def load_catalogues(files: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(rules of the sound catalogues, (file, fault) of the others) from texts (file, value); one bad rule rejects its catalogue."""
    read = files.select("file", F.from_json("value", CATALOGUE).alias("c"), F.try_parse_json("value").isNull().alias("broken"))
    published = _instant(F.col("c.publishedAt"))
    shape = (F.col("c.schemaVersion") == 1) & _text(F.col("c.ruleVersion"), 128) & F.size("c.aliases").between(1, MOST_RULES)
    head = F.when(F.col("broken"), "json").when(~F.coalesce(shape, F.lit(False)), "schema").when(published.isNull(), "timestamp").when(published > now_ms + 300_000, "future_publication")
    marked = read.select("file", "c", head.alias("head"))
    each = marked.where("head is null").select("file", F.explode("c.aliases").alias("r"))
    start, until = _instant(F.col("r.effectiveFrom")), _instant(F.col("r.effectiveUntil"))
    times = start.isNull() | (F.col("r.effectiveUntil").isNotNull() & until.isNull())
    sound = _scope(F.col("r.agent")) & _text(F.col("r.key"), 160) & _text(F.col("r.displayName"), 160) & (F.col("r.providerId").isNull() | _scope(F.col("r.providerId")))
    sound &= F.col("r.basis").isin(*BASES) & F.coalesce(until > start, F.lit(True))
    rules = each.select(
        "file", F.lower("r.agent").alias("agent"), model_key(F.col("r.key")).alias("key"), F.lower("r.providerId").alias("provider_id"), F.col("r.displayName").alias("label"), start.alias("from_ms"), until.alias("until_ms"),
        F.when(times, "timestamp").when(~F.coalesce(sound, F.lit(False)), "rule").alias("fault"),
    )
    same = Window.partitionBy("file", "agent", "key", "provider_id", "from_ms", "until_ms")
    rules = rules.withColumn("fault", F.coalesce("fault", F.when(F.count("*").over(same) > 1, "duplicate")))
    order = {"timestamp": 0, "rule": 1, "duplicate": 2}
    worst = rules.where("fault is not null").groupBy("file").agg(F.min_by("fault", F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("fault"))).alias("fault"))
    faults = marked.where("head is not null").select("file", F.col("head").alias("fault")).unionByName(worst)
    return rules.drop("fault").join(faults, "file", "left_anti"), faults


def candidates(own: DataFrame, *feeds: DataFrame) -> DataFrame:
    """The bundled and imported rules (``feed`` null), which come first, united with those of each further catalogue."""
    out = own.withColumn("feed", F.lit(None).cast("int"))
    for number, rules in enumerate(feeds):
        out = out.unionByName(rules.withColumn("feed", F.lit(number)))
    return out


def labels(ranges: DataFrame, rules: DataFrame) -> DataFrame:
    """``ranges`` (id, raw, agent, provider_id, from_ms, to_ms) with the label that covers each without gap or conflict, else the raw name.

    At any instant the rule for the provider comes before one for any, and a later start before an earlier. The winner of
    each piece of the range must give the same single label and last until the next. Bundled rules decide alone where
    there is one; else all further catalogues that have one must agree.
    """
    key, agent = model_key(F.col("raw")), F.lower("agent")
    named = ranges.withColumns({"key_": key, "agent_": agent, "asked_": F.coalesce(F.lower("provider_id"), F.lit(""))})  # a rule never has the empty provider
    spans = ["key_", "agent_", "asked_", "asked_from", "to_ms"]
    # many ranges ask the same, and of rules that begin at once only their labels and their first end count
    asked = named.where("from_ms < to_ms").select("key_", "agent_", "asked_", F.col("from_ms").alias("asked_from"), "to_ms").distinct()
    starts = rules.groupBy(F.col("key").alias("key_"), F.col("agent").alias("agent_"), "provider_id", "feed", "from_ms").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.coalesce("until_ms", F.lit(LATEST))).alias("until"))
    met = asked.join(starts, ["key_", "agent_"]).where((F.col("provider_id").isNull() | (F.col("provider_id") == F.nullif(F.col("asked_"), F.lit("")))) & (F.col("from_ms") < F.col("to_ms")))
    rank = F.struct(F.col("provider_id").isNotNull().alias("own"), F.col("from_ms").alias("at")).alias("rank")
    groups = met.select(*spans, "feed", rank, "low", "high", "until")
    whole = Window.partitionBy(*spans, "feed")
    along = whole.orderBy("rank.at", "rank.own")
    groups = groups.withColumn("base", F.max(F.when(F.col("rank.at") <= F.col("asked_from"), F.col("rank"))).over(whole))
    best = F.max("rank").over(along.rowsBetween(Window.unboundedPreceding, -1))
    at_once = F.max("rank").over(Window.partitionBy(*spans, "feed", "rank.at"))
    groups = groups.withColumns({"before": best, "at_once": at_once})
    later = (F.col("rank.at") > F.col("asked_from")) & (F.col("rank") == F.col("at_once")) & (F.col("rank") > F.greatest("base", F.coalesce("before", "base")))
    steps = groups.withColumn("step", F.coalesce((F.col("rank") == F.col("base")) | later, F.lit(False)))
    following = F.first(F.when(F.col("step"), F.col("rank.at")), ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    steps = steps.withColumn("ends", F.coalesce(following, F.col("to_ms")))
    sound = F.coalesce((F.col("low") == F.col("high")) & (F.col("until") >= F.col("ends")), F.lit(False))
    of_step = lambda c: F.when(F.col("step"), c)
    found = steps.groupBy(*spans, "feed").agg(F.bool_and(of_step(sound)).alias("sound"), F.min(of_step(F.col("low"))).alias("low"), F.max(of_step(F.col("low"))).alias("high"), F.bool_or(F.col("base").isNull()).alias("gap"))
    label = F.when(F.col("sound") & (F.col("low") == F.col("high")) & ~F.col("gap"), F.col("low"))
    own = F.col("feed").isNull()
    decided = found.withColumn("label", label).groupBy(*spans).agg(
        F.bool_or(own).alias("has_own"), F.max(F.when(own, F.col("label"))).alias("own_label"),
        F.count_if(~own & F.col("label").isNull()).alias("open"), F.min(F.when(~own, F.col("label"))).alias("least"), F.max(F.when(~own, F.col("label"))).alias("fed"),
    )
    chosen = F.when(F.col("has_own"), F.col("own_label")).when((F.col("open") == 0) & (F.col("least") == F.col("fed")), F.col("fed"))
    told = decided.select("key_", "agent_", "asked_", F.col("asked_from").alias("from_ms"), "to_ms", chosen.alias("chosen"))
    back = named.join(told, ["key_", "agent_", "asked_", "from_ms", "to_ms"], "left")
    return back.select(*ranges.columns, F.coalesce("chosen", "raw").alias("label"))


def official_ids(providers: DataFrame, names: DataFrame) -> DataFrame:
    """Ids of ``providers`` that are a prefix of some canonical name, or that with ``-cn``; subscription plans are left out."""
    prefixes = names.where(F.col("canonical").contains("/")).select(F.substring_index("canonical", "/", 1).alias("prefix")).where("prefix <> ''").distinct()
    ids = providers.select("provider_id").distinct().where(~F.col("provider_id").contains("-plan"))
    base = ids.select("provider_id", F.explode(F.array_distinct(F.array("provider_id", F.regexp_replace("provider_id", "-cn$", "")))).alias("prefix"))
    return base.join(prefixes, "prefix", "left_semi").select("provider_id").distinct()


def catalogue_names(texts: DataFrame) -> DataFrame:
    """(alias, id) of JSON catalogues (``json``: {"models": [{"id", "aliases"}]}); of several models of one alias the least id."""
    models = texts.select(F.explode(F.from_json("json", "struct<models:array<struct<id:string,aliases:array<string>>>>").models).alias("m"))
    each = models.select("m.id", F.explode("m.aliases").alias("alias"))
    return each.where("id is not null and alias is not null").groupBy("alias").agg(F.min("id").alias("id"))


def reference_models(rows: DataFrame, model: str, provider: str, at_ms: Column, names: DataFrame) -> DataFrame:
    """``rows`` with ``reference``: the model's name by the fixed rules or, where these leave it as it is, by a catalogue."""
    key = reference_model(F.col(model), F.col(provider), at_ms)
    held = names.select(F.col("alias").alias("alias_"), F.col("id").alias("id_"))
    named = rows.withColumn("key_", key).join(held, F.col("key_") == F.col("alias_"), "left")
    return named.select(*rows.columns, F.coalesce("id_", "key_").alias("reference"))
