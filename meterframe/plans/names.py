"""Queries over names: alias catalogues, labels of time ranges, and official provider ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.operators import aliases
from meterframe.registry import query
from meterframe.sources.usage import table

NOW = 1_704_067_200_000
#: Supplier i publishes a catalogue: faulty ones by their number, rules from its customers.
_FAULT = "CASE WHEN s_suppkey % 11 = 1 THEN 'json' WHEN s_suppkey % 11 = 2 THEN 'schema' WHEN s_suppkey % 11 = 3 THEN 'future_publication' WHEN s_suppkey % 11 = 4 THEN 'rule' WHEN s_suppkey % 11 = 5 THEN 'duplicate' WHEN s_suppkey % 11 = 6 THEN 'timestamp' END"


@query(
    f"SELECT s_suppkey AS file, {_FAULT} AS fault, CASE WHEN {_FAULT} IS NULL THEN 2 END AS rules, CASE WHEN {_FAULT} IS NULL THEN concat('Model ', s_suppkey) END AS label FROM supplier"
)
def s8_alias_catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, key = F.col("s_suppkey") % 11, F.col("s_suppkey").cast("string")
    rule = lambda name, since, basis: F.struct(F.lit("agent").alias("agent"), F.concat(F.lit("m_"), key, name).alias("key"), F.concat(F.lit("Model "), key).alias("displayName"), since.alias("effectiveFrom"), basis.alias("basis"))
    since = F.when(kind == 6, "2020-13-01T00:00:00Z").otherwise("2020-01-01T00:00:00Z")
    rules = F.array(rule(F.lit(""), since, F.when(kind == 4, "rumour").otherwise("catalogue")), rule(F.when(kind == 5, "").otherwise("-b"), F.lit("2020-01-01T00:00:00Z"), F.lit("catalogue")))
    published = F.when(kind == 3, "2024-06-01T00:00:00Z").otherwise("2023-06-01T00:00:00Z")
    body = F.to_json(F.struct(F.when(kind == 2, 2).otherwise(1).alias("schemaVersion"), F.lit("v1").alias("ruleVersion"), published.alias("publishedAt"), rules.alias("aliases")))
    files = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), F.when(kind == 1, F.concat(F.lit("["), body)).otherwise(body).alias("value"))
    good, bad = aliases.load_catalogues(files, NOW)
    read = good.groupBy("file").agg(F.lit(None).cast("string").alias("fault"), F.count("*").alias("rules"), F.max("label").alias("label"))
    return read.unionByName(bad.select("file", "fault", F.lit(None).cast("long").alias("rules"), F.lit(None).cast("string").alias("label")))


_RULES = """rules AS (
  SELECT p_brand AS agent, lower(p_type) AS key, CASE WHEN p_partkey % 3 = 0 THEN 'china' END AS provider_id, concat('L', p_size % 3) AS label, CAST(p_size % 7 AS BIGINT) * 100 AS from_ms,
    CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size % 7 AS BIGINT) * 100 + 100 * (1 + p_partkey % 9) END AS until_ms, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 5 AS INTEGER) END AS feed FROM part WHERE p_size % 4 = 0)"""


@query(
    f"""WITH {_RULES}, ranges AS (SELECT p_partkey AS id, p_type AS raw, p_brand AS agent, CASE WHEN p_partkey % 2 = 0 THEN 'China' END AS provider_id, CAST(p_partkey % 8 AS BIGINT) * 90 AS a, CAST(p_partkey % 8 AS BIGINT) * 90 + CAST(p_size AS BIGINT) * 8 AS z FROM part),
    met AS (SELECT r.id, r.a, r.z, l.feed, l.provider_id IS NOT NULL AS own, l.from_ms, l.label, coalesce(l.until_ms, 253402300800000) AS until FROM ranges r JOIN rules l ON l.key = lower(r.raw) AND l.agent = r.agent AND (l.provider_id IS NULL OR l.provider_id = lower(r.provider_id)) AND l.from_ms < r.z),
    g AS (SELECT id, a, z, feed, own, from_ms, min(label) AS low, max(label) AS high, min(until) AS until FROM met GROUP BY ALL),
    cuts AS (SELECT DISTINCT id, feed, a, z, greatest(from_ms, a) AS cut_at FROM g UNION SELECT DISTINCT id, feed, a, z, a FROM g),
    pieces AS (SELECT *, coalesce(lead(cut_at) OVER (PARTITION BY id, feed ORDER BY cut_at), z) AS ends FROM cuts),
    won AS (SELECT p.id, p.feed, p.cut_at, p.ends, arg_max(struct_pack(low := g.low, high := g.high, until := g.until), struct_pack(own := g.own, f := g.from_ms)) AS w FROM pieces p LEFT JOIN g ON g.id = p.id AND g.feed IS NOT DISTINCT FROM p.feed AND g.from_ms <= p.cut_at GROUP BY ALL),
    fed AS (SELECT id, feed, CASE WHEN bool_and(coalesce(w.low = w.high AND w.until >= ends, false)) AND count(DISTINCT w.low) = 1 THEN min(w.low) END AS label FROM won GROUP BY ALL),
    d AS (SELECT id, bool_or(feed IS NULL) AS has_own, max(label) FILTER (feed IS NULL) AS own_label, count(*) FILTER (feed IS NOT NULL AND label IS NULL) AS open, count(DISTINCT label) FILTER (feed IS NOT NULL) AS kinds, max(label) FILTER (feed IS NOT NULL) AS fed FROM fed GROUP BY 1)
    SELECT r.id, coalesce(CASE WHEN has_own THEN own_label WHEN open = 0 AND kinds = 1 THEN fed END, raw) AS label FROM ranges r LEFT JOIN d ON d.id = r.id AND r.a < r.z"""
)
def j5_u13_x3_alias_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of own and of four further catalogues over ranges of time, in hundredths of which rules begin."""
    parts = table(spark, sf_dir, "part")
    start = (F.col("p_size") % 7).cast("long") * 100
    rules = parts.where("p_size % 4 = 0").select(
        F.lower("p_brand").alias("agent"), F.lower("p_type").alias("key"), F.when(F.col("p_partkey") % 3 == 0, "china").alias("provider_id"), F.concat(F.lit("L"), F.col("p_size") % 3).alias("label"),
        start.alias("from_ms"), F.when(F.col("p_partkey") % 4 != 0, start + 100 * (1 + F.col("p_partkey") % 9)).alias("until_ms"), (F.col("p_partkey") % 5).alias("feed"),
    )
    feeds = [rules.where(F.col("feed") == k).drop("feed") for k in range(5)]
    first = (F.col("p_partkey") % 8).cast("long") * 90
    ranges = parts.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("raw"), F.col("p_brand").alias("agent"), F.when(F.col("p_partkey") % 2 == 0, "China").alias("provider_id"), first.alias("from_ms"), (first + F.col("p_size").cast("long") * 8).alias("to_ms"))
    return aliases.labels(ranges, aliases.candidates(*feeds)).select("id", "label")


@query(
    """WITH ids AS (SELECT DISTINCT concat(lower(n_name), CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '-cn' WHEN 2 THEN '-plan' ELSE '-eu' END) AS provider_id FROM customer JOIN nation ON c_nationkey = n_nationkey),
    names AS (SELECT DISTINCT lower(n_name) AS prefix FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 <> 0)
    SELECT provider_id FROM ids WHERE provider_id NOT LIKE '%-plan%' AND (provider_id IN (SELECT prefix FROM names) OR (suffix(provider_id, '-cn') AND left(provider_id, length(provider_id) - 3) IN (SELECT prefix FROM names)))"""
)
def a28_official_provider_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("name"))
    suffix = F.element_at(F.array(F.lit(""), F.lit("-cn"), F.lit("-plan"), F.lit("-eu")), (F.col("c_custkey") % 4 + 1).cast("int"))
    providers = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat("name", suffix).alias("provider_id"))
    canonical = F.when(F.col("s_suppkey") % 3 != 0, F.concat("name", F.lit("/model-"), "s_suppkey")).otherwise(F.concat(F.lit("model-"), "s_suppkey"))
    names = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(canonical.alias("canonical"))
    return aliases.official_ids(providers, names)


@query(
    r"""SELECT p_partkey, CASE WHEN p_type LIKE 'PROMO%' AND p_size % 3 < 2 THEN concat(k, '-latest') ELSE k END AS reference FROM (SELECT *, lower(replace(p_type, ' ', '-')) AS k FROM part)"""
)
def f3_catalogue_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue for each brand names the latest version of every type but the promotional ones."""
    parts = table(spark, sf_dir, "part")
    name = F.replace(F.lower("p_type"), F.lit(" "), F.lit("-"))
    model = F.struct(name.alias("id"), F.array(F.concat(name, F.lit("-latest"))).alias("aliases"))
    texts = parts.where("p_type not like 'PROMO%'").groupBy("p_brand").agg(F.to_json(F.struct(F.collect_set(model).alias("models"))).alias("json"))
    ending = F.when(F.col("p_size") % 3 == 0, "-latest").when(F.col("p_size") % 3 == 1, " _LATEST").otherwise("")
    rows = parts.select("p_partkey", F.concat("p_type", ending).alias("model"), F.lit(None).cast("string").alias("provider"))
    return aliases.reference_models(rows, "model", "provider", F.lit(0), aliases.catalogue_names(texts)).select("p_partkey", "reference")
