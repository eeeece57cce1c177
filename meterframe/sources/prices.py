"""Price books: loading and validating tariff rows, the binding to the part table, and community catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterframe.functions.scalars import usd_to_hundredths

RATES = ("input_rate", "read_rate", "write_rate", "output_rate")
_GROUP = "p_type, p_size % 2, p_partkey % 4, p_partkey % 3, p_size % 5 < 2"
BOUND = {
    "price_id": "concat('p', min(p_partkey))",
    "provider": "CASE p_partkey % 4 WHEN 0 THEN 'China' WHEN 1 THEN 'FRANCE' ELSE 'vendor' END",
    "model": "CASE p_size % 2 WHEN 0 THEN p_type ELSE concat(lower(p_type), '-v1') END",
    "region": "CASE p_partkey % 4 WHEN 0 THEN 'global' WHEN 1 THEN 'eu' WHEN 2 THEN 'global' ELSE 'cn' END",
    "channel": "CASE p_partkey % 4 WHEN 3 THEN 'plan' ELSE 'api' END",
    "official": "p_partkey % 4 >= 2",
    "currency": "CASE WHEN p_partkey % 4 = 3 THEN 'CNY' ELSE 'USD' END",
    "threshold": "CAST(p_partkey % 3 * 2500 AS BIGINT)",
    "priority": "CASE WHEN p_size % 5 < 2 THEN 0 ELSE 1 END",
    "from_ms": "CASE WHEN p_size % 5 < 2 THEN CAST(880000000000 AS BIGINT) ELSE CAST(800000000000 AS BIGINT) END",
    "to_ms": "CASE WHEN p_size % 5 < 2 THEN NULL ELSE CAST(930000000000 AS BIGINT) END",
    "input_rate": "CAST(floor(min(p_retailprice) * 100) AS BIGINT)",
    "read_rate": "CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE CAST(floor(min(p_retailprice) * 10) AS BIGINT) END",
    "write_rate": "CAST(floor(min(p_retailprice) * 125) AS BIGINT)",
    "output_rate": "CAST(floor(max(p_retailprice) * 500) AS BIGINT)",
}


def price_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tariff row for each model spelling, vendor, tier and snapshot that the part table gives."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    keys = {"p_type": "p_type", "two": "p_size % 2", "four": "p_partkey % 4", "three": "p_partkey % 3", "old": "p_size % 5 < 2"}
    grouped = parts.groupBy(*[F.expr(e).alias(k) for k, e in keys.items()]).agg(F.min("p_partkey").alias("p"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))

    def bound(text: str) -> str:
        for old, new in (("min(p_partkey)", "p"), ("min(p_retailprice)", "low"), ("max(p_retailprice)", "high"), ("p_partkey % 4", "four"), ("p_partkey % 3", "three"), ("p_size % 5 < 2", "old"), ("p_size % 2", "two")):
            text = text.replace(old, new)
        return text

    return grouped.select(*[F.expr(bound(e)).alias(c) for c, e in BOUND.items()])


PRICES = f"prices AS (SELECT {', '.join(f'{e} AS {c}' for c, e in BOUND.items())} FROM part GROUP BY {_GROUP})"


def overlaps(prices: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows whose validity begins before an earlier row of the same key has ended."""
    order = Window.partitionBy(*keys).orderBy("from_ms", "price_id").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.coalesce("to_ms", F.lit(1 << 62))).over(order)
    return prices.withColumn("reach", reach).where(F.col("from_ms") < F.col("reach"))


def faults(prices: DataFrame, currencies: tuple[str, ...] = ("USD", "CNY", "EUR")) -> DataFrame:
    """(price_id, fault) of the rows that a price book must not have."""
    negative = F.lit(False)
    for rate in RATES:
        negative |= F.coalesce(F.col(rate) < 0, F.lit(False))
    single = prices.select("price_id", F.when(negative, "negative_rate").when(~F.col("currency").isin(*currencies), "unknown_currency").when(F.col("to_ms") <= F.col("from_ms"), "empty_interval").when(F.col("threshold") < 0, "negative_threshold").alias("fault")).where("fault is not null")
    repeated = prices.groupBy("price_id").count().where("count > 1").select("price_id", F.lit("repeated_id").alias("fault"))
    crossing = overlaps(prices, ("provider", "model", "region", "channel", "threshold", "priority")).select("price_id", F.lit("overlap").alias("fault"))
    return single.unionByName(repeated).unionByName(crossing)


_COST = "struct<input:double,output:double,cache_read:double,cache_write:double,tiers:array<struct<size:bigint,input:double,output:double>>>"


def community_prices(catalogue: DataFrame, providers: dict[str, str]) -> DataFrame:
    """Tariff rows of a catalogue whose JSON text maps providers to models to costs in US dollars a million tokens.

    ``providers`` gives the canonical provider of each accepted one; a ``-cn`` name has the region cn. The base price is the
    tier of threshold 0; of several tiers of one size the first wins.
    """
    schema = f"map<string,struct<models:map<string,struct<cost:{_COST}>>>>"
    book = catalogue.select(F.explode(F.from_json("json", schema)).alias("provider", "held"))
    names = F.create_map(*[F.lit(x) for kv in providers.items() for x in kv])
    known = book.withColumn("canonical", F.element_at(names, F.col("provider"))).where("canonical is not null")
    models = known.select("provider", "canonical", F.explode("held.models").alias("model", "m")).where("m.cost is not null")
    base = F.struct(F.lit(0).cast("long").alias("size"), F.col("m.cost.input").alias("input"), F.col("m.cost.output").alias("output"))
    tiers = models.select("canonical", "provider", "model", "m", F.posexplode(F.concat(F.array(base), F.coalesce("m.cost.tiers", F.array().cast(T.ArrayType(T.StructType([T.StructField("size", T.LongType()), T.StructField("input", T.DoubleType()), T.StructField("output", T.DoubleType())])))))).alias("turn", "tier"))
    first = F.row_number().over(Window.partitionBy("provider", "model", "tier.size").orderBy("turn"))
    kept = tiers.withColumn("n", first).where("n = 1")
    region = F.when(F.col("provider").endswith("-cn"), "cn").otherwise("global")
    return kept.select(
        F.col("canonical").alias("provider"), "model", region.alias("region"), F.col("tier.size").alias("threshold"), usd_to_hundredths(F.col("tier.input")).alias("input_rate"), usd_to_hundredths(F.col("tier.output")).alias("output_rate"),
        usd_to_hundredths(F.col("m.cost.cache_read")).alias("read_rate"), usd_to_hundredths(F.col("m.cost.cache_write")).alias("write_rate"),
    )
