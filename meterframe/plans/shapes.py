"""Queries over the shapes of records: documents, caches, mutation logs, categories, placeholders, instants and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.operators import buckets
from meterframe.registry import query
from meterframe.sources import feeds
from meterframe.sources.usage import table

_CATEGORY = "CASE WHEN l_linenumber = 3 OR l_partkey % 10 = 0 OR l_suppkey % 8 = 0 THEN 'sub_agent' WHEN l_partkey % 13 = 0 THEN 'auxiliary' ELSE 'main' END"


@query(f"SELECT {_CATEGORY} AS category, l_linenumber, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY ALL")
def n10_call_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.when(F.col("l_partkey") % 10 == 0, F.concat(F.lit("s"), "l_orderkey"))
    path = F.concat(F.lit("projects/x/"), F.when(F.col("l_suppkey") % 8 == 0, "subagents/").otherwise(""), F.lit("log.jsonl"))
    purpose = F.when(F.col("l_partkey") % 13 == 0, "title").when(F.col("l_partkey") % 2 == 0, "turn")
    category = buckets.call_category(F.col("l_linenumber") == 3, parent, path, purpose)
    return table(spark, sf_dir, "lineitem").groupBy(category.alias("category"), "l_linenumber").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


@query(
    """SELECT CASE WHEN l_partkey % 37 = 0 THEN 'placeholder' WHEN l_partkey % 11 = 0 OR l_suppkey % 17 = 0 THEN 'required_missing' WHEN l_partkey % 41 = 0 THEN 'out_of_range' ELSE 'ok' END AS outcome,
    count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY 1"""
)
def n12_shape_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    counts = {"input": F.when(part % 11 != 0, F.when(part % 41 == 0, -1).otherwise(F.floor("l_quantity"))), "output": F.when(supplier % 17 != 0, F.floor(F.col("l_extendedprice")))}
    fault = buckets.shape_fault(F.when(part % 37 == 0, "<synthetic>").otherwise("a-model"), counts)
    return table(spark, sf_dir, "lineitem").groupBy(F.coalesce(fault, F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


@query("SELECT event_id, CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 5 = 2 THEN epoch_us(ts) // 1000000 * 1000 ELSE epoch_us(ts) // 1000 END AS at_ms FROM events")
def n14_instant_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO text, milliseconds, seconds, nanoseconds, and pairs of seconds and nanoseconds; some instants are implausible."""
    us = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz"))
    us = F.when(F.col("event_id") % 31 == 0, F.lit(631_152_000_000_000).cast("long")).otherwise(us)
    form, whole = F.col("event_id") % 5, F.call_function("div", us, F.lit(1_000_000).cast("long"))
    iso = F.when(form == 0, F.concat(F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
    epoch = F.when(form == 1, F.call_function("div", us, F.lit(1000).cast("long"))).when(form == 2, whole).when(form == 3, us * 1000)
    at = buckets.instant(iso, epoch, F.when(form == 4, whole), F.when(form == 4, (us % 1_000_000) * 1000))
    return table(spark, sf_dir, "events").select("event_id", at.alias("at_ms"))


@query(
    """SELECT l_suppkey, CASE WHEN l_partkey % 2 = 0 THEN 'reported' ELSE 'estimated' END AS kind, count(*) AS n, CAST(sum(CAST(floor(l_tax * 1000000 + 0.5) AS BIGINT)) AS BIGINT) AS micro FROM lineitem WHERE l_partkey % 9 <> 0 GROUP BY ALL
    UNION ALL SELECT l_suppkey, NULL, count(*), NULL FROM lineitem WHERE l_partkey % 9 = 0 GROUP BY l_suppkey"""
)
def n16_cost_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = F.when(F.col("l_partkey") % 9 == 0, F.when(F.col("l_partkey") % 2 == 0, -1.0).otherwise(float("nan"))).otherwise(F.col("l_tax"))
    units, kind = buckets.cost_kind(cost, F.col("l_partkey") % 2 == 0)
    return table(spark, sf_dir, "lineitem").select("l_suppkey", kind.alias("kind"), units.alias("units")).groupBy("l_suppkey", "kind").agg(F.count("*").alias("n"), F.sum("units").alias("micro"))


@query("SELECT event_type, count(*) AS records, count(*) FILTER (event_id % 7 = 0) AS rejected, CAST(sum(CASE WHEN event_id % 7 <> 0 THEN user_id END) AS BIGINT) AS tokens FROM events GROUP BY 1")
def n8_attribute_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record with a count out of range is rejected whole, not read without it."""
    tokens = F.when(F.col("event_id") % 7 == 0, F.lit("-1")).otherwise(F.col("user_id").cast("string"))
    spans = table(spark, sf_dir, "events").select("event_type", F.create_map(F.lit("tokens"), tokens).alias("attributes"), F.create_map(F.lit("tokens"), F.lit("5")).alias("resource"))
    rejected = feeds.attribute_fault(("tokens",))
    return spans.groupBy("event_type").agg(F.count("*").alias("records"), F.count_if(rejected).alias("rejected"), F.sum(F.when(~rejected, feeds.attribute(("tokens",)))).alias("tokens"))


@query(
    """SELECT conv_id, role, CAST(count(*) AS BIGINT) AS messages, CAST(sum(length(text)) AS BIGINT) AS tokens, CAST(max(turn) AS BIGINT) AS last_turn, NULL AS fault FROM conversations WHERE conv_id % 10 <> 3 GROUP BY ALL
    UNION ALL SELECT conv_id, NULL, NULL, NULL, NULL, 'not_a_document' FROM conversations WHERE conv_id % 10 = 3 GROUP BY conv_id"""
)
def s2_session_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each conversation, of its messages with their counts; some documents are cut off."""
    message = F.struct(F.col("turn").alias("id"), "role", F.struct(F.char_length("text").alias("input")).alias("tokens"))
    texts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.lit("s").alias("sessionId"), F.sort_array(F.collect_list(message)).alias("messages"))).alias("value"))
    files = texts.select(F.col("conv_id").alias("file"), F.when(F.col("conv_id") % 10 == 3, F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value")).alias("value"))
    rows, bad = feeds.documents(files, "sessionId string, messages array<struct<id:bigint,role:string,tokens:struct<input:bigint>>>", "messages")
    read = rows.groupBy(F.col("file").alias("conv_id"), F.col("message.role").alias("role")).agg(F.count("*").alias("messages"), F.sum("message.tokens.input").alias("tokens"), F.max("message.id").alias("last_turn"), F.lit(None).cast("string").alias("fault"))
    none = F.lit(None).cast("long")
    return read.unionByName(bad.select(F.col("file").alias("conv_id"), F.lit(None).cast("string").alias("role"), none.alias("messages"), none.alias("tokens"), none.alias("last_turn"), "fault"))


@query(
    """WITH q AS (SELECT c_custkey, unnest(['chat', 'completions', 'premium']) AS quota_id FROM customer)
    SELECT c_custkey AS file, concat('plan-', c_custkey % 3) AS plan, quota_id, CAST(c_custkey % 300 * 1000 AS BIGINT) AS entitlement,
      CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 200 * 1000 + 500 AS BIGINT) END AS remaining,
      CASE WHEN quota_id <> 'chat' AND c_custkey % 7 <> 0 AND c_custkey % 300 > 0 AND c_custkey % 200 * 1000 + 500 <= c_custkey % 300 * 1000 THEN CAST(c_custkey % 300 * 1000 - c_custkey % 200 * 1000 - 500 AS BIGINT) END AS used,
      quota_id = 'chat' AS unlimited, CASE WHEN c_custkey % 2 = 0 THEN CAST(1704067200000 AS BIGINT) END AS observed_ms FROM q WHERE NOT (quota_id = 'completions' AND c_custkey % 5 = 0)"""
)
def s9_quota_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cache text for each customer, with comments and an older entry beside the one that counts."""
    key = "c_custkey"
    left = f"if({key} % 7 = 0, '-5', concat({key} % 200, '.5'))"
    snapshot = lambda name, unlimited, has: f"""concat('"{name}":{{"entitlement":', {key} % 300, ',"quota_remaining":', {left}, ',"unlimited":{unlimited},"has_quota":', {has}, if({key} % 2 = 0, ',"timestamp_utc":"2024-01-01T00:00:00Z"', ''), '}}')"""
    held = f"""concat({snapshot('chat', 'true', "'true'")}, ',', {snapshot('completions', 'false', f"if({key} % 5 = 0, 'false', 'true')")}, ',', {snapshot('premium', 'false', "'true'")})"""
    text = f"""concat('// a comment\\n {{"userCache":{{"old":{{"retrievedAt":"2023-01-01T00:00:00Z","response":{{"copilot_plan":"old"}}}},\\n  // another\\n"new":{{"retrievedAt":"2024-02-01T00:00:00Z","response":{{"copilot_plan":"plan-', {key} % 3, '","quota_snapshots":{{', {held}, '}}}}}}}}}}')"""
    return feeds.quota_cache(table(spark, sf_dir, "customer").select(F.col(key).alias("file"), F.expr(text).alias("value")), "userCache")


@query(
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line FROM events),
    s AS (SELECT user_id, max(line) FILTER (event_type = 'signup') AS begun, count(*) FILTER (event_type = 'purchase') AS sets FROM o GROUP BY 1),
    c AS (SELECT s.user_id, begun, max(line) FILTER (event_type = 'error' AND line > begun) AS cut FROM s JOIN o USING (user_id) GROUP BY 1, 2)
    SELECT c.user_id AS file, count(*) FILTER (line >= coalesce(cut, begun + 1) AND event_type IN ('click', 'view', 'error') AND line > begun) AS requests,
      CAST(sum(CASE WHEN line >= coalesce(cut, begun + 1) AND event_type IN ('click', 'view', 'error') AND line > begun THEN event_id END) AS BIGINT) AS ids,
      arg_max(event_id, line) FILTER (event_type = 'purchase' AND line > begun) AS last_set, count(*) FILTER (line < (SELECT min(x.line) FROM o x WHERE x.user_id = c.user_id AND x.event_type = 'signup')) AS faults
    FROM c JOIN o USING (user_id) WHERE begun IS NOT NULL GROUP BY 1, begun, cut"""
)
def u4_mutation_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each user: sign-ups begin anew, errors cut the list and push, purchases set a value, others push."""
    item = F.array(F.struct(F.col("event_id").alias("id")))
    push = F.array(F.lit("requests"))
    entry = (
        F.when(F.col("event_type") == "signup", F.lit('{"kind":0,"v":{"requests":[],"last":{}}}'))
        .when(F.col("event_type") == "error", F.to_json(F.struct(F.lit(2).alias("kind"), push.alias("k"), item.alias("v"), F.lit(0).alias("i"))))
        .when(F.col("event_type") == "purchase", F.to_json(F.struct(F.lit(1).alias("kind"), F.array(F.lit("last"), F.lit("id")).alias("k"), F.col("event_id").alias("v"))))
        .otherwise(F.to_json(F.struct(F.lit(2).alias("kind"), push.alias("k"), item.alias("v"))))
    )
    lines = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), entry.alias("value"))
    from pyspark.sql import Window

    numbered = lines.withColumn("line", F.row_number().over(Window.partitionBy("user_id").orderBy("at")))
    state = feeds.replayed(numbered, "user_id", "line").select("file", "faults", F.from_json("state", "requests array<struct<id:bigint>>, last struct<id:bigint>").alias("s"))
    ids = F.expr("aggregate(s.requests, CAST(NULL AS BIGINT), (a, x) -> coalesce(a, 0) + x.id)")
    return state.where("s is not null").select("file", F.size("s.requests").cast("long").alias("requests"), ids.alias("ids"), F.col("s.last.id").alias("last_set"), "faults")
