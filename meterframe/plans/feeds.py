"""Feed queries: JSON columns, journals, matches against ledgers, and records that upgrade others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.registry import query
from meterframe.sources import feeds
from meterframe.sources.stored import logs
from meterframe.sources.usage import table

_LINE = "CASE WHEN event_id % 17 = 0 THEN concat('{', props) WHEN event_id % 19 = 0 THEN concat('[', props, ']') WHEN event_id % 23 = 0 THEN '' ELSE props END"


@query(
    f"""WITH l AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id, {_LINE} AS value, props FROM events),
    p AS (SELECT *, row_number() OVER w AS line, CAST(coalesce(sum(octet_length(encode(value)) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM l WINDOW w AS (PARTITION BY day ORDER BY event_id))
    SELECT day, line, "offset", CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 THEN 'not_an_object' END AS fault, CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM p WHERE value <> ''"""
)
def s1_s4_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log of JSON lines for each day: every record, and every bad line, by its line and offset."""
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("day"), "event_id", F.expr(_LINE).alias("value"))
    place = logs(spark, sf_dir, "events", ("events",), rows, "day", ["event_id"])
    good, bad = feeds.read_lines(spark, place, "k bigint")
    day = F.regexp_extract("file", "day=([^/]+)", 1).alias("day")
    return good.select(day, "line", "offset", F.lit(None).cast("string").alias("fault"), "k").unionByName(bad.select(day, "line", "offset", "fault", F.lit(None).cast("long").alias("k")))


_ROW = "CASE WHEN event_id % 13 = 0 THEN '{\"k\": \"7\"}' WHEN event_id % 17 = 0 THEN '{\"n\": 1}' WHEN event_id % 19 = 0 THEN '[1]' WHEN event_id % 23 = 0 THEN '{\"k\": null}' WHEN event_id % 29 = 0 THEN '{\"k\": 3, \"n\": true}' ELSE props END"


@query(
    """SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'wrong_type:k' WHEN event_id % 17 = 0 THEN 'required_missing:k' WHEN event_id % 19 = 0 THEN 'not_an_object' WHEN event_id % 23 = 0 THEN 'required_missing:k' WHEN event_id % 29 = 0 THEN 'wrong_type:n' END AS fault,
    CASE WHEN event_id % 13 = 0 OR event_id % 17 = 0 OR event_id % 19 = 0 OR event_id % 23 = 0 OR event_id % 29 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events"""
)
def s4_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as an application's table, its JSON column read by type; nothing has been read before."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_ROW).alias("data"))
    good, bad = feeds.table_scan(rows, "event_id", None, "data", {"k": ("$.k", ("BIGINT",), True), "n": ("$.n", ("DOUBLE", "BIGINT", "DECIMAL"), False)})
    return good.select("event_id", F.lit(None).cast("string").alias("fault"), "k").unionByName(bad.select("event_id", "fault", F.lit(None).cast("long").alias("k")))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'client' ELSE 'server' END AS kind, epoch_us(ts) // 1000 AS start_ms, CASE WHEN event_id % 3 = 2 THEN NULL ELSE user_id END AS tokens FROM events")
def s3_n8_span_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz"))
    third, user = F.col("event_id") % 3, F.col("user_id").cast("string")
    name = F.when(third == 0, "gen_ai.usage.input_tokens").otherwise("input_tokens")
    wrapped = F.struct(F.when(third != 0, user).alias("intValue"), F.when(third == 0, user).alias("stringValue"))
    span = F.struct(F.lit("t").alias("traceId"), F.col("event_id").cast("string").alias("spanId"), F.lit("call").alias("name"), F.when(F.col("event_id") % 2 == 0, 3).otherwise(2).alias("kind"), (us * 1000).cast("string").alias("startTimeUnixNano"), F.array(F.struct(F.when(third == 2, "secret").otherwise(name).alias("key"), wrapped.alias("value"))).alias("attributes"))
    body = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")))
    found = feeds.spans(table(spark, sf_dir, "events").select(body.alias("body")), ("gen_ai.usage.input_tokens", "input_tokens"))
    return found.select(F.col("spanId").cast("long").alias("event_id"), "kind", "start_ms", feeds.attribute(("gen_ai.usage.input_tokens", "input_tokens")).alias("tokens"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(t, '^[=+@-]') THEN concat('''', t) ELSE t END AS cell FROM (SELECT p_partkey, concat(CASE p_partkey % 5 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@' ELSE '' END, p_name) AS t FROM part)")
def s10_guarded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.when(F.col("p_partkey") % 5 == 0, "=").when(F.col("p_partkey") % 5 == 1, "-").when(F.col("p_partkey") % 5 == 2, "@").otherwise(""), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", feeds.guarded(text).alias("cell"))


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber = 1)")
def j11_ledger_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that no ledger entry covers."""
    ledger = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(ledger, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'A' AND EXISTS (SELECT 1 FROM lineitem x WHERE x.l_returnflag = 'R' AND x.l_orderkey = l.l_orderkey AND x.l_linenumber = l.l_linenumber) THEN 'identity_upgraded' END AS reason FROM lineitem l"""
)
def j16_identity_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record known by a part of its identity is excluded once the whole identity has been accepted."""
    lines = table(spark, sf_dir, "lineitem")
    whole = lines.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber").distinct().withColumn("whole", F.lit(True))
    reason = F.when((F.col("l_returnflag") == "A") & F.col("whole"), "identity_upgraded")
    return lines.join(whole, ["l_orderkey", "l_linenumber"], "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", reason.alias("reason"))


_RECORD = "CASE l_linenumber WHEN 7 THEN 'session.summary' WHEN 6 THEN 'usage.snapshot' WHEN 5 THEN 'model.echo' ELSE 'model.request' END"
_EXCLUDED = {"session.summary": "summary", "usage.snapshot": "cumulative_snapshot", "model.echo": "echo"}


@query(
    f"""WITH typed AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_RECORD} AS record FROM lineitem),
    marked AS (SELECT *, CASE record WHEN 'session.summary' THEN 'summary' WHEN 'usage.snapshot' THEN 'cumulative_snapshot' WHEN 'model.echo' THEN 'echo'
      ELSE CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') THEN 'held' WHEN row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) > 1 THEN 'repeated' ELSE 'added' END END AS outcome FROM typed)
    SELECT record, outcome, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM marked GROUP BY 1, 2"""
)
def n11_n18_insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record: left out by its type, held by the target already, a repeat of a request id, or added."""
    held = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")).distinct()
    typed = table(spark, sf_dir, "lineitem").withColumn("record", F.expr(_RECORD))
    marked = feeds.insert_or_ignore(typed, "record", _EXCLUDED, held, ["l_orderkey"], ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])
    return marked.groupBy("record", "outcome").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


@query("SELECT p_partkey, CASE WHEN p_size % 10 < 7 THEN 'known_version' ELSE 'latest_fallback' END AS basis FROM part")
def n17_version_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame([(i,) for i in range(7)], "version long").withColumn("known", F.lit(True))
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 10).cast("long").alias("version"))
    return parts.join(registry, "version", "left").select("p_partkey", F.when(F.col("known"), "known_version").otherwise("latest_fallback").alias("basis"))


@query(
    """WITH e AS (SELECT user_id, event_type, event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS side, CASE WHEN event_id % 3 <> 2 THEN value + side END AS value, CASE WHEN event_id % 3 <> 1 THEN props END AS props FROM events)
    SELECT user_id, event_type, arg_max(value, struct_pack(side, event_id)) FILTER (value IS NOT NULL) AS value, arg_max(props, struct_pack(side, event_id)) FILTER (props IS NOT NULL) AS props, count(*) FILTER (side = 0) AS snapshots, count(*) FILTER (side = 1) AS entries FROM e GROUP BY ALL"""
)
def u5_snapshot_and_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the events are snapshots; the others journal entries that set one field each, by message id."""
    side = F.when(F.col("event_id") % 3 == 0, 0).otherwise(1)
    entries = table(spark, sf_dir, "events").select(
        "user_id", "event_type", "event_id", side.alias("side"), F.when(F.col("event_id") % 3 != 2, F.col("value") + side).alias("value"), F.when(F.col("event_id") % 3 != 1, F.col("props")).alias("props")
    )
    return feeds.overlaid(entries, ["user_id", "event_type"], "side", ["event_id"], ["value", "props"])
