"""Queries over ordered records: counters, context, boundaries, echoes, reconciliation and session trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterframe.operators import ordered
from meterframe.registry import query
from meterframe.sources.usage import table

_COUNT = "CAST(floor(value) AS BIGINT) % 5"
COUNTER = f"""counter AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS at_s, event_type = 'signup' AS reset,
  CAST(CASE WHEN event_type = 'error' THEN 1 WHEN event_type = 'signup' THEN {_COUNT} ELSE 10 * (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)) + {_COUNT} END AS BIGINT) AS value, event_type, ts FROM events)"""


def counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter by user that mostly rises: sign-ups start it anew, errors report a lower value."""
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    small = F.floor("value") % 5
    value = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", small).otherwise(10 * turn + small)
    at = F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", at.alias("at"), (F.col("event_type") == "signup").alias("reset"), value.cast("long").alias("value"), "event_type", "ts")


@query(
    f"""WITH RECURSIVE {COUNTER}, c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_s, event_id) AS turn FROM counter),
    f AS (SELECT user_id, event_id, turn, at_s AS base_at, value AS base, 'first' AS outcome, value AS amount FROM c WHERE turn = 1
      UNION ALL SELECT user_id, event_id, turn, CASE WHEN keeps THEN base_at ELSE at_s END, CASE WHEN keeps THEN base ELSE value END, outcome, CASE WHEN outcome = 'reset' THEN value WHEN outcome = 'delta' THEN value - base END FROM (
        SELECT *, outcome IN ('out_of_order', 'regression') OR (at_s = base_at AND outcome = 'delta') AS keeps FROM (
          SELECT c.user_id, c.event_id, c.turn, c.at_s, c.value, f.base_at, f.base, CASE WHEN c.at_s = f.base_at AND c.value <> f.base THEN 'out_of_order' WHEN c.at_s = f.base_at THEN 'delta' WHEN c.reset THEN 'reset' WHEN c.value >= f.base THEN 'delta' ELSE 'regression' END AS outcome
          FROM f JOIN c ON c.user_id = f.user_id AND c.turn = f.turn + 1)))
    SELECT user_id, event_id, outcome, amount FROM f"""
)
def w2_t8_counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.counter_deltas(counter(spark, sf_dir), "user_id", "at", "value", "reset", "event_id")


@query(
    f"""WITH {COUNTER}, l AS (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE value % 7 END AS last_call FROM counter),
    g AS (SELECT *, lag(value) OVER w AS before, lag(last_call) OVER w AS seen FROM l WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, CASE WHEN before IS NULL OR value > before THEN CASE WHEN last_call > 0 THEN 'new_call' ELSE 'no_evidence' END
      WHEN value = before THEN CASE WHEN last_call IS DISTINCT FROM seen AND coalesce(last_call > 0, false) THEN CASE WHEN event_id % 2 = 0 THEN 'compaction_echo' ELSE 'new_call' END ELSE 'duplicate_report' END
      ELSE CASE WHEN last_call > 0 AND last_call IS DISTINCT FROM seen THEN 'new_call' ELSE 'no_evidence' END END AS verdict FROM g"""
)
def w3_last_call_echoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = counter(spark, sf_dir).withColumn("last_call", F.when(F.col("event_type") != "error", F.col("value") % 7))
    return ordered.echoes(rows, "user_id", ["ts", "event_id"], "value", "last_call", F.col("event_id") % 2 == 0).select("event_id", "verdict")


@query(
    """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN props END IGNORE NULLS) OVER w AS context, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER w AS parent
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def w4_carried_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    setters = {"context": F.when(F.col("event_type") == "signup", F.col("props")), "parent": F.when(F.col("event_type") == "error", F.col("event_id"))}
    return ordered.carried(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], setters).select("event_id", "context", "parent")


_STEPS = "steps AS (SELECT *, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS step FROM events)"


@query(f"WITH {_STEPS} SELECT event_id, step FROM steps")
def w5_step_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.numbered(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "step")


@query(
    f"""WITH {_STEPS} SELECT user_id, step, arg_max(value, struct_pack(ts, event_id)) AS sample, count(*) AS samples, step < max(step) OVER (PARTITION BY user_id) AS final FROM steps GROUP BY user_id, step"""
)
def w6_latest_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = ordered.numbered(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    final = F.col("step") < F.max("step").over(Window.partitionBy("user_id"))
    return ordered.latest_samples(steps, ["user_id", "step"], ["ts", "event_id"], F.col("value"), final)


@query(
    f"""WITH {COUNTER}, d AS (SELECT user_id, CAST(sum(value % 11) AS BIGINT) AS detail FROM counter WHERE event_type <> 'signup' GROUP BY 1), t AS (SELECT user_id, CAST(sum(value % 11) + CASE WHEN user_id % 3 = 0 THEN user_id ELSE 0 END AS BIGINT) AS native FROM counter GROUP BY user_id)
    SELECT *, CASE WHEN detail IS NULL THEN 'no_detail' WHEN gap = 0 THEN 'match' WHEN gap > 0 THEN 'missing' ELSE 'excess' END AS verdict FROM (
      SELECT user_id, native, detail, carried, native - coalesce(detail, 0) - carried AS gap FROM (SELECT *, CASE WHEN user_id % 2 = 0 AND user_id % 3 = 0 THEN user_id ELSE 0 END AS carried FROM t) LEFT JOIN d USING (user_id))"""
)
def a19_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = counter(spark, sf_dir)
    totals = seen.groupBy("user_id").agg((F.sum(F.col("value") % 11) + F.when(F.col("user_id") % 3 == 0, F.col("user_id")).otherwise(0)).cast("long").alias("native"))
    totals = totals.withColumn("carried", F.when((F.col("user_id") % 2 == 0) & (F.col("user_id") % 3 == 0), F.col("user_id")))
    return ordered.reconcile(seen.where("event_type <> 'signup'").select("user_id", (F.col("value") % 11).alias("amount")), totals, "user_id")


@query(
    f"""WITH {_STEPS}, k AS (SELECT user_id, step, arg_max(value, struct_pack(ts, event_id)) AS sample FROM steps GROUP BY ALL),
    r AS (SELECT user_id, step, arg_max(value, struct_pack(ts, event_id)) AS sample FROM steps WHERE event_type <> 'view' AND step % 7 <> 2 GROUP BY ALL)
    SELECT user_id, step, sample, 'verified' AS status FROM r UNION ALL SELECT user_id, step, sample, 'excluded' FROM k WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = k.user_id AND r.step = k.step)"""
)
def w6_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rewrite of the log has lost views and some steps: the keys that are gone are excluded, not deleted."""
    steps = ordered.numbered(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    latest = lambda rows: ordered.latest_samples(rows, ["user_id", "step"], ["ts", "event_id"], F.col("value"), F.lit(True)).select("user_id", "step", "sample")
    return ordered.tombstones(latest(steps), latest(steps.where("event_type <> 'view' AND step % 7 <> 2")), ["user_id", "step"])


_PARENT = "CASE WHEN turn = 0 THEN NULL WHEN turn % 5 = 3 AND turn >= 2 THEN turn - 2 ELSE turn - 1 END"


@query(
    f"""WITH RECURSIVE nodes AS (SELECT DISTINCT conv_id, turn, {_PARENT} AS parent FROM conversations), walk AS (SELECT conv_id, max(turn) AS turn, 0 AS depth FROM nodes GROUP BY 1
      UNION ALL SELECT w.conv_id, n.parent, depth + 1 FROM walk w JOIN nodes n ON n.conv_id = w.conv_id AND n.turn = w.turn JOIN nodes p ON p.conv_id = n.conv_id AND p.turn = n.parent)
    SELECT conv_id, turn, CAST(depth AS BIGINT) AS depth FROM walk"""
)
def u3_active_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_PARENT).alias("parent")).distinct()
    return ordered.active_path(nodes, "conv_id", "turn", "parent", "turn")
