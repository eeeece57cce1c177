"""Merge queries: versions by identity, upserts, source authority, packages and quota histories."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.functions.scalars import content_hash
from meterframe.operators import merging
from meterframe.registry import query
from meterframe.sources import stored
from meterframe.sources.usage import EVENTS, ZONE, table, usage_events

_CONTENT = ("record_kind", "input_total", "output_total", "session_id")
_MD5 = "md5(concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in _CONTENT) + "))"
_KEYS = ["source_instance_id", "source_record_key"]
_ORDER = ["occurred_at_ms", "part_key", "supplier_key"]
VERSIONS = f"WITH RECURSIVE {EVENTS}, versions AS (SELECT *, {_MD5} AS content FROM events_)"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_events(spark, sf_dir).withColumn("content", content_hash(list(_CONTENT)))


_BOTH = "s.source_revision IS NOT NULL AND v.source_revision IS NOT NULL"
_HIGHER = f"CASE WHEN {_BOTH} THEN v.source_revision > s.source_revision ELSE v.lifecycle_rank > s.lifecycle_rank END"
_EQUAL = f"CASE WHEN {_BOTH} THEN v.source_revision = s.source_revision ELSE v.lifecycle_rank = s.lifecycle_rank END"


_ARBITRATED = (
    VERSIONS
    + f""", v0 AS (SELECT *, row_number() OVER w AS turn, count(*) OVER (PARTITION BY source_instance_id, source_record_key) AS n FROM versions
      WINDOW w AS (PARTITION BY source_instance_id, source_record_key ORDER BY occurred_at_ms, part_key, supplier_key, source_revision NULLS FIRST, lifecycle_rank, content)),
    s AS (SELECT source_instance_id, source_record_key, turn, n, part_key, source_revision, lifecycle_rank, content, false AS conflict, 0 AS replaced FROM v0 WHERE turn = 1
      UNION ALL SELECT s.source_instance_id, s.source_record_key, v.turn, s.n, CASE WHEN {_HIGHER} THEN v.part_key ELSE s.part_key END, CASE WHEN {_HIGHER} THEN v.source_revision ELSE s.source_revision END,
        CASE WHEN {_HIGHER} THEN v.lifecycle_rank ELSE s.lifecycle_rank END, CASE WHEN {_HIGHER} THEN v.content ELSE s.content END,
        CASE WHEN {_HIGHER} THEN false ELSE s.conflict OR ({_EQUAL} AND v.content <> s.content) END, s.replaced + CASE WHEN {_HIGHER} THEN 1 ELSE 0 END
      FROM s JOIN v0 v ON v.source_instance_id = s.source_instance_id AND v.source_record_key = s.source_record_key AND v.turn = s.turn + 1)
    SELECT source_instance_id, source_record_key, n AS versions, part_key, source_revision, lifecycle_rank, content, conflict, replaced FROM s WHERE turn = n"""
)


@query(_ARBITRATED)
def w1_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merging.arbitrate(versions(spark, sf_dir), _KEYS, _ORDER)
    return found.select(*_KEYS, "versions", "part_key", "source_revision", "lifecycle_rank", "content", "conflict", "replaced")


@query(_ARBITRATED)
def t2_t3_merged_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions in two batches, later ones of an identity before earlier ones, merged into a stored table by month; the second batch twice."""
    from meterframe.streaming import ingest
    from meterframe.llm.shared import removed
    from meterframe.streaming.versions import Versions, shuffles_removed

    rows = versions(spark, sf_dir).select(*_KEYS, *_ORDER, "source_revision", "lifecycle_rank", "content")
    place = f"{stored.folder(spark)}/meterframe-versions/{uuid.uuid4().hex}"
    table = Versions(spark, place, _KEYS, _ORDER, F.trunc(ingest.local_day(ZONE), "month"))
    with shuffles_removed(spark):
        rows.write.option("compression", "zstd").parquet(f"{place}/rows")  # a merge reads them several times
    rows = spark.read.parquet(f"{place}/rows")
    part = F.pmod(F.col("part_key"), F.lit(3))
    for batch in (rows.where(part == 2), rows.where(part < 2), rows.where(part < 2)):
        table.merge(batch)
    removed(spark, f"{place}/rows")
    table.vacuum(keep=1)
    return table.current().select(*_KEYS, "versions", "part_key", "source_revision", "lifecycle_rank", "content", "conflict", "replaced")


_ONE = "QUALIFY row_number() OVER (PARTITION BY source_instance_id, source_record_key ORDER BY occurred_at_ms, part_key, supplier_key) = 1"
_SIDE = "SELECT source_instance_id, source_record_key, source_revision, lifecycle_rank, content, occurred_at_ms FROM versions WHERE supplier_key % 2 = {0} " + _ONE
_N = {"s.": "o.", "v.": "n."}


def _side(rows: DataFrame, odd: int) -> DataFrame:
    kept = merging.first_occurrence(rows.where(F.col("supplier_key") % 2 == odd), ["group_key", "line"], _ORDER)
    return kept.select("group_key", "line", "source_revision", "lifecycle_rank", "content", "occurred_at_ms")


@query(
    f"""WITH {EVENTS}, versions AS (SELECT *, order_key AS group_key, line_number AS line, {_MD5} AS content FROM events_),
    side AS (SELECT group_key, line, source_revision, lifecycle_rank, content, occurred_at_ms, supplier_key % 2 AS odd FROM versions QUALIFY row_number() OVER (PARTITION BY group_key, line, supplier_key % 2 ORDER BY occurred_at_ms, part_key, supplier_key) = 1),
    o AS (SELECT * FROM side WHERE odd = 0), n AS (SELECT * FROM side WHERE odd = 1),
    j AS (SELECT coalesce(o.group_key, n.group_key) AS group_key, coalesce(o.line, n.line) AS line, CASE WHEN o.content IS NULL THEN 'added' WHEN n.content IS NULL THEN 'kept'
      WHEN {_HIGHER.replace('s.', 'o.').replace('v.', 'n.')} THEN 'updated' WHEN {_EQUAL.replace('s.', 'o.').replace('v.', 'n.')} THEN CASE WHEN o.content = n.content THEN 'unchanged' ELSE 'conflict' END ELSE 'skipped' END AS outcome,
      o.occurred_at_ms AS old_at, n.occurred_at_ms AS new_at, o.content AS old_content, n.content AS new_content FROM o FULL JOIN n ON o.group_key = n.group_key AND o.line = n.line)
    SELECT group_key, line, outcome, CASE WHEN outcome IN ('added', 'updated') THEN new_at ELSE old_at END AS occurred_at_ms, CASE WHEN outcome IN ('added', 'updated') THEN new_content ELSE old_content END AS content FROM j"""
)
def u2_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = versions(spark, sf_dir).withColumns({"group_key": F.col("order_key"), "line": F.col("line_number")})
    return merging.upsert(_side(rows, 0), _side(rows, 1), ["group_key", "line"]).select("group_key", "line", "outcome", "occurred_at_ms", "content")


_DAY = "CAST(make_timestamp({0} * 1000) AS DATE)"


@query(
    f"""WITH {EVENTS}, versions AS (SELECT *, order_key AS group_key, line_number AS line, {_MD5} AS content FROM events_),
    side AS (SELECT group_key, line, source_revision, lifecycle_rank, content, occurred_at_ms, supplier_key % 2 AS odd FROM versions QUALIFY row_number() OVER (PARTITION BY group_key, line, supplier_key % 2 ORDER BY occurred_at_ms, part_key, supplier_key) = 1),
    o AS (SELECT * FROM side WHERE odd = 0), n AS (SELECT * FROM side WHERE odd = 1),
    j AS (SELECT CASE WHEN o.content IS NULL THEN 'added' WHEN {_HIGHER.replace('s.', 'o.').replace('v.', 'n.')} THEN 'updated' WHEN {_EQUAL.replace('s.', 'o.').replace('v.', 'n.')} THEN CASE WHEN o.content = n.content THEN 'unchanged' ELSE 'conflict' END ELSE 'skipped' END AS outcome,
      {_DAY.format('o.occurred_at_ms')} AS old_day, {_DAY.format('n.occurred_at_ms')} AS new_day FROM n LEFT JOIN o ON o.group_key = n.group_key AND o.line = n.line),
    d AS (SELECT outcome, new_day AS day FROM j UNION ALL SELECT outcome, old_day FROM j WHERE outcome = 'updated' AND old_day <> new_day)
    SELECT day, {', '.join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in ('added', 'updated', 'unchanged', 'skipped', 'conflict'))} FROM d GROUP BY 1"""
)
def u2_affected_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = versions(spark, sf_dir).withColumns({"group_key": F.col("order_key"), "line": F.col("line_number")})
    day = F.to_date(F.timestamp_millis("occurred_at_ms"))
    sides = [_side(rows, odd).withColumn("day", day) for odd in (0, 1)]
    return merging.affected_days(*sides, ["group_key", "line"], "day")


@query(f"WITH {EVENTS} SELECT origin_host, user_id, order_key, part_key, line_number, source_instance_id FROM events_ QUALIFY row_number() OVER (PARTITION BY origin_host, user_id, order_key, line_number ORDER BY supplier_key, part_key, source_record_key) = 1")
def w11_u6_first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = merging.first_occurrence(usage_events(spark, sf_dir), ["origin_host", "user_id", "order_key", "line_number"], ["supplier_key", "part_key", "source_record_key"])
    return kept.select("origin_host", "user_id", "order_key", "part_key", "line_number", "source_instance_id")


_PACK = "SELECT agent, local_day, count(*) AS events, CAST(sum(total_tokens) AS BIGINT) AS tokens, max(part_key) AS revision FROM {0} GROUP BY ALL"


@query(
    f"""WITH {EVENTS}, o AS ({_PACK.format('events_ WHERE supplier_key % 3 <> 0')}), n AS ({_PACK.format("events_ WHERE supplier_key % 3 <> 1 AND local_day < DATE '1999-01-01'")})
    SELECT agent, local_day, CASE WHEN o.revision IS NULL THEN 'added' WHEN o.events = n.events AND o.tokens IS NOT DISTINCT FROM n.tokens THEN 'unchanged' WHEN n.revision >= o.revision THEN 'replaced' ELSE 'conflict' END AS outcome
    FROM n LEFT JOIN o USING (agent, local_day)"""
)
def u8_package_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = usage_events(spark, sf_dir)
    pack = lambda rows: rows.groupBy("agent", "local_day").agg(F.count("*").alias("events"), F.sum("total_tokens").alias("tokens"), F.max("part_key").alias("revision"))
    stored, incoming = pack(events.where("supplier_key % 3 <> 0")), pack(events.where("supplier_key % 3 <> 1 AND local_day < DATE'1999-01-01'"))
    return merging.merge_partitions(stored, incoming, ["agent", "local_day"], ["events", "tokens"])


@query(
    """WITH o AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS used FROM events WHERE event_type <> 'error' GROUP BY ALL), n AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS used FROM events WHERE event_type <> 'signup' GROUP BY ALL)
    SELECT user_id, day, CASE WHEN o.used IS NULL THEN 'added' WHEN o.used = n.used THEN 'skipped' ELSE 'corrected' END AS outcome FROM n LEFT JOIN o USING (user_id, day)"""
)
def u11_quota_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = lambda kind: table(spark, sf_dir, "events").where(F.col("event_type") != kind).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("value").alias("used"))
    return merging.record_quota(seen("error"), seen("signup"), ["user_id", "day"], "used")


@query(
    f"""WITH {EVENTS}, covered AS (SELECT DISTINCT origin_host, user_id, session_id, local_day FROM events_ WHERE line_number = 1 AND session_id IS NOT NULL), frozen AS (SELECT DISTINCT local_day, source_instance_id FROM events_ WHERE part_key % 97 = 0)
    SELECT e.source_instance_id, CASE WHEN f.local_day IS NOT NULL THEN 'sealed' WHEN c.local_day IS NOT NULL THEN 'excluded' ELSE 'counted' END AS authority, count(*) AS n FROM events_ e
    LEFT JOIN covered c ON e.origin_host = c.origin_host AND e.user_id = c.user_id AND e.session_id = c.session_id AND e.local_day = c.local_day
    LEFT JOIN frozen f ON e.local_day = f.local_day AND e.source_instance_id = f.source_instance_id WHERE line_number <> 1 GROUP BY ALL"""
)
def j10_u14_source_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = usage_events(spark, sf_dir)
    marked = merging.select_authority(
        events.where("line_number <> 1"), events.where("line_number = 1 AND session_id IS NOT NULL"), ["origin_host", "user_id", "session_id", "local_day"], events.where("part_key % 97 = 0"), ["local_day", "source_instance_id"]
    )
    return marked.groupBy("source_instance_id", "authority").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS} SELECT source_instance_id, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM events_ WHERE source_instance_id IN (SELECT source_instance_id FROM events_ WHERE user_id = 'user-3') GROUP BY 1")
def j9_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = usage_events(spark, sf_dir)
    owned = events.where("user_id = 'user-3'").select("source_instance_id").distinct()
    return events.join(owned, "source_instance_id", "left_semi").groupBy("source_instance_id").agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"))
