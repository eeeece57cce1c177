"""Exchange queries: detail and partition packages, native intervals, day replacement and price snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.functions.scalars import content_hash
from meterframe.operators import archives, exchange, rollups
from meterframe.plans.merges import _CONTENT, _MD5, _ORDER
from meterframe.plans.retention import FLOOR, PERIODS, TODAY
from meterframe.plans.summaries import DIMS, MEASURES, read_daily, read_hourly
from meterframe.registry import query
from meterframe.sources.usage import EVENTS, usage_events

_ROLLS = f"""roll AS (SELECT local_day, {DIMS}, {MEASURES} FROM events_ WHERE attribution_status = 'verified' GROUP BY ALL)"""
_LIVE = "supplier_key % 3 <> 0 AND part_key % 211 <> 0"


@query(
    f"""WITH {EVENTS}, {_ROLLS}, live AS (SELECT * FROM events_ WHERE attribution_status = 'verified' AND {_LIVE}),
    d AS (SELECT source_instance_id, local_day, count(*) AS details FROM live GROUP BY ALL), r AS (SELECT source_instance_id, local_day, CAST(sum(events) AS BIGINT) AS counted FROM roll GROUP BY ALL),
    days AS (SELECT d.*, coalesce(details = counted, false) AS complete FROM d LEFT JOIN r USING (source_instance_id, local_day))
    SELECT source_instance_id, 'exported' AS kind, CAST(sum(details) AS BIGINT) AS n FROM days WHERE complete GROUP BY 1
    UNION ALL SELECT source_instance_id, 'incomplete', CAST(count(*) AS BIGINT) FROM days WHERE NOT complete GROUP BY 1
    UNION ALL SELECT source_instance_id, 'archived', CAST(count(*) AS BIGINT) FROM roll r WHERE NOT EXISTS (SELECT 1 FROM days d WHERE d.source_instance_id = r.source_instance_id AND d.local_day = r.local_day) GROUP BY 1"""
)
def s5_detail_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of which some are gone: source-days that lack a row are not exported; archives hold the days without any."""
    events = rollups.eligible(usage_events(spark, sf_dir)).where(_LIVE)
    rows = read_daily(spark, sf_dir)
    records, archived, partial = exchange.export_details(events, rows, rows)
    counted = lambda table, kind: table.groupBy("source_instance_id").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    whole = records.where(F.get_json_object("record", "$.source_record_key").isNotNull())
    return counted(whole, "exported").unionByName(counted(partial, "incomplete")).unionByName(counted(archived, "archived"))


_ONE = "QUALIFY row_number() OVER (PARTITION BY source_instance_id, source_record_key, odd ORDER BY occurred_at_ms, part_key, supplier_key) = 1"
_HIGH = "CASE WHEN o.source_revision IS NOT NULL AND n.source_revision IS NOT NULL THEN n.source_revision {0} o.source_revision ELSE n.lifecycle_rank {0} o.lifecycle_rank END"


@query(
    f"""WITH {EVENTS}, v AS (SELECT *, {_MD5} AS content, concat(source_instance_id, '/', order_key % 50) AS package FROM events_),
    o AS (SELECT source_instance_id, source_record_key, local_day, content, source_revision, lifecycle_rank, part_key % 13 = 0 AS conflict FROM v WHERE part_key % 2 = 0 QUALIFY row_number() OVER (PARTITION BY source_instance_id, source_record_key ORDER BY occurred_at_ms, part_key, supplier_key) = 1),
    p AS (SELECT package, source_instance_id, source_record_key, local_day, content, source_revision, lifecycle_rank, total_tokens, part_key % 17 = 0 AS conflict FROM v WHERE part_key % 2 = 1),
    bad AS (SELECT DISTINCT package FROM (SELECT package, count(*) OVER (PARTITION BY package, source_instance_id, source_record_key) > 1 OR local_day < DATE '1995-06-01' OR coalesce(total_tokens > 12000, false) AS fault FROM p) WHERE fault),
    n AS (SELECT * FROM p WHERE package NOT IN (SELECT package FROM bad)),
    j AS (SELECT coalesce(o.source_instance_id, n.source_instance_id) AS source_instance_id, CASE WHEN o.content IS NULL THEN 'added' WHEN n.content IS NULL THEN 'kept' WHEN {_HIGH.format('>')} THEN 'updated'
      WHEN {_HIGH.format('=')} THEN CASE WHEN o.content = n.content THEN 'unchanged' ELSE 'conflict' END ELSE 'skipped' END AS outcome, o.local_day AS old_day, n.local_day AS new_day, o.conflict AS old_flag, n.conflict AS new_flag FROM o FULL JOIN n ON o.source_instance_id = n.source_instance_id AND o.source_record_key = n.source_record_key),
    every AS (SELECT source_instance_id, outcome, CASE WHEN outcome IN ('added', 'updated') THEN new_day ELSE old_day END AS day, CASE WHEN outcome IN ('added', 'updated') THEN new_flag ELSE old_flag OR outcome = 'conflict' END AS flag FROM j
      UNION ALL SELECT source_instance_id, 'rejected', local_day, conflict FROM p WHERE package IN (SELECT package FROM bad))
    SELECT source_instance_id, outcome, count(*) AS n, count(DISTINCT day) AS days, count(*) FILTER (flag) AS conflicts FROM every GROUP BY ALL"""
)
def u9_detail_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meterframe.operators.merging import first_occurrence

    rows = usage_events(spark, sf_dir).withColumn("content", content_hash(list(_CONTENT)))
    keys = ["source_instance_id", "source_record_key"]
    held = ["local_day", "content", "source_revision", "lifecycle_rank"]
    flag = lambda n: (F.col("part_key") % n == 0).alias("conflict")
    target = first_occurrence(rows.where("part_key % 2 = 0"), keys, _ORDER).select(*keys, *held, flag(13))
    package = rows.where("part_key % 2 = 1").select(F.concat("source_instance_id", F.lit("/"), F.col("order_key") % 50).alias("package"), *keys, *held, flag(17), "total_tokens")
    archived = rows.where("local_day < DATE'1995-06-01'").select(*exchange.SOURCE_DAY)
    valid = F.coalesce(F.col("total_tokens") <= 12000, F.lit(True))
    merged = exchange.import_details(target, package, archived, keys, valid)
    return merged.groupBy("source_instance_id", "outcome").agg(F.count("*").alias("n"), F.count_distinct("local_day").alias("days"), F.count_if("conflict").alias("conflicts"))


_A, _Z = "1996-03-05", "1997-02-11"
_LAST = "1997-02-10"  # the day before the end


@query(
    f"""WITH {EVENTS}, {_ROLLS}, hours AS (SELECT local_day, local_hour, {DIMS}, count(*) AS events FROM events_ WHERE attribution_status = 'verified' GROUP BY ALL), {PERIODS},
    d AS (SELECT * FROM roll WHERE local_day >= DATE '{_A}' AND local_day < DATE '{_Z}'), h AS (SELECT * FROM hours WHERE local_day >= DATE '{_A}' AND local_day < DATE '{_Z}'), p AS (SELECT * FROM periods WHERE first_day >= DATE '{_A}' AND end_day <= DATE '{_Z}')
    SELECT 'daily' AS name, source_instance_id, count(*) AS n, CAST(sum(events) AS BIGINT) AS events, NULL AS host FROM d GROUP BY ALL UNION ALL SELECT 'hourly', source_instance_id, count(*), CAST(sum(events) AS BIGINT), NULL FROM h GROUP BY ALL
    UNION ALL SELECT 'period', source_instance_id, count(*), CAST(sum(events) AS BIGINT), NULL FROM p GROUP BY ALL
    UNION ALL SELECT 'sources', source_instance_id, 1, NULL, max(origin_host) FROM events_ WHERE source_instance_id IN (SELECT source_instance_id FROM d UNION SELECT source_instance_id FROM h UNION SELECT source_instance_id FROM p) GROUP BY source_instance_id"""
)
def s11_aggregate_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and periods are added up from the hours of the exported days, so that events are joined and rolled up once."""
    hours = read_hourly(spark, sf_dir, _A, _LAST)
    rows = rollups.resum(hours, "local_day", *rollups.DIMENSIONS)
    hosts = usage_events(spark, sf_dir).groupBy("source_instance_id").agg(F.max("origin_host").alias("host"))
    # a period that is exported lies in these days as a whole
    tables = exchange.export_partitions(rows, hours, archives.materialise_periods(rows, TODAY, FLOOR), hosts, _A, _Z, True)
    none = F.lit(None).cast("string")
    out = tables["sources"].select(F.lit("sources").alias("name"), "source_instance_id", F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("events"), "host")
    for name in ("daily", "hourly", "period"):
        out = out.unionByName(tables[name].groupBy("source_instance_id").agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum("events").alias("events"), none.alias("host")))
    return out


_SPOILT = "CASE WHEN local_day = DATE '1996-01-08' AND calls > 0 THEN -calls ELSE calls END"
_FAULTS = """CASE WHEN source_instance_id = 'inst-7' THEN 'undeclared_source' WHEN source_instance_id = 'inst-9' THEN 'other_agent' WHEN calls < 0 THEN 'negative_value'
  WHEN local_day = DATE '1997-03-03' AND events < 2 THEN 'more_than_events' WHEN local_day = DATE '1998-05-05' THEN 'granularity' END"""


@query(
    f"""WITH {EVENTS}, {_ROLLS}, rows_ AS (SELECT source_instance_id, local_day, events, {_SPOILT} AS calls, source_instance_id || '/' || strftime(local_day, '%Y-%m') AS package FROM roll), m AS (SELECT *, {_FAULTS} AS fault FROM rows_),
    r AS (SELECT *, bool_or(fault IS NOT NULL) OVER (PARTITION BY package) AS rejected FROM m) SELECT source_instance_id, fault, rejected, count(*) AS n, CAST(sum(events) AS BIGINT) AS events FROM r GROUP BY ALL"""
)
def p11_partition_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's month is a package; some rows of some are spoilt."""
    package = F.concat("source_instance_id", F.lit("/"), F.date_format("local_day", "yyyy-MM"))
    spoilt = F.when((F.col("local_day") == "1996-01-08") & (F.col("calls") > 0), -F.col("calls")).otherwise(F.col("calls"))
    grain = F.when(F.col("local_day") == "1998-05-05", "fortnight").otherwise("day")
    conflicts = F.when(F.col("local_day") == "1997-03-03", 2).otherwise(0)
    rows = read_daily(spark, sf_dir).select("source_instance_id", "local_day", F.lit("a").alias("agent"), "events", spoilt.alias("calls"), conflicts.alias("conflicts"), grain.alias("granularity"), F.lit(None).cast("int").alias("local_hour"), package.alias("package"))
    declared = rows.where("source_instance_id <> 'inst-7'").select("package", "source_instance_id", F.when(F.col("source_instance_id") == "inst-9", "b").otherwise("a").alias("agent")).distinct()
    return exchange.partition_faults(rows, declared, ("events", "calls")).groupBy("source_instance_id", "fault", "rejected").agg(F.count("*").alias("n"), F.sum("events").alias("events"))


@query(
    f"""WITH {EVENTS}, {_ROLLS}, s AS (SELECT source_instance_id, local_day, CAST(sum(events) AS BIGINT) AS events, CAST(sum(calls) AS BIGINT) AS calls FROM roll GROUP BY ALL),
    i AS (SELECT source_instance_id, local_day, events + CASE WHEN day(local_day) % 4 = 0 THEN 1 ELSE 0 END AS events, calls, day(local_day) % 3 AS revision, source_instance_id || '/' || strftime(local_day, '%Y-%m') AS package FROM s),
    o AS (SELECT *, 1 AS revision FROM s WHERE day(local_day) % 5 <> 0), live AS (SELECT DISTINCT source_instance_id, local_day FROM s WHERE local_day >= DATE '1998-02-01' AND day(local_day) = 11),
    t AS (SELECT DISTINCT package FROM i JOIN live USING (source_instance_id, local_day))
    SELECT i.source_instance_id, CASE WHEN i.package IN (SELECT package FROM t) THEN 'overlaps_detail' WHEN o.events IS NULL THEN 'added' WHEN o.events = i.events AND o.calls = i.calls THEN 'unchanged' WHEN i.revision >= o.revision THEN 'replaced' ELSE 'conflict' END AS outcome, count(*) AS n
    FROM i LEFT JOIN o ON o.source_instance_id = i.source_instance_id AND o.local_day = i.local_day GROUP BY ALL"""
)
def u8_package_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = read_daily(spark, sf_dir).groupBy("source_instance_id", "local_day").agg(F.sum("events").alias("events"), F.sum("calls").alias("calls"))
    day = F.day("local_day")
    incoming = held.select("source_instance_id", "local_day", (F.col("events") + F.when(day % 4 == 0, 1).otherwise(0)).alias("events"), "calls", (day % 3).alias("revision"), F.concat("source_instance_id", F.lit("/"), F.date_format("local_day", "yyyy-MM")).alias("package"))
    live = held.where((F.col("local_day") >= "1998-02-01") & (day == 11))
    merged = exchange.merge_packages(held.where(day % 5 != 0).withColumn("revision", F.lit(1)), incoming, live, ["source_instance_id", "local_day"], ["events", "calls"])
    return merged.groupBy("source_instance_id", "outcome").agg(F.count("*").alias("n"))


@query(
    """WITH o AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS content, CASE WHEN o_orderkey % 3 <> 0 THEN 5 END AS revision, epoch_ms(o_orderdate) AS start_ms FROM orders WHERE o_orderkey % 4 <> 1 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY o_custkey, o_totalprice) = 1),
    n AS (SELECT l_orderkey AS k, CASE WHEN l_orderkey % 5 = 0 THEN (SELECT max(content) FROM o x WHERE x.k = l.l_orderkey) ELSE max(l_partkey) END AS content, CASE WHEN l_orderkey % 7 <> 0 THEN 3 + l_orderkey % 4 END AS revision, max(CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE epoch_ms(l_shipdate) END) AS start_ms FROM lineitem l GROUP BY l_orderkey)
    SELECT outcome, count(*) AS n, CAST(sum(k) AS BIGINT) AS ids, CAST(sum(CASE WHEN outcome IN ('added', 'replaced') THEN nc ELSE oc END) AS BIGINT) AS content FROM (
      SELECT coalesce(o.k, n.k) AS k, o.content AS oc, n.content AS nc, CASE WHEN n.content IS NULL THEN 'kept' WHEN n.start_ms IS NULL OR n.start_ms < 850000000000 THEN 'below_floor' WHEN o.content IS NULL THEN 'added' WHEN o.content = n.content THEN 'unchanged' WHEN coalesce(n.revision < o.revision, false) THEN 'ignored'
        WHEN coalesce(n.revision > o.revision, false) THEN 'replaced' ELSE 'conflict' END AS outcome FROM o FULL JOIN n ON o.k = n.k) GROUP BY 1"""
)
def u10_interval_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meterframe.operators.merging import first_occurrence
    from meterframe.sources.usage import table

    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    key = F.col("o_orderkey")
    orders = first_occurrence(table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_custkey", "o_totalprice"]).where(key % 4 != 1)
    stored = orders.select(key.alias("k"), F.floor("o_totalprice").alias("content"), F.when(key % 3 != 0, 5).alias("revision"), ms("o_orderdate").alias("start_ms"), ms("o_orderdate").alias("end_ms"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_partkey").alias("part"), F.max(F.when(F.col("l_orderkey") % 13 != 0, ms("l_shipdate"))).alias("start_ms"))
    incoming = lines.join(stored.select("k", F.col("content").alias("same")), "k", "left").select("k", F.when(F.col("k") % 5 == 0, F.col("same")).otherwise(F.col("part")).alias("content"), F.when(F.col("k") % 7 != 0, 3 + F.col("k") % 4).alias("revision"), "start_ms", F.col("start_ms").alias("end_ms"))
    found = exchange.upsert_intervals(stored, incoming, ["k"], 850_000_000_000)
    return found.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("k").alias("ids"), F.sum("content").alias("content"))


@query(
    f"""WITH {EVENTS}, {_ROLLS}, s AS (SELECT source_instance_id, local_day, CAST(sum(events) AS BIGINT) AS events FROM roll GROUP BY ALL), f AS (SELECT source_instance_id, local_day, events + 5 AS events FROM s WHERE local_day >= DATE '1996-01-01' AND local_day < DATE '1997-07-01' AND events % 3 <> 0),
    b AS (SELECT source_instance_id, min(local_day) AS a, max(local_day) AS z FROM f GROUP BY 1)
    SELECT source_instance_id, origin, count(*) AS days, CAST(sum(events) AS BIGINT) AS events FROM (SELECT s.*, 'stored' AS origin FROM s LEFT JOIN b USING (source_instance_id) WHERE NOT coalesce(local_day > a AND local_day < z AND local_day >= DATE '1996-04-01', false)
      UNION ALL SELECT f.*, 'snapshot' FROM f JOIN b USING (source_instance_id) WHERE local_day > a AND local_day < z AND local_day >= DATE '1996-04-01') GROUP BY ALL"""
)
def u7_day_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = read_daily(spark, sf_dir).groupBy("source_instance_id", "local_day").agg(F.sum("events").alias("events"))
    snapshot = held.where("local_day >= DATE'1996-01-01' AND local_day < DATE'1997-07-01' AND events % 3 <> 0").withColumn("events", F.col("events") + 5)
    found = exchange.replace_days(held, snapshot, F.lit("1996-04-01").cast("date"))
    return found.groupBy("source_instance_id", "origin").agg(F.count("*").alias("days"), F.sum("events").alias("events"))


@query(
    """WITH s AS (SELECT concat(p_brand, '/', p_size) AS snapshot_id, p_size % 3 AS kind, count(*) AS n, max(p_retailprice) > 0 AS any FROM part GROUP BY ALL)
    SELECT snapshot_id, CASE kind WHEN 0 THEN 'added' WHEN 1 THEN 'skipped' ELSE 'rejected' END AS outcome FROM s"""
)
def u12_snapshot_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots by brand and size: a third is new, a third known, a third known with other prices."""
    from meterframe.sources.usage import table

    rows = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), "p_size").alias("snapshot_id"), (F.col("p_size") % 3).alias("kind"), "p_partkey", "p_retailprice")
    columns = ["p_partkey", "p_retailprice"]
    old = rows.where("kind <> 0").withColumn("p_retailprice", F.when(F.col("kind") == 2, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice")))
    return exchange.import_snapshots(exchange.snapshot_content(old, columns), exchange.snapshot_content(rows, columns))
