"""Raw feeds: JSON lines with bad ones set apart, span batches, JSON columns of application tables, and a CSV sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterframe.sources import lines

LINE_LIMIT = lines.LINE_LIMIT


def read_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(records with their file, line and offset, diagnostics (file, line, offset, fault)): what cannot be read is named by place, not shown.

    Only ended lines are read. Faults: line_too_long, invalid_utf8_line, not_an_object.
    """
    whole = lines.registered(spark).read.format("whole_lines").option("path", path).load()
    return parsed(lines.readable(lines.numbered(whole)).select("file", "line", "offset", "fault", "value"), schema)


def line_fault(value: str = "value") -> Column:
    """Why a line is no JSON object; null if it is one."""
    return F.when(F.octet_length(value) > LINE_LIMIT, "line_too_long").when(F.try_parse_json(value).isNull() | ~F.trim(value).startswith("{"), "not_an_object")


def parsed(rows: DataFrame, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """Lines (value, other columns) to their fields, and the ones that cannot be read; a ``fault`` found before stands."""
    others = [c for c in rows.columns if c not in ("value", "fault")]
    fault = F.coalesce("fault", line_fault()) if "fault" in rows.columns else line_fault()
    marked = rows.withColumn("fault", fault)
    return marked.where("fault is null").select(*others, F.from_json("value", schema).alias("r")).select(*others, "r.*"), marked.where("fault is not null").select(*others, "fault")


def table_scan(rows: DataFrame, key: str, since: int | None, column: str, fields: dict[str, tuple[str, tuple[str, ...], bool]]) -> tuple[DataFrame, DataFrame]:
    """(records, faults) of an application table's rows beyond ``since``, the last key that has been read (None: all).

    ``fields``: name -> (path in the JSON of ``column``, the types it may have, the first of which it is read as, whether it is
    required). Types are those of JSON: BIGINT, DOUBLE, DECIMAL, STRING, BOOLEAN. A value of another type is a fault of the whole row,
    ``wrong_type:`` and the field's name, and is not turned into one; so is ``required_missing:``; a text that is no object
    is ``not_an_object``. The predicate on the key reaches the scan.
    """
    fresh = rows if since is None else rows.where(F.col(key) > since)
    parsed_ = fresh.withColumn("json_", F.try_parse_json(column))
    fault = F.when(F.col("json_").isNull() | ~F.coalesce(F.schema_of_variant("json_").startswith("OBJECT"), F.lit(False)), "not_an_object")
    for name, (path, types, required) in fields.items():
        held = F.try_variant_get("json_", path, "variant")
        kind = F.regexp_replace(F.schema_of_variant(held), r"[(<].*", "")
        missing = held.isNull() | (kind == "VOID")
        fault = fault.when(~missing & ~kind.isin(*types), f"wrong_type:{name}")
        fault = fault.when(missing, f"required_missing:{name}") if required else fault
    marked = parsed_.withColumn("fault", fault)
    read = {name: F.try_variant_get("json_", path, types[0].lower()) for name, (path, types, _) in fields.items()}
    return marked.where("fault is null").withColumns(read).drop("json_", "fault", column), marked.where("fault is not null").select(key, "fault")


def spans(batches: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """One row for each span of OTLP JSON batches: ids, kind, milliseconds, and the allowed attributes as text."""
    value = "struct<stringValue:string,intValue:string,asInt:string,doubleValue:double,boolValue:boolean>"
    attributes = f"array<struct<key:string,value:{value}>>"
    span = f"struct<traceId:string,spanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{attributes}>"
    schema = f"struct<resourceSpans:array<struct<resource:struct<attributes:{attributes}>,scopeSpans:array<struct<spans:array<{span}>>>>>>"
    flat = batches.select(F.explode(F.from_json("body", schema).resourceSpans).alias("r")).select("r.resource", F.explode("r.scopeSpans").alias("s")).select("resource", F.explode("s.spans").alias("x"))

    def scalars(column: Column) -> Column:
        text = lambda a: F.struct(a.key.alias("key"), F.coalesce(a.value.stringValue, a.value.intValue, a.value.asInt, a.value.doubleValue.cast("string"), a.value.boolValue.cast("string")).alias("value"))
        return F.map_filter(F.map_from_entries(F.transform(F.coalesce(column, F.array().cast(attributes)), text)), lambda k, v: k.isin(*allowed))

    kinds = F.create_map(*[F.lit(x) for kv in {0: "unspecified", 1: "internal", 2: "server", 3: "client", 4: "producer", 5: "consumer"}.items() for x in kv])
    ms = lambda c: F.call_function("div", F.col(c).cast("long"), F.lit(1_000_000).cast("long"))
    return flat.select("x.traceId", "x.spanId", "x.name", F.try_element_at(kinds, F.col("x.kind")).alias("kind"), ms("x.startTimeUnixNano").alias("start_ms"), ms("x.endTimeUnixNano").alias("end_ms"), scalars(F.col("x.attributes")).alias("attributes"), scalars(F.col("resource.attributes")).alias("resource"))


def attribute(names: tuple[str, ...], low: int = 0, high: int = 1 << 62) -> Column:
    """A count by any of its names, the record's before the resource's; null if it is out of range."""
    found = F.coalesce(*[F.try_element_at(c, F.lit(n)).try_cast("long") for c in ("attributes", "resource") for n in names])
    return F.when(found.between(low, high), found)


def attribute_fault(names: tuple[str, ...], low: int = 0, high: int = 1 << 62) -> Column:
    """Whether the record has such a count that is no number or out of range: it is rejected then."""
    fault = F.lit(False)
    for held in ("attributes", "resource"):
        for name in names:
            value = F.try_element_at(held, F.lit(name))
            fault |= value.isNotNull() & ~F.coalesce(value.try_cast("long").between(low, high), F.lit(False))
    return fault


def guarded(text: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(text.rlike(r"^[=+@\-]"), F.concat(F.lit("'"), text)).otherwise(text)


def write_summary_csv(rows: DataFrame, path: str) -> None:
    cells = [guarded(F.col(f.name)).alias(f.name) if f.dataType == T.StringType() else F.col(f.name) for f in rows.schema.fields]
    rows.select(*cells).write.mode("overwrite").option("header", True).csv(path)


def insert_or_ignore(records: DataFrame, kind: str, excluded: dict[str, str], held: DataFrame, target_keys: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """Records with ``outcome``: why their type is left out (N11), else held by the target, a repeat of its keys, or added.

    Where the target's keys are some of the records', these are brought together and sorted once, for repeats and target.
    """
    dropped = F.lit(None).cast("string")
    for name, reason in excluded.items():
        dropped = F.when(F.col(kind) == name, reason).otherwise(dropped)
    known = held.select(*target_keys).withColumn("held_", F.lit(True))
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if set(target_keys) <= set(keys):
        # by number: tasks are not put together again, so that what each sorts stays small
        records = records.repartition(4 * int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), *target_keys)
        keys = [*target_keys, *[k for k in keys if k not in target_keys]]
        turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    outcome = F.coalesce(dropped, F.when(F.col("held_"), "held").when(F.col("turn_") > 1, "repeated").otherwise("added"))
    return records.withColumn("turn_", turn).join(known, target_keys, "left").withColumn("outcome", outcome).drop("held_", "turn_")


def overlaid(entries: DataFrame, keys: list[str], side: str, order: list[str], fields: list[str]) -> DataFrame:
    """Each field's last set value: a journal entry's (``side`` 1) before the snapshot's (0), a later one before an earlier."""
    at = F.struct(side, *order)
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields]
    return entries.groupBy(*keys).agg(*last, F.count_if(F.col(side) == 0).alias("snapshots"), F.count_if(F.col(side) == 1).alias("entries"))


def documents(files: DataFrame, schema: str, messages: str) -> tuple[DataFrame, DataFrame]:
    """Whole JSON documents (file, value) to one row for each message with its place, and the files that are no document."""
    fault = F.when(F.try_parse_json("value").isNull() | ~F.trim("value").startswith("{"), "not_a_document")
    marked = files.select("file", "value", fault.alias("fault"))
    read = marked.where("fault is null").select("file", F.from_json("value", schema).alias("d"))
    return read.select("file", "d.*").select("file", "*", F.posexplode_outer(messages).alias("place", "message")).drop(messages), marked.where("fault is not null").select("file", "fault")


_QUOTA = "struct<entitlement:double,quota_remaining:double,remaining:double,unlimited:boolean,has_quota:boolean,percent_remaining:double,timestamp_utc:string>"


def quota_cache(files: DataFrame, root: str) -> DataFrame:
    """(file, plan, quota_id, entitlement, remaining, used, unlimited, observed_ms) of cache texts (file, value), counts in thousandths.

    Lines of comments are left out; of several entries the latest stands. A quota that the account does not have, and a
    count that is negative or no multiple of a thousandth, are left out. What is used is known of limited quotas alone.
    """
    entry = f"struct<retrievedAt:string,response:struct<copilot_plan:string,quota_snapshots:map<string,{_QUOTA}>>>"
    text = F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), r"(?m)^[ \t]*//.*$", "")
    cache = F.from_json(text, f"struct<`{root}`:map<string,{entry}>>")[root]
    newest = F.array_max(F.transform(F.map_entries(cache), lambda e: F.struct(F.try_to_timestamp(e.value.retrievedAt).alias("at"), e.key.alias("key"))))
    held = files.select("file", F.try_element_at(cache, newest.key).response.alias("r")).select("file", F.col("r.copilot_plan").alias("plan"), F.explode("r.quota_snapshots").alias("quota_id", "q")).where("coalesce(q.has_quota, true)")

    def milli(value: Column) -> Column:
        return F.when((value >= 0) & (value < 9e15) & (F.abs(value * 1000 - F.round(value * 1000)) <= 1e-6), F.round(value * 1000).cast("long"))

    limit, left = milli(F.col("q.entitlement")), milli(F.coalesce("q.quota_remaining", "q.remaining"))
    unlimited = F.coalesce("q.unlimited", F.lit(False))
    used = F.when(~unlimited & (limit > 0) & (left <= limit), limit - left)
    return held.select("file", "plan", "quota_id", limit.alias("entitlement"), left.alias("remaining"), used.alias("used"), unlimited.alias("unlimited"), F.unix_millis(F.try_to_timestamp("q.timestamp_utc")).alias("observed_ms"))


def replayed(lines: DataFrame, file: str, order: str) -> DataFrame:
    """U4: (file, state, faults): the JSON state that a mutation log leaves, and how many of its lines could not be applied.

    Kinds: 0 a new state, 1 a value set at a path (none: removed), 2 items pushed to a list cut at a place first, 3 a
    path deleted. A log is one session's file and is replayed by one task, line after line.
    """
    import json

    import pandas as pd

    def place(state, path):
        for step in path:
            state = state[step]
        return state

    def apply(state, entry: dict):
        kind, path = entry.get("kind"), entry.get("k") or []
        if kind == 0:
            return entry.get("v") if isinstance(entry.get("v"), dict) else None
        if state is None or kind not in (1, 2, 3):
            raise ValueError("no state")
        parent, last = place(state, path[:-1]), path[-1]
        if kind == 2:
            held = parent.get(last) if isinstance(parent.get(last), list) else []
            start = entry.get("i", len(held))
            if start > len(held):
                raise ValueError("beyond the end")
            parent[last] = held[:start] + (entry.get("v") or [])
        elif kind == 1 and "v" in entry:
            if isinstance(parent, list) and not 0 <= last < len(parent):
                raise ValueError("beyond the end")
            parent[last] = entry["v"]
        elif isinstance(parent, dict):
            parent.pop(last, None)
        else:
            raise ValueError("no key")
        return state

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        state, faults = None, 0
        for text in frame.sort_values("order_")["value"]:
            try:
                state = apply(state, json.loads(text))
            except (ValueError, TypeError, KeyError, IndexError, AttributeError):
                faults += 1
        return pd.DataFrame({"file": [frame["file"].iloc[0]], "state": [json.dumps(state)], "faults": [faults]})

    return lines.select(F.col(file).alias("file"), F.col(order).alias("order_"), "value").groupBy("file").applyInPandas(run, "file long, state string, faults long")
