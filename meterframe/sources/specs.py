"""Specifications of single sources as data, and the one job that reads records by them.

A specification says which of a source's JSON records hold usage, where the counts are, by which rule they are read,
and what names a record. Sources whose formats are not written down here can be added as data alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterframe.operators import buckets
from meterframe.sources import feeds, lines


@dataclass(frozen=True)
class Spec:
    """``kind``: (path, value) that a usage record has. ``counts``: paths of the parts, first found first. ``required``: parts
    without which a record is not read. ``messages``, ``session``: of a document, the paths of its records and of its session.
    ``sidechain``, ``parent``: what a call's category follows from. ``identity``: names in order of preference, the last of
    which every record has. In braces stand JSON paths, places (@line, @index in a document, @session, @agent: folders of
    the file, @repeat: how many records of the file had the same time before) and, after a bar, what stands in for them."""

    name: str
    counts: dict[str, tuple[str, ...]]
    rule: str
    identity: tuple[str, ...]
    kind: tuple[str, str] | None = None
    model: tuple[str, ...] = ()
    time: str = "$.timestamp"
    required: tuple[str, ...] = ()
    zero_unknown: bool = False
    sidechain: str | None = None
    parent: str | None = None
    messages: str | None = None
    session: str | None = None
    files: str = ""
    version: str | None = None
    versions: tuple[str, ...] = ()


# The names under which these writers keep their counts.
SPECS = {
    s.name: s
    for s in (
        Spec(
            "codex", {"input": ("$.payload.usage.input_tokens",), "read": ("$.payload.usage.cached_input_tokens",), "write": ("$.payload.usage.cache_write_input_tokens",), "output": ("$.payload.usage.output_tokens",), "reasoning": ("$.payload.usage.reasoning_output_tokens",)},
            "inclusive", ("resp:{$.payload.response_id}", "seq:{$.payload.thread_id|$.payload.session_id|unknown-session}:{@line}"), ("$.type", "token_usage_record"), ("$.payload.model",), required=("input", "read", "write", "output", "reasoning"), files=r"/\.codex/.*/rollout-[^/]*\.jsonl$", version="$.payload.cli_version",
        ),
        Spec(
            "claude-code", {"input": ("$.message.usage.input_tokens",), "read": ("$.message.usage.cache_read_input_tokens",), "write": ("$.message.usage.cache_creation_input_tokens",), "output": ("$.message.usage.output_tokens",)},
            "exclusive", ("req:{$.requestId}", "msg:{$.message.id}", "uuid:{$.uuid}", "seq:{$.sessionId|unknown-session}:{@line}"), ("$.type", "assistant"), ("$.message.model",), required=("input", "read", "write", "output"), sidechain="$.isSidechain", files=r"/\.claude/projects/.*\.jsonl$", version="$.version",
        ),
        Spec(
            "gemini", {"input": ("$.tokens.input",), "read": ("$.tokens.cached",), "output": ("$.tokens.output",), "reasoning": ("$.tokens.thoughts",)},
            "independent", ("gemini:{@session}:{$.id}", "gemini:{@session}:idx-{@index}"), ("$.type", "gemini"), ("$.model",), required=("input", "output"), messages="$.messages", session="$.sessionId", files=r"/\.gemini/tmp/.*\.json$",
        ),
        Spec(
            "qwen", {"input": ("$.usageMetadata.promptTokenCount",), "read": ("$.usageMetadata.cachedContentTokenCount",), "output": ("$.usageMetadata.candidatesTokenCount",), "reasoning": ("$.usageMetadata.thoughtsTokenCount",)},
            "independent", ("qwen:{$.uuid}", "seq:{$.sessionId|unknown-session}:{@line}"), ("$.type", "assistant"), ("$.model",), required=("input", "output"), sidechain="$.isSidechain", parent="$.agentId", files=r"/\.qwen/.*/chats/.*\.jsonl$", version="$.version",
        ),
        Spec(
            "pi", {"input": ("$.message.usage.input",), "read": ("$.message.usage.cacheRead",), "write": ("$.message.usage.cacheWrite",), "output": ("$.message.usage.output",), "reasoning": ("$.message.usage.reasoning",)},
            "exclusive", ("pi:message:{$.id|-}:{$.parentId|-}:{$.timestamp|-}",), ("$.type", "message"), ("$.message.model",), required=("input", "read", "write", "output"), files=r"/\.pi/agent/sessions/.*\.jsonl$", version="$.version", versions=("3",),
        ),
        Spec(
            "kimi-code", {"input": ("$.usage.inputOther",), "read": ("$.usage.inputCacheRead",), "write": ("$.usage.inputCacheCreation",), "output": ("$.usage.output",)},
            "exclusive", ("kimi-code:usage:{@session|nosession}:{@agent|noagent}:{$.time}:{@repeat}",), ("$.type", "usage.record"), ("$.model",), "$.time", required=("input", "read", "write", "output"), files=r"/\.kimi-code/sessions/.*/wire\.jsonl$", version="$.protocol_version", versions=("1.5",),
        ),
        Spec(
            "otel",
            {
                "input": ("$.attributes['gen_ai.usage.input_tokens']", "$.attributes['usage.input_tokens']"), "output": ("$.attributes['gen_ai.usage.output_tokens']", "$.attributes['usage.output_tokens']"),
                "read": ("$.attributes['gen_ai.usage.cache_read.input_tokens']", "$.attributes['usage.cache_read_input_tokens']"), "write": ("$.attributes['gen_ai.usage.cache_creation.input_tokens']", "$.attributes['usage.cache_creation_input_tokens']"),
                "reasoning": ("$.attributes['gen_ai.usage.reasoning.output_tokens']", "$.attributes['gen_ai.usage.reasoning_tokens']", "$.attributes['usage.reasoning_tokens']"),
            },
            "inclusive", ('otel:["{$.traceId|$.trace_id}","{$.spanId}"]', "otel:{$.spanId}"), ("$.name", "chat"), ("$.attributes['gen_ai.request.model']", "$.attributes['gen_ai.response.model']"), "$.startTime", required=("input", "output"), files=r"/otel/.*\.jsonl$",
        ),
    )
}


def _first(paths: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.get_json_object("value", p) for p in paths]) if paths else F.lit(None).cast("string")


def _named(template: str) -> Column:
    """A key by its template; null if a place in it has no value."""
    parts: list[Column] = []
    for text, inside in re.findall(r"([^{]*)(?:\{([^}]*)\})?", template):
        if text:
            parts.append(F.lit(text))
        if inside:
            choices = [F.get_json_object("value", c) if c[0] == "$" else F.col(f"{c[1:]}_").cast("string") if c[0] == "@" else F.lit(c) for c in inside.split("|")]
            parts.append(F.coalesce(*choices))
    return F.concat(*parts)


def _placed(records: DataFrame, spec: Spec) -> DataFrame:
    """Records with the places that the identity names; a record without a line or offset has null for it."""
    missing = [c for c in ("line", "offset") if c not in records.columns]
    placed = records.withColumns({c: F.lit(None).cast("long") for c in missing})
    folder = lambda k: F.try_element_at(F.split("file", "/"), F.lit(-k))
    session = F.get_json_object("value", spec.session) if spec.session else F.nullif(folder(4), F.lit(""))
    return placed.withColumns({"session_": session, "agent_": F.nullif(folder(2), F.lit("")), "index_": F.lit(None).cast("long"), "line_": F.col("line")})


def read(records: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """(events, faults) of JSON texts (file, value and, where known, line, offset, fault): tokens by the rule, record_key,
    model, at_ms and call_category; and by place what is not read, with why.

    Faults: of lines those of ``feeds.read_lines``; of documents not_a_document, and no_messages where there is no list of
    them; of usage records those of ``buckets.shape_fault``. Only lines are held to a length.
    """
    placed = _placed(records, spec)
    known = F.col("fault") if "fault" in records.columns else F.lit(None).cast("string")
    if spec.messages:
        each = F.from_json(F.get_json_object("value", spec.messages), "array<string>")
        broken = F.when(F.try_parse_json("value").isNull() | ~F.trim("value").startswith("{"), "not_a_document").when(each.isNull(), "no_messages")
        marked = placed.withColumn("fault", F.coalesce(known, broken))
        unread = marked.where("fault is not null")
        sound = marked.where("fault is null")
        records = sound.select(*[c for c in sound.columns if c not in ("value", "index_")], F.posexplode(each).alias("index_", "value"))
    else:
        marked = placed.withColumn("fault", F.coalesce(known, feeds.line_fault()))
        unread, records = marked.where("fault is not null"), marked.where("fault is null")
    if spec.kind:
        records = records.where(F.get_json_object("value", spec.kind[0]) == spec.kind[1])
    if any("@repeat" in template for template in spec.identity):
        same = Window.partitionBy("file", F.get_json_object("value", spec.time)).orderBy("line", "value")
        records = records.withColumn("repeat_", F.row_number().over(same) - 1)
    text, side, parent = (F.get_json_object("value", path) if path else F.lit(None).cast("string") for path in (spec.time, spec.sidechain, spec.parent))
    parts = {part: _first(paths).try_cast("long") for part, paths in spec.counts.items()}
    parts |= {"model_raw": _first(spec.model), "key_": F.coalesce(*[_named(t) for t in spec.identity]), "time_": text, "side_": side, "parent_": parent}
    # behind a generator, so that filters on the parts do not read the text again for each of them
    shaped = records.select("file", "line", "offset", "index_", F.inline(F.array(F.struct(*[c.alias(n) for n, c in parts.items()]))))
    shaped = shaped.withColumn("fault", buckets.shape_fault(F.col("model_raw"), {p: F.col(p) for p in spec.required}))
    source = buckets.Source({p: f"`{p}`" for p in spec.counts}, spec.rule, ["key_"], zero_unknown=spec.zero_unknown)
    sound = buckets.normalise(shaped.where("fault is null"), source)
    nothing = F.lit(None).cast("string")
    category = buckets.call_category(F.coalesce(F.col("side_") == "true", F.lit(False)), F.col("parent_"), F.col("file").cast("string"), nothing)
    at = buckets.instant(F.col("time_"), F.col("time_").try_cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long"))
    events = sound.withColumns({"at_ms": at, "call_category": category, "agent": F.lit(spec.name)})
    kept = ["agent", "file", "line", "record_key", "model_raw", "at_ms", "call_category", *buckets.COLUMNS, "diagnostic"]
    place = [F.lit(spec.name).alias("agent"), "file", F.coalesce("line", "index_").alias("line"), "offset", "fault"]
    return events.select(*kept), unread.select(*place).unionByName(shaped.where("fault is not null").select(*place))


def texts(spark: SparkSession, path: str, spec: Spec, files: str = "") -> DataFrame:
    """(file, line, offset, fault, value): the ended lines of a source's files or, where it writes documents, whole files of any length."""
    whole = lines.registered(spark).read.format("whole_lines").options(path=path, files=files, unit="file" if spec.messages else "line").load()
    if spec.messages:
        place = [F.lit(None).cast("long").alias(c) for c in ("line", "offset")]
        return whole.select("file", *place, F.lit(None).cast("string").alias("fault"), F.regexp_replace(F.col("value").cast("string"), "^\ufeff", "").alias("value"))
    return lines.readable(lines.numbered(whole)).select("file", "line", "offset", "fault", "value")


def read_lines(spark: SparkSession, path: str, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """``read`` of all files under a path as those of one source."""
    return read(texts(spark, path, spec), spec)


def discover(spark: SparkSession, path: str, specs: dict[str, Spec] = SPECS) -> DataFrame:
    """(file, size, agent): every file under a path and the source whose name it has, null if none claims it. No file is opened."""
    found = lines.registered(spark).read.format("whole_lines").options(path=path, unit="name").load().select("file", "size")
    agent = F.lit(None).cast("string")
    for spec in specs.values():
        agent = F.when(F.col("file").rlike(spec.files), spec.name).otherwise(agent) if spec.files else agent
    return found.withColumn("agent", agent)


def detect(records: DataFrame, spec: Spec) -> DataFrame:
    """(file, version, basis) of a source's texts: known_version, latest_fallback for a version that is not known or not told, or
    unsupported for a file in which no record has the source's shape. A file of no records at all has no row."""
    version = F.get_json_object("value", spec.version) if spec.version else F.lit(None).cast("string")
    if spec.messages:
        shaped = F.get_json_object("value", spec.messages).startswith("[")
    else:
        shaped = F.get_json_object("value", spec.kind[0]).isNotNull() if spec.kind else F.try_parse_json("value").isNotNull()
    each = records.groupBy("file").agg(F.min(version).alias("version"), F.bool_or(F.coalesce(shaped, F.lit(False))).alias("shaped_"))
    known = F.col("version").isin(*spec.versions) if spec.versions else F.lit(False)
    basis = F.when(~F.col("shaped_"), "unsupported").when(F.coalesce(known, F.lit(False)), "known_version").otherwise("latest_fallback")
    return each.select("file", "version", basis.alias("basis"))


def capability(spark: SparkSession, specs: dict[str, Spec] = SPECS) -> DataFrame:
    """(agent, part, told): what each source tells of a call: a count that it always has, one that it may have, or none."""
    rows = [(s.name, part, "always" if part in s.required else "sometimes" if part in s.counts else "never") for s in specs.values() for part in buckets.PARTS]
    return spark.createDataFrame(rows, "agent string, part string, told string")


def scan(spark: SparkSession, path: str, specs: dict[str, Spec] = SPECS) -> tuple[DataFrame, DataFrame]:
    """(events, faults) of a folder of mixed writers; each source reads its own files, and events have the ``basis`` of theirs.

    Beside the faults of ``read``: unknown_source for a file that no source claims, no_version_fits for one of another shape.
    """
    events = faults = None
    for spec in specs.values():
        if not spec.files:
            continue
        held = texts(spark, path, spec, spec.files)
        shapes = detect(held.where("fault is null"), spec)
        own, bad = read(held, spec)
        own = own.join(shapes.select("file", "basis"), "file", "left").select("agent", "file", "basis", *[c for c in own.columns if c not in ("agent", "file")])
        none = [F.lit(None).cast("long").alias(c) for c in ("line", "offset")]
        bad = bad.unionByName(shapes.where("basis = 'unsupported'").select(F.lit(spec.name).alias("agent"), "file", *none, F.lit("no_version_fits").alias("fault")))
        events, faults = (own, bad) if events is None else (events.unionByName(own), faults.unionByName(bad))
    strange = discover(spark, path, specs).where("agent is null")
    return events, faults.unionByName(strange.select("agent", "file", *none, F.lit("unknown_source").alias("fault")))
