"""Names, token totals, qualities, contradictions and exact money as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LONG = 9_223_372_036_854_775_807


def fold_name(name: Column) -> Column:
    return F.lower(name)


def model_key(model: Column) -> Column:
    """Lower case, separators as single hyphens; Claude versions with hyphens for dots."""
    key = F.regexp_replace(F.regexp_replace(F.lower(model), r"[\s_-]+", "-"), "^-+|-+$", "")
    return F.when(key.startswith("claude-"), F.replace(key, F.lit("."), F.lit("-"))).otherwise(key)


# Vendor namespaces that a reference model drops, aliases of serving names, vendors by family.
NAMESPACES = ("openai/", "anthropic/", "google/", "moonshotai/", "moonshot/", "kimi-code/", "kimi-coding/", "kimi-for-coding-backup/", "tencent/", "codebuddy/", "alibaba/", "alibaba-cn/")
ALIASES = {
    "gpt-5.5-2026-04-23": "gpt-5.5",
    "k3": "kimi-k3",
    "k3-256k": "kimi-k3",
    "k3.1-pro": "kimi-k3.1-pro",
    "k3.1-pro-highspeed": "kimi-k3.1-pro-highspeed",
    "k28-agent-preview": "kimi-k2.8-preview",
    "hy4-preview-f": "hy4-preview",
    "hy-4-preview": "hy4-preview",
}
DATED_ALIASES = {"kimi-for-coding": (1_789_084_800_000, "kimi-k2.8-preview")}
VENDORS = (
    (r"^gpt-|^o[134](-|$)", ("openai",)),
    (r"^claude-", ("anthropic",)),
    (r"^gemini-", ("google",)),
    (r"^kimi-|^moonshot-|^k3$|^k3-256k$", ("moonshot", "moonshotai", "moonshotai-cn")),
    (r"^glm-", ("zai", "zhipuai")),
    (r"^deepseek-", ("deepseek",)),
    (r"^hy4-", ("tencent", "tencent-cloud")),
    (r"^qwen", ("alibaba", "alibaba-cn")),
)


def reference_model(model: Column, provider: Column, at_ms: Column) -> Column:
    """The model that a price list would name: without its own provider's or a known namespace, aliases resolved at the usage date."""
    key = model_key(model)
    prefix, leaf = F.substring_index(key, "/", 1), F.regexp_replace(key, "^[^/]*/", "")
    own = F.coalesce(key.contains("/") & ((model_key(provider) == prefix) | (F.lower(F.trim(provider)) == "github-copilot")), F.lit(False))
    bare = F.when(own, leaf).otherwise(key)
    bare = model_key(F.regexp_replace(bare, "^(" + "|".join(NAMESPACES) + ")", ""))
    found = F.element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), bare)
    for name, (since, target) in DATED_ALIASES.items():
        found = F.when((bare == name) & (at_ms >= since), F.lit(target)).otherwise(found)
    return F.coalesce(found, bare)


def official_providers(model: Column) -> Column:
    out = F.array().cast("array<string>")
    for pattern, names in reversed(VENDORS):
        out = F.when(model.rlike(pattern), F.array(*map(F.lit, names))).otherwise(out)
    return out


def price_substitutes(model: Column, provider: Column) -> Column:
    """Models whose price may stand in, in order of preference."""
    return F.array_compact(
        F.array(
            F.when(model.endswith("-preview") & (F.length(model) > 8), F.regexp_replace(model, "-preview$", "")),
            F.when(model == "kimi-k2.8-preview", F.lit("kimi-k2.7-code")),
            F.when((model == "codex-auto-review") & (F.lower(F.trim(provider)) == "openai"), F.lit("gpt-5.6-luna")),
        )
    )


def event_id(instance: Column, key: Column) -> Column:
    def escaped(c: Column) -> Column:
        return F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("#"), F.lit("%23"))

    return F.concat(escaped(instance), F.lit("#"), escaped(key))


def content_hash(columns: list[str]) -> Column:
    """Equal for equal content; the observation time and the parse basis are not content."""
    kept = [c for c in columns if c not in ("observed_at_ms", "parse_basis")]
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in kept]))


def checked_sum(*parts: Column) -> Column:
    """Null if a part is; an overflow is an error under ANSI mode."""
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def input_total(prefix: str = "", quality: str = "q_") -> tuple[Column, Column]:
    """(value, quality) of the input total: the three exclusive buckets where all are known, else the reported total."""
    names = ("input_uncached", "input_cache_read", "input_cache_write")
    parts = [F.col(prefix + n) for n in names]
    total = F.try_add(F.try_add(parts[0], parts[1]), parts[2])
    estimated = F.lit(False)
    for n in names:
        estimated = estimated | (F.col(quality + n) == "estimated")
    return F.coalesce(total, F.col(prefix + "input_total")), F.when(total.isNotNull(), F.when(estimated, "estimated").otherwise("derived")).otherwise(F.col(quality + "input_total"))


def total_tokens(prefix: str = "", quality: str = "q_") -> tuple[Column, Column]:
    value, kind = input_total(prefix, quality)
    total = F.try_add(value, F.col(prefix + "output_total"))
    estimated = (kind == "estimated") | (F.col(quality + "output_total") == "estimated")
    return F.coalesce(total, F.col(prefix + "total_tokens")), F.when(total.isNotNull(), F.when(estimated, "estimated").otherwise("derived")).otherwise(F.col(quality + "total_tokens"))


def contradictions() -> Column:
    """(code, field, detail) of the contradictions among an event's token columns, in a fixed order."""
    c = F.col
    total, _ = total_tokens()
    both = c("input_cache_read").cast("decimal(38,0)") + c("input_cache_write")
    # Codes, fields, and how a detail names its values.
    checks = (
        ("cache_read_exceeds_input_total", "input_cache_read", c("input_cache_read") > c("input_total"), ("cache_read ", c("input_cache_read"), " > input_total ", c("input_total"))),
        ("cache_write_exceeds_input_total", "input_cache_write", c("input_cache_write") > c("input_total"), ("cache_write ", c("input_cache_write"), " > input_total ", c("input_total"))),
        ("cache_sum_exceeds_input_total", "input_total", both > c("input_total"), ("cache_read ", c("input_cache_read"), " + cache_write ", c("input_cache_write"), " > input_total ", c("input_total"))),
        ("reasoning_exceeds_output_total", "output_reasoning", c("output_reasoning") > c("output_total"), ("reasoning ", c("output_reasoning"), " > output_total ", c("output_total"))),
        ("uncached_exceeds_input_total", "input_uncached", c("input_uncached") > c("input_total"), ("uncached ", c("input_uncached"), " > input_total ", c("input_total"))),
        ("source_total_mismatch", "source_total", c("source_total") != total, ("source_total ", c("source_total"), " != normalized total ", total)),
    )

    def row(code: str, field: str, test: Column, told: tuple) -> Column:
        detail = F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in told])
        return F.when(test, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), detail.alias("detail")))

    return F.array_compact(F.array(*[row(*check) for check in checks]))


def component_amount(tokens: Column, rate: Column) -> Column:
    """Minor units of tokens at hundredths of a minor unit a million tokens, rounded half up."""
    exact = tokens.cast("decimal(38,0)") * rate.cast("decimal(19,0)") + F.lit(50_000_000).cast("decimal(38,0)")
    return F.call_function("div", exact, F.lit(100_000_000).cast("decimal(38,0)"))


def usd_to_hundredths(usd: Column) -> Column:
    return F.when((usd > 0) & (usd < 1e14), F.floor(usd * 10_000 + 0.5).cast("long"))


def display_bound(value: Column, *known: Column) -> tuple[Column, Column]:
    """(shown value, whether it is only a lower bound)."""
    return F.coalesce(value, F.greatest(*known) if len(known) > 1 else known[0]), value.isNull()


def heat_level(value: Column, most: Column) -> Column:
    """1 to 4 by the share of the greatest value; 0 for none."""
    return F.when(value <= 0, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(4), F.ceil(value * 4 / most)))).cast("int")


def hit_rate(read: Column, fresh: Column) -> Column:
    return F.when(read + fresh == 0, F.lit(0.0)).otherwise(F.round(F.lit(100.0) * read / (read + fresh), 2))


def version_parts(version: Column) -> Column:
    """A dotted version as numbers, for comparison; parts that are no numbers count as zero."""
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(F.try_to_number(F.regexp_extract(p, "^[0-9]+", 0), F.lit("999999999")).cast("int"), F.lit(0)))
