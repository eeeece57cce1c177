"""Language identification by fusing the evidence of text, declared language, address suffix and host.

Likelihoods of the text come from byte trigrams of texts with a declared language, counted over all documents. What
pages declare, and the suffix of their address, are weighed by how often each goes with each language. The prior of
a host is smoothed towards its domain's, and the domain's towards all pages', each from counts by grouped
aggregation (the suffix is evidence of its own and not counted again). A class ``und`` whose trigrams are all alike stands for text in no known language.

Cases: null, empty and wordless texts have no text evidence: they are ``und`` and rejected. A null declaration, suffix
or host adds nothing. Repeated rows keep one result each. Ties go to the language that comes first by name. Without
any declared language all is ``und``. Empty tables give empty results; columns besides those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterframe.llm import trigrams
from meterframe.llm.blocks import column_bytes, sliced
from meterframe.llm.shared import checkpointed, hot_join

BUCKETS = 4096
UNKNOWN = "und"
UNKNOWN_PRIOR = 0.01
#: Overlapping trigrams are not independent: three of them count as one observation.
TEMPER = 1 / 3
SMOOTH = 0.1
#: Trigrams of all languages together that smooth each one's counts: one with few texts looks like all of them.
POOLED = 100.0
STRENGTH = 5.0
#: How much less likely than chance, in nats a trigram, a known language may make a text before it counts as unknown.
MARGIN = 1.0
#: A text's languages that lie this many nats behind its best one are left out: what is declared, suffix and host, each
#: counted over fewer than 10 ** 15 rows, cannot make up for more than four times 40 nats.
REACH = 200.0
#: Rows that a value seen in no known language counts for.
LEAST = 1e-6
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def primary(tag: Column) -> Column:
    """The primary subtag of a language tag, in lower case; null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(tag)), "^([a-z]{2,3})(?:[-_]|$)", 1), F.lit(""))


def page_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, suffix, domain, host) of raw pages."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    text = F.regexp_replace("html", r"(?is)<(script|style|head|nav)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    parts = pages.select("page_id", text.alias("text"), primary(declared).alias("declared"), F.nullif(host, F.lit("")).alias("host"))
    return parts.withColumn("suffix", F.element_at(F.split("host", r"\."), -1)).withColumn("domain", F.array_join(F.slice(F.split("host", r"\."), -2, 2), "."))


def document_evidence(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, text, declared, suffix, domain, host) of documents: the source stands for the host, its last label for the suffix."""
    host = F.lower("source")
    parts = docs.select(*keys, "text", primary(F.col("lang")).alias("declared"), host.alias("host"))
    dotted = F.col("host").contains(".")
    return parts.withColumn("suffix", F.when(dotted, F.element_at(F.split("host", r"\."), -1))).withColumn("domain", F.when(dotted, F.array_join(F.slice(F.split("host", r"\."), -2, 2), ".")))


def fit(texts: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood of each bucket by language) of a table of (text, declared).

    Every declared language is told apart. A primary subtag has two or three letters, so that there are fewer than 18,300
    whatever the number of texts, and some hundreds in use; the driver gets their counts of BUCKETS buckets each.
    """
    names = sorted(r.declared for r in texts.where("declared is not null").select("declared").distinct().collect())
    if not names:
        return [], np.zeros((0, BUCKETS))
    place = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            groups = np.array([place.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
            here, local = np.unique(groups[groups >= 0], return_inverse=True)
            groups[groups >= 0] = local
            found = trigrams.counts(column_bytes(batch.column(0)), groups, len(here), BUCKETS, _FOLD)
            for lang, counts in zip(here.tolist(), found, strict=True):
                total[lang] = total.get(lang, 0) + counts
        for lang, counts in total.items():
            bucket = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), lang, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[bucket])], ["lang", "bucket", "n"])

    counted = texts.where("declared is not null").select("text", "declared").mapInArrow(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((len(names), BUCKETS))
    total[np.array(counted.column("lang")), np.array(counted.column("bucket"))] = np.array(counted.column("n"))
    pooled = (total.sum(axis=0) + SMOOTH) / (total.sum() + SMOOTH * BUCKETS)
    return names, np.log((total + POOLED * pooled) / (total.sum(axis=1, keepdims=True) + POOLED))


_EVIDENCE = ("declared", "suffix", "domain", "host")
_CANDIDATES = "cands array<struct<lang:int,log:double,soft:double>>"


def likelihoods(evidence: DataFrame, model: tuple[list[str], np.ndarray], keys: tuple[str, ...]) -> DataFrame:
    """(keys, declared, suffix, domain, host, cands): of every language within ``REACH`` of the best, the text's log-likelihood and its share."""
    names, logs = model
    table = np.vstack([logs, np.full((1, BUCKETS), -np.log(BUCKETS) - MARGIN)])
    held = [*keys, *_EVIDENCE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column_bytes(batch.column("text"))
            found = TEMPER * (trigrams.counts(texts, np.arange(len(texts)), len(texts), BUCKETS, _FOLD) @ table.T)
            found[:, -1] += np.log(UNKNOWN_PRIOR)
            found[[not t.translate(_FOLD).strip() for t in texts], :-1] = -1e9
            found -= found.max(axis=1, keepdims=True, initial=-np.inf)
            near = found >= -REACH
            near[:, -1] = True
            soft = np.exp(found)
            soft /= soft.sum(axis=1, keepdims=True)
            lang = np.nonzero(near)[1].astype(np.int32)
            ends = np.zeros(len(texts) + 1, np.int32)
            np.cumsum(near.sum(axis=1), out=ends[1:])
            cands = pa.StructArray.from_arrays([pa.array(lang), pa.array(found[near]), pa.array(soft[near])], ["lang", "log", "soft"])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in held], pa.ListArray.from_arrays(pa.array(ends), cands)], [*held, "cands"])

    whole = evidence.select(*keys, "text", *_EVIDENCE)
    schema = ", ".join([*[f"`{c}` {whole.schema[c].dataType.simpleString()}" for c in held], _CANDIDATES])
    return whole.mapInArrow(sliced(run, 256), schema)


def gathered(rows: DataFrame, languages: int) -> DataFrame:
    """(kind, value, rows, known, by_lang): how many rows each declaration, suffix, domain and host has, by the text's own best guesses.

    Counts are added up before they are shuffled; a value's map has at most as many entries as there are languages.
    """
    values = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in _EVIDENCE])
    each = rows.select(F.explode(F.filter(values, lambda v: v.value.isNotNull())).alias("at"), "cands").select("at.*", F.explode("cands").alias("c"))
    counted = each.groupBy("kind", "value", F.col("c.lang").alias("lang")).agg(F.sum("c.soft").alias("n"))
    entry = F.when(F.col("lang") < languages, F.struct("lang", "n"))
    return counted.groupBy("kind", "value").agg(F.sum("n").alias("rows"), F.sum(entry.n).alias("known"), F.map_from_entries(F.collect_list(entry)).alias("by_lang"))


def identify(evidence: DataFrame, model: tuple[list[str], np.ndarray], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, language, probability, text_language, kept) of every row of (keys, text, declared, suffix, domain, host).

    A language's log posterior is the text's log-likelihood, plus how much likelier than usual it makes the declaration
    and the suffix, plus the log of its prior over the uniform one. The prior of a host leans on its domain's, and that on
    all rows', as if each had ``STRENGTH`` rows of the one above. ``und`` has the likelihood of evenly spread trigrams alone.
    """
    names, _ = model
    if not names:
        unknown = F.lit(UNKNOWN)
        return evidence.select(*keys, unknown.alias("language"), F.lit(1.0).alias("probability"), unknown.alias("text_language"), F.lit(False).alias("kept"))
    n = len(names)
    rows = checkpointed(likelihoods(evidence, model, keys).withColumn("_row", F.monotonically_increasing_id()))
    totals = {r.lang: r.n for r in rows.select(F.explode("cands").alias("c")).groupBy("c.lang").agg(F.sum("c.soft").alias("n")).collect()}  # a number for each language
    each = [float(totals.get(i, 0.0)) for i in range(n)]
    count, known = sum(totals.values()), max(1.0, sum(each))
    tables = checkpointed(gathered(rows, n))
    joined = rows
    for kind in _EVIDENCE:
        table = tables.where(F.col("kind") == kind).select(F.col("value").alias(kind), F.col("rows").alias("_rows"), F.struct(F.coalesce("known", F.lit(0.0)).alias("known"), "by_lang").alias(f"{kind}_seen"))
        joined = hot_join(joined, table, kind, "_rows", count, "_row", "left")
    of_all, base = F.lit(each), F.lit([(x + 1.0) / (sum(each) + n) for x in each])

    def seen(kind: str, lang: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col(f"{kind}_seen.by_lang"), lang), F.lit(0.0))

    def likelier(kind: str, lang: Column) -> Column:
        share = (F.col(f"{kind}_seen.known") + LEAST) / known
        return F.coalesce(F.log((seen(kind, lang) + STRENGTH * share) / (of_all[lang] + STRENGTH) / share), F.lit(0.0))

    def prior(lang: Column) -> Column:
        value = base[lang]
        for kind in ("domain", "host"):
            value = F.coalesce((seen(kind, lang) + STRENGTH * value) / (F.col(f"{kind}_seen.known") + STRENGTH), value)
        return value

    def posterior(c: Column) -> Column:
        fused = c.log + likelier("declared", c.lang) + likelier("suffix", c.lang) + F.log(prior(c.lang) * n)
        return F.struct(F.when(c.lang < n, fused).otherwise(c.log).alias("log"), (-c.lang).alias("turn"))

    scored = joined.select(*keys, F.transform("cands", posterior).alias("fused"), F.array_max(F.transform("cands", lambda c: F.struct(c.log.alias("log"), (-c.lang).alias("turn")))).alias("text"))
    best = scored.select(*keys, "fused", "text", F.array_max("fused").alias("best"))
    every = F.lit([*names, UNKNOWN])
    probability = 1 / F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x.log - F.col("best.log")))
    return best.select(*keys, every[-F.col("best.turn")].alias("language"), probability.alias("probability"), every[-F.col("text.turn")].alias("text_language"), (-F.col("best.turn") < n).alias("kept"))
