"""The registered queries of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meterframe.llm.fingerprints import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from meterframe.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from meterframe.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meterframe.llm.sharding import assign

    return assign(table(spark, sf_dir, "documents"))


@query
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meterframe.llm.mixing import mix, taken

    return taken(mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op8_source_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', coalesce(text, ''))) AS tie, row_number() OVER () AS rid
  FROM documents),
sources AS (
  SELECT row_number() OVER (ORDER BY source NULLS LAST) AS src, source, source_size
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
weighted AS (SELECT *, CAST([3, 1, 2][(src - 1) % 3 + 1] AS BIGINT) AS weight, CAST(source_size * 2 AS DOUBLE) AS bound FROM sources),
tried AS (
  SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(bound) OVER earlier, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS tried,
         row_number() OVER (ORDER BY bound / weight, src) AS turn
  FROM weighted WINDOW earlier AS (ORDER BY bound / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(tried, turn) FILTER (WHERE bound / weight >= tried) AS level FROM tried),
targets AS (SELECT src, source, source_size, coalesce(least(bound, level * weight), bound) AS target FROM tried, level),
placed AS (
  SELECT s.rid, s.doc_id, s.size, t.src, t.source_size, t.target,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY t.src ORDER BY substring(s.tie, 1, 3), s.doc_id NULLS FIRST, s.size, s.tie
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
blocks AS (
  SELECT src, block, source_size, target, row_number() OVER (PARTITION BY src ORDER BY md5(concat_ws('|', src, block)), block) - 1 AS rank
  FROM (SELECT src, source_size, target, unnest(range(0, CAST(ceil(source_size / 32.0) AS BIGINT))) AS block FROM targets)),
parts AS (
  SELECT src, block, greatest(0, least(32, source_size - block * 32,
         floor(target + 0.5) - floor(floor(target + 0.5) / source_size) * source_size - rank * 32)) AS partial
  FROM blocks),
pieces AS (SELECT rid, src, pos, size, unnest(range(pos // 32, (pos + size - 1) // 32 + 1)) AS block FROM placed WHERE size > 0),
part AS (
  SELECT p.rid, sum(greatest(0, least(p.pos + p.size, p.block * 32 + b.partial) - greatest(p.pos, p.block * 32))) AS part
  FROM pieces p JOIN parts b USING (src, block) GROUP BY p.rid)
SELECT r.doc_id, r.size, r.source_size, r.target,
       CAST(CASE WHEN r.source_size > 0 THEN floor(floor(r.target + 0.5) / r.source_size) ELSE 0 END * r.size + coalesce(part.part, 0) AS BIGINT) AS taken
FROM placed r LEFT JOIN part USING (rid)
"""


@query
def op3_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from meterframe.llm.transducer import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op5_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from meterframe.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op4_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from meterframe.llm.language import document_evidence, fit, identify, page_evidence
    from meterframe.llm.shared import written

    ids = {"doc_id": F.lit(None).cast("long"), "page_id": F.lit(None).cast("long")}
    docs = document_evidence(table(spark, sf_dir, "documents").withColumn("page_id", ids["page_id"]), ("doc_id", "page_id"))
    pages = written(page_evidence(table(spark, sf_dir, "pages"))).withColumn("doc_id", ids["doc_id"])
    evidence = docs.unionByName(pages)
    return identify(evidence, fit(evidence), ("doc_id", "page_id"))


@query
def op9_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meterframe.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"))


@query
def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meterframe.llm.katz import score

    return score(table(spark, sf_dir, "documents"))


@query
def op11_active_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meterframe.llm.codes import compress

    return compress(table(spark, sf_dir, "embeddings")).drop("label")


#: Whether a vector is there and all its components are finite.
_FINITE = "embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round compares every part with every entry."""
    steps = [
        f"""rows_ AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, q) AS rid, vec_id, label, q
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE {_FINITE})),
wide AS (SELECT greatest(1, CAST(ceil(coalesce(max(len(q)), 0) / {parts}.0) AS BIGINT)) AS w FROM rows_),
piece AS MATERIALIZED (
  SELECT rid, part, list_slice(list_resize(q, {parts} * w, 0), part * w + 1, part * w + w) AS x
  FROM rows_, wide, (SELECT unnest(range({parts})) AS part)),
comp AS MATERIALIZED (SELECT rid, part, generate_subscripts(x, 1) AS pos, unnest(x) AS v FROM piece),
book0 AS MATERIALIZED (SELECT part, rid - 1 AS e, x AS c FROM piece WHERE rid <= {entries})"""
    ]
    dot = "list_inner_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))".format
    for r in range(rounds + 1):
        steps.append(
            f"""near{r} AS MATERIALIZED (
  SELECT rid, part, min(CAST({dot("x", "x")} - 2 * {dot("x", "c")} + {dot("c", "c")} AS BIGINT) * 256 + e) AS best
  FROM piece JOIN book{r} USING (part) GROUP BY rid, part)"""
        )
        if r < rounds:
            steps.append(
                f"""mean{r} AS (
  SELECT part, e, list(m ORDER BY pos) AS c
  FROM (SELECT c.part, best % 256 AS e, pos, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM comp c JOIN near{r} USING (rid, part) GROUP BY c.part, best % 256, pos)
  GROUP BY part, e),
book{r + 1} AS MATERIALIZED (SELECT part, e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m USING (part, e))"""
            )
    return "WITH " + ", ".join(steps) + f""",
coded AS (
  SELECT vec_id, label, string_agg(lpad(lower(to_hex(best % 256)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error
  FROM rows_ JOIN near{rounds} USING (rid) GROUP BY rid, vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM book{rounds}) AS codebooks_sha256
FROM coded
"""


ORACLES["op11_active_lloyd_codes"] = _codes_sql()


@query
def op12_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meterframe.llm.licences import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from meterframe.llm.negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


ORACLES["op13_hard_negatives"] = f"""
WITH rows_ AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
scored AS MATERIALIZED (
  SELECT a.rid AS arid, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM rows_ a, rows_ b WHERE a.vec_id % 100 = 0 AND a.rid <> b.rid),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id NULLS LAST) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.arid, p.rid ORDER BY n.score DESC, n.vec_id NULLS LAST) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.arid = p.arid AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.arid, p.rid ORDER BY n.score DESC, n.vec_id NULLS LAST) <= 10
"""
