"""From raw documents to packed training sequences: five stages, each over all that the one before it has kept.

Every stage but the last returns the columns of ``documents``. A row is known again by two 64-bit hashes of all that it
holds, so that equal rows share a decision. Null texts are rejected by the language stage; a null doc_id is a row like any other.
Of near-duplicates the document of the least doc_id stays (without ids: of the least hashes), once if the row is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.llm import language, mixing, packing, quality, simhash
from meterframe.llm.shared import written

#: Keys of rejected rows that are broadcast, 64 MB of them at most; more are joined by a shuffle of the documents.
FEW = 1 << 22
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KEYS = ("k1", "k2")


def _keys() -> list[Column]:
    return [F.xxhash64(*COLUMNS).alias("k1"), F.xxhash64(F.lit(1), *COLUMNS).alias("k2")]


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` but for the rows of the rejected keys, which are written and counted first: their number decides how they are joined."""
    gone = written(rejected.select(*KEYS).distinct())
    gone = F.broadcast(gone) if gone.count() <= FEW else gone
    return docs.select(*COLUMNS, *_keys()).join(gone, list(KEYS), "left_anti").select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus declares."""
    evidence = language.document_evidence(docs.select(*COLUMNS, *_keys()), KEYS)
    return _without(docs, language.identify(evidence, language.fit(evidence), KEYS).where("not kept"))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly labelled scorer does not reject."""
    return quality.classify(docs, carry=COLUMNS).where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group that links of verified similarity join."""
    found = written(simhash.verified_near_duplicates(docs.select(*_keys(), "doc_id", "text"), (*KEYS, "doc_id")))
    single = found.distinct()
    least = single.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *KEYS)).alias("first"))
    keys = written(least.select(*[F.col(f"first.{k}").alias(k) for k in KEYS]))
    kept = _without(docs, single.join(keys, list(KEYS), "left_anti"))
    if found.count() == single.count():
        return kept
    return kept.select(*COLUMNS, *_keys()).dropDuplicates(list(KEYS)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", classify_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The stages draw on trained models, XXH64 and a tokenizer; they are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
