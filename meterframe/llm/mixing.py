"""Mixing sources to target weights, with DataFrame functions alone.

The words of a source, document after document, are cut into fixed-length blocks. Targets follow from weights, no
source being used more than twice, and give each source a number of slots. Every output shard draws how many slots it
has of each source: multinomial counts, given the sources' totals. A source's slots, shard after shard, are mapped to
its blocks by a pseudorandom permutation, pass after pass, and joined with the blocks by index. The last slot of a
source takes only what the target still lacks. What a document gives to the mix is what the slots take of its blocks.

Cases: a null text has size 0 and takes nothing; a null source is a source, the last in order. Rows of one doc_id are
rows of their own. Within a source documents are ordered by ranges of the MD5 of id and text, there by doc_id (null
first), size and MD5; equal rows are interchangeable. Very long texts are in many blocks. Empty tables give empty
results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterframe.llm.shared import checkpointed, shuffle_partitions

BLOCK = 32
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
SHARD_SLOTS = 65536
SEED = 42
#: Draws of one row.
RUN = 65536
#: Hexadecimal digits that name the ranges in which running sums and ranks are taken before their totals are added up.
RANGE_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Mix:
    """rows: row, k1, k2, doc_id, source, size, source_size, target, src, at (the row's first word in its source's words).

    sources: src, source, source_size, target. blocks: src, block, words, and rank, its place in the permutation.
    """

    rows: DataFrame
    sources: DataFrame
    blocks: DataFrame
    block: int


def _before(value: Column, keys: list[str], order: list[Column]) -> Column:
    return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) to (src, source, source_size, target): level * weight, or repeats * size where that is less.

    The level is the one at which the targets share ``share`` times all sizes, found from running sums in the order in
    which sources meet their bound. One task holds the table of sources, never their documents.
    """
    src = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    weighted = sizes.select(src.alias("src"), "source", "source_size").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("src") - 1) % len(weights) + 1))
    bound = (F.col("source_size") * repeats).cast("double")
    order = Window.orderBy(bound / F.col("weight"), "src")
    earlier, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum(bound).over(earlier), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    tried = weighted.select("*", level.alias("tried"), F.row_number().over(order).alias("turn"))
    level = F.min_by("tried", F.when(bound / F.col("weight") >= F.col("tried"), F.col("turn"))).over(every)
    return tried.withColumn("level", level).select("src", "source", "source_size", F.coalesce(F.least(bound, F.col("level") * F.col("weight")), bound).alias("target"))


def mix(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, keys: tuple[Column, Column] | None = None) -> Mix:
    """``keys``: two long columns by which the caller knows a row again, kept in ``rows`` as k1 and k2."""
    k1, k2 = keys or (F.lit(None).cast("long"), F.lit(None).cast("long"))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))).alias("tie"),
        k1.alias("k1"),
        k2.alias("k2"),
    )
    # equal rows are one with a number of copies until all have their places
    alike = checkpointed(sized.withColumn("range", F.substring("tie", 1, RANGE_DIGITS)).groupBy("source", "range", "doc_id", "size", "tie", "k1", "k2").agg(F.count("*").alias("copies")))
    held = alike.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    known = checkpointed(targets(held.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, repeats))
    same = F.col("l.source").eqNullSafe(F.col("r.source"))
    starts = held.alias("l").join(known.alias("r"), same).select("src", "r.source", "source_size", "target", "range", _before(F.col("words"), ["src"], [F.col("range")]).alias("start"))
    within = _before(F.col("size") * F.col("copies"), ["source", "range"], [F.asc_nulls_first("doc_id"), F.col("size"), F.col("tie"), F.col("k1"), F.col("k2")])
    placed = alike.withColumn("within", within)
    rows = placed.alias("l").join(starts.alias("r"), same & (F.col("l.range") == F.col("r.range")))
    rows = rows.select("k1", "k2", "doc_id", "l.source", "size", "source_size", "target", "src", (F.col("start") + F.col("within")).alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    rows = checkpointed(rows.select("k1", "k2", "doc_id", "source", "size", "source_size", "target", "src", (F.col("first") + F.col("copy") * F.col("size")).alias("at"), F.monotonically_increasing_id().alias("row")))

    first, last = F.ceil(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    begun = rows.where((F.col("size") > 0) & (first <= last)).select("src", "source_size", F.explode(F.sequence(first, last)).alias("block"))
    hashed = begun.withColumn("hash", F.md5(F.concat_ws("|", "src", "block"))).withColumn("range", F.substring("hash", 1, RANGE_DIGITS))
    counts = hashed.groupBy("src", "range").count()
    starts = counts.select("src", "range", _before(F.col("count"), ["src"], [F.col("range")]).alias("start"))
    rank = F.row_number().over(Window.partitionBy("src", "range").orderBy("hash", "block")) - 1
    ranked = hashed.withColumn("within", rank).join(starts, ["src", "range"]).withColumn("rank", F.col("start") + F.col("within"))
    words = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    return Mix(rows, known, ranked.select("src", "block", words.alias("words"), "rank"), block)


def _tasks(df: DataFrame, shards: int) -> int:
    """Tasks that a few rows, each of which makes many, are dealt to: a number given, since their bytes would tell Spark that one will do."""
    return max(1, min(shards, shuffle_partitions(df.sparkSession)))


def shard_counts(sources: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(src, shard, slots) of a table (src, n_slots): each source's slots, dealt over the shards by a seeded draw each.

    A shard's counts by source are thus multinomial given the sources' totals. Draws are made in runs of ``RUN``, so that
    no row holds more of them, and are added up before they are shuffled.
    """
    runs = sources.where("n_slots > 0").select("src", "n_slots", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / RUN))).alias("run"))
    runs = runs.repartition(_tasks(sources, shards), "src", "run")
    draws = runs.select("src", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("n_slots"), (F.col("run") + 1) * RUN) - 1)).alias("draw"))
    return draws.groupBy("src", F.pmod(F.xxhash64(F.lit(seed), "src", "draw"), F.lit(shards)).alias("shard")).agg(F.count("*").alias("slots"))


def slots(mixed: Mix, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, src, slot, block, turn, words, whole) of every slot of the mix.

    Slot s of a source has the block of rank s modulo the number of its blocks: the ranks are the source's pseudorandom
    permutation, met pass after pass. A slot of a whole pass takes all words of its block; in the last pass, the words
    that the target still lacks.
    """
    block = mixed.block
    aim, size = F.floor(F.col("target") + 0.5), F.col("source_size")
    sources = mixed.sources.where("source_size > 0").select("src", F.ceil(size / block).alias("each"), F.floor(aim / size).alias("passes"), (aim - F.floor(aim / size) * size).alias("rest"))
    sources = checkpointed(sources.withColumn("n_slots", F.col("passes") * F.col("each") + F.ceil(F.col("rest") / block)))
    total = sources.agg(F.sum("n_slots")).first()[0] or 0
    shards = max(1, -(-total // shard_slots))
    dealt = shard_counts(sources, shards, seed).withColumn("start", _before(F.col("slots"), ["src"], [F.col("shard")])).join(sources, "src")
    numbered = dealt.repartition(_tasks(sources, shards), "src", "shard").withColumn("slot", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("slots") - 1)))
    placed = numbered.select("src", "shard", "slot", F.pmod("slot", "each").alias("rank"), F.floor(F.col("slot") / F.col("each")).alias("turn"), "passes", "rest")
    whole = F.col("turn") < F.col("passes")
    lacking = F.least(F.col("words"), F.col("rest") - F.col("rank") * block)
    # Spark takes the slots to be as few as the rows that they are numbered from, and would broadcast them
    return placed.join(mixed.blocks.hint("merge"), ["src", "rank"]).select("shard", "src", "slot", "block", "turn", F.when(whole, F.col("words")).otherwise(lacking).cast("long").alias("words"), whole.alias("whole"))


def block_uses(mixed: Mix) -> DataFrame:
    """(src, block, passes, partial): how many slots take the whole block, and how many of its words one more takes."""
    return slots(mixed).groupBy("src", "block").agg(F.count_if("whole").alias("passes"), F.sum(F.when(F.col("whole"), 0).otherwise(F.col("words"))).alias("partial"))


def taken_ranges(mixed: Mix) -> DataFrame:
    """(row, passes, begin, end): of each block that a row reaches into, the whole passes, the row's words there, and those in the partial pass."""
    block = mixed.block
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    pieces = mixed.rows.where("size > 0").select("row", "src", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
    found = pieces.join(block_uses(mixed), ["src", "block"])
    start, stop = F.col("block") * block, F.col("at") + F.col("size")
    begin, end = F.greatest(F.col("at"), start), F.least(stop, start + F.col("partial"))
    return found.select("row", "passes", (F.least(stop, start + block) - begin).alias("words"), (begin - F.col("at")).alias("begin"), (F.greatest(begin, end) - F.col("at")).alias("end"))


def taken(mixed: Mix) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, taken) of every row: the words that the slots of its blocks take of it."""
    took = taken_ranges(mixed).groupBy("row").agg(F.sum(F.col("passes") * F.col("words") + F.col("end") - F.col("begin")).alias("took"))
    return mixed.rows.join(took, "row", "left").select("row", "doc_id", "source", "size", "source_size", "target", F.coalesce("took", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The columns of ``docs`` (doc_id, text, lang, source, n_chars) with the words that the mix takes of each row.

    A row comes once for each whole pass of its source, and once more, if blocks of it are in the partial pass, with
    the words of these blocks and the white space after each. A row without words is not in the mix.
    """
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    keys = F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)
    keyed = docs.select(*columns, keys[0].alias("k1"), keys[1].alias("k2"))
    mixed = mix(docs, block, keys=keys)
    part = F.when(F.col("begin") < F.col("end"), F.struct("begin", "end"))
    ranges = taken_ranges(mixed).groupBy("row").agg(F.max("passes").cast("int").alias("passes"), F.array_sort(F.collect_list(part)).alias("ranges"))
    takes = mixed.rows.select("row", "k1", "k2").join(ranges, "row").where("passes > 0 or size(ranges) > 0").select("k1", "k2", "passes", "ranges")
    words = F.regexp_extract_all("text", F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), 1)
    some = F.size("ranges") > 0
    cut = F.array_join(F.flatten(F.transform("ranges", lambda r: F.slice("words", r.begin.cast("int") + 1, (r.end - r.begin).cast("int")))), "")
    joined = keyed.dropDuplicates(["k1", "k2"]).join(takes, ["k1", "k2"]).withColumn("words", F.when(some, words))
    texts = F.concat(F.array_repeat("text", F.col("passes")), F.when(some, F.array(cut)).otherwise(F.array().cast("array<string>")))
    return joined.select("doc_id", F.explode(texts).alias("text"), "lang", "source").select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))
