"""Hard negatives of anchors: rows of another label that score below a positive, but not far below it.

An anchor's score with a row is the inner product of their whole-number vectors. Anchors are scored against all rows in
blocks: a task holds one part of the rows and one block of anchors. The first pass finds each anchor's positives: a part
hands on no more than the first few of each. These bound the scores that a negative may have, so that in the second pass
a part hands on each anchor's positives and, for each of them, the first negatives within its bounds: the rest cannot be
among the first of all. What is handed on is dealt by anchor and sorted inside the partitions by (anchor, falling score,
id), all of it packed into three longs. An iterator then reads each partition as a stream: a positive opens a window, a
negative goes to every open window that holds its score, and a window closes when it is full or the next anchor begins.
It holds the windows of one anchor, never its rows. At the same score positives come first, as a window may begin there.

Rows are copied for every ``ANCHORS`` anchors and anchors for every ``ROWS`` rows, as vectors; pairs are never rows.

Cases: rows with a null label, a null vector or a null or non-finite component take no part. A row without an id is no
anchor, comes last among equal scores, and is told with a null id. Rows of one id are rows of their own, the anchor's too:
each is an anchor, and a positive or negative of the others. Shorter vectors, empty ones too, count as followed by zeros.
Components beyond 2^47 count as 2^47 and scores beyond 2^60 as 2^60. Anchors without a positive, or without a negative
within bounds, have no rows. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterframe.llm.integers import finite, matrix, products, scaled
from meterframe.llm.shared import checkpointed, shuffle_partitions

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: The bounds of a negative's score, in hundredths of the positive's.
LOW, HIGH = 30, 90
#: Rows and anchors of one task.
ROWS = 65_536
ANCHORS = 16_384
#: Rows that are not worth a task of their own.
FEW = 1024
#: Anchors of one product: with ``ROWS`` rows a matrix of 16 million scores.
STEP = 256
_FAR = 1 << 60


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.clip(products(anchors, rows), -_FAR, _FAR).astype(np.int64)


def first(values: np.ndarray, ids: np.ndarray, places: np.ndarray, count: int) -> np.ndarray:
    """Those of ``places`` that come first by falling value, then id: ``count`` of them, or all."""
    if len(places) > 4 * count:  # only what reaches the value of the last one that may come first
        least = np.partition(values[places], len(places) - count)[len(places) - count]
        places = places[values[places] >= least]
    return places[np.lexsort((ids[places], -values[places]))[:count]]


def _within(low: int, high: int, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest whole score with low * positive <= 100 * score <= high * positive."""
    exact = positive.astype(object)
    return (-(-(low * exact) // 100)).astype(np.int64), (high * exact // 100).astype(np.int64)


_KEYS = "anchor long, down long, id long, anchor_id long, vec_id long, score long, positive boolean"
_SCORED = pa.schema([("anchor", pa.int64()), ("down", pa.int64()), ("id", pa.int64()), ("anchor_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("positive", pa.bool_())])


def _scored(rows: DataFrame, anchors: DataFrame, size: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """Sort keys and scores of the pairs that a part hands on. ``anchors`` with ``wanted``, the scores of their positives,
    ask for negatives within bounds, those without it for positives."""
    n_rows, n_anchors = rows.count(), anchors.count()
    spread = min(shuffle_partitions(rows.sparkSession), -(-n_rows // FEW))
    parts, blocks = max(1, spread, -(-n_rows // ROWS)), max(1, -(-n_anchors // ANCHORS))
    turn = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    copies = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = rows.select("row", "vec_id", "label", "vector", turn(parts).alias("part"), copies(blocks, "block"))
    right = anchors.select("row", "vec_id", "label", "vector", "wanted", turn(blocks).alias("block"), copies(parts, "part"))

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = []
        if held.num_rows and asked.num_rows:
            names, vectors = np.array(held.column("row")), matrix(held.column("vector"), size)
            told = held.column("label").combine_chunks().dictionary_encode()
            labels, number = np.array(told.indices), {name: k for k, name in enumerate(told.dictionary.to_pylist())}
            null = np.array(held.column("vec_id").is_null())
            ids = np.array(held.column("vec_id").fill_null(_LAST))
            own, kinds, queries = np.array(asked.column("row")), [number.get(x, -1) for x in asked.column("label").to_pylist()], matrix(asked.column("vector"), size)
            own_ids, wanted = np.array(asked.column("vec_id")), asked.column("wanted").to_pylist()
            for at in range(0, len(own), STEP):
                for i, value in enumerate(scores(queries[at : at + STEP], vectors), at):
                    same = labels == kinds[i]
                    if wanted[i] is None:
                        places = first(value, ids, np.flatnonzero(same & (names != own[i])), positives)
                        good = np.ones(len(places), bool)
                    else:
                        least, most = _within(low, high, np.array(wanted[i], np.int64))
                        other = np.flatnonzero(~same & (value >= least.min()) & (value <= most.max()))
                        picks = [first(value, ids, other[(value[other] >= a) & (value[other] <= b)], negatives) for a, b in zip(least.tolist(), most.tolist(), strict=True)]
                        places = np.unique(np.concatenate(picks))
                        good = np.zeros(len(places), bool)
                    score = value[places]
                    found.append([np.full(len(places), own[i]), 2 * (_FAR - score) + ~good, ids[places], np.full(len(places), own_ids[i]), ids[places], score, good, null[places]])
        if not found:
            return _SCORED.empty_table()
        *columns, null = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table([pa.array(c, f.type, mask=null if f.name == "vec_id" else None) for c, f in zip(columns, _SCORED, strict=True)], schema=_SCORED)

    right = right.toDF(*right.columns)  # columns of its own, for the grouping by both sides
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(run, _KEYS)


#: Where ids that are null stand among equal scores.
_LAST = (1 << 63) - 1


def _streamed(scored: DataFrame, handle: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """What ``handle`` yields for the pairs of a partition, which it gets one by one in the order of their keys."""
    names, kinds = zip(*[(name, {"long": pa.int64(), "int": pa.int32()}[kind]) for name, kind in map(str.split, schema.split(", "))], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = handle(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        while held := list(islice(told, 4096)):
            columns = zip(*held, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    ordered = scored.repartition("anchor").sortWithinPartitions("anchor", "down", "id")
    return ordered.mapInArrow(run, schema)


def _leading(rows: Iterator[tuple], count: int) -> Iterator[tuple]:
    """The first pairs of each anchor: (anchor, id, vec_id, score)."""
    current, seen = None, 0
    for anchor, _, key, _, vec_id, score, _ in rows:
        current, seen = (current, seen + 1) if anchor == current else (anchor, 1)
        if seen <= count:
            yield anchor, key, vec_id, score


def _windows(rows: Iterator[tuple], count: int, low: int, high: int) -> Iterator[tuple]:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from pairs in the order of their keys."""
    current, open_ = None, []
    for anchor, _, _, anchor_id, vec_id, score, positive in rows:
        if anchor != current:
            current, open_ = anchor, []
        if positive:
            open_.append([vec_id, score, 0])
            continue
        for window in open_:
            if window[2] < count and low * window[1] <= 100 * score <= high * window[1]:
                window[2] += 1
                yield anchor_id, window[0], window[2], vec_id, window[1], score


def mine(vectors: DataFrame, anchors: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows that ``anchors`` holds for.

    ``label`` is the label that counts; its value is told by its text.
    """
    asked = F.coalesce(anchors & F.col("vec_id").isNotNull(), F.lit(False)).alias("asked")
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("string").alias("label"), F.when(finite("embedding"), scaled("embedding", scale)).alias("vector"), asked)
    clean = checkpointed(whole.where("label is not null and vector is not null").withColumn("row", F.monotonically_increasing_id()))
    size = clean.agg(F.max(F.size("vector"))).first()[0] or 0
    own = clean.where("asked").withColumn("wanted", F.lit(None).cast("array<long>"))
    near = _scored(clean, own, size, positives, negatives, low, high)
    best = checkpointed(_streamed(near, lambda rows: _leading(rows, positives), "anchor long, id long, vec_id long, score long"))
    wanted = best.groupBy("anchor").agg(F.collect_list("score").alias("wanted"))
    known = checkpointed(own.drop("wanted").join(wanted, own.row == wanted.anchor).drop("anchor"))
    opened = best.join(known.select("row", F.col("vec_id").alias("anchor_id")), best.anchor == F.col("row"))
    opened = opened.select("anchor", (2 * (F.lit(_FAR) - F.col("score"))).alias("down"), "id", "anchor_id", "vec_id", "score", F.lit(True).alias("positive"))
    pairs = opened.unionByName(_scored(clean, known, size, positives, negatives, low, high))
    return _streamed(pairs, lambda rows: _windows(rows, negatives, low, high), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
