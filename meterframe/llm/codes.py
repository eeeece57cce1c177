"""Codes of vectors: a small codebook for each part of a vector, by Lloyd's rounds over the entries that still move.

Components are scaled to whole numbers, so that every distance and mean is exact and a rerun gives the same code. A row
keeps, for each part, the entry that it is assigned to and the squared distance to it. After a round some entries have
moved. A part whose own entry has stayed compares only the moved ones with the distance that it keeps: all others are
as far as they were, and have lost before. A part whose own entry has moved is compared with all. Ties go to the lower
index. Each task hands on, beside its rows, how the sums and counts of the entries change by its own reassigned parts;
Spark adds these up, and the driver sees no more than one number for each component of the codebooks. A round that
moves no entry is the last.

Cases: rows whose vector is null or holds a null or non-finite component are dropped. Rows without a vec_id or label are
rows like any other; null ids come last where the first entries are chosen, and null labels are one label. Repeated rows
each have a code; of equal ids the smaller vector comes first. Shorter vectors, empty ones too, count as followed by zeros
up to the longest, and all up to a multiple of the parts. With fewer rows than entries the codebooks are as small.
Components beyond 2^47 count as 2^47; an error beyond a long is null, and so is a label's sum that holds one. Empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.llm.integers import distances, finite, matrix, scaled
from meterframe.llm.shared import hot_join, removed, written_at

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Squared distances and sums are longs up to this magnitude of scaled components, and decimals beyond.
PLAIN = 1 << 24
#: Rows of one numpy step.
ROWS = 8192
_LONG = (1 << 63) - 1


def assigned(part: np.ndarray, entries: np.ndarray, moved: np.ndarray, own: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row of ``part``; ``own``: its entry before, -1 for none; ``kept``: the distance to it."""
    own, kept = own.copy(), kept.copy()
    again = (own < 0) | moved[own]
    if again.any():
        away = distances(part[again], entries)
        own[again] = np.argmin(away, axis=1)  # the first of equal ones
        kept[again] = away[np.arange(len(away)), own[again]]
    active = np.flatnonzero(moved)
    rest = np.flatnonzero(~again)
    if len(active) and len(rest):
        away = distances(part[rest], entries[active])
        best = np.argmin(away, axis=1)
        least, name = away[np.arange(len(away)), best], active[best]
        nearer = ((least < kept[rest]) | ((least == kept[rest]) & (name < own[rest]))).astype(bool)
        own[rest[nearer]], kept[rest[nearer]] = name[nearer], least[nearer]
    return own, kept


def _changes(part: np.ndarray, before: np.ndarray, after: np.ndarray, entries: int) -> np.ndarray:
    """How sums and, in the last column, counts of the entries change."""
    out = np.zeros((entries, part.shape[1] + 1), part.dtype)
    for names, sign in ((after, 1), (before, -1)):
        turned = (before != after) & (names >= 0)
        np.add.at(out[:, :-1], names[turned], sign * part[turned])
        np.add.at(out[:, -1], names[turned], sign)
    return out


def _round(state: DataFrame, books: np.ndarray, moved: np.ndarray, plain: bool) -> DataFrame:
    """``state`` after one assignment; rows with ``change`` alone tell what the entries gain."""
    parts, entries, width = books.shape
    kind = "long" if plain else "decimal(38,0)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = np.zeros((parts, entries, width + 1), np.int64 if plain else object)
        names = ["vec_id", "label", "vector", "code", "kept", "change"]
        number = pa.int64() if plain else pa.decimal128(38, 0)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                vectors = matrix(batch.column(2), parts * width)
                vectors = vectors if plain else vectors.astype(object)
                if batch.column(3).null_count:  # the first round
                    codes, kept = np.full((batch.num_rows, parts), -1), np.zeros((batch.num_rows, parts), np.int64)
                else:
                    codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
                    kept = matrix(batch.column(4), parts) if plain else np.array([[int(x) for x in row] for row in batch.column(4).to_pylist()], object)
                kept = kept.copy() if plain else kept.astype(object)
                for p in range(parts):
                    part = vectors[:, p * width : (p + 1) * width]
                    before = codes[:, p]
                    after, kept[:, p] = assigned(part, books[p], moved[p], before, kept[:, p])
                    change[p] += _changes(part, before, after, entries)
                    codes[:, p] = after
                rows = [r.tobytes() for r in codes.astype(np.uint8)]
                values = pa.array(kept.ravel() if plain else [Decimal(x) for x in kept.ravel()], number)
                ends = pa.array(np.arange(0, kept.size + 1, parts, dtype=np.int32))
                columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(rows, pa.binary()), pa.ListArray.from_arrays(ends, values)]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(rows), pa.list_(pa.decimal128(38, 0)))], names)
        if change.any():
            told = pa.array([[Decimal(int(x)) for x in change.ravel()]], pa.list_(pa.decimal128(38, 0)))
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.list_(number))]
            yield pa.RecordBatch.from_arrays([*none, told], names)

    return state.mapInArrow(run, f"vec_id long, label string, vector array<long>, code binary, kept array<{kind}>, change array<decimal(38,0)>")


def _gathered(state: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The changes of all tasks added up: one number for each component and count of the codebooks."""
    out = np.zeros(shape, object)
    told = state.where("change is not null").select(F.posexplode("change").alias("place", "by")).groupBy("place").agg(F.sum("by").alias("by"))
    for place, by in told.collect():
        out.reshape(-1)[place] = int(by)
    return out


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(rows (vec_id, label, code, kept), codebooks by part and entry); ``label`` is told as text.

    ``code`` holds a byte for each part, ``kept`` the squared distance of the part to its entry.
    """
    spark = vectors.sparkSession
    clean = vectors.where(finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), scaled("embedding", scale).alias("vector"))
    held = clean.agg(F.max(F.size("vector")).alias("size"), F.max(F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector")))).alias("most")).first()
    width, plain = max(1, -(-(held.size or 0) // parts)), (held.most or 0) < PLAIN
    first = [r.vector for r in clean.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()]
    books = np.zeros((parts, len(first), width), np.int64)
    for e, vector in enumerate(first):
        books[:, e, :] = np.array([*vector, *[0] * (parts * width - len(vector))], np.int64).reshape(parts, width)
    kind = "long" if plain else "decimal(38,0)"
    state, path = clean.select("*", F.lit(None).cast("binary").alias("code"), F.lit(None).cast(f"array<{kind}>").alias("kept")), None
    totals, moved = np.zeros((parts, len(first), width + 1), object), np.ones((parts, len(first)), bool)
    for turn in range(rounds + 1):
        state, fresh = written_at(_round(state, books, moved, plain))
        if path:
            removed(spark, path)
        path = fresh
        if turn == rounds:
            break
        totals = totals + _gathered(state, totals.shape)
        used = totals[:, :, -1] > 0
        after = books.copy()
        after[used] = (totals[used][:, :-1] // totals[used][:, -1:]).astype(np.int64)
        moved, books = (after != books).any(axis=2), after
        if not moved.any():
            break
        state = state.where("change is null").drop("change")
    return state.where("change is null").select("vec_id", "label", "code", "kept"), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every row that is kept."""
    rows, books = fit(vectors, parts, entries, rounds)
    total = F.aggregate("kept", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))
    error = F.when(total <= _LONG, total).cast("long")
    # hot_join has no row for a null key: labels are told by a mark before them
    named = rows.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), error.alias("error"), F.coalesce(F.concat(F.lit("="), "label"), F.lit("")).alias("name"))
    whole = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")))
    sums = named.groupBy("name").agg(F.count("*").alias("n"), whole.alias("sum")).select("name", "n", F.when(F.col("sum") <= _LONG, F.col("sum")).cast("long").alias("label_error"))
    sums = written_at(sums)[0]
    count = sums.agg(F.sum("n")).first()[0] or 0
    found = hot_join(named, sums, "name", "n", count, "vec_id")
    return found.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
