"""Nearest neighbours by low-dimensional stable projections, a kd-tree over them, and a chi-square stopping test.

Vectors are projected on a few Gaussian directions. The squared ratio of projected to true distance then follows a
chi-square law. The search takes the vectors of the leaves within reach in order of their own projected distance, verifies
them a few at a time by the true distance, and ends when a neighbour nearer than the k-th found would, with the asked
probability, have been met. So the recall that is expected is at least ``CONFIDENCE``, and most vectors are only projected.

The upper levels of the tree are fitted on about ``FIT`` vectors and deal every vector into a cell; a cell of more
than ``CELL`` vectors is split by hash, so equal vectors may be any share of the rows. A query first searches its own
cell, which bounds its k-th distance, then only the cells that the test does not rule out. A length with at most
``CELL`` vectors is one cell.

Cases: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows whose id is
null. Rows of one id are each a candidate and a query, but not candidates for one another. Only vectors of the same
length are compared, however many lengths there are. Distances are taken in double precision on the vectors as they are
stored, as floats or doubles. Ties go to the smaller id. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterframe.llm.blocks import sliced
from meterframe.llm.shared import checkpointed

DIRECTIONS = 24
CONFIDENCE = 0.95
FIT = 20_000
CELL = 8192
LEAF = 64
#: The most cells of one length: a bound of the tree that each task holds; larger cells are split by hash.
CELLS = 4096
#: Queries of one task.
QUERIES = 16384


def chi_square(x: np.ndarray, degrees: int = DIRECTIONS) -> np.ndarray:
    """The distribution function for an even number of degrees."""
    half = np.minimum(np.asarray(x, float) / 2, 700)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, degrees // 2):
        term = term * half / i
        total += term
    return 1 - np.exp(-half) * total


def quantile(probability: float, degrees: int = DIRECTIONS) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(np.array(middle), degrees) < probability else (low, middle)
    return high


def directions(size: int, count: int = DIRECTIONS) -> np.ndarray:
    return np.random.default_rng(size).standard_normal((size, count))


def leaves(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Index arrays of the leaves: halves at the median of the widest direction until no more than ``most`` are left."""
    out, open_ = [], [np.arange(len(points))]
    while open_:
        held = open_.pop()
        if len(held) <= most:
            out.append(held)
            continue
        widest = int(np.argmax(np.ptp(points[held], axis=0)))
        held = held[np.argpartition(points[held, widest], len(held) // 2)]
        open_ += [held[: len(held) // 2], held[len(held) // 2 :]]
    return out


class Cells:
    """The upper levels of the tree: (direction, cut) of each inner node, in heap order; leaves are the cells."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.cut = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        held = {1: sample}
        for node in range(1, 1 << depth):
            points = held.pop(node)
            if len(points):
                self.axis[node] = np.argmax(np.ptp(points, axis=0))
                self.cut[node] = np.median(points[:, self.axis[node]])
            right = points[:, self.axis[node]] > self.cut[node]
            held[2 * node], held[2 * node + 1] = points[~right], points[right]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - (1 << self.depth)

    def distances(self, point: np.ndarray) -> np.ndarray:
        """The squared distance of a projected point to the box of each cell."""
        low, high = np.full((1, len(point)), -np.inf), np.full((1, len(point)), np.inf)
        for level in range(self.depth):
            nodes = np.arange(1 << level, 2 << level)
            low, high = np.repeat(low, 2, axis=0), np.repeat(high, 2, axis=0)
            left, right, axis, cut = 2 * np.arange(len(nodes)), 2 * np.arange(len(nodes)) + 1, self.axis[nodes], self.cut[nodes]
            high[left, axis] = np.minimum(high[left, axis], cut)
            low[right, axis] = np.maximum(low[right, axis], cut)
        away = np.maximum(0, np.maximum(low - point, point - high))
        return (away * away).sum(axis=1)


class Tree:
    """The vectors of one cell part, as leaves with their boxes. Of equal vectors the k + 1 least ids are enough."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.lexsort(ids[None])
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        _, group = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)
        seen = np.argsort(group, kind="stable")
        sizes = np.bincount(group)
        turn = np.empty(len(ids), np.int64)
        turn[seen] = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        few = turn <= 2 * k
        # rows of one id are no neighbours of each other, so more than k + 1 rows may be needed where ids repeat
        if not few.all() and len(np.unique(ids)) < len(ids):
            few[:] = True
        ids, vectors = ids[few], vectors[few]
        points = vectors @ directions(vectors.shape[1])
        parts = leaves(points, LEAF)
        at = np.concatenate(parts)
        self.ids, self.vectors, self.points = ids[at], vectors[at], points[at]
        #: Vectors that searches have compared by their true distance.
        self.met = 0
        self.bounds = np.cumsum([0, *map(len, parts)])
        self.low = np.array([points[p].min(axis=0) for p in parts])
        self.high = np.array([points[p].max(axis=0) for p in parts])

    def search(self, own: int, vector: np.ndarray, point: np.ndarray, bound: float, k: int, stop: float) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the k nearest that may still be among the k nearest of all."""
        slack = 1e-9 * float(point @ point)
        away = np.maximum(0, np.maximum(self.low - point, point - self.high))
        near = np.flatnonzero((away * away).sum(axis=1) - slack <= stop * bound * bound)
        rows = np.concatenate([np.arange(self.bounds[x], self.bounds[x + 1]) for x in near] or [np.zeros(0, np.int64)])
        rows = rows[self.ids[rows] != own]
        gap = self.points[rows] - point
        far = np.einsum("ij,ij->i", gap, gap) - slack
        order = np.argsort(far, kind="stable")
        rows, far = rows[order], far[order]
        best, names = np.zeros(0), np.zeros(0, np.int64)
        at, step = 0, 2 * k
        while at < len(rows):
            kth = min(bound, best[k - 1] if len(best) >= k else np.inf)
            some = rows[at : min(at + step, int(np.searchsorted(far, stop * kth * kth, side="right")))]
            if not len(some):
                break
            gap = self.vectors[some] - vector
            best, names = np.concatenate([best, np.sqrt((gap * gap).sum(axis=1))]), np.concatenate([names, self.ids[some]])
            keep = np.lexsort((names, best))[:k]
            best, names = best[keep], names[keep]
            at, step = at + len(some), min(2 * step, 256)
        self.met += at
        return best, names


def _matrix(column) -> np.ndarray:
    """The vectors of one length in the column, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _projected(column) -> np.ndarray:
    """The projections of the vectors in a column, whatever their lengths."""
    lengths = np.asarray(column.value_lengths(), np.int64)
    out = np.zeros((len(lengths), DIRECTIONS))
    for size in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == size)
        out[at] = _matrix(column.take(pa.array(at))) @ directions(size)
    return out


_FOUND = "row long, query_id long, vec_id long, score double"
_PLACE = ["size", "cell", "part"]


def _blocks(vectors: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors and queries by block: a cell part's queries are cut into blocks of about ``QUERIES``, and only its own vectors
    are copied for each of them."""
    blocks = asked.groupBy(*_PLACE).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    turn = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    asked = asked.join(blocks, _PLACE).withColumn("block", turn).drop("blocks")
    copies = blocks.select(*_PLACE, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    held = vectors.select(*_PLACE, "vec_id", "embedding").join(copies, _PLACE)
    return held, asked.toDF(*asked.columns)  # columns of its own, for the grouping by both sides


def _search(vectors: DataFrame, asked: DataFrame, k: int, confidence: float) -> DataFrame:
    """asked: row, size, cell, part, query_id, embedding, bound."""
    stop = quantile(confidence)

    def run(held: pa.Table, queries: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if held.num_rows and queries.num_rows:
            tree = Tree(np.array(held.column("vec_id")), _matrix(held.column("embedding")), k)
            wanted = _matrix(queries.column("embedding"))
            points = wanted @ directions(wanted.shape[1])
            for row, own, bound, vector, point in zip(queries.column("row").to_pylist(), queries.column("query_id").to_pylist(), queries.column("bound").to_pylist(), wanted, points, strict=True):
                best, names = tree.search(own, vector, point, bound, k, stop)
                rows += [(row, own, n, s) for s, n in zip(best.tolist(), names.tolist(), strict=True)]
        row, own, name, score = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table({"row": pa.array(row, pa.int64()), "query_id": pa.array(own, pa.int64()), "vec_id": pa.array(name, pa.int64()), "score": pa.array(score, pa.float64())})

    held, asked = _blocks(vectors, checkpointed(asked))
    keys = [*_PLACE, "block"]
    return held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, _FOUND)


def _fitted(clean: DataFrame) -> dict[int, Cells]:
    """The upper levels for each length of more than ``CELL`` vectors, fitted on projections of at most about ``FIT`` of them all together."""
    large = {r["size"]: r["count"] for r in clean.groupBy("size").count().where(F.col("count") > CELL).collect()}
    if not large:
        return {}
    each = max(1, FIT // len(large))
    share = F.element_at(F.create_map(*[F.lit(x) for size, n in large.items() for x in (size, min(1.0, each / n))]), F.col("size"))
    picked = clean.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < share * (1 << 30)).select("size", "embedding")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _projected(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.tobytes() for p in points], pa.binary())], ["size", "point"])

    found = picked.mapInArrow(project, "size int, point binary").toArrow()
    sizes, points = np.array(found.column("size")), np.frombuffer(b"".join(found.column("point").to_pylist())).reshape(-1, DIRECTIONS)
    return {size: Cells(points[sizes == size], min(math.ceil(math.log2(n / CELL)), int(math.log2(CELLS)))) for size, n in large.items()}


def nearest(vectors: DataFrame, queries: F.Column, k: int = 10, confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row that ``queries`` holds for.

    All lengths go through one plan; a length is part of a cell's name.
    """
    exact = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    embedding = F.col("embedding").cast("array<float>" if exact else "array<double>")
    sound = F.size("embedding") > 0
    sound &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), embedding.alias("embedding"), queries.alias("asked")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(sound, F.lit(False)))
    clean = checkpointed(clean.select("*", F.size("embedding").alias("size"), F.monotonically_increasing_id().alias("row")))
    trees = _fitted(clean)
    number = "float" if exact else "double"
    names = ["size", "vec_id", "embedding", "asked", "row"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, sizes = _projected(batch.column("embedding")), np.asarray(batch.column("size"))
            found = np.zeros(batch.num_rows, np.int32)
            for size, tree in trees.items():
                found[sizes == size] = tree.of(points[sizes == size])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*names, "cell"])

    placed = checkpointed(clean.select(*names).mapInArrow(place, f"size int, vec_id long, embedding array<{number}>, asked boolean, row long, cell int"))
    # a length without a tree has one cell of CELL vectors at most, so only cells of trees are counted, and split
    treed = F.col("size").isin(list(trees))
    parts = {size: np.zeros(1 << tree.depth, np.int64) for size, tree in trees.items()}
    for r in placed.where(treed).groupBy("size", "cell").count().collect() if trees else ():
        parts[r["size"]][r["cell"]] = -(-r["count"] // CELL)
    split = {f"{size}/{cell}": int(n) for size, held in parts.items() for cell, n in enumerate(held) if n > 1}
    part = F.lit(0)
    if split:
        many = F.element_at(F.create_map(*[F.lit(x) for kv in split.items() for x in kv]), F.concat_ws("/", "size", "cell"))
        part = F.coalesce(F.pmod(F.xxhash64("row"), many).cast("int"), part)
    dealt = placed.withColumn("part", part)
    home = dealt.where("asked").select("size", F.col("vec_id").alias("query_id"), "embedding", "row", "cell", "part", F.lit(float("inf")).alias("bound"))
    first = checkpointed(_search(dealt, home, k, confidence))
    worst = first.groupBy("row").agg(F.count("*").alias("n"), F.max("score").alias("worst")).select("row", F.when(F.col("n") >= k, F.col("worst")).alias("bound"))
    stop = quantile(confidence)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for every part of a cell within reach of its bound, but the one that it has searched."""
        for batch in batches:
            points, within = _projected(batch.column("embedding")), np.asarray(batch.column("bound"))
            sizes, cells, own = (np.asarray(batch.column(c)) for c in ("size", "cell", "part"))
            rows, to_cell, to_part = [], [], []
            for i, point in enumerate(points):
                counts = parts[int(sizes[i])]
                near = np.flatnonzero((counts > 0) & (trees[int(sizes[i])].distances(point) - 1e-9 * float(point @ point) <= stop * within[i] * within[i]))
                cell = np.repeat(near, counts[near])
                turn = np.arange(len(cell)) - np.repeat(np.cumsum(counts[near]) - counts[near], counts[near])
                other = (cell != cells[i]) | (turn != own[i])
                rows.append(np.full(other.sum(), i))
                to_cell.append(cell[other])
                to_part.append(turn[other])
            if rows:
                again = batch.take(pa.array(np.concatenate(rows)))
                moved = {"cell": pa.array(np.concatenate(to_cell).astype(np.int32)), "part": pa.array(np.concatenate(to_part).astype(np.int32))}
                yield pa.RecordBatch.from_arrays([moved.get(n, again.column(n)) for n in again.schema.names], again.schema.names)

    every = first
    if trees:  # without one, every query has met all vectors of its length
        known = home.where(treed).drop("bound").join(worst, "row", "left").select("size", "query_id", "embedding", "row", "cell", "part", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
        asked = known.mapInArrow(sliced(spread, 64), f"size int, query_id long, embedding array<{number}>, row long, cell int, part int, bound double")
        every = first.unionByName(_search(dealt, asked, k, confidence))
    rank = F.row_number().over(Window.partitionBy("row").orderBy("score", "vec_id"))
    return every.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
