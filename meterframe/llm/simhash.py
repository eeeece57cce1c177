"""SimHash near-duplicates: tiled exact comparison by exclusive-or and bit counts.

Cases: a null text counts as empty; a text without words has fingerprint zero, which links like any other; a text of
fewer words than a shingle is one shingle. Repeated rows keep one result each. A null doc_id gets a fingerprint, and
the component of whatever ids it reaches (null if none). Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.llm.blocks import blocks, column_bytes, shingle_hashes, shingle_spans, sliced
from meterframe.llm.components import connected_components, rooted
from meterframe.llm.shared import checkpointed, hot_join, written

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 1 << 15
#: Of verified near-duplicates: words in a shingle, least Jaccard similarity, and bits within which candidates lie.
NEAR_SHINGLE = 5
NEAR = 0.8
NEAR_RADIUS = 14
NEAR_TILE = 1 << 17
#: Nodes of one tile of what is still open after the first links.
OPEN_TILE = 4096
#: Buckets of the shingle counts that bound a pair's similarity from above before its texts are read.
HISTOGRAM = 64
#: Candidates of one pair of tiles that are held before they are cut down to a least spanning forest.
HELD = 1 << 20
_U = np.uint64


def simhashes(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Bit i is set where it is set in more than half of the shingles' XXH64 values."""
    ones = np.zeros((len(texts), 64), np.int64)
    total = np.zeros(len(texts), np.int64)
    for block in blocks(enumerate(texts), overlap=shingle - 1):
        first, last, bounds = shingle_spans(block, shingle)
        some = np.flatnonzero(np.diff(bounds))
        if not len(some):
            continue
        view, digest = memoryview(block.text), xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(block.starts[first].tolist(), block.ends[last].tolist(), strict=True)), _U, len(first))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        np.add.at(ones, block.rows[some], np.add.reduceat(bits, bounds[some], axis=0, dtype=np.int32))
        np.add.at(total, block.rows, np.diff(bounds))
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(_U).ravel()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, bits: the fingerprint's 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = simhashes(column_bytes(batch.column(1)), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64), pa.int64())], ["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sliced(run), "doc_id long, bits long")


def _halves(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.bitwise_count(bits >> _U(32)), np.bitwise_count(bits & _U(0xFFFFFFFF))


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join all of a and b that are within the radius, at most one for each fingerprint."""
    every = a if b is a else np.concatenate([a, b])
    offset = 0 if b is a else len(a)
    label = np.arange(len(every))
    rows = max(1, (1 << 18) // max(1, len(b)))
    for at in range(0, len(a), rows):
        i, j = np.nonzero(np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= radius)
        i, j = i + at, j + offset
        while len(i):
            x, y = label[i], label[j]
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            if len(i):
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while (label[label] != label).any():
                    label = label[label]
    moved = np.flatnonzero(label != np.arange(len(every)))
    return list(zip(every[moved].view(np.int64).tolist(), every[label[moved]].view(np.int64).tolist(), strict=True))


def links(bits: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(u, v) pairs of distinct fingerprints whose components are those of all pairs within ``radius`` bits.

    A tile holds about ``tile`` fingerprints with the same population counts of their two halves. Two tiles are
    compared only if these counts differ by no more than the radius together. The driver sees the sizes of the
    33 * 33 population classes alone. Of each pair of tiles only a spanning forest is kept.
    """
    high, low = F.bit_count(F.shiftrightunsigned("bits", 32)), F.bit_count(F.col("bits").bitwiseAND(F.lit(0xFFFFFFFF)))
    classed = bits.select("bits", (high * 33 + low).cast("int").alias("cls"))
    tiles_in = {r.cls: -(-r["count"] // tile) for r in classed.groupBy("cls").count().collect()}
    if not tiles_in:
        return classed.select(F.col("bits").alias("u"), F.col("bits").alias("v")).limit(0)
    near = {c: [d for d in tiles_in if abs(c // 33 - d // 33) + abs(c % 33 - d % 33) <= radius] for c in tiles_in}
    split = F.element_at(F.create_map(*[F.lit(x) for kv in tiles_in.items() for x in kv]), F.col("cls"))
    grouped = classed.select("cls", F.pmod(F.xxhash64("bits"), split).cast("int").alias("part"), "bits").groupBy("cls", "part").agg(F.array_sort(F.collect_list("bits")).alias("held"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A tile goes to every pair it is in; a pair is named by the two (class, part)."""
        for batch in batches:
            for c, p, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = np.asarray(held.values, np.int64).tobytes()
                pairs = [sorted([(c, p), (d, q)]) for d in near[c] for q in range(tiles_in[d])]
                for at in range(0, len(pairs), 64):
                    x, y = zip(*pairs[at : at + 64], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in side], pa.int32()) for side in (x, y) for i in (0, 1)] + [pa.array([data] * len(x), pa.binary())], ["a", "i", "b", "j", "held"])

    def compare(table: pa.Table) -> pa.Table:
        sides = [np.frombuffer(x, _U) for x in table.column("held").to_pylist()]
        same = table.column("a")[0].as_py() == table.column("b")[0].as_py() and table.column("i")[0].as_py() == table.column("j")[0].as_py()
        found = _forest(sides[0], sides[0] if same else sides[1], radius) if same or len(sides) > 1 else []
        return pa.table({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([y for _, y in found], pa.int64())})

    pairs = grouped.mapInArrow(spread, "a int, i int, b int, j int, held binary")
    return pairs.groupBy("a", "i", "b", "j").applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, bits, component_id): component_id is the least doc_id reachable over links of ``radius`` bits or fewer."""
    signed = checkpointed(fingerprints(docs, shingle).withColumn("row", F.monotonically_increasing_id()))
    distinct = checkpointed(signed.groupBy("bits").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    parts = connected_components(links(distinct, radius))
    return hot_join(signed, rooted(distinct, parts, "bits"), "bits", "n", signed.count(), "row").select("doc_id", "bits", "component_id")


def _profiles(texts: list[bytes], shingle: int) -> list[bytes]:
    """How many of a text's distinct shingles fall into each bucket."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for block in blocks(enumerate(texts), overlap=shingle - 1):
        hashes, bounds = shingle_hashes(block, shingle)
        for k, row in enumerate(block.rows.tolist()):
            found[row].append(hashes[bounds[k] : bounds[k + 1]])
    sets = [np.unique(np.concatenate(x)) if x else np.zeros(0, _U) for x in found]
    return [np.bincount((x >> _U(58)).astype(np.int64), minlength=HISTOGRAM).astype(np.uint32).tobytes() for x in sets]


def _set(bits: np.ndarray) -> np.ndarray:
    """np.flatnonzero, quick where few are set."""
    some = np.flatnonzero(np.packbits(bits))
    place = (some[:, None] * 8 + np.arange(8)).ravel()
    place = place[place < len(bits)]
    return place[bits[place]]


def spanning(n: int, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the pairs of a spanning forest of least distances, component of each of n nodes)."""
    label, kept = np.arange(n), []
    for d in np.unique(far):
        at = np.flatnonzero(far == d)
        while len(at):
            x, y = label[i[at]], label[j[at]]
            at, x, y = (v[x != y] for v in (at, x, y))
            if len(at):
                high, low = np.maximum(x, y), np.minimum(x, y)
                order = np.lexsort((low, high))
                roots, first = np.unique(high[order], return_index=True)
                kept.append(at[order[first]])
                label[roots] = low[order[first]]
                while (label[label] != label).any():
                    label = label[label]
    return np.concatenate(kept) if kept else np.zeros(0, np.int64), label


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, is_open) of the pairs within the radius of two tiles of records (node, bits, class) whose classes differ.

    All of them where a component has at most four for each node; of a larger component only a spanning forest of least
    distances, and each of its nodes beside itself, marked as open.
    """
    every = a if b is a else np.concatenate([a, b])
    offset = 0 if b is a else len(a)
    i = j = np.zeros(0, np.int64)
    far = np.zeros(0, np.uint8)
    cut = np.zeros(len(every), bool)
    fresh: list[tuple[np.ndarray, ...]] = []
    held = 0
    rows = max(1, (1 << 18) // max(1, len(b)))
    for at in range(0, len(a), rows):
        distance = np.bitwise_count(a["bits"][at : at + rows, None] ^ b["bits"][None, :])
        place = _set(distance.ravel() <= radius)
        x, y = np.divmod(place, len(b))
        d, x, y = distance[x, y], x + at, y + offset
        apart = every["cls"][x] != every["cls"][y] if b is not a else (x < y) & (every["cls"][x] != every["cls"][y])
        fresh.append((x[apart], y[apart], d[apart]))
        held += len(fresh[-1][0])
        if held > HELD:
            i, j, far = (np.concatenate([v, *w]) for v, w in zip((i, j, far), zip(*fresh, strict=True), strict=True))
            cut[i] = cut[j] = True
            kept, _ = spanning(len(every), i, j, far)
            i, j, far, fresh, held = i[kept], j[kept], far[kept], [], 0
    if fresh:
        i, j, far = (np.concatenate([v, *w]) for v, w in zip((i, j, far), zip(*fresh, strict=True), strict=True))
    node = every["node"]
    kept, label = spanning(len(every), i, j, far)
    pairs, nodes = np.bincount(label[i], minlength=len(every)), np.bincount(label, minlength=len(every))
    large = pairs > 4 * nodes
    large[label[cut]] = True
    part = ~large[label[i]]
    part[kept] = True
    opened = np.flatnonzero(large[label])
    return np.concatenate([node[i[part]], node[opened]]), np.concatenate([node[j[part]], node[opened]]), np.repeat([False, True], [part.sum(), len(opened)])


def candidates(nodes: DataFrame, radius: int = NEAR_RADIUS, tile: int = NEAR_TILE) -> DataFrame:
    """(u, v, is_open) of a table of (node, bits, cls): the pairs of ``_near`` of all pairs of tiles."""
    n = nodes.count()
    tiles = max(1, -(-n // tile), min(16, -(-n // 2048)))
    record = np.dtype([("node", np.int64), ("bits", _U), ("cls", np.int64)])
    grouped = nodes.select(F.pmod(F.xxhash64("node"), F.lit(tiles)).cast("int").alias("part"), F.struct("node", "bits", "cls").alias("one")).groupBy("part").agg(F.collect_list("one").alias("held"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.empty(len(held.values), record)
                for name in record.names:
                    data[name] = np.asarray(held.values.field(name), np.int64).view(record[name])
                data = data.tobytes()
                for q in range(tiles):
                    yield pa.RecordBatch.from_arrays([pa.array([min(p, q)], pa.int32()), pa.array([max(p, q)], pa.int32()), pa.array([p], pa.int32()), pa.array([data], pa.binary())], ["a", "b", "p", "held"])

    def compare(table: pa.Table) -> pa.Table:
        sides = [np.frombuffer(x, record) for x in table.column("held").to_pylist()]
        same = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        u, v, opened = _near(sides[0], sides[0] if same else sides[1], radius) if same or len(sides) > 1 else (*np.zeros((2, 0), np.int64), np.zeros(0, bool))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "is_open": pa.array(opened, pa.bool_())})

    return grouped.mapInArrow(spread, "a int, b int, p int, held binary").groupBy("a", "b").applyInArrow(compare, "u long, v long, is_open boolean")


def _texts_of(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text), compressed, of the nodes asked for."""
    from meterframe.llm import fingerprints

    held = fingerprints.matching(docs.select("node", "text"), "node", asked).join(asked, "node")
    return written(held.groupBy("node").agg(F.any_value("text").alias("text")))


def _decided(nodes: DataFrame, docs: DataFrame, radius: int, threshold: float, tile: int = OPEN_TILE) -> DataFrame:
    """(u, v) links of verified similarity among (node, bits, cls), of all pairs within the radius whose classes differ.

    Tiles are compared in pairs. The texts of nodes that have such a pair go to the tiles where they have it, once each;
    there the nearest pairs are verified first, and a link spares the pairs of the classes that it joins.
    """
    from meterframe.llm import fingerprints

    tiles = max(1, -(-nodes.count() // tile))
    placed = nodes.withColumns({"i": F.pmod(F.xxhash64("node"), F.lit(tiles)).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))})
    copied = placed.select("node", "bits", "cls", "i", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))

    def near(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, differing bits) of the pairs."""
        bits, cls = np.asarray(table.column("bits")).view(_U), np.asarray(table.column("cls"))
        left = np.asarray(table.column("i")) == table.column("a")[0].as_py()
        same = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        rows, others = np.flatnonzero(left), np.flatnonzero(left if same else ~left)
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))]
        for at in range(0, len(rows), 256):
            some = rows[at : at + 256]
            far = np.bitwise_count(bits[some, None] ^ bits[None, others])
            x, y = np.nonzero((far <= radius) & (cls[some, None] != cls[None, others]) & ((some[:, None] < others[None, :]) | (not same)))
            found.append((some[x], others[y], far[x, y]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def needed(table: pa.Table) -> pa.Table:
        i, j, _ = near(table)
        return table.take(pa.array(np.union1d(i, j)))

    def decide(table: pa.Table) -> pa.Table:
        node, cls = np.asarray(table.column("node")), table.column("cls").to_pylist()
        sets = [fingerprints._shingles(t) for t in fingerprints._unsqueezed(table.column("text"))]
        root = {c: c for c in cls}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        i, j, far = near(table)
        u, v = [], []
        for k in np.argsort(far, kind="stable").tolist():
            x, y = int(i[k]), int(j[k])
            a, b = find(cls[x]), find(cls[y])
            if a != b and fingerprints._similar(sets[x], sets[y], threshold):
                root[a] = b
                u.append(node[x])
                v.append(node[y])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    wanted = written(copied.groupBy("a", "b").applyInArrow(needed, "node long, bits long, cls long, i int, a int, b int"))
    read = _texts_of(written(wanted.select("node").distinct()), docs)
    return wanted.join(read, "node").groupBy("a", "b").applyInArrow(decide, "u long, v long")


def _verified(pairs: DataFrame, profiles: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose texts are that similar. The texts of a pair are read only if its profiles leave it possible."""
    from meterframe.llm import fingerprints

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(-1, HISTOGRAM).astype(np.int64) for c in batch.columns[2:])
            both = np.minimum(a, b).sum(axis=1)
            keep = both >= threshold * (a.sum(axis=1) + b.sum(axis=1) - both)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], ["u", "v"])

    def beside(table: DataFrame, value: str) -> DataFrame:
        return table.select(F.col("node").alias("u"), F.col(value).alias("a")), table.select(F.col("node").alias("v"), F.col(value).alias("b"))

    left, right = beside(profiles, "profile")
    likely = written(pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(sliced(possible), "u long, v long"))
    asked = written(likely.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    left, right = beside(_texts_of(asked, docs), "text")
    held = likely.join(left, "u").join(right, "v").select(F.col("u").alias("head"), F.col("v").alias("cls"), "a", "b")
    return fingerprints.verified(held, threshold).select(F.col("head").alias("u"), F.col("cls").alias("v"))


def verified_near_duplicates(docs: DataFrame, keys: tuple[str, ...] = ("key",), radius: int = NEAR_RADIUS, threshold: float = NEAR) -> DataFrame:
    """(keys, class_id) of every row of (keys, text), the classes being those of all candidates of Jaccard >= threshold.

    Candidates are distinct texts whose fingerprints of five-word shingles lie within the radius; each is verified on
    whole texts, unless other verified links have joined its two texts already. Texts of one XXH64 are one node.
    """
    docs = docs.select(*keys, F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("node", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column_bytes(batch.column("text"))
            found = simhashes(texts, NEAR_SHINGLE).view(np.int64)
            carried = [batch.column(c) for c in (*keys, "node")]
            yield pa.RecordBatch.from_arrays([*carried, pa.array(found), pa.array(_profiles(texts, NEAR_SHINGLE), pa.binary())], [*keys, "node", "bits", "profile"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys)
    signed = written(docs.mapInArrow(sliced(run), f"{schema}, node long, bits long, profile binary"))
    nodes = checkpointed(signed.groupBy("node", "bits").agg(F.count("*").alias("n")).withColumn("cls", F.col("node")))
    found = written(candidates(nodes, radius))
    profiles = signed.select("node", "profile").dropDuplicates(["node"])
    links = written(_verified(found.where("not is_open").select("u", "v"), profiles, docs, threshold))
    classes = connected_components(links)
    opened = found.where("is_open").select(F.col("u").alias("node")).distinct()
    if not opened.isEmpty():
        again = checkpointed(nodes.select("node", "bits").join(opened, "node").join(classes, "node", "left").select("node", "bits", F.coalesce("root", "node").alias("cls")))
        links = written(links.unionByName(_decided(again, docs, radius, threshold)))
        classes = connected_components(links)
    of_node = checkpointed(nodes.join(classes, "node", "left").select("node", "n", F.coalesce("root", "node").alias("class_id")))
    return hot_join(signed.select(*keys, "node"), of_node, "node", "n", signed.count(), keys[0]).drop("node")
