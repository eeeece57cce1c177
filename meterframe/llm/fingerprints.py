"""MinHash fingerprints: multiple universal hash permutations over word shingles, banded joins, verified Jaccard.

Cases: a null text counts as empty. Without words the fingerprint is ``ffff...``, and two such are alike (1.0); a text
of fewer words than a shingle is one shingle. Repeated rows keep one result each. In document order a null id comes
last, rows of one id are one place, and the text that stands for it is the first by two hashes. A table of one document
has itself as the next. Texts are the same if two 64-bit hashes of them are. Very long texts are signed whole, in blocks.
Empty tables give empty results; columns besides those named are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterframe.llm.blocks import blocks, column_bytes, mix, shingle_hashes, sliced
from meterframe.llm.components import connected_components, rooted
from meterframe.llm.shared import checkpointed, hot_join, shuffle_partitions, written

PERMUTATIONS = 128
SHINGLE = 5
#: Bands of a signature and its components in each: a pair of similarity 0.8 shares none with a chance of 5 in 100,000.
BANDS, ROWS = 25, 5
THRESHOLD = 0.8
#: Pairs whose signatures are less alike are no candidates: one of similarity 0.8 has a chance of 1 in 100 million to be so.
LEAST = 0.6
#: The most bands that are looked for as large, and the parts that these are cut into; bands of at most ``PART`` texts are not cut.
HEAVY = 100
PART = 10_000
#: Bits of the filter by which texts that are asked for are found.
MARKS = 1 << 25
#: Texts of one tile of a band.
TILE = 2048
_U = np.uint64


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * count + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return seeds[:count] | _U(1), seeds[count:]


def signatures(texts: list[bytes], permutations: int = PERMUTATIONS, shingle: int = SHINGLE) -> np.ndarray:
    """One row of 16-bit minima for each text: the low bits of the least value of each permutation a*x + b."""
    least = np.full((permutations, len(texts)), np.iinfo(_U).max, _U)
    a, b = _permutations(permutations)
    for block in blocks(enumerate(texts), overlap=shingle - 1):
        hashes, bounds = shingle_hashes(block, shingle)
        some = np.flatnonzero(np.diff(bounds))
        if not len(some):
            continue
        rows, starts, moved = block.rows[some], bounds[some], np.empty_like(hashes)
        for k in range(permutations):
            np.multiply(hashes, a[k], out=moved)
            moved += b[k]
            found = np.minimum.reduceat(moved, starts)
            least[k, rows] = np.minimum(least[k, rows], found)
    return (least.T & _U(0xFFFF)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity: the share of equal components."""
    return (a == b).mean(axis=1)


def _hex(signature: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in signature.astype(">u2")]


def fingerprints(docs: DataFrame, permutations: int = PERMUTATIONS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint as hex) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = _hex(signatures(column_bytes(batch.column(1)), permutations, shingle))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def _edges(docs: DataFrame, parts: int) -> list[int]:
    """At most ``parts`` - 1 ids that cut the ids into ranges of about equal counts."""
    ranks = [i / parts for i in range(1, parts)]
    found = docs.select(F.percentile_approx("doc_id", ranks, 10 * parts).alias("q")).first() if ranks else None
    return sorted(set(found.q)) if found and found.q else []


def _range_of(column: str, edges: list[int]) -> F.Column:
    """How many of the sorted edges lie above the value: by groups of edges first, then inside the group."""
    if not edges:
        return F.lit(0)
    step = math.isqrt(len(edges) - 1) + 1
    falling = edges[::-1]
    groups = [falling[i : i + step] for i in range(0, len(falling), step)]
    lasts = F.array(*[F.lit(g[-1]) for g in groups])
    group = F.size(F.filter(lasts, lambda e: e > F.col(column)))
    inside = F.try_element_at(F.array(*[F.array(*map(F.lit, g)) for g in groups]), group + 1)
    return group * step + F.coalesce(F.size(F.filter(inside, lambda e: e > F.col(column))), F.lit(0))


def _text_keys() -> list[Column]:
    """Two 64-bit hashes of the text (null: empty), by which equal texts are known."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, of texts, as compressed bytes: a shuffle of texts is the dearest step of all here."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = [squeeze(t) for t in column_bytes(batch.columns[-1])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())], batch.schema.names)


def _marked(keys: DataFrame, column: str) -> np.ndarray:
    """A bit for each residue of the long keys modulo ``MARKS``: a filter of a fixed size, whatever the number of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        bits = np.zeros(MARKS, bool)
        for batch in batches:
            bits[np.asarray(batch.column(0)) % MARKS] = True
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(np.packbits(bits).tobytes())], pa.binary())], ["bits"])

    import zstandard

    out = np.zeros(MARKS // 8, np.uint8)
    for row in keys.select(column).coalesce(8).mapInArrow(run, "bits binary").collect():  # at most eight rows
        out |= np.frombuffer(zstandard.decompress(row.bits), np.uint8)
    return out


def matching(texts: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of ``texts`` (longs, and last the text) whose ``column`` may be among that of ``keys``, with their texts compressed.

    Only these go into a join with the keys: the shuffle grows with what is asked for, not with all texts.
    """
    marks = _marked(keys, column)
    names = texts.columns
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = np.asarray(batch.column(at)) % MARKS
                yield batch.filter(pa.array((marks[place >> 3] >> (7 - (place & 7)) & 1).astype(bool)))

        yield from _squeezed(kept())

    return texts.mapInArrow(run, ", ".join([*[f"{n} long" for n in names[:-1]], f"{names[-1]} binary"]))


def _unsqueezed(column) -> list[bytes]:
    import zstandard

    restore = zstandard.ZstdDecompressor().decompress
    return [restore(x) for x in column.to_pylist()]


def with_next(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows dealt by descending ranges of doc_id, each range sorted upwards after the head of the range below it.

    Only ids and hashes are read to cut the ranges; the texts are shuffled once, compressed. A head is the one row of its
    range's greatest id that comes first by hashes. Rows without id are dealt over as many ranges as there are others, each
    after the head of all. The classes (doc_id, h1, h2, class_id) come each before the row that they belong to.
    Columns: part, ahead (the row only stands for what follows the range), doc_id, h1, h2, class_id, text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_keys(), "text")
    parts = shuffle_partitions(docs.sparkSession)
    edges = _edges(docs.where("doc_id is not null"), parts)
    last = len(edges) + 1  # the first range of the ids that are null
    part = F.when(F.col("doc_id").isNull(), last + F.pmod("h1", F.lit(parts))).otherwise(_range_of("doc_id", edges)).cast("int")
    first = F.max(F.struct("doc_id", F.bitwise_not("h1").alias("h1"), F.bitwise_not("h2").alias("h2")))
    found = docs.select(F.least(part, F.lit(last)).alias("part"), "doc_id", "h1", "h2").groupBy("part").agg(first.alias("head")).select("part", "head.*").orderBy("part").collect()
    heads = []
    for i, r in enumerate(found):  # cyclic: after the last comes the first
        before = found[i - 1].part
        heads.append((r.doc_id, ~r.h1, ~r.h2, list(range(last, last + parts)) if before == last else [before]))
    heads = docs.sparkSession.createDataFrame(heads, "id long, a long, b long, also array<int>")
    stands = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b"))
    known = docs.join(F.broadcast(heads), stands, "left")
    places = F.concat(F.array(F.struct(part.alias("part"), F.lit(False).alias("ahead"))), F.coalesce(F.transform("also", lambda p: F.struct(p.alias("part"), F.lit(True).alias("ahead"))), F.array().cast("array<struct<part:int,ahead:boolean>>")))
    dealt = known.select(F.explode(places).alias("at"), "doc_id", "h1", "h2", "text").select("at.*", "doc_id", "h1", "h2", F.lit(None).cast("long").alias("class_id"), "text")
    dealt = dealt.mapInArrow(_squeezed, "part int, ahead boolean, doc_id long, h1 long, h2 long, class_id long, text binary")
    beside = classes.select(part.alias("part"), F.lit(False).alias("ahead"), "doc_id", "h1", "h2", "class_id", F.lit(None).cast("binary").alias("text"))
    order = ("part", F.desc("ahead"), F.asc_nulls_first("doc_id"), "h1", "h2", F.col("text").isNotNull())
    return dealt.unionByName(beside).repartitionById(last + parts, F.col("part")).sortWithinPartitions(*order)


def edited_fingerprints(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Each text's fingerprint beside those of its edited text and of the next document, and its class of near-duplicates.

    Edited: the last floor(n / 2) code points give way to as many first ones (or all) of the next document by falling id.
    class_id is that of ``near_duplicates``.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, following, this, told = None, object(), "", "", None
        for batch in batches:
            ids, texts, nexts, classes = [], [], [], []

            def handed():
                out = one(ids[:], texts[:], nexts[:], classes[:])
                for held in (ids, texts, nexts, classes):
                    held.clear()
                return out

            for p, ahead, doc_id, h1, h2, class_id, data in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if data is None:
                    told = (doc_id, h1, h2, class_id)
                    continue
                text = _unsqueezed(pa.array([data]))[0].decode()
                if p != part:
                    part, current, this = p, object(), ""
                if ahead:
                    if current != "ahead":
                        current, this = "ahead", text
                    continue
                if current == "ahead" or doc_id != current:
                    current, following, this = doc_id, this, text
                ids.append(doc_id)
                texts.append(text)
                nexts.append(following)
                classes.append(told[3] if told and told[:3] == (doc_id, h1, h2) else doc_id)
                if len(ids) == 512:
                    yield handed()
            if ids:
                yield handed()

    def one(ids: list, texts: list[str], nexts: list[str], classes: list) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nexts, strict=True)]
        every = list(dict.fromkeys([*texts, *edited, *nexts]))
        place = {t: i for i, t in enumerate(every)}
        signed = signatures([t.encode() for t in every])
        own, new, after = (signed[[place[t] for t in x]] for x in (texts, edited, nexts))
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(_hex(own), pa.string()),
            pa.array(_hex(new), pa.string()),
            pa.array(likeness(own, new), pa.float64()),
            pa.array(likeness(own, after), pa.float64()),
            pa.array(classes, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id"])

    nodes = near_classes(docs, threshold)
    # rows alone in their class need no word of it
    some = nodes.where("not (alone and n = 1)").select(F.struct("h1", "h2").alias("key"), "n", "class_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_keys()).distinct().select("doc_id", F.struct("h1", "h2").alias("key"))
    classes = hot_join(rows, some, "key", "n", max(1, nodes.agg(F.sum("n")).first()[0] or 0), "doc_id").select("doc_id", "key.*", "class_id")
    return with_next(docs, classes).mapInArrow(run, schema)


def _band_rows(bands: int, rows: int):
    """(node, number, band): the hash of each band of a signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, PERMUTATIONS).astype(_U)
            keys = np.empty((len(signed), bands), _U)
            for k in range(bands):
                key = np.full(len(signed), k + 1, _U)
                for j in range(k * rows, (k + 1) * rows):
                    key = mix(key * _U(0x9E3779B97F4A7C15) + signed[:, j])
                keys[:, k] = key
            numbers = np.tile(np.arange(bands, dtype=np.int32), len(signed))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), bands)), pa.array(numbers), pa.array(keys.ravel().view(np.int64))], ["node", "number", "band"])

    return run


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(h1, h2, n, least, class_id, alone) of every distinct text, n being its rows.

    Texts that share a band are candidates. First each is compared with one other, the least text of its bands that it
    shares most bands with (of parts of bands, where a band is large, whose least ones are compared with each other's);
    links of verified similarity join texts to classes. Then every pair of a band whose texts are still in different
    classes is decided, in the first band that the two share, in tiles: by the signatures where these rule the similarity
    out, else on whole texts, unless links found before it in the tile have joined its classes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_keys(), "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = [x.tobytes() for x in signatures(column_bytes(batch.column(3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(signed, pa.binary())], ["doc_id", "h1", "h2", "sign"])

    signed = docs.mapInArrow(sliced(sign), "doc_id long, h1 long, h2 long, sign binary")
    distinct = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.any_value("sign").alias("sign"))
    nodes = written(distinct.withColumn("node", F.monotonically_increasing_id()))
    banded = nodes.select("node", "sign").mapInArrow(_band_rows(bands, rows), "node long, number int, band long")
    heavy = [x.item for x in banded.agg(F.expr(f"approx_top_k(band, {HEAVY}, {100 * HEAVY})").alias("top")).first().top if x["count"] > PART]
    part = F.when(F.col("band").isin(heavy), F.pmod(F.xxhash64("node"), F.lit(HEAVY))).otherwise(F.lit(0)) if heavy else F.lit(0)
    window = Window.partitionBy("band", "part")
    held = banded.withColumn("part", part).select("band", "number", "node", F.min("node").over(window).alias("head"), F.count("*").over(window).alias("many"))
    held = written(held.where("many > 1" if not heavy else (F.col("many") > 1) | F.col("band").isin(heavy)).drop("many"))
    shared = held.where("head <> node").groupBy("node", "head").count().groupBy("node").agg(F.max_by("head", F.struct("count", -F.col("head"))).alias("u"))
    links = shared.select("u", F.col("node").alias("v"))
    if heavy:
        tops = held.where(F.col("band").isin(heavy)).select("band", "head").distinct()
        links = links.unionByName(tops.select(F.min("head").over(Window.partitionBy("band")).alias("u"), F.col("head").alias("v")).where("u <> v"))
    texts = docs.select("h1", "h2", "text")
    links = written(_decided(links.distinct(), nodes, texts, threshold))
    classes = connected_components(links)
    links = written(links.unionByName(_rest(held, nodes, classes, texts, threshold, bands, rows)))
    classes = connected_components(links)
    found = rooted(checkpointed(nodes.select("node", "n", "least")), classes, "node").select("node", F.col("component_id").alias("class_id"))
    alone = nodes.drop("sign").join(classes.select("node", F.lit(False).alias("alone")), "node", "left")
    return checkpointed(alone.join(found, "node").select("h1", "h2", "n", "least", "class_id", F.coalesce("alone", F.lit(True)).alias("alone")))


def _rest(held: DataFrame, nodes: DataFrame, classes: DataFrame, texts: DataFrame, threshold: float, bands: int, rows: int) -> DataFrame:
    """(u, v) links among the texts of one band, in different classes so far, of all bands."""
    labelled = held.select("band", "number", "node").join(classes, "node", "left").select("band", "number", "node", F.coalesce("root", "node").alias("cls"))
    mixed = labelled.groupBy("band").agg(F.min("cls").alias("a"), F.max("cls").alias("b"), F.count("*").alias("size")).where("a <> b").select("band", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    dealt = labelled.join(written(mixed), "band").withColumn("i", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    dealt = written(dealt.join(nodes.select("node", "sign"), "node"))
    copied = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("band", "number", "node", "cls", "sign", "i", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))

    def near(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, components that are alike) of the tile's pairs of different classes, first met in this band, that may be similar."""
        cls, side = np.asarray(table.column("cls")), np.asarray(table.column("i"))
        sign = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint16).reshape(-1, PERMUTATIONS)
        number, left = table.column("number")[0].as_py(), side == table.column("a")[0].as_py()
        same = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        others = np.flatnonzero(left if same else ~left)
        some: list[tuple[np.ndarray, ...]] = []
        for x in np.flatnonzero(left).tolist():
            y = others[(cls[others] != cls[x]) & ((others > x) | (not same))]
            equal = sign[y] == sign[x]
            alike = equal.sum(axis=1)
            before = equal[:, : number * rows].reshape(len(y), number, rows).all(axis=2).any(axis=1)
            kept = (alike >= LEAST * PERMUTATIONS) & ~before
            some.append((np.full(kept.sum(), x), y[kept], alike[kept]))
        return tuple(np.concatenate(c) for c in zip(*some, strict=True)) if some else tuple(np.zeros((3, 0), np.int64))

    def needed(table: pa.Table) -> pa.Table:
        i, j, _ = near(table)
        return table.take(pa.array(np.union1d(i, j)))

    def decide(table: pa.Table) -> pa.Table:
        node, root = np.asarray(table.column("node")), {c: c for c in table.column("cls").to_pylist()}
        cls = table.column("cls").to_pylist()
        sets = [_shingles(t) for t in _unsqueezed(table.column("text"))]

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        i, j, alike = near(table)
        u, v = [], []
        for k in np.argsort(-alike, kind="stable").tolist():
            x, y = int(i[k]), int(j[k])
            a, b = find(cls[x]), find(cls[y])
            if a != b and _similar(sets[x], sets[y], threshold):
                root[a] = b
                u.append(node[x])
                v.append(node[y])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    keys = ["band", "a", "b"]
    columns = "band long, number int, node long, cls long, sign binary, i int, a int, b int"
    wanted = written(copied.groupBy(*keys).applyInArrow(needed, columns))
    read = _texts_of(wanted.select("node").distinct(), nodes, texts)
    return wanted.join(read, "node").groupBy(*keys).applyInArrow(decide, "u long, v long")


def _texts_of(asked: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text), compressed, of the nodes asked for."""
    keys = written(nodes.select("h1", "h2", "node").join(written(asked), "node"))
    held = matching(texts, "h1", keys).join(keys, ["h1", "h2"])
    return written(held.groupBy("node").agg(F.any_value("text").alias("text")))


def _decided(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose texts are that similar. Texts are read only of pairs that the signatures leave possible."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, PERMUTATIONS) for c in batch.columns[2:])
            keep = pa.array((a == b).sum(axis=1) >= LEAST * PERMUTATIONS)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["u", "v"])

    def beside(table: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
        return table.select(F.col("node").alias("u"), F.col(value).alias("a")), table.select(F.col("node").alias("v"), F.col(value).alias("b"))

    left, right = beside(nodes, "sign")
    likely = written(pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(sliced(possible), "u long, v long"))
    left, right = beside(_texts_of(likely.select(F.explode(F.array("u", "v")).alias("node")).distinct(), nodes, texts), "text")
    held = likely.join(left, "u").join(right, "v").select(F.col("u").alias("head"), F.col("v").alias("cls"), "a", "b")
    return verified(held, threshold).select(F.col("head").alias("u"), F.col("cls").alias("v"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id) of every row: the least doc_id that links of verified Jaccard >= threshold reach; null if there is none.

    Equal texts are one class before any join.
    """
    nodes = near_classes(docs, threshold, bands, rows).select(F.struct("h1", "h2").alias("key"), "n", "class_id")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*_text_keys()).alias("key"))
    return hot_join(keyed, nodes, "key", "n", max(1, nodes.agg(F.sum("n")).first()[0] or 0), "doc_id").select("doc_id", "class_id")


def _shingles(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(np.concatenate([shingle_hashes(x, SHINGLE)[0] for x in blocks([(0, text)], SHINGLE - 1)] or [np.zeros(0, _U)]))


def _similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two sets of distinct hashes have that Jaccard similarity at least; two empty ones have."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return not union or both >= threshold * union


def verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """(head, cls) of the pairs (head, cls, a, b) whose texts a and b have that Jaccard similarity at least; a and b may be compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, others = np.array(batch.column(0)), np.array(batch.column(1))
            sides = [_unsqueezed(c) if c.type == pa.binary() else column_bytes(c) for c in batch.columns[2:]]
            keep = np.array([_similar(_shingles(a), _shingles(b), threshold) for a, b in zip(*sides, strict=True)], bool)
            yield pa.RecordBatch.from_arrays([pa.array(heads[keep], pa.int64()), pa.array(others[keep], pa.int64())], ["head", "cls"])

    return pairs.select("head", "cls", "a", "b").mapInArrow(sliced(run), "head long, cls long")
