"""Best-fit packing of token pieces into sequences, improved by swaps between underfull bins.

Cases: a null text counts as empty, and an empty document is its end token alone. Rows of one doc_id, or without one, are
packed each on their own. A document longer than a sequence is cut so that all pieces but the first are full. Pieces of one
length are alike to the search: among them, and in a sequence, the order is that of length (falling), doc_id, piece and
CRC-32. Very long texts and very long runs of white space are cut like any other. Empty tables give empty results; other
columns are ignored. Sequence numbers hold a group's number in the high bits.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.llm.blocks import sliced
from meterframe.llm.shared import checkpointed

LENGTH = 2048
GROUP = 16384
END = 0
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """The pieces of every row, with the CRC-32 of their ids as unsigned little-endian 32-bit numbers."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from meterframe.llm.tokens import encoder

        encode = encoder(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), END], "<u4")
                first = (len(ids) - 1) % length + 1
                for k, (a, b) in enumerate(zip([0, *range(first, len(ids), length)], [*range(first, len(ids) + 1, length)], strict=True)):
                    out.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), x, strict=True)) for x in out], schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    return docs.mapInArrow(sliced(run), SCHEMA)


class _Bins:
    """Bins of item lengths; the open ones are also held by fill, for best fit."""

    def __init__(self, room: int):
        self.room, self.items, self.fill, self.order = room, [], [], []

    def place(self, item: int, size: int) -> None:
        at = bisect_left(self.order, (self.room - size + 1,)) - 1
        if at < 0:
            self.items.append([item])
            self.fill.append(size)
            insort(self.order, (size, len(self.fill) - 1))
            return
        fill, bin_ = self.order.pop(at)
        self.items[bin_].append(item)
        self.fill[bin_] = fill + size
        if fill + size < self.room:
            insort(self.order, (fill + size, bin_))


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    bins = _Bins(room)
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins.place(item, sizes[item])
    return bins.items


class _Search:
    """Underfull bins as multisets of lengths, found again by any length or any sum of two lengths that they hold.

    Items of one length are alike. ``masks`` has a bit for each length (0) and each sum of two (1) in some underfull bin.
    """

    def __init__(self, bins: list[list[int]], sizes: list[int], room: int):
        self.room = room
        self.items: list[dict[int, list[int]]] = []
        self.fill = [sum(sizes[i] for i in held) for held in bins]
        self.where: tuple[dict[int, set[int]], ...] = ({}, {})
        self.masks = [0, 0]
        self.underfull: set[int] = set()
        for k, held in enumerate(bins):
            lengths: dict[int, list[int]] = {}
            for i in held:
                lengths.setdefault(sizes[i], []).append(i)
            self.items.append(lengths)
            self._enter(k)

    def _pairs(self, k: int) -> dict[int, tuple[int, int]]:
        """Each sum of two lengths in the bin, with two lengths that give it."""
        lengths = sorted(self.items[k])
        found = {2 * a: (a, a) for a in lengths if len(self.items[k][a]) > 1}
        for n, a in enumerate(lengths):
            for b in lengths[n + 1 :]:
                found.setdefault(a + b, (a, b))
        return found

    def _enter(self, k: int) -> None:
        if 0 < self.fill[k] < self.room:
            self.underfull.add(k)
            for kind, totals in enumerate((self.items[k], self._pairs(k))):
                for total in totals:
                    self.where[kind].setdefault(total, set()).add(k)
                    self.masks[kind] |= 1 << total

    def _leave(self, k: int) -> None:
        if k in self.underfull:
            self.underfull.discard(k)
            for kind, totals in enumerate((self.items[k], self._pairs(k))):
                for total in totals:
                    self.where[kind][total].discard(k)
                    if not self.where[kind][total]:
                        self.masks[kind] &= ~(1 << total)

    def step(self, k: int) -> tuple | None:
        """The move or exchange that fills bin k most, from the emptiest bin that has what it takes: (gain, bin, given, taken)."""
        own, found = self.fill[k], None
        gives = [((), 0), *(((a,), a) for a in sorted(self.items[k])), *((v, z) for z, v in self._pairs(k).items())]
        for given, size in gives:
            for kind in (0, 1) if len(given) == 1 else (0,):  # a move, one for one, one for two, two for one
                gains = self.masks[kind] >> size + 1 & (1 << self.room - own) - 1
                while gains and (gain := gains.bit_length()) > (found[0] if found else 0):
                    gains &= ~(1 << gain - 1)
                    others = [b for b in self.where[kind][size + gain] if b != k]
                    if others and gain > self.fill[other := min(others, key=lambda b: (self.fill[b], b))] - own:
                        found = (gain, other, given, (size + gain,) if kind == 0 else self._pairs(other)[size + gain])
                        break
        return found

    def exchange(self, k: int, gain: int, other: int, given: tuple, taken: tuple) -> None:
        self._leave(k)
        self._leave(other)
        for source, target, lengths in ((k, other, given), (other, k, taken)):
            for length in lengths:
                held = self.items[source][length]
                self.items[target].setdefault(length, []).append(held.pop())
                if not held:
                    del self.items[source][length]
        self.fill[k] += gain
        self.fill[other] -= gain
        self._enter(k)
        self._enter(other)

    def tight(self) -> bool:
        """Whether the underfull bins hold too much for one bin fewer."""
        return sum(self.fill[k] for k in self.underfull) > self.room * (len(self.underfull) - 1)


def improve(bins: list[list[int]], sizes: list[int], room: int) -> list[list[int]]:
    """Local search over the underfull bins, until no step is left or fewer bins could not hold the pieces.

    A step moves an item into a bin, or exchanges one for one, two for one or one for two, between any two underfull bins.
    Each raises the sum of squared fills: a bin gains g only if its new fill is above the other's old one. Fuller bins
    choose first, and take what fills them most; of equal gains, from the emptiest bin, then from the first. A bin that
    loses its last item is gone.
    """
    fills = [f for f in (sum(sizes[i] for i in held) for held in bins) if f < room]
    if sum(fills) > room * (len(fills) - 1):
        return bins
    search = _Search(bins, sizes, room)
    moved = True
    while moved and not search.tight():
        moved = False
        for k in sorted(search.underfull, key=lambda k: (-search.fill[k], k)):
            while k in search.underfull and (step := search.step(k)):
                search.exchange(k, *step)
                moved = True
    return [[i for length in sorted(held, reverse=True) for i in held[length]] for held in search.items if held]


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """The pieces with their sequence and their place in it.

    Pieces are written once, so that no text is encoded twice, and dealt by row number into groups of about ``group``
    pieces, each packed in one task: equal rows fall into any group, and the number of groups follows that of the pieces.
    Every group keeps its own last underfull sequences.
    """
    cut = checkpointed(pieces(docs, tokenizer, length).withColumn("row", F.monotonically_increasing_id()))
    groups = max(1, -(-cut.count() // group))
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups))).drop("row")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sizes = table.column("length").to_pylist()
        bins = improve(best_fit(sizes, length), sizes, length)
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for k, held in enumerate(bins):
            at = 0
            for i in held:
                sequence[i], offset[i] = k, at
                at += sizes[i]
        number = table.column("grp")[0].as_py() if len(sizes) else 0
        return table.drop_columns(["grp"]).append_column("sequence_id", pa.array(sequence + (number << 32))).append_column("offset", pa.array(offset))

    return dealt.groupBy("grp").applyInArrow(run, SCHEMA + ", sequence_id long, offset long")
