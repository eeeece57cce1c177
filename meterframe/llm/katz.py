"""Katz backoff scores: Good-Turing discounted counts, exactly normalised backoff weights, evaluated token by token.

The model has a table of n-gram counts of the training texts for each level up to ``order``. The tables are partitioned
by hash, in as many partitions as the corpus calls for, and grow with it; they are never sent whole to any task. Texts
are gathered into pages. A page asks each partition of a table for the entries that it needs, in one packed message, and
gets the answers in the same order:

1. pages send their distinct words, as bytes, with their counts; each partition of the word table adds up what all pages
   counted and gives each word a number, the same for all pages;
2. level by level, pages ask for the counts of their n-grams, each known by the numbers of its history and its word; a
   frequent history is spread over as many partitions as its share of the tokens calls for. A partition also answers
   what a history's backoff weight follows from: how many n-grams it has of each discounted count, and the probability
   mass of its followers one level down. It numbers its n-grams, which are the histories of the next level;
3. each token is scored recursively: its n-gram if that was seen, else the history's backoff weight times the score of
   one level down; a word that was never seen has the mass that discounting leaves.

Numbers are exact: no two words or n-grams share one. Half a count is held back in every history, so that the backoff
weight is never zero. One history's probabilities, over all known words and the unknown one, sum to one.

Cases: a null text counts as empty and is one end token. Repeated rows count and are scored each; a null doc_id trains.
With no training text every token is unknown. Very long texts make a page of their own and are scored whole. Empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.llm.blocks import blocks, column_bytes, distinct_spans, mix, span_hashes
from meterframe.llm.shared import bucketed, checkpointed, shuffle_partitions

ORDER = 2
TOP = 5
HELD_BACK = 0.5
PAGE_BYTES = 6 << 20
#: Bytes of text for each partition of a table.
PART_BYTES = 8 << 20
FOLDS = 10
_U = np.uint64
END = b""
#: The history at the start of a text, and one that was never seen.
START, UNSEEN = -1, -2
_ANSWER = "page long, level int, part int, data binary, stats array<long>"


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays by the bytes of equal weight: those of small numbers are mostly zero, and compress away."""
    planes = [x if isinstance(x, bytes) else (x.dtype.str, np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b"") for x in arrays]
    return zstandard.compress(pickle.dumps(planes, 5), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    def array(x):
        if isinstance(x, bytes):
            return x
        kind = np.dtype(x[0])
        return np.ascontiguousarray(np.frombuffer(x[1], np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()

    return tuple(map(array, pickle.loads(zstandard.decompress(data))))


def trains(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS != 0


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """Katz's factors for counts 0 to TOP (0: unused), from n_1 .. n_(TOP + 1); (r - 1/2) / r where the formula fails."""
    n = np.concatenate([[0.0], counts_of_counts.astype(float)])
    out = np.ones(TOP + 1)
    last = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 1.0
    for r in range(1, TOP + 1):
        found = ((r + 1) * n[r + 1] / (r * n[r]) - last) / (1 - last) if n[r] and last < 1 else 0.0
        out[r] = found if 0 < found < 1 else (r - 0.5) / r
    return out


class Words:
    """The lowest level: probabilities of words from their counts."""

    def __init__(self, stats: list[int]):
        self.tokens, self.types = stats[0], stats[1]
        self.factors = discounts(np.array(stats[2:]))
        kept = sum((1 - self.factors[r]) * r * stats[1 + r] for r in range(1, TOP + 1))
        self.unknown = (HELD_BACK + kept) / (self.tokens + HELD_BACK)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        factor = np.where(counts <= TOP, self.factors[np.minimum(counts, TOP)], 1.0)
        return np.where(counts > 0, factor * counts / (self.tokens + HELD_BACK), self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


def pages(docs: DataFrame) -> DataFrame:
    """(page, bytes, data): the texts' ids, folds, lengths, distinct words, frequent ones first, and tokens as places among these."""

    def one(ids: list, texts: list[bytes], number: int, size: int) -> pa.RecordBatch:
        found: list[list[np.ndarray]] = [[] for _ in ids]
        names: dict[bytes, int] = {END: 0}
        for block in blocks(enumerate(texts)):
            first, of = distinct_spans(np.frombuffer(block.text, np.uint8), block.starts, block.ends)
            spans = zip(block.starts[first].tolist(), block.ends[first].tolist(), strict=True)
            places = np.fromiter((names.setdefault(block.text[a:b], len(names)) for a, b in spans), np.int64, len(first))[of]
            for k, row in enumerate(block.rows.tolist()):
                found[row].append(places[block.first[k] : block.first[k + 1]])
        end = np.zeros(1, np.int64)
        lengths = np.array([sum(map(len, f)) + 1 for f in found])
        tokens = np.concatenate([x for f in found for x in (*f, end)])
        order = np.argsort(-np.bincount(tokens, minlength=len(names)), kind="stable")
        moved = np.empty(len(order), np.int64)
        moved[order] = np.arange(len(order))
        every = list(names)
        known = np.array([i is not None for i in ids])
        data = _pack(np.array([i or 0 for i in ids], np.int64), known, np.array([trains(i) for i in ids]), lengths, b" ".join(every[i] for i in order.tolist()), moved[tokens].astype(np.uint32))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["page", "bytes", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), column_bytes(batch.column(1)), strict=True):
                if size and size + len(text) > PAGE_BYTES:
                    yield one(ids, texts, number, size)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text) + 1
        if ids:
            yield one(ids, texts, number, size)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "page long, bytes long, data binary")


def _bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    return np.searchsorted(keys, np.arange(parts + 1))


def _dealt(blob: bytes, parts: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of a page, their order by table partition, and where each partition begins in it."""
    words = blob.split(b" ")
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    to = (span_hashes(np.frombuffer(blob, np.uint8), starts, ends) % _U(parts)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    return words, order, _bounds(to[order], parts)


def _word_requests(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, data in zip(batch.column("page").to_pylist(), batch.column("data").to_pylist(), strict=True):
                _, _, train, lengths, blob, tokens = _unpack(data)
                words, order, at = _dealt(blob, parts)
                counts = np.bincount(tokens, np.repeat(train, lengths), len(words)).astype(np.uint32)[order]
                words = [words[i] for i in order.tolist()]
                for p in np.flatnonzero(np.diff(at)).tolist():
                    sent = _pack(b" ".join(words[at[p] : at[p + 1]]), counts[at[p] : at[p + 1]])
                    yield pa.RecordBatch.from_arrays([pa.array([page], pa.int64()), pa.array([p], pa.int32()), pa.array([sent], pa.binary())], ["page", "part", "data"])

    return run


def _answers(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("page", "level", "part", "data", "stats"), columns, kinds, strict=True)})


def _numbers(total: np.ndarray, part: int, parts: int) -> np.ndarray:
    """A number for each entry that was counted, small for frequent ones, which no other partition gives."""
    turn = np.empty(len(total), np.int64)
    turn[np.argsort(-total, kind="stable")] = np.arange(len(total))
    return np.where(total > 0, turn * parts + part, UNSEEN)


def _word_table(parts: int):
    def run(asked: pa.Table) -> pa.Table:
        """Adds up one partition of the word table and answers every page."""
        part = asked.column("part")[0].as_py()
        names: dict[bytes, int] = {}
        places, counts = [], []
        for data in asked.column("data").to_pylist():
            blob, counted = _unpack(data)
            places.append(np.fromiter((names.setdefault(w, len(names)) for w in blob.split(b" ")), np.int64, len(counted)))
            counts.append(counted)
        total = np.bincount(np.concatenate(places), np.concatenate(counts)).astype(np.int64)
        number = _numbers(total, part, parts)
        rows = [(page, 1, part, _pack(number[x], total[x]), None) for page, x in zip(asked.column("page").to_pylist(), places, strict=True)]
        small = [int((total == r).sum()) for r in range(1, TOP + 2)]
        ends = int(total[names[END]]) if END in names else 0
        return _answers([*rows, (None, 1, part, None, [int(total.sum()), int((total > 0).sum()), *small, ends])])

    return run


class _Page:
    """A page's tokens, with the number, the count and the probability of each one's n-gram at the last level that was answered."""

    def __init__(self, data: bytes, answers: dict[int, bytes], level: Words, parts: int, texts: int):
        self.ids, self.known, self.train, self.lengths, blob, place = _unpack(data)
        words, order, _ = _dealt(blob, parts)
        told = [_unpack(answers[p]) for p in sorted(answers)]
        if sum(len(n) for n, _ in told) != len(words):
            raise ValueError("answers do not match the page")
        number, count = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        number[order], count[order] = (np.concatenate(x) for x in zip(*told, strict=True))
        self.parts, self.texts, self.level, self.k = parts, texts, level, 1
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.place, self.number, self.words = place.astype(np.int64), number, count
        self.gram, self.count = number[self.place], count[self.place]
        self.own = self.count
        self.score = level.probability(count)[self.place]

    def advance(self) -> None:
        """The distinct n-grams of the next level, in the order in which they are asked for. Those of unseen histories are not."""
        self.k += 1
        before, times = np.empty_like(self.gram), np.empty_like(self.count)
        before[1:], times[1:] = self.gram[:-1], self.count[:-1]
        before[self.starts], times[self.starts] = START, self.texts
        known = np.flatnonzero((before != UNSEEN) & (times > 0))
        self.asking = known
        self.history, of = np.unique(before[known], return_inverse=True)
        self.times = np.zeros(len(self.history), np.int64)
        self.times[of] = times[known]
        n = len(self.number)
        pairs, self.first, self.pair_of = np.unique(of * n + self.place[known], return_index=True, return_inverse=True)
        self.seen_here = np.bincount(self.pair_of, np.repeat(self.train, self.lengths)[known], len(pairs)).astype(np.uint32)
        self.v, self.w = pairs // n, pairs % n
        share = np.minimum(self.parts, np.maximum(1, -(-self.times * 4 * self.parts // max(1, self.level.tokens))))
        base = (mix(self.history.view(_U)) % _U(self.parts)).astype(np.int64)
        # a word that was never counted makes no n-gram; all such of a history are asked for as one
        keys = mix(self.history[self.v].view(_U) * _U(0x9E3779B97F4A7C15) ^ self.number[self.w].view(_U))
        at = (base[self.v] + (keys % share[self.v].astype(_U)).astype(np.int64)) % self.parts
        self.order = np.lexsort((self.number[self.w], self.v, at))
        self.cuts = _bounds(at[self.order], self.parts)
        wants = np.zeros(len(self.history), bool)  # histories whose backoff weight may be needed
        wants[self.v[self.seen_here == 0]] = True
        wanting = np.flatnonzero(wants)
        places = np.repeat(wanting, share[wanting])
        turn = np.arange(len(places)) - np.repeat(np.cumsum(share[wanting]) - share[wanting], share[wanting])
        to = (base[places] + turn) % self.parts
        sort = np.argsort(to, kind="stable")
        self.weights, self.weight_cuts = places[sort], _bounds(to[sort], self.parts)

    def requests(self) -> Iterator[tuple[int, bytes]]:
        below = self.words[self.w] if self.k == 2 else self.score[self.asking[self.first]]
        for p in range(self.parts):
            here = self.order[self.cuts[p] : self.cuts[p + 1]]
            weights = self.weights[self.weight_cuts[p] : self.weight_cuts[p + 1]]
            if len(here) or len(weights):
                v = self.v[here]
                begin = np.flatnonzero(np.diff(v, prepend=-1))
                runs = np.diff(np.append(begin, len(v))).astype(np.uint32)
                yield p, _pack(np.diff(self.history[v[begin]], prepend=0), runs, self.number[self.w[here]], below[here], self.seen_here[here], self.history[weights])

    def absorb(self, answers: dict[int, bytes], factors: np.ndarray) -> None:
        """Scores of this level from the answers: that of the n-gram, or the history's backoff weight times the one below."""
        found, number = np.zeros(len(self.v), np.int64), np.full(len(self.v), UNSEEN, np.int64)
        lost, below = np.zeros(len(self.history)), np.zeros(len(self.history))
        missing = [(1 - factors[r]) * r for r in range(1, TOP + 1)]
        for p, data in answers.items():
            counts, numbers, mass, *small = _unpack(data)
            here, weights = self.order[self.cuts[p] : self.cuts[p + 1]], self.weights[self.weight_cuts[p] : self.weight_cuts[p + 1]]
            found[here] = counts
            number[here] = numbers if len(numbers) else UNSEEN
            np.add.at(lost, weights, sum((m * x for m, x in zip(missing, small, strict=True)), np.zeros(len(weights))))
            np.add.at(below, weights, mass)
        factor = np.where(found <= TOP, factors[np.minimum(found, TOP)], 1.0)
        seen = (factor * found / (self.times[self.v] + HELD_BACK))[self.pair_of]
        weight = (HELD_BACK + lost) / (self.times + HELD_BACK) / np.maximum(1e-300, 1 - below)
        at = self.asking
        self.score[at] = np.where(seen > 0, seen, weight[self.v][self.pair_of] * self.score[at])
        self.gram, self.count = np.full_like(self.gram, UNSEEN), np.zeros_like(self.count)
        self.gram[at], self.count[at] = number[self.pair_of], found[self.pair_of]

    def sums(self) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) by text."""
        return self.lengths, np.add.reduceat((self.own > 0).astype(np.int64), self.starts), np.add.reduceat(self.level.base(self.own), self.starts), np.add.reduceat(np.log10(self.score), self.starts)


def _gram_table(level: Words, k: int, parts: int, last: bool):
    def run(asked: pa.Table) -> pa.Table:
        """Adds up one partition of the n-gram table of level k and answers every page."""
        sent = [_unpack(x) for x in asked.column("data").to_pylist()]
        part = asked.column("part")[0].as_py()
        v = np.concatenate([np.repeat(np.cumsum(x[0]), x[1]) for x in sent])
        names, history = np.unique(np.concatenate([v, *[x[5] for x in sent]]), return_inverse=True)
        asks = np.split(history[len(v) :], np.cumsum([len(x[5]) for x in sent])[:-1])
        history = history[: len(v)]
        words, word = np.unique(np.concatenate([x[2] for x in sent]), return_inverse=True)
        _, first, place = np.unique(history * max(1, len(words)) + word, return_index=True, return_inverse=True)
        total = np.bincount(place, np.concatenate([x[4] for x in sent]), len(first)).astype(np.int64)
        real = total > 0
        one = np.concatenate([x[3] for x in sent])[first]
        one = level.probability(one.astype(np.int64)) if k == 2 else one
        mass = np.bincount(history[first][real], one[real], len(names))
        small = [np.bincount(history[first][total == r], minlength=len(names)).astype(np.uint32) for r in range(1, TOP + 1)]
        number = np.zeros(0, np.int64) if last else _numbers(total, part, parts)
        rows = []
        for page, x, mine in zip(asked.column("page").to_pylist(), np.split(place, np.cumsum([len(x[2]) for x in sent])[:-1]), asks, strict=True):
            rows.append((page, k, part, _pack(total[x].astype(np.uint32), number if last else number[x], mass[mine], *[s[mine] for s in small]), None))
        return _answers([*rows, (None, k, part, None, [int((total == r).sum()) for r in range(1, TOP + 2)])])

    return run


def _stats(answers: DataFrame, count: int) -> list[int]:
    found = answers.where("stats is not null").agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).alias(f"s{i}") for i in range(count)]).first()
    return [int(x) for x in found]


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, by n-grams of up to ``order`` words."""
    spark = docs.sparkSession
    gathered = bucketed(pages(docs), "page", shuffle_partitions(spark))
    size = gathered.agg(F.sum("bytes")).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-size // PART_BYTES))
    asked = gathered.mapInArrow(_word_requests(parts), "page long, part int, data binary")
    answers = checkpointed(asked.groupBy("part").applyInArrow(_word_table(parts), _ANSWER))
    *counted, texts = _stats(answers, TOP + 4)
    level = Words(counted)
    factors: list[np.ndarray] = []

    def restored(data: bytes, told: pa.Table) -> _Page:
        """The page with the answers of all levels so far."""
        by_level: list[dict[int, bytes]] = [{} for _ in range(len(factors) + 1)]
        for k, p, d in zip(*(told.column(n).to_pylist() for n in ("level", "part", "data")), strict=True):
            by_level[k - 1][p] = d
        page = _Page(data, by_level[0], level, parts, texts)
        for k, f in enumerate(factors):
            page.advance()
            page.absorb(by_level[k + 1], f)
        return page

    def ask(held: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        for number, data in zip(held.column("page").to_pylist(), held.column("data").to_pylist(), strict=True):
            page = restored(data, told)
            page.advance()
            rows += [(number, p, d) for p, d in page.requests()]
        number, part, data = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"page": pa.array(number, pa.int64()), "part": pa.array(part, pa.int32()), "data": pa.array(data, pa.binary())})

    def finish(held: pa.Table, told: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        for data in held.column("data").to_pylist():
            page = restored(data, told)
            n, known, base, log = page.sums()
            out.append(pa.table({"doc_id": pa.array(page.ids, mask=~page.known), "held_out": ~page.train, "n_tokens": n.astype(np.int64), "n_known": known, "train_tokens": np.full(len(n), level.tokens), "base_score": base, "score": log}))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})

    answered = answers.where("page is not null")
    for k in range(2, order + 1):
        requests = gathered.groupBy("page").cogroup(answered.groupBy("page")).applyInArrow(ask, "page long, part int, data binary")
        answers = checkpointed(requests.groupBy("part").applyInArrow(_gram_table(level, k, parts, k == order), _ANSWER))
        factors.append(discounts(np.array(_stats(answers, TOP + 1))))
        answered = answered.unionByName(answers.where("page is not null"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return gathered.groupBy("page").cogroup(answered.groupBy("page")).applyInArrow(finish, schema)
