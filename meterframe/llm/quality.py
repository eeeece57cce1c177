"""Text quality from weak labels: overlapping heuristic labellers, expectation-maximisation, and a hashed linear scorer.

Each labeller votes good, bad or nothing on a text. The votes of all documents are counted by pattern; expectation-
maximisation over the patterns estimates how often each labeller votes what on good and on bad texts, and so the
probability that a pattern's texts are good. A linear scorer on hashed trigrams and votes is fitted to these probabilities on
``FIT`` documents, taken by a hash of their ids, and scores every document.

Cases: null and empty texts get the score of no trigrams, are bad by every labeller that votes, and are rejected.
Repeated rows keep one result each. A table on which all labellers agree still has a model. Empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.llm import trigrams
from meterframe.llm.blocks import column_bytes, sliced

BUCKETS = 2048
#: The most documents that the scorer is fitted on.
FIT = 4000
GOOD, BAD, ABSTAIN = 1, 0, 2
#: Only texts that are far likelier bad than good are rejected.
KEEP = 0.1
#: Features are shares of a text's trigrams times this.
SCALE = 32.0
#: Trigrams added to every text's count, so that a short text says little.
SHORT = 60.0


_SPACES = bytes([9, 10, 11, 12, 13, 32])
_UPPER = bytes(range(65, 91))
_LETTER = bytes(b for b in range(256) if b >= 128 or chr(b).isalpha())
_NO_LETTER = bytes(b for b in range(256) if b not in _LETTER)
_SYMBOL = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_MARK = b"*#$%&@~^=<>\\{}[]+_"
_STOP = bytes(46 if b in b",;:!?" else 32 if b in _SPACES else b for b in range(256))
_RUNS = re.compile(rb"([^\w\s.\x80-\xff])\1").findall


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else ABSTAIN


def votes(text: bytes) -> tuple[int, ...]:
    """One vote of each labeller on a text in UTF-8; their grounds overlap."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    letters, solid = len(text.translate(None, _NO_LETTER)), max(1, sum(map(len, words)))
    upper, marks = size - len(text.translate(None, _UPPER)), size - len(text.translate(None, _MARK))
    plain = n - len((text.translate(_STOP) + b" ").replace(b". ", b" ").translate(None, _LETTER).split())
    runs, bare = len(_RUNS(text)), n - len(text.translate(None, _SYMBOL).split())
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = len(lines) - len(set(lines))
    shouted, cells = text.count(b"!!"), text.count(b"|") + text.count(b"\t")
    mean, none = size / max(1, n), n == 0
    again = sum(map(bytes.__eq__, words, words[1:]))
    return (
        _vote(none or marks > 0.06 * size, marks < 0.02 * size),
        _vote(none or plain < 0.6 * n, plain > 0.8 * n),
        _vote(none or runs > 0.2 * n, runs < 0.03 * n),
        _vote(none or bare > 0.15 * n, bare < 0.03 * n),
        _vote(none or upper > 0.4 * max(1, letters), upper < 0.2 * max(1, letters)),
        _vote(none or shouted > 0.05 * n, shouted <= 0.01 * n),
        _vote(none or cells > 0.15 * n, cells <= 0.02 * n),
        _vote(none or mean > 25, 3 < mean < 14),
        _vote(none or letters < 0.78 * solid, letters > 0.88 * solid),
        _vote(none or len(lines) > 3 and repeated > 0.5 * len(lines), len(lines) > 1 and repeated <= 0.2 * len(lines)),
        _vote(none or n > 40 and len(set(words)) < 0.2 * n, n > 20 and len(set(words)) > 0.3 * n),
        _vote(none or n > 10 and again > 0.1 * n, n > 10 and again < 0.02 * n),
    )


LABELLERS = len(votes(b""))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good texts, P(vote | class, labeller), P(good | pattern)) by expectation-maximisation from the count of bad votes."""
    good = np.array([0.95, 0.5, 0.05])[np.minimum(2, (patterns == BAD).sum(axis=1))]
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        tables = np.empty((2, patterns.shape[1], 3))
        for c in (0, 1):
            for v in (BAD, GOOD):
                tables[c, :, v] = (weight[c] @ (patterns == v)) + (2.0 if v == c else 1.0)
            tables[c, :, :2] /= tables[c, :, :2].sum(axis=1, keepdims=True)
            tables[c, :, ABSTAIN] = 1.0  # no vote, no evidence
        logs = np.log([1 - share, share])[:, None] + np.stack([np.log(tables[c, np.arange(patterns.shape[1])[None, :], patterns]).sum(axis=1) for c in (0, 1)])
        good = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    return float(share), tables, good


def _decode(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(LABELLERS)) % 3


def _shapes(patterns: np.ndarray) -> np.ndarray:
    """A column for each vote that a labeller can give."""
    return np.concatenate([patterns == BAD, patterns == GOOD], axis=1).astype(np.float32)


def _features(texts: list[bytes]) -> np.ndarray:
    found = trigrams.counts(texts, np.arange(len(texts)), len(texts), BUCKETS).astype(np.float32)
    return SCALE * found / (found.sum(axis=1, keepdims=True) + SHORT)


def fit_scorer(features: np.ndarray, good: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression on soft labels, by adaptive gradient steps."""
    weights, bias = np.zeros(features.shape[1]), 0.0
    seen, seen_bias = np.full(features.shape[1], 1e-8), 1e-8
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(features @ weights.astype(np.float32) + bias))) - good
        step, step_bias = error.astype(np.float32) @ features / len(good) + decay * weights, error.mean()
        seen, seen_bias = seen + step * step, seen_bias + step_bias * step_bias
        weights -= rate * step / np.sqrt(seen)
        bias -= rate * step_bias / np.sqrt(seen_bias)
    return np.append(weights, bias)


def classify(docs: DataFrame, keep: float = KEEP, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, pattern, posterior, score, kept) of every row: the weak label's and the scorer's probability of good.

    ``carry`` names further columns of ``docs`` that the rows keep, so that a caller can filter them without a join.
    """
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[c for c in carry if c not in ("doc_id", "text")])
    docs = whole.select("doc_id", "text")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = 3 ** np.arange(LABELLERS)
        for batch in batches:
            codes = [int(np.dot(votes(t), base)) for t in column_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int32())], ["doc_id", "pattern"])

    voted = docs.mapInArrow(sliced(vote), "doc_id long, pattern int")
    counted = voted.groupBy("pattern").count().orderBy("pattern").toArrow()  # at most 3 ** LABELLERS rows
    if not counted.num_rows:
        none = (F.lit(0).alias("pattern"), F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
        return whole.select("doc_id", *none, *[c for c in whole.columns if c in carry and c != "doc_id"])
    codes, counts = np.array(counted.column("pattern")), np.array(counted.column("count"))
    _, _, good = estimate(_decode(codes), counts)
    posterior = dict(zip(codes.tolist(), good.tolist(), strict=True))

    share = min(1.0, 2 * FIT / int(counts.sum()))
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(FIT)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = 3 ** np.arange(LABELLERS)
        for batch in batches:
            every = column_bytes(batch.column(1))
            for at in range(0, len(every), 64):
                texts = every[at : at + 64]
                features = pa.array([x.astype(np.float16).tobytes() for x in _features(texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([features, pa.array([int(np.dot(votes(t), base)) for t in texts], pa.int32())], ["features", "pattern"])

    chosen = picked.mapInArrow(sliced(sample), "features binary, pattern int").toArrow()
    matrix = np.frombuffer(b"".join(chosen.column("features").to_pylist()), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    seen = np.array(chosen.column("pattern"), np.int64)
    model = fit_scorer(np.concatenate([matrix, _shapes(_decode(seen))], axis=1), np.array([posterior[c] for c in seen.tolist()])) if len(matrix) else np.zeros(BUCKETS + 2 * LABELLERS + 1)

    passed = [c for c in whole.columns if c in carry and c != "doc_id"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = 3 ** np.arange(LABELLERS)
        for batch in batches:
            ids, texts = batch.column(0), column_bytes(batch.column(1))
            pattern = [int(np.dot(votes(t), base)) for t in texts]
            n, found = trigrams.sums(texts, model[None, :BUCKETS])
            shape = _shapes(_decode(np.array(pattern, np.int64))) @ model[BUCKETS:-1]
            scores = 1 / (1 + np.exp(-np.clip(SCALE * found[:, 0] / (n + SHORT) + shape + model[-1], -500, 500)))
            weak = np.array([posterior[p] for p in pattern])
            blank = np.array([not t.strip() for t in texts], bool)
            yield pa.RecordBatch.from_arrays([ids, pa.array(pattern, pa.int32()), pa.array(weak, pa.float64()), pa.array(scores, pa.float64()), pa.array((scores >= keep) & ~blank), *[batch.column(c) for c in passed]], ["doc_id", "pattern", "posterior", "score", "kept", *passed])

    found = "doc_id long, pattern int, posterior double, score double, kept boolean"
    return whole.mapInArrow(sliced(score), ", ".join([found, *[f"`{c}` {whole.schema[c].dataType.simpleString()}" for c in passed]]))
