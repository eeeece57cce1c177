"""Ordered operators on one hot key: ranges of time give what one walk over the whole key gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterframe.operators import ordered

SEEN = "k long, i long, at long, v long, r boolean"


def observed(seed, times):
    """A key with a third of all rows, a null key and small ones; ``times``: how many distinct times there are."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(600):
        k = 0 if i % 3 == 0 else None if i % 7 == 0 else int(rng.integers(1, 9))
        out.append((k, i, int(rng.integers(0, times)), int(rng.integers(0, 40)) + i // 20, bool(rng.random() < 0.05)))
    return out


def walked(rows):
    out, base = [], {}
    for k, i, at, v, r in sorted(rows, key=lambda x: (x[2], x[1])):
        new = type("New", (), {"at": at, "value": v, "reset": r})
        outcome, amount, stands = ordered.judged(new, *base.get(k, (None, None)))
        if stands:
            base[k] = (v, at)
        out.append((k, i, outcome, amount))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_of_a_range", [7, 40, 1 << 20])
@pytest.mark.parametrize("times", [25, 300, None])
def test_counters_by_ranges(spark, monkeypatch, rows_of_a_range, times):
    monkeypatch.setattr(ordered, "RANGE_ROWS", rows_of_a_range)
    rows = observed(1, times or 10)
    rows = rows if times else [(k, i, i * 3, v, r) for k, i, _, v, r in rows]  # no time twice
    found = ordered.counter_deltas(spark.createDataFrame(rows, SEEN).repartition(4), "k", "at", "v", "r", "i").collect()
    assert sorted(((r.k, r.i, r.outcome, r.amount) for r in found), key=str) == walked(rows)


def test_baselines_compose():
    rng = np.random.default_rng(2)
    for _ in range(300):
        groups = [[(int(rng.integers(0, 30)), bool(rng.random() < 0.1)) for _ in range(rng.integers(1, 5))] for _ in range(rng.integers(1, 6))]
        whole = None
        for g in groups:
            one = ordered.Baseline.of(g)
            whole = one if whole is None else whole.then(one)
        for start in [None, *range(32)]:
            base, at = start, -1
            for t, g in enumerate(groups):
                for v, r in g:
                    _, _, stands = ordered.judged(type("New", (), {"at": t, "value": v, "reset": r}), base, at)
                    base, at = (v, t) if stands else (base, at)
            assert whole(start) == base


@pytest.mark.parametrize("rows_of_a_range", [7, 1 << 20])
def test_context_steps_and_echoes_by_ranges(spark, monkeypatch, rows_of_a_range):
    monkeypatch.setattr(ordered, "RANGE_ROWS", rows_of_a_range)
    rows = observed(3, 60)
    frame = spark.createDataFrame(rows, SEEN).repartition(4)
    setter, bound = F.when(F.col("v") % 5 == 0, F.col("v")), F.col("v") % 4 == 0
    got = {r.i: (r.c, r.v) for r in ordered.carried(frame, "k", ["at", "i"], {"c": setter}).collect()}
    steps = {r.i: r.step for r in ordered.numbered(frame, "k", ["at", "i"], bound).collect()}
    calls = frame.withColumn("last", F.when(F.col("v") % 3 > 0, F.col("v") % 3))
    verdicts = {r.i: r.verdict for r in ordered.echoes(calls, "k", ["at", "i"], "v", "last", F.col("i") % 2 == 0).collect()}
    context, count, before = {}, {}, {}
    for k, i, _, v, _ in sorted(rows, key=lambda x: (x[2], x[1])):
        context[k] = v if v % 5 == 0 else context.get(k)
        count[k] = count.get(k, 0) + (v % 4 == 0)
        assert got[i] == (context[k], v) and steps[i] == count[k]
        last = v % 3 or None
        old, seen = before.get(k, (None, None))
        if old is None or v > old:
            want = "new_call" if last else "no_evidence"
        elif v == old:
            want = ("compaction_echo" if i % 2 == 0 else "new_call") if last and last != seen else "duplicate_report"
        else:
            want = "new_call" if last and last != seen else "no_evidence"
        assert verdicts[i] == want
        before[k] = (v, last)


def test_active_path_of_deep_and_circular_trees(spark):
    rng = np.random.default_rng(4)
    nodes = [(1, i, i - 1 if i else None, i) for i in range(300)]  # a chain
    nodes += [(2, i, int(rng.integers(0, i)) if i else None, i) for i in range(120)]
    nodes += [(3, i, (i + 1) % 9, i) for i in range(9)] + [(3, 9, 4, 9)]  # a cycle with a tail
    nodes += [(4, 5, 77, 1), (5, 1, 1, 1)]  # a parent that is not there; a node above itself
    found = ordered.active_path(spark.createDataFrame(nodes, "t long, n long, p long, o long"), "t", "n", "p", "o").collect()
    want = set()
    for tree in range(1, 6):
        above = {n: p for t, n, p, _ in nodes if t == tree}
        at, depth = max((o, n) for t, n, _, o in nodes if t == tree)[1], 0
        while at in above and (tree, at) not in {x[:2] for x in want}:
            want.add((tree, at, depth))
            at, depth = above[at], depth + 1
    assert {(r.t, r.n, r.depth) for r in found} == want
    assert ordered.active_path(spark.createDataFrame([], "t long, n long, p long, o long"), "t", "n", "p", "o").count() == 0
