"""Keyed state of streams: counters with their baseline, and the context that a file's control records set.

State lies in the RocksDB store, which keeps it off the heap. A counter's baseline is kept for good, two numbers a key, as
the counter goes on from it however long it rests. Where ``ttl_ms`` ends it, a mark that the key was there stays: the next
observation is told apart as ``expired``, of unknown amount, since its total holds what was counted before. A context
ends after ``ttl_ms`` without a record of its file; what follows has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from meterframe.operators.ordered import judged

TTL_MS = 90 * 86_400_000
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Counters(StatefulProcessor):
    """T4: each observation of a cumulative counter with its outcome; the baseline is kept by key."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.base = handle.getValueState("base", "value long, at long", self.ttl_ms)
        self.known = handle.getValueState("known", "known boolean") if self.ttl_ms else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        value, at = self.base.get() if self.base.exists() else (None, None)
        ended, out = value is None and self.known is not None and self.known.exists(), []
        for new in pd.concat(list(rows)).sort_values(["at", "tie"]).itertuples():
            outcome, amount, stands = judged(new, value, at)
            if ended:
                outcome, amount, ended = "expired", None, False
            if stands:
                value, at = int(new.value), int(new.at)
            out.append((key[0], new.tie, outcome, amount))
        if value is not None:
            self.base.update((value, at))
            if self.known is not None:
                self.known.update((True,))
        frame = pd.DataFrame(out, columns=["key", "tie", "outcome", "amount"])
        frame["amount"] = frame["amount"].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


class Context(StatefulProcessor):
    """T5: each record with what the control records of its file have set so far, in this batch or an earlier one."""

    def __init__(self, columns: list[str], order: str, ttl_ms: int):
        self.columns, self.order, self.ttl_ms = columns, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("context", ", ".join(f"{c} string" for c in self.columns), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.held.get() if self.held.exists() else (None,) * len(self.columns)
        frame = pd.concat(list(rows)).sort_values(self.order)
        for c, old in zip(self.columns, before, strict=True):
            filled = frame[c].astype(object).where(frame[c].notna(), None).ffill()
            frame[c] = filled.where(filled.notna(), old)
        self.held.update(tuple(None if pd.isna(v) else v for v in frame[self.columns].iloc[-1]))
        yield frame

    def close(self) -> None:
        pass


def counter_stream(observations: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(key, tie, outcome, amount) of a stream of (key, tie, at, value, reset)."""
    observations.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return observations.groupBy("key").transformWithStateInPandas(Counters(ttl_ms), "key long, tie long, outcome string, amount long", "Append", "ProcessingTime")


def context_stream(records: DataFrame, file: str, order: str, columns: list[str], ttl_ms: int = TTL_MS) -> DataFrame:
    """A stream of records with each of ``columns`` filled from the latest record of its file that has it."""
    records.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return records.groupBy(file).transformWithStateInPandas(Context(columns, order, ttl_ms), records.schema, "Append", "ProcessingTime")
