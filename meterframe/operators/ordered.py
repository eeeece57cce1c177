"""Ordered records of one key: counters to deltas, carried context, boundaries and echoes."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from meterframe.sources.stored import checkpointed


def judged(new, value: int | None, at: int | None) -> tuple[str, int | None, bool]:
    """(outcome, amount, whether it becomes the baseline) of an observation after a baseline."""
    if value is None:
        return "first", new.value, True
    same = new.at == at
    if new.at < at or same and new.value != value:
        return "out_of_order", None, False
    if same:
        return "delta", 0, False
    if new.reset:
        return "reset", new.value, True
    if new.value >= value:
        return "delta", new.value - value, True
    return "regression", None, False


#: A key of more rows is cut into ranges of time of about so many.
RANGE_ROWS = 1 << 20


def instant(rows: DataFrame, column: str) -> Column:
    """A column of times as whole numbers in the same order."""
    kind = rows.schema[column].dataType.typeName()
    if kind == "timestamp":
        return F.unix_micros(column)
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(column))
    return F.unix_date(column).cast("long") if kind == "date" else F.col(column).cast("long")


def ranged(rows: DataFrame, key: str, at: Column) -> DataFrame:
    """``rows`` with ``id_``, the key as a value that is never null, and ``range_``: which stretch of time of its key a row lies
    in, so that no task holds a key of any size.

    Rows of one time are in one range. Keys of up to ``RANGE_ROWS`` rows are one range; there are no more others than one
    in so many rows, few enough to be broadcast. What a range takes over from those before it comes from a table of one row
    for each range.
    """
    timed = rows.withColumn("at_", at)
    hot = timed.groupBy(F.col(key).alias("k_")).agg(F.count("*").alias("n_"), F.min("at_").alias("low_"), F.max("at_").alias("high_")).where(F.col("n_") > RANGE_ROWS)
    span = F.greatest(F.lit(1), F.ceil((F.col("high_") - F.col("low_") + 1) * (RANGE_ROWS / F.col("n_")))).cast("long")
    cut = timed.join(F.broadcast(hot.select("k_", "low_", span.alias("span_"))), F.col(key).eqNullSafe(F.col("k_")), "left")
    number = F.coalesce(F.floor((F.col("at_") - F.col("low_")) / F.col("span_")).cast("long"), F.lit(0))
    return cut.select(*rows.columns, F.struct(key).alias("id_"), number.alias("range_"))


def _entered(rows: DataFrame, ranges: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``rows`` with what their range takes over: windows over the few ranges of a key, joined by the partitioning that the rows have."""
    carry = ranges.select(F.col("id_").alias("i_"), F.col("range_").alias("r_"), *[c.alias(n) for n, c in columns.items()])
    return rows.join(carry, (F.col("id_") == F.col("i_")) & (F.col("range_") == F.col("r_")), "left").drop("i_", "r_")


def _in_order() -> WindowSpec:
    """The ranges of a key."""
    return Window.partitionBy("id_").orderBy("range_")


def _before() -> WindowSpec:
    """The ranges of a key before a range."""
    return _in_order().rowsBetween(Window.unboundedPreceding, -1)


def counter_deltas(seen: DataFrame, key: str, at: str, value: str, reset: str, tie: str) -> DataFrame:
    """Every observation of a cumulative counter with its outcome and amount.

    The first gives the native total. A rise is a delta; a fall is a reset where there is evidence for one, else a
    regression that leaves the baseline. Another value at the same time is out of order. Where no two observations of a
    key have one time, the baseline is the greatest value since the last reset, and windows give it. Other keys' ranges are
    told as functions of the baseline that they begin with, which compose, and are then judged each from its own.
    """
    rows = seen.select(key, F.col(tie).alias("tie"), F.col(at).alias("at"), F.col(value).cast("long").alias("value"), F.col(reset).alias("reset"))
    rows = rows.withColumn("at", instant(rows, "at"))
    rows = ranged(rows, key, F.col("at"))
    order = Window.partitionBy("id_", "range_").orderBy("at", "tie")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    twice = F.coalesce(F.lag("at").over(order) == F.col("at"), F.lit(False))
    marked = rows.withColumns({"twice": twice, "turn": F.row_number().over(order), "segment": F.sum(F.col("reset").cast("int")).over(so_far)})
    tail = F.max_by("high", "segment")  # the greatest value since the range's last reset
    each = marked.groupBy("id_", "range_", "segment").agg(F.max("value").alias("high"), F.bool_or("twice").alias("twice"))
    ranges = each.groupBy("id_", "range_").agg(tail.alias("tail"), F.max("segment").alias("resets"), F.bool_or("twice").alias("twice"))
    ranges = ranges.withColumns({"any_twice": F.bool_or("twice").over(Window.partitionBy("id_")), "since": F.sum("resets").over(_in_order().rowsBetween(Window.unboundedPreceding, 0))})
    ranges = ranges.withColumn("after", F.max("tail").over(Window.partitionBy("id_", "since").orderBy("range_").rowsBetween(Window.unboundedPreceding, 0)))
    entered = _entered(marked, ranges, {"entry": F.lag("after").over(_in_order()), "any_twice": F.col("any_twice"), "opens": F.row_number().over(_in_order()) == 1})
    plain = entered.where("not any_twice")
    inside = F.max("value").over(Window.partitionBy("id_", "range_", "segment").orderBy("at", "tie").rowsBetween(Window.unboundedPreceding, -1))
    base = F.when(F.col("segment") == 0, F.greatest("entry", inside)).otherwise(inside)
    first, restarts = F.col("opens") & (F.col("turn") == 1), F.col("reset")
    outcome = F.when(first, "first").when(restarts, "reset").when(F.col("value") >= base, "delta").otherwise("regression")
    amount = F.when(first | restarts, F.col("value")).when(F.col("value") >= base, F.col("value") - base)
    clean = plain.select(key, F.col("tie").cast("long").alias(tie), outcome.alias("outcome"), amount.alias("amount"))
    return clean.unionByName(_judged_by_range(entered.where("any_twice").select(key, "range_", "tie", "at", "value", "reset"), seen.schema[key].dataType.simpleString(), key, tie))


class Baseline:
    """What a range makes of the baseline that it begins with: up to each limit a value, beyond the last one ``rest`` or, if
    that is None, the baseline itself. ``first`` is the baseline that it leaves where there was none."""

    def __init__(self, limits: list[int], values: list[int], rest: int | None, first: int | None):
        self.limits, self.values, self.rest, self.first = limits, values, rest, first

    @classmethod
    def of(cls, observations: list[tuple[int, bool]]) -> Baseline:
        """Of the observations of one time, in their order: the first that is a reset or not below the baseline stands."""
        limits: list[int] = []
        for value, reset in observations:
            if reset:
                return cls(limits, limits, value, observations[0][0])
            if not limits or value > limits[-1]:
                limits.append(value)
        return cls(limits, limits, None, observations[0][0])

    def __call__(self, base: int | None) -> int | None:
        if base is None:
            return self.first
        at = bisect_left(self.limits, base)
        return self.values[at] if at < len(self.limits) else base if self.rest is None else self.rest

    def then(self, after: Baseline) -> Baseline:
        """Both one after the other."""
        limits, values = list(self.limits), [after(v) for v in self.values]
        rest = after(self.rest) if self.rest is not None else after.rest
        if self.rest is None:
            at = bisect_right(after.limits, limits[-1]) if limits else 0
            limits, values = limits + after.limits[at:], values + after.values[at:]
        kept = [i for i in range(len(values)) if i + 1 == len(values) or values[i] != values[i + 1]]
        return Baseline([limits[i] for i in kept], [values[i] for i in kept], rest, after(self.first))


def _judged_by_range(rows: DataFrame, kind: str, key: str, tie: str) -> DataFrame:
    """``judged`` one after the other in each range, from the baseline that the ranges before it leave."""
    import pandas as pd

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["at", "tie"])
        whole = None
        for _, held in frame.groupby("at", sort=True):
            one = Baseline.of([(int(v), bool(r)) for v, r in zip(held["value"], held["reset"], strict=True)])
            whole = one if whole is None else whole.then(one)
        return pd.DataFrame({key: frame[key].iloc[:1], "range_": frame["range_"].iloc[:1], "limits": [whole.limits], "values": [whole.values], "rest": pd.array([whole.rest], "Int64"), "first": [whole.first]})

    def composed(frame: pd.DataFrame) -> pd.DataFrame:
        base, entries = None, []
        frame = frame.sort_values("range_")
        for r in frame.itertuples():
            entries.append(base)
            base = Baseline(list(r.limits), list(r.values), None if pd.isna(r.rest) else int(r.rest), int(r.first))(base)
        return pd.DataFrame({key: frame[key], "range_": frame["range_"], "entry": pd.array(entries, "Int64")})

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        # the baseline that a range begins with is of an earlier time
        held = None if pd.isna(frame["entry"].iloc[0]) else int(frame["entry"].iloc[0])
        when, out = None if held is None else frame["at"].min() - 1, []
        for new in frame.sort_values(["at", "tie"]).itertuples():
            outcome, amount, stands = judged(new, held, when)
            if stands:
                held, when = int(new.value), int(new.at)
            out.append((getattr(new, key), new.tie, outcome, amount))
        found = pd.DataFrame(out, columns=[key, tie, "outcome", "amount"])
        found["amount"] = found["amount"].astype("Int64")
        return found

    sums = rows.groupBy(key, "range_").applyInPandas(summed, f"{key} {kind}, range_ long, limits array<long>, `values` array<long>, rest long, first long")
    entries = sums.groupBy(key).applyInPandas(composed, f"{key} {kind}, range_ long, entry long")
    entered = _entered(rows.withColumn("id_", F.struct(key)), entries.withColumn("id_", F.struct(key)), {"entry": F.col("entry")})
    return entered.groupBy(key, "range_").applyInPandas(fold, f"{key} {kind}, {tie} long, outcome string, amount long")


def carried(rows: DataFrame, key: str, order: list[str], columns: dict[str, Column]) -> DataFrame:
    """Each named column's latest value so far, from the records that set it."""
    cut = ranged(rows.select("*", *[c.alias(f"set_{n}") for n, c in columns.items()]), key, instant(rows, order[0]))
    here = Window.partitionBy("id_", "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranges = cut.groupBy("id_", "range_").agg(*[F.max_by(f"set_{n}", F.when(F.col(f"set_{n}").isNotNull(), F.struct(*order))).alias(n) for n in columns])
    entry = {f"old_{n}": F.last(n, ignorenulls=True).over(_before()) for n in columns}
    inside = cut.withColumns({f"set_{n}": F.last(f"set_{n}", ignorenulls=True).over(here) for n in columns})
    return _entered(inside, ranges, entry).select(*rows.columns, *[F.coalesce(f"set_{n}", f"old_{n}").alias(n) for n in columns])


def numbered(rows: DataFrame, key: str, order: list[str], boundary: Column) -> DataFrame:
    """``step``: how many boundaries there were before and at each record."""
    cut = ranged(rows.withColumn("bound_", F.when(boundary, 1).otherwise(0)), key, instant(rows, order[0]))
    here = Window.partitionBy("id_", "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranges = cut.groupBy("id_", "range_").agg(F.sum("bound_").alias("n"))
    entry = {"old_": F.sum("n").over(_before())}
    inside = cut.withColumn("step", F.sum("bound_").over(here))
    return _entered(inside, ranges, entry).select(*rows.columns, (F.col("step") + F.coalesce("old_", F.lit(0))).cast("long").alias("step"))


def latest_samples(rows: DataFrame, keys: list[str], order: list[str], sample: Column, last_step: Column) -> DataFrame:
    """The last sample of each step; it is final once a later step has begun."""
    found = rows.groupBy(*keys).agg(F.max_by(sample, F.struct(*order)).alias("sample"), F.count("*").alias("samples"))
    return found.withColumn("final", last_step)


def tombstones(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Samples of a rewritten file: those that it still has, and the keys that are gone from it as ``excluded``."""
    gone = before.join(after.select(*keys).distinct(), keys, "left_anti").withColumn("status", F.lit("excluded"))
    return after.withColumn("status", F.lit("verified")).unionByName(gone)


def echoes(rows: DataFrame, key: str, order: list[str], total: str, last: str, compacted: Column) -> DataFrame:
    """``verdict`` on each snapshot's last call: new_call, compaction_echo, duplicate_report or no_evidence."""
    cut = ranged(rows, key, instant(rows, order[0]))
    window = Window.partitionBy("id_", "range_").orderBy(*order)
    pair = F.struct(F.col(total).alias("total"), F.col(last).alias("last"))
    ranges = cut.groupBy("id_", "range_").agg(F.max_by(pair, F.struct(*order)).alias("end_"))
    rows = _entered(cut.withColumns({"turn_": F.row_number().over(window), "lag_": F.lag(pair).over(window)}), ranges, {"old_": F.lag("end_").over(_in_order())})
    rows = rows.withColumn("lag_", F.when(F.col("turn_") == 1, F.col("old_")).otherwise(F.col("lag_"))).drop("turn_", "old_", "range_", "id_")
    before, seen = F.col("lag_.total"), F.col("lag_.last")
    valid = F.coalesce(F.col(last) > 0, F.lit(False))
    changed = ~F.col(last).eqNullSafe(seen)
    delta = F.col(total) - before
    verdict = (
        F.when(before.isNull() | (delta > 0), F.when(valid, "new_call").otherwise("no_evidence"))
        .when(delta == 0, F.when(changed & valid, F.when(compacted, "compaction_echo").otherwise("new_call")).otherwise("duplicate_report"))
        .otherwise(F.when(valid & changed, "new_call").otherwise("no_evidence"))
    )
    return rows.withColumn("verdict", verdict).drop("lag_")


def reconcile(details: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Sum of details, and what was carried over from before them, against the native total: the difference and a verdict.

    ``totals``: key, native, and carried where the source tells it.
    """
    sums = details.groupBy(key).agg(F.sum("amount").alias("detail"))
    carried = F.coalesce("carried", F.lit(0)) if "carried" in totals.columns else F.lit(0)
    joined = totals.join(sums, key, "left").withColumn("carried", carried.cast("long"))
    gap = F.col("native") - F.coalesce("detail", F.lit(0)) - F.col("carried")
    return joined.select(key, "native", "detail", "carried", gap.alias("gap"), F.when(F.col("detail").isNull(), "no_detail").when(gap == 0, "match").when(gap > 0, "missing").otherwise("excess").alias("verdict"))


def active_path(nodes: DataFrame, tree: str, node: str, parent: str, order: str) -> DataFrame:
    """The nodes from each tree's last entry to its root; abandoned branches are left out, a cycle ends the walk.

    Pointer doubling: after k rounds a node knows its ancestor 2^k steps up, and the path is known that far. Rounds are the
    logarithm of the longest path, and a tree may have any number of nodes; in a cycle every node keeps its least depth.
    """
    own = nodes.groupBy(F.col(tree).alias("t"), F.col(node).alias("n")).agg(F.max_by(parent, F.struct(F.col(parent).isNotNull(), F.col(order))).alias("up"), F.max(order).alias("o"))
    own = checkpointed(own)
    path = checkpointed(own.groupBy("t").agg(F.max_by("n", F.struct("o", "n")).alias("n")).withColumn("depth", F.lit(0).cast("long")))
    # a parent that is no node of the tree is no step
    known = own.select("t", F.col("n").alias("up"))
    jump = checkpointed(own.where("up is not null").select("t", "n", "up").join(known, ["t", "up"], "left_semi"))
    step, size = 1, path.count()
    while True:
        above = path.join(jump, ["t", "n"]).select("t", F.col("up").alias("n"), (F.col("depth") + step).alias("depth"))
        path = checkpointed(path.unionByName(above).groupBy("t", "n").agg(F.min("depth").alias("depth")))
        grown = path.count()
        if grown == size:
            return path.select(F.col("t").alias(tree), F.col("n").alias(node), "depth")
        size, step = grown, 2 * step
        jump = checkpointed(jump.join(jump.select("t", F.col("n").alias("up"), F.col("up").alias("further")), ["t", "up"]).select("t", "n", F.col("further").alias("up")))
