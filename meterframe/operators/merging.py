"""Merges by identity: arbitration of versions, upserts with their outcome, set operations of packages and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def arbitrate(versions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each identity: the version that stands after all arrived in order, and whether there was a conflict.

    Revisions are compared where both sides have one, else the lifecycle's rank. The higher replaces, the lower is kept
    out; an equal one with other content is a conflict, and the old version stands. That is a total order where all
    versions of an identity have a revision, or none has: windows rank those. The mixed ones are folded in the order of
    their arrival.
    """
    arrival = Window.partitionBy(*keys).orderBy(*order, F.asc_nulls_first("source_revision"), "lifecycle_rank", "content")
    identity = arrival.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in the order of the other windows: one sort for all
    revised = F.col("source_revision").isNotNull()
    marked = versions.withColumns({"all_": F.bool_and(revised).over(identity), "any_": F.bool_or(revised).over(identity)})
    marked = marked.withColumn("rank_", F.when(F.col("all_"), F.col("source_revision")).when(~F.col("any_"), F.col("lifecycle_rank")))
    before = F.max("rank_").over(arrival.rowsBetween(Window.unboundedPreceding, -1))
    placed = marked.withColumns({"rises_": F.coalesce(F.col("rank_") > before, F.lit(False)), "turn_": F.row_number().over(arrival), "top_": F.max("rank_").over(identity)})
    # of the greatest rank the first to arrive stands; another of that rank with other content is a conflict
    row = F.struct(*order, "source_revision", "lifecycle_rank", "content")
    best, mixed = F.col("rank_") == F.col("top_"), F.col("any_") & ~F.col("all_")
    sums = placed.groupBy(*keys).agg(
        F.count("*").alias("versions"), F.min_by(F.when(best, row), F.when(best, F.col("turn_"))).alias("now"),
        (F.count_distinct(F.when(best, F.col("content"))) > 1).alias("conflict"), F.count_if("rises_").alias("replaced"),
        F.array_sort(F.collect_list(F.when(mixed, row))).alias("seen"),
    )
    done = F.when(F.size("seen") == 0, F.struct("now", "conflict", "replaced")).otherwise(_folded("seen"))
    return sums.select(*keys, "versions", done.alias("d")).select(*keys, "versions", "d.now.*", "d.conflict", "d.replaced")


def _folded(seen: str) -> Column:
    """(now, conflict, replaced) of versions of which some have a revision and some have none: no total order ranks them."""
    first = F.struct(F.try_element_at(seen, F.lit(1)).alias("now"), F.lit(False).alias("conflict"), F.lit(0).cast("long").alias("replaced"))

    def step(acc: Column, new: Column) -> Column:
        old = acc.now
        both = old.source_revision.isNotNull() & new.source_revision.isNotNull()
        higher = F.when(both, new.source_revision > old.source_revision).otherwise(new.lifecycle_rank > old.lifecycle_rank)
        equal = F.when(both, new.source_revision == old.source_revision).otherwise(new.lifecycle_rank == old.lifecycle_rank)
        clash = equal & (new.content != old.content)
        return F.struct(F.when(higher, new).otherwise(old).alias("now"), F.when(higher, F.lit(False)).otherwise(acc.conflict | clash).alias("conflict"), (acc.replaced + higher.cast("long")).alias("replaced"))

    return F.aggregate(F.slice(seen, 2, F.greatest(F.lit(1), F.size(seen))), first, step)


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], refused: str | None = None) -> DataFrame:
    """A full outer join of the stored rows and one batch: what stands, and ``outcome`` of added, updated, unchanged, skipped, conflict or kept.

    Both sides have content, source_revision and lifecycle_rank, once for each identity. ``refused``: a column of the batch;
    rows for which it is true meet no stored row and come out as they are, as ``rejected``, and may repeat an identity.
    """
    old, new = target.alias("o"), batch.alias("n")
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"o.{k}") == F.col(f"n.{k}")
    out = F.coalesce(F.col(f"n.{refused}"), F.lit(False)) if refused else F.lit(False)
    on = on & ~out if refused else on
    both = F.col("o.source_revision").isNotNull() & F.col("n.source_revision").isNotNull()
    order = lambda op: F.when(both, op(F.col("n.source_revision"), F.col("o.source_revision"))).otherwise(op(F.col("n.lifecycle_rank"), F.col("o.lifecycle_rank")))
    higher, equal = order(lambda a, b: a > b), order(lambda a, b: a == b)
    same = F.col("o.content") == F.col("n.content")
    outcome = (
        F.when(out, "rejected").when(F.col("o.content").isNull(), "added").when(F.col("n.content").isNull(), "kept").when(higher, "updated").when(equal & same, "unchanged").when(equal, "conflict").otherwise("skipped")
    )
    takes = outcome.isin("added", "updated", "rejected")
    columns = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys] + [F.when(takes, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in target.columns if c not in keys]
    return old.join(new, on, "full_outer").select(*columns, outcome.alias("outcome"))


def affected_days(target: DataFrame, batch: DataFrame, keys: list[str], day: str) -> DataFrame:
    """(day, added, updated, unchanged, skipped, conflict): how many rows of an upsert touch each day.

    An update counts on the day that it takes the row from as well as on the one that it takes it to; all others on the
    batch's day. Days that are only kept are not affected.
    """
    done = upsert(target, batch, keys).select(*keys, "outcome").where("outcome <> 'kept'")
    old, new = target.select(*keys, F.col(day).alias("old_")), batch.select(*keys, F.col(day).alias("new_"))
    both = done.join(old, keys, "left").join(new, keys, "left")
    days = F.when(F.col("outcome") == "updated", F.array_distinct(F.array_compact(F.array("old_", "new_")))).otherwise(F.array("new_"))
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("added", "updated", "unchanged", "skipped", "conflict")]
    return both.select(F.explode(days).alias(day), "outcome").groupBy(day).agg(*counts)


def first_occurrence(calls: DataFrame, identity: list[str], age: list[Column | str]) -> DataFrame:
    """Of calls of one identity the first by the age of its source."""
    return calls.withColumn("turn", F.row_number().over(Window.partitionBy(*identity).orderBy(*age))).where("turn = 1").drop("turn")


def merge_partitions(stored: DataFrame, incoming: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Package rows against stored ones: equal is unchanged, a newer or equal revision replaces, an older one is a conflict."""
    o, n = stored.alias("o"), incoming.alias("n")
    same = F.lit(True)
    for v in values:
        same &= F.col(f"o.{v}").eqNullSafe(F.col(f"n.{v}"))
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"o.{k}") == F.col(f"n.{k}")
    outcome = F.when(F.col("o.revision").isNull(), "added").when(same, "unchanged").when(F.col("n.revision") >= F.col("o.revision"), "replaced").otherwise("conflict")
    return n.join(o, on, "left").select(*[F.col(f"n.{k}") for k in keys], outcome.alias("outcome"))


def record_quota(history: DataFrame, seen: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, outcome): an identical row is skipped, another value at the same time replaces it, a new time is kept."""
    o, n = history.alias("o"), seen.alias("n")
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"o.{k}") == F.col(f"n.{k}")
    outcome = F.when(F.col(f"o.{keys[0]}").isNull(), "added").when(F.col(f"o.{value}").eqNullSafe(F.col(f"n.{value}")), "skipped").otherwise("corrected")
    return n.join(o, on, "left").select(*[F.col(f"n.{k}") for k in keys], outcome.alias("outcome"))


def select_authority(native: DataFrame, telemetry: DataFrame, scope: list[str], sealed: DataFrame, partition: list[str]) -> DataFrame:
    """Native rows with ``authority``: rows of a scope that telemetry covers are excluded, unless their partition is sealed."""
    covered = telemetry.select(*scope).distinct().withColumn("covered", F.lit(True))
    frozen = sealed.select(*partition).distinct().withColumn("frozen", F.lit(True))
    marked = native.join(covered, scope, "left").join(frozen, partition, "left")
    return marked.withColumn("authority", F.when(F.col("frozen"), "sealed").when(F.col("covered"), "excluded").otherwise("counted")).drop("covered", "frozen")
