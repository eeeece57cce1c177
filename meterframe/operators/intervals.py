"""Joins of instants with spans by bins: a span is cut into bins of one width, instants and bins meet by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEEK_DAYS = 7
WEEK_MS = 7 * 86_400_000


def within(rows: DataFrame, spans: DataFrame, keys: list[str], at: Column, first: Column, end: Column, width: int, how: str, also: Column | None = None) -> DataFrame:
    """``rows`` (alias r) joined with the ``spans`` (alias s) of their keys that hold ``at``: first <= at < end, and ``also``.

    A row lies in one bin, so it meets a span once however many bins the span is cut into. Keys with many rows are spread
    over their bins, and no row is compared with spans of another week. ``how``: inner, left, left_semi or left_anti.
    """
    bins = F.sequence(F.floor(first / width), F.floor((end - 1) / width))
    cut = spans.withColumns({"first_": first, "end_": end}).where("end_ > first_").withColumn("bin_", F.explode(bins))
    placed = rows.withColumns({"at_": at, "bin_": F.floor(at / width)})
    met = (F.col("r.bin_") == F.col("s.bin_")) & (F.col("r.at_") >= F.col("s.first_")) & (F.col("r.at_") < F.col("s.end_"))
    for k in keys:
        met &= F.col(f"r.{k}") == F.col(f"s.{k}")
    found = placed.alias("r").join(cut.alias("s"), met if also is None else met & also, how)
    return found if how in ("inner", "left") else found.drop("at_", "bin_")


def days(column: str) -> Column:
    return F.unix_date(column)
