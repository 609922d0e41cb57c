"""Intervals that overlap, by an equi-join on bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bins(start: Column, end: Column, width: int) -> Column:
    """Numbers of the bins that an interval, its end exclusive, reaches into."""
    return F.sequence(F.floor(start / width), F.floor((end - 1) / width))


def overlapping(left: DataFrame, right: DataFrame, by: str, width: int = 4096, start: str = "start", end: str = "end") -> DataFrame:
    """The rows of both sides of one group whose intervals (``start``, ``end``, ends exclusive) overlap, each pair once.

    Intervals are dealt into bins of ``width`` and meet there; of the bins that a pair has in common, the first counts. A
    long group is spread over its bins. ``width`` should be about as long as most intervals: an interval of n widths is
    copied n times. Empty intervals and nulls overlap nothing. Columns of the right side get ``right_`` before their names.
    """
    fine = (F.col(start) < F.col(end)) & F.col(by).isNotNull()
    a = left.where(fine).withColumn("bin", F.explode(_bins(F.col(start), F.col(end), width)))
    b = right.where(fine).select(*[F.col(c).alias(f"right_{c}") for c in right.columns])
    b = b.withColumn("right_bin", F.explode(_bins(F.col(f"right_{start}"), F.col(f"right_{end}"), width)))
    met = a.join(b, (F.col(by) == F.col(f"right_{by}")) & (F.col("bin") == F.col("right_bin")))
    overlap = (F.col(start) < F.col(f"right_{end}")) & (F.col(f"right_{start}") < F.col(end))
    first = F.col("bin") == F.floor(F.greatest(F.col(start), F.col(f"right_{start}")) / width)
    return met.where(overlap & first).drop("bin", "right_bin", f"right_{by}")
