"""Joins of intervals with samples and with each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strokeflow.operators.series import BY

#: Levels of dyadic buckets: the widest is 2 ** 62 units of time.
LEVELS = range(63)


def _level(a: Column, b: Column) -> Column:
    """The level whose buckets are about as wide as [a, b), so that two of them cover it."""
    width = F.greatest(b - a, F.lit(1))
    return F.least(F.ceil(F.log2(width.cast("double"))), F.lit(LEVELS[-1])).cast("int")


def _bucket(t: Column, level: Column) -> Column:
    return F.call_function("shiftright", t, level)


def _cover(df: DataFrame, start: str, end: str) -> DataFrame:
    """``df`` with (__level, __bucket): a few rows for each interval, none for an empty one."""
    a, b = F.col(start), F.col(end)
    level = _level(a, b)
    first, last = _bucket(a, level), _bucket(b - 1, level)
    kept = df.where(a < b).withColumn("__level", level)
    return kept.withColumn("__bucket", F.explode(F.sequence(first, last)))  # two, or three where the logarithm was rounded


def samples_within(samples: DataFrame, intervals: DataFrame, t: str, start: str, end: str, by=BY) -> DataFrame:
    """Each pair of an interval [start, end) and a sample in it, for intervals of any lengths, overlapping or not.

    An interval lies in one or two buckets of about its own length, and a sample asks only at the levels that its
    session's intervals have: an equi-join on (session, level, bucket), never a range join. Times are whole
    numbers; empty intervals and nulls match nothing. Both sides' columns come back; beside ``by``, their names differ.
    """
    covered = _cover(intervals, start, end)
    levels = covered.groupBy(*by).agg(F.array_sort(F.collect_set("__level")).alias("__levels"))  # 63 at most
    asked = samples.join(levels, list(by)).withColumn("__level", F.explode("__levels")).drop("__levels")
    asked = asked.withColumn("__bucket", _bucket(F.col(t), F.col("__level")))
    met = asked.join(covered, [*by, "__level", "__bucket"])
    return met.where((F.col(t) >= F.col(start)) & (F.col(t) < F.col(end))).drop("__level", "__bucket")


def overlapping(left: DataFrame, right: DataFrame, start: str, end: str, prefix: str = "other_", by=BY) -> DataFrame:
    """Each pair of a left and a right interval that share a moment; the right one's columns get ``prefix``.

    Two intervals overlap if one begins inside the other, so the pairs are those of two joins of starts with
    intervals; a pair that begins at one moment is found by the first alone.
    """
    other = right.select(*by, *[F.col(c).alias(f"{prefix}{c}") for c in right.columns if c not in by])
    a, b = f"{prefix}{start}", f"{prefix}{end}"
    full, other_full = left.where(F.col(start) < F.col(end)), other.where(F.col(a) < F.col(b))
    inside = samples_within(full, other_full, start, a, b, by)
    around = samples_within(other_full, full, a, start, end, by).where(F.col(a) > F.col(start))
    return inside.unionByName(around.select(inside.columns))
