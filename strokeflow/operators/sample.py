"""Thinning a series for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strokeflow.operators.series import BY, ORDER, in_order


def _place(index: Column, size: Column, n: int) -> Column:
    """Whether a row is among ``n`` evenly spaced ones of ``size``: floor(k * (size - 1) / (n - 1)), k = 0 ... n-1."""
    if n == 1:
        return index == 0
    # The row is kept if some k lands on it: the least k with k*(size-1)/(n-1) >= index must give it.
    k = F.ceil(index * (n - 1) / (size - 1))
    return (size <= n) | (F.floor(k * (size - 1) / (n - 1)) == index)


def stride(df: DataFrame, n: int, by=BY, order=ORDER) -> DataFrame:
    """At most ``n`` evenly spaced rows of each session, with the first and the last."""
    df = df.withColumn("__i", F.row_number().over(in_order(by, order)) - 1)
    df = df.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*by)))
    return df.where(_place(F.col("__i"), F.col("__n"), n)).drop("__i", "__n")


def keep_extrema(df: DataFrame, values: list[str], n: int, by=BY, order=ORDER) -> DataFrame:
    """At most ``n`` rows of each session that keep the lowest and highest of each value.

    Rows are cut into buckets; each keeps the first lowest and first highest row of each value, the
    session keeps its ends, and what is still too much is thinned evenly.
    """
    buckets = max(1, n // (2 * len(values)))
    df = df.withColumn("__i", F.row_number().over(in_order(by, order)) - 1)
    df = df.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*by)))
    # Bucket b holds the rows from floor(b*n/buckets) up to the next bucket's start.
    bucket = F.ceil((F.col("__i") + 1) * buckets / F.col("__n")) - 1
    df = df.withColumn("__b", bucket)
    picks = [f(v, k).alias(f"p{j}") for j, (v, f, k) in enumerate(
        (F.col("__i"), F.min_by, F.struct(F.col(v) * sign, "__i")) for v in values for sign in (1.0, -1.0))]
    chosen = df.where(F.col("__n") > n).groupBy(*by, "__b").agg(*picks)
    chosen = chosen.select(*by, F.explode(F.array(*[f"p{j}" for j in range(len(picks))])).alias("__i")).distinct()
    chosen = chosen.withColumn("__hit", F.lit(True))
    df = df.join(chosen, [*by, "__i"], "left")
    keep = F.col("__hit") | (F.col("__i") == 0) | (F.col("__i") == F.col("__n") - 1) | (F.col("__n") <= n)
    df = df.where(F.coalesce(keep, F.lit(False))).drop("__b", "__hit", "__n", "__i")
    return stride(df, n, by, order)
