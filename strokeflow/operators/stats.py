"""Time-weighted statistics of groups."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strokeflow.sources.scratch import stored


def weighted_mean(v: Column, w: Column) -> Column:
    known = v.isNotNull()
    return F.try_divide(F.sum(v * w), F.nullif(F.sum(F.when(known, w)), F.lit(0.0)))


def weighted_rms(v: Column, w: Column) -> Column:
    return F.sqrt(weighted_mean(v * v, w))


def weighted_geometric_std(v: Column, w: Column) -> Column:
    """exp of the weighted standard deviation of the logarithms; positive values only.

    The mean square less the squared mean keeps it to one pass; below zero by rounding counts as zero.
    """
    log = F.when(v > 0, F.ln(v))
    mean, square = weighted_mean(log, w), weighted_mean(log * log, w)
    return F.exp(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))))


def _cumulated(df: DataFrame, value: str, weight: str, by: list[str], tie: list[str]) -> DataFrame:
    w = W.partitionBy(*by).orderBy(value, *tie)
    return df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).withColumns({
        "__cum": F.sum(weight).over(w.rowsBetween(W.unboundedPreceding, 0)),
        "__total": F.sum(weight).over(W.partitionBy(*by)),
    })


#: Parts of an octave of the first histogram, parts of a bucket of each further one, and rows that may be sorted at once.
OCTAVE, FURTHER, SORTED = 256, 4096, 500_000


def _bucket(v: Column) -> Column:
    """A number that never falls as v rises: ``OCTAVE`` for each doubling, on both sides of zero."""
    octave = F.log2(F.abs(v)) + 1100  # above 0 for the smallest double
    return F.when(F.isnan(v), F.lit(2**62)).when(v == 0, F.lit(0)).otherwise(F.floor(F.signum(v) * octave * OCTAVE)).cast("long")


def _narrowed(df: DataFrame, value: str, weight: str | Column, goals: list, by: list[str], tie: list[str]) -> DataFrame:
    """The distinct values around the places ``goals`` (functions of the total) of the cumulated weight, with it.

    A histogram of the leading part of each value, added up in each task first, tells in which buckets a goal
    lies. Buckets of over ``SORTED`` rows are divided further; of the others the rows alone are
    read, equal values merged, and sorted, each bucket in a task of its own. So no group is sorted as a whole.
    Rows: by, __v, __cum, __total, __first (weight of the value's first row by ``tie``), __c0 and __v0
    (weight and value before it; null for the group's lowest) and __top (the group's highest value).
    """
    weight = F.col(weight) if isinstance(weight, str) else weight
    v = F.col(value).cast("double")
    rows = df.select(*by, *tie, v.alias("__v"), weight.alias("__w")).where(F.col("__v").isNotNull() & (F.col("__w") > 0))
    names = [f"__{c}" for c in by]
    same = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names, strict=True)])
    keyed, wanted = rows.withColumn("__b", _bucket(F.col("__v"))), None
    while True:
        sums = keyed.groupBy(*by, "__b").agg(
            F.sum("__w").alias("__own"), F.count("*").alias("__rows"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"),
            *([] if wanted is None else [F.first(c).alias(c) for c in ("__from", "__under", "__total", "__top")]),
        )
        if wanted is None:
            group, w = W.partitionBy(*by), W.partitionBy(*by).orderBy("__b")
            sums = sums.withColumns({"__total": F.sum("__own").over(group), "__top": F.max("__hi").over(group), "__from": F.lit(0), "__under": F.lit(None).cast("double")})
        else:
            w = W.partitionBy(*by, "__from").orderBy("__b")
        before = F.col("__from") + F.coalesce(F.sum("__own").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        sums = sums.withColumns({"__before": before, "__below": F.coalesce(F.lag("__hi").over(w), F.col("__under"))})
        places = [g(F.col("__total")) for g in goals]
        end = F.col("__before") + F.col("__own")
        inside = [(g <= end) & ((g > F.col("__before")) | F.col("__below").isNull()) for g in places]
        here = functools.reduce(Column.__or__, inside, F.col("__hi") == F.col("__top"))
        open_ = (F.col("__rows") > SORTED) & (F.col("__lo") < F.col("__hi")) & ~F.col("__hi").isin(float("inf"), float("nan")) & (F.col("__lo") != float("-inf"))
        wanted = stored(
            sums.where(here).select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col("__b").alias("__in"), "__before", "__below", "__total", "__top", "__lo", "__hi", open_.alias("__open")),
            "quantile-buckets",
        )
        keyed = keyed.drop("__from", "__under", "__total", "__top").join(wanted, same & (F.col("__b") == F.col("__in"))).drop(*names)
        if wanted.where("__open").isEmpty():
            break
        part = F.floor((F.col("__v") - F.col("__lo")) * FURTHER / (F.col("__hi") - F.col("__lo")))
        keyed = keyed.withColumn("__b", F.when(F.col("__open"), part).otherwise(F.lit(0)).cast("long")).withColumnsRenamed({"__before": "__from", "__below": "__under"}).drop("__in", "__lo", "__hi", "__open")
    bucket = [*by, "__before"]
    merged = keyed.groupBy(*bucket, "__v").agg(
        F.sum("__w").alias("__w"), F.min_by("__w", F.struct(*tie)).alias("__first") if tie else F.first("__w").alias("__first"), *[F.first(c).alias(c) for c in ("__below", "__total", "__top")]
    )
    w = W.partitionBy(*bucket).orderBy("__v")
    merged = merged.withColumn("__cum", F.col("__before") + F.sum("__w").over(w.rowsBetween(W.unboundedPreceding, 0)))
    start = F.when(F.col("__below").isNotNull(), F.col("__before"))
    return merged.withColumns({"__c0": F.coalesce(F.lag("__cum").over(w), start), "__v0": F.coalesce(F.lag("__v").over(w), F.col("__below"))})


def _at(q: float):
    return lambda total: F.lit(q) * total


def weighted_quantiles_inv(
    df: DataFrame, value: str, weight: str, quantiles: dict[str, float], by: list[str], tie: list[str], refine: bool = False
) -> DataFrame:
    """Inverse-CDF quantiles: the smallest value whose cumulated weight reaches q of the total.

    ``tie`` makes the order total, so that sums are taken in one order. With ``refine``, groups may have
    any size: only the values around a quantile are sorted.
    """
    if refine:
        rows = _narrowed(df, value, weight, [_at(q) for q in quantiles.values()], by, tie)
        return rows.groupBy(*by).agg(*[_reached("__v", q, F.lit(True)).alias(name) for name, q in quantiles.items()])
    rows = _cumulated(df, value, weight, by, tie)
    return rows.groupBy(*by).agg(*[_reached(value, q, F.lit(True)).alias(name) for name, q in quantiles.items()])


def linear_percentiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str]) -> DataFrame:
    """Exact percentiles, on the line between the two samples beside the place q * (n - 1), for groups of any size."""

    def rank(q: float, up: int):
        return lambda n: F.least(F.floor(F.lit(q) * (n - 1)) + 1 + up, n)

    rows = _narrowed(df, value, F.lit(1).cast("long"), [rank(q, up) for q in shares.values() for up in (0, 1)], by, [])
    n = F.max("__total")
    aggs = []
    for name, q in shares.items():
        low, high = (F.min(F.when(F.col("__cum") >= rank(q, up)(F.col("__total")), F.col("__v"))) for up in (0, 1))
        part = F.lit(q) * (n - 1) - F.floor(F.lit(q) * (n - 1))
        aggs.append((low + (high - low) * part).alias(name))
    return rows.groupBy(*by).agg(*aggs)


def weighted_quantiles_of(
    df: DataFrame, wanted: dict[str, tuple[Column, Column, dict[str, float]]], weight: str, by: list[str], tie: list[str], interp: bool = False
) -> DataFrame:
    """Quantiles of several values in one shuffle, by inverse CDF or (``interp``) on the line through its points.

    ``wanted`` maps a kind to (mask, value, {name: q}); a kind's rows are those under its mask. A group
    has a row if any kind has rows there.
    """
    kinds = [F.when(mask, F.struct(F.lit(kind).alias("__kind"), value.alias("__v"))) for kind, (mask, value, _) in wanted.items()]
    rows = df.select(*by, *tie, weight, F.explode(F.array_compact(F.array(*kinds))).alias("__x")).select(*by, *tie, weight, "__x.*")
    rows = _cumulated(rows, "__v", weight, [*by, "__kind"], tie)
    if interp:
        rows = _with_previous(rows, "__v", [*by, "__kind"], tie)
    pick = _on_line if interp else _reached
    aggs = [pick("__v", q, F.col("__kind") == kind).alias(name) for kind, (_, _, qs) in wanted.items() for name, q in qs.items()]
    return rows.groupBy(*by).agg(*aggs)


def beside_quantiles(
    df: DataFrame, wanted: dict[str, dict[str, float]], weight: str, by: list[str], tie: list[str], on_rows: bool = False
) -> tuple[DataFrame, dict[str, Column]]:
    """Interpolated quantiles of columns (``wanted``: column to {name: q}) for rows that a grouping by ``by`` reads anyway.

    Gives the rows with their cumulated weights, and the quantiles as aggregates of a group (``on_rows``: as windows). Where the rows of a group are together already,
    each column costs a sort and no shuffle; :func:`weighted_quantiles_of` reads and shuffles all values once more.
    """
    w, aggs = F.col(weight), {}
    most = (lambda c: F.max(c).over(W.partitionBy(*by))) if on_rows else F.max
    for v in wanted:
        df = df.withColumn(f"__x_{v}", F.when(w > 0, F.col(v)))
    df = df.withColumns({f"__total_{v}": F.sum(F.when(F.col(f"__x_{v}").isNotNull(), w)).over(W.partitionBy(*by)) for v in wanted})
    for v, names in wanted.items():
        # What does not count comes first, as null.
        x, total, order = F.col(f"__x_{v}"), F.col(f"__total_{v}"), W.partitionBy(*by).orderBy(f"__x_{v}", *tie)
        counted = F.when(x.isNotNull(), w)
        df = df.withColumns({
            f"__cum_{v}": F.when(x.isNotNull(), F.sum(counted).over(order.rowsBetween(W.unboundedPreceding, 0))),
            f"__cum0_{v}": F.sum(counted).over(order.rowsBetween(W.unboundedPreceding, -1)), f"__v0_{v}": F.lag(x).over(order),
        })
        cum, cum0, v0 = F.col(f"__cum_{v}"), F.col(f"__cum0_{v}"), F.col(f"__v0_{v}")
        for name, q in names.items():
            goal = q * total
            line = F.coalesce(v0 + (x - v0) * (goal - cum0) / (cum - cum0), x)
            aggs[name] = F.coalesce(most(F.when((cum >= goal) & (cum0.isNull() | (cum0 < goal)), line)), most(x))
    return df, aggs


def _reached(value: str, q: float, on: Column) -> Column:
    return F.min(F.when(on & (F.col("__cum") >= q * F.col("__total")), F.col(value)))


def _with_previous(rows: DataFrame, value: str, by: list[str], tie: list[str]) -> DataFrame:
    w = W.partitionBy(*by).orderBy(value, *tie)
    return rows.withColumns({"__cum0": F.lag("__cum").over(w), "__v0": F.lag(value).over(w)})


def _on_line(value: str, q: float, on: Column) -> Column:
    goal = q * F.col("__total")
    line = F.col("__v0") + (F.col(value) - F.col("__v0")) * (goal - F.col("__cum0")) / (F.col("__cum") - F.col("__cum0"))
    at = F.when(on & (F.col("__cum") >= goal), F.struct(F.col("__cum").alias("c"), F.coalesce(line, F.col(value)).alias("v")))
    return F.coalesce(F.min(at)["v"], F.max(F.when(on, F.col(value))))


def weighted_quantiles_interp(
    df: DataFrame, value: str, weight: str, quantiles: dict[str, float], by: list[str], tie: list[str], refine: bool = False
) -> DataFrame:
    """Quantiles on the line through (cumulated weight, value), held at both ends; ``refine`` as above."""
    if not refine:
        rows = _with_previous(_cumulated(df, value, weight, by, tie), value, by, tie)
        return rows.groupBy(*by).agg(*[_on_line(value, q, F.lit(True)).alias(name) for name, q in quantiles.items()])
    rows = _narrowed(df, value, weight, [_at(q) for q in quantiles.values()], by, tie)
    aggs = []
    for name, q in quantiles.items():
        goal = q * F.col("__total")
        # Of equal values the first in order ends the line; the others are level with it.
        line = F.col("__v0") + (F.col("__v") - F.col("__v0")) * (goal - F.col("__c0")) / F.col("__first")
        on = F.when(goal <= F.col("__c0") + F.col("__first"), line)
        at = F.when(F.col("__cum") >= goal, F.struct(F.col("__cum").alias("c"), F.coalesce(on, F.col("__v")).alias("v")))
        aggs.append(F.coalesce(F.min(at)["v"], F.max("__v")).alias(name))
    return rows.groupBy(*by).agg(*aggs)


def time_where(mask: Column, dt: Column) -> Column:
    return F.sum(F.when(mask, dt).otherwise(0.0))


def share_where(mask: Column, dt: Column) -> Column:
    """Percent of the time under a mask."""
    return F.try_divide(100.0 * time_where(mask, dt), F.nullif(F.sum(dt), F.lit(0.0)))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation; null if either side is constant."""
    both = a.isNotNull() & b.isNotNull()
    varies = (F.stddev_pop(F.when(both, a)) > 0) & (F.stddev_pop(F.when(both, b)) > 0)
    return F.when(varies, F.corr(a, b))


def padded_range(low: Column, high: Column, share: float = 0.05) -> tuple[Column, Column]:
    """A range as it is, or widened by ``share`` of its size (1 at zero) where both ends are equal."""
    pad = F.when(low == 0, 1.0).otherwise(F.abs(low) * share)
    return F.when(high > low, low).otherwise(low - pad), F.when(high > low, high).otherwise(high + pad)


def smoothed_mode(
    df: DataFrame, value: str, weight: str, by: list[str], bins: int = 100, sigma: float = 2.0, radius: int = 8,
    span: tuple[float, float] | None = None, spanned: Column | None = None,
) -> DataFrame:
    """(by, mode): peak of a weighted histogram smoothed by a Gaussian, refined by a parabola.

    The histogram covers ``span`` (of all groups, or those that are ``spanned``), or the group's lowest to
    highest value, and is taken as zero beyond; of equal peaks the lowest bin counts; edge bins are not refined.
    """
    from strokeflow.operators.hist import bin_index

    stats = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    lo, hi = mode_range(F.col("__lo"), F.col("__hi"), span, spanned)
    stats = stats.select(*by, lo.alias("__lo"), hi.alias("__hi"))
    index = bin_index(F.col(value), F.col("__lo"), F.col("__hi"), bins)
    counts = df.join(stats, by).withColumn("bin", index).where("bin is not null").groupBy(*by, "bin").agg(F.sum(weight).alias("__n"))
    full = counts.groupBy(*by).agg(F.collect_list("bin").alias("__bins"), F.collect_list(F.coalesce("__n", F.lit(0.0))).alias("__n"))
    peak = mode_of_bins(bins, sigma, radius)
    none = F.array().cast("array<int>"), F.array().cast("array<double>")
    return stats.join(full, by, "left").select(*by, peak(F.coalesce("__bins", none[0]), F.coalesce("__n", none[1]), F.col("__lo"), F.col("__hi")).alias("mode"))


def mode_range(low: Column, high: Column, span: tuple[float, float] | None, spanned: Column | None = None) -> tuple[Column, Column]:
    """Range of a mode's histogram: ``span`` (of all groups, or those that are ``spanned``), else the values' own, padded."""
    lo, hi = padded_range(low, high)
    if span is None:
        return lo, hi
    spanned = F.lit(True) if spanned is None else spanned
    return F.when(spanned, span[0]).otherwise(lo), F.when(spanned, span[1]).otherwise(hi)


def mode_of_bins(bins: int, sigma: float, radius: int):
    """Function of columns: the mode from a group's bins (in any order), their weights, and the histogram's range.

    A group is a row of at most ``bins`` bins; a batch of groups is smoothed at once, not each bin as a row of its own.
    """
    kernel = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    norm = sum(kernel)

    def peak(places: pd.Series, weights: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        n = len(places)
        if not n:
            return pd.Series([], dtype="float64")
        padded = np.zeros((n, bins + 2 * radius))
        group = np.repeat(np.arange(n), [len(x) for x in places])
        padded[group, np.concatenate(list(places)).astype(int) + radius] = np.concatenate(list(weights)).astype(float)
        smooth = np.zeros((n, bins))
        for i, k in enumerate(kernel):
            smooth += padded[:, i : i + bins] * (k / norm)
        smooth = np.round(smooth, 9)
        at, each = smooth.argmax(axis=1), np.arange(n)  # the first of equal peaks
        inner = (at > 0) & (at < bins - 1)
        left, top, right = smooth[each, np.maximum(at - 1, 0)], smooth[each, at], smooth[each, np.minimum(at + 1, bins - 1)]
        bend = left - 2 * top + right
        curved = inner & (np.abs(bend) >= 1e-12)
        shift = np.where(curved, np.clip(0.5 * (left - right) / np.where(curved, bend, 1.0), -0.5, 0.5), 0.0)
        low, high = lo.to_numpy(float), hi.to_numpy(float)
        return pd.Series(low + (at + 0.5 + shift) * (high - low) / bins)

    return F.pandas_udf(peak, "double")
