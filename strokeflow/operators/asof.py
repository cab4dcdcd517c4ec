"""Aligning series of different clocks: hold, interpolation, gap filling.

Both series are put in one order by a union, so each alignment is one exchange and one sort, and
never a range join. The neighbour after a sample is found in descending order, or by an offset that
skips nulls, because a frame that reaches to the end of a session would be evaluated anew for every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strokeflow.operators.series import BY, collapse_times, next_known


def hold_with_timeout(
    samples: DataFrame, pulses: DataFrame, t: str, value: str, period: str, out: str, factor: float = 1.5, by=BY
) -> DataFrame:
    """Backward as-of with a tolerance of each pulse's own.

    A pulse's value holds from its time until the next pulse or ``factor`` periods, whichever is
    first; a pulse without a value or period holds nothing. Samples before the first pulse of the
    session get 0 if that pulse is later than 0. ``<out>_held`` says whether a pulse was held.
    """
    keys = [F.col(c) for c in by]
    extra = [c for c in samples.columns if c not in by]
    body = F.struct(*extra).alias("__row")
    pulse = F.struct(F.col(t).alias("t"), F.col(value).cast("double").alias("v"), F.col(period).cast("double").alias("p"))
    left = samples.select(*keys, F.col(t).alias("__t"), F.lit(1).alias("__kind"), body)
    right = pulses.select(*keys, F.col(t).alias("__t"), F.lit(0).alias("__kind"), pulse.alias("__pulse"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = W.partitionBy(*by).orderBy("__t", "__kind")
    held = F.last("__pulse", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    first = F.min(F.when(F.col("__kind") == 0, F.col("__t"))).over(W.partitionBy(*by))
    both = both.withColumns({"__held": held, "__first": first}).where("__kind = 1")
    h = F.col("__held")
    fresh = h["v"].isNotNull() & h["p"].isNotNull() & (F.col("__t") < h["t"] + factor * h["p"])
    lead_in = (F.col("__t") < F.col("__first")) & (F.col("__first") > 0)
    return both.select(
        *keys, "__row.*",
        F.when(fresh, h["v"]).when(lead_in, 0.0).alias(out), F.coalesce(fresh, F.lit(False)).alias(f"{out}_held"),
    )


def hold_own(df: DataFrame, pulse: Column, t: str, value: str, out: str, factor: float = 1.5, by=BY, order=("t_us", "seq")) -> DataFrame:
    """:func:`hold_with_timeout` where the pulses are rows of the samples themselves, those under ``pulse``.

    A pulse's period is the step since the pulse before it (``<out>_period``). The first column of ``order`` rises with ``t``. One
    order serves all, and the rows are not brought together again.
    """
    w = W.partitionBy(*by).orderBy(*order)
    on = F.coalesce(pulse, F.lit(False))
    before = F.last(F.when(on, F.col(t)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    df = df.withColumn(f"{out}_period", F.when(on, F.col(t) - before))
    point = F.when(on, F.struct(F.col(t).alias("t"), F.col(value).cast("double").alias("v"), F.col(f"{out}_period").cast("double").alias("p")))
    df = df.withColumn("__point", point)
    upto = W.partitionBy(*by).orderBy(order[0]).rangeBetween(W.unboundedPreceding, W.currentRow)
    df = df.withColumns({
        "__held": F.last("__point", ignorenulls=True).over(upto), "__first": F.min("__point.t").over(W.partitionBy(*by)),
    })
    h = F.col("__held")
    fresh = h["v"].isNotNull() & h["p"].isNotNull() & (F.col(t) < h["t"] + factor * h["p"])
    lead_in = (F.col(t) < F.col("__first")) & (F.col("__first") > 0)
    return df.withColumns({
        out: F.when(fresh, h["v"]).when(lead_in, 0.0), f"{out}_held": F.coalesce(fresh, F.lit(False)),
    }).drop("__point", "__held", "__first")


def interpolate_join(
    samples: DataFrame, source: DataFrame, t: str, value: str, out: str, by=BY, least: int = 2, match_single: bool = False
) -> DataFrame:
    """Value of ``source`` at each sample's time, on the line between its neighbours.

    Equal source times are averaged; null outside the source's span, and where a session has fewer
    than ``least`` source times. With ``match_single`` the only source time of a session gives its
    value to samples at that time, give or take 1e-8 and a hundred-thousandth of it.
    """
    keys = [F.col(c) for c in by]
    extra = [c for c in samples.columns if c not in by]
    points = collapse_times(source.where(F.col(value).isNotNull() & F.col(t).isNotNull()), t, [value], by)
    point = F.struct(F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("v"))
    left = samples.select(*keys, F.col(t).cast("double").alias("__t"), F.struct(*extra).alias("__row"))
    right = points.select(*keys, F.col(t).cast("double").alias("__t"), point.alias("__point"))
    both = left.unionByName(right, allowMissingColumns=True)
    forth, back = W.partitionBy(*by).orderBy("__t"), W.partitionBy(*by).orderBy(F.desc("__t"))
    both = both.withColumns({
        "__a": F.last("__point", ignorenulls=True).over(forth.rangeBetween(W.unboundedPreceding, W.currentRow)),
        "__b": F.last("__point", ignorenulls=True).over(back.rangeBetween(W.unboundedPreceding, W.currentRow)),
        "__n": F.count("__point").over(W.partitionBy(*by)),
    }).where("__row is not null")
    a, b = F.col("__a"), F.col("__b")
    line = F.when(b["t"] > a["t"], a["v"] + (b["v"] - a["v"]) * (F.col("__t") - a["t"]) / (b["t"] - a["t"])).otherwise(a["v"])
    inside = a.isNotNull() & b.isNotNull() & (F.col("__n") >= least)
    result = F.when(inside, line)
    if match_single:
        p = F.coalesce(a, b)
        near = F.abs(F.col("__t") - p["t"]) <= 1e-8 + 1e-5 * F.abs(p["t"])
        result = F.when(F.col("__n") == 1, F.when(near, p["v"])).otherwise(result)
    return both.select(*keys, "__row.*", result.alias(out))


def interpolate_gaps(df: DataFrame, value: str, t: str, out: str, by=BY, order=("t_us", "seq")) -> DataFrame:
    """Fill the gaps of a column between its first and last known value along straight lines."""
    w = W.partitionBy(*by).orderBy(*order)
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("t"), F.col(value).alias("v")))
    df = df.withColumn("__point", point)
    df = df.withColumns({
        "__a": F.last("__point", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), "__b": next_known("__point", by, order),
    })
    a, b = F.col("__a"), F.coalesce("__point", "__b")
    line = F.when(b["t"] > a["t"], a["v"] + (b["v"] - a["v"]) * (F.col(t) - a["t"]) / (b["t"] - a["t"])).otherwise(a["v"])
    return df.withColumn(out, F.when(a.isNotNull() & b.isNotNull(), line)).drop("__point", "__a", "__b")
