"""Operators on the samples of a session in time order.

All take the columns that name a session (``by``) and put its samples in order (``order``). Nulls
stand for missing values. Operators on one key and order share a single exchange and sort.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

BY, ORDER = ("session_id",), ("t_us", "seq")


def in_order(by=BY, order=ORDER):
    return W.partitionBy(*by).orderBy(*order)


def whole(by=BY, order=ORDER):
    return in_order(by, order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def per_session(df: DataFrame, aggs: list[Column], by=BY) -> DataFrame:
    """Add aggregates of each session to its rows, by a grouping that is joined back.

    Partial aggregation keeps long sessions cheap, and the sort of the samples is not repeated.
    """
    keys = [F.col(c) for c in by]
    small = df.groupBy(*by).agg(*aggs)
    names = [f"__{c}" for c in by]
    small = small.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], *[c for c in small.columns if c not in by])
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names, strict=True)]
    cond = same[0]
    for x in same[1:]:
        cond = cond & x
    return df.join(small, cond, "left").drop(*names)


def over_session(df: DataFrame, aggs: dict[str, Column], by=BY) -> DataFrame:
    """As :func:`per_session` for rows that windows over the same key have brought together already: neither the
    rows' plan nor their exchange is made a second time, and their order stays."""
    w = W.partitionBy(*by)
    return df.withColumns({name: agg.over(w) for name, agg in aggs.items()})


def next_known(column: str, by=BY, order=ORDER) -> Column:
    """The next value of a column after a sample that is not null, in the samples' own order: no sort in descending order."""
    quoted = lambda names: ", ".join(f"`{c}`" for c in names)
    return F.expr(f"lead(`{column}`) IGNORE NULLS OVER (PARTITION BY {quoted(by)} ORDER BY {quoted(order)})")


def unwrap_clock(df: DataFrame, t: str, out: str, by=BY, order=("seq",), bits: int = 32) -> DataFrame:
    """Undo the wrapping of a counter: a fall of more than half its range adds a full range.

    Smaller steps back are left alone.
    """
    w = in_order(by, order)
    fell = F.when(F.lag(t).over(w) - F.col(t) > 2 ** (bits - 1), 1).otherwise(0)
    turns = F.sum("__fell").over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("__fell", fell).withColumn(out, F.col(t) + turns * F.lit(2**bits)).drop("__fell")


def step(t: str, by=BY, order=ORDER) -> Column:
    """Time since the sample before; null on the first one."""
    return F.col(t) - F.lag(t).over(in_order(by, order))


def sample_weights(df: DataFrame, t: str, out: str = "dt", by=BY, order=ORDER) -> DataFrame:
    """Time that each sample stands for: the step, or the median positive step where that is not positive."""
    df = df.withColumn("__step", step(t, by, order))
    df = over_session(df, {"__median": F.percentile(F.when(F.col("__step") > 0, F.col("__step")), F.lit(0.5))}, by)
    return df.withColumn(out, F.when(F.col("__step") > 0, F.col("__step")).otherwise(F.col("__median"))).drop("__step", "__median")


def repair_time(df: DataFrame, t: str, out: str, by=BY, order=("seq",)) -> DataFrame:
    """Strictly increasing times: a sample not after its repaired predecessor follows it by the median step.

    The rule is recursive, so sessions that need it go through one ordered pass, of which a task holds a
    batch and the last time; all others, found by one aggregate, keep their times and never leave the JVM.
    """
    stepped = df.withColumn("__step", step(t, by, order))
    stats = stepped.groupBy(*by).agg(
        F.percentile(F.when(F.col("__step") > 0, F.col("__step")), F.lit(0.5)).alias("__median"),
        F.coalesce(F.bool_or(F.col("__step") <= 0), F.lit(False)).alias("__broken"),
    )
    joined = df.join(stats, list(by))
    schema = T.StructType([*joined.schema.fields, T.StructField(out, T.DoubleType())])

    def fix(parts):
        session, last = None, None
        for pdf in parts:
            times = []
            for *key, now, median in zip(*[pdf[c] for c in by], pdf[t].astype(float), pdf["__median"], strict=True):
                if key != session:
                    session, last = key, None
                last = now if last is None or now > last else last + median
                times.append(last)
            yield pdf.assign(**{out: times})

    clean = joined.where(~F.col("__broken")).withColumn(out, F.col(t).cast("double"))
    fixed = joined.where("__broken").repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(fix, schema)
    return clean.unionByName(fixed).drop("__median", "__broken")


def speed_sanity(df: DataFrame, column: str, most: float = 200.0) -> DataFrame:
    """Speeds outside 0 to ``most`` become null; the raw ones stay beside them; doing it twice changes nothing."""
    raw = F.col(f"{column}_raw") if f"{column}_raw" in df.columns else F.col(column)
    df = df.withColumn(f"{column}_raw", raw)
    raw = F.col(f"{column}_raw")
    return df.withColumns({column: F.when(raw.between(0, most), raw), "rejected": F.coalesce(~raw.between(0, most), F.lit(False))})


def default_zero(df: DataFrame, value: str, first: int = 250, by=BY, order=ORDER) -> DataFrame:
    """(by, zero): the median of a session's first samples, rounded half to even."""
    ranked = df.withColumn("__rn", F.row_number().over(in_order(by, order))).where(F.col("__rn") <= first)
    return ranked.groupBy(*by).agg(F.bround(F.percentile(value, F.lit(0.5))).alias("zero"))


def odd_window(seconds: float, median_dt: Column, least: int = 1) -> Column:
    """Samples in a duration, made odd: 2 * floor(n / 2) + 1 of the rounded ratio n."""
    n = F.greatest(F.bround(F.lit(seconds) / median_dt), F.lit(least))
    return (2 * F.floor(n / 2) + 1).cast("int")


def calibrate(raw: Column, zero: Column, sign: Column | int = 1, anchor: Column | None = None) -> Column:
    """Signed counts from the zero, less the anchor's own counts where there is an anchor."""
    counts = sign * (raw - zero) + F.lit(0.0)  # never -0.0
    return counts if anchor is None else counts - F.coalesce(sign * (anchor - zero), F.lit(0.0))


def _padded(value: Column, k: int, by, order) -> Column:
    """Sum over 2k+1 samples; places beyond the ends repeat the first or last sample."""
    w, full = in_order(by, order), whole(by, order)
    rn, n = F.row_number().over(w), F.count(F.lit(1)).over(full)
    before, after = F.greatest(F.lit(0), k + 1 - rn), F.greatest(F.lit(0), k - n + rn)
    inside = F.sum(value).over(w.rowsBetween(-k, k))
    return inside + before * F.first(value).over(full) + after * F.last(value).over(full)


def moving_average(value: Column, window: int, by=BY, order=ORDER) -> Column:
    """Centred mean over an odd window with edge samples repeated; an even window is widened by one."""
    k = window // 2
    return _padded(value, k, by, order) / (2 * k + 1)


def moving_average_known(value: Column, window: int, by=BY, order=ORDER) -> Column:
    """As :func:`moving_average` over the known values alone; null where a window has none."""
    k = window // 2
    total = _padded(F.coalesce(value, F.lit(0.0)), k, by, order)
    return F.try_divide(total, F.nullif(_padded(value.isNotNull().cast("int"), k, by, order), F.lit(0)))


def rolling_sum(value: Column, window: int, by=BY, order=ORDER) -> Column:
    return _padded(value, window // 2, by, order)


def gradient(value: Column, t: Column, by=BY, order=ORDER) -> Column:
    """Derivative on uneven times: second order inside, one-sided at the ends, null for one sample."""
    w = in_order(by, order)
    prev, following = F.lag(value).over(w), F.lead(value).over(w)
    hs, hd = t - F.lag(t).over(w), F.lead(t).over(w) - t
    inner = (hs * hs * following + (hd * hd - hs * hs) * value - hd * hd * prev) / (hs * hd * (hs + hd))
    return (
        F.when(hs.isNull() & hd.isNull(), F.lit(None)).when(hs.isNull(), (following - value) / hd)
        .when(hd.isNull(), (value - prev) / hs).otherwise(inner)
    )


def gradient_in_runs(df: DataFrame, value: str, t: str, out: str, by=BY, order=ORDER, least: int = 3) -> DataFrame:
    """:func:`gradient` inside each unbroken run of known values with at least ``least`` samples."""
    w = in_order(by, order)
    known = F.col(value).isNotNull()
    edge = (known != F.lag(known).over(w)).cast("int")
    df = df.withColumn("__edge", F.coalesce(edge, F.lit(0)))
    df = df.withColumn("__run", F.sum("__edge").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = (*by, "__run")
    size = F.count(F.lit(1)).over(whole(runs, order))
    slope = gradient(F.col(value), F.col(t), runs, order)
    return df.withColumn(out, F.when(known & (size >= least), slope)).drop("__edge", "__run")


def gradient_bridged(df: DataFrame, value: str, t: str, out: str, by=BY, order=ORDER) -> DataFrame:
    """:func:`gradient` over the known values as if the others were not there; null at the others.

    Known and missing samples are told apart by one more partition column, so no join is needed.
    """
    parts = (*by, "__known")
    df = df.withColumn("__known", F.col(value).isNotNull())
    return df.withColumn(out, F.when(F.col("__known"), gradient(F.col(value), F.col(t), parts, order))).drop("__known")


def central_difference(value: Column, t: Column, by=BY, order=ORDER) -> Column:
    """(next - previous) / time between them, one-sided at the ends, null unless time moves on."""
    w = in_order(by, order)
    after, before = F.coalesce(F.lead(value).over(w), value), F.coalesce(F.lag(value).over(w), value)
    span = F.coalesce(F.lead(t).over(w), t) - F.coalesce(F.lag(t).over(w), t)
    return F.when(span > 0, (after - before) / span)


def percent_scale(value: Column, low: Column, high: Column) -> Column:
    """0 to 100 between low and high; 0 where these are equal."""
    return F.when(high > low, (value - low) / (high - low) * 100.0).otherwise(F.when(value.isNotNull(), 0.0))


def stroke_percent(value: Column, full: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Percent of the configured stroke, else of the used one, and which of them it was."""
    set_ = full.isNotNull() & (full != 0)
    return (
        F.when(set_, value / full * 100.0).otherwise(percent_scale(value, low, high)),
        F.when(set_, "configured").otherwise("used"),
    )


def sign_change(value: Column, by=BY, order=ORDER) -> Column:
    """Whether the sign differs from the sample before; zeros and missing values break it."""
    return F.coalesce(value * F.lag(value).over(in_order(by, order)) < 0, F.lit(False))


def roughness(df: DataFrame, value: str, out: str, window: int, by=BY, order=ORDER) -> DataFrame:
    """RMS, over the window, of the signal less its moving average."""
    df = df.withColumn("__rest", F.pow(F.col(value) - moving_average_known(F.col(value), window, by, order), 2))
    return df.withColumn(out, F.sqrt(moving_average_known(F.col("__rest"), window, by, order))).drop("__rest")


def collapse_times(df: DataFrame, t: str, values: list[str], by=BY) -> DataFrame:
    """One row for each time, with the mean of each value."""
    return df.groupBy(*by, t).agg(*[F.avg(v).alias(v) for v in values])
