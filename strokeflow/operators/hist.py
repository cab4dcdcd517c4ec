"""Time-weighted histograms, occupancy grids and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def signed_log(v: Column) -> Column:
    """sign(v) * log10(1 + abs(v))."""
    return F.signum(v) * F.log10(1 + F.abs(v))


def signed_log_inverse(x: Column) -> Column:
    return F.signum(x) * (F.pow(F.lit(10.0), F.abs(x)) - 1)


def edge(low: Column, high: Column, bins: int, i: Column) -> Column:
    return low + i * ((high - low) / bins)


def bin_index(v: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin of equal width, from 0; the last bin is closed; null outside the range.

    The first guess is put right against the bin's own edges, so a value on an edge lies in the bin
    that the edge opens.
    """
    guess = F.least(F.floor((v - low) * bins / (high - low)), F.lit(bins - 1)).cast("int")
    guess = F.when(v < edge(low, high, bins, guess), guess - 1).otherwise(
        F.when((v >= edge(low, high, bins, guess + 1)) & (guess < bins - 1), guess + 1).otherwise(guess)
    )
    return F.when((v >= low) & (v <= high), F.greatest(guess, F.lit(0)))


def dense_bins(groups: DataFrame, bins: int, name: str = "bin") -> DataFrame:
    return groups.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))


def histogram(
    df: DataFrame, value: str, weight: str, bins: int, low: Column, high: Column, by: list[str], relative: bool = False
) -> DataFrame:
    """(by, bin, low_edge, high_edge, time) with all bins, as time or as percent of the group's time.

    ``low`` and ``high`` are literals or columns that are constant in a group.
    """
    rows = df.withColumns({"__lo": low, "__hi": high, "bin": bin_index(F.col(value), low, high, bins)})
    groups = rows.groupBy(*by).agg(F.max("__lo").alias("__lo"), F.max("__hi").alias("__hi"), F.sum(weight).alias("__all"))
    counts = rows.where("bin is not null").groupBy(*by, "bin").agg(F.sum(weight).alias("time"))
    out = dense_bins(groups, bins).join(counts, [*by, "bin"], "left").withColumn("time", F.coalesce("time", F.lit(0.0)))
    time = F.try_divide(100.0 * F.col("time"), F.nullif(F.col("__all"), F.lit(0.0))) if relative else F.col("time")
    lo, hi = F.col("__lo"), F.col("__hi")
    return out.select(
        *by, "bin", edge(lo, hi, bins, F.col("bin")).alias("low_edge"), edge(lo, hi, bins, F.col("bin") + 1).alias("high_edge"),
        time.alias("time"),
    )


def velocity_histogram(
    df: DataFrame, value: str, weight: str, bins: int, by: list[str], log: bool = False, relative: bool = False
) -> DataFrame:
    """Time in each velocity bin: all, compression (>= 0) and rebound (< 0), on a range symmetric about 0."""
    x = signed_log(F.col(value)) if log else F.col(value)
    rows = df.withColumn("__x", x).where("__x is not null")
    reach = rows.groupBy(*by).agg(F.max(F.abs(F.col("__x"))).alias("__r"), F.sum(weight).alias("__all"))
    reach = reach.withColumn("__r", F.when(F.col("__r") > 0, F.col("__r")).otherwise(1.0))
    rows = rows.join(reach, by).withColumn("bin", bin_index(F.col("__x"), -F.col("__r"), F.col("__r"), bins))
    t, scale = F.col(weight), F.lit(1.0)
    sums = rows.groupBy(*by, "bin").agg(
        F.sum(t).alias("all_time"),
        F.sum(F.when(F.col(value) >= 0, t).otherwise(0.0)).alias("compression_time"),
        F.sum(F.when(F.col(value) < 0, t).otherwise(0.0)).alias("rebound_time"),
    )
    if relative:
        scale = F.try_divide(F.lit(100.0), F.nullif(F.col("__all"), F.lit(0.0)))
    out = dense_bins(reach, bins).join(sums, [*by, "bin"], "left")
    centre = edge(-F.col("__r"), F.col("__r"), bins, F.col("bin") + 0.5)
    return out.select(
        *by, "bin", (signed_log_inverse(centre) if log else centre).alias("center"),
        *[(F.coalesce(c, F.lit(0.0)) * scale).alias(c) for c in ("all_time", "compression_time", "rebound_time")],
    )


def occupancy(
    df: DataFrame, x: str, y: str, weight: str, nx: int, ny: int, ranges: tuple[Column, Column, Column, Column], by: list[str]
) -> DataFrame:
    """(by, x_bin, y_bin, time, samples) of the cells that have samples."""
    x0, x1, y0, y1 = ranges
    rows = df.withColumns({"x_bin": bin_index(F.col(x), x0, x1, nx), "y_bin": bin_index(F.col(y), y0, y1, ny)})
    return (
        rows.where("x_bin is not null and y_bin is not null").groupBy(*by, "x_bin", "y_bin")
        .agg(F.sum(weight).alias("time"), F.count(F.lit(1)).alias("samples"))
    )


def auto_ranges(df: DataFrame, x: str, y: str, by: list[str], tail: float = 0.005) -> DataFrame:
    """(by, x0, x1, y0, y1): x without its tails, y symmetric up to the high percentile of its size."""
    q = F.percentile(x, F.array(F.lit(tail), F.lit(1 - tail)))
    reach = F.percentile(F.abs(F.col(y)), F.lit(1 - tail))
    rows = df.groupBy(*by).agg(q.alias("q"), reach.alias("r"))
    low, high = F.col("q")[0], F.col("q")[1]
    pad = F.greatest(F.abs(low) * 0.05, F.lit(1.0))
    flat = ~(high > low)
    r = F.when(F.col("r") > 0, F.col("r")).otherwise(1.0)
    return rows.select(
        *by, F.when(flat, low - pad).otherwise(low).alias("x0"), F.when(flat, high + pad).otherwise(high).alias("x1"),
        (-r).alias("y0"), r.alias("y1"),
    )


def dense_grid(cells: DataFrame, groups: DataFrame, nx: int, ny: int, by: list[str]) -> DataFrame:
    """All cells of each group's grid, 0 where nothing was."""
    grid = dense_bins(dense_bins(groups.select(*by), nx, "x_bin"), ny, "y_bin")
    return grid.join(cells, [*by, "x_bin", "y_bin"], "left").fillna(0.0, ["time"]).fillna(0, ["samples"])


def bands(df: DataFrame, percent: str, weight: str, by: list[str]) -> DataFrame:
    """Percent of time in each tenth of 0 to 100; values beyond count in the outer bands."""
    band = F.least(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(percent))) / 10), F.lit(9)).cast("int")
    rows = df.where(F.col(percent).isNotNull()).withColumn("band", band)
    totals = rows.groupBy(*by).agg(F.sum(weight).alias("__all"))
    times = rows.groupBy(*by, "band").agg(F.sum(weight).alias("__t"))
    out = dense_bins(totals, 10, "band").join(times, [*by, "band"], "left")
    share = F.try_divide(100.0 * F.coalesce("__t", F.lit(0.0)), F.nullif(F.col("__all"), F.lit(0.0)))
    return out.select(*by, "band", share.alias("share"))


def display_intensity(time: Column, scale: str, by: list[str]) -> Column:
    """Intensity of a cell: linear, square root, or log10 with empty cells at the smallest time."""
    if scale == "sqrt":
        return F.sqrt(time)
    if scale == "log":
        least = F.min(F.when(time > 0, time)).over(W.partitionBy(*by))
        return F.log10(F.greatest(time, least))
    return time
