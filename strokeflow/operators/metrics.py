"""Metrics of a session's channels: positions, velocities, sensor health and balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strokeflow.operators import hist, stats
from strokeflow.operators.series import over_session, percent_scale
from strokeflow.sources.scratch import stored

KEY = ["session_id", "channel"]
SIGNS = {"Compression": 1, "Rebound": -1}


def metric_catalog(travel_units: str = "counts", velocity_units: str = "counts/s") -> list[tuple[str, str, str, bool]]:
    """(metric, units, category, visible) of the 58 channel metrics, in order."""
    tenths = [f"P{a}-{a + 10}" for a in range(0, 100, 10)]
    rows = [
        ("Session duration", "s", "riding", True), ("Analog sample count", "samples", "hardware", True),
        ("Median analog dt", "us", "hardware", True), ("Minimum travel", travel_units, "riding", True),
        ("Maximum travel", travel_units, "riding", True), ("Used stroke", travel_units, "riding", False),
        ("Mean position", "%", "riding", True), ("Median position", "%", "riding", True), ("Mode position", "%", "riding", True),
        ("Position geometric SD", "x", "riding", True),
    ]
    rows += [(f"Position {t}", "%", "riding", True) for t in tenths]
    for sign in SIGNS:
        rows += [(f"{x} {sign.lower()} velocity", velocity_units, "riding", True) for x in ("Mean", "Median", "Mode")]
        rows += [(f"{sign} velocity geometric SD", "x", "riding", True)]
        rows += [(f"{sign} velocity {t}", "%", "riding", True) for t in tenths]
    rows += [(f"Peak {sign.lower()} velocity", velocity_units, "riding", True) for sign in SIGNS]
    rows += [
        ("RMS velocity", velocity_units, "riding", False), ("Time in bottom 10%", "%", "riding", False),
        ("Time in top 10%", "%", "riding", False), ("Raw count span", "counts", "hardware", True),
        ("ADC span used", "%", "hardware", True), ("Implied mm / count", "mm/count", "hardware", True),
        ("ADC rail-near low", "samples", "hardware", True), ("ADC rail-near high", "samples", "hardware", True),
    ]
    return rows


def rail_margin(bits: int) -> int:
    return max(1, round(((1 << bits) - 1) * 0.02))


def adc_health(df: DataFrame, bits: int, by: list[str]) -> DataFrame:
    """Span of the raw counts, share of the converter's range, samples near either rail."""
    top, margin = (1 << bits) - 1, rail_margin(bits)
    span = F.max("raw") - F.min("raw")
    return df.groupBy(*by).agg(
        span.alias("raw_span"), (100.0 * span / top).alias("adc_span_pct"),
        F.count_if(F.col("raw") <= margin).alias("rail_low"), F.count_if(F.col("raw") >= top - margin).alias("rail_high"),
    )


def signed_velocity(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, sign, mean, median, mode, geometric_sd) of the velocities >= 0 and < 0."""
    rows = df.where("velocity is not null and dt > 0").withColumn("sign", F.when(F.col("velocity") >= 0, 1).otherwise(-1))
    v, w = F.col("velocity"), F.col("dt")
    key = [*by, "sign"]
    wide = rows.groupBy(*key).agg(
        stats.weighted_mean(v, w).alias("mean"), stats.weighted_geometric_std(F.abs(v), w).alias("geometric_sd")
    )
    median = stats.weighted_quantiles_inv(rows, "velocity", "dt", {"median": 0.5}, key, ["seq"])
    return wide.join(median, key).join(stats.smoothed_mode(rows, "velocity", "dt", key), key)


POSITION, COMPRESSION, REBOUND = "Position", "Compression", "Rebound"


def distributions(rows: DataFrame) -> DataFrame:
    """Of ``rows(session_id, channel, seq, dt, position, velocity)``, for positions and for the velocities of each
    sign: (kind, mean, median, mode, geometric_sd, shares), the last an array of ten bands.

    Shares are percents of time in tenths: of 0 to 100 for positions, of the kind's own range, and of all time,
    for velocities. The kinds are rows of one table that is shuffled and sorted by value once: the order serves median and mode
    (a bin's time is known at its last row), and one grouping takes all measures.
    """
    position, velocity, bins = F.col("position"), F.col("velocity"), 100
    one = lambda cond, kind, v: F.when(cond, F.struct(F.lit(kind).alias("kind"), v.cast("double").alias("v")))
    kinds = F.array_compact(F.array(
        one(position.isNotNull(), POSITION, position), one(velocity >= 0, COMPRESSION, velocity), one(velocity < 0, REBOUND, velocity)
    ))
    timed = over_session(rows.where("dt > 0").select(*KEY, "seq", "dt", "position", "velocity"), {"__every": F.sum("dt")}, KEY)
    long = timed.select(*KEY, "seq", "dt", "__every", F.explode(kinds).alias("x")).select(*KEY, "seq", "dt", "__every", "x.*")
    key, v, dt, is_position = [*KEY, "kind"], F.col("v"), F.col("dt"), F.col("kind") == POSITION
    long = over_session(long, {"__lo": F.min("v"), "__hi": F.max("v"), "__own": F.sum("dt")}, key)
    low, high = stats.mode_range(F.col("__lo"), F.col("__hi"), (0.0, 100.0), is_position)
    long = long.withColumn("bin", hist.bin_index(v, low, high, bins))
    order = W.partitionBy(*key).orderBy("v", "seq")
    upto, binned = order.rowsBetween(W.unboundedPreceding, 0), F.col("bin").isNotNull()
    long = long.withColumns({
        "__cum": F.sum("dt").over(upto), "__cum_bin": F.sum(F.when(binned, dt)).over(upto),
        "__last": binned & ~F.col("bin").eqNullSafe(F.lead("bin").over(order)),
    })
    percent = F.when(is_position, v).otherwise(percent_scale(v, F.col("__lo"), F.col("__hi")))
    long = long.withColumn("band", F.least(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), percent)) / 10), F.lit(9)).cast("int"))
    whole = F.nullif(F.when(is_position, F.max("__own")).otherwise(F.max("__every")), F.lit(0.0))
    share = lambda i: F.try_divide(100.0 * F.sum(F.when(F.col("band") == i, dt).otherwise(0.0)), whole)
    found = long.groupBy(*key).agg(
        stats.weighted_mean(v, dt).alias("mean"), stats.weighted_geometric_std(F.abs(v), dt).alias("geometric_sd"),
        F.min(F.when(F.col("__cum") >= 0.5 * F.col("__own"), v)).alias("median"), F.array(*map(share, range(10))).alias("shares"),
        F.max("__lo").alias("__lo"), F.max("__hi").alias("__hi"),
        *[F.array_sort(F.collect_list(F.when(F.col("__last"), F.col(c)))).alias(c) for c in ("bin", "__cum_bin")],
    )
    low, high = stats.mode_range(F.col("__lo"), F.col("__hi"), (0.0, 100.0), is_position)
    # Bins and cumulated times both rise, so sorted they belong together.
    before = F.concat(F.array(F.lit(0.0)), F.slice("__cum_bin", 1, F.greatest(F.size("__cum_bin") - 1, F.lit(0))))
    times = F.zip_with("__cum_bin", before, lambda x, y: x - y)
    mode = stats.mode_of_bins(bins, 2.0, 8)(F.col("bin"), times, low, high)
    return found.select(*key, "mean", "median", mode.alias("mode"), "geometric_sd", "shares")


def channel_metrics(df: DataFrame, bits: int = 12, travel_units: str = "counts", velocity_units: str = "counts/s") -> DataFrame:
    """The 58 metrics of each (session_id, channel).

    ``df`` has session_id, channel, seq, dt (seconds), raw, travel and velocity. Positions are travel
    in percent where ``travel_units`` is "%" (clipped to 0-100), else on the channel's used range.
    """
    df = df.where(" and ".join(f"{c} is not null" for c in KEY))
    df = over_session(df, {"lo": F.min("travel"), "hi": F.max("travel")}, KEY)
    scaled = F.least(F.greatest(F.col("travel"), F.lit(0.0)), F.lit(100.0)) if travel_units == "%" else percent_scale(
        F.col("travel"), F.col("lo"), F.col("hi")
    )
    # Several parts read the rows, so they are written once.
    rows = stored(df.withColumn("position", scaled).select(*KEY, "seq", "dt", "raw", "travel", "velocity", "position", "lo", "hi"), "metrics")
    dt, travel, velocity = (F.col(c) for c in ("dt", "travel", "velocity"))
    good = F.when(dt > 0, dt)
    top, margin = (1 << bits) - 1, rail_margin(bits)
    tenth = 0.1 * (F.col("hi") - F.col("lo"))
    wide = rows.groupBy(*KEY).agg(
        F.coalesce(F.sum(good), F.lit(0.0)).alias("duration"), F.count(F.lit(1)).alias("n"),
        F.percentile(good, F.lit(0.5)).alias("median_dt"), F.min("travel").alias("lo"), F.max("travel").alias("hi"),
        F.max(velocity).alias("peak_c"), F.min(velocity).alias("peak_r"), F.sqrt(F.avg(velocity * velocity)).alias("rms"),
        F.sum(F.when(travel <= F.col("lo") + tenth, dt).otherwise(0.0)).alias("bottom"),
        F.sum(F.when(travel >= F.col("hi") - tenth, dt).otherwise(0.0)).alias("top"),
        (F.max("raw") - F.min("raw")).alias("span"), F.count_if(F.col("raw") <= margin).alias("rail_low"),
        F.count_if(F.col("raw") >= top - margin).alias("rail_high"),
    )
    c = F.col
    used = c("hi") - c("lo")
    all_time = F.nullif(c("duration"), F.lit(0.0))
    implied = F.try_divide(used, F.nullif(c("span"), F.lit(0.0))) if travel_units == "mm" else F.lit(None)
    values = {
        "Session duration": c("duration"), "Analog sample count": c("n"), "Median analog dt": c("median_dt") * 1e6,
        "Minimum travel": c("lo"), "Maximum travel": c("hi"), "Used stroke": used, "Peak compression velocity": c("peak_c"), "Peak rebound velocity": c("peak_r"),
        "RMS velocity": c("rms"), "Time in bottom 10%": F.try_divide(100.0 * c("bottom"), all_time),
        "Time in top 10%": F.try_divide(100.0 * c("top"), all_time), "Raw count span": c("span"),
        "ADC span used": 100.0 * c("span") / top, "Implied mm / count": implied, "ADC rail-near low": c("rail_low"),
        "ADC rail-near high": c("rail_high"),
    }
    low = {POSITION: "position", COMPRESSION: "compression velocity", REBOUND: "rebound velocity"}
    high = {POSITION: "Position", COMPRESSION: "Compression velocity", REBOUND: "Rebound velocity"}
    for kind in low:
        values |= {f"{x.capitalize()} {low[kind]}": c(kind)[x] for x in ("mean", "median", "mode")}
        values |= {f"{high[kind]} geometric SD": c(kind)["geometric_sd"]}
        values |= {f"{high[kind]} P{10 * i}-{10 * i + 10}": F.get(c(kind)["shares"], i) for i in range(10)}
    measures = F.struct("mean", "median", "mode", "geometric_sd", "shares")
    found = distributions(rows).groupBy(*KEY).agg(*[F.max(F.when(c("kind") == kind, measures)).alias(kind) for kind in low])
    # A channel's metrics are one row until the end, so they are not joined with the catalog.
    catalog = [
        F.struct(F.lit(i).alias("place"), F.lit(m).alias("metric"), F.lit(u).alias("units"), F.lit(k).alias("category"), F.lit(v).alias("visible"), values[m].cast("double").alias("value"))
        for i, (m, u, k, v) in enumerate(metric_catalog(travel_units, velocity_units))
    ]
    return wide.join(found, KEY, "left").select(*KEY, F.inline(F.array(*catalog))).select(*KEY, "metric", "place", "units", "category", "visible", "value")


def balance_rows(df: DataFrame) -> DataFrame:
    """Add front_pct, rear_pct, balance_pct, front_share_pct and active to rows with front, rear, dt.

    Each channel is scaled to its own used stroke; the front share counts where both together
    reach 10 %.
    """
    df = over_session(df, {f"__{n}_{c}": f(c) for c in ("front", "rear") for n, f in (("lo", F.min), ("hi", F.max))})
    front, rear = (percent_scale(F.col(x), F.col(f"__lo_{x}"), F.col(f"__hi_{x}")) for x in ("front", "rear"))
    df = df.withColumns({"front_pct": front, "rear_pct": rear})
    both = F.col("front_pct") + F.col("rear_pct")
    ok = (F.col("dt") > 0) & F.col("front_pct").isNotNull() & F.col("rear_pct").isNotNull()
    df = df.withColumns({
        "balance_pct": F.col("front_pct") - F.col("rear_pct"), "active": F.coalesce(ok & (both >= 10), F.lit(False)),
    })
    share = F.when(F.col("active"), 100.0 * F.col("front_pct") / F.nullif(both, F.lit(0.0)))
    return df.withColumn("front_share_pct", share).drop("__lo_front", "__hi_front", "__lo_rear", "__hi_rear")


def balance_summary(rows: DataFrame) -> DataFrame:
    """Mean, RMS and correlation of the balance, and shares of the active time by bias."""
    dt, b = F.col("dt"), F.col("balance_pct")
    w = F.when((dt > 0) & b.isNotNull(), dt)
    active = F.when(F.col("active"), dt)
    total = F.nullif(F.sum(active), F.lit(0.0))

    def share(mask: Column) -> Column:
        return F.try_divide(100.0 * F.sum(F.when(mask, active).otherwise(0.0)), total)

    return rows.groupBy("session_id").agg(
        stats.weighted_mean(b, w).alias("mean_balance_pct"), stats.weighted_rms(b, w).alias("rms_balance_pct"),
        stats.weighted_mean(F.col("front_share_pct"), active).alias("mean_front_share_pct"),
        stats.correlation(F.when(dt > 0, F.col("front_pct")), F.when(dt > 0, F.col("rear_pct"))).alias("correlation"),
        F.coalesce(F.sum(active), F.lit(0.0)).alias("active_time"), share(b > 10).alias("front_bias_time_pct"),
        share(b < -10).alias("rear_bias_time_pct"), share(F.abs(b) <= 10).alias("neutral_time_pct"),
    )
