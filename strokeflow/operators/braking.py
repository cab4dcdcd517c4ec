"""Braking analysis: how far and how roughly a fork dives under deceleration.

Samples get a wheel speed by interpolation, its smoothed derivative, and masks. Thresholds and
speed bins are per session. All metrics of every (threshold, bin) come from one expanded table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strokeflow.operators import asof, series, stats
from strokeflow.operators.series import in_order
from strokeflow.sources.scratch import stored

GROUP = ["session_id", "threshold_no", "speed_bin"]


@dataclass(frozen=True)
class BrakingConfig:
    speed_source: tuple[float, float] = (0.0, 200.0)
    valid_speed: tuple[float, float] = (5.0, 200.0)
    valid_accel: float = 15.0
    valid_stroke: tuple[float, float] = (-5.0, 105.0)
    coasting_accel: float = 0.5
    topout_pct: float = 5.0
    smooth: int = 5
    speed_scale: float = 1 / 3.6
    bin_mode: str = "percentile"
    bin_percentiles: tuple[float, ...] = (0.0, 25.0, 50.0, 75.0, 100.0)
    bin_edges: tuple[float, ...] = (0.0, 20.0, 35.0, 50.0, 120.0)
    threshold_mode: str = "percentile"
    decel_percentiles: tuple[float, ...] = (40.0, 60.0, 80.0)
    decel_values: tuple[float, ...] = (2.0, 3.0, 4.0, 5.0)
    selected: tuple[str, str] = ("percentile", "P80")
    gap_samples: int = 1
    min_samples_in_event: int = 1
    min_samples: int = 20
    min_events: int = 3
    limits: dict[str, tuple[float, float]] = field(default_factory=lambda: {
        "topout": (10.0, 25.0), "dive": (5.0, 15.0), "packdown": (2.0, 5.0), "deep80": (2.0, 6.0), "deep90": (0.5, 1.5),
        "margin": (15.0, 5.0), "rough": (1.5, 2.0),
    })


def prepare(samples: DataFrame, pulses: DataFrame, cfg: BrakingConfig) -> DataFrame:
    """Add speed, smooth_speed, decel, valid, topout and coasting.

    ``samples`` has session_id, t_us, seq, t, dt, stroke and velocity; ``pulses`` session_id, t, speed.
    """
    lo, hi = cfg.speed_source
    df = asof.interpolate_join(samples, pulses.where(F.col("speed").between(lo, hi)), "t", "speed", "speed")
    df = df.withColumn("smooth_speed", series.moving_average_known(F.col("speed"), cfg.smooth))
    df = df.withColumn("__mps", F.col("smooth_speed") * cfg.speed_scale)
    df = series.gradient_in_runs(df, "__mps", "t", "accel").drop("__mps")
    accel, stroke = F.col("accel"), F.col("stroke")
    valid = (
        (F.col("dt") > 0) & F.col("speed").between(*cfg.valid_speed) & F.col("smooth_speed").isNotNull()
        & (F.abs(accel) <= cfg.valid_accel) & stroke.between(*cfg.valid_stroke)
    )
    topout = F.coalesce(stroke <= cfg.topout_pct, F.lit(False))
    df = df.withColumns({"decel": -accel + 0.0, "valid": F.coalesce(valid, F.lit(False)), "topout": topout})
    df = df.withColumn("coasting", F.col("valid") & (F.abs(accel) <= cfg.coasting_accel) & ~F.col("topout"))
    return df.withColumn("i", F.row_number().over(in_order()))


def increasing(values: Column) -> Column:
    """An array made strictly increasing: each value at least a hair above the one before."""
    return F.aggregate(
        values, F.array().cast("array<double>"),
        lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(F.greatest(x, F.element_at(acc, -1) + 1e-6)))),
    )


def session_scalars(df: DataFrame, cfg: BrakingConfig) -> DataFrame:
    """(session_id, edges, limits): speed-bin edges and thresholds, in one grouping.

    Only sessions with valid samples have a row; ``limits`` is empty where no valid sample brakes.
    """
    brakes = F.col("decel") > 0

    def at(percents: tuple[float, ...]) -> Column:
        return F.array(*[F.lit(p / 100) for p in percents])

    aggs, labelled = [F.count_if(brakes).alias("n")], []
    if cfg.bin_mode == "absolute":
        edges = F.array(*[F.lit(float(e)) for e in cfg.bin_edges])
    else:
        aggs.append(F.percentile("speed", at(cfg.bin_percentiles)).alias("edges"))
        edges = F.col("edges")

    def limit(number: int, kind: str, label: Column, value: Column) -> Column:
        return F.struct(F.lit(number).alias("threshold_no"), F.lit(kind).alias("threshold_type"), label.alias("threshold_label"),
                        value.alias("decel_threshold"))

    if cfg.threshold_mode in ("percentile", "both"):
        aggs.append(F.percentile(F.when(brakes, F.col("decel")), at(cfg.decel_percentiles)).alias("q"))
        labelled += [limit(i, "percentile", F.lit(f"P{p:g}"), F.col("q")[i]) for i, p in enumerate(cfg.decel_percentiles)]
    if cfg.threshold_mode in ("absolute", "both"):
        labelled += [limit(100 + i, "absolute", F.lit(f"{v:.2f} ms2"), F.lit(float(v))) for i, v in enumerate(cfg.decel_values)]
    limits = F.filter(F.array(*labelled), lambda x: F.col("n") > 0)
    return df.where("valid").groupBy("session_id").agg(*aggs).select("session_id", increasing(edges).alias("edges"), limits.alias("limits"))


def speed_edges(df: DataFrame, cfg: BrakingConfig) -> DataFrame:
    """(session_id, edges) of the sessions with valid samples."""
    return session_scalars(df, cfg).select("session_id", "edges")


def bin_of(value: Column, edges: Column) -> Column:
    """Bin from 1: open on the right inside, the last bin closed, null outside."""
    n = F.size(edges) - 1
    inside = (value >= edges[0]) & (value <= F.element_at(edges, -1))
    return F.when(inside, F.least(F.size(F.filter(edges, lambda e: e <= value)), n))


def thresholds(df: DataFrame, cfg: BrakingConfig) -> DataFrame:
    """(session_id, threshold_no, threshold_type, threshold_label, decel_threshold) of sessions that brake."""
    return session_scalars(df, cfg).select("session_id", F.inline("limits"))


def expand(df: DataFrame, cfg: BrakingConfig) -> DataFrame:
    """Valid samples at each threshold of their session, with their speed bin and masks.

    Edges and thresholds are one row a session, so one join on session_id brings both.
    """
    binned = df.where("valid").join(session_scalars(df, cfg), "session_id")
    binned = binned.withColumn("speed_bin", bin_of(F.col("speed"), F.col("edges"))).where("speed_bin is not null").drop("edges")
    out = binned.select("*", F.inline("limits")).drop("limits")
    braking = F.col("decel") >= F.col("decel_threshold")
    return out.withColumns({"braking": braking, "loaded": braking & ~F.col("topout")})


def events(expanded: DataFrame, df: DataFrame, cfg: BrakingConfig) -> DataFrame:
    """Braking events of each (session, threshold, bin) with their measures, numbered in each session.

    Runs are found among the braking rows alone: a gap of up to ``gap_samples`` samples does not end
    an event. The samples of an event, gaps included, come back by an equi-join on their number.
    """
    w = W.partitionBy(*GROUP).orderBy("i")
    hits = expanded.where("braking").select(*GROUP, "threshold_label", "i")
    hits = hits.withColumn("__new", F.coalesce((F.col("i") - F.lag("i").over(w) > cfg.gap_samples + 1).cast("int"), F.lit(0)))
    hits = hits.withColumn("run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    spans = hits.groupBy(*GROUP, "threshold_label", "run").agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"))
    spans = spans.where(F.col("last_i") - F.col("first_i") + 1 >= cfg.min_samples_in_event)
    key = [*GROUP, "run"]
    inside = spans.withColumn("i", F.explode(F.sequence("first_i", "last_i"))).join(
        df.select("session_id", "i", "seq", "t", "dt", "speed", "decel", "stroke", "velocity", "topout"), ["session_id", "i"]
    )
    loaded = ~F.col("topout") & F.col("stroke").isNotNull()
    inside = inside.withColumn("stroke_loaded", F.when(loaded, F.col("stroke")))
    n, rn = F.count("stroke_loaded").over(W.partitionBy(*key)), F.sum(loaded.cast("int")).over(W.partitionBy(*key).orderBy("i"))
    third = F.greatest(F.floor(n / 3), F.lit(1))
    inside = inside.withColumns({
        "__first": F.when(loaded & (n >= 6) & (rn <= third), F.col("stroke")),
        "__last": F.when(loaded & (n >= 6) & (rn > n - third), F.col("stroke")),
    })
    # Running weights in order of stroke, so that the quantiles come from the grouping of the other measures.
    weight = F.when(loaded & (F.col("dt") > 0), F.col("dt"))
    by_stroke = W.partitionBy(*key).orderBy(F.col("stroke_loaded").asc_nulls_last(), "seq")
    inside = inside.withColumns({
        "__known": weight.isNotNull(), "__cum": F.sum(weight).over(by_stroke.rowsBetween(W.unboundedPreceding, 0)),
        "__total": F.sum(weight).over(W.partitionBy(*key)),
    })

    def reached(q: float) -> Column:
        return F.min(F.when(F.col("__known") & (F.col("__cum") >= q * F.col("__total")), F.col("stroke_loaded")))

    dt, v = F.col("dt"), F.when(loaded, F.col("velocity"))
    half = F.lit(0.5)
    out = inside.groupBy(*key, "threshold_label", "first_i", "last_i").agg(
        F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.sum("dt").alias("duration"),
        F.min_by("speed", "i").alias("entry_speed"), F.max_by("speed", "i").alias("exit_speed"), F.max("decel").alias("peak_decel"),
        F.avg("decel").alias("mean_decel"), stats.share_where(F.col("topout"), dt).alias("topout_pct"),
        F.max("stroke_loaded").alias("max_stroke"), stats.weighted_rms(v, dt).alias("rms_velocity"),
        (F.percentile("__last", half) - F.percentile("__first", half)).alias("pack_down"),
        reached(0.5).alias("median_stroke"), reached(0.95).alias("p95_stroke"),
    )
    number = F.row_number().over(W.partitionBy("session_id").orderBy("threshold_no", "speed_bin", "first_i"))
    return out.withColumn("event_no", number).drop("run")


def metric_rows(expanded: DataFrame, found: DataFrame, cfg: BrakingConfig) -> DataFrame:
    """One row for each (session, threshold, bin): loaded braking against coasting at the same speed."""
    dt, stroke, v = F.col("dt"), F.col("stroke"), F.col("velocity")
    loaded, coast, braking = F.col("loaded"), F.col("coasting"), F.col("braking")
    lw, cw = F.when(loaded, dt), F.when(coast, dt)

    def deep(limit: float) -> Column:
        return F.try_divide(100.0 * F.sum(F.when(stroke >= limit, lw).otherwise(0.0)), F.nullif(F.sum(lw), F.lit(0.0)))

    wide = expanded.groupBy(*GROUP, "threshold_type", "threshold_label", "decel_threshold").agg(
        F.count_if(braking).alias("n"), F.count_if(loaded).alias("n_loaded"), F.count_if(coast).alias("n_coasting"),
        F.sum(F.when(braking, dt).otherwise(0.0)).alias("time"), F.coalesce(F.sum(lw), F.lit(0.0)).alias("loaded_time"),
        F.coalesce(F.sum(cw), F.lit(0.0)).alias("coasting_time"),
        F.try_divide(100.0 * F.sum(F.when(braking & F.col("topout"), dt).otherwise(0.0)), F.nullif(F.sum(F.when(braking, dt)), F.lit(0.0))).alias("topout_pct"),
        *[deep(x).alias(f"deep{x}_pct") for x in (70, 80, 90, 95)],
        stats.weighted_rms(F.when(loaded, v), lw).alias("rms_braking"), stats.weighted_rms(F.when(coast, v), cw).alias("rms_coasting"),
    )

    def at(prefix: str, *percents: int) -> dict[str, float]:
        return {f"{prefix}_p{p}": p / 100 for p in percents}

    quantiles = stats.weighted_quantiles_of(expanded, {
        "loaded": (loaded, stroke, at("loaded", 50, 75, 90, 95, 99)), "coasting": (coast, stroke, at("coasting", 50, 75, 90)),
        "compression": (loaded & (v > 0), v, at("compression", 95)), "rebound": (loaded & (v < 0), F.abs(v), at("rebound", 95)),
    }, "dt", GROUP, ["seq"])
    out = wide.join(quantiles, GROUP, "left")
    per_event = found.groupBy(*GROUP).agg(
        F.count("*").alias("events"), *[F.percentile(c, F.lit(p)).alias(n) for n, c, p in (
            ("pack_down_p50", "pack_down", 0.5), ("pack_down_p75", "pack_down", 0.75), ("event_max_p50", "max_stroke", 0.5),
            ("event_max_p90", "max_stroke", 0.9), ("event_p95_p50", "p95_stroke", 0.5))],
    )
    out = out.join(per_event, GROUP, "left").withColumn("events", F.coalesce("events", F.lit(0)))
    ratio = F.when(F.abs(F.col("rms_coasting")) >= 1e-12, F.col("rms_braking") / F.col("rms_coasting"))
    out = out.withColumns({
        "dive_pct": F.col("loaded_p50") - F.col("coasting_p50"), "p75_offset_pct": F.col("loaded_p75") - F.col("coasting_p75"),
        "p90_offset_pct": F.col("loaded_p90") - F.col("coasting_p90"), "bottom_margin_pct": 100.0 - F.col("loaded_p99"), "rough_ratio": ratio,
    })
    return out.withColumn("warning", _texts("; ", [
        (F.col("n") < cfg.min_samples, "low total samples"), (F.col("n_loaded") < cfg.min_samples, "low loaded samples"),
        (F.col("n_coasting") < cfg.min_samples, "low coasting baseline"), (F.col("events") < cfg.min_events, "low event count"),
        (F.col("topout_pct") >= cfg.limits["topout"][1], "high topout contamination"),
    ]))


def _texts(sep: str, parts: list[tuple[Column, str]], default: str = "") -> Column:
    joined = F.concat_ws(sep, *[F.when(c, F.lit(t)) for c, t in parts])
    return F.when(joined == "", F.lit(default)).otherwise(joined)


def grade(value: Column, watch: float, high: float) -> Column:
    """OK, WATCH or HIGH, NO DATA for null; a ``high`` below ``watch`` makes low values the bad ones."""
    worse = (lambda x: value >= x) if high >= watch else (lambda x: value <= x)
    return F.when(value.isNull(), "NO DATA").when(worse(high), "HIGH").when(worse(watch), "WATCH").otherwise("OK")


def grade_dive(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNull(), "NO DATA").when(value < low, "LOW").when(value > high, "HIGH").otherwise("MODERATE")


def grade_packdown(value: Column, caution: float, high: float) -> Column:
    return F.when(value.isNull(), "NO DATA").when(value >= high, "WATCH").when(value >= caution, "INFO").otherwise("OK")


def select_rows(rows: DataFrame, cfg: BrakingConfig) -> DataFrame:
    """Rows of the chosen threshold; in sessions without it, those of the highest one of its type, else of any."""
    kind, label = cfg.selected
    chosen = (F.col("threshold_type") == kind) & (F.col("threshold_label") == label)
    rank = F.struct(chosen.cast("int"), (F.col("threshold_type") == kind).cast("int"), "decel_threshold", -F.col("threshold_no"))
    best = rows.groupBy("session_id").agg(F.max_by("threshold_no", rank).alias("threshold_no"))
    return rows.join(best, ["session_id", "threshold_no"])


def bin_flag(cfg: BrakingConfig) -> Column:
    """What is worth a look in a metric row, else "baseline"; the texts are fixed values."""
    c, lim = F.col, cfg.limits
    topout, rough = lim["topout"], lim["rough"]
    return _texts(", ", [
        (c("events") < cfg.min_events, "few events"), (c("topout_pct") >= topout[1], "topout high"),
        ((c("topout_pct") >= topout[0]) & (c("topout_pct") < topout[1]), "topout watch"), (c("dive_pct") >= lim["dive"][1], "dive high"),
        (c("deep90_pct") >= lim["deep90"][0], "near-bottom"),
        (~F.coalesce(c("deep90_pct") >= lim["deep90"][0], F.lit(False)) & (c("deep80_pct") >= lim["deep80"][0]), "deep stroke"),
        (c("bottom_margin_pct") <= lim["margin"][1], "low margin"), (c("rough_ratio") >= rough[1], "rough high"),
        ((c("rough_ratio") >= rough[0]) & (c("rough_ratio") < rough[1]), "rough watch"),
        (c("pack_down_p75") >= lim["packdown"][1], "packdown watch"),
    ], "baseline")


def roll_up(selected: DataFrame) -> DataFrame:
    """One row for each session, weighted by loaded time, or by loaded samples where there is no time."""
    total = F.sum("loaded_time").over(W.partitionBy("session_id"))
    rows = selected.withColumn("__w", F.when(total > 0, F.col("loaded_time")).otherwise(F.col("n_loaded").cast("double")))
    w = F.col("__w")
    means = {
        "topout_mean": "topout_pct", "loaded_median": "loaded_p50", "loaded_p90": "loaded_p90", "loaded_p95": "loaded_p95",
        "dive_mean": "dive_pct", "deep80_mean": "deep80_pct", "deep90_mean": "deep90_pct", "rough_mean": "rough_ratio",
        "rms_braking_mean": "rms_braking",
    }
    return rows.groupBy("session_id").agg(
        F.sum("loaded_time").alias("loaded_time"), F.sum("events").alias("events"), F.max("topout_pct").alias("topout_max"),
        F.min("bottom_margin_pct").alias("margin_min"), F.max("rough_ratio").alias("rough_max"),
        *[stats.weighted_mean(F.col(c), w).alias(n) for n, c in means.items()],
    )


EVENT_MEASURES = ["duration", "entry_speed", "peak_decel", "max_stroke", "p95_stroke", "topout_pct", "rms_velocity", "pack_down"]


def event_summary(found: DataFrame) -> DataFrame:
    """(session_id, events) with median and 90 % point of eight measures, and 75 % of pack-down."""
    aggs = [F.percentile(c, F.lit(p)).alias(f"{c}_{n}") for c in EVENT_MEASURES for n, p in (("p50", 0.5), ("p90", 0.9))]
    return found.groupBy("session_id").agg(F.count("*").alias("events"), F.percentile("pack_down", F.lit(0.75)).alias("pack_down_p75"), *aggs)


def flag_rows(summary: DataFrame, cfg: BrakingConfig) -> DataFrame:
    """(session_id, level, topic) of the warnings of each session; INFO Baseline where there are none. Levels and topics are fixed values.

    ``summary`` joins :func:`roll_up` and ``pack_down_p75`` of :func:`event_summary`.
    """
    c, lim = F.col, cfg.limits

    def pick(*cases: tuple[Column, str, str]) -> Column:
        out = F.lit(None)
        for cond, level, topic in reversed(cases):
            out = F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(topic).alias("topic"))).otherwise(out)
        return out

    flags = F.array_compact(F.array(
        pick((c("events") < cfg.min_events, "HIGH", "Low event count")),
        pick((c("topout_max") >= lim["topout"][1], "HIGH", "Topout contamination"), (c("topout_max") >= lim["topout"][0], "WATCH", "Topout contamination")),
        pick((c("dive_mean") >= lim["dive"][1], "WATCH", "Brake dive"), (c("dive_mean") < lim["dive"][0], "INFO", "Low brake dive")),
        pick((c("deep90_mean") >= lim["deep90"][0], "HIGH", "Near-bottom use"), (c("deep80_mean") >= lim["deep80"][0], "WATCH", "Deep stroke use")),
        pick((c("rough_max") >= lim["rough"][1], "HIGH", "Rough braking"), (c("rough_max") >= lim["rough"][0], "WATCH", "Rough braking")),
        pick((c("pack_down_p75") >= lim["packdown"][1], "WATCH", "Pack-down"), (c("pack_down_p75") >= lim["packdown"][0], "INFO", "Mild pack-down")),
    ))
    none = F.array(F.struct(F.lit("INFO").alias("level"), F.lit("Baseline").alias("topic")))
    rows = summary.withColumn("f", F.when(F.size(flags) > 0, flags).otherwise(none))
    return rows.select("session_id", F.explode("f").alias("f")).select("session_id", "f.*")


def main_read(cfg: BrakingConfig) -> Column:
    """What a session's braking comes to, in words, from the columns of the report's ``summary``.

    The texts are fixed values.
    """
    c, lim = F.col, cfg.limits

    def told(known: Column, cases: list[tuple[Column, str]], rest: str | None) -> Column:
        text = F.lit(rest)
        for cond, words in reversed(cases):
            text = F.when(cond, words).otherwise(text)
        return F.when(known, text)

    deep, margin, dive, topout, rough, pack = (c(x) for x in ("deep90_mean", "margin_min", "dive_mean", "topout_max", "rough_max", "pack_down_p75"))
    parts = [
        told(deep.isNotNull() & margin.isNotNull(), [((deep < lim["deep90"][0]) & (margin > lim["margin"][0]), "good stroke reserve"), (margin <= lim["margin"][1], "small bottom margin")],
             "some deep stroke use"),
        told(dive.isNotNull(), [(dive < lim["dive"][0], "low brake dive"), (dive > lim["dive"][1], "high brake dive")], "moderate brake dive"),
        told(topout.isNotNull(), [(topout >= lim["topout"][1], "topout contamination high"), (topout >= lim["topout"][0], "some topout contamination")], "topout clean"),
        told(rough.isNotNull(), [(rough >= lim["rough"][1], "rough braking high"), (rough >= lim["rough"][0], "rough braking elevated")], "roughness controlled"),
        told(pack.isNotNull(), [(pack >= lim["packdown"][1], "some events pack down")], None),
    ]
    joined = F.concat_ws("; ", *parts)
    return F.when(joined == "", "not enough braking evidence").otherwise(joined)


def missing_reason(df: DataFrame, cfg: BrakingConfig) -> DataFrame:
    """(session_id, has_data, reason): why a session has no braking analysis."""
    speed, valid = F.count("speed"), F.count_if("valid")
    brake = F.count_if(F.col("valid") & (F.col("decel") > 0))
    reason = (
        F.when(speed < 2, "Wheel speed has fewer than two valid samples.")
        .when(valid == 0, "No valid samples after speed and stroke filtering.")
        .when(brake == 0, "No valid positive deceleration samples.")
    )
    return df.groupBy("session_id").agg(reason.alias("reason")).select("session_id", F.col("reason").isNull().alias("has_data"), "reason")


def braking_report(samples: DataFrame, pulses: DataFrame, cfg: BrakingConfig) -> dict[str, DataFrame]:
    """All tables of the braking analysis."""
    # What several tables read is written once.
    df = stored(prepare(samples, pulses, cfg), "braking")
    expanded = stored(expand(df, cfg), "braking-expanded")
    found = stored(events(expanded, df, cfg), "braking-events")
    rows = stored(metric_rows(expanded, found, cfg), "braking-rows")
    selected = select_rows(rows, cfg).withColumn("flag", bin_flag(cfg))
    chosen = found.join(selected.select("session_id", "threshold_no").distinct(), ["session_id", "threshold_no"])
    summary = roll_up(selected).join(event_summary(chosen).select("session_id", "pack_down_p75"), "session_id", "left").withColumn("main_read", main_read(cfg))
    return {
        "metric_rows": rows, "event_rows": found, "speed_bin_rows": selected, "summary": summary, "event_summary": event_summary(chosen),
        "flag_rows": flag_rows(summary, cfg), "status": missing_reason(df, cfg),
    }
