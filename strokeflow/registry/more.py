"""Queries of the smaller projections, filters, orders and of parts of the reports."""

from __future__ import annotations

from pyspark.sql import Window as W

from strokeflow.functions import config
from strokeflow.operators import braking, breakdown, catalog, metrics, series, stats
from strokeflow.plans import quicklook
from strokeflow.registry.base import F, SAMPLES_SQL, SQL, WEIGHTED_SQL, event_samples, query, rounded, table, weighted_samples
from strokeflow.registry.braking import BINS, CFG as BRAKE, EVENTS as BRAKE_EVENTS, ROWS, SELECTED, _events, _inputs
from strokeflow.registry.breakdown import CFG, CLASS, EVENTS, STATES, classified, kept
from strokeflow.registry.misc import _CAT, _catalog
from strokeflow.registry.stats import _CH, _channels, bin_sql, heatmaps
from strokeflow.sources import logs

_W = "OVER (PARTITION BY session_id ORDER BY t_us, seq)"
KEY = ["session_id", "seq"]


@query("b2_analog_projection", f"WITH {SAMPLES_SQL} SELECT session_id, seq, front AS front_raw, round(front / 4095, 9) AS front_norm, CAST(t_us - lag(t_us) {_W} AS DOUBLE) AS dt_us, round(front * 0.073260073, 6) AS front_mm FROM s")
def b2(spark, folder):
    df = event_samples(spark, folder)
    return df.select(*KEY, F.col("front").alias("front_raw"), F.round(F.col("front") / 4095, 9).alias("front_norm"), series.step("t_us").cast("double").alias("dt_us"),
                     F.round(F.col("front") * 0.073260073, 6).alias("front_mm"))


@query("b4_wheel_projection", f"""WITH {SAMPLES_SQL}, p AS (SELECT *, t_us - lag(t_us) {_W} AS interval_us FROM s WHERE code = 'click')
SELECT session_id, seq, round(CASE WHEN interval_us > 0 THEN 2.1 / (interval_us / 1e6) END * 3.6, 9) AS speed_kph, round(CASE WHEN interval_us > 0 THEN 2.1 / (interval_us / 1e6) END * 2.2369362920544, 9) AS speed_mph FROM p""")
def b4(spark, folder):
    df = event_samples(spark, folder).where("code = 'click'").withColumn("interval_us", series.step("t_us"))
    speed = F.when(F.col("interval_us") > 0, 2.1 / (F.col("interval_us") / 1e6))
    return rounded(df.select(*KEY, (speed * 3.6).alias("speed_kph"), (speed * 2.2369362920544).alias("speed_mph")), 9)


@query("b7_first_and_latest_config", f"WITH {SAMPLES_SQL} SELECT session_id, arg_min(front, seq) AS first_value, arg_max(front, seq) AS latest_value FROM s WHERE code = 'signup' GROUP BY session_id")
def b7(spark, folder):
    df = event_samples(spark, folder).where("code = 'signup'")
    return df.groupBy("session_id").agg(F.min_by("front", "seq").alias("first_value"), F.max_by("front", "seq").alias("latest_value"))


@query("b9_finite_pairs", f"WITH {SAMPLES_SQL}, p AS (SELECT session_id, seq, CASE WHEN front < 400 THEN front END AS x, CASE WHEN rear > 5 THEN rear END AS y FROM s) SELECT * FROM p WHERE x IS NOT NULL AND y IS NOT NULL")
def b9(spark, folder):
    df = event_samples(spark, folder)
    x, y = F.when(F.col("front") < 400, F.col("front")), F.when(F.col("rear") > 5, F.col("rear"))
    return df.select(*KEY, x.alias("x"), y.alias("y")).where("x is not null and y is not null")


@query("b11_state_selection", f"WITH {CLASS} SELECT session_id, seq FROM k WHERE band = 1 AND motion = 'braking' AND activity = 'active'")
def b11(spark, folder):
    return classified(spark, folder).where("band = 1 and motion = 'braking' and activity = 'active'").select(*KEY)


@query("b13_visible_metrics", f"SELECT session_id, channel, metric, units, value FROM ({SQL['e15_channel_metrics']}) WHERE visible AND category = 'riding'")
def b13(spark, folder):
    """The riding metrics that a comparison shows, of each channel."""
    found = metrics.channel_metrics(_channels(spark, folder)).where("visible and category = 'riding'")
    return rounded(found.select("session_id", "channel", "metric", "units", "value"), 4)


@query("b15_channel_view", f"""WITH {WEIGHTED_SQL}, {_CH} SELECT session_id, channel, seq, CASE WHEN channel = 'front' THEN round(travel * 0.1, 6) ELSE travel END AS travel,
  CASE WHEN channel = 'front' THEN 'mm' ELSE 'counts' END AS units FROM ch""")
def b15(spark, folder):
    """Millimetres where a channel has a scale, counts otherwise, with the units beside them."""
    scale = F.when(F.col("channel") == "front", 0.1)
    df = _channels(spark, folder)
    return df.select("session_id", "channel", "seq", F.coalesce(F.round(F.col("travel") * scale, 6), F.col("travel")).alias("travel"),
                     F.when(scale.isNotNull(), "mm").otherwise("counts").alias("units"))


@query("b17_topout_coasting", f"WITH {BINS} SELECT session_id, count(*) FILTER (topout) AS topout, count(*) FILTER (coasting) AS coasting, count(*) FILTER (valid AND NOT topout) AS loaded FROM pp GROUP BY session_id")
def b17(spark, folder):
    df = braking.prepare(*_inputs(spark, folder), BRAKE)
    return df.groupBy("session_id").agg(F.count_if("topout").alias("topout"), F.count_if("coasting").alias("coasting"), F.count_if(F.col("valid") & ~F.col("topout")).alias("loaded"))


@query("b18_missing_values", f"WITH {SAMPLES_SQL} SELECT session_id, count(CASE WHEN front < 100 THEN front END) AS known, max(CASE WHEN front < 100 THEN front END) AS most, sum(coalesce(CASE WHEN front < 100 THEN rear END, -1)) AS filled FROM s GROUP BY session_id")
def b18(spark, folder):
    nan = F.when(F.col("front") < 100, F.col("front")).otherwise(float("nan"))
    v = F.nanvl(nan, F.lit(None).cast("double"))
    df = event_samples(spark, folder).select("session_id", v.alias("v"), F.when(v.isNotNull(), F.col("rear")).alias("r"))
    return df.groupBy("session_id").agg(F.count("v").alias("known"), F.max("v").alias("most"), F.sum(F.coalesce("r", F.lit(-1.0))).alias("filled"))


@query("c2_median_step", f"WITH {WEIGHTED_SQL} SELECT session_id, round(median, 6) AS median FROM md")
def c2(spark, folder):
    df = event_samples(spark, folder).withColumn("step", series.step("t_h"))
    return rounded(df.groupBy("session_id").agg(F.percentile(F.when(F.col("step") > 0, F.col("step")), F.lit(0.5)).alias("median")))


@query("d6_catalog_join", f"WITH {_CAT} SELECT c.session_id, c.date, count(e.event_id) AS events FROM cat c LEFT JOIN events e ON e.user_id = c.session_id AND e.event_type = 'error' GROUP BY ALL")
def d6(spark, folder):
    errors = event_samples(spark, folder).where("code = 'error'").groupBy("session_id").agg(F.count("*").alias("events"))
    return _catalog(spark, folder).join(errors, "session_id", "left").select("session_id", "date", F.coalesce("events", F.lit(0)).alias("events"))


@query("d10_coasting_baseline", f"WITH {ROWS} SELECT session_id, threshold_label, speed_bin, round(loaded_p50, 4) AS loaded, round(coasting_p50, 4) AS coasting, round(dive_pct, 4) + 0.0 AS dive FROM m")
def d10(spark, folder):
    x, found = _events(spark, folder)
    rows = braking.metric_rows(x, found, BRAKE)
    return rounded(rows.select("session_id", "threshold_label", "speed_bin", F.col("loaded_p50").alias("loaded"), F.col("coasting_p50").alias("coasting"), F.col("dive_pct").alias("dive")), 4)


@query("d13_selection_comparison", f"""WITH {CLASS}, z AS (SELECT session_id, motion = 'braking' AS braking, sum(dt) AS duration, max(front_travel) AS deepest FROM k WHERE dt > 0 GROUP BY ALL)
SELECT session_id, metric, round(max(v) FILTER (braking), 4) AS selected, round(max(v) FILTER (NOT braking), 4) AS others FROM
  (SELECT session_id, braking, 'duration' AS metric, duration AS v FROM z UNION ALL SELECT session_id, braking, 'front_max_stroke', deepest FROM z) GROUP BY ALL""")
def d13(spark, folder):
    """Two selections of a session side by side, a row for each measure."""
    rows = kept(spark, folder).withColumn("side", F.when(F.col("motion") == "braking", "selected").otherwise("others"))
    both = breakdown.selection_summary(rows, ["session_id", "side"], CFG).select("session_id", "side", "duration", "front_max_stroke")
    long = both.unpivot(["session_id", "side"], ["duration", "front_max_stroke"], "metric", "v")
    return rounded(long.groupBy("session_id", "metric").pivot("side", ["selected", "others"]).agg(F.first("v")), 4)


@query("e10_context_heatmap", f"""WITH {WEIGHTED_SQL}, r AS (SELECT session_id, min(front) AS x0, max(front) AS x1, min(rear) AS y0, max(rear) AS y1 FROM d GROUP BY session_id),
c AS (SELECT session_id, {bin_sql('front', 'x0', 'x1', 10)} AS x_bin, {bin_sql('rear', 'y0', 'y1', 10)} AS y_bin, dt FROM d JOIN r USING (session_id))
SELECT session_id, 'rear' AS response, x_bin, y_bin, round(sum(dt), 6) AS time, count(*) AS samples FROM c GROUP BY ALL""")
def e10(spark, folder):
    return rounded(heatmaps(weighted_samples(spark, folder), "front", {"rear": "rear"}, "dt", 10))


@query("e17_time_at_the_ends", f"""WITH {WEIGHTED_SQL}, m AS (SELECT session_id, min(rear) AS lo, max(rear) AS hi FROM d GROUP BY session_id)
SELECT session_id, round(100.0 * sum(CASE WHEN rear <= lo + 0.1 * (hi - lo) THEN dt ELSE 0 END) / sum(dt), 6) AS bottom, round(100.0 * sum(CASE WHEN rear >= hi - 0.1 * (hi - lo) THEN dt ELSE 0 END) / sum(dt), 6) AS top
FROM d JOIN m USING (session_id) GROUP BY session_id""")
def e17(spark, folder):
    df = series.per_session(weighted_samples(spark, folder), [F.min("rear").alias("lo"), F.max("rear").alias("hi")])
    tenth, dt = 0.1 * (F.col("hi") - F.col("lo")), F.col("dt")
    return rounded(df.groupBy("session_id").agg(stats.share_where(F.col("rear") <= F.col("lo") + tenth, dt).alias("bottom"), stats.share_where(F.col("rear") >= F.col("hi") - tenth, dt).alias("top")))


@query("e27_event_statistics", f"""WITH {BRAKE_EVENTS} SELECT session_id, threshold_no, speed_bin, count(*) AS events, round(quantile_cont(max_stroke, 0.5), 4) AS max_p50, round(quantile_cont(max_stroke, 0.9), 4) AS max_p90,
  round(quantile_cont(p95_stroke, 0.5), 4) AS p95_p50 FROM ev GROUP BY ALL""")
def e27(spark, folder):
    found = _events(spark, folder)[1]
    q = lambda c, p: F.percentile(c, F.lit(p))
    return rounded(found.groupBy(*braking.GROUP).agg(F.count("*").alias("events"), q("max_stroke", 0.5).alias("max_p50"), q("max_stroke", 0.9).alias("max_p90"), q("p95_stroke", 0.5).alias("p95_p50")), 4)


@query("e31_quicklook", f"""WITH {WEIGHTED_SQL}, {_CH}, n AS (SELECT *, position >= 95 AS full_, position >= 95 AND NOT coalesce(lag(position >= 95) OVER (PARTITION BY session_id, channel ORDER BY t_us, seq), false) AS rise FROM ch),
a AS (SELECT session_id, channel, round(sum(dt), 6) AS duration, max(travel) - min(travel) AS used_stroke, round(100.0 * sum(CASE WHEN full_ THEN dt ELSE 0 END) / sum(dt), 6) AS near_full_pct, count(*) FILTER (rise) AS near_full_runs FROM n GROUP BY ALL),
b AS (SELECT session_id, count(*) FILTER (code = 'error') AS faults, bool_or(code = 'purchase') AS clean_close FROM s GROUP BY session_id) SELECT * FROM a JOIN b USING (session_id)""")
def e31(spark, folder):
    status = event_samples(spark, folder).select("session_id", F.when(F.col("code") == "purchase", "CLEAN_CLOSE").when(F.col("code") == "error", "SD_ERROR").otherwise("BOOT").alias("name"))
    return rounded(quicklook.quicklook(_channels(spark, folder), status))


@query("f9_sequential_ids", f"WITH {SAMPLES_SQL} SELECT session_id, seq, printf('E%03d', row_number() {_W}) AS event_id FROM s WHERE code = 'error'")
def f9(spark, folder):
    df = event_samples(spark, folder).where("code = 'error'")
    return df.select(*KEY, F.format_string("E%03d", F.row_number().over(series.in_order())).alias("event_id"))


@query("g1_timeline_order", f"WITH {SAMPLES_SQL} SELECT session_id, seq, code, row_number() OVER (PARTITION BY session_id ORDER BY t_us, seq, code)::INTEGER AS place FROM s")
def g1(spark, folder):
    w = W.partitionBy("session_id").orderBy("t_us", "seq", "code")
    return event_samples(spark, folder).select(*KEY, "code", F.row_number().over(w).alias("place"))


@query("g4_event_order", f"WITH {EVENTS} SELECT session_id, event_type, event_id, round(start_t, 4) AS start_t FROM ev")
def g4(spark, folder):
    return rounded(breakdown.detect_events(kept(spark, folder), CFG).select("session_id", "event_type", "event_id", "start_t"), 4)


@query("g5_state_order", f"WITH {STATES} SELECT session_id, state_id, band, motion, activity FROM stt")
def g5(spark, folder):
    return breakdown.state_table(kept(spark, folder), CFG).select("session_id", "state_id", "band", "motion", "activity")


@query("g6_first_ten_sessions", f"WITH {SAMPLES_SQL}, i AS (SELECT session_id, row_number() OVER (ORDER BY session_id) AS k FROM (SELECT DISTINCT session_id FROM s)) SELECT session_id, count(*) AS rows FROM s JOIN i USING (session_id) WHERE k <= 10 GROUP BY session_id")
def g6(spark, folder):
    df = event_samples(spark, folder)
    ten = df.select("session_id").distinct().orderBy("session_id").limit(10)
    return df.join(F.broadcast(ten), "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("rows"))


@query("j2_motion_states", f"WITH {CLASS} SELECT session_id, motion, count(*) AS n, round(sum(dt), 4) AS time FROM k GROUP BY ALL")
def j2(spark, folder):
    return rounded(classified(spark, folder).groupBy("session_id", "motion").agg(F.count("*").alias("n"), F.sum("dt").alias("time")), 4)


@query("j3_activity_score", f"WITH {CLASS} SELECT session_id, seq, round(score, 4) AS score, round(density, 4) AS density FROM k")
def j3(spark, folder):
    return rounded(classified(spark, folder).select(*KEY, "score", "density"), 4)


@query("j4_repeated_hits", f"WITH {CLASS} SELECT session_id, count(*) FILTER (repeated) AS repeated, count(*) FILTER (impact) AS impacts, round(max(impact_threshold), 4) AS threshold FROM k GROUP BY session_id")
def j4(spark, folder):
    df = classified(spark, folder)
    return rounded(df.groupBy("session_id").agg(F.count_if("repeated").alias("repeated"), F.count_if("impact").alias("impacts"), F.max("impact_threshold").alias("threshold")), 4)


@query("j6_activity_states", f"WITH {CLASS} SELECT activity, count(*) AS n FROM k GROUP BY activity")
def j6(spark, folder):
    return classified(spark, folder).groupBy("activity").agg(F.count("*").alias("n"))


@query("j9_pack_down_mask", f"WITH {EVENTS} SELECT session_id, seq, coalesce(pack_front, false) AS pack_front, coalesce(pack_rear, false) AS pack_rear FROM ki")
def j9(spark, folder):
    df = kept(spark, folder)
    df = breakdown.pack_down(df, {c: f"pack_{c}" for c in breakdown.CHANNELS}, CFG)
    return df.select(*KEY, *[F.coalesce(f"pack_{c}", F.lit(False)).alias(f"pack_{c}") for c in ("front", "rear")])


@query("s3_speed_bin_ids", f"WITH {BINS}, z AS (SELECT session_id, seq, speed, edges FROM pp JOIN ed USING (session_id)) SELECT session_id, seq, CASE WHEN speed >= edges[1] AND speed <= edges[5] THEN least(len(list_filter(edges, lambda e: e <= speed)), 4) END::DOUBLE AS bin FROM z")
def s3(spark, folder):
    df = braking.prepare(*_inputs(spark, folder), BRAKE)
    return df.join(braking.speed_edges(df, BRAKE), "session_id").select(*KEY, braking.bin_of(F.col("speed"), F.col("edges")).cast("double").alias("bin"))


@query("s7_text_flags", f"""WITH {SELECTED}, mr AS (SELECT session_id, concat_ws('; ',
  CASE WHEN deep90_mean IS NOT NULL AND margin_min IS NOT NULL THEN CASE WHEN deep90_mean < 0.5 AND margin_min > 15 THEN 'good stroke reserve' WHEN margin_min <= 5 THEN 'small bottom margin' ELSE 'some deep stroke use' END END,
  CASE WHEN dive_mean < 5 THEN 'low brake dive' WHEN dive_mean > 15 THEN 'high brake dive' WHEN dive_mean IS NOT NULL THEN 'moderate brake dive' END,
  CASE WHEN topout_max >= 25 THEN 'topout contamination high' WHEN topout_max >= 10 THEN 'some topout contamination' WHEN topout_max IS NOT NULL THEN 'topout clean' END,
  CASE WHEN rough_max >= 2 THEN 'rough braking high' WHEN rough_max >= 1.5 THEN 'rough braking elevated' WHEN rough_max IS NOT NULL THEN 'roughness controlled' END,
  CASE WHEN es.pack_down_p75 >= 5 THEN 'some events pack down' END) AS t FROM ru LEFT JOIN es USING (session_id))
SELECT session_id, speed_bin, warning, CASE WHEN fl = '' THEN 'baseline' ELSE fl END AS flag, CASE WHEN t = '' THEN 'not enough braking evidence' ELSE t END AS main_read FROM sel JOIN mr USING (session_id)""")
def s7(spark, folder):
    report = braking.braking_report(*_inputs(spark, folder), BRAKE)
    return report["speed_bin_rows"].select("session_id", "speed_bin", "warning", "flag").join(report["summary"].select("session_id", "main_read"), "session_id")


@query("s8_state_flags", f"WITH {STATES}, f AS (SELECT session_id, unnest(flags) AS flag FROM stt) SELECT session_id, flag, count(*) AS n FROM f GROUP BY ALL")
def s8(spark, folder):
    rows = breakdown.state_table(kept(spark, folder), CFG).select("session_id", F.explode("flags").alias("flag"))
    return rows.groupBy("session_id", "flag").agg(F.count("*").alias("n"))


@query("s11_utc_date", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events")
def s11(spark, folder):
    e = table(spark, folder, "events")
    epoch = F.when(F.col("event_id") % 9 == 0, 0).otherwise(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    return e.select("event_id", catalog.utc_date(epoch).alias("day"))


@query("s15_safe_division", "SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(l_discount) >= 1e-12 THEN l_tax / l_discount END, 6) AS ratio FROM lineitem")
def s15(spark, folder):
    return rounded(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", config.safe_divide(F.col("l_tax"), F.col("l_discount")).alias("ratio")))


@query("s16_vector_magnitude", f"WITH {SAMPLES_SQL} SELECT session_id, seq, round(sqrt(front * front + rear * rear), 6) AS size FROM s")
def s16(spark, folder):
    return rounded(event_samples(spark, folder).select(*KEY, F.sqrt(F.col("front") ** 2 + F.col("rear") ** 2).alias("size")))


_CODES, _REASONS = (" ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) for names in (logs.STATUS_NAMES, logs.STOP_REASONS))


@query("b5_status_projection", f"""WITH {SAMPLES_SQL}, p AS (SELECT session_id, seq, CAST(rear AS INTEGER) % 20 AS code, CAST(front AS INTEGER) % 4 AS value1 FROM s)
SELECT session_id, seq, code, value1, CASE code {_CODES} ELSE 'UNKNOWN_' || code END AS name,
  CASE WHEN code = 9 THEN CASE value1 {_REASONS} ELSE 'UNKNOWN_' || value1 END END AS stop_reason FROM p""")
def b5(spark, folder):
    code, value = F.col("code"), F.col("value1")
    df = event_samples(spark, folder).select(*KEY, (F.col("rear").cast("int") % 20).alias("code"), (F.bround("front").cast("int") % 4).alias("value1"))
    return df.withColumns({"name": logs.status_name(code), "stop_reason": logs.stop_reason(code, value)})


@query("s14_unit_factors", f"""WITH {SAMPLES_SQL} SELECT session_id, seq, round(t_us / 1e6, 6) AS t_s, round(front * 3.6, 9) AS kph, round(front * 2.2369362920544, 9) AS mph,
  round(rear / 4095, 9) AS norm, round(rear * (300.0 / 4095), 9) AS mm FROM s""")
def s14(spark, folder):
    scale = config.mm_per_count(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(config.FRONT_FULL_SCALE_MM), F.lit(12.0))
    speed, raw = F.col("front"), F.col("rear")
    df = event_samples(spark, folder).select(*KEY, F.round(F.col("t_us") / 1e6, 6).alias("t_s"), (speed * 3.6).alias("kph"), (speed * 2.2369362920544).alias("mph"),
                                             (raw / 4095).alias("norm"), (raw * scale).alias("mm"))
    return rounded(df, 9)
