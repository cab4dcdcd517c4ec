"""Queries of the braking analysis, on events as samples and clicks as wheel pulses."""

from __future__ import annotations

from strokeflow.operators import braking as b
from strokeflow.operators import series
from strokeflow.registry.base import F, WEIGHTED_SQL, query, rounded, weighted_samples
from strokeflow.registry.series import _gradient_sql, _P, _padded_sql
from strokeflow.sources.scratch import stored

CFG = b.BrakingConfig(
    speed_source=(0.0, 1000.0), valid_speed=(5.0, 450.0), valid_accel=1000.0, valid_stroke=(0.0, 100.0), coasting_accel=2.0,
    smooth=3, speed_scale=1.0, threshold_mode="both", decel_values=(0.5, 2.0), min_samples=3, min_events=2,
)


def _inputs(spark, folder):
    df = weighted_samples(spark, folder)
    samples = df.select("session_id", "t_us", "seq", F.col("t_h").alias("t"), "dt", F.col("rear").alias("stroke"),
                        (F.col("rear") - F.lag("rear").over(series.in_order())).alias("velocity"))
    return samples, df.where("code = 'click'").select("session_id", F.col("t_h").alias("t"), F.col("front").alias("speed"))


_W = "OVER (PARTITION BY session_id ORDER BY t_us, seq)"
_W2 = "OVER (PARTITION BY session_id, run ORDER BY t_us, seq)"
PREP = WEIGHTED_SQL + f""",
q AS (SELECT session_id, t_h, avg(front) AS v FROM s WHERE code = 'click' GROUP BY session_id, t_h),
nq AS (SELECT session_id, count(*) AS n FROM q GROUP BY session_id),
v0 AS (SELECT session_id, t_us, seq, t_h, dt, rear AS stroke, rear - lag(rear) {_W} AS velocity FROM d),
xa AS (SELECT v0.*, a.t_h AS ta, a.v AS va FROM v0 ASOF LEFT JOIN q a ON v0.session_id = a.session_id AND v0.t_h >= a.t_h),
xb AS (SELECT xa.*, b.t_h AS tb, b.v AS vb FROM xa ASOF LEFT JOIN q b ON xa.session_id = b.session_id AND xa.t_h <= b.t_h),
sp AS (SELECT xb.*, CASE WHEN n >= 2 AND ta IS NOT NULL AND tb IS NOT NULL THEN CASE WHEN tb > ta THEN va + (vb - va) * (xb.t_h - ta) / (tb - ta) ELSE va END END AS speed
  FROM xb LEFT JOIN nq USING (session_id)),
sm AS (SELECT *, {_padded_sql('coalesce(speed, 0)', 1)} / nullif({_padded_sql('CASE WHEN speed IS NULL THEN 0 ELSE 1 END', 1)}, 0) AS v FROM sp {_P}),
g0 AS (SELECT *, CASE WHEN (v IS NULL) <> lag(v IS NULL) {_W} THEN 1 ELSE 0 END AS edge FROM sm),
g1 AS (SELECT *, sum(edge) {_W} AS run FROM g0),
g2 AS (SELECT *, CASE WHEN v IS NOT NULL AND count(*) OVER (PARTITION BY session_id, run) >= 3 THEN {_gradient_sql('v', _W2)} END AS accel FROM g1),
p AS (SELECT session_id, t_us, seq, t_h AS t, dt, stroke, velocity, speed, v AS smooth_speed, -accel + 0.0 AS decel, stroke <= 5 AS topout,
  coalesce(dt > 0 AND speed BETWEEN 5 AND 450 AND v IS NOT NULL AND abs(accel) <= 1000 AND stroke BETWEEN 0 AND 100, false) AS valid,
  row_number() {_W} AS i FROM g2),
pp AS (SELECT *, valid AND abs(decel) <= 2 AND NOT topout AS coasting FROM p)"""
BINS = PREP + """,
eq AS (SELECT session_id, quantile_cont(speed, [0, 0.25, 0.5, 0.75, 1]) AS q FROM pp WHERE valid GROUP BY session_id),
e1 AS (SELECT session_id, q[1] AS a, greatest(q[2], q[1] + 1e-6) AS b, q FROM eq), e2 AS (SELECT *, greatest(q[3], b + 1e-6) AS c FROM e1),
e3 AS (SELECT *, greatest(q[4], c + 1e-6) AS dd FROM e2), ed AS (SELECT session_id, [a, b, c, dd, greatest(q[5], dd + 1e-6)] AS edges FROM e3)"""
THRESH = """,
th0 AS (SELECT session_id, quantile_cont(decel, [0.4, 0.6, 0.8]) AS q FROM pp WHERE valid AND decel > 0 GROUP BY session_id),
th AS (SELECT session_id, 0 AS threshold_no, 'percentile' AS threshold_type, 'P40' AS threshold_label, q[1] AS decel_threshold FROM th0
  UNION ALL SELECT session_id, 1, 'percentile', 'P60', q[2] FROM th0 UNION ALL SELECT session_id, 2, 'percentile', 'P80', q[3] FROM th0
  UNION ALL SELECT session_id, 100, 'absolute', '0.50 ms2', 0.5 FROM th0 UNION ALL SELECT session_id, 101, 'absolute', '2.00 ms2', 2.0 FROM th0)"""
EXPAND = BINS + THRESH + """,
bn AS (SELECT pp.*, CASE WHEN speed >= edges[1] AND speed <= edges[5] THEN least(len(list_filter(edges, lambda e: e <= speed)), 4) END AS speed_bin
  FROM pp JOIN ed USING (session_id) WHERE valid),
x AS (SELECT bn.*, threshold_no, threshold_type, threshold_label, decel_threshold, decel >= decel_threshold AS braking,
  decel >= decel_threshold AND NOT topout AS loaded FROM bn JOIN th USING (session_id) WHERE speed_bin IS NOT NULL)"""


@query("b16_valid_braking", f"""WITH {PREP} SELECT session_id, seq, round(speed, 5) AS speed, round(smooth_speed, 5) AS smooth_speed, round(decel, 4) AS decel,
  valid, topout, coasting FROM pp""")
def b16(spark, folder):
    df = b.prepare(*_inputs(spark, folder), CFG)
    return df.select("session_id", "seq", *[F.round(c, n).alias(c) for c, n in (("speed", 5), ("smooth_speed", 5), ("decel", 4))], "valid", "topout", "coasting")


@query("s4_speed_bins", f"WITH {BINS} SELECT session_id, generate_subscripts(edges, 1)::INTEGER AS n, round(unnest(edges), 5) AS edge FROM ed")
def s4(spark, folder):
    edges = b.speed_edges(b.prepare(*_inputs(spark, folder), CFG), CFG)
    return rounded(edges.select("session_id", F.posexplode("edges").alias("p", "edge")).select("session_id", (F.col("p") + 1).alias("n"), "edge"), 5)


@query("s5_thresholds", f"WITH {PREP}{THRESH} SELECT session_id, threshold_no, threshold_type, threshold_label, round(decel_threshold, 5) AS decel_threshold FROM th")
def s5(spark, folder):
    return rounded(b.thresholds(b.prepare(*_inputs(spark, folder), CFG), CFG), 5)


@query("d9_threshold_expansion", f"""WITH {EXPAND} SELECT session_id, threshold_label, speed_bin, count(*) AS n, count(*) FILTER (braking) AS n_braking,
  count(*) FILTER (loaded) AS n_loaded FROM x GROUP BY ALL""")
def d9(spark, folder):
    x = b.expand(b.prepare(*_inputs(spark, folder), CFG), CFG)
    return x.groupBy("session_id", "threshold_label", "speed_bin").agg(
        F.count("*").alias("n"), F.count_if("braking").alias("n_braking"), F.count_if("loaded").alias("n_loaded"))


_G = "session_id, threshold_no, speed_bin"
EVENTS = EXPAND + f""",
h0 AS (SELECT {_G}, threshold_label, i, CASE WHEN i - lag(i) OVER (PARTITION BY {_G} ORDER BY i) > 2 THEN 1 ELSE 0 END AS nw FROM x WHERE braking),
h1 AS (SELECT *, sum(nw) OVER (PARTITION BY {_G} ORDER BY i) AS run FROM h0),
h2 AS (SELECT {_G}, threshold_label, run, min(i) AS first_i, max(i) AS last_i FROM h1 GROUP BY ALL),
ins0 AS (SELECT h2.*, pp.i, seq, t, dt, speed, decel, stroke, velocity, topout FROM h2 JOIN pp ON h2.session_id = pp.session_id AND pp.i BETWEEN first_i AND last_i),
ins1 AS (SELECT *, CASE WHEN NOT topout THEN stroke END AS sl, count(*) FILTER (NOT topout) OVER (PARTITION BY {_G}, run) AS n,
  count(*) FILTER (NOT topout) OVER (PARTITION BY {_G}, run ORDER BY i) AS rn FROM ins0),
ins AS (SELECT *, sum(CASE WHEN sl IS NOT NULL THEN dt END) OVER (PARTITION BY {_G}, run ORDER BY sl NULLS LAST, seq ROWS UNBOUNDED PRECEDING) AS cum,
  sum(CASE WHEN sl IS NOT NULL THEN dt END) OVER (PARTITION BY {_G}, run) AS tot FROM ins1),
ev0 AS (SELECT {_G}, threshold_label, run, first_i, last_i, min(t) AS start_t, max(t) AS end_t, sum(dt) AS duration, arg_min_null(speed, i) AS entry_speed,
  arg_max_null(speed, i) AS exit_speed, max(decel) AS peak_decel, avg(decel) AS mean_decel, 100.0 * sum(CASE WHEN topout THEN dt ELSE 0 END) / sum(dt) AS topout_pct,
  max(sl) AS max_stroke, sqrt(sum(velocity * velocity * dt) FILTER (NOT topout) / nullif(sum(dt) FILTER (NOT topout AND velocity IS NOT NULL), 0)) AS rms_velocity,
  quantile_cont(sl, 0.5) FILTER (n >= 6 AND rn > n - greatest(n // 3, 1)) - quantile_cont(sl, 0.5) FILTER (n >= 6 AND rn <= greatest(n // 3, 1)) AS pack_down,
  min(sl) FILTER (cum >= 0.5 * tot) AS median_stroke, min(sl) FILTER (cum >= 0.95 * tot) AS p95_stroke FROM ins GROUP BY ALL),
ev AS (SELECT * EXCLUDE (run), row_number() OVER (PARTITION BY session_id ORDER BY threshold_no, speed_bin, first_i) AS event_no FROM ev0)"""


def _events(spark, folder):
    # Both are read several times, so they are written once.
    df = stored(b.prepare(*_inputs(spark, folder), CFG), "braking")
    x = stored(b.expand(df, CFG), "braking-expanded")
    return x, b.events(x, df, CFG)


_EV = ["start_t", "end_t", "duration", "entry_speed", "exit_speed", "peak_decel", "mean_decel", "topout_pct", "max_stroke", "rms_velocity", "pack_down", "median_stroke", "p95_stroke"]


def _round_sql(names) -> str:
    return ", ".join(f"round({n}, 4) + 0.0 AS {n}" for n in names)


@query("f6_braking_events", f"WITH {EVENTS} SELECT session_id, threshold_no, speed_bin, threshold_label, first_i, last_i, event_no, {_round_sql(_EV)} FROM ev")
def f6(spark, folder):
    return rounded(_events(spark, folder)[1], 4)


@query("f7_pack_down", f"""WITH {EVENTS} SELECT session_id, threshold_label, count(pack_down) AS n, round(max(pack_down), 4) AS deepest FROM ev GROUP BY ALL""")
def f7(spark, folder):
    found = _events(spark, folder)[1]
    return rounded(found.groupBy("session_id", "threshold_label").agg(F.count("pack_down").alias("n"), F.max("pack_down").alias("deepest")), 4)


def _q_sql(name: str, where: str, value: str, prefix: str, qs) -> str:
    picks = ", ".join(f"min(vv) FILTER (cum >= {p / 100} * tot) AS {prefix}_p{p}" for p in qs)
    return f"""{name} AS (SELECT {_G}, {picks} FROM (SELECT {_G}, {value} AS vv, sum(dt) OVER (PARTITION BY {_G} ORDER BY {value}, seq ROWS UNBOUNDED PRECEDING) AS cum,
  sum(dt) OVER (PARTITION BY {_G}) AS tot FROM x WHERE {where} AND {value} IS NOT NULL) GROUP BY ALL)"""


ROWS = EVENTS + f""",
w0 AS (SELECT {_G}, threshold_type, threshold_label, decel_threshold, count(*) FILTER (braking) AS n, count(*) FILTER (loaded) AS n_loaded, count(*) FILTER (coasting) AS n_coasting,
  coalesce(sum(dt) FILTER (braking), 0) AS time, coalesce(sum(dt) FILTER (loaded), 0) AS loaded_time, coalesce(sum(dt) FILTER (coasting), 0) AS coasting_time,
  100.0 * coalesce(sum(dt) FILTER (braking AND topout), 0) / sum(dt) FILTER (braking) AS topout_pct,
  {', '.join(f'100.0 * coalesce(sum(dt) FILTER (loaded AND stroke >= {z}), 0) / sum(dt) FILTER (loaded) AS deep{z}_pct' for z in (70, 80, 90, 95))},
  sqrt(sum(velocity * velocity * dt) FILTER (loaded) / nullif(sum(dt) FILTER (loaded AND velocity IS NOT NULL), 0)) AS rms_braking,
  sqrt(sum(velocity * velocity * dt) FILTER (coasting) / nullif(sum(dt) FILTER (coasting AND velocity IS NOT NULL), 0)) AS rms_coasting FROM x GROUP BY ALL),
{_q_sql('ql', 'loaded', 'stroke', 'loaded', (50, 75, 90, 95, 99))}, {_q_sql('qc', 'coasting', 'stroke', 'coasting', (50, 75, 90))},
{_q_sql('qp', 'loaded AND velocity > 0', 'velocity', 'compression', (95,))}, {_q_sql('qr', 'loaded AND velocity < 0', 'abs(velocity)', 'rebound', (95,))},
pe AS (SELECT {_G}, count(*) AS ne, quantile_cont(pack_down, 0.5) AS pack_down_p50, quantile_cont(pack_down, 0.75) AS pack_down_p75, quantile_cont(max_stroke, 0.5) AS event_max_p50,
  quantile_cont(max_stroke, 0.9) AS event_max_p90, quantile_cont(p95_stroke, 0.5) AS event_p95_p50 FROM ev GROUP BY ALL),
m0 AS (SELECT * EXCLUDE (ne), coalesce(ne, 0) AS events, loaded_p50 - coasting_p50 AS dive_pct, loaded_p75 - coasting_p75 AS p75_offset_pct, loaded_p90 - coasting_p90 AS p90_offset_pct,
  100.0 - loaded_p99 AS bottom_margin_pct, CASE WHEN abs(rms_coasting) >= 1e-12 THEN rms_braking / rms_coasting END AS rough_ratio
  FROM w0 LEFT JOIN ql USING ({_G}) LEFT JOIN qc USING ({_G}) LEFT JOIN qp USING ({_G}) LEFT JOIN qr USING ({_G}) LEFT JOIN pe USING ({_G})),
m AS (SELECT *, concat_ws('; ', CASE WHEN n < 3 THEN 'low total samples' END, CASE WHEN n_loaded < 3 THEN 'low loaded samples' END,
  CASE WHEN n_coasting < 3 THEN 'low coasting baseline' END, CASE WHEN events < 2 THEN 'low event count' END, CASE WHEN topout_pct >= 25 THEN 'high topout contamination' END) AS warning FROM m0)"""
_NUM = (
    "decel_threshold time loaded_time coasting_time topout_pct deep70_pct deep80_pct deep90_pct deep95_pct rms_braking rms_coasting loaded_p50 loaded_p75 loaded_p90"
    " loaded_p95 loaded_p99 coasting_p50 coasting_p75 coasting_p90 compression_p95 rebound_p95 pack_down_p50 pack_down_p75 event_max_p50 event_max_p90"
    " event_p95_p50 dive_pct p75_offset_pct p90_offset_pct bottom_margin_pct rough_ratio"
).split()


@query("e26_braking_metric_rows", f"WITH {ROWS} SELECT {_G}, threshold_type, threshold_label, n, n_loaded, n_coasting, events, warning, {_round_sql(_NUM)} FROM m")
def e26(spark, folder):
    x, found = _events(spark, folder)
    return rounded(b.metric_rows(x, found, CFG), 4)


SELECTED = ROWS + """,
sel AS (SELECT m.*, concat_ws(', ', CASE WHEN events < 2 THEN 'few events' END, CASE WHEN topout_pct >= 25 THEN 'topout high' WHEN topout_pct >= 10 THEN 'topout watch' END,
  CASE WHEN dive_pct >= 15 THEN 'dive high' END, CASE WHEN deep90_pct >= 0.5 THEN 'near-bottom' WHEN deep80_pct >= 2 THEN 'deep stroke' END,
  CASE WHEN bottom_margin_pct <= 5 THEN 'low margin' END, CASE WHEN rough_ratio >= 2 THEN 'rough high' WHEN rough_ratio >= 1.5 THEN 'rough watch' END,
  CASE WHEN pack_down_p75 >= 5 THEN 'packdown watch' END) AS fl FROM m WHERE threshold_label = 'P80'),
chosen AS (SELECT * FROM ev WHERE threshold_label = 'P80'),
es AS (SELECT session_id, count(*) AS events, quantile_cont(pack_down, 0.75) AS pack_down_p75, """ + ", ".join(
    f"quantile_cont({c}, {p}) AS {c}_{n}" for c in b.EVENT_MEASURES for n, p in (("p50", 0.5), ("p90", 0.9))) + """ FROM chosen GROUP BY session_id),
ru AS (SELECT session_id, sum(loaded_time) AS loaded_time, sum(events)::BIGINT AS events, max(topout_pct) AS topout_max, min(bottom_margin_pct) AS margin_min, max(rough_ratio) AS rough_max,
""" + ", ".join(f"sum({c} * loaded_time) / nullif(sum(loaded_time) FILTER ({c} IS NOT NULL), 0) AS {n}" for n, c in (
    ("topout_mean", "topout_pct"), ("loaded_median", "loaded_p50"), ("loaded_p90", "loaded_p90"), ("loaded_p95", "loaded_p95"), ("dive_mean", "dive_pct"),
    ("deep80_mean", "deep80_pct"), ("deep90_mean", "deep90_pct"), ("rough_mean", "rough_ratio"), ("rms_braking_mean", "rms_braking"))) + """
  FROM m WHERE threshold_label = 'P80' GROUP BY session_id)"""  # fmt: skip


@query("b14_select_rows", f"WITH {SELECTED} SELECT session_id, speed_bin, threshold_label, CASE WHEN fl = '' THEN 'baseline' ELSE fl END AS flag FROM sel")
def b14(spark, folder):
    x, found = _events(spark, folder)
    rows = b.select_rows(b.metric_rows(x, found, CFG), CFG)
    return rows.select("session_id", "speed_bin", "threshold_label", b.bin_flag(CFG).alias("flag"))


@query("e28_roll_up", f"""WITH {SELECTED} SELECT session_id, events, {_round_sql(['loaded_time', 'topout_max', 'margin_min', 'rough_max', 'topout_mean', 'loaded_median',
  'loaded_p90', 'loaded_p95', 'dive_mean', 'deep80_mean', 'deep90_mean', 'rough_mean', 'rms_braking_mean'])} FROM ru""")
def e28(spark, folder):
    x, found = _events(spark, folder)
    return rounded(b.roll_up(b.select_rows(b.metric_rows(x, found, CFG), CFG)), 4)


@query("e29_event_summary", f"""WITH {SELECTED} SELECT session_id, events, round(pack_down_p75, 4) AS pack_down_p75,
{_round_sql([f'{c}_{n}' for c in b.EVENT_MEASURES for n in ('p50', 'p90')])} FROM es""")
def e29(spark, folder):
    return rounded(b.braking_report(*_inputs(spark, folder), CFG)["event_summary"], 4)


@query("j14_flag_rows", f"""WITH {SELECTED}, su AS (SELECT ru.*, es.pack_down_p75 FROM ru LEFT JOIN es USING (session_id)), fr AS (
SELECT session_id, 'HIGH' AS level, 'Low event count' AS topic FROM su WHERE events < 2
UNION ALL SELECT session_id, CASE WHEN topout_max >= 25 THEN 'HIGH' ELSE 'WATCH' END, 'Topout contamination' FROM su WHERE topout_max >= 10
UNION ALL SELECT session_id, CASE WHEN dive_mean >= 15 THEN 'WATCH' ELSE 'INFO' END, CASE WHEN dive_mean >= 15 THEN 'Brake dive' ELSE 'Low brake dive' END FROM su WHERE dive_mean >= 15 OR dive_mean < 5
UNION ALL SELECT session_id, CASE WHEN deep90_mean >= 0.5 THEN 'HIGH' ELSE 'WATCH' END, CASE WHEN deep90_mean >= 0.5 THEN 'Near-bottom use' ELSE 'Deep stroke use' END FROM su
  WHERE deep90_mean >= 0.5 OR deep80_mean >= 2
UNION ALL SELECT session_id, CASE WHEN rough_max >= 2 THEN 'HIGH' ELSE 'WATCH' END, 'Rough braking' FROM su WHERE rough_max >= 1.5
UNION ALL SELECT session_id, CASE WHEN pack_down_p75 >= 5 THEN 'WATCH' ELSE 'INFO' END, CASE WHEN pack_down_p75 >= 5 THEN 'Pack-down' ELSE 'Mild pack-down' END FROM su WHERE pack_down_p75 >= 2)
SELECT * FROM fr UNION ALL SELECT session_id, 'INFO', 'Baseline' FROM su WHERE session_id NOT IN (SELECT session_id FROM fr)""")
def j14(spark, folder):
    return b.braking_report(*_inputs(spark, folder), CFG)["flag_rows"]


@query("j13_braking_status", f"""WITH {PREP} SELECT session_id, r IS NULL AS has_data, r AS reason FROM (SELECT session_id, CASE WHEN count(speed) < 2 THEN 'Wheel speed has fewer than two valid samples.'
  WHEN count(*) FILTER (valid) = 0 THEN 'No valid samples after speed and stroke filtering.'
  WHEN count(*) FILTER (valid AND decel > 0) = 0 THEN 'No valid positive deceleration samples.' END AS r FROM pp GROUP BY session_id)""")
def j13(spark, folder):
    return b.missing_reason(b.prepare(*_inputs(spark, folder), CFG), CFG)


@query("s6_grades", f"""WITH {SELECTED} SELECT session_id, CASE WHEN topout_max IS NULL THEN 'NO DATA' WHEN topout_max >= 25 THEN 'HIGH' WHEN topout_max >= 10 THEN 'WATCH' ELSE 'OK' END AS topout,
  CASE WHEN margin_min IS NULL THEN 'NO DATA' WHEN margin_min <= 5 THEN 'HIGH' WHEN margin_min <= 15 THEN 'WATCH' ELSE 'OK' END AS margin,
  CASE WHEN dive_mean IS NULL THEN 'NO DATA' WHEN dive_mean < 5 THEN 'LOW' WHEN dive_mean > 15 THEN 'HIGH' ELSE 'MODERATE' END AS dive FROM ru""")
def s6(spark, folder):
    s = b.braking_report(*_inputs(spark, folder), CFG)["summary"]
    lim = CFG.limits
    return s.select("session_id", b.grade(F.col("topout_max"), *lim["topout"]).alias("topout"), b.grade(F.col("margin_min"), *lim["margin"]).alias("margin"),
                    b.grade_dive(F.col("dive_mean"), *lim["dive"]).alias("dive"))
