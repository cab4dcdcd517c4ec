"""Queries of the series, run and alignment operators."""

from __future__ import annotations

from strokeflow.operators import asof, islands, series
from strokeflow.registry.base import F, SAMPLES_SQL, WEIGHTED_SQL, event_samples, query, rounded, weighted_samples

KEY = ["session_id", "seq"]
_W = "OVER (PARTITION BY session_id ORDER BY t_us, seq)"


def _mask_level():
    """A channel with gaps: the front value where it is under 400, else missing."""
    return F.when(F.col("front") < 400, F.col("front"))


_GAPPY = SAMPLES_SQL + ",\ng AS (SELECT *, CASE WHEN front < 400 THEN front END AS v FROM s)"


@query("b1_unwrap_clock", f"""WITH {SAMPLES_SQL}, m AS (SELECT *, t_us % 4294967296 AS c FROM s),
x AS (SELECT *, CASE WHEN lag(c) {_W} - c > 2147483648 THEN 1 ELSE 0 END AS fell FROM m)
SELECT session_id, seq, c AS clock, CAST(c + 4294967296 * sum(fell) {_W} AS BIGINT) AS unwrapped FROM x""")
def b1(spark, folder):
    df = event_samples(spark, folder).withColumn("clock", F.col("t_us") % 2**32)
    df = series.unwrap_clock(df, "clock", "unwrapped", order=("t_us", "seq"))
    return df.select(*KEY, "clock", "unwrapped")


@query("c1_sample_weights", f"WITH {WEIGHTED_SQL} SELECT session_id, seq, round(dt, 6) AS dt FROM d")
def c1(spark, folder):
    return rounded(weighted_samples(spark, folder).select(*KEY, "dt"))


@query("c1_repair_time", f"""WITH RECURSIVE {SAMPLES_SQL}, b AS (SELECT session_id, seq, row_number() {_W} AS i, CASE WHEN seq % 7 = 0 THEN t_h - 40 ELSE t_h END AS t_bad FROM s),
st AS (SELECT *, t_bad - lag(t_bad) OVER (PARTITION BY session_id ORDER BY i) AS step FROM b),
md AS (SELECT session_id, quantile_cont(step, 0.5) FILTER (step > 0) AS median FROM st GROUP BY session_id),
g(session_id, i, t_good) AS (SELECT session_id, i, t_bad FROM b WHERE i = 1
  UNION ALL SELECT b.session_id, b.i, CASE WHEN b.t_bad > g.t_good THEN b.t_bad ELSE g.t_good + median END FROM g JOIN b ON b.session_id = g.session_id AND b.i = g.i + 1 JOIN md ON md.session_id = g.session_id)
SELECT b.session_id, b.seq, round(t_bad, 6) AS t_bad, round(t_good, 6) AS t_good FROM b JOIN g ON b.session_id = g.session_id AND b.i = g.i""")
def c1_repair(spark, folder):
    """Times of every seventh event moved back, then repaired."""
    df = event_samples(spark, folder)
    df = df.withColumn("t_bad", F.when(F.col("seq") % 7 == 0, F.col("t_h") - 40).otherwise(F.col("t_h")))
    return rounded(series.repair_time(df, "t_bad", "t_good", order=("t_us", "seq")).select(*KEY, "t_bad", "t_good"))


@query("c3_odd_window", f"""WITH {WEIGHTED_SQL}
SELECT session_id, CAST(2 * floor(greatest(round_even(60.0 / median, 0), 1) / 2) + 1 AS INTEGER) AS window_samples FROM md""")
def c3(spark, folder):
    df = event_samples(spark, folder).withColumn("step", series.step("t_h"))
    median = df.groupBy("session_id").agg(F.percentile(F.when(F.col("step") > 0, F.col("step")), F.lit(0.5)).alias("m"))
    return median.select("session_id", series.odd_window(60.0, F.col("m")).alias("window_samples"))


@query("c4_default_zero", f"""WITH {SAMPLES_SQL}, r AS (SELECT *, row_number() {_W} AS rn FROM s)
SELECT session_id, round_even(quantile_cont(front, 0.5), 0) AS zero FROM r WHERE rn <= 25 GROUP BY session_id""")
def c4(spark, folder):
    return series.default_zero(event_samples(spark, folder), "front", 25)


@query("c5_calibrate", f"""WITH {SAMPLES_SQL}, r AS (SELECT *, row_number() {_W} AS rn FROM s),
z AS (SELECT session_id, round_even(quantile_cont(front, 0.5), 0) AS zero FROM r WHERE rn <= 25 GROUP BY session_id)
SELECT session_id, seq, round(zero - front, 6) AS counts, round((zero - front) - (zero - 95.0), 6) AS travel
FROM s JOIN z USING (session_id)""")
def c5(spark, folder):
    df = event_samples(spark, folder)
    df = df.join(series.default_zero(df, "front", 25), "session_id")
    front, zero = F.col("front"), F.col("zero")
    return rounded(df.select(*KEY, series.calibrate(front, zero, -1).alias("counts"),
                             series.calibrate(front, zero, -1, F.lit(95.0)).alias("travel")))


def _padded_sql(expr: str, k: int) -> str:
    return (
        f"(sum({expr}) OVER (PARTITION BY session_id ORDER BY t_us, seq ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"
        f" + greatest(0, {k} + 1 - row_number() {_W}) * first({expr}) OVER p"
        f" + greatest(0, {k} - count(*) OVER p + row_number() {_W}) * last({expr}) OVER p)"
    )


_P = "WINDOW p AS (PARTITION BY session_id ORDER BY t_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query("c6_moving_average", f"WITH {SAMPLES_SQL} SELECT session_id, seq, round({_padded_sql('front', 2)} / 5, 6) AS smooth FROM s {_P}")
def c6(spark, folder):
    df = event_samples(spark, folder)
    return rounded(df.select(*KEY, series.moving_average(F.col("front"), 5).alias("smooth")))


@query("c7_moving_average_known", f"""WITH {_GAPPY}
SELECT session_id, seq, round({_padded_sql('coalesce(v, 0)', 2)} / nullif({_padded_sql('CASE WHEN v IS NULL THEN 0 ELSE 1 END', 2)}, 0), 6) AS smooth
FROM g {_P}""")
def c7(spark, folder):
    df = event_samples(spark, folder).withColumn("v", _mask_level())
    return rounded(df.select(*KEY, series.moving_average_known(F.col("v"), 5).alias("smooth")))


@query("c8_rolling_sum", f"WITH {SAMPLES_SQL} SELECT session_id, seq, round({_padded_sql('rear', 3)}, 6) AS total FROM s {_P}")
def c8(spark, folder):
    return rounded(event_samples(spark, folder).select(*KEY, series.rolling_sum(F.col("rear"), 7).alias("total")))


def _gradient_sql(v: str, w: str) -> str:
    return f"""CASE WHEN lag(t_h) {w} IS NULL AND lead(t_h) {w} IS NULL THEN NULL
  WHEN lag(t_h) {w} IS NULL THEN (lead({v}) {w} - {v}) / (lead(t_h) {w} - t_h)
  WHEN lead(t_h) {w} IS NULL THEN ({v} - lag({v}) {w}) / (t_h - lag(t_h) {w})
  ELSE (power(t_h - lag(t_h) {w}, 2) * lead({v}) {w} + (power(lead(t_h) {w} - t_h, 2) - power(t_h - lag(t_h) {w}, 2)) * {v}
        - power(lead(t_h) {w} - t_h, 2) * lag({v}) {w})
       / ((t_h - lag(t_h) {w}) * (lead(t_h) {w} - t_h) * (lead(t_h) {w} - lag(t_h) {w})) END"""


@query("c9_gradient", f"WITH {SAMPLES_SQL} SELECT session_id, seq, round({_gradient_sql('front', _W)}, 5) AS slope FROM s")
def c9(spark, folder):
    df = event_samples(spark, folder)
    return rounded(df.select(*KEY, series.gradient(F.col("front"), F.col("t_h")).alias("slope")), 5)


_W2 = "OVER (PARTITION BY session_id, run ORDER BY t_us, seq)"
_W3 = "OVER (PARTITION BY session_id, v IS NULL ORDER BY t_us, seq)"


@query("c10_gradient_in_runs", f"""WITH {_GAPPY},
e AS (SELECT *, CASE WHEN (v IS NULL) <> lag(v IS NULL) {_W} THEN 1 ELSE 0 END AS edge FROM g),
r AS (SELECT *, sum(edge) {_W} AS run FROM e)
SELECT session_id, seq, round(CASE WHEN v IS NOT NULL AND count(*) OVER (PARTITION BY session_id, run) >= 3
  THEN {_gradient_sql('v', _W2)} END, 5) AS slope FROM r""")
def c10(spark, folder):
    df = event_samples(spark, folder).withColumn("v", _mask_level())
    return rounded(series.gradient_in_runs(df, "v", "t_h", "slope").select(*KEY, "slope"), 5)


@query("c11_gradient_bridged", f"""WITH {_GAPPY}
SELECT session_id, seq, round(CASE WHEN v IS NOT NULL THEN {_gradient_sql('v', _W3)} END, 5) AS slope FROM g""")
def c11(spark, folder):
    df = event_samples(spark, folder).withColumn("v", _mask_level())
    return rounded(series.gradient_bridged(df, "v", "t_h", "slope").select(*KEY, "slope"), 5)


@query("c12_central_difference", f"""WITH {SAMPLES_SQL}, x AS (SELECT *, coalesce(lead(front) {_W}, front) - coalesce(lag(front) {_W}, front) AS dv,
  coalesce(lead(t_h) {_W}, t_h) - coalesce(lag(t_h) {_W}, t_h) AS span FROM s)
SELECT session_id, seq, round(CASE WHEN span > 0 THEN dv / span END, 5) AS slope FROM x""")
def c12(spark, folder):
    df = event_samples(spark, folder)
    return rounded(df.select(*KEY, series.central_difference(F.col("front"), F.col("t_h")).alias("slope")), 5)


_RANGE = "m AS (SELECT session_id, min(front) AS lo, max(front) AS hi FROM s GROUP BY session_id)"


def _ranged(spark, folder):
    return series.per_session(event_samples(spark, folder), [F.min("front").alias("lo"), F.max("front").alias("hi")])


@query("c13_percent_scale", f"""WITH {SAMPLES_SQL}, {_RANGE}
SELECT session_id, seq, round(CASE WHEN hi > lo THEN (front - lo) / (hi - lo) * 100 ELSE 0 END, 6) AS pct FROM s JOIN m USING (session_id)""")
def c13(spark, folder):
    return rounded(_ranged(spark, folder).select(*KEY, series.percent_scale(F.col("front"), F.col("lo"), F.col("hi")).alias("pct")))


@query("c14_stroke_percent", f"""WITH {SAMPLES_SQL}, {_RANGE}
SELECT session_id, seq, round(CASE WHEN session_id % 2 = 0 THEN front / 300 * 100 WHEN hi > lo THEN (front - lo) / (hi - lo) * 100 ELSE 0 END, 6) AS pct,
  CASE WHEN session_id % 2 = 0 THEN 'configured' ELSE 'used' END AS basis FROM s JOIN m USING (session_id)""")
def c14(spark, folder):
    df = _ranged(spark, folder).withColumn("full", F.when(F.col("session_id") % 2 == 0, 300.0))
    pct, basis = series.stroke_percent(F.col("front"), F.col("full"), F.col("lo"), F.col("hi"))
    return rounded(df.select(*KEY, pct.alias("pct"), basis.alias("basis")))


@query("c16_sign_change", f"WITH {SAMPLES_SQL} SELECT session_id, seq, coalesce((front - 200) * lag(front - 200) {_W} < 0, false) AS crossed FROM s")
def c16(spark, folder):
    return event_samples(spark, folder).select(*KEY, series.sign_change(F.col("front") - 200).alias("crossed"))


@query("c17_roughness", f"""WITH {SAMPLES_SQL}, a AS (SELECT *, power(front - {_padded_sql('front', 2)} / 5, 2) AS rest FROM s {_P})
SELECT session_id, seq, round(sqrt({_padded_sql('rest', 2)} / 5), 5) AS roughness FROM a {_P}""")
def c17(spark, folder):
    return rounded(series.roughness(event_samples(spark, folder), "front", "roughness", 5).select(*KEY, "roughness"), 5)


@query("c18_collapse_times", f"""WITH {SAMPLES_SQL}, h AS (SELECT session_id, floor(t_h / 24) AS day, front, rear FROM s)
SELECT session_id, day, round(avg(front), 6) AS front, round(avg(rear), 6) AS rear FROM h GROUP BY session_id, day""")
def c18(spark, folder):
    df = event_samples(spark, folder).withColumn("day", F.floor(F.col("t_h") / 24).cast("double"))
    return rounded(series.collapse_times(df, "day", ["front", "rear"]))


_MASK = SAMPLES_SQL + ",\nk AS (SELECT *, front > 60 AS m FROM s)"
_RUN = f"""e AS (SELECT *, CASE WHEN m <> lag(m) {_W} THEN 1 ELSE 0 END AS edge FROM k),
r AS (SELECT *, sum(edge) {_W} AS run FROM e)"""


def _masked(spark, folder):
    return event_samples(spark, folder).withColumn("m", F.col("front") > 60)


@query("f1_runs", f"""WITH {_MASK}, {_RUN},
x AS (SELECT session_id, run, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM r WHERE m GROUP BY session_id, run)
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY run) AS INTEGER) AS run_no, first_seq, last_seq, n FROM x""")
def f1(spark, folder):
    aggs = [F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n")]
    return islands.runs(_masked(spark, folder), "m", aggs)


@query("f2_fill_gaps", f"""WITH {_MASK}, {_RUN}
SELECT session_id, seq, m OR (run > 0 AND run < max(run) OVER (PARTITION BY session_id) AND count(*) OVER (PARTITION BY session_id, run) <= 2) AS filled FROM r""")
def f2(spark, folder):
    return islands.fill_gaps(_masked(spark, folder), "m", "filled", 2).select(*KEY, "filled")


@query("f3_keep_long", f"""WITH {_MASK}, {_RUN}
SELECT session_id, seq, m AND count(*) OVER (PARTITION BY session_id, run) >= 3 AS kept FROM r""")
def f3(spark, folder):
    return islands.keep_long(_masked(spark, folder), "m", "kept", 3).select(*KEY, "kept")


_CODES = SAMPLES_SQL + """,
k AS (SELECT *, CASE WHEN front < 40 THEN 0 WHEN front < 90 THEN 1 ELSE 2 END AS c, code <> 'error' AS ok FROM s)"""


def _coded(spark, folder):
    c = F.when(F.col("front") < 40, 0).when(F.col("front") < 90, 1).otherwise(2)
    return event_samples(spark, folder).withColumns({"c": c, "ok": F.col("code") != "error"})


@query("f4_absorb_short", f"""WITH {_CODES},
a AS (SELECT *, CASE WHEN ok <> lag(ok) {_W} THEN 1 ELSE 0 END AS e1 FROM k), b AS (SELECT *, sum(e1) {_W} AS stretch FROM a),
a2 AS (SELECT *, CASE WHEN c <> lag(c) OVER (PARTITION BY session_id, stretch ORDER BY t_us, seq) THEN 1 ELSE 0 END AS e2 FROM b),
b2 AS (SELECT *, sum(e2) OVER (PARTITION BY session_id, stretch ORDER BY t_us, seq) AS run FROM a2),
x AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY session_id, stretch, run) >= 2 THEN c END AS lng,
  max(CASE WHEN run = 1 THEN c END) OVER (PARTITION BY session_id, stretch) AS second FROM b2)
SELECT session_id, seq, CASE WHEN ok THEN coalesce(last_value(lng IGNORE NULLS) OVER (PARTITION BY session_id, stretch ORDER BY t_us, seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), second, 1) ELSE c END AS state FROM x""")
def f4(spark, folder):
    return islands.absorb_short(_coded(spark, folder), "c", F.col("ok"), "state", 2, 1).select(*KEY, "state")


@query("f5_segment_ids", f"""WITH {_CODES}, k2 AS (SELECT *, CASE WHEN ok THEN c * 10 + floor(rear / 50) END AS st FROM k),
a AS (SELECT *, CASE WHEN st IS DISTINCT FROM lag(st) {_W} AND row_number() {_W} > 1 THEN 1 ELSE 0 END AS e FROM k2),
b AS (SELECT *, sum(e) {_W} AS run FROM a)
SELECT session_id, seq, CAST(CASE WHEN ok THEN dense_rank() OVER (PARTITION BY session_id, ok ORDER BY run) - 1 ELSE -1 END AS INTEGER) AS segment FROM b""")
def f5(spark, folder):
    df = _coded(spark, folder).withColumn("half", F.floor(F.col("rear") / 50))
    return islands.segment_ids(df, ["c", "half"], F.col("ok"), "segment").select(*KEY, "segment")


@query("f10_middle_value", f"""WITH {_MASK}, {_RUN}, x AS (SELECT *, row_number() {_W2} AS rn, count(*) OVER (PARTITION BY session_id, run) AS n FROM r WHERE m)
SELECT session_id, CAST(run AS BIGINT) AS run, max(code) FILTER (rn = 1 + (n - 1) // 2) AS code FROM x GROUP BY session_id, run""")
def f10(spark, folder):
    df = islands.with_runs(_masked(spark, folder), F.col("m")).where("m")
    mid = islands.middle_value(F.col("code"), ("session_id", "run"))
    return df.select("session_id", "run", mid.alias("code")).distinct()


_PULSES = SAMPLES_SQL + f""",
q AS (SELECT session_id, t_h, front AS v, t_h - lag(t_h) OVER (PARTITION BY session_id ORDER BY t_us, seq) AS p, seq, t_us FROM s WHERE code = 'click'),
u AS (SELECT session_id, seq, t_h, 1 AS kind, NULL AS pulse FROM s
      UNION ALL SELECT session_id, seq, t_h, 0, {{'t': t_h, 'v': v, 'p': p}} FROM q),
h AS (SELECT *, last_value(pulse IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY t_h, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held,
        min(CASE WHEN kind = 0 THEN t_h END) OVER (PARTITION BY session_id) AS first_t FROM u)"""


def _clicks(spark, folder):
    clicks = event_samples(spark, folder).where("code = 'click'")
    return clicks.select("session_id", "t_h", F.col("front").alias("v"), series.step("t_h").alias("p"))


@query("d1_asof_hold", f"""WITH {_PULSES}
SELECT session_id, seq, round(CASE WHEN held.p IS NOT NULL AND t_h < held.t + 1.5 * held.p THEN held.v
  WHEN t_h < first_t AND first_t > 0 THEN 0.0 END, 6) AS speed,
  coalesce(held.p IS NOT NULL AND t_h < held.t + 1.5 * held.p, false) AS speed_held FROM h WHERE kind = 1""")
def d1(spark, folder):
    samples = event_samples(spark, folder).select("session_id", "seq", "t_h")
    held = asof.hold_with_timeout(samples, _clicks(spark, folder), "t_h", "v", "p", "speed")
    return rounded(held.select(*KEY, "speed", "speed_held"))


@query("d2_interp_join", f"""WITH {SAMPLES_SQL}, q AS (SELECT session_id, t_h, avg(rear) AS v FROM s WHERE code = 'view' GROUP BY session_id, t_h),
n AS (SELECT session_id, count(*) AS n FROM q GROUP BY session_id),
x AS (SELECT s.session_id, s.seq, s.t_h, a.t_h AS ta, a.v AS va FROM s ASOF LEFT JOIN q a ON s.session_id = a.session_id AND s.t_h >= a.t_h),
y AS (SELECT x.*, b.t_h AS tb, b.v AS vb FROM x ASOF LEFT JOIN q b ON x.session_id = b.session_id AND x.t_h <= b.t_h)
SELECT y.session_id, seq, round(CASE WHEN n >= 2 AND ta IS NOT NULL AND tb IS NOT NULL THEN
  CASE WHEN tb > ta THEN va + (vb - va) * (y.t_h - ta) / (tb - ta) ELSE va END END, 6) AS rear_at FROM y LEFT JOIN n USING (session_id)""")
def d2(spark, folder):
    df = event_samples(spark, folder)
    views = df.where("code = 'view'").select("session_id", "t_h", "rear")
    return rounded(asof.interpolate_join(df.select("session_id", "seq", "t_h"), views, "t_h", "rear", "rear_at").select(*KEY, "rear_at"))


@query("d4_interp_gaps", f"""WITH {_GAPPY}, q AS (SELECT session_id, t_h, v FROM g WHERE v IS NOT NULL),
x AS (SELECT g.session_id, g.seq, g.t_h, a.t_h AS ta, a.v AS va FROM g ASOF LEFT JOIN q a ON g.session_id = a.session_id AND g.t_h >= a.t_h),
y AS (SELECT x.*, b.t_h AS tb, b.v AS vb FROM x ASOF LEFT JOIN q b ON x.session_id = b.session_id AND x.t_h <= b.t_h)
SELECT session_id, seq, round(CASE WHEN ta IS NOT NULL AND tb IS NOT NULL THEN
  CASE WHEN tb > ta THEN va + (vb - va) * (t_h - ta) / (tb - ta) ELSE va END END, 6) AS filled FROM y""")
def d4(spark, folder):
    df = event_samples(spark, folder).withColumn("v", _mask_level())
    return rounded(asof.interpolate_gaps(df, "v", "t_h", "filled").select(*KEY, "filled"))


