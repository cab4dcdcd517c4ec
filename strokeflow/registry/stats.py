"""Queries of the statistics, histogram and metric operators."""

from __future__ import annotations

import math

from strokeflow.operators import hist, islands, metrics, series, stats
from strokeflow.registry.base import F, SAMPLES_SQL, WEIGHTED_SQL, event_samples, query, rounded, table, weighted_samples

_W = "OVER (PARTITION BY session_id ORDER BY t_us, seq)"


def _lines(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_returnflag", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("w")
    )


_L = "l AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice AS v, l_quantity AS w FROM lineitem)"


@query("e1_weighted_mean", f"WITH {_L} SELECT l_returnflag, round(sum(v * w) / sum(w), 4) AS mean FROM l GROUP BY l_returnflag")
def e1(spark, folder):
    return rounded(_lines(spark, folder).groupBy("l_returnflag").agg(stats.weighted_mean(F.col("v"), F.col("w")).alias("mean")), 4)


@query("e2_weighted_rms", f"WITH {_L} SELECT l_returnflag, round(sqrt(sum(v * v * w) / sum(w)), 4) AS rms FROM l GROUP BY l_returnflag")
def e2(spark, folder):
    return rounded(_lines(spark, folder).groupBy("l_returnflag").agg(stats.weighted_rms(F.col("v"), F.col("w")).alias("rms")), 4)


_CUM = """c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS cum,
  sum(w) OVER (PARTITION BY l_returnflag) AS total FROM l WHERE w > 0)"""
_QS = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}


@query("e3_wquantile_inv", f"WITH {_L}, {_CUM} SELECT l_returnflag, "
       + ", ".join(f"min(v) FILTER (cum >= {q} * total) AS {n}" for n, q in _QS.items()) + " FROM c GROUP BY l_returnflag")
def e3(spark, folder):
    return stats.weighted_quantiles_inv(_lines(spark, folder), "v", "w", _QS, ["l_returnflag"], ["l_orderkey", "l_linenumber"], refine=True)


@query("e4_wquantile_interp", f"""WITH {_L}, {_CUM}, x AS (SELECT *, lag(cum) OVER o AS c0, lag(v) OVER o AS v0 FROM c
  WINDOW o AS (PARTITION BY l_returnflag ORDER BY v, l_orderkey, l_linenumber))
SELECT l_returnflag, """ + ", ".join(
    f"round(coalesce(arg_min(coalesce(v0 + (v - v0) * ({q} * total - c0) / (cum - c0), v), cum) FILTER (cum >= {q} * total), max(v)), 4) AS {n}"
    for n, q in _QS.items()) + " FROM x GROUP BY l_returnflag")
def e4(spark, folder):
    df = _lines(spark, folder)
    return rounded(stats.weighted_quantiles_interp(df, "v", "w", _QS, ["l_returnflag"], ["l_orderkey", "l_linenumber"], refine=True), 4)


@query("e5_geometric_sd", f"""WITH {_L}, m AS (SELECT l_returnflag, sum(ln(v) * w) / sum(w) AS mu FROM l WHERE v > 0 GROUP BY l_returnflag)
SELECT l_returnflag, round(exp(sqrt(sum(power(ln(v) - mu, 2) * w) / sum(w))), 6) AS gsd FROM l JOIN m USING (l_returnflag) WHERE v > 0 GROUP BY l_returnflag""")
def e5(spark, folder):
    return rounded(_lines(spark, folder).groupBy("l_returnflag").agg(stats.weighted_geometric_std(F.col("v"), F.col("w")).alias("gsd")))


@query("e6_percentile_range", f"""WITH {SAMPLES_SQL}, q AS (SELECT session_id, quantile_cont(front, 0.01) AS lo, quantile_cont(front, 0.99) AS hi FROM s GROUP BY session_id)
SELECT session_id, round(CASE WHEN hi > lo THEN lo ELSE lo - CASE WHEN lo = 0 THEN 1 ELSE abs(lo) * 0.05 END END, 6) AS low,
  round(CASE WHEN hi > lo THEN hi ELSE hi + CASE WHEN lo = 0 THEN 1 ELSE abs(lo) * 0.05 END END, 6) AS high FROM q""")
def e6(spark, folder):
    q = stats.linear_percentiles(event_samples(spark, folder), "front", {"p01": 0.01, "p99": 0.99}, ["session_id"])
    low, high = stats.padded_range(F.col("p01"), F.col("p99"))
    return rounded(q.select("session_id", low.alias("low"), high.alias("high")))


def bin_sql(v: str, lo: str, hi: str, n: int) -> str:
    g = f"least(floor(({v} - ({lo})) * {n} / (({hi}) - ({lo}))), {n - 1})"
    e = lambda i: f"(({lo}) + ({i}) * ((({hi}) - ({lo})) / {n}))"
    return (
        f"(CASE WHEN {v} >= ({lo}) AND {v} <= ({hi}) THEN greatest(0, CASE WHEN {v} < {e(g)} THEN {g} - 1"
        f" WHEN {v} >= {e(g + ' + 1')} AND {g} < {n - 1} THEN {g} + 1 ELSE {g} END) END)::INTEGER"
    )


@query("e7_travel_histogram", f"""WITH {WEIGHTED_SQL}, g AS (SELECT session_id, sum(dt) AS al FROM d GROUP BY session_id),
b AS (SELECT session_id, {bin_sql('front', '0.0', '200.0', 20)} AS bin, sum(dt) AS t FROM d GROUP BY 1, 2),
x AS (SELECT session_id, al, unnest(generate_series(0, 19))::INTEGER AS bin FROM g)
SELECT x.session_id, x.bin, round(x.bin * 10.0, 6) AS low_edge, round((x.bin + 1) * 10.0, 6) AS high_edge, round(100.0 * coalesce(t, 0) / al, 6) AS time
FROM x LEFT JOIN b ON x.session_id = b.session_id AND x.bin = b.bin""")
def e7(spark, folder):
    df = weighted_samples(spark, folder)
    return rounded(hist.histogram(df, "front", "dt", 20, F.lit(0.0), F.lit(200.0), ["session_id"], relative=True))


_VEL = """v AS (SELECT *, front - lag(front) OVER (PARTITION BY session_id ORDER BY t_us, seq) AS vel FROM d)"""


def _velocity(spark, folder):
    df = weighted_samples(spark, folder)
    return df.withColumn("vel", F.col("front") - F.lag("front").over(series.in_order()))


def _velocity_sql(x: str, centre: str) -> str:
    return f"""WITH {WEIGHTED_SQL}, {_VEL}, z AS (SELECT *, {x} AS x FROM v WHERE vel IS NOT NULL),
r AS (SELECT session_id, CASE WHEN max(abs(x)) > 0 THEN max(abs(x)) ELSE 1.0 END AS r FROM z GROUP BY session_id),
b AS (SELECT session_id, {bin_sql('x', '-r', 'r', 16)} AS bin, sum(dt) AS al, sum(CASE WHEN vel >= 0 THEN dt ELSE 0 END) AS co,
  sum(CASE WHEN vel < 0 THEN dt ELSE 0 END) AS re FROM z JOIN r USING (session_id) GROUP BY 1, 2),
g AS (SELECT session_id, r, unnest(generate_series(0, 15))::INTEGER AS bin FROM r)
SELECT g.session_id, g.bin, round({centre}, 6) AS center, round(coalesce(al, 0), 6) AS all_time, round(coalesce(co, 0), 6) AS compression_time,
  round(coalesce(re, 0), 6) AS rebound_time FROM g LEFT JOIN b ON g.session_id = b.session_id AND g.bin = b.bin"""


@query("e8_velocity_histogram", _velocity_sql("vel", "(-r + (g.bin + 0.5) * (2 * r / 16)) + 0.0"))
def e8(spark, folder):
    return rounded(hist.velocity_histogram(_velocity(spark, folder), "vel", "dt", 16, ["session_id"]))


_C = "(-r + (g.bin + 0.5) * (2 * r / 16))"


@query("e8_velocity_histogram_log", _velocity_sql("sign(vel) * log10(1 + abs(vel))", f"sign({_C}) * (power(10.0, abs({_C})) - 1)"))
def e8_log(spark, folder):
    return rounded(hist.velocity_histogram(_velocity(spark, folder), "vel", "dt", 16, ["session_id"], log=True))


def _percentile_sql(ordered: str, q: float) -> str:
    """Linear percentile of a sorted list: between equal neighbours it is their value, to the last bit."""
    at = f"((len({ordered}) - 1) * {q}::DOUBLE)"
    low, high = (f"{ordered}[{f}({at})::BIGINT + 1]" for f in ("floor", "ceil"))
    return f"CASE WHEN {low} = {high} THEN {low} ELSE (ceil({at}) - {at}) * {low} + ({at} - floor({at})) * {high} END"


#: The rule of :func:`strokeflow.operators.hist.auto_ranges`, with its ranges for flat sessions.
_RANGES = f"""q AS (SELECT session_id, {_percentile_sql('fronts', 0.005)} AS a0, {_percentile_sql('fronts', 0.995)} AS a1, {_percentile_sql('speeds', 0.995)} AS b
  FROM (SELECT session_id, list_sort(list(front) FILTER (front IS NOT NULL)) AS fronts, list_sort(list(abs(vel)) FILTER (vel IS NOT NULL)) AS speeds FROM v GROUP BY session_id)),
r AS (SELECT session_id, CASE WHEN a1 > a0 THEN a0 ELSE a0 - greatest(abs(a0) * 0.05, 1.0) END AS x0, CASE WHEN a1 > a0 THEN a1 ELSE a1 + greatest(abs(a0) * 0.05, 1.0) END AS x1,
  CASE WHEN b > 0 THEN b ELSE 1.0 END AS y1 FROM q)"""


@query("e9_occupancy_grid", f"""WITH {WEIGHTED_SQL}, {_VEL}, {_RANGES},
c AS (SELECT session_id, {bin_sql('front', 'x0', 'x1', 20)} AS x_bin, {bin_sql('vel', '-y1', 'y1', 20)} AS y_bin, dt FROM v JOIN r USING (session_id))
SELECT session_id, x_bin, y_bin, round(sum(dt), 6) AS time, count(*) AS samples FROM c WHERE x_bin IS NOT NULL AND y_bin IS NOT NULL GROUP BY ALL""")
def e9(spark, folder):
    df = _velocity(spark, folder)
    ranged = df.join(hist.auto_ranges(df, "front", "vel", ["session_id"]), "session_id")
    ends = tuple(F.col(c) for c in ("x0", "x1", "y0", "y1"))
    return rounded(hist.occupancy(ranged, "front", "vel", "dt", 20, 20, ends, ["session_id"]))


@query("a20_dense_grid", f"""WITH {WEIGHTED_SQL}, c AS (SELECT session_id, {bin_sql('front', '0.0', '500.0', 8)} AS x_bin, {bin_sql('rear', '0.0', '100.0', 8)} AS y_bin, dt FROM d),
t AS (SELECT session_id, x_bin, y_bin, sum(dt) AS time, count(*) AS samples FROM c GROUP BY ALL),
g AS (SELECT DISTINCT session_id, x::INTEGER AS x_bin, y::INTEGER AS y_bin FROM s, generate_series(0, 7) AS a(x), generate_series(0, 7) AS b(y))
SELECT g.session_id, g.x_bin, g.y_bin, round(coalesce(time, 0), 6) AS time, coalesce(samples, 0) AS samples FROM g
LEFT JOIN t ON g.session_id = t.session_id AND g.x_bin = t.x_bin AND g.y_bin = t.y_bin""")
def a20(spark, folder):
    df = weighted_samples(spark, folder)
    ends = tuple(map(F.lit, (0.0, 500.0, 0.0, 100.0)))
    cells = hist.occupancy(df, "front", "rear", "dt", 8, 8, ends, ["session_id"])
    return rounded(hist.dense_grid(cells, df.select("session_id").distinct(), 8, 8, ["session_id"]))


@query("e11_heatmaps", f"""WITH {WEIGHTED_SQL}, {_VEL}, u AS (SELECT session_id, dt, front AS src, 'rear' AS response, rear AS y FROM v
  UNION ALL SELECT session_id, dt, front, 'velocity', vel FROM v),
r AS (SELECT session_id, response, min(src) AS a0, max(src) AS a1, min(y) AS b0, max(y) AS b1 FROM u WHERE y IS NOT NULL GROUP BY ALL),
q AS (SELECT *, a0 - CASE WHEN a1 > a0 THEN 0 ELSE 0.5 END AS x0, a1 + CASE WHEN a1 > a0 THEN 0 ELSE 0.5 END AS x1,
  b0 - CASE WHEN b1 > b0 THEN 0 ELSE 0.5 END AS y0, b1 + CASE WHEN b1 > b0 THEN 0 ELSE 0.5 END AS y1 FROM r),
c AS (SELECT u.session_id, u.response, {bin_sql('src', 'x0', 'x1', 12)} AS x_bin, {bin_sql('y', 'y0', 'y1', 12)} AS y_bin, dt
  FROM u JOIN q ON u.session_id = q.session_id AND u.response = q.response)
SELECT session_id, response, x_bin, y_bin, round(sum(dt), 6) AS time, count(*) AS samples FROM c WHERE y_bin IS NOT NULL AND x_bin IS NOT NULL GROUP BY ALL""")
def e11(spark, folder):
    df = _velocity(spark, folder)
    return rounded(heatmaps(df, "front", {"rear": "rear", "velocity": "vel"}, "dt", 12))


def heatmaps(df, source: str, responses: dict[str, str], weight: str, bins: int):
    """Time in (source, response) cells of several responses, on the ranges of the data."""
    pairs = [F.struct(F.lit(k).alias("response"), F.col(c).cast("double").alias("y")) for k, c in responses.items()]
    long = df.select("session_id", weight, F.col(source).alias("x"), F.explode(F.array(*pairs)).alias("p"))
    long = long.select("session_id", weight, "x", "p.*").where("x is not null and y is not null")
    by = ["session_id", "response"]
    ends = long.groupBy(*by).agg(*[f(c).alias(f"{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))])
    for c in "xy":
        pad = F.when(F.col(f"{c}1") > F.col(f"{c}0"), 0.0).otherwise(0.5)
        ends = ends.withColumns({f"{c}0": F.col(f"{c}0") - pad, f"{c}1": F.col(f"{c}1") + pad})
    ranges = tuple(F.col(c) for c in ("x0", "x1", "y0", "y1"))
    return hist.occupancy(long.join(ends, by), "x", "y", weight, bins, bins, ranges, by)


def mode_sql(p: str, src: str, by: str, value: str, weight: str, lo: str | None = None, hi: str | None = None, bins: int = 100) -> str:
    """CTEs <p>_m(by, mode) of the smoothed histogram mode."""
    kernel = [math.exp(-0.5 * (i / 2.0) ** 2) for i in range(-8, 9)]
    total = sum(kernel)
    over = f"OVER (PARTITION BY {by} ORDER BY bin)"
    smooth = " + ".join(
        f"coalesce({'lead' if i > 0 else 'lag'}(n, {abs(i)}) {over}, 0) * {k / total!r}" for i, k in zip(range(-8, 9), kernel, strict=True)
    )
    pad = f"CASE WHEN max({value}) > min({value}) THEN 0 WHEN min({value}) = 0 THEN 1 ELSE abs(min({value})) * 0.05 END"
    ends = (f"{lo}", f"{hi}") if lo else (f"min({value}) - {pad}", f"max({value}) + {pad}")
    join = " AND ".join(f"g.{c} = c.{c}" for c in by.split(", "))
    return f"""{p}_r AS (SELECT {by}, {ends[0]} AS mlo, {ends[1]} AS mhi FROM {src} WHERE {value} IS NOT NULL GROUP BY {by}),
{p}_c AS (SELECT {by}, {bin_sql(value, 'mlo', 'mhi', bins)} AS bin, sum({weight}) AS n FROM {src} JOIN {p}_r USING ({by}) GROUP BY ALL),
{p}_g AS (SELECT *, unnest(generate_series(0, {bins - 1}))::INTEGER AS bin FROM {p}_r),
{p}_d AS (SELECT g.*, coalesce(c.n, 0.0) AS n FROM {p}_g g LEFT JOIN {p}_c c ON {join} AND g.bin = c.bin),
{p}_s AS (SELECT *, round({smooth}, 9) AS sm FROM {p}_d),
{p}_n AS (SELECT *, lag(sm) {over} AS l, lead(sm) {over} AS r, row_number() OVER (PARTITION BY {by} ORDER BY sm DESC, bin) AS k FROM {p}_s),
{p}_m AS (SELECT {by}, mlo + (bin + 0.5 + CASE WHEN l IS NULL OR r IS NULL OR abs(l - 2 * sm + r) < 1e-12 THEN 0.0
  ELSE greatest(-0.5, least(0.5, 0.5 * (l - r) / (l - 2 * sm + r))) END) * (mhi - mlo) / {bins} AS mode FROM {p}_n WHERE k = 1)"""


@query("e12_smoothed_mode", f"WITH {WEIGHTED_SQL}, {mode_sql('a', 'd', 'session_id', 'front', 'dt')} SELECT session_id, round(mode, 5) AS mode FROM a_m")
def e12(spark, folder):
    return rounded(stats.smoothed_mode(weighted_samples(spark, folder), "front", "dt", ["session_id"]), 5)


@query("e13_bands", f"""WITH {WEIGHTED_SQL}, b AS (SELECT session_id, least(floor(greatest(0, least(100, rear)) / 10), 9)::INTEGER AS band, dt FROM d),
a AS (SELECT session_id, sum(dt) AS al FROM b GROUP BY session_id), t AS (SELECT session_id, band, sum(dt) AS t FROM b GROUP BY ALL),
g AS (SELECT *, unnest(generate_series(0, 9))::INTEGER AS band FROM a)
SELECT g.session_id, g.band, round(100.0 * coalesce(t, 0) / al, 6) AS share FROM g LEFT JOIN t ON g.session_id = t.session_id AND g.band = t.band""")
def e13(spark, folder):
    return rounded(hist.bands(weighted_samples(spark, folder), "rear", "dt", ["session_id"]))


def _channels(spark, folder):
    """Both channels in long form with their velocity; counts stand for travel, hours for seconds."""
    df = weighted_samples(spark, folder)
    pairs = [F.struct(F.lit(c).alias("channel"), F.col(c).alias("raw")) for c in ("front", "rear")]
    long = df.select("session_id", "t_us", "seq", "dt", F.explode(F.array(*pairs)).alias("p")).select("*", "p.*").drop("p")
    velocity = F.col("raw") - F.lag("raw").over(series.in_order(("session_id", "channel")))
    return long.withColumns({"travel": F.col("raw"), "velocity": velocity})


_CH = """ch0 AS (SELECT session_id, t_us, seq, dt, 'front' AS channel, front AS raw FROM d UNION ALL SELECT session_id, t_us, seq, dt, 'rear', rear FROM d),
ch1 AS (SELECT *, raw AS travel, raw - lag(raw) OVER (PARTITION BY session_id, channel ORDER BY t_us, seq) AS velocity FROM ch0),
ends AS (SELECT session_id, channel, min(travel) AS lo, max(travel) AS hi, sum(dt) AS al FROM ch1 GROUP BY ALL),
ch AS (SELECT ch1.*, lo, hi, al, CASE WHEN hi > lo THEN (travel - lo) / (hi - lo) * 100 ELSE 0 END AS position FROM ch1 JOIN ends USING (session_id, channel)),
sv0 AS (SELECT *, CASE WHEN velocity >= 0 THEN 1 ELSE -1 END AS sign FROM ch WHERE velocity IS NOT NULL AND dt > 0),
sv AS (SELECT *, sum(dt) OVER (PARTITION BY session_id, channel, sign ORDER BY velocity, seq ROWS UNBOUNDED PRECEDING) AS cum,
  sum(dt) OVER (PARTITION BY session_id, channel, sign) AS tot FROM sv0)"""
_SIGNED = f"""{mode_sql('sm', 'sv', 'session_id, channel, sign', 'velocity', 'dt')},
sgmu AS (SELECT session_id, channel, sign, sum(ln(abs(velocity)) * dt) / sum(dt) AS mu FROM sv WHERE velocity <> 0 GROUP BY ALL),
sgsd AS (SELECT session_id, channel, sign, exp(sqrt(sum(power(ln(abs(velocity)) - mu, 2) * dt) / sum(dt))) AS geometric_sd FROM sv JOIN sgmu USING (session_id, channel, sign)
  WHERE velocity <> 0 GROUP BY ALL),
sgm AS (SELECT session_id, channel, sign, sum(velocity * dt) / sum(dt) AS mean, min(velocity) FILTER (cum >= 0.5 * tot) AS median FROM sv GROUP BY ALL),
sg AS (SELECT * FROM sgm LEFT JOIN sgsd USING (session_id, channel, sign) JOIN sm_m USING (session_id, channel, sign))"""


@query("e14_signed_velocity", f"""WITH {WEIGHTED_SQL}, {_CH}, {_SIGNED}
SELECT session_id, channel, sign, round(mean, 5) AS mean, round(median, 5) AS median, round(mode, 4) AS mode, round(geometric_sd, 5) AS geometric_sd FROM sg""")
def e14(spark, folder):
    df = metrics.signed_velocity(_channels(spark, folder), metrics.KEY)
    return df.select("session_id", "channel", "sign", *[F.round(c, 5).alias(c) for c in ("mean", "median", "geometric_sd")], F.round("mode", 4).alias("mode"))


def _e15_sql() -> str:
    rows = metrics.metric_catalog()
    values = ", ".join(f"({i}, '{m}', '{u}', '{c}', {str(v).lower()})" for i, (m, u, c, v) in enumerate(rows))
    wide = {
        "Session duration": "sum(dt)", "Analog sample count": "count(*)", "Median analog dt": "quantile_cont(dt, 0.5) * 1e6",
        "Minimum travel": "min(travel)", "Maximum travel": "max(travel)", "Used stroke": "max(travel) - min(travel)",
        "Mean position": "sum(position * dt) / sum(dt)", "Peak compression velocity": "max(velocity)", "Peak rebound velocity": "min(velocity)",
        "RMS velocity": "sqrt(avg(velocity * velocity))",
        "Time in bottom 10%": "100.0 * sum(CASE WHEN travel <= lo + 0.1 * (hi - lo) THEN dt ELSE 0 END) / sum(dt)",
        "Time in top 10%": "100.0 * sum(CASE WHEN travel >= hi - 0.1 * (hi - lo) THEN dt ELSE 0 END) / sum(dt)",
        "Raw count span": "max(raw) - min(raw)", "ADC span used": "100.0 * (max(raw) - min(raw)) / 4095",
        "ADC rail-near low": "count(*) FILTER (raw <= 82)", "ADC rail-near high": "count(*) FILTER (raw >= 4013)",
    }
    parts = [f"SELECT session_id, channel, '{m}' AS metric, ({e})::DOUBLE AS value FROM ch GROUP BY session_id, channel" for m, e in wide.items()]
    parts.append("SELECT session_id, channel, 'Mode position', mode FROM pm_m")
    parts.append("SELECT session_id, channel, 'Median position', min(position) FILTER (cum >= 0.5 * al) FROM pq GROUP BY session_id, channel")
    parts.append("SELECT session_id, channel, 'Position geometric SD', exp(sqrt(sum(power(ln(position) - mu, 2) * dt) / sum(dt))) FROM ch JOIN pmu USING (session_id, channel) WHERE position > 0 GROUP BY session_id, channel")
    for b in range(10):
        name, test = f"P{b * 10}-{b * 10 + 10}", f"least(floor({{}} / 10), 9) = {b}"
        parts.append(f"SELECT session_id, channel, 'Position {name}', 100.0 * sum(CASE WHEN {test.format('position')} THEN dt ELSE 0 END) / sum(dt) FROM ch GROUP BY session_id, channel")
        for label, sign in metrics.SIGNS.items():
            parts.append(f"SELECT session_id, channel, '{label} velocity {name}', 100.0 * sum(CASE WHEN {test.format('vp')} THEN dt ELSE 0 END) / max(al) FROM vp WHERE sign = {sign} GROUP BY session_id, channel")
    for label, sign in metrics.SIGNS.items():
        low = label.lower()
        for metric, column in ((f"Mean {low} velocity", "mean"), (f"Median {low} velocity", "median"), (f"Mode {low} velocity", "mode"), (f"{label} velocity geometric SD", "geometric_sd")):
            parts.append(f"SELECT session_id, channel, '{metric}', {column} FROM sg WHERE sign = {sign}")
    union = "\nUNION ALL ".join(parts)
    return f"""WITH {WEIGHTED_SQL}, {_CH}, {_SIGNED}, {mode_sql('pm', 'ch', 'session_id, channel', 'position', 'dt', '0.0', '100.0')},
pmu AS (SELECT session_id, channel, sum(ln(position) * dt) / sum(dt) AS mu FROM ch WHERE position > 0 GROUP BY ALL),
pq AS (SELECT *, sum(dt) OVER (PARTITION BY session_id, channel ORDER BY position, seq ROWS UNBOUNDED PRECEDING) AS cum FROM ch),
ve AS (SELECT session_id, channel, sign, min(velocity) AS vlo, max(velocity) AS vhi FROM sv GROUP BY ALL),
vp AS (SELECT sv.*, CASE WHEN vhi > vlo THEN (velocity - vlo) / (vhi - vlo) * 100 ELSE 0 END AS vp FROM sv JOIN ve USING (session_id, channel, sign)),
val AS ({union}),
cat(place, metric, units, category, visible) AS (VALUES {values})
SELECT e.session_id, e.channel, cat.place, cat.metric, units, category, visible, round(value, 4) AS value
FROM ends e CROSS JOIN cat LEFT JOIN val v ON v.session_id = e.session_id AND v.channel = e.channel AND v.metric = cat.metric"""


@query("e15_channel_metrics", _e15_sql())
def e15(spark, folder):
    return rounded(metrics.channel_metrics(_channels(spark, folder)), 4)


@query("e16_adc_health", f"""WITH {WEIGHTED_SQL}, {_CH} SELECT session_id, channel, max(raw) - min(raw) AS raw_span, round(100.0 * (max(raw) - min(raw)) / 511, 6) AS adc_span_pct,
  count(*) FILTER (raw <= 10) AS rail_low, count(*) FILTER (raw >= 501) AS rail_high FROM ch GROUP BY ALL""")
def e16(spark, folder):
    return rounded(metrics.adc_health(_channels(spark, folder), 9, metrics.KEY))


_BAL = WEIGHTED_SQL + """,
m AS (SELECT session_id, min(front) AS fl, max(front) AS fh, min(rear) AS rl, max(rear) AS rh FROM d GROUP BY session_id),
p AS (SELECT d.*, CASE WHEN fh > fl THEN (front - fl) / (fh - fl) * 100 ELSE 0 END AS f, CASE WHEN rh > rl THEN (rear - rl) / (rh - rl) * 100 ELSE 0 END AS r FROM d JOIN m USING (session_id)),
b AS (SELECT *, f - r AS bal, f + r >= 10 AS act, CASE WHEN f + r >= 10 THEN 100.0 * f / (f + r) END AS share FROM p)"""


@query("e18_balance", f"""WITH {_BAL}
SELECT session_id, round(sum(bal * dt) / sum(dt), 5) AS mean_balance_pct, round(sqrt(sum(bal * bal * dt) / sum(dt)), 5) AS rms_balance_pct,
  round(sum(share * dt) FILTER (act) / sum(dt) FILTER (act), 5) AS mean_front_share_pct, round(corr(f, r), 5) AS correlation,
  round(sum(dt) FILTER (act), 5) AS active_time, round(100.0 * coalesce(sum(dt) FILTER (act AND bal > 10), 0) / sum(dt) FILTER (act), 5) AS front_bias_time_pct,
  round(100.0 * coalesce(sum(dt) FILTER (act AND bal < -10), 0) / sum(dt) FILTER (act), 5) AS rear_bias_time_pct,
  round(100.0 * coalesce(sum(dt) FILTER (act AND abs(bal) <= 10), 0) / sum(dt) FILTER (act), 5) AS neutral_time_pct FROM b GROUP BY session_id""")
def e18(spark, folder):
    return rounded(metrics.balance_summary(metrics.balance_rows(weighted_samples(spark, folder))), 5)


@query("e19_correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag")
def e19(spark, folder):
    df = table(spark, folder, "lineitem")
    return rounded(df.groupBy("l_returnflag").agg(stats.correlation(F.col("l_quantity"), F.col("l_extendedprice")).alias("r")))


def crossing_summary(df, value, threshold, by=("session_id",)):
    """Runs above a threshold in the rows as they stand, their time and share of all time."""
    w = series.in_order(by)
    rows = df.withColumn("__on", F.coalesce(value >= threshold, F.lit(False)))
    rows = rows.withColumn("__rise", F.col("__on") & ~F.coalesce(F.lag("__on").over(w), F.lit(False)))
    return rows.groupBy(*by).agg(
        F.count_if("__rise").alias("events"), stats.time_where(F.col("__on"), F.col("dt")).alias("time"),
        stats.share_where(F.col("__on"), F.col("dt")).alias("time_pct"),
    )


@query("e24_threshold_crossings", f"""WITH {WEIGHTED_SQL}, o AS (SELECT *, rear >= 85 AS act FROM d),
e AS (SELECT *, act AND NOT coalesce(lag(act) {_W}, false) AS rise FROM o)
SELECT session_id, count(*) FILTER (rise) AS events, round(coalesce(sum(dt) FILTER (act), 0), 6) AS time, round(100.0 * coalesce(sum(dt) FILTER (act), 0) / sum(dt), 6) AS time_pct
FROM e GROUP BY session_id""")
def e24(spark, folder):
    return rounded(crossing_summary(weighted_samples(spark, folder), F.col("rear"), 85))


@query("e25_longest_run", f"""WITH {WEIGHTED_SQL}, k AS (SELECT *, front > 60 AS m FROM d), e AS (SELECT *, CASE WHEN m <> lag(m) {_W} THEN 1 ELSE 0 END AS x FROM k),
r AS (SELECT *, sum(x) {_W} AS run FROM e), t AS (SELECT session_id, run, sum(dt) AS dur FROM r WHERE m GROUP BY ALL)
SELECT session_id, count(*) AS runs, round(max(dur), 6) AS longest FROM t GROUP BY session_id""")
def e25(spark, folder):
    df = weighted_samples(spark, folder).withColumn("m", F.col("front") > 60)
    found = islands.runs(df, "m", [F.sum("dt").alias("dur")])
    return rounded(found.groupBy("session_id").agg(F.count("*").alias("runs"), F.max("dur").alias("longest")))


@query("e35_shared_range", f"WITH {WEIGHTED_SQL}, {_CH} SELECT channel, round(coalesce(nullif(max(abs(velocity)), 0), 1), 6) AS reach FROM ch GROUP BY channel")
def e35(spark, folder):
    df = _channels(spark, folder).groupBy("channel").agg(F.max(F.abs("velocity")).alias("m"))
    return rounded(df.select("channel", F.coalesce(F.nullif("m", F.lit(0.0)), F.lit(1.0)).alias("reach")))


@query("e38_display_intensity", f"""WITH {WEIGHTED_SQL}, c AS (SELECT session_id, {bin_sql('rear', '0.0', '100.0', 10)} AS bin, sum(dt) AS t FROM d GROUP BY ALL)
SELECT session_id, bin, round(sqrt(t), 6) AS root, round(log10(greatest(t, min(CASE WHEN t > 0 THEN t END) OVER (PARTITION BY session_id))), 6) AS log FROM c""")
def e38(spark, folder):
    df = weighted_samples(spark, folder).withColumn("bin", hist.bin_index(F.col("rear"), F.lit(0.0), F.lit(100.0), 10))
    cells = df.groupBy("session_id", "bin").agg(F.sum("dt").alias("t"))
    return rounded(cells.select("session_id", "bin", *[hist.display_intensity(F.col("t"), k, ["session_id"]).alias(n) for n, k in (("root", "sqrt"), ("log", "log"))]))
