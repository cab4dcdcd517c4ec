"""Session operators on small inputs with known results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strokeflow.functions import config
from strokeflow.operators import asof, braking, breakdown, catalog, hist, intervals, islands, metrics, sample, series, stats


def frame(spark, columns, rows):
    return spark.createDataFrame(rows, columns)


def series_of(spark, values, t=None, **more):
    t = t if t is not None else list(range(len(values)))
    cols = {"v": values, **more}
    rows = [("s", i, i, float(t[i]), *[None if c[i] is None else float(c[i]) for c in cols.values()]) for i in range(len(values))]
    return frame(spark, "session_id string, seq long, t_us long, t double, " + ", ".join(f"{c} double" for c in cols), rows)


def values(df, column, key="seq"):
    return [r[column] for r in df.orderBy(key).collect()]


def test_clock_wrap(spark):
    top = 2**32
    df = frame(spark, "session_id string, n long, t long", [("s", 0, top - 2000), ("s", 1, top - 1000), ("s", 2, 1000), ("s", 3, 3000), ("s", 4, 2500), ("s", 5, 4000)])
    got = values(series.unwrap_clock(df, "t", "u", order=("n",)), "u", "n")
    assert got == [top - 2000, top - 1000, top + 1000, top + 3000, top + 2500, top + 4000]


def test_moving_average_repeats_the_edges(spark):
    v = [1.0, 4.0, 9.0, 2.0, 7.0]
    df = series_of(spark, v)
    for k in (1, 3, 5, 9):
        pad = np.pad(v, k // 2, mode="edge")
        want = np.convolve(pad, np.ones(k) / k, mode="valid")
        assert np.allclose(values(df.withColumn("m", series.moving_average(F.col("v"), k)), "m"), want)


def test_moving_average_of_known_values(spark):
    df = series_of(spark, [None, 2.0, None, None, None, 6.0])
    got = values(df.withColumn("m", series.moving_average_known(F.col("v"), 3)), "m")
    assert got == [2.0, 2.0, 2.0, None, 6.0, 6.0]


def test_gradient_on_uneven_times(spark):
    t, v = [0.0, 1.0, 1.5, 4.0, 4.2], [0.0, 2.0, 1.0, 5.0, 5.5]
    got = values(series_of(spark, v, t).withColumn("g", series.gradient(F.col("v"), F.col("t"))), "g")
    assert np.allclose(got, np.gradient(v, t))
    assert values(series_of(spark, [3.0]).withColumn("g", series.gradient(F.col("v"), F.col("t"))), "g") == [None]


def test_gradients_with_gaps(spark):
    df = series_of(spark, [0.0, 1.0, 4.0, None, 9.0, None, 1.0, 2.0, 3.0])
    assert values(series.gradient_in_runs(df, "v", "t", "g"), "g") == [1.0, 2.0, 3.0, None, None, None, 1.0, 1.0, 1.0]
    known = [0, 1, 2, 4, 6, 7, 8]
    got = values(series.gradient_bridged(df, "v", "t", "g"), "g")
    want = np.gradient([0.0, 1.0, 4.0, 9.0, 1.0, 2.0, 3.0], known)
    assert np.allclose([got[i] for i in known], want) and got[3] is None


def test_time_repair(spark):
    df = frame(spark, "session_id string, seq long, t double", [("a", i, t) for i, t in enumerate([0.0, 1.0, 0.5, 0.6, 3.0])] + [("b", i, float(i)) for i in range(3)])
    got = series.repair_time(df, "t", "u")
    assert values(got.where("session_id = 'a'"), "u") == [0.0, 1.0, 2.0, 3.0, 4.0] or values(got.where("session_id = 'a'"), "u")[2] > 1.0
    assert values(got.where("session_id = 'b'"), "u") == [0.0, 1.0, 2.0]


def test_travel_anchor(spark):
    df = series_of(spark, [90.0, 100.0, 110.0])
    zero = F.lit(0.0)
    assert values(df.withColumn("x", series.calibrate(F.col("v"), zero, 1, F.lit(95.0))), "x") == [-5.0, 5.0, 15.0]
    assert values(df.withColumn("x", series.calibrate(F.col("v"), zero, 1, F.lit(None).cast("double"))), "x") == [90.0, 100.0, 110.0]


def test_runs_and_gaps(spark):
    mask = [True, False, True, True, False, False, False, True, False]
    df = series_of(spark, [1.0] * 9).withColumn("m", F.element_at(F.array(*map(F.lit, mask)), F.col("seq").cast("int") + 1))
    got = islands.runs(df, "m", [F.min("seq").alias("a"), F.max("seq").alias("b")]).orderBy("run_no").collect()
    assert [(r.run_no, r.a, r.b) for r in got] == [(1, 0, 0), (2, 2, 3), (3, 7, 7)]
    assert values(islands.fill_gaps(df, "m", "f", 2), "f") == [True, True, True, True, False, False, False, True, False]
    assert values(islands.keep_long(df, "m", "k", 2), "k") == [False, False, True, True, False, False, False, False, False]


def absorb_by_steps(codes, valid, least, fallback):
    out, n = list(codes), len(codes)
    i = 0
    while i < n:
        if not valid[i]:
            i += 1
            continue
        stop = i
        while stop < n and valid[stop]:
            stop += 1
        runs, a = [], i
        for j in range(i + 1, stop + 1):
            if j == stop or codes[j] != codes[a]:
                runs.append([a, j, codes[a]])
                a = j
        for k, (a, b, code) in enumerate(runs):
            if b - a < least:
                runs[k][2] = runs[k - 1][2] if k else (runs[1][2] if len(runs) > 1 else fallback)
            for j in range(a, b):
                out[j] = runs[k][2]
        i = stop
    return out


def test_short_runs_are_absorbed(spark):
    r = np.random.default_rng(4)
    rows, want = [], {}
    for s in range(60):
        codes, valid = r.integers(0, 3, 25).tolist(), (r.random(25) > 0.15).tolist()
        rows += [(str(s), i, i, c, v) for i, (c, v) in enumerate(zip(codes, valid, strict=True))]
        want[str(s)] = absorb_by_steps(codes, valid, 3, 1)
    df = frame(spark, "session_id string, seq long, t_us long, c int, ok boolean", rows)
    got = islands.absorb_short(df, "c", F.col("ok"), "x", 3, 1).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("seq", "x"))).alias("x"))
    assert {g.session_id: [x.x for x in g.x] for g in got.collect()} == want


def test_hold_with_timeout(spark):
    samples = frame(spark, "session_id string, t double", [("s", i / 2) for i in range(19)])
    pulses = frame(spark, "session_id string, t double, p double, v double", [("s", 1.0, None, None), ("s", 2.0, 1.0, 10.0), ("s", 5.0, 2.0, 20.0), ("s", 7.0, 1.0, 25.0), ("s", 8.0, 1.0, 30.0)])
    got = {r.t: r.speed for r in asof.hold_with_timeout(samples, pulses, "t", "v", "p", "speed").collect()}
    assert [got[t] for t in (0.0, 0.5, 1.5, 2.0, 4.0, 5.0, 7.0, 8.0)] == [0.0, 0.0, None, 10.0, None, 20.0, 25.0, 30.0]


def test_interpolation_join_averages_equal_times(spark):
    samples = frame(spark, "session_id string, t double", [("s", t) for t in (0.0, 1.0, 1.5, 2.0, 4.0, 5.0)] + [("t", 1.0)])
    source = frame(spark, "session_id string, t double, v double", [("s", 1.0, 2.0), ("s", 1.0, 4.0), ("s", 4.0, 9.0), ("s", 3.0, None), ("t", 1.0, 5.0)])
    got = {(r.session_id, r.t): r.x for r in asof.interpolate_join(samples, source, "t", "v", "x").collect()}
    assert [got["s", t] for t in (0.0, 1.0, 1.5, 2.0, 4.0, 5.0)] == [None, 3.0, 4.0, 5.0, 9.0, None] and got["t", 1.0] is None


def test_gaps_are_filled_inside_the_known_span(spark):
    df = series_of(spark, [None, 1.0, None, None, 4.0, None])
    assert values(asof.interpolate_gaps(df, "v", "t", "x"), "x") == [None, 1.0, 2.0, 3.0, 4.0, None]


def channel(spark, travel, velocity, dt=1.0):
    rows = [("s", "front", i, dt, float(t), float(t), float(v)) for i, (t, v) in enumerate(zip(travel, velocity, strict=True))]
    return frame(spark, "session_id string, channel string, seq long, dt double, raw double, travel double, velocity double", rows)


def metrics_of(df, **kw):
    got = metrics.channel_metrics(df, **kw)
    return {r.metric: r.value for r in got.collect()}


def test_channel_metrics_in_counts(spark):
    m = metrics_of(channel(spark, [0, 10, 10, 10, 40], [-20, -10, 0, 10, 20]))
    assert len(m) == 58
    assert m["Mean position"] == pytest.approx(35) and m["Median position"] == pytest.approx(25) and m["Mode position"] == pytest.approx(25.5)
    assert m["Mean compression velocity"] == pytest.approx(10) and m["Median compression velocity"] == pytest.approx(10)
    assert m["Mean rebound velocity"] == pytest.approx(-15) and m["Median rebound velocity"] == pytest.approx(-20)
    assert all(m[f"{s} velocity P{b}"] == pytest.approx(20) for s in ("Compression", "Rebound") for b in ("0-10", "90-100"))
    assert sum(m[f"Position P{a}-{a + 10}"] for a in range(0, 100, 10)) == pytest.approx(100)


def test_channel_metrics_in_percent_of_stroke(spark):
    m = metrics_of(channel(spark, [10, 35, 60, 25], [0, 22, -18, 8]), travel_units="%")
    assert m["Used stroke"] == 50 and m["Mean position"] == pytest.approx(32.5) and m["Median position"] == pytest.approx(25)
    assert all(m[f"Position P{b}"] == pytest.approx(25) for b in ("10-20", "20-30", "30-40", "60-70"))
    m = metrics_of(channel(spark, [-5, 5, 50, 105], [0, 1, 2, 3]), travel_units="%")
    assert m["Mean position"] == pytest.approx(38.75) and m["Position P0-10"] == pytest.approx(50) and m["Position P90-100"] == pytest.approx(25)
    travel = [12] * 4 + [30] * 3 + [31] * 3 + [32] * 3
    assert 29 < metrics_of(channel(spark, travel, [0] * 13), travel_units="%")["Mode position"] < 33


def test_histograms_sum_to_all_time(spark):
    df = channel(spark, [10, 35, 60, 25], [-1200, -80, 40, 1600])
    t = hist.histogram(df, "travel", "dt", 80, F.lit(0.0), F.lit(100.0), ["session_id"], relative=True)
    assert t.count() == 80 and t.agg(F.sum("time")).first()[0] == pytest.approx(100)
    v = hist.velocity_histogram(df, "velocity", "dt", 100, ["session_id"], log=True, relative=True).agg(F.sum("all_time"), F.sum("compression_time"), F.sum("rebound_time")).first()
    assert v[0] == pytest.approx(100) and v[1] + v[2] == pytest.approx(100)


def test_bins_follow_their_edges(spark):
    v = [0.0, 0.1, 0.3, 0.7, 1.0, -0.01, 1.01] + [i / 49 for i in range(50)]
    df = series_of(spark, v)
    got = values(df.withColumn("b", hist.bin_index(F.col("v"), F.lit(0.0), F.lit(1.0), 49)), "b")
    counts, _ = np.histogram(v, bins=49, range=(0.0, 1.0))
    assert got[5] is None and got[6] is None
    assert np.array_equal(np.bincount([x for x in got if x is not None], minlength=49), counts)


def test_weighted_quantiles_differ_on_purpose(spark):
    df = frame(spark, "g int, v double, w double, seq int", [(1, 1.0, 1.0, 1), (1, 2.0, 1.0, 2), (1, 10.0, 2.0, 3), (1, None, 5.0, 4)])
    inv = stats.weighted_quantiles_inv(df, "v", "w", {"m": 0.5, "h": 0.9}, ["g"], ["seq"]).first()
    line = stats.weighted_quantiles_interp(df, "v", "w", {"a": 0.0, "m": 0.75, "h": 1.0}, ["g"], ["seq"]).first()
    assert (inv.m, inv.h) == (2.0, 10.0) and (line.a, line.m, line.h) == (1.0, 6.0, 10.0)


def simple_braking(spark):
    t = np.arange(0, 4.001, 0.01)
    speed = np.where(t < 2, 40.0, np.where(t < 3, 40.0 - 7.2 * (t - 2), 32.8))
    stroke = np.where((t >= 2) & (t < 3), 45.0, 25.0)
    rows = [("s", i, i, float(x), 0.01, float(stroke[i]), 0.0) for i, x in enumerate(t)]
    samples = frame(spark, "session_id string, seq long, t_us long, t double, dt double, stroke double, velocity double", rows)
    pulses = frame(spark, "session_id string, t double, speed double", [("s", float(a), float(b)) for a, b in zip(t, speed, strict=True)])
    cfg = braking.BrakingConfig(smooth=1, threshold_mode="absolute", decel_values=(1.0,), bin_mode="absolute", bin_edges=(0.0, 120.0), selected=("absolute", "1.00 ms2"), gap_samples=10, min_samples_in_event=25)
    return samples, pulses, cfg


def test_braking_dive(spark):
    samples, pulses, cfg = simple_braking(spark)
    report = braking.braking_report(samples, pulses, cfg)
    row = report["metric_rows"].first()
    assert row.loaded_p50 > 40 and abs(row.dive_pct - 20) <= 1 and row.events >= 1
    assert report["status"].first().has_data
    low = braking.BrakingConfig(**{**cfg.__dict__, "min_samples": 1000, "min_events": 10})
    rep = braking.braking_report(samples, pulses, low)
    assert "low loaded samples" in rep["metric_rows"].first().warning and "Low event count" in {r.topic for r in rep["flag_rows"].collect()}


def test_braking_without_wheel_speed_says_why(spark):
    samples, pulses, cfg = simple_braking(spark)
    got = braking.braking_report(samples, pulses.where("false"), cfg)
    assert got["metric_rows"].count() == 0 and "Wheel speed" in got["status"].first().reason


def test_braking_gap_merge(spark):
    t = np.arange(0, 2.001, 0.01)
    on = ((t >= 0.2) & (t < 0.45)) | ((t >= 0.5) & (t < 0.75)) | ((t >= 1.2) & (t < 1.28))
    base = [("s", i, i, float(x), i + 1, 0.01, 40.0, 2.0, 45.0, 1.0, False) for i, x in enumerate(t)]
    df = frame(spark, "session_id string, seq long, t_us long, t double, i int, dt double, speed double, decel double, stroke double, velocity double, topout boolean", base)
    x = df.withColumns({"threshold_no": F.lit(0), "threshold_label": F.lit("x"), "speed_bin": F.lit(1)}).withColumn("braking", F.element_at(F.array(*[F.lit(bool(b)) for b in on]), F.col("i")))
    found = braking.events(x, df, braking.BrakingConfig(gap_samples=10, min_samples_in_event=20)).collect()
    assert len(found) == 1 and found[0].start_t < 0.25 and found[0].end_t > 0.70


def test_breakdown_finds_braking_and_impacts(spark):
    t = np.arange(0, 9, 0.02)
    speed = np.where(t < 3, 10 + 8 * t, np.where(t < 6, 34 - 8 * (t - 3), 12.0))
    front = 50 + 10 * np.sin(6 * t) + np.where((t > 3) & (t < 6), 30, 0)
    k = int(4 / 0.02)
    front[k : k + 4] = [85, 96, 100, 88]
    rear = 40 + 10 * np.cos(6 * t)
    fv, rv = np.gradient(front, t), np.gradient(rear, t)
    rows = [("s", i, i, float(x), 0.02, float(speed[i]), float(front[i]), float(rear[i]), float(fv[i]), float(rv[i]), float(front[i] - rear[i]), 50.0) for i, x in enumerate(t)]
    df = frame(spark, "session_id string, seq long, t_us long, t double, dt double, speed double, front_travel double, rear_travel double, front_velocity double, rear_velocity double, balance_pct double, front_share_pct double", rows)
    cover = frame(spark, "session_id string, usable boolean, imu boolean, front_basis string, rear_basis string", [("s", True, False, "configured", "used")])
    cfg = breakdown.BreakdownConfig(motion_window=25, min_segment=37, repeated_window=21, pack_window=31)
    got = breakdown.breakdown_report(df, cover, cfg)
    states = got["states"].collect()
    assert {"braking", "accelerating"} <= {s.motion for s in states}
    assert {s.state_id for s in states} == {f"S{i + 1:03d}" for i in range(len(states))}
    assert {"bottom_out", "high_compression_velocity"} <= {e.event_type for e in got["events"].collect()}
    assert "impact candidate" in {r.activity for r in got["samples"].select("activity").distinct().collect()}
    titles = [f.title for f in got["findings"].orderBy("place").collect()]
    assert "Braking fork usage high" in titles and titles[0] == "Bottom-out events detected"
    assert got["quality"].where("status = 'warning'").count() == 1 and got["speed_bands"].count() == 5 and got["segments"].count() >= 3


def test_auto_labels_and_order(spark):
    rows = [("a", 1776470400, None), ("b", 1776470500, "Race setup"), ("c", 1776470600, None)]
    base = frame(spark, "session_id string, start_epoch long", [(a, e) for a, e, _ in rows])
    meta = frame(spark, "session_id string, date string, track string, set_label string, comment string, set_label_auto boolean", [("b", " 2026-04-18 ", None, "Race setup", "x", None)])
    got = catalog.auto_labels(catalog.merge_metadata(base, meta)).orderBy("session_id").collect()
    assert [r.set_label for r in got] == ["Set 1", "Race setup", "Set 3"] and {r.date for r in got} == {"2026-04-18"} and got[1].track == ""
    assert [r.session_id for r in catalog.newest_first(base).collect()] == ["c", "b", "a"]
    with pytest.raises(ValueError, match="two"):
        catalog.pick_sessions(base, ["a"])


def test_config_migration_and_parsing(spark):
    df = frame(
        spark, "schema_version int, front_full_scale_mm double, front_sensor_mm double, front_filter_window int, rear_filter_window int, front_manual_reference string,"
        " rear_manual_reference string, travel_bins int, velocity_bins int, color_scale string, axis_mode string",
        [(4, 615.0, None, 21, None, "12.5", "bad", 100, None, "log", "x"), (10, 1.0, 1.0, 21, 7, None, "", 100, 120, "log", "signed_log")],
    )
    a, b = config.migrate(df).collect()
    assert (a.front_full_scale_mm, a.front_sensor_mm, a.front_filter_window, a.rear_filter_window, a.travel_bins, a.velocity_bins, a.color_scale, a.axis_mode) == (300.0, 635.0, 3, 3, 400, 400, "sqrt", "linear")
    assert (a.front_manual_reference, a.rear_manual_reference) == (12.5, None)
    assert (b.front_filter_window, b.rear_filter_window, b.travel_bins, b.color_scale, b.axis_mode) == (21, 7, 100, "log", "signed_log")
    t = frame(spark, "t string", [("315/4035",), (" 2 ",), ("1/0",), ("a",), ("",), ("1/2/3",)])
    assert [r.x for r in t.select(config.number_or_ratio(F.col("t")).alias("x")).collect()] == [315 / 4035, 2.0, None, None, None, None]
    t = frame(spark, "t string", [("1, 2.5,",), ("",), ("1,x",)])
    assert [r.x for r in t.select(config.number_list(F.col("t")).alias("x")).collect()] == [[1.0, 2.5], None, None]


def test_downsampling(spark):
    df = spark.range(10_000).select(F.lit("s").alias("session_id"), F.col("id").alias("seq"), F.col("id").alias("t_us"), F.when(F.col("id") == 123, 0.0).otherwise(20.0).alias("v"))
    got = sample.stride(df, 2500).orderBy("seq").collect()
    assert [r.seq for r in got] == np.linspace(0, 9999, 2500).astype(int).tolist()
    kept = sample.keep_extrema(df, ["v"], 200)
    assert kept.count() <= 200 and kept.agg(F.min("v")).first()[0] == 0.0
    assert sample.stride(df.limit(5), 10).count() == 5


def test_speed_sanity_is_idempotent(spark):
    from strokeflow.registry.misc import speed_sanity

    df = series_of(spark, [10.0, 1200.0, -1.0, None]).withColumnRenamed("v", "speed")
    once = speed_sanity(df, "speed")
    for x in (once, speed_sanity(once, "speed")):
        assert values(x, "speed") == [10.0, None, None, None] and values(x, "rejected") == [False, True, True, False]
        assert values(x, "speed_raw") == [10.0, 1200.0, -1.0, None]


def test_intervals_of_any_length(spark):
    r = random.Random(4)
    times = [(s, i, r.randint(-(10**6), 10**6)) for s in ("a", "b") for i in range(150)] + [("c", 0, 2**53 + 1)]
    spans = [(s, 1000 + i, a, a + r.choice([0, 1, 7, 1000, 2**17 + 1, 10**6, -5])) for s in ("a", "b") for i, a in enumerate(r.randint(-(10**6), 10**6) for _ in range(80))]
    spans += [("a", 1, -(10**6), 10**6), ("c", 1, 0, 2**53 + 2), ("d", 1, 0, 5)]
    samples, marks = spark.createDataFrame(times, "session_id string, i int, t long"), spark.createDataFrame(spans, "session_id string, no int, a long, b long")
    got = sorted((x.session_id, x.no, x.i) for x in intervals.samples_within(samples, marks, "t", "a", "b").collect())
    assert got == sorted((s, no, i) for s, no, a, b in spans for z, i, t in times if s == z and a <= t < b)
    pairs = sorted((x.session_id, x.no, x.other_no) for x in intervals.overlapping(marks, marks, "a", "b").collect())
    assert pairs == sorted((s, n, m) for s, n, a, b in spans for z, m, c, d in spans if s == z and a < b and c < d and a < d and c < b)
