"""Operators for sessions of any length against the plain ones, and quantiles found by narrowing."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strokeflow.operators import asof, islands, long, series, stats
from strokeflow.streaming import logs as streams

ROWS = 7


@pytest.fixture(scope="module")
def samples(spark):
    """A long session in bursts with ties and missing values, short ones, one of a single time and one of one sample."""
    r = random.Random(3)
    rows, t = [], 0
    for i in range(300):
        t += r.choice([0, 1, 1, 2, 500])
        rows.append(("hot", i, t, t / 10, r.choice([None, 1.0, 2.5, -3.0, 8.0]), r.choice([0, 0, 0, 1, 2]), r.random() < 0.8))
    for s in ("a", "b"):
        rows += [(s, i, i * 3, i * 0.3, r.choice([None, 1.0, -2.0]), r.choice([0, 1]), r.random() < 0.7) for i in range(9)]
    rows += [("flat", i, 5, 0.5, float(i % 3), i % 2, True) for i in range(20)] + [("one", 0, 1, 0.1, 2.0, 1, True), (None, 0, 1, 0.1, 2.0, 1, True), (None, 1, 2, 0.2, None, 0, True)]
    df = spark.createDataFrame(rows, "session_id string, seq int, t_us long, t_h double, v double, c int, ok boolean").repartition(5)
    return df.withColumns({"front": F.coalesce("v", F.lit(0.5)), "m": F.col("v") > 0})


def same(a, b, *columns):
    key = ["session_id", "seq", *columns]
    cell = lambda x: round(x, 6) if isinstance(x, float) else x
    rows = [sorted((str(tuple(map(cell, r))) for r in df.select(*key).collect())) for df in (a, b)]
    assert rows[0] == rows[1] and rows[0]


@pytest.mark.parametrize("name, halo", [("average", 3), ("known", 3), ("sum", 3), ("slope", 1), ("central", 1), ("sign", 1), ("rough", 4)])
def test_windows_on_chunks(samples, name, halo):
    def apply(d, by, order):
        if name == "rough":
            return series.roughness(d, "front", "x", 5, by, order)
        made = {
            "average": lambda: series.moving_average(F.col("front"), 7, by, order), "known": lambda: series.moving_average_known(F.col("v"), 7, by, order),
            "sum": lambda: series.rolling_sum(F.col("front"), 7, by, order), "slope": lambda: series.gradient(F.col("front"), F.col("t_h") + F.col("seq"), by, order),
            "central": lambda: series.central_difference(F.col("front"), F.col("t_h"), by, order), "sign": lambda: series.sign_change(F.col("v"), by, order),
        }
        return d.withColumn("x", made[name]())

    for rows in (1, ROWS, 1000):
        same(long.windowed(samples, apply, halo, rows=rows), apply(samples, series.BY, series.ORDER), "x")


@pytest.mark.parametrize("rows", [1, ROWS, 1000])
def test_runs_on_chunks(samples, rows):
    aggs = [F.min("seq").alias("seq"), F.count("*").alias("n")]
    same(long.runs(samples, "m", aggs, rows=rows), islands.runs(samples, "m", aggs), "n", "run_no")
    same(long.fill_gaps(samples, "m", "x", 2, rows=rows), islands.fill_gaps(samples, "m", "x", 2), "x")
    same(long.keep_long(samples, "m", "x", 3, rows=rows), islands.keep_long(samples, "m", "x", 3), "x")
    same(long.segment_ids(samples, ["c", "m"], F.col("ok"), "x", rows=rows), islands.segment_ids(samples, ["c", "m"], F.col("ok"), "x"), "x")


@pytest.mark.parametrize("rows", [2, ROWS])
def test_absorbing_and_slopes_on_chunks(samples, rows):
    same(long.absorb_short(samples, "c", F.col("ok"), "x", 2, 9, rows=rows), islands.absorb_short(samples, "c", F.col("ok"), "x", 2, 9), "x")
    df = samples.withColumn("t_h", F.col("t_h") + F.col("seq"))
    same(long.gradient_in_runs(df, "v", "t_h", "x", rows=rows), series.gradient_in_runs(df, "v", "t_h", "x"), "x")
    same(long.gradient_bridged(df, "v", "t_h", "x", rows=rows), series.gradient_bridged(df, "v", "t_h", "x"), "x")


@pytest.mark.parametrize("rows", [1, ROWS])
def test_alignment_on_chunks(samples, rows):
    df = samples.where("session_id <> 'flat'").withColumn("t_h", F.col("t_h") + F.col("seq"))
    base, pulses = df.select("session_id", "seq", "t_h"), df.where("c = 0").select("session_id", "t_h", F.col("v").alias("w"), F.lit(1.5).alias("p"))
    same(long.hold_with_timeout(base, pulses, "t_h", "w", "p", "x", rows=rows), asof.hold_with_timeout(base, pulses, "t_h", "w", "p", "x"), "x", "x_held")
    same(long.interpolate_join(base, pulses, "t_h", "w", "x", rows=rows), asof.interpolate_join(base, pulses, "t_h", "w", "x"), "x")
    same(long.interpolate_gaps(df, "v", "t_h", "x", rows=rows), asof.interpolate_gaps(df, "v", "t_h", "x"), "x")


def test_a_hot_session_is_dealt_to_many_tasks(spark):
    df = spark.range(4000).select(F.when(F.col("id") >= 0, "hot").alias("session_id"), F.col("id").alias("seq"), F.col("id").alias("t_us"), F.rand(1).alias("front"))
    out = long.windowed(df, lambda d, by, o: d.withColumn("x", series.moving_average(F.col("front"), 5, by, o)).withColumn("chunk", F.col(long.CHUNK)), 2, rows=100)
    assert out.select("chunk").distinct().count() == 40 and out.count() == 4000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(session_id[^)]*__chunk", plan) and re.search(r"hashpartitioning\(session_id[^)]*__bucket", plan)


@pytest.mark.parametrize("most", [3, 10**6])
def test_quantiles_by_narrowing(spark, monkeypatch, most):
    monkeypatch.setattr(stats, "SORTED", most)
    r = random.Random(5)
    rows = [("a", i, r.choice([0.0, -1.5, 3.0, r.gauss(0, 100), r.gauss(50, 1e-3), None]), float(r.randint(0, 4))) for i in range(900)]
    rows += [("b", i, 7.0, 1.0) for i in range(50)] + [("c", 0, -2.0, 2.0), ("d", 0, None, 1.0)] + [(None, i, float(i), 1.0) for i in range(30)]
    rows += [("e", i, 10.0 ** r.randint(-300, 300), 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, seq int, v double, w double").repartition(4)
    qs = {"zero": 0.0, "low": 0.03, "mid": 0.5, "high": 0.97, "one": 1.0}
    for f in (stats.weighted_quantiles_inv, stats.weighted_quantiles_interp):
        plain, refined = ({x.g: x for x in f(df, "v", "w", qs, ["g"], ["seq"], **k).collect()} for k in ({}, {"refine": True}))
        assert set(plain) == set(refined) == {"a", "b", "c", "e", None}
        for g, x in plain.items():
            assert list(refined[g])[1:] == pytest.approx(list(x)[1:], rel=1e-9)
    got = {x.g: x for x in stats.linear_percentiles(df, "v", qs, ["g"]).collect()}
    for x in df.where("v is not null").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, qs.values()))).alias("q")).collect():
        assert list(got[x.g])[1:] == pytest.approx(x.q, rel=1e-9)


@pytest.mark.parametrize("rows", [1, 3, 40, 1000])
def test_debouncing_by_jump_pointers(spark, rows):
    r = random.Random(rows)
    times = [("a", t) for t in sorted(r.sample(range(3000), 300))] + [("a", 100_000 + 10 * i) for i in range(60)] + [("b", 5), ("b", 5), ("c", None), (None, 1)]
    df = spark.createDataFrame(times, "session_id string, t_us long")
    want = sorted(map(str, streams.debounce(df, 25).collect()))
    assert want == sorted(map(str, long.debounce(df, 25, rows).collect())) and len(want) > 90


def test_debouncing_calls_python_for_many_chunks_at_once(spark, monkeypatch):
    r = random.Random(7)
    times = spark.createDataFrame([(f"s{i % 400}", r.randrange(10**6)) for i in range(3000)], "session_id string, t_us long")
    want = sorted(map(str, streams.debounce(times, 2000).collect()))
    for most in (100_000, 500):
        monkeypatch.setattr(long, "CALL", most)
        out = long.debounce(times, 2000, 20)
        assert re.search(r"FlatMapGroupsInPandas \[__call", out._jdf.queryExecution().executedPlan().toString())
        assert sorted(map(str, out.collect())) == want


@pytest.mark.parametrize("cuts", [2, 5])
def test_gaps_of_a_stream_however_it_is_cut(spark, tmp_path, cuts):
    r, rows, seq = random.Random(cuts), [], {"a": 0, "b": 7}
    for i in range(120):
        s = r.choice("ab")
        seq[s] += r.choice([1, 1, 1, 2, 5])
        rows.append((s, 10_000_000 + 1000 * i, seq[s], i // 12 % cuts))
    df = spark.createDataFrame(rows, "session_id string, t_us long, seq long, cut int")
    want = sorted(map(str, streams.record_gaps(df).collect()))
    for i in range(cuts):
        df.where(F.col("cut") == i).drop("cut").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for t in (5_000_000_000, 9_000_000_000):
        spark.createDataFrame([("z", t, 0)], "session_id string, t_us long, seq long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("session_id string, t_us long, seq long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = streams.gap_stream(source, "1 second", 60_000).writeStream.format("memory").queryName(f"gaps{cuts}").outputMode("append")
    q.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(200)
    assert want == sorted(map(str, spark.table(f"gaps{cuts}").where("session_id <> 'z'").collect())) and want
