"""Steps that many queries share read their input once, and equal the general operators."""

from pyspark.sql import functions as F

from strokeflow.operators import asof, islands, series, stats
from strokeflow.operators import breakdown as classes
from strokeflow.registry import base, breakdown, ingest, more
from strokeflow.sources import exports, logs, published
from strokeflow.streaming import logs as streams

FOLDER = "/root/testdata/sf0.001"


def _counts(df) -> tuple[int, int]:
    plan = df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()
    return plan[0].count("FileScan"), plan[1].count("Exchange ")


def test_samples_of_the_breakdown_are_one_scan_and_one_exchange(spark):
    assert _counts(base.weighted_samples(spark, FOLDER)) == (1, 1)
    assert _counts(breakdown.samples(spark, FOLDER)) == (1, 1)
    assert _counts(breakdown._coverage(spark, FOLDER)) == (1, 1)


def test_state_flags_classify_the_samples_once(spark):
    plan = more.s8(spark, FOLDER)._jdf.queryExecution().sparkPlan().toString()
    assert "events.parquet" not in plan and plan.count("FileScan") <= 4


def test_pulses_among_the_samples_hold_as_pulses_beside_them(spark):
    rows = base.weighted_samples(spark, FOLDER).select("session_id", "t_us", "seq", "t_h", "front", "code")
    # Samples and pulses at one time, too.
    rows = rows.unionByName(rows.where("seq % 7 = 0 and code <> 'click'").withColumn("seq", F.col("seq") - 1_000_000))
    pulses = rows.where("code = 'click'").select("session_id", F.col("t_h").alias("t_h"), F.col("front").alias("v"), series.step("t_h").alias("p"))
    want = asof.hold_with_timeout(rows, pulses, "t_h", "v", "p", "speed").select("session_id", "seq", "speed", "speed_held")
    got = asof.hold_own(rows, F.col("code") == "click", "t_h", "front", "speed").select("session_id", "seq", "speed", "speed_held")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.where("speed_held").count() > 0


def test_gap_stream_calls_python_by_bucket_not_by_session(spark, tmp_path):
    rows = spark.range(4000).selectExpr("concat('s', id % 400) AS session_id", "(id + 1) * 1000000 AS t_us", "id * 2 AS seq").coalesce(1)
    rows.write.parquet(f"{tmp_path}/in")
    schema = "session_id string, t_us long, seq long"
    spark.createDataFrame([("", 10_000_000_000, 0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([("", 20_000_000_000, 1)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = streams.gap_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "1 second", buckets=8)
    q = out.writeStream.format("memory").queryName("bucketed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    # A record of state for each bucket that has rows, whatever the number of sessions.
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 8
    got = {tuple(r) for r in spark.table("bucketed").collect()}
    want = {tuple(r) for r in streams.record_gaps(rows).collect()}
    assert got == want


def test_published_exports_sort_few_rows_in_a_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(published, "ROWS", 200)
    records = ingest._records(spark, FOLDER)
    exports.published_exports(records, f"file://{tmp_path}/published")
    rows = spark.read.parquet(f"file://{tmp_path}/published/timeline").groupBy(F.input_file_name()).count().collect()
    assert len(rows) >= 4 and max(r["count"] for r in rows) < sum(r["count"] for r in rows) / 2
    # Records that know the wraps of their clock are not sorted again for any table.
    stored = records.sparkSession.createDataFrame([], logs.with_wraps(records).schema)
    assert _counts(logs.wheel_table(logs.unwrapped(stored)).select("seq", "t_us"))[1] == 0
    want = {tuple(r) for r in logs.unwrapped(records).select("session_id", "n", "t_us").collect()}
    assert {tuple(r) for r in logs.unwrapped(logs.with_wraps(records)).select("session_id", "n", "t_us").collect()} == want


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_and_gaps_keep_the_samples_in_one_order(spark):
    rows = spark.range(60).selectExpr(
        "id % 3 AS session_id", "id AS t_us", "id AS seq", "double(id) AS t", "CASE WHEN id % 7 < 3 THEN double(id * id) END AS v", "(id div 6) % 5 < 2 AS m", "CASE WHEN id % 11 <> 0 THEN int(id div 9 % 3) END AS code"
    )
    filled = asof.interpolate_gaps(rows, "v", "t", "v")
    assert _plan(islands.keep_long(filled, "m", "long", 3)).count("Sort ") == 1
    assert _plan(islands.absorb_short(filled, "code", F.col("v").isNotNull(), "state", 2, 1)).count("Sort ") == 1
    got = islands.keep_long(rows, "m", "long", 3).orderBy("session_id", "seq").collect()
    for s in range(3):
        mine = [r for r in got if r["session_id"] == s]
        for i, r in enumerate(mine):
            a = b = i
            while a > 0 and mine[a - 1]["m"] == r["m"]:
                a -= 1
            while b + 1 < len(mine) and mine[b + 1]["m"] == r["m"]:
                b += 1
            assert r["long"] == (r["m"] and b - a + 1 >= 3)


def test_a_selection_is_read_and_brought_together_once(spark):
    rows = breakdown.kept(spark, FOLDER)
    assert _counts(classes.selection_summary(rows, ["session_id"], breakdown.CFG)) == (1, 1)
    assert _counts(classes.pack_down(rows, {c: f"pack_{c}" for c in classes.CHANNELS}, breakdown.CFG)) == (1, 1)


def test_quantiles_beside_a_grouping_equal_those_of_their_own_shuffle(spark):
    rows = spark.range(400).selectExpr(
        "id % 9 AS g", "id AS seq", "CASE WHEN id % 5 <> 0 AND id % 9 <> 4 THEN double(id * 37 % 50) END AS a", "double(id * 31 % 23) AS b", "CASE WHEN id % 13 <> 0 THEN double(id % 4) END AS w"
    )
    names = {c: {f"{c}_{100 * q:.0f}": q for q in (0.0, 0.3, 0.5, 0.95, 1.0)} for c in "ab"}
    want = stats.weighted_quantiles_of(rows, {c: (F.lit(True), F.col(c), n) for c, n in names.items()}, "w", ["g"], ["seq"], interp=True)
    beside, aggs = stats.beside_quantiles(rows, names, "w", ["g"], ["seq"])
    got = beside.groupBy("g").agg(*[x.alias(n) for n, x in aggs.items()])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    on_rows, windows = stats.beside_quantiles(rows, names, "w", ["g"], ["seq"], on_rows=True)
    assert {tuple(r) for r in on_rows.withColumns(windows).select(got.columns).collect()} == {tuple(r) for r in got.collect()}


def test_channel_metrics_shuffle_samples_and_never_bins(spark):
    found = more.b13(spark, FOLDER)
    # Samples by channel for the values in order, and rows of channels; no bin of a histogram is a row.
    assert _counts(found)[0] == 2 and _counts(found)[1] <= 4 and "sequence(0, 99" not in _plan(found)


def test_modes_of_bins_are_those_of_a_dense_histogram(spark):
    rows = [([0, 3, 5], [1.0, 2.0, 2.0]), ([99], [4.0]), ([5, 3], [2.0, 2.0]), ([], [])]
    df = spark.createDataFrame([(i, b, w, 0.0, 100.0) for i, (b, w) in enumerate(rows)], "i int, b array<int>, w array<double>, lo double, hi double")
    got = dict(df.select("i", stats.mode_of_bins(100, 2.0, 8)("b", "w", "lo", "hi")).collect())
    # Equal neighbours peak between them, a peak at the edge is not refined, and no weight at all means the lowest bin.
    assert got[1] == 99.5 and got[3] == 0.5 and abs(got[2] - 4.5) < 1e-6 and 3.5 < got[0] < 4.5
