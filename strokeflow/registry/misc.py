"""Queries of sampling, catalogue, configuration and the remaining projections and joins."""

from __future__ import annotations

from pyspark.sql import Window as W

from strokeflow.functions import config
from strokeflow.operators import asof, catalog, hist, intervals, metrics, sample, series, stats
from strokeflow.operators.series import speed_sanity
from strokeflow.plans import context
from strokeflow.registry import breakdown
from strokeflow.registry.base import F, SAMPLES_SQL, SQL, WEIGHTED_SQL, event_samples, query, rounded, table, weighted_samples
from strokeflow.registry.breakdown import CLASS_BASE
from strokeflow.registry.stats import _channels
from strokeflow.sources.scratch import scratch_folder, stored
from strokeflow.streaming import logs as streams

_W = "OVER (PARTITION BY session_id ORDER BY t_us, seq)"
KEY = ["session_id", "seq"]


@query("b8_speed_sanity", f"WITH {SAMPLES_SQL} SELECT session_id, seq, CASE WHEN front BETWEEN 0 AND 200 THEN front END AS speed, front AS speed_raw, NOT front BETWEEN 0 AND 200 AS rejected FROM s")
def b8(spark, folder):
    df = speed_sanity(event_samples(spark, folder).withColumn("speed", F.col("front")), "speed", 200.0)
    return df.select(*KEY, "speed", "speed_raw", "rejected")


@query("b10_time_selection", f"""WITH {SAMPLES_SQL}, z AS (SELECT session_id, min(t_h) + 300 AS a, min(t_h) + 100 AS b FROM s GROUP BY session_id)
SELECT s.session_id, seq FROM s JOIN z USING (session_id) WHERE t_h BETWEEN least(a, b) AND greatest(a, b)""")
def b10(spark, folder):
    df = event_samples(spark, folder)
    df = series.per_session(df, [(F.min("t_h") + 300).alias("a"), (F.min("t_h") + 100).alias("b")])
    return df.where(F.col("t_h").between(F.least("a", "b"), F.greatest("a", "b"))).select(*KEY)


@query("b12_status_highlights", f"WITH {SAMPLES_SQL} SELECT session_id, code, count(*) AS n, min(t_us) AS first_us, max(t_us) AS last_us FROM s WHERE code NOT IN ('view', 'click', 'signup') GROUP BY ALL")
def b12(spark, folder):
    df = event_samples(spark, folder).where(~F.col("code").isin("view", "click", "signup"))
    return df.groupBy("session_id", "code").agg(F.count("*").alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))


@query("a12_tag_counts", f"WITH {SAMPLES_SQL} SELECT session_id, code, count(*) AS n FROM s GROUP BY ALL")
def a12(spark, folder):
    return event_samples(spark, folder).groupBy("session_id", "code").agg(F.count("*").alias("n"))


@query("a13_inspect_first", f"WITH {SAMPLES_SQL}, r AS (SELECT *, row_number() {_W} AS place FROM s) SELECT session_id, place::INTEGER AS place, seq, code FROM r WHERE place <= 12")
def a13(spark, folder):
    df = event_samples(spark, folder).withColumn("place", F.row_number().over(series.in_order()))
    return df.where("place <= 12").select("session_id", "place", "seq", "code")


@query("k4_lost_records", f"WITH {SAMPLES_SQL}, g AS (SELECT *, seq - lag(seq) {_W} - 1 AS gap FROM s) SELECT session_id, coalesce(sum(greatest(gap, 0)), 0)::BIGINT AS lost FROM g GROUP BY session_id")
def k4(spark, folder):
    df = event_samples(spark, folder)
    lost = streams.record_gaps(df).groupBy("session_id").agg(F.sum("lost").alias("lost"))
    return df.select("session_id").distinct().join(lost, "session_id", "left").fillna(0, ["lost"])


_DAY = 86_400_000_000
_FAULTS = f"WITH {SAMPLES_SQL} SELECT session_id{{text}} AS session_id, code, t_us // 86400000000 AS day, count(*) AS n, sum(rear) AS total FROM s WHERE code = 'error' GROUP BY ALL"


def _faults(status):
    df = status.where("code = 'error'").withColumn("event_time", F.timestamp_micros("t_us"))
    found = streams.fault_counts(df, window="1 day", late="5 hours", name="code", value="rear")
    day = F.expr(f"unix_micros(window.start) div {_DAY}")
    return found.select("session_id", "code", day.alias("day"), F.col("reports").alias("n"), F.col("faults").alias("total"))


@query("k3_fault_windows", _FAULTS.replace("{text}", ""))
def k3(spark, folder):
    return _faults(event_samples(spark, folder))


def _replayed(spark, folder, apply):
    """The events as a stream of four files, each event up to four hours late, through ``apply``; then rows that close it."""
    place = scratch_folder(spark, "replay")
    late = F.col("t_us") + F.col("seq") % 5 * 3_600_000_000
    rows = event_samples(spark, folder).select(F.col("session_id").cast("string").alias("session_id"), "t_us", "seq", "code", "rear").withColumn("at", late)
    rows = stored(rows, "replayed")  # read five times
    low, high = rows.agg(F.min("at"), F.max("at")).first()
    for i in range(4):
        part = F.least(F.floor((F.col("at") - low) * 4 / max(high - low, 1)), F.lit(3)) == i
        rows.where(part).drop("at").repartition(1).write.mode("append").parquet(f"{place}/in")
    for i in (1, 2):
        end = [("", high + 10 * i * _DAY, 0, "error", 0.0)]
        spark.createDataFrame(end, rows.drop("at").schema).coalesce(1).write.mode("append").parquet(f"{place}/in")
    source = spark.readStream.schema(rows.drop("at").schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    out = apply(source)
    sink = out.writeStream.format("parquet").option("checkpointLocation", f"{place}/checkpoint").outputMode("append")
    sink.trigger(availableNow=True).start(f"{place}/out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/out").where("session_id <> ''")


@query("k3_fault_stream", _FAULTS.replace("{text}", "::VARCHAR"))
def k3_stream(spark, folder):
    return _replayed(spark, folder, _faults)


@query("k4_gap_stream", f"WITH {SAMPLES_SQL}, g AS (SELECT session_id::VARCHAR AS session_id, lag(seq) {_W} AS after_seq, seq AS next_seq FROM s) SELECT *, next_seq - after_seq - 1 AS lost FROM g WHERE next_seq - after_seq > 1")
def k4_stream(spark, folder):
    return _replayed(spark, folder, lambda source: streams.gap_stream(source, "5 hours"))


@query("d3_single_source_interp", f"""WITH {SAMPLES_SQL}, q AS (SELECT session_id, min(t_h) AS t1, arg_min(rear, t_us) AS v FROM s WHERE code = 'signup' GROUP BY session_id)
SELECT s.session_id, s.seq, CASE WHEN abs(t_h - t1) <= 1e-8 + 1e-5 * abs(t1) THEN v END AS v FROM s LEFT JOIN q USING (session_id)""")
def d3(spark, folder):
    """A source of one sample matches only samples at (almost) its own time."""
    df = event_samples(spark, folder)
    one = df.where("code = 'signup'").groupBy("session_id").agg(F.min("t_h").alias("t_h"), F.min_by("rear", "t_us").alias("rear"))
    return asof.interpolate_join(df.select(*KEY, "t_h"), one, "t_h", "rear", "v", match_single=True).select(*KEY, "v")


@query("d5_session_config", """SELECT o_orderkey, c_custkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def d5(spark, folder):
    """Rows with the attributes of their session; small dimensions are left to Spark to broadcast by size."""
    orders, customer, nation = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_custkey", "n_name")


@query("d7_channel_pivot", f"""WITH {WEIGHTED_SQL}, u AS (SELECT session_id, 'front' AS channel, front AS v FROM d UNION ALL SELECT session_id, 'rear', rear FROM d)
SELECT session_id, max(v) FILTER (channel = 'front') AS front, max(v) FILTER (channel = 'rear') AS rear FROM u GROUP BY session_id""")
def d7(spark, folder):
    df = _channels(spark, folder)
    return df.groupBy("session_id").pivot("channel", ["front", "rear"]).agg(F.max("raw"))


_TEN = ", ".join(f"max(value) FILTER (turn = {i}) AS s{i:02d}" for i in range(1, 11))


@query("d8_compare_sessions", f"""WITH val AS ({SQL['e15_channel_metrics']}), pk AS (SELECT session_id, row_number() OVER (ORDER BY session_id) AS turn FROM (SELECT DISTINCT user_id AS session_id FROM events))
SELECT channel, metric, units, {_TEN} FROM val JOIN pk USING (session_id) WHERE turn <= 10 AND visible GROUP BY ALL""")
def d8(spark, folder):
    """The visible metrics of ten sessions, which is as many as a comparison takes."""
    df = _channels(spark, folder)
    ten = event_samples(spark, folder).select("session_id").distinct().orderBy("session_id").limit(10)
    labels = ten.select("session_id", F.format_string("s%02d", F.row_number().over(W.orderBy("session_id"))).alias("label"))
    found = metrics.channel_metrics(df.join(ten, "session_id", "left_semi")).where("visible")
    return rounded(catalog.compare(found, labels), 4)


@query("e30_session_summary", f"""WITH {SAMPLES_SQL} SELECT session_id, count(*) AS rows, count(*) FILTER (code = 'click') AS pulses, min(t_us) AS first_us, max(t_us) AS last_us,
  max(t_us) - min(t_us) AS duration_us, min(front) AS front_min, max(front) AS front_max, min(rear) AS rear_min, max(rear) AS rear_max FROM s GROUP BY session_id""")
def e30(spark, folder):
    return event_samples(spark, folder).groupBy("session_id").agg(
        F.count("*").alias("rows"), F.count_if(F.col("code") == "click").alias("pulses"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"),
        (F.max("t_us") - F.min("t_us")).alias("duration_us"), *[f(c).alias(f"{c}_{n}") for c in ("front", "rear") for n, f in (("min", F.min), ("max", F.max))],
    )


@query("e32_status_counts", f"WITH {SAMPLES_SQL} SELECT session_id, count(DISTINCT code) AS names, bool_or(code = 'purchase') AS clean_close FROM s GROUP BY session_id")
def e32(spark, folder):
    return event_samples(spark, folder).groupBy("session_id").agg(F.count_distinct("code").alias("names"), F.bool_or(F.col("code") == "purchase").alias("clean_close"))


@query("e33_wheel_stats", f"""WITH {SAMPLES_SQL}, p AS (SELECT session_id, front AS v FROM s WHERE code = 'click' UNION ALL SELECT session_id, unnest([0.0, 0.0]) FROM (SELECT DISTINCT session_id FROM s WHERE code = 'click'))
SELECT session_id, count(*) - 2 AS pulses, max(v) AS max_speed, round(avg(v), 6) AS mean_speed FROM p GROUP BY session_id""")
def e33(spark, folder):
    """Speeds of a session's pulses; the curve starts with two points at zero, which the mean includes."""
    pulses = event_samples(spark, folder).where("code = 'click'").select("session_id", F.col("front").alias("v"))
    anchors = pulses.select("session_id").distinct().select("session_id", F.explode(F.array(F.lit(0.0), F.lit(0.0))).alias("v"))
    both = pulses.unionByName(anchors)
    return rounded(both.groupBy("session_id").agg((F.count("*") - 2).alias("pulses"), F.max("v").alias("max_speed"), F.avg("v").alias("mean_speed")))


@query("e34_peak_magnitude", f"WITH {SAMPLES_SQL} SELECT session_id, count(*) AS samples, round(max(sqrt(front * front + rear * rear)), 6) AS peak FROM s WHERE code = 'view' GROUP BY session_id")
def e34(spark, folder):
    df = event_samples(spark, folder).where("code = 'view'")
    return rounded(df.groupBy("session_id").agg(F.count("*").alias("samples"), F.max(F.sqrt(F.col("front") ** 2 + F.col("rear") ** 2)).alias("peak")))


_CAT = """cat AS (SELECT user_id AS session_id, min(epoch_us(ts)) // 1000000 AS start_epoch, strftime(min(ts), '%Y-%m-%d') AS date, 'track ' || (user_id % 3) AS track,
  CASE WHEN user_id % 5 = 0 THEN 'Race setup' ELSE '' END AS set_label, user_id % 5 <> 0 AS set_label_auto FROM events GROUP BY user_id)"""


def _catalog(spark, folder):
    base = event_samples(spark, folder).groupBy("session_id").agg(F.expr("min(t_us) div 1000000").alias("start_epoch"))
    own = base.where("session_id % 5 = 0").select("session_id", catalog.utc_date(F.col("start_epoch")).alias("date"), F.lit(" track 0 ").alias("track"),
                                                  F.lit("Race setup ").alias("set_label"), F.lit(None).cast("string").alias("comment"), F.lit(None).cast("boolean").alias("set_label_auto"))
    df = catalog.merge_metadata(base, own)
    return df.withColumn("track", F.concat(F.lit("track "), (F.col("session_id") % 3).cast("string")))


@query("a25_merge_metadata", f"WITH {_CAT} SELECT session_id, start_epoch, date, track, set_label, '' AS comment, set_label_auto FROM cat")
def a25(spark, folder):
    return _catalog(spark, folder)


@query("e36_catalog_groups", f"WITH {_CAT} SELECT date, track, count(*) AS sessions, count(DISTINCT date) AS days FROM cat GROUP BY ROLLUP (date, track)")
def e36(spark, folder):
    return catalog.grouped(_catalog(spark, folder))


@query("f8_auto_labels", f"""WITH {_CAT} SELECT session_id, date, CASE WHEN NOT set_label_auto THEN set_label ELSE 'Set ' || row_number() OVER (PARTITION BY date ORDER BY start_epoch, session_id) END AS set_label,
  set_label_auto FROM cat""")
def f8(spark, folder):
    return catalog.auto_labels(_catalog(spark, folder)).select("session_id", "date", "set_label", "set_label_auto")


@query("g2_newest_first", f"WITH {_CAT} SELECT session_id, start_epoch FROM cat ORDER BY start_epoch DESC, session_id DESC")
def g2(spark, folder):
    return catalog.newest_first(_catalog(spark, folder).select("session_id", "start_epoch"))


@query("s12_display_label", f"WITH {_CAT} SELECT session_id, concat_ws(' | ', session_id::VARCHAR, date, track, nullif(set_label, '')) AS label FROM cat")
def s12(spark, folder):
    return _catalog(spark, folder).select("session_id", catalog.display_label(*map(F.col, ("session_id", "date", "track", "set_label", "comment"))).alias("label"))


@query("a22_changed_sessions", f"""WITH {SAMPLES_SQL}, c AS (SELECT session_id, count(*) AS n, max(t_us) AS last_us FROM s GROUP BY session_id),
o AS (SELECT session_id, count(*) AS n, max(t_us) AS last_us FROM s WHERE seq % 11 <> 0 GROUP BY session_id) SELECT c.* FROM c ANTI JOIN o USING (session_id, n, last_us)""")
def a22(spark, folder):
    df = event_samples(spark, folder)
    state = lambda x: x.groupBy("session_id").agg(F.count("*").alias("n"), F.max("t_us").alias("last_us"))
    return state(df).join(state(df.where("seq % 11 <> 0")), ["session_id", "n", "last_us"], "left_anti")


@query("a23_stale_sessions", f"""WITH {SAMPLES_SQL}, c AS (SELECT session_id, count(*) AS n, sum(seq)::BIGINT AS total FROM s GROUP BY session_id)
SELECT session_id, sha256('{{"n":' || n || ',"total":' || total || '}}') AS signature FROM c WHERE session_id % 4 <> 0""")
def a23(spark, folder):
    df = event_samples(spark, folder).groupBy("session_id").agg(F.count("*").alias("n"), F.sum("seq").alias("total"))
    df = df.withColumn("signature", catalog.signature("n", "total"))
    return catalog.stale(df, df.where("session_id % 4 = 0").select("session_id", "signature")).select("session_id", "signature")


@query("g8_stride", f"""WITH {SAMPLES_SQL}, r AS (SELECT *, row_number() {_W} - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM s),
k AS (SELECT DISTINCT session_id, floor(x * (n - 1) / 19.0)::BIGINT AS i FROM r, generate_series(0, 19) AS g(x))
SELECT r.session_id, seq FROM r LEFT JOIN k ON r.session_id = k.session_id AND r.i = k.i WHERE n <= 20 OR k.i IS NOT NULL""")
def g8(spark, folder):
    return sample.stride(event_samples(spark, folder), 20).select(*KEY)


@query("g9_keep_extrema", f"""WITH {SAMPLES_SQL}, r AS (SELECT *, row_number() {_W} - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM s),
b AS (SELECT *, ceil((i + 1) * 10.0 / n) - 1 AS b FROM r),
p AS (SELECT session_id, arg_min(i, struct_pack(v := front, i := i)) AS a, arg_min(i, struct_pack(v := -front, i := i)) AS z FROM b GROUP BY session_id, b),
u AS (SELECT session_id, a AS i FROM p UNION SELECT session_id, z FROM p UNION SELECT session_id, 0 FROM p UNION SELECT session_id, n - 1 FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY session_id) AS m FROM u),
k AS (SELECT DISTINCT session_id, floor(x * (m - 1) / 19.0)::BIGINT AS j FROM o, generate_series(0, 19) AS g(x)),
f AS (SELECT o.session_id, o.i FROM o LEFT JOIN k ON o.session_id = k.session_id AND o.j = k.j WHERE m <= 20 OR k.j IS NOT NULL)
SELECT r.session_id, r.seq FROM r JOIN f ON r.session_id = f.session_id AND r.i = f.i""")
def g9(spark, folder):
    return sample.keep_extrema(event_samples(spark, folder), ["front"], 20).select(*KEY)


_PICKS = [f"arg_min(i, struct_pack(v := {sign}{c}, i := i)) AS p{n}" for n, (c, sign) in enumerate((c, s) for c in ("front", "rear") for s in ("", "-"))]


@query("g10_keep_extrema_shared", f"""WITH {SAMPLES_SQL}, r AS (SELECT *, row_number() {_W} - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM s),
b AS (SELECT *, ceil((i + 1) * 6.0 / n) - 1 AS b FROM r), p AS (SELECT session_id, {', '.join(_PICKS)} FROM b GROUP BY session_id, b),
u AS (SELECT session_id, unnest([p0, p1, p2, p3]) AS i FROM p UNION SELECT session_id, 0 FROM p UNION SELECT session_id, n - 1 FROM r UNION SELECT session_id, i FROM r WHERE n <= 24),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY session_id) AS m FROM u),
k AS (SELECT DISTINCT session_id, floor(x * (m - 1) / 23.0)::BIGINT AS j FROM o, generate_series(0, 23) AS g(x)),
f AS (SELECT o.session_id, o.i FROM o LEFT JOIN k ON o.session_id = k.session_id AND o.j = k.j WHERE m <= 24 OR k.j IS NOT NULL)
SELECT r.session_id, r.seq FROM r JOIN f ON r.session_id = f.session_id AND r.i = f.i""")
def g10(spark, folder):
    return sample.keep_extrema(event_samples(spark, folder), ["front", "rear"], 24).select(*KEY)


@query("g7_arg_max", f"WITH {SAMPLES_SQL} SELECT session_id, arg_max(seq, struct_pack(f := front, s := seq)) AS seq, max(front) AS front FROM s GROUP BY session_id")
def g7(spark, folder):
    return event_samples(spark, folder).groupBy("session_id").agg(F.max_by("seq", F.struct("front", "seq")).alias("seq"), F.max("front").alias("front"))


#: The five kinds of records of a timeline: event, kind, and the column of its own.
_RECORDS = [("click", "wheel", "speed_kph", "front"), ("view", "imu", "x_raw", "rear"), ("signup", "status", "code", "rear"), ("purchase", "analog", "front_raw", "front"),
            ("error", "config", "analog_rate_hz", "front")]


@query("h1_outer_union", f"WITH {SAMPLES_SQL} " + " UNION ALL ".join(
    f"SELECT '{kind}' AS event_type, session_id, seq, t_us, " + ", ".join(f"{v if k == kind else 'NULL'}::DOUBLE AS {k}_{c}" for _, k, c, v in _RECORDS)
    + f" FROM s WHERE code = '{event}'" for event, kind, _, _ in _RECORDS))
def h1(spark, folder):
    df, out = event_samples(spark, folder), None
    for event, kind, column, value in _RECORDS:
        own = df.where(F.col("code") == event).select(F.lit(kind).alias("event_type"), "session_id", "seq", "t_us", F.col(value).alias(f"{kind}_{column}"))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


@query("h2_bag_union", f"""WITH {SAMPLES_SQL}, u AS (SELECT session_id, front AS v FROM s WHERE front > 50 UNION ALL SELECT session_id, rear FROM s WHERE rear > 50)
SELECT session_id, count(*) AS n, round(quantile_cont(v, 0.99), 6) AS p99 FROM u GROUP BY session_id""")
def h2(spark, folder):
    df = event_samples(spark, folder).select("session_id", F.explode(F.array("front", "rear")).alias("v")).where("v > 50")
    return rounded(df.groupBy("session_id").agg(F.count("*").alias("n"), F.percentile("v", F.lit(0.99)).alias("p99")))


@query("h3_distinct_edges", f"WITH {SAMPLES_SQL} SELECT session_id, array_to_string(list_sort(list(DISTINCT floor(rear / 25)::INTEGER)), ',') AS edges FROM s GROUP BY session_id")
def h3(spark, folder):
    df = event_samples(spark, folder)
    return df.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set(F.floor(F.col("rear") / 25).cast("int"))), ",").alias("edges"))


@query("s1_signed_log", f"WITH {SAMPLES_SQL}, v AS (SELECT session_id, seq, front - 100 AS v FROM s) SELECT session_id, seq, round(sign(v) * log10(1 + abs(v)), 6) + 0.0 AS x FROM v")
def s1(spark, folder):
    df = event_samples(spark, folder)
    x = hist.signed_log(F.col("front") - 100)
    return rounded(df.select(*KEY, x.alias("x")))


@query("s9_normalised_config", f"""WITH {SAMPLES_SQL} SELECT session_id, seq, greatest(0.05, rear / 10 - 1) AS braking, least(greatest(front, 50), 100) AS percentile, least(rear, 60) AS low,
  CASE WHEN front / 2 <= least(rear, 60) THEN least(rear, 60) + 1 ELSE front / 2 END AS high, CASE WHEN code IN ('view', 'click') THEN code ELSE 'view' END AS mode FROM s""")
def s9(spark, folder):
    df, c = event_samples(spark, folder), F.col
    low = F.least("rear", F.lit(60.0))
    return df.select(*KEY, config.clamp(c("rear") / 10 - 1, 1.0, 0.05).alias("braking"), config.clamp(c("front"), 99.0, 50.0, 100.0).alias("percentile"), low.alias("low"),
                     config.above(c("front") / 2, low).alias("high"), config.choice(c("code"), ("view", "click"), "view").alias("mode"))


@query("s10_migrate_config", """SELECT o_orderkey, 10 AS schema_version, 300.0::DOUBLE AS front_full_scale_mm, CASE WHEN o_orderkey % 12 < 10 AND o_orderkey % 3 = 0 THEN 3 WHEN o_orderkey % 3 = 0 THEN 21 ELSE 7 END AS front_filter_window,
  CASE WHEN o_orderkey % 12 < 10 AND o_orderkey % 2 = 0 THEN 400 WHEN o_orderkey % 2 = 0 THEN 100 ELSE 250 END AS travel_bins,
  CASE WHEN o_orderkey % 12 < 10 THEN 'sqrt' ELSE 'log' END AS color_scale, 'linear' AS axis_mode FROM orders""")
def s10(spark, folder):
    k = F.col("o_orderkey")
    df = table(spark, folder, "orders").select(
        "o_orderkey", (k % 12).cast("int").alias("schema_version"), F.lit(315.0).alias("front_full_scale_mm"), F.lit(None).cast("double").alias("front_sensor_mm"),
        F.when(k % 3 == 0, 21).otherwise(7).alias("front_filter_window"), F.lit(21).alias("rear_filter_window"), F.lit("95").alias("front_manual_reference"), F.lit("x").alias("rear_manual_reference"),
        F.when(k % 2 == 0, 100).otherwise(250).alias("travel_bins"), F.lit(120).alias("velocity_bins"), F.lit("log").alias("color_scale"), F.lit("polar").alias("axis_mode"),
    )
    return config.migrate(df).select("o_orderkey", "schema_version", "front_full_scale_mm", "front_filter_window", "travel_bins", "color_scale", "axis_mode")


@query("s13_number_or_ratio", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN round(l_quantity / 8, 6) WHEN l_linenumber % 3 = 1 THEN l_quantity END AS value FROM lineitem""")
def s13(spark, folder):
    n = F.col("l_linenumber")
    text = F.when(n % 3 == 0, F.concat(F.col("l_quantity").cast("string"), F.lit(" / 8"))).when(n % 3 == 1, F.concat(F.lit(" "), F.col("l_quantity").cast("string"))).otherwise("x1")
    return rounded(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", config.number_or_ratio(text).alias("value")))


@query("b3_mm_per_count", f"""WITH {SAMPLES_SQL} SELECT session_id, seq, round(coalesce(CASE WHEN seq % 3 = 0 THEN 0.1 END, CASE WHEN seq % 3 = 1 THEN 635 / 4095.0 END, 300 / 4095.0), 9) AS mm FROM s""")
def b3(spark, folder):
    k = F.col("seq") % 3
    mm = config.mm_per_count(F.when(k == 0, 0.1), F.when(k == 1, 635.0), F.lit(300.0), F.lit(12))
    return rounded(event_samples(spark, folder).select(*KEY, mm.alias("mm")), 9)


@query("e37_time_fraction", f"WITH {WEIGHTED_SQL} SELECT session_id, round(100.0 * sum(CASE WHEN rear >= 50 THEN dt ELSE 0 END) / sum(dt), 6) AS pct FROM d GROUP BY session_id")
def e37(spark, folder):
    return rounded(weighted_samples(spark, folder).groupBy("session_id").agg(stats.share_where(F.col("rear") >= 50, F.col("dt")).alias("pct")))


@query("d11_interval_samples", f"""WITH {SAMPLES_SQL}, v AS (SELECT session_id, seq AS no, t_us AS a, t_us + 86400000000 AS b FROM s WHERE code = 'signup')
SELECT v.session_id, v.no, count(*) AS n, max(front) AS peak FROM v JOIN s ON v.session_id = s.session_id AND s.t_us >= a AND s.t_us < b GROUP BY ALL""")
def d11(spark, folder):
    """Samples of externally given intervals."""
    df = event_samples(spark, folder)
    marks = df.where("code = 'signup'").select("session_id", F.col("seq").alias("no"), F.col("t_us").alias("a"), (F.col("t_us") + 86_400_000_000).alias("b"))
    hit = intervals.samples_within(df, marks, "t_us", "a", "b")
    return hit.groupBy("session_id", "no").agg(F.count("*").alias("n"), F.max("front").alias("peak"))


_SPANS = """v AS (SELECT session_id, seq AS no, code, t_us AS a, t_us + CASE seq % 5 WHEN 0 THEN 0 WHEN 1 THEN 1000000 WHEN 2 THEN 3600000000 WHEN 3 THEN 259200000000 ELSE 3000000000000 END AS b
  FROM s WHERE code IN ('signup', 'click'))"""


@query("d11_overlaps", f"""WITH {SAMPLES_SQL}, {_SPANS}
SELECT x.session_id, x.no, y.no AS other_no, least(x.b, y.b) - greatest(x.a, y.a) AS shared FROM v x JOIN v y ON x.session_id = y.session_id AND x.a < y.b AND y.a < x.b
WHERE x.code = 'signup' AND y.code = 'click' AND x.a < x.b AND y.a < y.b""")
def d11_overlaps(spark, folder):
    """Intervals from nothing to a month that overlap others: pairs and the time that they share."""
    seq, df = F.col("seq"), event_samples(spark, folder)
    length = F.when(seq % 5 == 0, 0).when(seq % 5 == 1, 1_000_000).when(seq % 5 == 2, 3_600_000_000).when(seq % 5 == 3, 259_200_000_000).otherwise(3_000_000_000_000)
    spans = df.select("session_id", seq.alias("no"), "code", F.col("t_us").alias("a"), (F.col("t_us") + length).alias("b"))
    pairs = intervals.overlapping(spans.where("code = 'signup'"), spans.where("code = 'click'"), "a", "b")
    return pairs.select("session_id", "no", "other_no", (F.least("b", "other_b") - F.greatest("a", "other_a")).alias("shared"))


@query("d12_calibration_template", """SELECT c_custkey, c_name, t.c_nationkey, t.c_mktsegment, c_acctbal
FROM customer, (SELECT c_nationkey, c_mktsegment FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1) t""")
def d12(spark, folder):
    """Two fields of one configuration for all; the others stay."""
    configs = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")
    template = configs.orderBy(F.desc("c_acctbal"), "c_custkey").limit(1)
    return catalog.apply_template(configs, template, ["c_nationkey", "c_mktsegment"])


@query("c15_derived_series", f"""WITH {WEIGHTED_SQL}, u AS (SELECT session_id, t_us, seq, t_h, 'front' AS channel, front AS v FROM d UNION ALL SELECT session_id, t_us, seq, t_h, 'rear', rear FROM d),
r AS (SELECT *, row_number() OVER w AS rn FROM u WINDOW w AS (PARTITION BY session_id, channel ORDER BY t_us, seq)),
z AS (SELECT session_id, channel, round_even(quantile_cont(v, 0.5), 0) AS zero FROM r WHERE rn <= 25 GROUP BY ALL),
t AS (SELECT r.*, v - zero AS travel FROM r JOIN z USING (session_id, channel)),
m AS (SELECT session_id, channel, min(travel) AS lo, max(travel) AS hi FROM t GROUP BY ALL),
x AS (SELECT *, (sum(travel) OVER (PARTITION BY session_id, channel ORDER BY t_us, seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)
  + CASE WHEN rn = 1 THEN travel ELSE 0 END + CASE WHEN lead(travel) OVER (PARTITION BY session_id, channel ORDER BY t_us, seq) IS NULL THEN travel ELSE 0 END) / 3 AS smooth FROM t)
SELECT session_id, channel, seq, travel, round(smooth, 5) AS smooth, round(CASE WHEN hi > lo THEN (travel - lo) / (hi - lo) * 100 ELSE 0 END, 5) AS pct FROM x JOIN m USING (session_id, channel)""")
def c15(spark, folder):
    from strokeflow.plans.derive import derive_channels

    return rounded(derive_channels(event_samples(spark, folder), "t_h", zero_samples=25, window=3).select("session_id", "channel", "seq", "travel", "smooth", "pct"), 5)


def _along(column: str, n: int) -> str:
    """CTEs that interpolate a column of ``q`` at the times of ``c0``, as ``l{n}``."""
    return f"""i{n} AS (SELECT c0.session_id, c0.seq, c0.t_h, a.t_h AS ta, a.{column} AS va FROM c0 ASOF LEFT JOIN q a ON c0.session_id = a.session_id AND c0.t_h >= a.t_h),
j{n} AS (SELECT i.*, b.t_h AS tb, b.{column} AS vb FROM i{n} i ASOF LEFT JOIN q b ON i.session_id = b.session_id AND i.t_h <= b.t_h),
l{n} AS (SELECT j.session_id, seq, CASE WHEN n = 1 THEN CASE WHEN abs(j.t_h - coalesce(ta, tb)) <= 1e-8 + 1e-5 * abs(coalesce(ta, tb)) THEN coalesce(va, vb) END
  WHEN ta IS NOT NULL AND tb IS NOT NULL THEN CASE WHEN tb > ta THEN va + (vb - va) * (j.t_h - ta) / (tb - ta) ELSE va END END AS v FROM j{n} j LEFT JOIN nq USING (session_id))"""


@query("j1_context_dataset", f"""WITH {CLASS_BASE}, q AS (SELECT session_id, t_h, -avg(rear) AS x, avg(front) AS z, avg(rear - front) AS y FROM d WHERE code = 'view' GROUP BY session_id, t_h),
nq AS (SELECT session_id, count(*) AS n FROM q GROUP BY session_id), {_along('x', 1)}, {_along('z', 2)}, {_along('y', 3)},
w AS (SELECT c1.*, l1.v AS longitudinal, l2.v AS vertical, l3.v AS pitch_rate FROM c1 JOIN l1 USING (session_id, seq) JOIN l2 USING (session_id, seq) JOIN l3 USING (session_id, seq))
SELECT session_id, seq, round(speed, 5) AS speed_kph, round(longitudinal, 5) + 0.0 AS longitudinal, round(vertical, 5) AS vertical, round(pitch_rate, 5) + 0.0 AS pitch_rate, round(front_travel, 5) AS front_travel,
round(rear_velocity, 5) + 0.0 AS rear_velocity, round(balance_pct, 5) + 0.0 AS balance_pct, round(front_share_pct, 5) AS front_share_pct FROM w""")
def j1(spark, folder):
    """Samples with held speed, three inertial axes, one of them inverted, and their responses side by side."""
    df = weighted_samples(spark, folder)
    pulses = df.where("code = 'click'").select("session_id", F.col("t_h").alias("t"), F.col("front").alias("v"), series.step("t_h").alias("p"))
    frames = df.where("code = 'view'").select(
        "session_id", F.lit(None).cast("double").alias("estimated"), F.col("t_h").alias("burst"), F.col("rear").alias("accel_x_g"),
        F.col("front").alias("accel_z_g"), (F.col("rear") - F.col("front")).alias("gyro_y_dps"),
    )
    cfg = context.ContextConfig(longitudinal=("accel_x_g", True))
    out = context.context_dataset(breakdown.positions(spark, folder), pulses, frames, cfg)
    return rounded(out.select(*KEY, "speed_kph", "longitudinal", "vertical", "pitch_rate", "front_travel", "rear_velocity", "balance_pct", "front_share_pct"), 5)


@query("j15_shared_histograms", f"""WITH {WEIGHTED_SQL}, g AS (SELECT session_id, sum(dt) AS al FROM d GROUP BY session_id), b AS (SELECT session_id, least(floor(front / 50), 9)::INTEGER AS bin, sum(dt) AS t FROM d
  WHERE front BETWEEN 0 AND 500 GROUP BY ALL) SELECT session_id, bin, round(100.0 * t / al, 6) AS share FROM b JOIN g USING (session_id)""")
def j15(spark, folder):
    out = hist.histogram(weighted_samples(spark, folder), "front", "dt", 10, F.lit(0.0), F.lit(500.0), ["session_id"], relative=True)
    return rounded(out.where("time > 0").select("session_id", "bin", F.col("time").alias("share")))
