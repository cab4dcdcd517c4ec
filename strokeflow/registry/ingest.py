"""Queries of ingest, export and the opening of sessions: the events of a user are encoded as a binary log,
and read back through the library."""

from __future__ import annotations

import contextlib
import functools

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame

from strokeflow.operators import catalog
from strokeflow.plans import quicklook
from strokeflow.plans.derive import derive_channels
from strokeflow.registry.base import F, SAMPLES_SQL, SQL, event_samples, query, rounded
from strokeflow.registry.more import e31
from strokeflow.sources import exports, logs
from strokeflow.sources.scratch import scratch_folder, stored
from strokeflow.streaming import logs as streams

#: A user's events as log records, after one configuration record. Every kind of record comes from one kind of
#: event; errors become records of an unknown tag or a wrong length. Some users' files are broken.
_LOG = """
WITH e AS (SELECT user_id AS u, event_id AS seq, event_type AS code, epoch_us(ts) AS t, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
             CAST(round(value * 100) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
every AS (SELECT * FROM e UNION ALL SELECT u, 0, 'config', min(t), 0, 0, 0 FROM e GROUP BY u),
named AS (SELECT *, 'LOG' || u AS session_id, t % 4294967296 AS raw_t,
            CASE code WHEN 'config' THEN 'CFG' WHEN 'view' THEN 'ANLG' WHEN 'click' THEN 'WSPD' WHEN 'signup' THEN 'STAT' WHEN 'purchase' THEN 'IMU'
              ELSE CASE WHEN v % 2 = 1 THEN 'XYZ1' ELSE 'ANLG' END END AS tag,
            CASE code WHEN 'config' THEN 36 WHEN 'view' THEN 8 WHEN 'click' THEN 8 WHEN 'signup' THEN 12
              WHEN 'purchase' THEN 54 + CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END ELSE 3 END AS len,
            CASE WHEN u % 13 = 0 THEN 'magic is not STLOG1' WHEN u % 11 = 0 THEN 'payload of the last record is cut short' END AS error FROM every),
good AS (SELECT *, CASE WHEN lag(raw_t) OVER (PARTITION BY u ORDER BY n) - raw_t > 2147483648 THEN 1 ELSE 0 END AS fell FROM named WHERE error IS NULL),
r AS (SELECT *, CAST(raw_t + 4294967296 * sum(fell) OVER (PARTITION BY u ORDER BY n) AS BIGINT) AS t_us, 2.0 + (u % 4) * 0.25 AS circumference FROM good)"""


def _le(x: Column, size: int) -> Column:
    """Little-endian bytes of an integer, as hexadecimal text."""
    digits = F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(256**size))), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])


def session_logs(spark, folder) -> DataFrame:
    """(path, content) of a binary log for each user of ``events``."""
    s = event_samples(spark, folder).select(
        F.col("session_id").alias("u"), "seq", "code", "t_us", F.col("rear").cast("long").alias("k"), F.round(F.col("front") * 100).cast("long").alias("v")
    )
    u, k, v, code, seq = (F.col(c) for c in ("u", "k", "v", "code", "seq"))

    def frame(tag, *axes):
        return F.concat(_le(tag, 1), *[_le(x, 2) for x in axes])

    accel = F.lit(16) + k % 4 * 2 + k % 2
    x = v % 30000 - 15000
    head = [_le(seq, 4), *[_le(F.lit(n), 2) for n in (4, 2, 1, 1)], _le(k, 2), _le(F.lit(0), 2), _le(k % 3, 2), _le(v, 4), _le(F.when(k % 7 == 0, 0).otherwise(v + 8), 4)]
    stamp = F.concat(_le(F.lit(32), 1), _le(v, 4), F.lit("0000"))
    burst = F.concat(*head, frame(accel, x, k * 100, -k), stamp, frame(accel, -x, k * 100, -k), frame(F.lit(8), k, -k, v % 1000), F.when(k % 5 == 0, "0102").otherwise(""))
    payload = (
        F.when(code == "view", F.concat(_le(seq, 4), _le(v % 4096, 2), _le(k * 40, 2)))
        .when(code == "click", F.concat(_le(seq, 4), _le(F.when(k >= 10, v * 100).otherwise(0), 4)))
        .when(code == "signup", F.concat(_le(k % 20, 2), _le(k, 2), _le(v - 20000, 4), _le(k % 4, 4)))
        .when(code == "purchase", burst).otherwise(_le(v, 3))
    )
    tag = F.when(code == "view", "ANLG").when(code == "click", "WSPD").when(code == "signup", "STAT").when(code == "purchase", "IMU ")
    tag = tag.otherwise(F.when(v % 2 == 1, "XYZ1").otherwise("ANLG"))

    def record(tag, payload, flags, seq, t):
        return F.concat(F.hex(tag.cast("binary")), _le(F.length(payload) / 2, 2), _le(flags, 2), _le(seq, 4), _le(t, 4), payload)

    records = s.select("u", "t_us", "seq", record(tag, payload, k, seq, F.col("t_us")).alias("body"))
    whole = records.groupBy("u").agg(F.min("t_us").alias("t0"), F.sort_array(F.collect_list(F.struct("t_us", "seq", "body"))).alias("r"))
    numbers = [(500, 2), (12, 1), (8, 1), (20, 4), (800, 4), (1500, 4), (3000, 4)]
    floats = [_le(F.lit(0x40000000) + u % 4 * 0x100000, 4), _le(F.when(u % 5 == 0, 3).otherwise(4), 2)]
    settings = F.concat(*[_le(F.lit(n), size) for n, size in numbers], *floats, *[_le(F.lit(n), size) for n, size in ((500, 2), (416, 2), (32, 2), (6, 1), (1, 1), (0, 2))])
    plain = logs.FILE_HEADER.pack(logs.MAGIC, 1, 100, 3, 0, b"build", 0, 0, 1, 1, 0, 12, 8, 500, 416, 32, 16, *[0] * 14).hex()
    at = 2 * logs.HEADER_FIELDS["start_epoch"][0]
    magic = F.when(u % 13 == 0, "00").otherwise(plain[:2])
    header = F.concat(magic, F.lit(plain[2:at]), _le(F.expr("t0 div 1000000"), 4), F.lit(plain[at + 8 :]))
    text = F.concat(header, record(F.lit("CFG "), settings, F.lit(0), F.lit(0), F.col("t0")), F.array_join("r.body", ""))
    cut = F.when(u % 11 == 0, F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text)
    return whole.select(F.concat(F.lit("/logs/LOG"), u.cast("string"), F.lit(".BIN")).alias("path"), F.unhex(cut).alias("content"))


def _records(spark, folder) -> DataFrame:
    return logs.read_records(spark, [], files=session_logs(spark, folder))


def _doubles(df: DataFrame, *columns: str) -> DataFrame:
    """Whole numbers that may be null as doubles, as both engines' frames have them."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _good(spark, folder) -> DataFrame:
    return logs.unwrapped(_records(spark, folder))


@query("a1_session_records", f"{_LOG} SELECT session_id, n::DOUBLE AS n, tag, NULL::VARCHAR AS error FROM r UNION ALL SELECT DISTINCT session_id, NULL, NULL, error FROM named WHERE error IS NOT NULL")
def a1(spark, folder):
    return _doubles(_records(spark, folder).select("session_id", "n", "tag", "error"), "n")


def log_files(spark, folder) -> str:
    """The logs as files of a folder in the store that all executors share."""
    place = scratch_folder(spark, "logs")
    logs.write_files(session_logs(spark, folder), place)
    return place


@query("a1_split_logs", f"""{_LOG} SELECT session_id, n::DOUBLE AS n, tag, t_us::DOUBLE AS t_us, CAST(file_size AS DOUBLE) AS file_size, NULL::VARCHAR AS error
FROM (SELECT r.*, CASE WHEN n = 0 THEN sum(16 + len) OVER (PARTITION BY session_id) + 100 END AS file_size FROM (SELECT * FROM r) r)
UNION ALL SELECT DISTINCT session_id, NULL, NULL, NULL, NULL, error FROM named WHERE error IS NOT NULL""")
def a1_split(spark, folder):
    """Ranges of a few records each: most begin in the middle of one."""
    records = stored(logs.read_records(spark, log_files(spark, folder), range_bytes=200), "split-records")
    good = logs.unwrapped(records).select("session_id", "n", "tag", "t_us", "file_size", "error")
    bad = logs.quarantine(records).select("session_id", *[F.lit(None).cast(k).alias(c) for c, k in (("n", "long"), ("tag", "string"), ("t_us", "long"), ("file_size", "long"))], "error")
    return _doubles(good.unionByName(bad), "n", "t_us", "file_size")


@query("a2_session_header", f"""{_LOG} SELECT session_id, 1 AS format_version, min(t) // 1000000 AS start_epoch, 'build' AS build_id, 12 AS analog_resolution_bits, 416 AS imu_rate_hz,
count(*) AS records, CAST(100 + sum(16 + len) AS BIGINT) AS file_size FROM r GROUP BY session_id""")
def a2(spark, folder):
    df = logs.sessions(_records(spark, folder)).withColumn("h", logs.header_fields(F.col("head")))
    return df.select("session_id", "h.format_version", "h.start_epoch", "h.build_id", "h.analog_resolution_bits", "h.imu_rate_hz", "records", "file_size")


@query("a3_record_header", f"{_LOG} SELECT session_id, n, tag, len AS payload_len, k AS flags, seq, raw_t AS t_us FROM r")
def a3(spark, folder):
    df = _records(spark, folder).where("error is null")
    return df.select("session_id", "n", "tag", F.length("payload").alias("payload_len"), "flags", "seq", "t_us")


@query("a4_config_table", f"""{_LOG} SELECT session_id, t_us, 500 AS analog_rate_hz, 12 AS analog_resolution_bits, 8 AS analog_averaging, 20 AS button_debounce_ms, 800 AS button_hold_start_ms,
1500 AS button_hold_stop_ms, 3000 AS reed_debounce_us, circumference AS wheel_circumference_m, CASE WHEN u % 5 = 0 THEN 3 ELSE 4 END AS imu_accel_range_g, 500 AS imu_gyro_range_dps,
416 AS imu_odr_hz, 32 AS imu_watermark_frames, 6 AS imu_fifo_mode, 1 AS imu_timestamp_decimation FROM r WHERE tag = 'CFG'""")
def a4(spark, folder):
    return logs.config_table(_good(spark, folder)).drop("n", "seq", "flags", "t_s")


_NAMES = "CASE k % 20 " + " ".join(f"WHEN {n} THEN '{x}'" for n, x in logs.STATUS_NAMES.items()) + " ELSE 'UNKNOWN_' || (k % 20) END"
_STOPS = "CASE WHEN k % 20 = 9 THEN CASE k % 4 " + " ".join(f"WHEN {n} THEN '{x}'" for n, x in logs.STOP_REASONS.items()) + " ELSE 'UNKNOWN_' || (k % 4) END END"


@query("a5_status_table", f"{_LOG} SELECT session_id, seq, t_us, k % 20 AS code, {_NAMES} AS name, k AS status_flags, v - 20000 AS value0, k % 4 AS value1, {_STOPS} AS stop_reason FROM r WHERE code = 'signup'")
def a5(spark, folder):
    return logs.status_table(_good(spark, folder)).select("session_id", "seq", "t_us", "code", "name", "status_flags", "value0", "value1", "stop_reason")


@query("a6_analog_payload", f"{_LOG} SELECT session_id, seq, t_us, seq AS sample_index, v % 4096 AS front_raw, k * 40 AS rear_raw FROM r WHERE code = 'view'")
def a6(spark, folder):
    return logs.analog_table(_good(spark, folder)).select("session_id", "seq", "t_us", "sample_index", "front_raw", "rear_raw")


_WHEEL = "CASE WHEN k >= 10 THEN v * 100 ELSE 0 END"
_SPEED = f"CASE WHEN {_WHEEL} > 0 THEN circumference / ({_WHEEL} / 1e6) END"


@query("a7_wheel_payload", f"{_LOG} SELECT session_id, seq, t_us, seq AS pulse_count, {_WHEEL} AS interval_us, round({_SPEED} * 3.6, 6) AS speed_kph FROM r WHERE code = 'click'")
def a7(spark, folder):
    return rounded(logs.wheel_table(_good(spark, folder)).select("session_id", "seq", "t_us", "pulse_count", "interval_us", "speed_kph"))


#: The four frames of a burst.
_FRAMES = f"""{_LOG},
f AS (SELECT *, CASE frame_index WHEN 1 THEN 32 WHEN 3 THEN 8 ELSE 16 + k % 4 * 2 + k % 2 END AS tag_raw,
        CASE frame_index WHEN 0 THEN v % 30000 - 15000 WHEN 2 THEN 15000 - v % 30000 WHEN 3 THEN k END AS x_raw,
        CASE frame_index WHEN 1 THEN NULL WHEN 3 THEN -k ELSE k * 100 END AS y_raw, CASE frame_index WHEN 1 THEN NULL WHEN 3 THEN v % 1000 ELSE -k END AS z_raw
      FROM (SELECT *, unnest([0, 1, 2, 3]) AS frame_index FROM r WHERE code = 'purchase'))"""


@query("a8_imu_frames", f"""{_FRAMES} SELECT session_id, seq, frame_index, tag_raw, tag_raw // 8 AS tag_sensor, CASE tag_raw // 8 WHEN 4 THEN 'TIMESTAMP' WHEN 2 THEN 'ACCEL_NC' ELSE 'GYRO_NC' END AS tag_name,
tag_raw // 2 % 4 AS tag_counter, tag_raw % 2 AS tag_parity, (CASE WHEN frame_index > 0 THEN v END)::DOUBLE AS sample_tick, x_raw::DOUBLE AS x_raw, y_raw::DOUBLE AS y_raw, z_raw::DOUBLE AS z_raw FROM f""")
def a8(spark, folder):
    names = ["tag_raw", "tag_sensor", "tag_name", "tag_counter", "tag_parity", "sample_tick", "x_raw", "y_raw", "z_raw"]
    return _doubles(logs.imu_frames(_good(spark, folder)).select("session_id", "seq", "frame_index", *names), *names[-4:])


@query("a9_imu_scaled", f"""{_FRAMES} SELECT session_id, seq, frame_index, {', '.join(f"round(CASE WHEN tag_raw // 8 = 2 AND u % 5 <> 0 THEN {a}_raw * 0.122 / 1000 END, 6) AS accel_{a}_g" for a in 'xyz')},
{', '.join(f"round(CASE WHEN tag_raw // 8 = 1 THEN {a}_raw * 17.5 / 1000 END, 6) AS gyro_{a}_dps" for a in 'xyz')} FROM f""")
def a9(spark, folder):
    scaled = [f"accel_{a}_g" for a in "xyz"] + [f"gyro_{a}_dps" for a in "xyz"]
    return rounded(logs.imu_frames(_good(spark, folder)).select("session_id", "seq", "frame_index", *scaled))


@query("a10_imu_host_time", f"{_FRAMES} SELECT session_id, seq, frame_index, (CASE WHEN frame_index > 0 AND k % 7 <> 0 THEN t_us - 200 END)::DOUBLE AS estimated_t_us FROM f")
def a10(spark, folder):
    return _doubles(logs.imu_frames(_good(spark, folder)).select("session_id", "seq", "frame_index", "estimated_t_us"), "estimated_t_us")


@query("a11_unparsed", f"""{_LOG} SELECT session_id, n, tag, 3 AS raw_len, lower(printf('%02x%02x%02x', v % 256, v // 256 % 256, v // 65536)) AS raw_hex FROM r WHERE code = 'error'""")
def a11(spark, folder):
    return logs.unparsed(_good(spark, folder))


@query("b6_imu_bursts", f"""{_LOG} SELECT session_id, seq, t_us, seq AS burst_index, 4 AS frame_count, 2 AS accel_frames, 1 AS gyro_frames, 1 AS timestamp_frames, k AS fifo_level_before, 0 AS fifo_level_after,
k % 3 AS burst_flags, v AS first_timestamp_raw, (nullif(v, 0) * 25)::DOUBLE AS first_timestamp_us, CASE WHEN k % 7 = 0 THEN 0 ELSE v + 8 END AS last_timestamp_raw, (CASE WHEN k % 7 <> 0 THEN (v + 8) * 25 END)::DOUBLE AS last_timestamp_us
FROM r WHERE code = 'purchase'""")
def b6(spark, folder):
    return _doubles(logs.imu_bursts(_good(spark, folder)).drop("n", "flags", "t_s"), "first_timestamp_us", "last_timestamp_us")


_OPTIONS = {"zero": {"front": 100}, "invert": {"rear": True}, "mm_per_count": {"front": 0.25}}


_WRITTEN: dict[tuple[str, str], str] = {}


def exported(spark, folder) -> str:
    """A folder with the exports of all sessions, written once in an application."""
    key = (spark.conf.get("spark.app.id"), folder)
    if key not in _WRITTEN:
        root = scratch_folder(spark, "exports")
        exports.write_exports(_records(spark, folder), root, by="run", **_OPTIONS)
        _WRITTEN[key] = root
    return _WRITTEN[key]


_POSITIONS = f"""{_LOG}, p AS (SELECT session_id, n, seq, t_us, v % 4096 AS front_raw, v % 4096 - 100 AS front, -(k * 40) AS rear FROM r WHERE code = 'view'),
a AS (SELECT *, t_us - lag(t_us) OVER w AS dt_us, coalesce(lead(t_us) OVER w, t_us) - coalesce(lag(t_us) OVER w, t_us) AS span,
        coalesce(lead(front) OVER w, front) - coalesce(lag(front) OVER w, front) AS df, coalesce(lead(rear) OVER w, rear) - coalesce(lag(rear) OVER w, rear) AS dr
      FROM p WINDOW w AS (PARTITION BY session_id ORDER BY n))"""


@query("a14_export_analog", f"""{_POSITIONS} SELECT session_id, seq, t_us, dt_us::DOUBLE AS dt_us, front_raw, front AS front_position_counts, rear AS rear_position_counts, round(front_raw / 4095, 9) AS front_norm, front * 0.25 AS front_mm,
round(CASE WHEN span > 0 THEN df * 1e6 / span END, 9) AS front_velocity_counts_per_s, round(CASE WHEN span > 0 THEN dr * 1e6 / span END, 9) AS rear_velocity_counts_per_s,
round(CASE WHEN span > 0 THEN df * 1e6 / span END * 0.25, 9) AS front_velocity_mm_per_s, NULL::DOUBLE AS rear_velocity_mm_per_s FROM a""")
def a14(spark, folder):
    df = exports.read_table(spark, exported(spark, folder), "analog")
    velocities = [f"{c}_velocity_{u}_per_s" for c in ("front", "rear") for u in ("counts", "mm")]
    return rounded(_doubles(df, "dt_us").select("session_id", "seq", "t_us", "dt_us", "front_raw", "front_position_counts", "rear_position_counts", "front_norm", "front_mm", *velocities), 9)


@query("a15_optional_scan", f"{_LOG} SELECT session_id, seq, seq AS pulse_count, {_WHEEL} AS interval_us FROM r WHERE code = 'click'")
def a15(spark, folder):
    """A table of the exports, and the same of a folder that is not there."""
    root = exported(spark, folder)
    both = exports.read_table(spark, root, "wheel").unionByName(exports.read_table(spark, f"{root}/nowhere", "wheel"))
    return both.select("session_id", "seq", "pulse_count", "interval_us")


_COUNTS = {"analog_rows": "view", "wheel_rows": "click", "stat_rows": "signup", "imu_burst_rows": "purchase"}
_SUMMARY = ", ".join(f"count(*) FILTER (code = '{code}') AS {c}" for c, code in _COUNTS.items())


@query("a16_summary_scan", f"""{_LOG} SELECT session_id, '/logs/' || session_id || '.BIN' AS source_path, CAST(100 + sum(16 + len) AS BIGINT) AS file_size_bytes, {_SUMMARY}, 4 * count(*) FILTER (code = 'purchase') AS imu_frame_rows,
min(t_us) AS first_host_timestamp_us, max(t_us) AS last_host_timestamp_us, max(t_us) - min(t_us) AS duration_us, min(v % 4096) FILTER (code = 'view') AS front_raw_min, max(k * 40) FILTER (code = 'view') AS rear_raw_max,
count(*) FILTER (tag = 'ANLG') AS analog_records FROM r GROUP BY session_id""")
def a16(spark, folder):
    df = exports.read_summaries(spark, exported(spark, folder))
    timing = [f"timing.{c}" for c in ("first_host_timestamp_us", "last_host_timestamp_us", "duration_us")]
    return df.select("session_id", "source_path", "file_size_bytes", *[f"counts.{c}" for c in catalog.COUNTS], *timing,
                     "analog_extents.front_raw_min", "analog_extents.rear_raw_max", F.coalesce(F.col("record_counts")["ANLG"], F.lit(0)).alias("analog_records"))


@query("a17_timeline_csv", f"""{_FRAMES}, t AS (SELECT session_id, CASE code WHEN 'config' THEN 'config' WHEN 'view' THEN 'analog' WHEN 'click' THEN 'wheel' ELSE 'status' END AS event_type, seq, t_us, code, k, v, NULL AS frame_index
FROM r WHERE code NOT IN ('purchase', 'error') UNION ALL
SELECT session_id, CASE tag_raw // 8 WHEN 4 THEN 'imu_timestamp' WHEN 2 THEN 'imu_accel_nc' ELSE 'imu_gyro_nc' END, seq, CASE WHEN frame_index > 0 AND k % 7 <> 0 THEN t_us - 200 ELSE t_us END, code, k, v, frame_index FROM f)
SELECT session_id, event_type, seq::VARCHAR AS record_seq, t_us::VARCHAR AS host_timestamp_us, coalesce((CASE WHEN code = 'view' THEN v % 4096 END)::VARCHAR, '') AS front_raw,
CASE WHEN code = 'signup' THEN {_NAMES} ELSE '' END AS stat_name, coalesce(frame_index::VARCHAR, '') AS imu_frame_index, CASE WHEN code = 'config' THEN '416' ELSE '' END AS config_imu_odr_hz FROM t""")
def a17(spark, folder):
    """The timeline's fields as they stand in the files."""
    rows = exports.read_timeline(spark, exported(spark, folder))
    fields = ["event_type", "record_seq", "host_timestamp_us", "front_raw", "stat_name", "imu_frame_index", "config_imu_odr_hz"]
    return rows.select("session_id", *[F.coalesce(c, F.lit("")).alias(c) for c in fields])


@query("a18_export_counts", f"""{_LOG}, c AS (SELECT session_id, {_SUMMARY}, count(*) FILTER (code = 'config') AS config_rows, count(*) FILTER (code = 'error') AS lost FROM r GROUP BY session_id)
SELECT session_id, unnest(['analog', 'wheel', 'status', 'imu_bursts', 'imu_frames', 'config', 'timeline']) AS name,
unnest([analog_rows, wheel_rows, stat_rows, imu_burst_rows, 4 * imu_burst_rows, config_rows, analog_rows + wheel_rows + stat_rows + 4 * imu_burst_rows + config_rows]) AS n FROM c""")
def a18(spark, folder):
    """Rows of each session in each exported table, zeros too."""
    root = exported(spark, folder)
    tables = {n: exports.read_table(spark, root, n) for n in exports.TABLES} | {"timeline": exports.read_timeline(spark, root)}
    names = list(tables)
    parts = [df.select("session_id", F.lit(n).alias("name")) for n, df in tables.items()]
    found = functools.reduce(DataFrame.unionAll, parts).groupBy("session_id").pivot("name", names).count()
    return found.select("session_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(n, F.lit(0)).alias("n")) for n in names])).alias("x")).select("session_id", "x.*")


_ZERO = f"""{_LOG}, z AS (SELECT session_id, round_even(quantile_cont(v % 4096, 0.5), 0) AS front, round_even(quantile_cont(k * 40, 0.5), 0) AS rear FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t_us, seq) AS place FROM r WHERE code = 'view') WHERE place <= 250 GROUP BY session_id),
d AS (SELECT r.session_id, channel, seq, CASE channel WHEN 'front' THEN v % 4096 - z.front ELSE k * 40 - z.rear END AS travel FROM r JOIN z USING (session_id), (VALUES ('front'), ('rear')) c(channel) WHERE code = 'view')"""


@query("a19_derived_cache", f"{_ZERO} SELECT session_id, channel, seq, travel FROM d")
def a19(spark, folder):
    """The derived samples, written by session, with those of a third of the sessions written again."""
    cache = scratch_folder(spark, "derived")
    derived = exports.open_sessions(spark, exported(spark, folder))["derived"]
    exports.save_by_run(derived, cache)
    store = exports.save_by_run(derived.where("pmod(crc32(session_id), 3) = 0"), cache)
    return store.read(exports.SAVED).select("session_id", "channel", "seq", "travel")


@query("a21_quicklook_sink", SQL["e31_quicklook"])
def a21(spark, folder):
    """The quicklook as JSON, read back."""
    sink, found = scratch_folder(spark, "quicklook"), e31(spark, folder)
    quicklook.write_quicklook(found, sink)
    return spark.read.schema(found.schema).json(sink)


@query("a24_catalog_scan", f"{_LOG} SELECT session_id, min(t) // 1000000 AS start_epoch, max(t_us) - min(t_us) AS duration_us FROM r GROUP BY session_id")
def a24(spark, folder):
    """All exported sessions with a readable summary, newest first; a broken summary among them."""
    broken = scratch_folder(spark, "broken-summaries")
    spark.range(1).select(F.lit("{not a summary").alias("value")).write.text(broken)
    return catalog.newest_first(exports.read_summaries(spark, exported(spark, folder), broken).select("session_id", "start_epoch", "duration_us"))


@query("a18_exports_in_turn", f"{_LOG} SELECT session_id, 4 * count(*) FILTER (code = 'purchase') AS imu_frame_rows, count(*) FILTER (code = 'view') AS samples FROM r GROUP BY session_id")
def a18_in_turn(spark, folder):
    """The sessions exported a half at a time, and one half once more: tables and catalogue hold them all."""
    root, records = scratch_folder(spark, "exports-in-turn"), stored(_records(spark, folder), "records")
    for i in (0, 1, 0):
        exports.write_exports(records.where(F.pmod(F.crc32("session_id"), F.lit(2)) == i), root, by="run", **_OPTIONS)
    samples = exports.read_table(spark, root, "analog").groupBy("session_id").agg(F.count("*").alias("samples"))
    found = exports.read_summaries(spark, root).select("session_id", "counts.imu_frame_rows")
    return found.join(samples, "session_id", "left").fillna(0, ["samples"])


@query("a23_published_exports", f"""{_LOG} SELECT session_id, CASE WHEN u % 3 = 0 THEN 2 ELSE 1 END AS run, count(*) FILTER (code = 'view') AS samples,
coalesce(CAST(sum(v % 4096 - CASE WHEN u % 3 = 0 THEN 150 ELSE 100 END) FILTER (code = 'view') AS BIGINT), 0) AS counts, count(*) FILTER (code = 'view') AS summary_samples FROM r GROUP BY session_id, u""")
def a23_published(spark, folder):
    """All sessions are exported; then the configuration of a third changes, and only these are exported again."""
    root, records = scratch_folder(spark, "published"), stored(_records(spark, folder), "records")
    front = logs.sessions(records).select("session_id", F.lit("front").alias("channel"), F.lit(100.0).alias("zero"), F.lit(False).alias("invert"), F.lit(0.25).alias("mm_per_count"))
    exports.published_exports(records, root, front)
    changed = F.when(F.regexp_extract("session_id", r"(\d+)", 1).cast("long") % 3 == 0, 150.0).otherwise(F.col("zero"))
    store = exports.published_exports(records, root, front.withColumn("zero", changed))
    sums = store.read("analog").groupBy("session_id").agg(F.count("*").alias("samples"), F.sum("front_position_counts").alias("counts"))
    summaries = store.read("summary").select("session_id", F.col("counts.analog_rows").alias("summary_samples"))
    rows = store.manifest().select("session_id", F.col("run").cast("int").alias("run")).join(sums, "session_id", "left").join(summaries, "session_id", "left")
    return rows.fillna(0, ["samples", "counts"])


@query("a19_derived_reused", f"""{_ZERO} SELECT d.session_id, channel, CASE WHEN CAST(substr(d.session_id, 4) AS BIGINT) % 3 = 0 THEN 2 ELSE 1 END AS run, count(*) AS n,
CAST(sum(travel + CASE WHEN CAST(substr(d.session_id, 4) AS BIGINT) % 3 = 0 AND channel = 'front' THEN z.front - 7 ELSE 0 END) AS DOUBLE) AS travel FROM d JOIN z USING (session_id) GROUP BY ALL""")
def a19_reused(spark, folder):
    """Derived series of all sessions, then with other zeros for a third of them: the rest is read as it was."""
    cache, opened = scratch_folder(spark, "derived-reused"), exports.open_sessions(spark, exported(spark, folder))
    samples = opened["analog"].select("session_id", "t_us", "t_s", "seq", F.col("front_raw").alias("front"), F.col("rear_raw").alias("rear"))

    def derive(some, configs):
        return derive_channels(some, "t_s", window=3, configs=configs.drop("source_path"))

    other = F.when((F.regexp_extract("session_id", r"(\d+)", 1).cast("long") % 3 == 0) & (F.col("channel") == "front"), 7.0).otherwise(F.col("zero"))
    for configs in (opened["configs"], opened["configs"].withColumn("zero", other)):
        store = exports.published_derived(samples, configs, cache, derive)
    found = store.read("derived").groupBy("session_id", "channel").agg(F.count("*").alias("n"), F.sum("travel").alias("travel"))
    return found.join(store.manifest().select("session_id", F.col("run").cast("int").alias("run")), "session_id")


@query("a26_open_exports", f"""{_LOG} SELECT session_id, seq, round(CASE WHEN {_SPEED} * 3.6 <= 200 THEN {_SPEED} * 3.6 END, 6) AS speed_kph, round({_SPEED} * 3.6, 6) AS speed_kph_raw FROM r WHERE code = 'click'""")
def a26(spark, folder):
    return rounded(exports.open_sessions(spark, exported(spark, folder))["wheel"].select("session_id", "seq", "speed_kph", "speed_kph_raw"))


@query("a27_stored_configs", f"""{_ZERO} SELECT session_id, channel, CASE WHEN channel = 'front' AND session_id LIKE '%1' THEN 7.0 WHEN channel = 'front' THEN z.front ELSE z.rear END AS zero,
channel = 'front' AND session_id LIKE '%1' AS invert FROM z, (VALUES ('front'), ('rear')) c(channel)""")
def a27(spark, folder):
    """Configurations of new sessions, some changed and stored, and loaded again."""
    root, store = exported(spark, folder), scratch_folder(spark, "configs")
    first = exports.open_sessions(spark, root)["configs"]
    changed = first.where("session_id like '%1'").withColumns({
        "zero": F.when(F.col("channel") == "front", 7.0).otherwise(F.col("zero")), "invert": F.col("channel") == "front",
    })
    exports.save_by_run(changed, store)
    return exports.open_sessions(spark, root, store)["configs"].select("session_id", "channel", "zero", "invert")


@query("a28_open_by_suffix", f"""{_LOG} SELECT kind, session_id, count(*) FILTER (code = 'view') AS samples, count(*) FILTER (code = 'click') AS pulses FROM r, (VALUES ('export'), ('log')) k(kind) GROUP BY ALL
HAVING samples + pulses > 0""")
def a28(spark, folder):
    """The same sessions opened as logs and as exports."""
    files = session_logs(spark, folder)
    opened = {"log": exports.open_sessions(spark, "/logs/*.BIN", files=files), "export": exports.open_sessions(spark, exported(spark, folder))}
    parts = [
        t[name].select(F.lit(kind).alias("kind"), "session_id", F.lit(int(name == "analog")).alias("a"), F.lit(int(name == "wheel")).alias("w"))
        for kind, t in opened.items() for name in ("analog", "wheel")
    ]
    both = functools.reduce(DataFrame.unionAll, parts)
    return both.groupBy("kind", "session_id").agg(F.sum("a").alias("samples"), F.sum("w").alias("pulses"))


_LEAST = 6 * 3600 * 1_000_000


@query("k2_debounce", f"""WITH RECURSIVE {SAMPLES_SQL}, p AS (SELECT DISTINCT session_id, t_us FROM s),
nxt AS (SELECT a.session_id, a.t_us, min(b.t_us) AS later FROM p a JOIN p b ON a.session_id = b.session_id AND a.t_us + {_LEAST} <= b.t_us GROUP BY ALL),
taken(session_id, t_us, interval_us, pulse_count) AS (
  SELECT session_id, min(t_us), 0::BIGINT, 1::BIGINT FROM p GROUP BY session_id
  UNION ALL SELECT t.session_id, n.later, n.later - t.t_us, t.pulse_count + 1 FROM taken t JOIN nxt n ON t.session_id = n.session_id AND t.t_us = n.t_us)
SELECT session_id::VARCHAR AS session_id, t_us, interval_us, pulse_count FROM taken""")
def k2(spark, folder):
    """Events at least six hours after the last one that was taken."""
    return streams.debounce(event_samples(spark, folder).select("session_id", "t_us"), _LEAST)


#: Users by the remainder of their number by three arrive in three runs. The second breaks off before its commit
#: and is started again; with the third come other files with the names of the first, which are refused.
@query("k1_arrivals", f"""{_LOG}, sums AS (SELECT u, session_id, count(*) AS records, max(error) AS error FROM named GROUP BY u, session_id)
SELECT session_id, u % 3 AS run, 0 AS copy, CASE WHEN error IS NULL THEN records ELSE 0 END AS records, error FROM sums
UNION ALL SELECT session_id, 2, 1, 0, 'another file has this session''s name' FROM sums WHERE u % 3 = 0""")
def k1(spark, folder):
    files = session_logs(spark, folder).withColumn("run", F.regexp_extract("path", r"LOG(\d+)", 1).cast("long") % 3)
    place = scratch_folder(spark, "arrivals")
    store = streams.LogStore(spark, f"{place}/store")

    def run():
        store.start(f"{place}/in", f"{place}/checkpoint").awaitTermination()

    class BreaksOff(streams.LogStore):
        def _put(self, df, name, stream, batch):
            if name == "commits":
                raise InterruptedError("no commit")
            super()._put(df, name, stream, batch)

    for i in range(3):
        logs.write_files(files.where(F.col("run") == i), f"{place}/in/{i}")
        if i == 1:
            with contextlib.suppress(StreamingQueryException):
                BreaksOff(spark, f"{place}/store").start(f"{place}/in", f"{place}/checkpoint").awaitTermination()
        if i == 2:
            logs.write_files(files.where("run = 0"), f"{place}/in/again")
        run()
    found = store.records().groupBy("session_id").agg(F.count("*").alias("n"))
    rows = store.commits().join(found, "session_id", "left")
    copy = F.col("path").contains("/again/").cast("int")
    records = F.when(F.col("error").isNull(), F.col("n")).otherwise(F.lit(0)).cast("long")
    return rows.select("session_id", F.col("batch").cast("int").alias("run"), copy.alias("copy"), records.alias("records"), "error")
