"""Export folders (a folder of CSV tables for each session), the store of configurations, and one way to open sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strokeflow.functions import config
from strokeflow.operators import catalog
from strokeflow.operators.series import default_zero, speed_sanity
from strokeflow.plans.derive import KEY, derive_channels, to_long
from strokeflow.sources import logs
from strokeflow.sources.published import Published, dealt
from strokeflow.sources.scratch import stored as stored_table

#: The columns of the exported tables, in their order.
_HEAD = "record_seq long, record_flags int, host_timestamp_us long, host_time_s double"
TABLES = {
    "analog": f"{_HEAD}, dt_us long, sample_index long, front_raw int, rear_raw int, front_position_counts int, rear_position_counts int,"
    " front_norm double, rear_norm double, front_velocity_counts_per_s double, rear_velocity_counts_per_s double, front_mm double,"
    " rear_mm double, front_velocity_mm_per_s double, rear_velocity_mm_per_s double",
    "wheel": f"{_HEAD}, pulse_count long, interval_us long, period_s double, speed_m_s double, speed_kph double, speed_mph double",
    "status": f"{_HEAD}, code int, name string, flags int, value0 int, value1 int",
    "imu_bursts": "record_seq long, record_flags int, burst_index long, burst_host_timestamp_us long, burst_host_time_s double, frame_count int,"
    " accel_frames int, gyro_frames int, timestamp_frames int, fifo_level_before int, fifo_level_after int, burst_flags int,"
    " first_timestamp_raw long, first_timestamp_us long, last_timestamp_raw long, last_timestamp_us long",
    "imu_frames": "record_seq long, record_flags int, burst_index long, burst_host_timestamp_us long, burst_host_time_s double, frame_index int,"
    " tag_raw int, tag_sensor int, tag_name string, tag_counter int, tag_parity int, sample_timestamp_raw long, sample_timestamp_us long,"
    " estimated_host_timestamp_us long, estimated_host_time_s double, x_raw int, y_raw int, z_raw int, accel_x_g double, accel_y_g double,"
    " accel_z_g double, gyro_x_dps double, gyro_y_dps double, gyro_z_dps double, raw_hex string",
    "config": f"{_HEAD}, analog_rate_hz int, analog_resolution_bits int, analog_averaging int, button_debounce_ms long, button_hold_start_ms long,"
    " button_hold_stop_ms long, reed_debounce_us long, wheel_circumference_m float, imu_accel_range_g int, imu_gyro_range_dps int,"
    " imu_odr_hz int, imu_watermark_frames int, imu_fifo_mode int, imu_timestamp_decimation int",
}
#: Names in the tables of :mod:`strokeflow.sources.logs` of columns that differ.
COMMON = {
    "record_seq": "seq", "record_flags": "flags", "host_timestamp_us": "t_us", "host_time_s": "t_s", "burst_host_timestamp_us": "t_us",
    "burst_host_time_s": "t_s", "estimated_host_timestamp_us": "estimated_t_us", "sample_timestamp_raw": "sample_tick",
}

#: The columns of an exported timeline: those of each table beside the record's, with the prefix of its kind.
_LEFT_OUT = {"dt_us", "period_s", "burst_host_time_s", "estimated_host_timestamp_us", "estimated_host_time_s", "raw_hex"}
_PREFIX = {"analog": "", "wheel": "", "status": "stat_", "imu_frames": "imu_", "config": "config_"}
_RECORD = ["record_seq", "record_flags", "host_timestamp_us", "host_time_s"]
#: The tags of the records by table.
_TAGS = {"analog": "ANLG", "wheel": "WSPD", "status": "STAT", "imu_frames": "IMU ", "config": "CFG "}


def columns_of(name: str) -> list[str]:
    """The columns of an exported table, in their order."""
    if name != "timeline":
        return [c.split()[0] for c in TABLES[name].split(", ")]
    own = [f"{prefix}{c}" for table, prefix in _PREFIX.items() for c in columns_of(table) if c not in _RECORD and c not in _LEFT_OUT]
    return ["event_type", "record_seq", "record_tag", *_RECORD[1:], *own]


def export_tables(
    records: DataFrame, bits: int = 12, zero: dict[str, int] | None = None, invert: dict[str, bool] | None = None,
    mm_per_count: dict[str, float] | None = None, configs: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The exported tables of logs, with session_id before their columns.

    ``zero``, ``invert`` and ``mm_per_count`` are by channel; mm columns are null without a scale. Where a session
    has a row in ``configs(session_id, channel, zero, invert, mm_per_count)`` that row's fields take their place.
    """
    good = logs.unwrapped(records)
    own = None
    if configs is not None:
        fields = F.first(F.struct("zero", "invert", "mm_per_count"))
        own = configs.groupBy(F.col("session_id").alias("__id")).pivot("channel", ["front", "rear"]).agg(fields).withColumnsRenamed({"front": "__front", "rear": "__rear"})
    order = W.partitionBy("session_id").orderBy("n")

    def change(c: str) -> Column:
        return F.coalesce(F.lead(c).over(order), F.col(c)) - F.coalesce(F.lag(c).over(order), F.col(c))

    analog = logs.analog_table(good, bits).withColumn("dt_us", F.col("t_us") - F.lag("t_us").over(order))
    if own is not None:
        analog = analog.join(own, F.col("session_id") == F.col("__id"), "left").drop("__id")
    for c in ("front", "rear"):
        at, turned, scale = F.lit(int((zero or {}).get(c, 0))), F.lit(bool((invert or {}).get(c))), F.lit((mm_per_count or {}).get(c)).cast("double")
        if own is not None:
            one = F.col(f"__{c}")
            at, turned = F.coalesce(one["zero"].cast("int"), at), F.coalesce(one["invert"], turned)
            scale = F.when(one.isNotNull(), one["mm_per_count"]).otherwise(scale)
        counts = f"{c}_position_counts"
        analog = analog.withColumn(counts, (F.col(f"{c}_raw") - at) * F.when(turned, -1).otherwise(1))
        speed = F.when(change("t_us") > 0, change(counts) * 1e6 / change("t_us"))
        analog = analog.withColumns({
            f"{c}_mm": F.col(counts) * scale, f"{c}_velocity_counts_per_s": speed, f"{c}_velocity_mm_per_s": speed * scale,
        })
    frames = logs.imu_frames(good).withColumns({
        "sample_timestamp_us": F.col("sample_tick") * logs.TICK_US, "estimated_host_time_s": F.col("estimated_t_us") / 1e6,
    })
    typed = {
        "analog": analog, "wheel": logs.wheel_table(good), "status": logs.status_table(good), "imu_bursts": logs.imu_bursts(good),
        "imu_frames": frames, "config": logs.session_config(good),
    }
    out = {}
    for name, df in typed.items():
        given = {c: COMMON.get(c, c) for c in columns_of(name)} | ({"flags": "status_flags"} if name == "status" else {})
        kinds = dict(c.split() for c in TABLES[name].split(", "))
        out[name] = df.select("session_id", *[F.col(x).cast(kinds[c]).alias(c) for c, x in given.items()])
    return out | {"timeline": _timeline(out)}


def _timeline(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables in one, in the order of each session's time; frames at their own time where it is known."""
    parts = []
    for name, prefix in _PREFIX.items():
        df, kind = tables[name], F.lit(name)
        if name == "imu_frames":
            at = F.coalesce("estimated_host_timestamp_us", "burst_host_timestamp_us")
            df = df.withColumns({"host_timestamp_us": at, "host_time_s": at / 1e6})
            kind = F.concat(F.lit("imu_"), F.lower("tag_name"))
        own = [F.col(c).alias(f"{prefix}{c}") for c in columns_of(name) if c not in _RECORD and c not in _LEFT_OUT]
        parts.append(df.select("session_id", kind.alias("event_type"), F.lit(_TAGS[name]).alias("record_tag"), *_RECORD, *own))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out.select("session_id", *columns_of("timeline"))


def summaries(records: DataFrame, tables: dict[str, DataFrame], mm_per_count: dict[str, float] | None = None) -> DataFrame:
    """The summary of each session, with the fields that :func:`strokeflow.operators.catalog.scan_summaries` reads."""
    good = logs.unwrapped(records)
    spans = good.groupBy("session_id").agg(F.min("t_us").alias("a"), F.max("t_us").alias("b"))
    tags = good.groupBy("session_id", "tag").count().groupBy("session_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "count")))).alias("record_counts")
    )
    rows = logs.sessions(records).join(spans, "session_id").join(tags, "session_id")
    names = dict(zip(catalog.COUNTS, ("analog", "wheel", "status", "imu_bursts", "imu_frames"), strict=True))
    for count, name in names.items():
        rows = rows.join(tables[name].groupBy("session_id").agg(F.count("*").alias(count)), "session_id", "left")
    extents = [f(f"{c}_raw").alias(f"{c}_raw_{n}") for c in ("front", "rear") for n, f in (("min", F.min), ("max", F.max))]
    rows = rows.join(tables["analog"].groupBy("session_id").agg(F.struct(*extents).alias("analog_extents")), "session_id", "left")
    scales = [F.lit((mm_per_count or {}).get(c)).cast("double").alias(f"{c}_mm_per_count") for c in ("front", "rear")]
    return rows.select(
        "session_id", F.col("path").alias("source_path"), F.col("file_size").alias("file_size_bytes"), logs.header_fields(F.col("head")).alias("header"),
        "record_counts", F.struct(*scales).alias("derived_scales"),
        F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in catalog.COUNTS]).alias("counts"),
        F.struct(F.col("a").alias("first_host_timestamp_us"), F.col("b").alias("last_host_timestamp_us"), (F.col("b") - F.col("a")).alias("duration_us")).alias("timing"),
        "analog_extents",
    )


_CSV = {"header": "true", "nullValue": "", "emptyValue": ""}


def write_exports(records: DataFrame, root: str, by: str = "session", **options) -> None:
    """Write the exported tables as CSV below ``root``, and the summaries as JSON.

    Null is an empty field. :func:`read_table`, :func:`read_summaries` and :func:`open_sessions` read it back.
    What is there of other sessions stays, their summaries too.

    By ``session``, each table has a folder for each session, so there are as many files as sessions times tables.
    By ``run``, for many sessions, the files of a table hold many sessions, whose id is their first column; the sessions
    written become visible together, as of their last run. A root keeps the form that it was begun in.
    """
    if by not in ("session", "run"):
        raise ValueError("exports are written by session or by run")
    store = Published(records.sparkSession, root)
    if (by == "session" and store.exists()) or (by == "run" and not store.exists() and store.has("analog")):
        raise ValueError("these exports were begun in the other form")
    records = stored_table(logs.with_wraps(records), "export-records")
    tables, n = export_tables(records, **options), records.count()
    sorted_tables = {}
    for name, df in tables.items():
        time = "host_timestamp_us" if "host_timestamp_us" in df.columns else "burst_host_timestamp_us"
        sorted_tables[name] = dealt(df, n, time, "record_seq")
    if by == "run":
        found = dealt(summaries(records, tables, options.get("mm_per_count")), n)
        formats = dict.fromkeys(tables, ("csv", _CSV)) | {"summary": ("json", {})}
        store.replace(logs.sessions(records), sorted_tables | {"summary": found}, formats)
        return
    for name, rows in sorted_tables.items():
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id")
        writer.options(**_CSV).csv(f"{root}/{name}")
    found = summaries(records, tables, options.get("mm_per_count")).withColumn("session", F.col("session_id")).repartition("session_id")
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").json(f"{root}/summary")


#: Changes when the tables come to be made in another way.
EXPORT_VERSION = 1


def published_exports(records: DataFrame, root: str, configs: DataFrame | None = None, **options) -> Published:
    """Export the sessions whose log, configuration or options have changed since their last export; Parquet tables by run.

    All exported tables and the summary of a session become visible together.
    """
    store = Published(records.sparkSession, root)
    sessions = logs.sessions(records).select("session_id", "path", "file_size", "records", F.hex("head").alias("head"))
    if configs is not None:
        fields = F.array_sort(F.collect_list(F.struct("channel", "zero", "invert", "mm_per_count")))
        sessions = sessions.join(configs.groupBy("session_id").agg(fields.alias("configs")), "session_id", "left")
    sessions = sessions.withColumns({"options": F.lit(repr(sorted(options.items()))), "version": F.lit(EXPORT_VERSION)})
    current = sessions.select("session_id", catalog.signature(*sessions.columns).alias("signature"))

    def build(stale: DataFrame) -> dict[str, DataFrame]:
        some = stored_table(logs.with_wraps(records.join(stale, "session_id", "left_semi")), "export-records")
        tables, n = export_tables(some, configs=configs, **options), some.count()
        every = tables | {"summary": summaries(some, tables, options.get("mm_per_count"))}
        return {name: dealt(df, n) for name, df in every.items()}

    store.publish(current, build)
    return store


def published_derived(samples: DataFrame, configs: DataFrame, root: str, derive: Callable[[DataFrame, DataFrame], DataFrame]) -> Published:
    """Derived series of the sessions whose samples or configuration have changed; the others are read as they were.

    ``derive(samples, configs)`` is asked for the stale sessions alone. A session's samples are known by their number,
    extent and a sum of hashes.
    """
    store = Published(samples.sparkSession, root)
    rows = samples.groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[c for c in samples.columns if c != "session_id"]).cast("decimal(38,0)")).alias("hashes"))
    own = configs.groupBy("session_id").agg(F.array_sort(F.collect_list(F.to_json(F.struct(*sorted(c for c in configs.columns if c != "session_id"))))).alias("configs"))
    sessions = rows.join(own, "session_id", "left").withColumn("version", F.lit(EXPORT_VERSION))
    current = sessions.select(F.col("session_id").cast("string").alias("session_id"), catalog.signature(*sessions.columns).alias("signature"))

    def build(stale: DataFrame) -> dict[str, DataFrame]:
        keep = [x.join(stale.select(F.col("session_id").alias("__id")), x["session_id"].cast("string") == F.col("__id"), "left_semi") for x in (samples, configs)]
        return {"derived": dealt(derive(*keep).withColumn("session_id", F.col("session_id").cast("string")))}

    store.publish(current, build)
    return store


CONFIG_FIELDS = {
    "source_path": "string", "zero": "double", "invert": "boolean", "mm_per_count": "double", "full_scale_mm": "double", "sensor_mm": "double",
    "manual_reference": "double",
}
#: The full scale and the sensor range of a new configuration, by channel.
NEW_SCALES = {"front": (config.FRONT_FULL_SCALE_MM, config.FRONT_SENSOR_MM), "rear": (None, None)}


def read_or_empty(spark: SparkSession, paths: str | list[str], schema: str, fmt: str = "parquet", **options) -> DataFrame:
    """Files of a format, or an empty table where no file is there."""
    try:
        return spark.read.schema(schema).options(**options).format(fmt).load(paths)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of all exported sessions below ``root``: a folder for each session with a file for each
    table, or the folders that :func:`write_exports` writes.

    Empty fields are null; a session without the file has no rows. Columns are named as in a log's
    typed tables where these have them.
    """
    csv = {"header": "true", "nullValue": "", "recursiveFileLookup": "true"}
    folders = read_or_empty(spark, root, TABLES[name], "csv", pathGlobFilter=f"{name}.csv", **csv)
    last = F.element_at(F.split(F.input_file_name(), "/"), -2)
    store = Published(spark, root)
    if store.exists():
        written = store.read(name, f"session_id string, {TABLES[name]}", "csv", header="true", nullValue="")
    else:
        written = read_or_empty(spark, f"{root}/{name}", TABLES[name], "csv", pathGlobFilter="part-*", **csv)
        written = written.withColumn("session_id", F.url_decode(F.regexp_replace(last, "^session_id=", "")))
    rows = folders.withColumn("session_id", last).unionByName(written)
    # The flags of a status keep a name of their own.
    names = ({"flags": "status_flags"} if name == "status" else {}) | COMMON
    return rows.select("session_id", *[F.col(c).alias(names.get(c, c)) for c in rows.columns if c != "session_id"])


def read_timeline(spark: SparkSession, root: str) -> DataFrame:
    """The exported timelines below ``root``, with their fields as text, as they stand in the files."""
    options = {"header": "true", "nullValue": "\0", "emptyValue": ""}
    store = Published(spark, root)
    if store.exists():
        schema = ", ".join(f"{c} string" for c in ["session_id", *columns_of("timeline")])
        return store.read("timeline", schema, "csv", **options)
    return spark.read.options(**options).csv(f"{root}/timeline")


def read_summaries(spark: SparkSession, root: str, *others: str) -> DataFrame:
    """The summaries of the exports below ``root``, of each session as of its last run, and those of other folders."""
    store = Published(spark, root)
    return catalog.scan_summaries(spark, [f"{root}/summary", *others], store.current if store.exists() else None)


def load_configs(spark: SparkSession, folder: str | None, zeros: DataFrame) -> DataFrame:
    """A configuration for each of ``zeros(session_id, channel, zero, source_path)``: the one stored in
    ``folder``, its gaps filled, or a new one."""
    schema = ", ".join(f"{n} {t}" for n, t in {"session_id": "string", "channel": "string", **CONFIG_FIELDS}.items())
    if folder and (store := Published(spark, folder)).exists():
        stored = store.read(SAVED, schema)
    else:
        stored = read_or_empty(spark, folder, schema) if folder else spark.createDataFrame([], schema)
    stored = stored.select(*[F.col(c).alias(f"__{c}") for c in ("session_id", "channel", *CONFIG_FIELDS)])
    rows = zeros.join(stored, (F.col("session_id") == F.col("__session_id")) & (F.col("channel") == F.col("__channel")), "left")

    def new(place: int) -> Column:
        out = F.lit(None).cast("double")
        for name, values in NEW_SCALES.items():
            out = F.when(F.col("channel") == name, F.lit(values[place]).cast("double")).otherwise(out)
        return out

    is_new = F.col("__session_id").isNull()
    return rows.select(
        F.col("session_id").cast("string").alias("session_id"), "channel", F.coalesce("source_path", "__source_path").alias("source_path"),
        F.coalesce("__zero", "zero").alias("zero"), F.coalesce("__invert", F.lit(False)).alias("invert"), F.col("__mm_per_count").alias("mm_per_count"),
        F.when(is_new, new(0)).otherwise(F.col("__full_scale_mm")).alias("full_scale_mm"),
        F.when(is_new, new(1)).otherwise(F.col("__sensor_mm")).alias("sensor_mm"), F.col("__manual_reference").alias("manual_reference"),
    )


#: The table of a folder that :func:`save_by_run` writes.
SAVED = "saved"


def save_by_run(df: DataFrame, folder: str) -> Published:
    """:func:`save_by_session` for many sessions, which share files; read by ``Published.read(SAVED)`` and :func:`load_configs`."""
    store, rows = Published(df.sparkSession, folder), stored_table(df, "saved")
    store.replace(rows.select("session_id"), {SAVED: rows.repartition("session_id").sortWithinPartitions("session_id")})
    return store


def save_by_session(df: DataFrame, folder: str) -> None:
    """Write a table by session, a folder for each; only the sessions written are replaced."""
    rows = df.repartition("session_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(folder)


def open_sessions(
    spark: SparkSession, paths: str | list[str], config_folder: str | None = None, configs: DataFrame | None = None, bits: int = 12, window: int = 3,
    files: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All tables of the sessions at ``paths``: logs (``*.BIN``) or the root of export folders, told apart by the suffix.

    Gives the typed tables with implausible wheel speeds taken out, ``configs`` (those given, else stored
    or new ones) and ``derived`` samples. Calling it with changed ``configs`` derives anew. ``files(path, content)``
    holds the logs where they are not to be read from ``paths``.
    """
    every = [paths] if isinstance(paths, str) else list(paths)
    binary = {p.upper().endswith(".BIN") for p in every}
    if len(binary) != 1:
        raise ValueError("paths are either all logs or one root of export folders")
    if binary.pop():
        out = logs.typed_tables(logs.read_records(spark, every, files=files), bits)
    elif len(every) == 1:
        out = {name: read_table(spark, every[0], name) for name in TABLES}
    else:
        raise ValueError("one root of export folders at a time")
    for speed in ("speed_m_s", "speed_kph", "speed_mph"):
        most = {"speed_m_s": 200.0 / 3.6, "speed_kph": 200.0, "speed_mph": 200.0 / 3.6 * 2.2369362920544}[speed]
        out["wheel"] = speed_sanity(out["wheel"], speed, most)
    samples = out["analog"].select("session_id", "t_us", "t_s", "seq", F.col("front_raw").alias("front"), F.col("rear_raw").alias("rear"))
    if configs is None:
        zeros = default_zero(to_long(samples), "raw", by=KEY).withColumn("source_path", F.lit(None).cast("string"))
        configs = load_configs(spark, config_folder, zeros)
    scale = config.mm_per_count(F.col("mm_per_count"), F.col("sensor_mm"), F.col("full_scale_mm"), F.lit(float(bits)))
    out["configs"] = configs
    out["derived"] = derive_channels(samples, "t_s", window=window, configs=configs.withColumn("mm_per_count", scale))
    return out
