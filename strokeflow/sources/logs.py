"""Ingest of binary session logs as one Spark job over a directory.

A log is a header of 100 bytes and tagged records of a 16-byte header and a payload, little-endian.
Framing runs in Arrow batches over ``binaryFile``; every typed table is a projection of the record
table in the JVM. A file that breaks the format goes to the quarantine table with its error.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strokeflow.sources.scratch import spread

#: The layout of the log format.
FILE_HEADER = struct.Struct("<8sHHII24sIII4B4H8B6I")
RECORD_HEADER = struct.Struct("<4sHHII")
MAGIC = b"STLOG1"
SIZES = {"CFG ": struct.calcsize("<HBB4If4HBBH"), "STAT": 12, "ANLG": 8, "WSPD": 8}
IMU_HEADER = struct.calcsize("<I7H2I")
FRAME = 7
CONFIG_TAG, STATUS_TAG, ANALOG_TAG, WHEEL_TAG, IMU_TAG = "CFG", "STAT", "ANLG", "WSPD", "IMU"

#: Status codes, stop reasons, IMU frame tags and scales of the format.
STATUS_NAMES = {
    1: "BOOT", 2: "RTC_VALID", 3: "RTC_INVALID", 4: "SD_READY", 5: "SD_ERROR", 6: "IMU_READY", 7: "IMU_ERROR", 8: "SESSION_START",
    9: "SESSION_STOP", 10: "CLEAN_CLOSE", 11: "QUEUE_OVERFLOW", 12: "ANALOG_OVERRUN", 13: "REED_OVERFLOW", 14: "IMU_FIFO_OVERFLOW",
    15: "WRITER_ERROR", 16: "IMU_READ_ERROR",
}
STOP_REASONS = {0: "UNKNOWN", 1: "SWITCH_OFF", 2: "VALIDATION_AUTORUN"}
FRAME_TAGS = {
    1: "GYRO_NC", 2: "ACCEL_NC", 3: "TEMPERATURE", 4: "TIMESTAMP", 5: "CFG_CHANGE", 6: "ACCEL_NC_T_2", 7: "ACCEL_NC_T_1", 8: "ACCEL_2XC",
    9: "ACCEL_3XC", 10: "GYRO_NC_T_2", 11: "GYRO_NC_T_1", 12: "GYRO_2XC", 13: "GYRO_3XC", 14: "SENSORHUB_SLAVE0", 15: "SENSORHUB_SLAVE1",
    16: "SENSORHUB_SLAVE2", 17: "SENSORHUB_SLAVE3", 18: "STEP_COUNTER", 19: "GAME_ROTATION", 20: "GEOMAG_ROTATION", 21: "ROTATION",
    25: "SENSORHUB_NACK",
}
ACCEL_MG_PER_COUNT = {2: 0.061, 4: 0.122, 8: 0.244, 16: 0.488}
GYRO_MDPS_PER_COUNT = {125: 4.375, 250: 8.75, 500: 17.5, 1000: 35.0, 2000: 70.0, 4000: 140.0}
TICK_US = 25

RECORDS = (
    "path string, error string, file_version int, start_epoch long, build string, n long, tag string, version int, flags int, seq long, t_us long, payload binary,"
    " head binary, file_size long"
)
BATCH = 50_000  # records


class LogError(ValueError):
    pass


def read_header(data: bytes) -> tuple[int, int, str]:
    """Version, start and build of a file; LogError where the format is broken."""
    if len(data) < FILE_HEADER.size:
        raise LogError("file is shorter than its header")
    head = FILE_HEADER.unpack_from(data)
    if head[0].rstrip(b"\0") != MAGIC:
        raise LogError("magic is not STLOG1")
    version, size, build, epoch = head[1], head[2], head[5], head[6]
    if size != FILE_HEADER.size:
        raise LogError(f"header size {size} is not {FILE_HEADER.size}")
    if head[16] != RECORD_HEADER.size:
        raise LogError(f"record header size {head[16]} is not {RECORD_HEADER.size}")
    return version, epoch, build.rstrip(b"\0").decode("ascii", "replace")


def walk_records(data: bytes):
    """(n, tag, flags, seq, t, payload's place and end) of each record; LogError where the format is broken."""
    n, at = 0, FILE_HEADER.size
    while at < len(data):
        if at + RECORD_HEADER.size > len(data):
            raise LogError("trailing bytes after the last record")
        tag, length, flags, seq, t = RECORD_HEADER.unpack_from(data, at)
        at += RECORD_HEADER.size
        if at + length > len(data):
            raise LogError("payload of the last record is cut short")
        yield n, tag.decode("ascii", "replace").rstrip("\0 "), flags, seq, t, at, at + length
        n, at = n + 1, at + length


_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_FIELDS = [(name, _KINDS[kind]) for name, kind in (c.split() for c in RECORDS.split(", "))]


#: With the number of times that the clock had started anew before a record, which only ranges know.
_WITH_WRAPS = [*_FIELDS, ("wraps", pa.int64())]


def _batch(rows: list[tuple], fields: list = _FIELDS) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _framed(path: str, data: bytes, clash: bool):
    """Batches of the records of one file; LogError, before any, where it is broken or its name is taken."""
    if clash:
        raise LogError(CLASH)
    header = read_header(data)
    for _ in walk_records(data):
        pass
    rows = []
    for n, tag, flags, seq, t, start, end in walk_records(data):
        head = (data[: FILE_HEADER.size], len(data)) if n == 0 else (None, None)
        rows.append((path, None, *header, n, tag, 1, flags, seq, t, data[start:end], *head))
        if len(rows) == BATCH:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _broken(path: str, error: LogError | str, fields: list = _FIELDS) -> pa.RecordBatch:
    return _batch([(path, str(error), *[None] * (len(fields) - 2))], fields)


#: What the names of two files in different folders make of their sessions.
CLASH = "another file has this session's name"
#: Files beyond this size are read by ranges: one value of a table ends at 2 GB.
WHOLE_BYTES = 1 << 30


def read_records(
    spark: SparkSession, paths: str | list[str], failfast: bool = False, files: DataFrame | None = None, range_bytes: int | None = None
) -> DataFrame:
    """One row for each record of each log, and one row with ``error`` for each broken file.

    A file's first record carries the bytes of its header (``head``) and its size. A session is named by
    its file; files in several folders with one name are errors, as their records would mix.

    ``files(path, content)`` are taken as they are. Files of ``paths`` are read by ranges of ``range_bytes``,
    each in a task of its own, if that is given or one of them is larger than ``WHOLE_BYTES``; the rows are the same, and
    know the wraps of the clock before them.
    """
    if files is None:
        files = spark.read.format("binaryFile").load(paths)
        if range_bytes or not files.where(F.col("length") > WHOLE_BYTES).isEmpty():
            return _by_ranges(files.select("path", "length"), range_bytes, failfast)

    def run(parts):
        for part in parts:
            for path, content, clash in zip(*part.columns, strict=True):
                try:
                    yield from _framed(path.as_py(), content.as_py(), clash.as_py())
                except LogError as x:
                    if failfast:
                        raise
                    yield _broken(path.as_py(), x)

    named = files.select("path", "content", session_of(F.col("path")).alias("session_id"))
    clashes = clashing(files)
    if clashes.isEmpty():  # else the contents would be shuffled for nothing
        named = named.withColumn("clash", F.lit(False))
    else:
        named = named.join(clashes.select("session_id", F.lit(True).alias("clash")), "session_id", "left")
    marked = named.select("path", "content", F.coalesce("clash", F.lit(False)).alias("clash"))
    return marked.mapInArrow(run, RECORDS).withColumn("session_id", session_of(F.col("path")))


def clashing(files: DataFrame) -> DataFrame:
    """(session_id, count): names that several of ``files(path)`` share."""
    named = files.select("path", session_of(F.col("path")).alias("session_id")).distinct()
    return named.groupBy("session_id").count().where("count > 1")


def _by_ranges(files: DataFrame, range_bytes: int | None, failfast: bool) -> DataFrame:
    from strokeflow.sources.ranges import RANGE_BYTES, read_ranges

    named = files.withColumn("session_id", session_of(F.col("path")))
    clashes = clashing(files).select("session_id")
    own = named.join(clashes, "session_id", "left_anti").select("path", "length")
    out = read_ranges(own, range_bytes or RANGE_BYTES, failfast)
    if not clashes.isEmpty():
        if failfast:
            raise LogError(CLASH)
        lost = named.join(clashes, "session_id", "left_semi").select("path", F.lit(CLASH).alias("error"))
        out = out.unionByName(lost, allowMissingColumns=True)
    return out.withColumn("session_id", session_of(F.col("path")))


def write_files(files: DataFrame, folder: str) -> int:
    """Write the bytes of each of ``files(path, content)`` below ``folder`` under the name that its path ends in."""
    from pyarrow import fs

    def run(parts):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for part in parts:
            for path, content in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                name = f"{root}/{path.rsplit('/', 1)[-1]}"
                with store.open_output_stream(f"{name}.part") as f:
                    f.write(content.as_buffer())
                store.move(f"{name}.part", name)
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows])], ["n"])

    return spread(files.select("path", "content"), "path").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def session_of(path: Column) -> Column:
    """File name without folder and suffix."""
    return F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1)


def unsigned(payload: Column, at: int, size: int) -> Column:
    """Little-endian unsigned integer at a byte offset, as a long."""
    parts = [F.conv(F.hex(F.substring(payload, at + i + 1, 1)), 16, 10).cast("long") * F.lit(256**i) for i in range(size)]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def signed(payload: Column, at: int, size: int) -> Column:
    u, half = unsigned(payload, at, size), 256**size // 2
    return F.when(u >= half, u - 256**size).otherwise(u)


def float32(payload: Column, at: int) -> Column:
    """Little-endian IEEE single at a byte offset, as a double; null for infinities and NaN."""
    u = unsigned(payload, at, 4)
    sign = F.when(F.shiftright(u, 31) == 1, -1.0).otherwise(1.0)
    exponent, mantissa = F.shiftright(u, 23).bitwiseAND(F.lit(255)), u.bitwiseAND(F.lit(8388607))
    normal = F.pow(F.lit(2.0), exponent - 127) * (1 + mantissa / 8388608.0)
    return F.when(exponent == 255, None).otherwise(sign * F.when(exponent == 0, mantissa * 2.0**-149).otherwise(normal))


def _lookup(codes: dict, key: Column) -> Column:
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    return F.create_map(*pairs)[key]


def _of(records: DataFrame, tag: str, length: int | None = None) -> DataFrame:
    rows = records.where((F.col("tag") == tag) & F.col("error").isNull())
    return rows if length is None else rows.where(F.length("payload") == length)


def unwrapped(records: DataFrame) -> DataFrame:
    """Records with t_us unwrapped in file order, and t_s."""
    good = with_wraps(records.where("error is null"))
    whole = good.withColumn("t_us", F.col("t_us") + F.shiftleft("wraps", 32)).drop("wraps")
    return whole.withColumn("t_s", F.col("t_us") / 1e6)


def with_wraps(records: DataFrame) -> DataFrame:
    """Records that know how often the clock had started anew before each, in file order: stored like this, no table made of them sorts them again."""
    from strokeflow.operators.series import unwrap_clock

    if "wraps" in records.columns:
        return records
    return unwrap_clock(records, "t_us", "wraps", ("session_id",), ("n",)).withColumn("wraps", F.shiftright(F.col("wraps") - F.col("t_us"), 32))


_BASE = ["session_id", "n", "seq", "flags", "t_us", "t_s"]


def sessions(records: DataFrame) -> DataFrame:
    """One row for each good session: header fields and record counts."""
    return records.where("error is null").groupBy("session_id").agg(
        F.first("path").alias("path"), F.first("file_version").alias("file_version"), F.first("start_epoch").alias("start_epoch"),
        F.first("build").alias("build"), F.count("*").alias("records"), F.max("file_size").alias("file_size"), F.max("head").alias("head"),
    )


#: The numbers of the file header after its magic and their place and size in bytes.
HEADER_FIELDS = {
    "format_version": (8, 2), "header_size": (10, 2), "firmware_version": (12, 4), "build_epoch": (16, 4), "start_epoch": (44, 4), "start_micros": (48, 4),
    "session_index": (52, 4), "rtc_valid": (56, 1), "enabled_mask": (57, 1), "analog_resolution_bits": (58, 1), "analog_averaging": (59, 1),
    "analog_rate_hz": (60, 2), "imu_rate_hz": (62, 2), "imu_watermark_frames": (64, 2), "record_header_size": (66, 2), "button_pin": (68, 1),
    "led_pin": (69, 1), "reed_pin": (70, 1), "imu_int1_pin": (71, 1), "front_pot_pin": (72, 1), "rear_pot_pin": (73, 1), "imu_cs_pin": (74, 1),
}


def header_fields(head: Column) -> Column:
    """The file header as a struct."""

    def text(at, size):
        return F.rtrim(F.decode(F.substring(head, at + 1, size), "US-ASCII"), F.lit("\0"))

    numbers = [unsigned(head, at, size).alias(name) for name, (at, size) in HEADER_FIELDS.items()]
    return F.struct(text(0, 8).alias("magic"), text(20, 24).alias("build_id"), *numbers)


def quarantine(records: DataFrame) -> DataFrame:
    return records.where("error is not null").select("session_id", "path", "error")


def config_table(records: DataFrame) -> DataFrame:
    """All configuration records, in order."""
    p = F.col("payload")
    return _of(records, CONFIG_TAG, SIZES["CFG "]).select(
        *_BASE, unsigned(p, 0, 2).alias("analog_rate_hz"), unsigned(p, 2, 1).alias("analog_resolution_bits"), unsigned(p, 3, 1).alias("analog_averaging"),
        unsigned(p, 4, 4).alias("button_debounce_ms"), unsigned(p, 8, 4).alias("button_hold_start_ms"), unsigned(p, 12, 4).alias("button_hold_stop_ms"),
        unsigned(p, 16, 4).alias("reed_debounce_us"), float32(p, 20).alias("wheel_circumference_m"), unsigned(p, 24, 2).alias("imu_accel_range_g"),
        unsigned(p, 26, 2).alias("imu_gyro_range_dps"), unsigned(p, 28, 2).alias("imu_odr_hz"), unsigned(p, 30, 2).alias("imu_watermark_frames"),
        unsigned(p, 32, 1).alias("imu_fifo_mode"), unsigned(p, 33, 1).alias("imu_timestamp_decimation"),
    )


def session_config(records: DataFrame) -> DataFrame:
    """The first configuration record of each session."""
    first = F.row_number().over(W.partitionBy("session_id").orderBy("n"))
    return config_table(records).withColumn("__k", first).where("__k = 1").drop("__k")


def latest_config(records: DataFrame) -> DataFrame:
    """The last configuration of each session: (session_id, circumference, accel and gyro range)."""
    c = config_table(records)
    last = F.max_by(F.struct("wheel_circumference_m", "imu_accel_range_g", "imu_gyro_range_dps"), "n")
    return c.groupBy("session_id").agg(last.alias("c")).select("session_id", "c.*")


def status_name(code: Column) -> Column:
    """The name of a status code; ``UNKNOWN_n`` for others."""
    return F.coalesce(_lookup(STATUS_NAMES, code), F.concat(F.lit("UNKNOWN_"), code.cast("string")))


def stop_reason(code: Column, value: Column) -> Column:
    """Why a session stopped; null for a status that is no stop."""
    return F.when(code == 9, F.coalesce(_lookup(STOP_REASONS, value.cast("int")), F.concat(F.lit("UNKNOWN_"), value.cast("string"))))


def status_table(records: DataFrame) -> DataFrame:
    p = F.col("payload")
    rows = _of(records, STATUS_TAG, SIZES["STAT"]).select(
        *_BASE, unsigned(p, 0, 2).cast("int").alias("code"), unsigned(p, 2, 2).alias("status_flags"), signed(p, 4, 4).alias("value0"), signed(p, 8, 4).alias("value1")
    )
    return rows.withColumns({"name": status_name(F.col("code")), "stop_reason": stop_reason(F.col("code"), F.col("value1"))})


def analog_table(records: DataFrame, bits: int = 12, mm_per_count: float | None = None) -> DataFrame:
    """Samples of both channels; mm columns are null without a scale."""
    p, top = F.col("payload"), float((1 << bits) - 1)
    rows = _of(records, ANALOG_TAG, SIZES["ANLG"]).select(
        *_BASE, unsigned(p, 0, 4).alias("sample_index"), unsigned(p, 4, 2).cast("int").alias("front_raw"), unsigned(p, 6, 2).cast("int").alias("rear_raw")
    )
    w = W.partitionBy("session_id").orderBy("t_us", "n")
    scale = F.lit(mm_per_count).cast("double")
    out = rows.withColumn("dt_us", F.col("t_us") - F.lag("t_us").over(w))
    return out.withColumns({f"{c}_norm": F.col(f"{c}_raw") / top for c in ("front", "rear")} | {f"{c}_mm": F.col(f"{c}_raw") * scale for c in ("front", "rear")})


def wheel_table(records: DataFrame) -> DataFrame:
    """Pulses with their speed; null without an interval or a wheel circumference."""
    p = F.col("payload")
    rows = _of(records, WHEEL_TAG, SIZES["WSPD"]).select(*_BASE, unsigned(p, 0, 4).alias("pulse_count"), unsigned(p, 4, 4).alias("interval_us"))
    rows = rows.join(latest_config(records).select("session_id", "wheel_circumference_m"), "session_id", "left")
    period = F.when(F.col("interval_us") > 0, F.col("interval_us") / 1e6)
    speed = F.when(F.col("wheel_circumference_m") > 0, F.col("wheel_circumference_m") / period)
    return rows.withColumns({"period_s": period, "speed_m_s": speed, "speed_kph": speed * 3.6, "speed_mph": speed * 2.2369362920544}).drop("wheel_circumference_m")


def imu_bursts(records: DataFrame) -> DataFrame:
    """The heads of the IMU bursts."""
    p = F.col("payload")
    counts = ("frame_count", "accel_frames", "gyro_frames", "timestamp_frames", "fifo_level_before", "fifo_level_after", "burst_flags")
    return _of(records, IMU_TAG).where(F.length("payload") >= IMU_HEADER).select(
        *_BASE, unsigned(p, 0, 4).alias("burst_index"), *[unsigned(p, 4 + 2 * i, 2).cast("int").alias(c) for i, c in enumerate(counts)],
        unsigned(p, 18, 4).alias("first_timestamp_raw"), (F.nullif(unsigned(p, 18, 4), F.lit(0)) * TICK_US).alias("first_timestamp_us"),
        unsigned(p, 22, 4).alias("last_timestamp_raw"), (F.nullif(unsigned(p, 22, 4), F.lit(0)) * TICK_US).alias("last_timestamp_us"),
    )


def imu_frames(records: DataFrame) -> DataFrame:
    """Frames of the IMU bursts: tag bits, carried timestamp, scaled axes and estimated host time."""
    p = F.col("payload")
    bursts = _of(records, IMU_TAG).where(F.length("payload") >= IMU_HEADER).select(
        *_BASE, unsigned(p, 0, 4).alias("burst_index"), unsigned(p, 4, 2).alias("frame_count"), unsigned(p, 22, 4).alias("last_tick"), "payload"
    )
    n = F.floor((F.length("payload") - IMU_HEADER) / FRAME).cast("int")
    rows = bursts.withColumn("frame_index", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    rows = rows.withColumn("f", F.substring("payload", IMU_HEADER + 1 + F.col("frame_index") * FRAME, F.lit(FRAME))).drop("payload")
    f = F.col("f")
    tag = unsigned(f, 0, 1)
    rows = rows.withColumns({
        "tag_raw": tag.cast("int"), "tag_sensor": F.shiftright(tag, 3).cast("int"), "tag_counter": F.shiftright(tag, 1).bitwiseAND(F.lit(3)).cast("int"),
        "tag_parity": tag.bitwiseAND(F.lit(1)).cast("int"), "tick": unsigned(f, 1, 4), "raw_hex": F.lower(F.hex(F.substring("f", 2, FRAME - 1))),
        **{f"{a}_raw": F.when(F.shiftright(tag, 3).isin(1, 2), signed(f, 1 + 2 * i, 2)) for i, a in enumerate("xyz")},
    })
    name = F.coalesce(_lookup(FRAME_TAGS, F.col("tag_sensor")), F.concat(F.lit("UNKNOWN_"), F.col("tag_sensor").cast("string")))
    w = W.partitionBy("session_id", "n").orderBy("frame_index").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("tag_name", name)
    stamp = F.last(F.when(F.col("tag_name") == "TIMESTAMP", F.col("tick")), ignorenulls=True).over(w)
    rows = rows.withColumn("sample_tick", stamp).join(latest_config(records).drop("wheel_circumference_m"), "session_id", "left")
    host = F.when((F.col("last_tick") > 0) & F.col("sample_tick").isNotNull(), F.col("t_us") - (F.col("last_tick") - F.col("sample_tick")) * TICK_US)
    g = _lookup(ACCEL_MG_PER_COUNT, F.col("imu_accel_range_g").cast("int")) / 1000.0
    dps = _lookup(GYRO_MDPS_PER_COUNT, F.col("imu_gyro_range_dps").cast("int")) / 1000.0
    scaled = {f"accel_{a}_g": F.when(F.col("tag_sensor") == 2, F.col(f"{a}_raw") * g) for a in "xyz"}
    scaled |= {f"gyro_{a}_dps": F.when(F.col("tag_sensor") == 1, F.col(f"{a}_raw") * dps) for a in "xyz"}
    return rows.withColumns({"estimated_t_us": host, **scaled}).drop("f", "tick", "imu_accel_range_g", "imu_gyro_range_dps")


def unparsed(records: DataFrame) -> DataFrame:
    """Records of an unknown tag or a wrong length, as hexadecimal text."""
    tag, n = F.col("tag"), F.length("payload")
    fits = (
        ((tag == CONFIG_TAG) & (n == SIZES["CFG "])) | ((tag == STATUS_TAG) & (n == SIZES["STAT"])) | ((tag == ANALOG_TAG) & (n == SIZES["ANLG"]))
        | ((tag == WHEEL_TAG) & (n == SIZES["WSPD"])) | ((tag == IMU_TAG) & (n >= IMU_HEADER))
    )
    return records.where("error is null").where(~fits).select("session_id", "n", "tag", n.alias("raw_len"), F.lower(F.hex("payload")).alias("raw_hex"))


def tag_counts(records: DataFrame) -> DataFrame:
    return records.where("error is null").groupBy("session_id", "tag").count()


def lost_records(records: DataFrame) -> DataFrame:
    """(session_id, lost): sequence numbers that no record has."""
    gap = F.col("seq") - F.lag("seq").over(W.partitionBy("session_id").orderBy("n")) - 1
    return records.where("error is null").withColumn("gap", gap).groupBy("session_id").agg(F.coalesce(F.sum(F.greatest("gap", F.lit(0))), F.lit(0)).alias("lost"))


def timeline(records: DataFrame) -> DataFrame:
    """All typed tables in one, with prefixed columns, ordered in each session by time."""
    parts = {"config": session_config(records), "status": status_table(records), "analog": analog_table(records), "wheel": wheel_table(records),
             "imu": imu_frames(records)}
    out = None
    for kind, df in parts.items():
        own = df.select(F.lit(kind).alias("event_type"), *_BASE, *[F.col(c).alias(f"{kind}_{c}") for c in df.columns if c not in _BASE])
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out.repartition("session_id").sortWithinPartitions("session_id", "t_us", "seq", "event_type")


def typed_tables(records: DataFrame, bits: int = 12, mm_per_count: float | None = None) -> dict[str, DataFrame]:
    good = unwrapped(records)
    return {
        "analog": analog_table(good, bits, mm_per_count), "wheel": wheel_table(good), "status": status_table(good), "config": session_config(good),
        "imu_bursts": imu_bursts(good), "imu_frames": imu_frames(good), "timeline": timeline(good), "sessions": sessions(records), "unparsed": unparsed(good),
    }


def export(records: DataFrame, folder: str, bits: int = 12, mm_per_count: float | None = None, fmt: str = "parquet") -> None:
    """Write each typed table below ``folder``, partitioned by session, replacing the sessions written."""
    for name, df in typed_tables(records, bits, mm_per_count).items():
        options = {"header": "true", "nullValue": "", "emptyValue": ""} if fmt == "csv" else {}
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**options).partitionBy("session_id").format(fmt).save(f"{folder}/{name}")
    broken = quarantine(records).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    broken.partitionBy("session_id").parquet(f"{folder}/quarantine")


def new_files(spark: SparkSession, paths: str | list[str], manifest: DataFrame) -> DataFrame:
    """Files that the manifest(path, length, modificationTime) does not hold as they are now."""
    files = spark.read.format("binaryFile").load(paths)
    return files.join(manifest, ["path", "length", "modificationTime"], "left_anti")
