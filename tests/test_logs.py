"""Ingest of logs written from the format, and the streams."""

import struct

import pytest
from pyspark.sql import functions as F

from strokeflow.sources import logs, ranges
from strokeflow.streaming import logs as streams


def header(epoch=1776470400):
    return logs.FILE_HEADER.pack(b"STLOG1", 1, 100, 3, 0, b"build", epoch, 0, 1, 1, 0, 12, 8, 500, 416, 32, 16, *[0] * 14)


def record(tag, seq, t, body, flags=0):
    return logs.RECORD_HEADER.pack(tag, len(body), flags, seq, t % 2**32) + body


def config(circumference=2.0):
    return struct.pack("<HBB4If4HBBH", 500, 12, 8, 20, 800, 1500, 3000, circumference, 4, 500, 416, 32, 6, 1, 0)


def burst():
    frames = b"".join([
        struct.pack("<B6s", 4 << 3, struct.pack("<IH", 1000, 0)), struct.pack("<Bhhh", (2 << 3) | 2 | 1, 1000, -2000, 8192),
        struct.pack("<B6s", 4 << 3, struct.pack("<IH", 1004, 0)), struct.pack("<Bhhh", 1 << 3, 100, 0, -100), struct.pack("<Bhhh", 30 << 3, 1, 2, 3), b"\x01\x02",
    ])
    return struct.pack("<I7H2I", 9, 5, 1, 1, 2, 5, 0, 0, 1000, 1008) + frames


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path, top = tmp_path_factory.mktemp("logs"), 2**32
    good = header() + b"".join([
        record(b"CFG ", 1, top - 2000, config()), record(b"ANLG", 2, top - 1000, struct.pack("<IHH", 0, 100, 4095)),
        record(b"ANLG", 3, 1000, struct.pack("<IHH", 1, 110, 0)), record(b"ANLG", 4, 3000, struct.pack("<IHH", 2, 120, 5)),
        record(b"WSPD", 6, 3500, struct.pack("<II", 1, 500_000)), record(b"WSPD", 7, 3600, struct.pack("<II", 2, 0)), record(b"IMU ", 8, 3700, burst()),
        record(b"XYZ1", 9, 3800, b"\x0a\xff"), record(b"STAT", 10, 4000, struct.pack("<HHii", 9, 0, -7, 1)), record(b"STAT", 11, 4100, struct.pack("<HHii", 77, 0, 0, 0)),
    ])
    (path / "LOG1.BIN").write_bytes(good)
    (path / "LOG2.BIN").write_bytes(header() + record(b"STAT", 1, 5, struct.pack("<HHii", 8, 0, 0, 0)))
    (path / "LOG3.BIN").write_bytes(b"not a real log")
    (path / "LOG4.BIN").write_bytes(good[:-3])
    (path / "LOG5.BIN").write_bytes(good + b"\0\0")
    return str(path)


def test_frames_and_quarantine(spark, folder):
    r = logs.read_records(spark, f"{folder}/*.BIN")
    assert {(x.session_id, x.tag): x["count"] for x in logs.tag_counts(r).collect()}["LOG1", "ANLG"] == 3
    bad = {x.path.rsplit("/", 1)[1]: x.error for x in logs.quarantine(r).collect()}
    assert set(bad) == {"LOG3.BIN", "LOG4.BIN", "LOG5.BIN"} and "shorter" in bad["LOG3.BIN"] and "trailing" in bad["LOG5.BIN"]
    s = {x.session_id: x for x in logs.sessions(r).collect()}
    assert s["LOG1"].start_epoch == 1776470400 and s["LOG1"].build == "build" and s["LOG1"].records == 10
    assert {x.session_id: x.lost for x in logs.lost_records(r).collect()}["LOG1"] == 1
    with pytest.raises(Exception, match="shorter"):
        logs.read_records(spark, f"{folder}/LOG3.BIN", failfast=True).count()


def test_typed_tables(spark, folder):
    t = logs.typed_tables(logs.read_records(spark, f"{folder}/*.BIN"))
    top = 2**32
    a = t["analog"].orderBy("t_us").collect()
    assert [x.t_us for x in a] == [top - 1000, top + 1000, top + 3000] and [x.dt_us for x in a] == [None, 2000, 2000]
    assert a[0].rear_norm == 1.0 and a[0].front_mm is None
    c = t["config"].first()
    assert (c.analog_rate_hz, c.analog_resolution_bits, c.wheel_circumference_m, c.imu_accel_range_g, c.imu_gyro_range_dps) == (500, 12, 2.0, 4, 500)
    w = t["wheel"].orderBy("pulse_count").collect()
    assert w[0].speed_kph == pytest.approx(14.4) and w[0].speed_mph == pytest.approx(4 * 2.2369362920544) and w[1].speed_kph is None
    st = t["status"].where("session_id = 'LOG1'").orderBy("t_us").collect()
    assert (st[0].name, st[0].stop_reason, st[0].value0) == ("SESSION_STOP", "SWITCH_OFF", -7) and st[1].name == "UNKNOWN_77" and st[1].stop_reason is None
    f = t["imu_frames"].orderBy("frame_index").collect()
    assert [x.tag_name for x in f] == ["TIMESTAMP", "ACCEL_NC", "TIMESTAMP", "GYRO_NC", "UNKNOWN_30"]
    assert f[1].accel_x_g == pytest.approx(0.122) and f[1].accel_y_g == pytest.approx(-0.244) and f[1].gyro_x_dps is None and (f[1].tag_counter, f[1].tag_parity) == (1, 1)
    assert f[3].gyro_z_dps == pytest.approx(-1.75) and f[1].estimated_t_us == top + 3700 - 8 * 25 and f[3].estimated_t_us == top + 3700 - 4 * 25
    assert [(x.tag, x.raw_len, x.raw_hex) for x in t["unparsed"].collect()] == [("XYZ1", 2, "0aff")]
    line = t["timeline"].where("session_id = 'LOG1'").orderBy("t_us", "seq").select("event_type").collect()
    assert [x.event_type for x in line] == ["config", "analog", "analog", "analog", "wheel", "wheel", *["imu"] * 5, "status", "status"]


def test_float32_columns(spark):
    v = [0.0, 1.5, -2.25, 2.074, 1e-40, 3.4e38]
    df = spark.createDataFrame([(struct.pack("<f", x),) for x in v], "b binary")
    got = [r.x for r in df.select(logs.float32(F.col("b"), 0).alias("x")).collect()]
    assert got == [struct.unpack("<f", struct.pack("<f", x))[0] for x in v]
    bad = spark.createDataFrame([(struct.pack("<f", float("nan")),)], "b binary")
    assert bad.select(logs.float32(F.col("b"), 0).alias("x")).first().x is None


def test_export_twice_gives_the_same_tables(spark, folder, tmp_path):
    r = logs.read_records(spark, f"{folder}/LOG1.BIN")
    for _ in range(2):
        logs.export(r, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/analog").count() == 3 and spark.read.parquet(f"{tmp_path}/timeline").count() == 13
    logs.export(r, str(tmp_path / "csv"), fmt="csv")
    assert spark.read.csv(f"{tmp_path}/csv/wheel", header=True).count() == 2


def test_files_with_one_name_do_not_mix(spark, folder, tmp_path):
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "LOG1.BIN").write_bytes(header() + record(b"STAT", 1, 5, struct.pack("<HHii", 8, 0, 0, 0)))
    (tmp_path / "b" / "LOG2.BIN").write_bytes(header() + record(b"STAT", 1, 5, struct.pack("<HHii", 8, 0, 0, 0)))
    r = logs.read_records(spark, f"{tmp_path}/*/*.BIN")
    assert [x.session_id for x in logs.sessions(r).collect()] == ["LOG2"]
    assert [(x.session_id, x.error) for x in logs.quarantine(r).collect()] == [("LOG1", "another file has this session's name")] * 2
    for _ in range(2):
        logs.export(r, str(tmp_path / "out"))
    assert spark.read.parquet(f"{tmp_path}/out/quarantine").count() == 2


def test_long_logs_come_in_batches(spark, tmp_path, monkeypatch):
    body = b"".join(record(b"ANLG", i, i * 2000, struct.pack("<IHH", i, i % 4096, 7)) for i in range(1, 25))
    monkeypatch.setattr(logs, "BATCH", 10)
    batches = list(logs._framed("LOG1.BIN", header() + body, False))
    assert [b.num_rows for b in batches] == [10, 10, 4] and batches[0].column("file_size")[0].as_py() == 100 + len(body)
    with pytest.raises(logs.LogError, match="cut short"):
        next(logs._framed("LOG1.BIN", header() + body[:-1], False))


def test_header_fields(spark, folder):
    h = logs.sessions(logs.read_records(spark, f"{folder}/LOG1.BIN")).select(logs.header_fields(F.col("head")).alias("h")).first().h
    assert (h.magic, h.build_id, h.format_version, h.start_epoch, h.analog_rate_hz, h.imu_rate_hz, h.record_header_size) == ("STLOG1", "build", 1, 1776470400, 500, 416, 16)


def test_new_files(spark, folder):
    files = spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
    manifest = files.where("path not like '%LOG2%'")
    assert [x.path.rsplit("/", 1)[1] for x in logs.new_files(spark, folder, manifest).collect()] == ["LOG2.BIN"]


def test_stream_of_logs(spark, folder, tmp_path):
    seen = []
    q = streams.stream_logs(spark, folder, str(tmp_path / "c"), lambda df, no: seen.extend(r.session_id for r in df.where("error is null").select("session_id").distinct().collect()))
    q.awaitTermination(120)
    assert sorted(seen) == ["LOG1", "LOG2"]
    streams.stream_logs(spark, folder, str(tmp_path / "c"), lambda df, no: seen.append("again")).awaitTermination(120)
    assert "again" not in seen


def test_debounce_batch_and_stream(spark, tmp_path):
    times = [0, 1000, 2999, 3000, 5000, 6001, 6002, 20_000]
    df = spark.createDataFrame([("s", t) for t in times], "session_id string, t_us long")
    want = [(0, 0, 1), (3000, 3000, 2), (6001, 3001, 3), (20_000, 13_999, 4)]
    assert [(r.t_us, r.interval_us, r.pulse_count) for r in streams.debounce(df).orderBy("t_us").collect()] == want
    for i in range(2):
        df.where(f"t_us {'<' if i == 0 else '>='} 4000").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = streams.debounce_stream(src).writeStream.format("memory").queryName("pulses").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert [(r.t_us, r.interval_us, r.pulse_count) for r in spark.table("pulses").orderBy("t_us").collect()] == want


def test_debounced_stream_takes_pulses_in_order_across_batches(spark, tmp_path):
    times = [0, 1000, 2999, 3000, 5000, 6001, 6002, 20_000, 21_000, 26_000, 29_500]
    start = 10_000_000  # the first watermark is at 0
    df = spark.createDataFrame([("s", start + t) for t in times] + [("r", start + t + 7) for t in times], "session_id string, t_us long")
    want = sorted(map(str, streams.debounce(df).collect()))
    later = spark.createDataFrame([("z", 5_000_000_000)], df.schema), spark.createDataFrame([("z", 9_000_000_000)], df.schema)
    for part in (df.where("t_us % 2 = 0"), df.where("t_us % 2 = 1"), *later):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    out = streams.debounce_stream(src, late="1 second", idle_ms=60_000)
    q = out.writeStream.format("memory").queryName("ordered").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert sorted(map(str, spark.table("ordered").where("session_id <> 'z'").collect())) == want


def test_fault_counts(spark):
    df = spark.sql("select 's' session_id, 'X' name, 2 value0, timestamp'2026-01-01 00:00:10' event_time union all select 's', 'X', 3, timestamp'2026-01-01 00:00:50'")
    r = streams.fault_counts(df).first()
    assert (r.faults, r.reports) == (5, 2)


def _rows(df):
    return sorted(map(str, df.select("session_id", "error", "n", "tag", "flags", "seq", "t_us", F.hex("payload"), F.hex("head"), "file_size").collect()))


@pytest.fixture(scope="module")
def tricky(tmp_path_factory):
    """Payloads that look like records, a long one, a clock that wraps, and files that break off in many ways."""
    path, top = tmp_path_factory.mktemp("tricky"), 2**32
    fake = b"".join(record(b"ANLG", 900 + i, 5, struct.pack("<IHH", i, 1, 2)) for i in range(40))
    body = b"".join(
        record(*x) for i in range(60)
        for x in ((b"ANLG", 3 * i, top - 30_000 + 1000 * i, struct.pack("<IHH", i, 1, 2)), (b"XYZ1", 3 * i + 1, 1000 * i, fake if i % 9 == 4 else b""), (b"\x01\x02 !", 3 * i + 2, 1000 * i, b"ANLG" * (i % 3)))
    )
    files = {
        "A.BIN": header() + body, "B.BIN": header() + record(b"CFG ", 1, 5, config()) + record(b"RAW ", 2, 6, fake * 20) + body, "C.BIN": header(), "D.BIN": b"", "E.BIN": header()[:50],
        "F.BIN": header() + body + b"ANLG", "G.BIN": header() + body[:-1] + record(b"ANLG", 1, 2, b"12345678")[:-3], "H.BIN": b"X" + header()[1:] + body, "sub/A.BIN": header(),
    }
    (path / "sub").mkdir()
    for name, data in files.items():
        (path / name).write_bytes(data)
    return path


@pytest.mark.parametrize("size", [50, 97, 1000, 20_000, 1 << 20])
def test_ranges_of_any_size_give_the_rows_of_whole_files(spark, tricky, size):
    paths = [f"{tricky}/*.BIN", f"{tricky}/sub/*.BIN"]
    whole, parts = logs.read_records(spark, paths), logs.read_records(spark, paths, range_bytes=size)
    assert _rows(whole) == _rows(parts)
    key = ["session_id", "n", "t_us"]
    assert sorted(logs.unwrapped(whole).select(key).collect()) == sorted(logs.unwrapped(parts).select(key).collect())


def test_a_wrong_guess_is_walked_again_from_the_true_record(tricky):
    data = (tricky / "B.BIN").read_bytes()
    inside = data.index(b"RAW ") + 500
    window = ranges._Window(str(tricky / "B.BIN"), len(data), inside, 2000)
    guess = window.guess(inside, inside + 400)
    true = [at for at, _ in ranges._Window(str(tricky / "B.BIN"), len(data), 0, len(data)).walk(len(header()), len(data))]
    assert guess is not None and guess not in true


def test_large_files_are_read_by_ranges(spark, tricky, monkeypatch):
    monkeypatch.setattr(logs, "WHOLE_BYTES", 1000)
    assert "wraps" in logs.read_records(spark, f"{tricky}/B.BIN").columns
    with pytest.raises(logs.LogError):
        logs.read_records(spark, f"{tricky}/F.BIN", failfast=True)


def test_store_of_arriving_logs(spark, tmp_path):
    def put(name, n):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(header() + b"".join(record(b"ANLG", i, i, struct.pack("<IHH", i, 1, 2)) for i in range(n)))

    def seen():
        return {(r.session_id, r.path.split("/in/")[1], r.records, r.error) for r in store.commits().collect()}, dict(store.records().groupBy("session_id").count().collect())

    store = streams.LogStore(spark, f"file://{tmp_path}/store")
    put("a/L1.BIN", 3)
    (tmp_path / "in/a/L2.BIN").write_bytes(header()[:9])
    store.start(f"file://{tmp_path}/in", f"file://{tmp_path}/checkpoint", 64).awaitTermination()
    first = {("L1", "a/L1.BIN", 3, None), ("L2", "a/L2.BIN", 0, "file is shorter than its header")}
    assert seen() == (first, {"L1": 3})
    put("b/L1.BIN", 5)
    put("b/L3.BIN", 2)
    # A checkpoint is lost: the first files come again, and stay as they were.
    store.start(f"file://{tmp_path}/in", f"file://{tmp_path}/other", 64).awaitTermination()
    both = first | {("L1", "b/L1.BIN", 0, logs.CLASH), ("L3", "b/L3.BIN", 2, None)}
    assert seen() == (both, {"L1": 3, "L3": 2})
    # A batch that is taken in again replaces what it had written.
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/in/b/*.BIN").select("path", "length", "modificationTime")
    stream = store.commits().where("session_id = 'L3'").first()
    store.take(files, stream.stream, stream.batch, 64)
    assert seen() == (both, {"L1": 3, "L3": 2})


def test_short_files_and_ranges_share_batches(folder):
    """F1, F16: a file or range of a few records must not make a batch of its own."""
    import os

    import pyarrow as pa

    names = sorted(f"{folder}/{n}" for n in os.listdir(folder) if n.endswith(".BIN"))
    files = pa.RecordBatch.from_pylist([{"path": n, "length": os.path.getsize(n)} for n in names * 3])
    batches = list(ranges._records(ranges._whole)([files]))
    one = [list(ranges._records(ranges._whole)([files.slice(i, 1)])) for i in range(len(names))]
    assert len(names) > 1 and len(batches) == 1 and batches[0].num_rows == 3 * sum(b.num_rows for bs in one for b in bs)
    assert any(x is not None for x in batches[0].column("error").to_pylist()) == any(x is not None for bs in one for b in bs for x in b.column("error").to_pylist())


def test_files_are_shared_out_over_all_tasks(spark, folder):
    """the names of many files are few bytes, which adaptive execution would join in one task."""
    files = spark.read.format("binaryFile").load(f"{folder}/*.BIN").select("path", "length")
    assert ranges.read_ranges(files).rdd.getNumPartitions() >= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
