"""Export folders, stored configurations and the opening of sessions."""

import pytest
from pyspark.sql import functions as F

from strokeflow.operators import catalog
from strokeflow.sources import exports, logs, published
from tests.test_logs import folder  # noqa: F401

NAMES = [c.split()[0] for c in exports.TABLES["analog"].split(", ")]


@pytest.fixture
def root(tmp_path):
    for s, values in (("S1", [100, 100, 140]), ("S2", [50, "", 60])):
        (tmp_path / "in" / s).mkdir(parents=True)
        rows = []
        for i, v in enumerate(values):
            row = dict.fromkeys(NAMES, "") | {"record_seq": i, "host_timestamp_us": i * 2000, "host_time_s": i * 0.002, "front_raw": v, "rear_raw": 7}
            rows.append(",".join(str(row[n]) for n in NAMES))
        (tmp_path / "in" / s / "analog.csv").write_text("\n".join([",".join(NAMES), *rows]) + "\n")
    (tmp_path / "in" / "S1" / "wheel.csv").write_text(
        "record_seq,record_flags,host_timestamp_us,host_time_s,pulse_count,interval_us,period_s,speed_m_s,speed_kph,speed_mph\n"
        "1,0,10,0.00001,1,500000,0.5,4,14.4,8.9\n2,0,20,0.00002,2,1,,900,3240,2013\n"
    )
    return str(tmp_path / "in")


def test_tables_of_export_folders(spark, root):
    a = {(r.session_id, r.seq): r for r in exports.read_table(spark, root, "analog").collect()}
    assert len(a) == 6 and a["S1", 2].front_raw == 140 and a["S2", 1].front_raw is None and a["S2", 2].t_us == 4000 and a["S1", 0].front_mm is None
    assert exports.read_table(spark, root, "imu_frames").count() == 0 and exports.read_table(spark, root + "/nowhere", "status").count() == 0


def test_open_configure_and_derive_again(spark, root, tmp_path):
    store = str(tmp_path / "configs")
    got = exports.open_sessions(spark, root, store)
    w = got["wheel"].orderBy("seq").collect()
    assert w[0].speed_kph == 14.4 and w[1].speed_kph is None and w[1].speed_kph_raw == 3240
    c = {(r.session_id, r.channel): r for r in got["configs"].collect()}
    assert c["S1", "front"].zero == 100 and c["S1", "front"].full_scale_mm == 300 and c["S1", "rear"].full_scale_mm is None and len(c) == 4
    d = {(r.session_id, r.channel, r.seq): r for r in got["derived"].collect()}
    assert d["S1", "front", 2].travel == 40 and d["S1", "front", 2].mm == pytest.approx(40 * 635 / 4095) and d["S1", "rear", 0].mm is None
    assert d["S1", "front", 0].basis == "configured" and d["S1", "rear", 0].basis == "used"
    changed = got["configs"].withColumn("invert", F.col("channel") == "front").withColumn("zero", F.when(F.col("session_id") == "S1", 120.0).otherwise(F.col("zero")))
    exports.save_by_session(changed.where("session_id = 'S1'"), store)
    again = exports.open_sessions(spark, root, store)
    d = {(r.session_id, r.channel, r.seq): r for r in again["derived"].collect()}
    assert d["S1", "front", 2].travel == -20 and d["S2", "front", 2].travel == 60 - d["S2", "front", 0].zero
    exports.save_by_session(again["derived"], str(tmp_path / "derived"))
    exports.save_by_session(again["derived"].where("session_id = 'S2'"), str(tmp_path / "derived"))
    assert spark.read.parquet(str(tmp_path / "derived")).count() == len(d)


def test_written_exports_are_read_back(spark, folder, tmp_path):  # noqa: F811
    root = str(tmp_path / "out")
    records = logs.read_records(spark, f"{folder}/*.BIN")
    for _ in range(2):
        exports.write_exports(records, root, zero={"front": 100}, invert={"rear": True}, mm_per_count={"front": 0.5})
    written = exports.export_tables(records, zero={"front": 100}, invert={"rear": True}, mm_per_count={"front": 0.5})
    for name in exports.TABLES:
        back = exports.read_table(spark, root, name)
        names = ({"flags": "status_flags"} if name == "status" else {}) | exports.COMMON
        want = written[name].select("session_id", *[F.col(c).alias(names.get(c, c)) for c in exports.columns_of(name)])
        assert sorted(map(str, back.collect())) == sorted(map(str, want.collect())), name
    a = exports.read_table(spark, root, "analog").orderBy("seq").collect()
    assert [x.front_position_counts for x in a] == [0, 10, 20] and a[1].rear_position_counts == 0 and a[1].front_mm == 5.0 and a[1].rear_mm is None
    assert a[1].front_velocity_counts_per_s == pytest.approx(20 * 1e6 / 4000) and a[0].front_velocity_counts_per_s == pytest.approx(10 * 1e6 / 2000)
    lines = spark.read.text(f"{root}/timeline/session_id=LOG1").collect()
    assert lines[0].value.split(",") == exports.columns_of("timeline") and len(exports.columns_of("timeline")) == 62
    found = {x.session_id: x for x in catalog.scan_summaries(spark, f"{root}/summary").collect()}
    assert set(found) == {"LOG1", "LOG2"} and found["LOG1"].counts.imu_frame_rows == 5 and found["LOG1"].record_counts["ANLG"] == 3
    assert found["LOG1"].duration_us == 6100 and found["LOG1"].analog_extents.rear_raw_max == 4095 and found["LOG2"].analog_extents is None
    opened, direct = exports.open_sessions(spark, root), exports.open_sessions(spark, f"{folder}/LOG1.BIN")
    columns = ["session_id", "channel", "seq", "travel", "mm"]
    assert sorted(map(str, opened["derived"].select(columns).collect())) == sorted(map(str, direct["derived"].select(columns).collect()))


def test_summaries_in_folders(spark, tmp_path):
    for name, text in (("S1", '{\n "header": {"start_epoch": 7},\n "timing": {"duration_us": 5}\n}'), ("S2", "{broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "summary.json").write_text(text)
    assert [(r.session_id, r.start_epoch, r.duration_us) for r in catalog.scan_summaries(spark, str(tmp_path)).collect()] == [("S1", 7, 5)]


def test_open_logs(spark, folder):  # noqa: F811
    got = exports.open_sessions(spark, f"{folder}/LOG1.BIN")
    assert got["derived"].count() == 6 and got["imu_bursts"].first().timestamp_frames == 2 and got["imu_bursts"].first().last_timestamp_us == 1008 * 25
    assert got["wheel"].where("speed_kph > 0").count() == 1
    with pytest.raises(ValueError, match="either all logs"):
        exports.open_sessions(spark, [f"{folder}/LOG1.BIN", folder])


def test_summaries_of_earlier_exports_stay(spark, folder, tmp_path):
    records = logs.read_records(spark, f"{folder}/*.BIN")
    ids = [r.session_id for r in logs.sessions(records).orderBy("session_id").collect()]
    for one in [*ids, ids[0]]:
        exports.write_exports(records.where(F.col("session_id") == one), str(tmp_path))
    found = catalog.scan_summaries(spark, f"{tmp_path}/summary")
    assert found.count() == len(ids) and sorted(r.session_id for r in found.select("session_id").collect()) == ids


def test_only_changed_sessions_are_published_and_a_broken_run_shows_nothing(spark, tmp_path):
    store, asked = published.Published(spark, str(tmp_path)), []

    def run(signatures, broken=False):
        def build(stale):
            asked.append(sorted(r.session_id for r in stale.collect()))
            rows = stale.withColumn("v", F.lit(len(asked)))
            return {"a": rows, "b": rows.where(F.raise_error(F.lit("broken")).isNull()) if broken else rows}

        current = spark.createDataFrame(list(signatures.items()), "session_id string, signature string")
        store.publish(current, build)

    def seen():
        return [{r.session_id: r.v for r in store.read(name).collect()} for name in ("a", "b")]

    run({"x": "1", "y": "1"})
    run({"x": "1", "y": "1"})
    assert asked == [["x", "y"]] and seen() == [{"x": 1, "y": 1}] * 2
    with pytest.raises(Exception, match="broken"):
        run({"x": "2", "y": "1", "z": "1"}, broken=True)
    assert seen() == [{"x": 1, "y": 1}] * 2
    run({"x": "2", "y": "1", "z": "1"})
    assert asked[1:] == [["x", "z"]] * 2 and seen() == [{"x": 3, "y": 1, "z": 3}] * 2


def test_exports_by_run_share_files_and_show_the_last_run(spark, folder, tmp_path):  # noqa: F811
    """F2 to F13: the number of files must not grow with that of the sessions."""
    root, records = str(tmp_path / "runs"), logs.read_records(spark, f"{folder}/*.BIN")
    exports.write_exports(records, root, by="run", zero={"front": 50})
    exports.write_exports(records.where("session_id = 'LOG1'"), root, by="run", zero={"front": 100})
    assert not list((tmp_path / "runs").rglob("session*=*"))
    for name in exports.TABLES:
        names = ({"flags": "status_flags"} if name == "status" else {}) | exports.COMMON
        want = exports.export_tables(records, zero={"front": 100})[name].select("session_id", *[F.col(c).alias(names.get(c, c)) for c in exports.columns_of(name)])
        assert sorted(map(str, exports.read_table(spark, root, name).collect())) == sorted(map(str, want.collect())), name
    assert exports.read_timeline(spark, root).columns == ["session_id", *exports.columns_of("timeline")]
    found = exports.read_summaries(spark, root)
    assert sorted(r.session_id for r in found.collect()) == ["LOG1", "LOG2"]
    with pytest.raises(ValueError, match="other form"):
        exports.write_exports(records, root)


def test_configurations_saved_by_run_share_files(spark, tmp_path):
    store = str(tmp_path / "configs")
    fields = {n: F.lit(None).cast(t) for n, t in exports.CONFIG_FIELDS.items()}
    rows = spark.range(50).select(F.concat(F.lit("S"), "id").alias("session_id"), F.lit("front").alias("channel"), *[c.alias(n) for n, c in fields.items()])
    exports.save_by_run(rows.withColumn("zero", F.lit(1.0)), store)
    exports.save_by_run(rows.where("session_id = 'S7'").withColumn("zero", F.lit(2.0)), store)
    assert len(list((tmp_path / "configs").rglob("part-*"))) < 50
    zeros = rows.select("session_id", "channel", F.lit(0.0).alias("zero"), "source_path")
    assert {r.session_id: r.zero for r in exports.load_configs(spark, store, zeros).collect()} == {f"S{i}": 2.0 if i == 7 else 1.0 for i in range(50)}
