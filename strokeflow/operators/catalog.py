"""The catalogue of sessions: metadata, labels, freshness and comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TEXTS = ("date", "track", "set_label", "comment")


def utc_date(epoch: Column) -> Column:
    """Date of seconds since 1970 in UTC; '' where there is none."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch / 86400).cast("int"))
    return F.coalesce(F.when(epoch > 0, F.date_format(day, "yyyy-MM-dd")), F.lit(""))


def merge_metadata(sessions: DataFrame, metadata: DataFrame) -> DataFrame:
    """Sessions with their texts: stored ones trimmed, else the defaults; identity stays the session's.

    ``set_label_auto`` is taken as true where it was not stored and the label is empty or the id.
    """
    m = metadata.select(F.col("session_id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in (*TEXTS, "set_label_auto")])
    df = sessions.join(m, F.col("session_id") == F.col("__id"), "left")
    stored = F.col("__id").isNotNull()
    default = {"date": utc_date(F.col("start_epoch")), "track": F.lit(""), "set_label": F.lit(""), "comment": F.lit("")}
    texts = {c: F.when(stored, F.trim(F.coalesce(f"__{c}", F.lit("")))).otherwise(default[c]) for c in TEXTS}
    inferred = F.trim(F.coalesce("__set_label", F.lit(""))).isin("") | (F.trim("__set_label") == F.col("session_id").cast("string"))
    auto = F.when(stored, F.coalesce("__set_label_auto", inferred)).otherwise(True)
    return df.withColumns({**texts, "set_label_auto": auto}).drop("__id", *[f"__{c}" for c in (*TEXTS, "set_label_auto")])


def auto_labels(catalog: DataFrame) -> DataFrame:
    """Number a day's sessions by start: ``Set k``; labels set by hand stay but use up their number."""
    w = W.partitionBy(F.coalesce(F.nullif(F.col("date"), F.lit("")), F.lit("undated"))).orderBy("start_epoch", "session_id")
    own = ~F.col("set_label_auto") & (F.col("set_label") != "")
    label = F.when(own, F.col("set_label")).otherwise(F.concat(F.lit("Set "), F.row_number().over(w).cast("string")))
    return catalog.withColumns({"set_label": label, "set_label_auto": ~own})


def display_label(*parts: Column) -> Column:
    """The non-empty parts joined by `` | ``."""
    return F.concat_ws(" | ", *[F.nullif(F.trim(p.cast("string")), F.lit("")) for p in parts])


def newest_first(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(F.desc("start_epoch"), F.desc("session_id"))


def grouped(catalog: DataFrame) -> DataFrame:
    """Sessions and distinct days of each (date, track), each date and in all."""
    return catalog.rollup("date", "track").agg(F.count("*").alias("sessions"), F.count_distinct("date").alias("days"))


def stale(current: DataFrame, done: DataFrame) -> DataFrame:
    """Sessions whose signature is not among those analysed."""
    return current.join(done, ["session_id", "signature"], "left_anti")


def signature(*columns: str) -> Column:
    """SHA-256 of what an analysis depends on."""
    return F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256)


def pick_sessions(catalog: DataFrame, ids: list[str], most: int = 10) -> DataFrame:
    """The first ``most`` of the asked sessions, at least two; ValueError otherwise."""
    wanted = list(dict.fromkeys(ids))[:most]
    if len(wanted) < 2:
        raise ValueError("a comparison takes at least two sessions")
    return catalog.where(F.col("session_id").isin(wanted))


def compare(metrics: DataFrame, labels: DataFrame, most: int = 10) -> DataFrame:
    """(channel, metric, units) rows with a column for each of at most ``most`` labels(session_id, label)."""
    names = [r["label"] for r in labels.select("label").orderBy("label").limit(most + 1).collect()]
    if not 2 <= len(names) <= most:
        raise ValueError(f"a comparison takes 2 to {most} sessions")
    rows = metrics.join(F.broadcast(labels), "session_id")
    return rows.groupBy("channel", "metric", "units").pivot("label", names).agg(F.first("value"))


def apply_template(configs: DataFrame, template: DataFrame, fields: list[str]) -> DataFrame:
    """Copy named fields of a one-row template to all configurations; the others stay."""
    row = template.select(*fields).first()
    if row is None:
        return configs.where("false")
    return configs.withColumns({c: F.lit(row[c]).cast(template.schema[c].dataType) for c in fields})


#: What the summary of an exported session counts and measures.
COUNTS = ("analog_rows", "wheel_rows", "stat_rows", "imu_burst_rows", "imu_frame_rows")
EXTENTS = ("front_raw_min", "front_raw_max", "rear_raw_min", "rear_raw_max")
SUMMARY = (
    "session_id string, source_path string, file_size_bytes long, header struct<start_epoch:long, build_id:string, analog_resolution_bits:int>,"
    " record_counts map<string, long>, derived_scales struct<front_mm_per_count:double, rear_mm_per_count:double>,"
    f" counts struct<{', '.join(f'{c}:long' for c in COUNTS)}>,"
    " timing struct<first_host_timestamp_us:long, last_host_timestamp_us:long, duration_us:long>,"
    f" analog_extents struct<{', '.join(f'{c}:int' for c in EXTENTS)}>, _corrupt_record string"
)


def scan_summaries(spark: SparkSession, paths: str | list[str], current: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Sessions with a readable summary; broken ones are left out.

    A summary is a line of an export's summary table (``part-*``), or a file of its own
    (``summary.json``) in a session's folder, which then names the session. Where summaries were written in runs
    (``run=``), ``current`` picks from rows with session_id and run those that hold.
    """
    schema = SUMMARY.replace(", _corrupt_record string", "")
    files = spark.read.options(recursiveFileLookup="true")
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    own = files.option("pathGlobFilter", "summary.json").text(paths, wholetext=True).select("value", F.url_decode(folder).alias("__folder"), F.lit(None).cast("long").alias("run"))
    run = F.nullif(F.regexp_extract(folder, r"^run=(\d+)$", 1), F.lit("")).cast("long")
    lines = files.option("pathGlobFilter", "part-*").text(paths).select("value", F.lit(None).cast("string").alias("__folder"), run.alias("run"))
    # Parsed as text: the reader of JSON refuses queries that ask for nothing but the mark of broken lines.
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = own.unionByName(lines).select("__folder", "run", parsed.alias("x")).where("x is not null and x._corrupt_record is null").select("__folder", "run", "x.*").drop("_corrupt_record")
    rows = rows.withColumn("session_id", F.coalesce("__folder", "session_id")).drop("__folder").where("session_id is not null")
    rows = rows.drop("run") if current is None else rows.where("run is null").drop("run").unionByName(current(rows.where("run is not null")))
    return rows.withColumns({"start_epoch": F.col("header.start_epoch"), "duration_us": F.col("timing.duration_us")})
