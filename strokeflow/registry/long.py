"""Queries of the operators for sessions of any length: one session holds a third of all events."""

from __future__ import annotations

from strokeflow.operators import long, series
from strokeflow.registry.base import F, SQL, event_samples, query, rounded
from strokeflow.registry.ingest import _LEAST
from strokeflow.registry.series import KEY

#: Chunks of so few samples that even the small tables have many.
ROWS = 100


def samples(spark, folder):
    """The events with a third of them in one session."""
    hot = F.when(F.col("seq") % 3 == 0, F.lit(0)).otherwise(F.col("session_id"))
    return event_samples(spark, folder).withColumn("session_id", hot.cast("long"))


def hot_sql(name: str) -> str:
    """The SQL of a query of the plain operator, over those samples."""
    return SQL[name].replace("SELECT user_id AS session_id,", "SELECT CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS BIGINT) AS session_id,")


def _register(name: str, make) -> None:
    """``make(samples)`` under the plain query's name with ``_long`` behind it."""
    query(f"{name}_long", hot_sql(name))(lambda spark, folder: make(samples(spark, folder)))


def _windowed(make, halo, places=6):
    """A query of one column, made on chunks with a halo."""

    return lambda df: rounded(long.windowed(df, make, halo, rows=ROWS), places)


def _level(df):
    return df.withColumn("v", F.when(F.col("front") < 400, F.col("front")))


def _masked(df):
    return df.withColumn("m", F.col("front") > 60)


def _coded(df):
    c = F.when(F.col("front") < 40, 0).when(F.col("front") < 90, 1).otherwise(2)
    return df.withColumns({"c": c, "ok": F.col("code") != "error", "half": F.floor(F.col("rear") / 50)})


def _column(value, out):
    return lambda d, by, order: d.withColumn(out, value(by, order)).select(*KEY, out, long.CHUNK, "__home", long.PLACE)


_register("c6_moving_average", _windowed(_column(lambda by, o: series.moving_average(F.col("front"), 5, by, o), "smooth"), 2))
_register("c7_moving_average_known", lambda df: _windowed(_column(lambda by, o: series.moving_average_known(F.col("v"), 5, by, o), "smooth"), 2)(_level(df)))
_register("c8_rolling_sum", _windowed(_column(lambda by, o: series.rolling_sum(F.col("rear"), 7, by, o), "total"), 3))
_register("c9_gradient", _windowed(_column(lambda by, o: series.gradient(F.col("front"), F.col("t_h"), by, o), "slope"), 1, 5))
_register("c10_gradient_in_runs", lambda df: rounded(long.gradient_in_runs(_level(df), "v", "t_h", "slope", rows=ROWS).select(*KEY, "slope"), 5))
_register("c11_gradient_bridged", lambda df: rounded(long.gradient_bridged(_level(df), "v", "t_h", "slope", rows=ROWS).select(*KEY, "slope"), 5))
_register("c12_central_difference", _windowed(_column(lambda by, o: series.central_difference(F.col("front"), F.col("t_h"), by, o), "slope"), 1, 5))
_register("c16_sign_change", _windowed(_column(lambda by, o: series.sign_change(F.col("front") - 200, by, o), "crossed"), 1))
_register("c17_roughness", lambda df: rounded(long.windowed(df, lambda d, by, o: series.roughness(d, "front", "roughness", 5, by, o), 4, rows=ROWS).select(*KEY, "roughness"), 5))
_register("f1_runs", lambda df: long.runs(_masked(df), "m", [F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n")], rows=ROWS))
_register("f2_fill_gaps", lambda df: long.fill_gaps(_masked(df), "m", "filled", 2, rows=ROWS).select(*KEY, "filled"))
_register("f3_keep_long", lambda df: long.keep_long(_masked(df), "m", "kept", 3, rows=ROWS).select(*KEY, "kept"))
_register("f4_absorb_short", lambda df: long.absorb_short(_coded(df), "c", F.col("ok"), "state", 2, 1, rows=ROWS).select(*KEY, "state"))
_register("f5_segment_ids", lambda df: long.segment_ids(_coded(df), ["c", "half"], F.col("ok"), "segment", rows=ROWS).select(*KEY, "segment"))


def _clicks(df):
    return df.where("code = 'click'").select("session_id", "t_h", F.col("front").alias("v"), series.step("t_h").alias("p"))


_register("d1_asof_hold", lambda df: rounded(long.hold_with_timeout(df.select("session_id", "seq", "t_h"), _clicks(df), "t_h", "v", "p", "speed", rows=ROWS).select(*KEY, "speed", "speed_held")))
_register("d2_interp_join", lambda df: rounded(
    long.interpolate_join(df.select("session_id", "seq", "t_h"), df.where("code = 'view'").select("session_id", "t_h", "rear"), "t_h", "rear", "rear_at", rows=ROWS).select(*KEY, "rear_at")))
_register("d4_interp_gaps", lambda df: rounded(long.interpolate_gaps(_level(df), "v", "t_h", "filled", rows=ROWS).select(*KEY, "filled")))
_register("k2_debounce", lambda df: long.debounce(df, _LEAST, rows=ROWS))
