"""A first look at every session: duration, stroke, runs near full stroke and status health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strokeflow.operators import metrics, stats
from strokeflow.operators.series import in_order, percent_scale, per_session

#: Status names that are part of a normal session.
NOMINAL = ("BOOT", "RTC_VALID", "SD_READY", "IMU_READY", "SESSION_START", "SESSION_STOP", "CLEAN_CLOSE")


def quicklook(channels: DataFrame, status: DataFrame, near_full: float = 95.0) -> DataFrame:
    """(session_id, channel) rows from channel samples (dt, travel) and status(session_id, name)."""
    by = metrics.KEY
    df = per_session(channels, [F.min("travel").alias("__lo"), F.max("travel").alias("__hi")], by)
    on = percent_scale(F.col("travel"), F.col("__lo"), F.col("__hi")) >= near_full
    df = df.withColumn("__on", F.coalesce(on, F.lit(False)))
    df = df.withColumn("__rise", F.col("__on") & ~F.coalesce(F.lag("__on").over(in_order(by)), F.lit(False)))
    per_channel = df.groupBy(*by).agg(
        F.sum("dt").alias("duration"), (F.max("travel") - F.min("travel")).alias("used_stroke"),
        stats.share_where(F.col("__on"), F.col("dt")).alias("near_full_pct"), F.count_if("__rise").alias("near_full_runs"),
    )
    health = status.groupBy("session_id").agg(
        F.count_if(~F.col("name").isin(*NOMINAL)).alias("faults"), F.bool_or(F.col("name") == "CLEAN_CLOSE").alias("clean_close")
    )
    return per_channel.join(health, "session_id", "left")


def write_quicklook(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)
