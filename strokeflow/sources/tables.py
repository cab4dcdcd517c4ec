"""The tables of a folder, and the event stream seen as recorded sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_samples(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as session samples: a user's events are a session, its value and ``k`` two channels.

    Time is in hours (``t_h``) besides microseconds, as events lie hours apart.
    """
    t_us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, folder, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), t_us.alias("t_us"),
        (t_us / 3.6e9).alias("t_h"), F.col("value").cast("double").alias("front"),
        F.get_json_object("props", "$.k").cast("double").alias("rear"), F.col("event_type").alias("code"),
    )
