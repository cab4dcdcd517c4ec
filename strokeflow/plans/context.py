"""The context dataset: each sample with its wheel speed, inertial values and responses side by side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strokeflow.operators import asof, series

#: The sources and responses of a context analysis, with their column, label and units.
SOURCES = {
    "wheel_speed": ("speed_kph", "Wheel speed", "km/h"), "longitudinal_accel": ("longitudinal", "Longitudinal accel", "g"),
    "vertical_accel": ("vertical", "Vertical accel", "g"), "pitch_rate": ("pitch_rate", "Pitch rate", "dps"),
    "vertical_roughness": ("vertical_roughness", "Vertical roughness", "g"),
}
RESPONSES = {
    "front_travel": ("front_travel", "Front travel", "%"), "rear_travel": ("rear_travel", "Rear travel", "%"),
    "front_velocity": ("front_velocity", "Front velocity", "%/s"), "rear_velocity": ("rear_velocity", "Rear velocity", "%/s"),
    "front_rear_balance": ("balance_pct", "Front/rear balance", "p.p."), "front_share": ("front_share_pct", "Front share", "%"),
}


@dataclass(frozen=True)
class ContextConfig:
    """Which inertial axis is which, and whether it points the other way; the roughness window is in samples."""

    longitudinal: tuple[str, bool] = ("accel_x_g", False)
    vertical: tuple[str, bool] = ("accel_z_g", False)
    pitch_rate: tuple[str, bool] = ("gyro_y_dps", False)
    roughness_window: int = 5


def effective_time(estimated: Column, burst: Column) -> Column:
    """A frame's own time, or its burst's where that is unknown."""
    return F.coalesce(estimated, burst)


def context_dataset(samples: DataFrame, pulses: DataFrame, frames: DataFrame, cfg: ContextConfig = ContextConfig()) -> DataFrame:
    """``samples`` with speed_kph, longitudinal, vertical, pitch_rate and vertical_roughness.

    ``samples`` has session_id, t_us, seq, t and the columns of the responses; ``pulses`` session_id, t,
    v (km/h) and p (the pulse's period); ``frames`` session_id, estimated, burst (times) and the axes.
    """
    df = asof.hold_with_timeout(samples, pulses, "t", "v", "p", "speed_kph")
    frames = frames.withColumn("t", effective_time(F.col("estimated"), F.col("burst")))
    for name in ("longitudinal", "vertical", "pitch_rate"):
        axis, invert = getattr(cfg, name)
        values = frames.select("session_id", "t", (F.col(axis) * (-1.0 if invert else 1.0)).alias("v"))
        df = asof.interpolate_join(df, values, "t", "v", name, match_single=True)
    return series.roughness(df, "vertical", "vertical_roughness", cfg.roughness_window)


def pair(df: DataFrame, source: str, response: str) -> DataFrame:
    """(session_id, t_us, seq, dt, source, response) of the samples that have both, by registered names."""
    x, y = F.col(SOURCES[source][0]), F.col(RESPONSES[response][0])
    return df.select("session_id", "t_us", "seq", "dt", x.alias("source"), y.alias("response")).where("source is not null and response is not null")
