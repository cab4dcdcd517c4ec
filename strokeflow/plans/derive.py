"""From raw samples to derived channels, in long form so that each rule is written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strokeflow.operators import series

KEY = ("session_id", "channel")


def to_long(samples: DataFrame, channels: tuple[str, ...] = ("front", "rear")) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("raw")) for c in channels]
    kept = [c for c in samples.columns if c not in channels]
    return samples.select(*kept, F.explode(F.array(*pairs)).alias("p")).select(*kept, "p.*")


def derive_channels(
    samples: DataFrame, t: str, zero_samples: int = 250, window: int = 3, full_scale: dict[str, float] | None = None, mm_per_count: dict[str, float] | None = None,
    configs: DataFrame | None = None,
) -> DataFrame:
    """Add travel, smooth, velocity, pct, basis and mm to each (session_id, channel) sample.

    The zero is the rounded median of the first samples; ``full_scale`` (counts) and ``mm_per_count``
    are by channel; mm is null without a scale. ``configs`` instead gives each (session_id, channel) its own
    zero, invert, manual_reference (counts), full_scale_mm and mm_per_count.
    """
    long = to_long(samples)
    zero = series.default_zero(long, "raw", zero_samples, KEY)
    sign, anchor = F.lit(1), None
    if configs is not None:
        own = configs.select(*KEY, *[F.col(c).alias(f"__{c}") for c in ("zero", "invert", "manual_reference", "full_scale_mm", "mm_per_count")])
        long = long.join(own, list(KEY), "left")
        sign, anchor = F.when(F.col("__invert"), -1).otherwise(1), F.col("__manual_reference")
    long = long.join(zero, list(KEY))
    if configs is not None:
        long = long.withColumn("zero", F.coalesce("__zero", "zero"))
    long = long.withColumn("travel", series.calibrate(F.col("raw"), F.col("zero"), sign, anchor))
    long = series.per_session(long, [F.min("travel").alias("__lo"), F.max("travel").alias("__hi")], KEY)
    long = long.withColumn("smooth", series.moving_average(F.col("travel"), window, KEY))
    long = long.withColumn("velocity", series.gradient(F.col("smooth"), F.col(t), KEY))

    def by_channel(values: dict[str, float] | None):
        out = F.lit(None).cast("double")
        for name, v in (values or {}).items():
            out = F.when(F.col("channel") == name, F.lit(float(v))).otherwise(out)
        return out

    full, scale = by_channel(full_scale), by_channel(mm_per_count)
    if configs is not None:
        full, scale = F.try_divide(F.col("__full_scale_mm"), F.nullif(F.col("__mm_per_count"), F.lit(0.0))), F.col("__mm_per_count")
    pct, basis = series.stroke_percent(F.col("travel"), full, F.col("__lo"), F.col("__hi"))
    out = long.withColumns({"pct": pct, "basis": basis, "mm": F.col("travel") * scale})
    return out.drop("__lo", "__hi", "__zero", "__invert", "__manual_reference", "__full_scale_mm", "__mm_per_count")
