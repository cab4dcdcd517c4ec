"""Session configuration as columns: defaults, limits, migration and parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the configuration format.
SCHEMA_VERSION = 10
FRONT_FULL_SCALE_MM, FRONT_SENSOR_MM = 300.0, 635.0
COLOR_SCALES, AXIS_MODES = ("linear", "sqrt", "log"), ("linear", "signed_log")


def number_or_ratio(text: Column) -> Column:
    """``12.5`` or ``315/4035`` as a double; null for anything else, an empty text or a zero divisor."""
    parts = F.split(F.trim(text), "/")
    value = lambda x: F.trim(x).try_cast("double")
    ratio = F.try_divide(value(parts[0]), F.nullif(value(F.get(parts, 1)), F.lit(0.0)))
    return F.when(F.size(parts) == 1, value(parts[0])).when(F.size(parts) == 2, ratio)


def number_list(text: Column) -> Column:
    """Comma-separated numbers as an array; null if one of them is none or there are none."""
    parts = F.filter(F.transform(F.split(text, ","), F.trim), lambda x: x != "")
    values = F.transform(parts, lambda x: x.try_cast("double"))
    return F.when((F.size(values) > 0) & ~F.exists(values, lambda x: x.isNull()), values)


def clamp(value: Column, default: float, low: float | None = None, high: float | None = None) -> Column:
    out = F.coalesce(value.try_cast("double"), F.lit(float(default)))
    out = out if low is None else F.greatest(out, F.lit(float(low)))
    return out if high is None else F.least(out, F.lit(float(high)))


def choice(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(F.lower(value).isin(*allowed), F.lower(value)).otherwise(default)


def above(high: Column, low: Column) -> Column:
    """An upper limit, moved to one over the lower limit where it is not above it."""
    return F.when(high <= low, low + 1.0).otherwise(high)


def sorted_edges(edges: Column, default: list[float], low: float | None = None, high: float | None = None) -> Column:
    """Distinct finite numbers in order, kept within limits; the default where none is left."""
    values = F.filter(edges, lambda x: x.isNotNull() & ~F.isnan(x))
    if low is not None or high is not None:
        lo, hi = F.lit(float("-inf") if low is None else float(low)), F.lit(float("inf") if high is None else float(high))
        values = F.transform(values, lambda x: F.least(F.greatest(x, lo), hi))
    else:
        values = F.filter(values, lambda x: x > 0)
    values = F.array_sort(F.array_distinct(values))
    return F.when(F.size(values) > 0, values).otherwise(F.array(*map(F.lit, default)))


def with_defaults(configs: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Each null field from its default; fields that are absent are added."""
    return configs.withColumns({
        k: F.coalesce(F.col(k), F.lit(v)) if k in configs.columns else F.lit(v) for k, v in defaults.items()
    })


def migrate(configs: DataFrame) -> DataFrame:
    """Bring configurations of any version to the current one.

    Columns: schema_version, front_full_scale_mm, front_sensor_mm, <channel>_filter_window,
    <channel>_manual_reference (text), travel_bins, velocity_bins, color_scale, axis_mode.
    """
    old = F.coalesce("schema_version", F.lit(0)) < SCHEMA_VERSION
    c = F.col
    changes = {"front_full_scale_mm": F.lit(FRONT_FULL_SCALE_MM), "front_sensor_mm": F.lit(FRONT_SENSOR_MM)}
    for ch in ("front", "rear"):
        window = c(f"{ch}_filter_window")
        changes[f"{ch}_filter_window"] = F.when(old & (window.isNull() | (window == 21)), 3).otherwise(window)
        changes[f"{ch}_manual_reference"] = c(f"{ch}_manual_reference").try_cast("double")
    for name, legacy in (("travel_bins", 100), ("velocity_bins", 120)):
        changes[name] = F.when(old & (c(name).isNull() | (c(name) == legacy)), 400).otherwise(c(name))
    scale = F.when(old & (c("color_scale").isNull() | c("color_scale").isin("", "log")), "sqrt").otherwise(c("color_scale"))
    changes["color_scale"] = F.when(scale.isin(*COLOR_SCALES), scale).otherwise("sqrt")
    changes["axis_mode"] = F.when(c("axis_mode").isin(*AXIS_MODES), c("axis_mode")).otherwise("linear")
    changes["schema_version"] = F.lit(SCHEMA_VERSION)
    return configs.withColumns(changes)


def mm_per_count(explicit: Column, sensor_mm: Column, full_mm: Column, bits: Column) -> Column:
    """Millimetres of a count: given, else from the sensor's range, else from the full scale."""
    top = F.pow(F.lit(2.0), bits) - 1
    return F.coalesce(explicit, F.try_divide(sensor_mm, F.nullif(top, F.lit(0.0))), F.try_divide(full_mm, F.nullif(top, F.lit(0.0))))


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) >= 1e-12, a / b)
