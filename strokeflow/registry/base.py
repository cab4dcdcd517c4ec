"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strokeflow.operators.series import sample_weights
from strokeflow.sources.tables import event_samples, table

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: The samples of :func:`event_samples`.
SAMPLES_SQL = """
s AS (SELECT user_id AS session_id, event_id AS seq, epoch_us(ts) AS t_us, epoch_us(ts) / 3.6e9 AS t_h,
        CAST(value AS DOUBLE) AS front, CAST(json_extract(props, '$.k') AS DOUBLE) AS rear, event_type AS code FROM events)"""
#: The samples with the time that each stands for.
WEIGHTED_SQL = (
    SAMPLES_SQL
    + """,
st AS (SELECT *, t_h - lag(t_h) OVER (PARTITION BY session_id ORDER BY t_us, seq) AS step FROM s),
md AS (SELECT session_id, quantile_cont(step, 0.5) FILTER (step > 0) AS median FROM st GROUP BY session_id),
d AS (SELECT st.*, CASE WHEN step > 0 THEN step ELSE median END AS dt FROM st JOIN md USING (session_id))"""
)


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder) under a name, with its SQL where there is any."""

    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def weighted_samples(spark, folder) -> DataFrame:
    return sample_weights(event_samples(spark, folder), "t_h")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that sums taken in another order compare as equal."""
    return df.select(*[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


__all__ = ["F", "QUERIES", "SAMPLES_SQL", "SQL", "WEIGHTED_SQL", "event_samples", "query", "rounded", "table", "weighted_samples"]
