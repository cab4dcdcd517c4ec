"""Registered queries against DuckDB on the smallest tables, and the shape of plans."""

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from strokeflow import registry
from strokeflow.operators import series
from strokeflow.sources.tables import event_samples

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from compare import norm  # noqa: E402

SF = "/root/testdata/sf0.001"
SOME = [
    "c6_moving_average", "c9_gradient", "c11_gradient_bridged", "c15_derived_series", "d1_asof_hold", "d2_interp_join", "e4_wquantile_interp", "e7_travel_histogram",
    "e9_occupancy_grid", "e12_smoothed_mode", "e18_balance", "f4_absorb_short", "f5_segment_ids", "f6_braking_events", "f8_auto_labels", "g9_keep_extrema", "j7_breakdown_samples",
    "a2_session_header", "a8_imu_frames", "a14_export_analog", "c1_repair_time", "e15_channel_metrics", "j1_context_dataset", "k2_debounce",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", SOME)
def test_same_rows_as_sql(spark, db, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), db.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_of_a_session_share_one_exchange_and_sort(spark):
    df = event_samples(spark, SF)
    out = df.select("seq", series.moving_average(F.col("front"), 5).alias("a"), series.gradient(F.col("front"), F.col("t_h")).alias("b"), series.sign_change(F.col("rear")).alias("c"))
    plan = plan_of(out)
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_scans_read_only_what_is_asked(spark):
    plan = plan_of(registry.queries()["e1_weighted_mean"](spark, SF))
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_returnflag:string>" in plan
    plan = plan_of(registry.queries()["e34_peak_magnitude"](spark, SF))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in plan


def test_occupancy_of_repeated_and_flat_samples(spark, db, tmp_path):
    """percentiles between equal neighbours, and sessions that never move."""
    db.sql(f"""COPY (SELECT event_id + 1000 * i AS event_id, ts, user_id, event_type, CASE WHEN user_id % 3 = 0 THEN 7.3 ELSE value END AS value, props
               FROM read_parquet('{SF}/events.parquet'), range(6) t(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    sql = registry.oracle_sql()["e9_occupancy_grid"].replace("FROM events)", f"FROM read_parquet('{tmp_path}/events.parquet'))")
    got = registry.queries()["e9_occupancy_grid"](spark, str(tmp_path)).toPandas()
    assert norm(got) == norm(db.sql(sql).df())
