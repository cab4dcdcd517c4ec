"""Runs of equal states: finding, filling, filtering and absorbing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strokeflow.operators.series import BY, ORDER, in_order, next_known, whole


def with_runs(df: DataFrame, state: Column, out: str = "run", by=BY, order=ORDER) -> DataFrame:
    """Number the runs of an equal state (null counts as a state) from 0 in each session."""
    w = in_order(by, order)
    df = df.withColumn("__state", state)
    changed = ~F.col("__state").eqNullSafe(F.lag("__state").over(w)) & (F.row_number().over(w) > 1)
    df = df.withColumn("__new", changed.cast("int"))
    return df.withColumn(out, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__state", "__new")


def runs(df: DataFrame, mask: str, aggs: list[Column], by=BY, order=ORDER) -> DataFrame:
    """One row for each run of true, numbered from 1 in ``run_no``, with its aggregates."""
    marked = with_runs(df, F.coalesce(F.col(mask), F.lit(False)), "__run", by, order).where(F.col(mask))
    found = marked.groupBy(*by, "__run").agg(*aggs)
    return found.withColumn("run_no", F.row_number().over(W.partitionBy(*by).orderBy("__run"))).drop("__run")


def fill_gaps(df: DataFrame, mask: str, out: str, longest: int, by=BY, order=ORDER) -> DataFrame:
    """Make runs of false of at most ``longest`` samples true, except at either end of a session."""
    df = with_runs(df, F.coalesce(F.col(mask), F.lit(False)), "__run", by, order)
    size = F.count(F.lit(1)).over(W.partitionBy(*by, "__run"))
    last = F.max("__run").over(W.partitionBy(*by))
    inner = (F.col("__run") > 0) & (F.col("__run") < last)
    filled = F.coalesce(F.col(mask), F.lit(False)) | (inner & (size <= longest))
    return df.withColumn(out, filled).drop("__run")


def _with_size(df: DataFrame, run: str, ahead: dict[str, Column], by, order) -> DataFrame:
    """Add __size, the samples of a run, and __ahead, the ``ahead`` columns at the start of the next run (null for the last).

    Runs follow each other in the samples' order, so a run ends where the next starts, and the samples need not be sorted by run.
    """
    w = in_order(by, order)
    number = F.row_number().over(w)
    start = F.when(~F.col(run).eqNullSafe(F.lag(run).over(w)) | (number == 1), F.struct(number.alias("i"), *[c.alias(k) for k, c in ahead.items()]))
    df = df.withColumn("__start", start)
    df = df.withColumns({
        "__ahead": next_known("__start", by, order), "__start": F.last("__start", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)),
        "__all": F.count(F.lit(1)).over(W.partitionBy(*by)),
    })
    return df.withColumn("__size", F.coalesce(F.col("__ahead.i"), F.col("__all") + 1) - F.col("__start.i")).drop("__start", "__all")


def keep_long(df: DataFrame, mask: str, out: str, least: int, by=BY, order=ORDER) -> DataFrame:
    """Keep runs of true of at least ``least`` samples."""
    df = with_runs(df, F.coalesce(F.col(mask), F.lit(False)), "__run", by, order)
    df = _with_size(df, "__run", {}, by, order)
    return df.withColumn(out, F.coalesce(F.col(mask), F.lit(False)) & (F.col("__size") >= least)).drop("__run", "__size", "__ahead")


def absorb_short(
    df: DataFrame, code: str, valid: Column, out: str, least: int, fallback: int, by=BY, order=ORDER
) -> DataFrame:
    """Give runs under ``least`` samples to their left neighbour, else to the next run, else ``fallback``.

    Stretches of invalid samples separate neighbours and keep their codes. The left neighbour of a
    run is the last long run of the stretch, because what lies between them was absorbed into it.
    """
    df = with_runs(df.withColumn("__ok", valid), F.col("__ok"), "__stretch", by, order)
    df = with_runs(df, F.struct("__ok", code), "__run", by, order)
    df = _with_size(df, "__run", {"__stretch": F.col("__stretch"), "code": F.col(code)}, by, order)
    w = in_order(by, order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    long = F.when((F.col("__size") >= least) & F.col(code).isNotNull(), F.struct("__stretch", F.col(code).alias("code")))
    opens = ~F.col("__stretch").eqNullSafe(F.lag("__stretch").over(w))
    df = df.withColumns({"__long": long, "__first": F.when(opens, F.struct("__ahead"))})
    df = df.withColumns({"__left": F.last("__long", ignorenulls=True).over(upto), "__first": F.last("__first", ignorenulls=True).over(upto)})
    left, second = (F.when(F.col(f"{c}.__stretch") == F.col("__stretch"), F.col(f"{c}.code")) for c in ("__left", "__first.__ahead"))
    # Only the first run of a stretch that starts short looks at the run that follows it.
    return df.withColumn(out, F.when(F.col("__ok"), F.coalesce(left, second, F.lit(fallback))).otherwise(F.col(code))).drop(
        "__ok", "__stretch", "__run", "__ahead", "__size", "__long", "__first", "__left"
    )


def segment_ids(df: DataFrame, states: list[str], valid: Column, out: str, by=BY, order=ORDER) -> DataFrame:
    """Number the runs of equal ``states`` among valid samples from 0; -1 elsewhere."""
    df = df.withColumn("__valid", valid)
    df = with_runs(df, F.when(F.col("__valid"), F.struct(*states)), "__run", by, order)
    w = in_order(by, order)
    starts = F.col("__valid") & ~F.col("__run").eqNullSafe(F.lag("__run").over(w))
    df = df.withColumn("__starts", F.coalesce(starts, F.lit(False)).cast("int"))
    number = (F.sum("__starts").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("int")
    return df.withColumn(out, F.when(F.col("__valid"), number).otherwise(-1)).drop("__valid", "__run", "__starts")


def middle_value(value: Column, by, order=ORDER) -> Column:
    """Value of the middle sample of a group (the earlier of two), as a window over the group."""
    w, full = in_order(by, order), whole(by, order)
    n = F.count(F.lit(1)).over(full)
    return F.max(F.when(F.row_number().over(w) == F.floor((n - 1) / 2) + 1, value)).over(full)
