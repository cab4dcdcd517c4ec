"""The operators on samples in time order, for sessions of any length.

A session is cut into chunks of an equal number of samples, each a group of its own, so that one session with a
third of all rows runs on all tasks. What an operator needs from outside its chunk comes in two ways:

- a halo: operators that look a few samples to either side run unchanged on chunks that also hold
  ``halo`` samples of the chunks beside them (:func:`windowed`);
- a carry: sums, last known values and numbers of runs are taken inside each chunk, the chunks' own results are
  put together in a table of one row for each chunk, and joined back (:func:`running_sum`,
  :func:`neighbours`, :func:`number_runs`).

To find a sample's place in its session without sorting the session, samples are first dealt to
time buckets of one width, counted, and numbered inside them. Samples of one time stay in one
bucket. The first column of ``order`` is a number; results equal those of the plain operators.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strokeflow.operators.series import BY, ORDER, collapse_times, gradient, in_order, per_session
from strokeflow.sources.scratch import stored

#: Samples of a chunk.
ROWS = 200_000
PLACE, CHUNK = "__place", "__chunk"


def _joined(df: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """``df`` with the other columns of ``small``, keyed by ``on``; nulls are equal."""
    keys = [f"__k{i}" for i in range(len(on))]
    small = small.select(*[F.col(c).alias(k) for c, k in zip(on, keys, strict=True)], *[c for c in small.columns if c not in on])
    same = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(on, keys, strict=True)])
    return df.join(small, same, how).drop(*keys)


def placed(df: DataFrame, by=BY, order=ORDER, rows: int = ROWS) -> DataFrame:
    """Add each sample's place in its session, from 0, and its chunk."""
    t = F.col(order[0]).cast("double")
    df = per_session(df, [F.count("*").alias("__n"), F.min(t).alias("__lo"), F.max(t).alias("__hi")], by)
    width = (F.col("__hi") - F.col("__lo")) * rows / F.col("__n")
    bucket = F.when((F.col("__n") > rows) & (width > 0), F.floor((t - F.col("__lo")) / width)).otherwise(F.lit(0))
    df = df.withColumn("__bucket", F.coalesce(bucket, F.lit(-1))).drop("__n", "__lo", "__hi")
    keys = [*by, "__bucket"]
    before = F.sum("__count").over(W.partitionBy(*by).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))
    counts = df.groupBy(*keys).agg(F.count("*").alias("__count")).withColumn("__before", F.coalesce(before, F.lit(0))).drop("__count")
    inside = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    df = _joined(df.withColumn("__inside", inside), counts, keys)
    place = F.col("__before") + F.col("__inside")
    return df.withColumns({PLACE: place, CHUNK: F.floor(place / rows)}).drop("__bucket", "__inside", "__before")


def windowed(df: DataFrame, apply: Callable[[DataFrame, tuple, tuple], DataFrame], halo: int, by=BY, order=ORDER, rows: int = ROWS) -> DataFrame:
    """``apply(df, by, order)`` on chunks with ``halo`` more samples on either side, which then go.

    Right for all that looks at most ``halo`` samples to either side, padded ends of a session included.
    """
    rows = max(rows, halo, 1)
    df = df if PLACE in df.columns else placed(df, by, order, rows)
    at = F.col(PLACE) % rows
    own = F.floor(F.col(PLACE) / rows)
    copies = F.array_compact(F.array(own, F.when((at < halo) & (own > 0), own - 1), F.when(at >= rows - halo, own + 1)))
    df = df.withColumn("__home", own).withColumn(CHUNK, F.explode(copies))
    out = apply(df, (*by, CHUNK), (PLACE,))
    return out.where(F.col(CHUNK) == F.col("__home")).drop("__home", CHUNK, PLACE)


def _carried(df: DataFrame, aggs: list[Column], carry: Callable[[W], dict[str, Column]], by) -> DataFrame:
    """Join to the rows of each chunk what ``carry`` makes, in the order of chunks, of each chunk's ``aggs``."""
    chunks = df.groupBy(*by, CHUNK).agg(*aggs)
    made = carry(W.partitionBy(*by).orderBy(CHUNK))
    return _joined(df, chunks.select(*by, CHUNK, *[c.alias(n) for n, c in made.items()]), [*by, CHUNK])


def running_sum(df: DataFrame, value: Column, out: str, by=BY, order=ORDER, rows: int = ROWS) -> DataFrame:
    """The sum of a whole number over the samples up to each, itself included."""
    df = stored((df if CHUNK in df.columns else placed(df, by, order, rows)).withColumn("__v", value), "long-sum")
    local = F.sum("__v").over(in_order((*by, CHUNK), (PLACE,)).rowsBetween(W.unboundedPreceding, 0))
    df = _carried(df, [F.sum("__v").alias("__s")], lambda w: {"__c": F.sum("__s").over(w.rowsBetween(W.unboundedPreceding, -1))}, by)
    return df.withColumn(out, local + F.coalesce("__c", F.lit(0))).drop("__v", "__c")


def neighbours(df: DataFrame, value: str, before: str, after: str, by=BY, order=ORDER, rows: int = ROWS) -> DataFrame:
    """The last known value up to each sample and the next from it on, itself included on both sides."""
    df = stored(df if CHUNK in df.columns else placed(df, by, order, rows), "long-known")
    known = F.col(value).isNotNull()
    df = _carried(
        df, [F.max_by(F.when(known, F.col(value)), F.when(known, F.col(PLACE))).alias("__last"), F.min_by(F.when(known, F.col(value)), F.when(known, F.col(PLACE))).alias("__first")],
        lambda w: {
            "__carry_a": F.last("__last", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)),
            "__carry_b": F.last("__first", ignorenulls=True).over(W.partitionBy(*by).orderBy(F.desc(CHUNK)).rowsBetween(W.unboundedPreceding, -1)),
        }, by,
    )
    forth, back = (W.partitionBy(*by, CHUNK).orderBy(o).rowsBetween(W.unboundedPreceding, 0) for o in (F.asc(PLACE), F.desc(PLACE)))
    return df.withColumns({
        before: F.coalesce(F.last(value, ignorenulls=True).over(forth), F.col("__carry_a")), after: F.coalesce(F.last(value, ignorenulls=True).over(back), F.col("__carry_b")),
    }).drop("__carry_a", "__carry_b")


def number_runs(df: DataFrame, state: Column, out: str = "run", by=BY, order=ORDER, rows: int = ROWS) -> DataFrame:
    """Number the runs of an equal state (null counts as a state) from 0; the chunks stay for what follows."""
    df = placed(df.withColumn("__state", state), by, order, rows)

    def mark(d: DataFrame, by_: tuple, order_: tuple) -> DataFrame:
        changed = ~F.col("__state").eqNullSafe(F.lag("__state").over(in_order(by_, order_)))
        return d.withColumns({"__new": (changed & (F.col(PLACE) > 0)).cast("int"), "__p": F.col(PLACE), "__c": F.col(CHUNK)})

    marked = windowed(df, mark, 1, by, order, rows).withColumnsRenamed({"__p": PLACE, "__c": CHUNK})
    return running_sum(marked, F.col("__new"), out, by, order, rows).drop("__new", "__state")


def _of_runs(df: DataFrame, facts: DataFrame, run: str, by) -> DataFrame:
    """Join facts about runs to their samples by way of the runs' parts in each chunk, as one run may hold most of a session."""
    parts = _joined(df.select(*by, CHUNK, run).distinct(), facts, [*by, run])
    return _joined(df, parts, [*by, CHUNK, run])


def run_sizes(df: DataFrame, run: str, aggs: list[Column], by=BY) -> DataFrame:
    """(by, run, size, aggs): one row for each run, added up in each task first."""
    return df.groupBy(*by, run).agg(F.count("*").alias("size"), *aggs)


def _unplaced(df: DataFrame) -> DataFrame:
    return df.drop(PLACE, CHUNK)


def runs(df: DataFrame, mask: str, aggs: list[Column], by=BY, order=ORDER, rows: int = ROWS) -> DataFrame:
    """As :func:`islands.runs`: one row for each run of true, numbered from 1 in ``run_no``.

    A session's runs alternate, so the numbers of the true ones follow from the run numbers.
    """
    marked = number_runs(df, F.coalesce(F.col(mask), F.lit(False)), "__run", by, order, rows)
    first = marked.groupBy(*by).agg(F.min_by(F.coalesce(F.col(mask), F.lit(False)), PLACE).alias("__starts"))
    found = marked.where(F.col(mask)).groupBy(*by, "__run").agg(*aggs)
    number = F.floor((F.col("__run") + F.when(F.col("__starts"), 2).otherwise(1)) / 2).cast("int")
    return _joined(found, first, list(by)).withColumn("run_no", number).drop("__run", "__starts")


def fill_gaps(df: DataFrame, mask: str, out: str, longest: int, by=BY, order=ORDER, rows: int = ROWS) -> DataFrame:
    """As :func:`islands.fill_gaps`."""
    m = F.coalesce(F.col(mask), F.lit(False))
    marked = stored(number_runs(df, m, "__run", by, order, rows), "long-runs")
    last = marked.groupBy(*by).agg(F.max("__run").alias("__end"))
    facts = _joined(run_sizes(marked, "__run", [], by), last, list(by))
    short = (F.col("size") <= longest) & (F.col("__run") > 0) & (F.col("__run") < F.col("__end"))
    rows_ = _of_runs(marked, facts.select(*by, "__run", short.alias("__short")), "__run", by)
    return _unplaced(rows_.withColumn(out, m | F.col("__short")).drop("__run", "__short"))


def keep_long(df: DataFrame, mask: str, out: str, least: int, by=BY, order=ORDER, rows: int = ROWS) -> DataFrame:
    """As :func:`islands.keep_long`."""
    m = F.coalesce(F.col(mask), F.lit(False))
    marked = stored(number_runs(df, m, "__run", by, order, rows), "long-runs")
    rows_ = _of_runs(marked, run_sizes(marked, "__run", [], by), "__run", by)
    return _unplaced(rows_.withColumn(out, m & (F.col("size") >= least)).drop("__run", "size"))


def absorb_short(df: DataFrame, code: str, valid: Column, out: str, least: int, fallback: int, by=BY, order=ORDER, rows: int = ROWS) -> DataFrame:
    """As :func:`islands.absorb_short`. The runs are a table of their own, cut into chunks in its turn.

    Absorbing from left to right sends each run to the last long one of its stretch, or else to the stretch's
    second run: both are carried over the chunks of the table of runs.
    """
    valid_ = F.coalesce(valid, F.lit(False))
    marked = stored(number_runs(df.withColumn("__ok", valid_), F.struct("__ok", code), "__run", by, order, rows), "long-runs")
    table = run_sizes(marked, "__run", [F.first("__ok").alias("ok"), F.first(code).alias("code")], by)
    table = number_runs(table, F.col("ok"), "__stretch", by, ("__run",), rows)
    long = F.when(F.col("size") >= least, F.struct("__stretch", "code"))
    table = stored(neighbours(table.withColumn("__long", long), "__long", "__left", "__next", by, ("__run",), rows).drop("__next"), "long-run-table")
    first = table.groupBy(*by, "__stretch").agg(F.min("__run").alias("__first"))
    second = _joined(table.select(*by, "__stretch", "__run", "code"), first, [*by, "__stretch"]).where(F.col("__run") == F.col("__first") + 1)
    table = _joined(table, second.select(*by, "__stretch", F.col("code").alias("__second")), [*by, "__stretch"])
    left = F.when(F.col("__left.__stretch") == F.col("__stretch"), F.col("__left.code"))
    goes = F.when(F.col("ok"), F.coalesce(left, "__second", F.lit(fallback))).otherwise(F.col("code"))
    facts = table.select(*by, "__run", goes.alias(out))
    return _unplaced(_of_runs(marked, facts, "__run", by).drop("__run", "__ok"))


def segment_ids(df: DataFrame, states: list[str], valid: Column, out: str, by=BY, order=ORDER, rows: int = ROWS) -> DataFrame:
    """As :func:`islands.segment_ids`: the valid runs are counted over the table of runs."""
    df = df.withColumn("__ok", F.coalesce(valid, F.lit(False)))
    marked = stored(number_runs(df, F.when(F.col("__ok"), F.struct(*states)), "__run", by, order, rows), "long-runs")
    table = running_sum(run_sizes(marked, "__run", [F.first("__ok").alias("ok")], by), F.col("ok").cast("int"), "__id", by, ("__run",), rows)
    facts = table.select(*by, "__run", F.when(F.col("ok"), F.col("__id") - 1).otherwise(-1).cast("int").alias(out))
    return _unplaced(_of_runs(marked, facts, "__run", by).drop("__run", "__ok"))


def gradient_in_runs(df: DataFrame, value: str, t: str, out: str, by=BY, order=ORDER, least: int = 3, rows: int = ROWS) -> DataFrame:
    """As :func:`series.gradient_in_runs`."""
    marked = stored(number_runs(df, F.col(value).isNotNull(), "__run", by, order, rows), "long-runs")
    sized = _of_runs(marked, run_sizes(marked, "__run", [], by), "__run", by)

    def slope(d: DataFrame, by_: tuple, order_: tuple) -> DataFrame:
        g = gradient(F.col(value), F.col(t), (*by_, "__run"), order_)
        return d.withColumn(out, F.when(F.col(value).isNotNull() & (F.col("size") >= least), g))

    return windowed(sized, slope, 1, by, order, rows).drop("__run", "size")


def gradient_bridged(df: DataFrame, value: str, t: str, out: str, by=BY, order=ORDER, rows: int = ROWS) -> DataFrame:
    """As :func:`series.gradient_bridged`: the known samples alone are cut into chunks."""
    known = windowed(df.where(F.col(value).isNotNull()), lambda d, b, o: d.withColumn(out, gradient(F.col(value), F.col(t), b, o)), 1, by, order, rows)
    return known.unionByName(df.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double")))


def _together(samples: DataFrame, points: DataFrame, point: Column, t: str, by) -> DataFrame:
    """Samples and points of another clock in one order; a point comes before the samples of its time."""
    keys = [F.col(c) for c in by]
    body = F.struct(*[c for c in samples.columns if c not in by]).alias("__row")
    left = samples.select(*keys, F.col(t).cast("double").alias("__t"), F.lit(1).alias("__kind"), body)
    right = points.select(*keys, F.col(t).cast("double").alias("__t"), F.lit(0).alias("__kind"), point.alias("__point"))
    return left.unionByName(right, allowMissingColumns=True)


def hold_with_timeout(samples: DataFrame, pulses: DataFrame, t: str, value: str, period: str, out: str, factor: float = 1.5, by=BY, rows: int = ROWS) -> DataFrame:
    """As :func:`asof.hold_with_timeout`."""
    point = F.struct(F.col(t).alias("t"), F.col(value).cast("double").alias("v"), F.col(period).cast("double").alias("p"))
    both = neighbours(_together(samples, pulses, point, t, by), "__point", "__held", "__next", by, ("__t", "__kind"), rows)
    both = _joined(both.where("__kind = 1"), pulses.groupBy(*by).agg(F.min(F.col(t).cast("double")).alias("__first")), list(by))
    h = F.col("__held")
    fresh = h["v"].isNotNull() & h["p"].isNotNull() & (F.col("__t") < h["t"] + factor * h["p"])
    lead_in = (F.col("__t") < F.col("__first")) & (F.col("__first") > 0)
    return both.select(*by, "__row.*", F.when(fresh, h["v"]).when(lead_in, 0.0).alias(out), F.coalesce(fresh, F.lit(False)).alias(f"{out}_held"))


def _on_line(a: Column, b: Column, t: Column) -> Column:
    line = F.when(b["t"] > a["t"], a["v"] + (b["v"] - a["v"]) * (t - a["t"]) / (b["t"] - a["t"])).otherwise(a["v"])
    return F.when(a.isNotNull() & b.isNotNull(), line)


def interpolate_join(samples: DataFrame, source: DataFrame, t: str, value: str, out: str, by=BY, least: int = 2, rows: int = ROWS) -> DataFrame:
    """As :func:`asof.interpolate_join` without ``match_single``."""
    points = collapse_times(source.where(F.col(value).isNotNull() & F.col(t).isNotNull()), t, [value], by)
    point = F.struct(F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("v"))
    both = neighbours(_together(samples, points, point, t, by), "__point", "__a", "__b", by, ("__t", "__kind"), rows).where("__kind = 1")
    both = _joined(both, points.groupBy(*by).agg(F.count("*").alias("__n")), list(by))
    a = F.col("__a")
    b = F.when(a["t"] == F.col("__t"), a).otherwise(F.col("__b"))  # a point at the sample's own time is on both sides
    return both.select(*by, "__row.*", F.when(F.col("__n") >= least, _on_line(a, b, F.col("__t"))).alias(out))


def interpolate_gaps(df: DataFrame, value: str, t: str, out: str, by=BY, order=ORDER, rows: int = ROWS) -> DataFrame:
    """As :func:`asof.interpolate_gaps`."""
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("t"), F.col(value).alias("v")))
    both = neighbours(df.withColumn("__point", point), "__point", "__a", "__b", by, order, rows)
    return _unplaced(both.withColumn(out, _on_line(F.col("__a"), F.col("__b"), F.col(t))).drop("__point", "__a", "__b"))


_NODES = f"session_id string, {CHUNK} long, start long, last long, taken long"
_ACCEPTED = "session_id string, t_us long, interval_us long, pulse_count long"


#: Rows of many chunks that one call of Python takes.
CALL = 100_000


def _by_chunk(df: DataFrame, calls: int, make: Callable[[np.ndarray, tuple], tuple], given: list[str], schema: str) -> DataFrame:
    """``make(times, given)`` of each chunk's sorted times and its values of ``given``, whose arrays become rows beside the
    session's and the chunk's names. The chunks share so many ``calls`` of Python, as one for each costs more than a small chunk's work."""
    names = [c.split()[0] for c in schema.split(", ")]
    keys = [c for c in ("session_id", CHUNK) if c in names]

    def run(pdf):
        s = pd.factorize(pdf["session_id"])[0]
        order = np.lexsort((pdf["t_us"], pdf[CHUNK], s))
        pdf, s = pdf.iloc[order], s[order]
        t, c = (pdf[x].to_numpy(dtype=np.int64) for x in ("t_us", CHUNK))
        starts = np.append(0, np.flatnonzero((s[1:] != s[:-1]) | (c[1:] != c[:-1])) + 1)
        first = pdf.iloc[starts]
        facts = first[given].itertuples(index=False, name=None) if given else [()] * len(starts)
        made = [make(x, f) for x, f in zip(np.split(t, starts[1:]), facts, strict=True)]
        sizes = [len(m[0]) for m in made]
        columns = [np.repeat(first[k].to_numpy(), sizes) for k in keys] + [np.concatenate(m) for m in zip(*made, strict=True)]
        return pd.DataFrame(dict(zip(names, columns, strict=True)))

    # A grouping, not a repartition: adaptive execution may undo the latter behind a join.
    call = F.pmod(F.xxhash64("session_id", CHUNK), F.lit(calls)).alias("__call")
    return df.select("session_id", CHUNK, "t_us", *given, call).groupBy("__call").applyInPandas(run, schema)


def _jumps(t: np.ndarray, least_us: int) -> np.ndarray:
    """For each of a chunk's times the place of the first pulse that may be accepted after it."""
    return np.append(np.searchsorted(t, t + least_us), len(t))


def _chains(least_us: int):
    def make(t, _):
        jump, n = _jumps(t, least_us), len(t)
        last, taken = np.arange(n + 1), np.append(np.ones(n, dtype=np.int64), 0)
        while (jump < n).any():  # each round doubles how far a pointer jumps
            last, taken, jump = np.where(jump < n, last[jump], last), taken + taken[jump], jump[jump]
        entries = min(n, int(np.searchsorted(t, t[0] + least_us)) + 1)  # the chain cannot enter a chunk behind these
        return t[:entries], t[last[:entries]], taken[:entries]

    return make


def _accepted(least_us: int):
    def make(t, given):
        start, before, first = given
        jump, at, places = _jumps(t, least_us).tolist(), int(np.searchsorted(t, start)), []
        while at < len(t):
            places.append(at)
            at = jump[at]
        times = t[places]
        return times, np.append(int(first), np.diff(times)), int(before) + 1 + np.arange(len(times))

    return make


def debounce(pulses: DataFrame, least_us: int = 3000, rows: int = ROWS) -> DataFrame:
    """As :func:`strokeflow.streaming.logs.debounce`, with the recursion taken by jump pointers.

    What a chunk accepts depends only on the pulse at which the chain of accepted ones enters it, and that is one of the few
    within ``least_us`` of its first, or the next. For each of them the chunk finds the last that would be accepted and how many. These
    entries point to the next chunk's; the entries that the chain really takes are found by pointers that
    double their reach, from each session's first pulse, in rounds as the logarithm of the chunks.
    """
    p = pulses.select(F.col("session_id").cast("string").alias("session_id"), "t_us").where("session_id is not null and t_us is not null").distinct()
    p = stored(placed(p, BY, ("t_us",), rows), "long-pulses")
    calls = max(1, -(-p.count() // CALL))
    nodes = stored(_by_chunk(p, calls, _chains(least_us), [], _NODES), "long-entries")
    points = nodes.select("session_id", F.col("start").alias("t"), F.lit(1).alias("kind"), F.col("start").alias("point"), F.lit(None).cast("long").alias("from"))
    needs = nodes.select("session_id", (F.col("last") + least_us).alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("point"), F.col("start").alias("from"))
    met = neighbours(points.unionByName(needs), "point", "__before", "next", BY, ("t", "kind"), rows)
    jump = stored(met.where("kind = 0 and next is not null").select("session_id", F.col("from").alias("start"), "next"), "long-jumps")
    reached = stored(nodes.groupBy("session_id").agg(F.min("start").alias("start")), "long-reached")
    while True:
        more = stored(reached.join(jump, ["session_id", "start"]).select("session_id", F.col("next").alias("start")), "long-reached")
        if more.isEmpty():
            break
        reached = reached.unionByName(more)
        beyond = jump.select("session_id", F.col("start").alias("next"), F.col("next").alias("beyond"))
        jump = stored(jump.join(beyond, ["session_id", "next"]).select("session_id", "start", F.col("beyond").alias("next")), "long-jumps")
    w = W.partitionBy("session_id").orderBy("start")  # one row for each chunk
    chain = nodes.join(reached, ["session_id", "start"]).withColumns({
        "before": F.coalesce(F.sum("taken").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "first": F.coalesce(F.col("start") - F.lag("last").over(w), F.lit(0)),
    }).select("session_id", CHUNK, "start", "before", "first")
    return _by_chunk(p.join(chain, ["session_id", CHUNK]), calls, _accepted(least_us), ["start", "before", "first"], _ACCEPTED)
