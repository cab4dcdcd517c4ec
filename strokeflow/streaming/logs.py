"""Session logs and pulses as streams."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupStateTimeout

from strokeflow.sources import logs
from strokeflow.sources.logs import RECORDS, read_records
from strokeflow.sources.ranges import RANGE_BYTES, read_ranges
from strokeflow.sources.scratch import stored


def stream_logs(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None]):
    """Pass the records of newly arrived logs to ``sink(records, batch_id)``; start of a query.

    The checkpoint remembers the files taken, so each file is passed on in one batch; a sink that
    overwrites by session makes repeats of a batch harmless.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.BIN").load(folder)
    return (
        files.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, no: sink(read_records(spark, [], files=df), no))
        .trigger(availableNow=True).start()
    )


_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_COMMITTED = "session_id string, path string, length long, modificationTime timestamp, records long, error string"


class LogStore:
    """Session logs taken in as they arrive: records, and a log of the batches that are complete.

    A batch first overwrites its own partition of ``records``, then its own partition of ``commits``, one
    row for each file. Readers see the sessions of committed batches only, so a batch that breaks off
    half-way shows nothing, and its repeat replaces what it had written. The commits also are the state of the
    stream: a name that an earlier batch took belongs to that file for good. The same file again (by path, size and
    time, as after the loss of a checkpoint) is passed over; another file of that name goes to the commits with an error.

    A batch is known by the id of its stream, which its checkpoint holds, and its number.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        empty = self.spark.createDataFrame([], f"{schema}, stream string, batch long")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return empty
        return self.spark.read.schema(empty.schema).parquet(f"{self.root}/{name}")

    def commits(self) -> DataFrame:
        """One row for each file of each committed batch."""
        return self._table("commits", _COMMITTED)

    def records(self) -> DataFrame:
        """The records of all committed sessions, as :func:`read_records` gives them."""
        good = self.commits().where("error is null").select("session_id", "stream", "batch")
        return self._table("records", f"{RECORDS}, session_id string, wraps long").join(good, ["session_id", "stream", "batch"], "left_semi")

    def _put(self, df: DataFrame, name: str, stream: str, batch: int) -> None:
        rows = df.withColumns({"stream": F.lit(stream), "batch": F.lit(batch).cast("long")})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream", "batch").parquet(f"{self.root}/{name}")

    def take(self, files: DataFrame, stream: str, batch: int, range_bytes: int | None = None) -> None:
        """Take in ``files(path, length, modificationTime)`` as one batch; a repeat of a batch has the same result."""
        earlier = self.commits().where(~((F.col("stream") == stream) & (F.col("batch") == batch)))
        held = earlier.where(F.coalesce(F.col("error") != logs.CLASH, F.lit(True)))
        named = files.select("path", "length", "modificationTime", logs.session_of(F.col("path")).alias("session_id"))
        seen = earlier.select("path", "length", "modificationTime").distinct()
        fresh = stored(named.join(seen, ["path", "length", "modificationTime"], "left_anti"), "arrivals")
        taken = held.select("session_id").distinct().withColumn("taken", F.lit(True))
        doubled = logs.clashing(fresh).select("session_id", F.lit(True).alias("doubled"))
        marked = fresh.join(taken, "session_id", "left").join(doubled, "session_id", "left").select(
            *fresh.columns, (F.col("taken").isNotNull() | F.col("doubled").isNotNull()).alias("clash")
        )
        own = stored(marked, "arrivals-marked")
        found = read_ranges(own.where("not clash").select("path", "length"), range_bytes or RANGE_BYTES)
        self._put(found.withColumn("session_id", logs.session_of(F.col("path"))), "records", stream, batch)
        written = self._table("records", f"{RECORDS}, session_id string, wraps long").where((F.col("stream") == stream) & (F.col("batch") == batch))
        sums = written.groupBy("session_id").agg(F.sum(F.when(F.col("error").isNull(), 1).otherwise(0)).alias("records"), F.max("error").alias("broken"))
        error = F.when(F.col("clash"), logs.CLASH).otherwise(F.col("broken"))
        rows = own.join(sums, "session_id", "left").select(
            "session_id", "path", "length", "modificationTime", F.when(F.col("clash"), F.lit(0)).otherwise(F.coalesce("records", F.lit(0))).cast("long").alias("records"), error.alias("error")
        )
        self._put(rows, "commits", stream, batch)

    def start(self, folder: str, checkpoint: str, range_bytes: int | None = None):
        """Take in what has arrived in ``folder`` and below since the last start, in one batch or more; start of a query."""
        schema = "path string, modificationTime timestamp, length long, content binary"
        files = self.spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.BIN").option("recursiveFileLookup", "true").load(folder)

        def sink(df: DataFrame, batch: int) -> None:
            # The stream writes its id there before its first batch.
            stream = json.loads(self.spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]
            self.take(df.select("path", "length", "modificationTime"), stream, batch, range_bytes)

        # Each batch's files are looked up by jobs of a task for each file up to this setting. The source reads it from this session while it runs.
        most = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if int(self.spark.conf.get(_LISTING)) > most:
            self.spark.conf.set(_LISTING, str(most))
        return files.select("path", "length", "modificationTime").writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()


_PULSES = "session_id string, t_us long, interval_us long, pulse_count long"


def _accept(times: list[int], last: int | None, count: int, least: int):
    out = []
    for t in times:
        if last is None or t - last >= least:
            count += 1
            out.append((t, 0 if last is None else t - last, count))
            last = t
    return out, last, count


def debounce(pulses: DataFrame, least_us: int = 3000) -> DataFrame:
    """Drop pulses less than ``least_us`` after the last accepted one of their session.

    What is accepted depends on what was accepted before, so each session's times go through one
    ordered pass, of which a task holds a batch and the last accepted time.
    """

    def run(parts):
        session, last, count = None, None, 0
        for pdf in parts:
            out = []
            for name, times in pdf.groupby("session_id", sort=False)["t_us"]:
                if name != session:
                    session, last, count = name, None, 0
                rows, last, count = _accept(times.tolist(), last, count, least_us)
                out += [(name, *r) for r in rows]
            yield pd.DataFrame(out, columns=["session_id", "t_us", "interval_us", "pulse_count"])

    rows = pulses.select(F.col("session_id").cast("string").alias("session_id"), "t_us").where("session_id is not null and t_us is not null")
    return rows.repartition("session_id").sortWithinPartitions("session_id", "t_us").mapInPandas(run, _PULSES)


def debounce_stream(pulses: DataFrame, least_us: int = 3000, late: str | None = None, idle_ms: int = 3_600_000) -> DataFrame:
    """:func:`debounce` on a stream; the state of a session is its last accepted time and count.

    Without ``late`` a batch is taken as it comes, in the order of its times. With it, pulses wait in their
    session's state until the watermark, ``late`` behind the latest pulse, has passed them: so they are taken in
    order however batches cut them, and the state of a session goes ``idle_ms`` after its last pulse.
    """
    if late is not None:
        return _debounce_in_order(pulses, least_us, late, idle_ms)

    def run(key, frames, state):
        last, count = state.get if state.exists else (None, 0)
        times = sorted(t for pdf in frames for t in pdf["t_us"])
        rows, last, count = _accept(times, last, count, least_us)
        if last is not None:
            state.update((last, count))
        out = pd.DataFrame(rows, columns=["t_us", "interval_us", "pulse_count"])
        out.insert(0, "session_id", key[0])
        yield out

    rows = pulses.select(F.col("session_id").cast("string").alias("session_id"), "t_us")
    return rows.groupBy("session_id").applyInPandasWithState(run, _PULSES, "last long, count long", "append", GroupStateTimeout.NoTimeout)


def _debounce_in_order(pulses: DataFrame, least_us: int, late: str, idle_ms: int) -> DataFrame:
    def run(key, frames, state):
        last, count, waiting = state.get if state.exists else (None, 0, [])
        times = sorted([*map(int, waiting), *(int(t) for pdf in frames for t in pdf["t_us"])])
        mark = state.getCurrentWatermarkMs()
        due = [t for t in times if t < mark * 1000]
        rest = times[len(due) :]
        rows, last, count = _accept(due, last, count, least_us)
        if state.hasTimedOut and not times:
            state.remove()
        else:
            state.update((last, count, rest))
            state.setTimeoutTimestamp(max(rest[0] // 1000, mark) + 1 if rest else max(last // 1000, mark) + idle_ms)
        out = pd.DataFrame(rows, columns=["t_us", "interval_us", "pulse_count"])
        out.insert(0, "session_id", key[0])
        yield out

    rows = pulses.select(F.col("session_id").cast("string").alias("session_id"), "t_us", F.timestamp_micros("t_us").alias("event_time"))
    return rows.withWatermark("event_time", late).groupBy("session_id").applyInPandasWithState(
        run, _PULSES, "last long, count long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def fault_counts(
    status: DataFrame, time: str = "event_time", window: str = "1 minute", late: str = "10 minutes", name: str = "name", value: str = "value0"
) -> DataFrame:
    """Faults by session, name and time window; late rows of a stream count up to ``late``, and a window
    comes out once the watermark has passed its end."""
    df = status.withWatermark(time, late) if status.isStreaming else status
    return df.groupBy("session_id", F.window(time, window), name).agg(F.sum(value).alias("faults"), F.count("*").alias("reports"))


_GAPS = "session_id string, after_seq long, next_seq long, lost long"


def record_gaps(records: DataFrame, order=("t_us", "seq")) -> DataFrame:
    """(session_id, after_seq, next_seq, lost): where sequence numbers are missing between neighbouring records of a session."""
    last = F.lag("seq").over(W.partitionBy("session_id").orderBy(*order))
    gaps = records.select("session_id", last.alias("after_seq"), F.col("seq").alias("next_seq")).withColumn("lost", F.col("next_seq") - F.col("after_seq") - 1)
    return gaps.where("lost > 0")


#: Groups into which :func:`gap_stream` deals sessions.
BUCKETS = 128
_GAP_STATE = "names array<string>, known binary, last binary, until binary, at binary, t binary, seq binary"


def gap_stream(records: DataFrame, late: str, idle_ms: int = 3_600_000, buckets: int = BUCKETS) -> DataFrame:
    """:func:`record_gaps` of a stream of ``records(session_id, t_us, seq)``, whatever its cut into batches.

    Records wait in the state until the watermark, ``late`` behind the latest one, has passed them, and are taken in
    order; the state then keeps a session's last number. It goes ``idle_ms`` after a session's last record.

    A call for each session and batch would cost more than its few records do, so sessions share ``buckets``
    groups, each of which takes its sessions' records as columns. More buckets make groups smaller.
    """

    def run(key, frames, state):
        mark = state.getCurrentWatermarkMs()
        names, *packed = state.get if state.exists else ([], *[b""] * 6)
        known, last, until, at, t, seq = (np.frombuffer(x, dtype=np.int64) for x in packed)
        fresh = [pdf[["session_id", "t_us", "seq"]] for pdf in frames]
        came = pd.concat(fresh) if fresh else pd.DataFrame({"session_id": [], "t_us": [], "seq": []})
        code, every = pd.factorize(np.array([*names, *came["session_id"]], dtype=object), use_na_sentinel=False)
        known, last, until = (np.append(x, np.zeros(len(every) - len(names), dtype=np.int64)) for x in (known, last, until))
        touched = np.zeros(len(every), dtype=bool)
        touched[code[len(names) :]] = True
        at = np.append(at, code[len(names) :]).astype(np.int64)
        t, seq = (np.append(x, came[c].to_numpy(dtype=np.int64)) for x, c in ((t, "t_us"), (seq, "seq")))
        order = np.lexsort((seq, t, at))
        at, t, seq = at[order], t[order], seq[order]
        due = t < mark * 1000
        who, now, number = at[due], t[due], seq[due]
        head = np.append(True, who[1:] != who[:-1])[: len(who)]
        before = np.where(head, last[who], np.append(0, number[:-1])[: len(who)])
        gap = (~head | (known[who] == 1)) & (number - before > 1)
        found = [np.array([*every], dtype=object)[who[gap]], before[gap], number[gap], (number - before - 1)[gap]]
        tail = np.append(who[1:] != who[:-1], True)[: len(who)]
        known[who[tail]], last[who[tail]], touched[who] = 1, number[tail], True
        ended = np.zeros(len(every), dtype=np.int64)
        ended[who[tail]] = now[tail] // 1000
        until = np.where(touched, np.maximum(ended, mark) + idle_ms, until)
        at, t, seq = at[~due], t[~due], seq[~due]
        waits = np.zeros(len(every), dtype=bool)
        waits[at] = True
        keep = waits | touched | (until > mark)
        if not keep.any():
            if state.exists:
                state.remove()
        else:
            place = np.cumsum(keep) - 1
            kept = [x for x, k in zip(every, keep, strict=True) if k]
            state.update((kept, *[x.astype(np.int64).tobytes() for x in (known[keep], last[keep], until[keep], place[at], t, seq)]))
            ends = [*([t.min() // 1000 + 1] if len(t) else []), *until[keep & ~waits]]
            state.setTimeoutTimestamp(int(max(min(ends), mark + 1)))
        yield pd.DataFrame(dict(zip(("session_id", "after_seq", "next_seq", "lost"), found, strict=True)))

    bucket = F.pmod(F.xxhash64("session_id"), F.lit(buckets)).alias("bucket")
    rows = records.select(F.col("session_id").cast("string").alias("session_id"), "t_us", "seq", F.timestamp_micros("t_us").alias("event_time"))
    return rows.withWatermark("event_time", late).select(bucket, "*").groupBy("bucket").applyInPandasWithState(
        run, _GAPS, _GAP_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
