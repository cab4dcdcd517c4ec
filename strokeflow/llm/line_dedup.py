"""Line deduplication with levelled sorted runs of line hashes.

A :class:`LineIndex` keeps runs, tables bucketed and sorted by the hash of a line. A new batch of
documents is merge-joined with the runs once: keys that no run holds are a new run at level 0, the
others a log of repeats. When a level has ``fan_in`` runs they are merged into one run of the next
level, so a key is rewritten once for each level only. Runs of one index never share a key.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case. Keys
of at least ``min_chars`` code points that ``min_docs`` or more documents hold lose all their
lines except those in the largest doc_id. Null or empty text is one empty line; repeated lines of
the surviving document stay; rows with one doc_id count as one document; a null doc_id counts as
one document below all others. An empty table gives an empty result. Extra columns pass through,
except that the four result columns replace columns of their names.
"""

from __future__ import annotations

import functools
import hashlib
import uuid

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokeflow.llm.common import NO_ID, shared_dir, stored

_SPACE = b" \t\n\x0b\x0c\r"


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _keys(text: str | None) -> tuple[list[str], list[bytes]]:
    """The lines of a text and their keys as UTF-8."""
    lines = (text or "").split("\n")
    return lines, [x.encode("utf-8", "surrogatepass").strip(_SPACE).lower() for x in lines]


def _long(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def line_keys(docs: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """Rows (doc, h1, h2, batch): the distinct keys of each document; one document, one batch."""

    def run(parts):
        for part in parts:
            ids, h1, h2 = [], [], []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for key in {k for k in _keys(text)[1] if _long(k, min_chars)}:
                    digest = xxhash.xxh3_128_intdigest(key)
                    ids.append(doc)
                    h1.append(_signed(digest >> 64))
                    h2.append(_signed(digest & (2**64 - 1)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, h1, h2)], ["doc", "h1", "h2"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    return rows.mapInArrow(run, "doc long, h1 long, h2 long").withColumn(
        "batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int")
    )


class LineIndex:
    """Levelled sorted runs of (h1, h2, n documents, largest doc).

    A run is a table in buckets of (h1, h2), sorted in each. A batch arrives in as many partitions, so
    joins with the runs and merges of runs read them as they lie, without an exchange.
    """

    def __init__(self, spark: SparkSession, fan_in: int = 2):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.repeats: list[DataFrame] = []
        self._tables: list[str] = []

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        table = f"line_{uuid.uuid4().hex}"
        writer = df.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        writer.partitionBy("known").option("path", shared_dir(self.spark, name)).saveAsTable(table)
        self._tables.append(table)
        return self.spark.table(table)

    def add(self, keys: DataFrame) -> None:
        """Take a batch of (doc, h1, h2); no document may come in two batches."""
        batch = keys.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("top"))
        known = F.lit(False)
        for i, run in enumerate(x for level in self.levels for x in level):
            batch = batch.join(run.select("h1", "h2", F.lit(True).alias(f"in{i}")), ["h1", "h2"], "left")
            known = known | F.col(f"in{i}").isNotNull()
        judged = self._written(batch.select("h1", "h2", "n", "top", known.alias("known")), "line-batch")
        self.repeats.append(judged.where("known"))
        self._put(judged.where("not known"), 0)

    def _put(self, run: DataFrame, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_in:
            runs, self.levels[level] = self.levels[level], []
            self._put(self._written(self._merged(runs), f"line-run-{level + 1}").where("not known"), level + 1)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """One run of all; runs share no keys, so each row comes from one of them."""
        out = runs[0].select("h1", "h2", "n", "top")
        for run in runs[1:]:
            out = out.join(run.select("h1", "h2", F.col("n").alias("m"), F.col("top").alias("other")), ["h1", "h2"], "full").select(
                "h1", "h2", F.coalesce("n", "m").alias("n"), F.coalesce("top", "other").alias("top")
            )
        return out.withColumn("known", F.lit(False))

    def frequent(self, min_docs: int) -> DataFrame:
        """(h1, h2, top) of the keys that at least ``min_docs`` documents hold."""
        rows = [x.select("h1", "h2", "n", "top") for x in [*(x for level in self.levels for x in level), *self.repeats]]
        return (
            functools.reduce(DataFrame.unionAll, rows)
            .groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
            .where(F.col("n") >= min_docs).select("h1", "h2", "top")
        )

    def close(self) -> None:
        """Forget the names of the runs; their files stay with the other written tables."""
        for table in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables.clear()


def dedup_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fan_in: int = 2
) -> DataFrame:
    """``docs`` with kept_text, n_lines, n_dropped and kept_sha256 added."""
    keys = stored(line_keys(docs, min_chars, batches), "line-keys", "batch")
    index = LineIndex(docs.sparkSession, fan_in)
    for b in range(batches):
        index.add(keys.where(F.col("batch") == b))
    frequent = stored(index.frequent(min_docs), "line-frequent")
    index.close()
    drops = (
        keys.join(frequent, ["h1", "h2"]).where("doc < top")
        .groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("h1").alias("__drop"))
    )

    @F.pandas_udf("kept_text string, n_lines long, n_dropped long, kept_sha256 string")
    def keep(texts: pd.Series, drop: pd.Series) -> pd.DataFrame:
        out = []
        for text, gone in zip(texts, drop, strict=True):
            gone = frozenset(gone.tolist()) if gone is not None else ()
            lines = (text or "").split("\n")
            kept = lines
            if gone:
                same = _keys(text)[1]
                kept = [
                    line for line, key in zip(lines, same, strict=True)
                    if not _long(key, min_chars) or _signed(xxhash.xxh3_128_intdigest(key) >> 64) not in gone
                ]
            joined = "\n".join(kept)
            sha = hashlib.sha256(joined.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((joined, len(lines), len(lines) - len(kept), sha))
        return pd.DataFrame(out, columns=["kept_text", "n_lines", "n_dropped", "kept_sha256"])

    return (
        docs.drop("kept_text", "n_lines", "n_dropped", "kept_sha256")
        .withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
        .join(drops, "__doc", "left")
        .withColumn("__kept", keep("text", "__drop")).select("*", "__kept.*").drop("__doc", "__kept", "__drop")
    )
