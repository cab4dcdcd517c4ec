"""Tables of sessions that are derived again only where what they depend on has changed, and become visible together.

A manifest has one row for each session and run: the signature of all that the session's tables were made
from. A run derives the sessions whose signature is not the one of their last run, writes all of their tables
into the run's own partitions, and the manifest's rows last. Readers take each session's tables from its last
run in the manifest, so they see all new tables or all old ones, and a run that broke off not at all; its
repeat takes the same number and replaces what was there. One writer at a time.

A run writes a few files for each table, whatever the number of its sessions; of many rows, as many as the caller deals them to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokeflow.sources.scratch import stored

_MANIFEST = "session_id string, signature string, run long"
#: Rows that a task sorts and writes. The tables of exports have up to 63 columns and few of them filled, so that a task of so
#: many bytes in a shuffle as adaptive execution takes would sort gigabytes.
ROWS = 100_000


def dealt(df: DataFrame, rows: int | None = None, *order: str) -> DataFrame:
    """``df`` by session, to tasks of about ``ROWS`` of the ``rows`` that it is made of, and sorted there; without a number, as adaptive execution deals it."""
    parts = [] if rows is None else [max(1, -(-rows // ROWS))]
    return df.repartition(*parts, "session_id").sortWithinPartitions("session_id", *order)


class Published:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def exists(self) -> bool:
        """Whether any session has been published here."""
        return self.has("manifest")

    def has(self, name: str) -> bool:
        """Whether a table of that name was begun."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _runs(self) -> DataFrame:
        if not self.has("manifest"):
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest")

    def manifest(self) -> DataFrame:
        """(session_id, signature, run) of each session's last run."""
        return self._runs().groupBy("session_id").agg(F.max_by("signature", "run").alias("signature"), F.max("run").alias("run"))

    def stale(self, current: DataFrame) -> DataFrame:
        """The rows of ``current(session_id, signature)`` that the manifest does not hold as they are."""
        return current.select("session_id", "signature").join(self.manifest().drop("run"), ["session_id", "signature"], "left_anti")

    def _put(self, df: DataFrame, name: str, run: int, fmt: str = "parquet", **options) -> None:
        rows = df.withColumn("run", F.lit(run).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").options(**options).format(fmt).save(f"{self.root}/{name}")

    def _next(self) -> int:
        return (self._runs().agg(F.max("run")).first()[0] or 0) + 1

    def publish(self, current: DataFrame, build: Callable[[DataFrame], dict[str, DataFrame]]) -> DataFrame:
        """Derive the stale ones of ``current(session_id, signature)``; these come back.

        ``build(stale)`` gives the tables, each with session_id, of the sessions in ``stale(session_id)``, dealt out and
        sorted as they should stand in their files (:func:`dealt`).
        """
        todo = stored(self.stale(current), "stale")
        if todo.isEmpty():
            return todo
        run = self._next()
        for name, df in build(todo.select("session_id")).items():
            self._put(df, name, run)
        self._put(todo, "manifest", run)
        return todo

    def replace(self, sessions: DataFrame, tables: dict[str, DataFrame], formats: dict[str, tuple[str, dict]] | None = None) -> None:
        """Publish ``tables``, sorted as they should stand in their files, as all that there is of ``sessions(session_id)``.

        ``formats`` gives a table's format and options where it is not Parquet.
        """
        run = self._next()
        for name, df in tables.items():
            fmt, options = (formats or {}).get(name, ("parquet", {}))
            self._put(df, name, run, fmt, **options)
        # No signature: a later ``publish`` makes these sessions anew.
        self._put(sessions.select("session_id", F.lit(None).cast("string").alias("signature")).distinct(), "manifest", run)

    def current(self, df: DataFrame) -> DataFrame:
        """The rows of ``df(session_id, run)`` that are of their session's last run."""
        return df.join(self.manifest().select("session_id", "run"), ["session_id", "run"], "left_semi").drop("run")

    def read(self, name: str, schema: str | None = None, fmt: str = "parquet", **options) -> DataFrame:
        """One table of all published sessions, each as of its last run."""
        reader = self.spark.read.schema(f"{schema}, run long") if schema else self.spark.read
        return self.current(reader.options(**options).format(fmt).load(f"{self.root}/{name}"))
