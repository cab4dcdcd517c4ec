"""Mixing sources to target weights by Poisson replication.

A source with ``n`` documents and target share ``p`` of ``total`` rows has the repetition rate
``p * total / n``. Each document draws its number of copies by inverting the Poisson distribution
of that mean at a number in [0, 1) hashed from the seed and its doc_id, is exploded by that
count, and all copies are put in a global random order: each goes to the partition that its random
key is hashed to, and a partition is sorted by that key. (A total order would draw twice, once to
find the bounds of ranges.)

A rate above ``MAX_MEAN`` is split into equal parts that draw independently (a sum of Poisson
numbers is one), so the tables of the distribution stay short and no array grows with the rate.

Null sources form a source of their own. Rows with one doc_id draw alike; a null doc_id draws as
the text "null". A source without a weight, the null source too, has the ``default`` weight; without
a default it gets none of the mix. If no source has documents the result is empty. Extra columns
pass through; columns named rate, copy or mix_key are replaced. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strokeflow.llm.common import bounded_broadcast, stored

MAX_MEAN = 16.0
#: P(X > 96) is below 1e-40 for a mean of 16, far beyond the 2^-52 steps of the hashed number.
LEVELS = 96
#: Tables of up to this many sources are sent to every executor, larger ones are shuffled.
BROADCAST_SOURCES = 20_000


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by ':'."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long").cast("double") / float(2**52)


def poisson_table(mean: Column) -> Column:
    """P(X <= 0), ..., P(X <= LEVELS - 1) for a Poisson number of this mean."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(LEVELS - 1)),
        start,
        lambda acc, j: F.struct(
            (acc["p"] * mean / j).alias("p"),
            F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * mean / j)).alias("cdf"),
        ),
        lambda acc: acc["cdf"],
    )


def repetition_rates(docs: DataFrame, weights: DataFrame, total: float | None = None, default: float = 0.0) -> DataFrame:
    """(source, n, rate) for ``weights(source, weight)``; the weights are made to sum to one.

    ``total`` is the number of rows to aim at, by default as many as ``docs`` has. Weights of
    sources without documents are shared among the others. Sources that ``weights`` does not list have
    the weight ``default``; a listed weight of 0 leaves a source out.
    """
    sizes = docs.groupBy("source").agg(F.count("*").alias("n")).alias("s")
    summed = F.greatest(F.coalesce(F.sum("weight"), F.lit(0.0)), F.lit(0.0))
    w = weights.groupBy("source").agg(summed.cast("double").alias("weight")).alias("w")
    rows = stored(
        sizes.join(w, F.col("s.source").eqNullSafe(F.col("w.source")), "left")
        .select("s.source", "n", F.coalesce("weight", F.lit(float(default))).alias("weight")),
        "mix-sizes",
    )
    sums = rows.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n")).first()
    if not sums["all_weight"]:
        return rows.select("source", "n", F.lit(0.0).alias("rate"))
    goal = float(sums["all_n"] if total is None else total)
    return rows.select("source", "n", (F.col("weight") * (goal / sums["all_weight"]) / F.col("n")).alias("rate"))


def mix_sources(docs: DataFrame, weights: DataFrame, total: float | None = None, seed: int = 0, default: float = 0.0) -> DataFrame:
    """Copies of ``docs`` with rate, copy (1, 2, ...) and mix_key added, in random order."""
    rates = repetition_rates(docs, weights, total, default)
    parts = F.greatest(F.ceil(F.col("rate") / MAX_MEAN), F.lit(1)).cast("int")
    table = (
        rates.where("rate > 0")
        .select(F.col("source").alias("__source"), F.col("rate"), parts.alias("__parts"))
        .withColumn("__cdf", poisson_table(F.col("rate") / F.col("__parts")))
    )
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    part = F.col("__part").cast("string")
    u = unit(F.lit(str(seed)), doc, part)
    drawn = (
        docs.drop("rate", "copy", "mix_key")
        .join(bounded_broadcast(table, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("__part", F.explode(F.sequence(F.lit(1), F.col("__parts"))))
        .withColumn("__u", u)
        .withColumn("__count", F.size(F.filter("__cdf", lambda c: c < F.col("__u"))))
    )
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), doc, part, F.col("copy").cast("string")).cast("binary"))
    copies = (
        drawn.where("__count > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__count"))))
        .withColumn("mix_key", key)
        .withColumn("copy", F.col("copy") + (F.col("__part") - 1) * LEVELS)
        .drop("__source", "__parts", "__part", "__cdf", "__u", "__count")
    )
    return copies.repartition("mix_key").sortWithinPartitions("mix_key")
