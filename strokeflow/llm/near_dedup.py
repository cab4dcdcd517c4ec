"""Near-duplicate documents by min-max hashing.

A document is the set of its distinct word shingles. Under each hash function both the smallest and
the largest value are kept, so half as many functions give a signature of the same length, unbiased
and with a lower variance. A band joins the minima and maxima of one or two functions;
``shape(percent)`` takes as many bands as make two sets at the threshold miss all of them with a
probability of 1e-10 at most.

Links are found in four steps, each linear in what it reads:

1. Documents with one set are one node.
2. Star: in each bucket of a band the node with the most company over all bands is the pivot, and
   the others are compared with it on their full sets.
3. The components of these links leave the buckets that still hold several. Pairs across their
   components are found exactly, by prefix filtering: in any fixed order of shingles, here the
   rarest first, two similar sets share one of their first 15 % (at 85 percent). They too are
   compared on their full sets.
4. The components of step 3's links between the components of step 2.

Words are runs of characters other than ASCII white space, A-Z in lower case. A text of fewer words
than a shingle is one shingle; null texts and texts without words have none and no links. A null
doc_id has no links, is its own component (null) and is kept. Repeated rows share a component; an
empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strokeflow.llm.common import stored
from strokeflow.llm.components import connected_components
from strokeflow.llm.shingles import as_binary, mix, shingle_sets, slices

MISS = 1e-10  # bound on the probability that no band joins two sets at the threshold
LEAST_PERCENT = 40
COUNTERS = 1 << 16

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shape(percent: int) -> tuple[int, int]:
    """(hash functions in a band, bands) for a threshold.

    A band of b functions has 2 b values, and two sets with a similarity of s agree in all of them
    with a probability of s ** (2 b).
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent is {LEAST_PERCENT} to 100, not {percent}")
    width = 2 if percent >= 75 else 1
    joined = min(percent / 100, 0.99) ** (2 * width)
    return width, math.ceil(math.log(MISS) / math.log1p(-joined))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240608))
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def signature(hashes: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """(functions, 2): minimum and maximum of the values of a set under each hash function."""
    out = np.empty((len(mul), 2), dtype=np.uint32)
    out[:, 0], out[:, 1] = 2**32 - 1, 0
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 4096):
        v = short[None, at : at + 4096] * mul[:, None]
        v += add[:, None]
        np.minimum(out[:, 0], v.min(axis=1), out=out[:, 0])
        np.maximum(out[:, 1], v.max(axis=1), out=out[:, 1])
    return out


def band_keys(signatures: np.ndarray, width: int) -> np.ndarray:
    """(rows, bands): one 64-bit key for each band; the band's number is part of it."""
    values = signatures.reshape(len(signatures), -1, 2 * width).astype(np.uint64)
    key = np.tile(np.arange(1, values.shape[1] + 1, dtype=np.uint64), (len(values), 1))
    for i in range(2 * width):
        key = mix(key * _STEP + values[:, :, i])
    return key


def sketches(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n, node, keys) of each row; ``node`` is a 128-bit hash of the set."""
    width, bands = shape(percent)

    def run(parts):
        mul, add = _functions(width * bands)
        for part in parts:
            for lo, hi, data, bounds in slices(part.column(1)):
                hashes, at = shingle_sets(data, bounds, size)
                sets = [hashes[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                some = [signature(x, mul, add) for x in sets if len(x)]
                keys = band_keys(np.array(some), width).view(np.int64) if some else np.empty((0, bands), np.int64)
                n = np.diff(at)
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0)[lo:hi], pa.array(n), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()),
                        pa.ListArray.from_arrays(ends, keys.ravel()),
                    ],
                    ["doc_id", "n", "node", "keys"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, node binary, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(doc, set) of the documents in ``wanted(doc)``; a set is its sorted hashes."""

    def run(parts):
        for part in parts:
            for lo, hi, data, bounds in slices(part.column(1)):
                found = as_binary(*shingle_sets(data, bounds, size)).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0)[lo:hi], found], ["doc", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(wanted, "doc")
    return texts.dropDuplicates(["doc", "text"]).mapInArrow(run, "doc long, set binary")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of documents whose full sets are similar: 100 * common >= percent * all."""

    def run(parts):
        for part in parts:
            linked = []
            for a, b in zip(part.column(2), part.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                linked.append(100 * same >= percent * (len(both) - same))
            yield part.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    joined = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a long, b long")


def _alike(n: str, m: str, percent: int):
    """No sets of n and m shingles can be similar if this is false."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(token, doc, component, n, at): the first shingles of each of ``sets(doc, component, set)``, rarest first."""

    def count(parts):
        sums = np.zeros(COUNTERS, dtype=np.int64)
        for part in parts:
            for x in part.column(0):
                sums += np.bincount((np.frombuffer(x.as_buffer(), np.uint64) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["slot", "n"])

    # A table of fixed size: it orders the shingles, and any order gives the right pairs.
    got = sets.select("set").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(COUNTERS, dtype=np.int64)
    table[got["slot"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    weight = sets.sparkSession.sparkContext.broadcast(np.log2(table + 1).astype(np.uint8))

    def first(parts):
        for part in parts:
            for doc, component, x in zip(*(part.column(i) for i in range(3)), strict=True):
                h = np.frombuffer(x.as_buffer(), np.uint64)
                order = np.lexsort((h, weight.value[(h % np.uint64(COUNTERS)).astype(np.int64)]))
                length = len(h) - -(-percent * len(h) // 100) + 1
                yield pa.RecordBatch.from_pandas(
                    pd.DataFrame(
                        {
                            "token": h[order[:length]].view(np.int64), "doc": doc.as_py(), "component": component.as_py(),
                            "n": len(h), "at": np.arange(length),
                        }
                    ),
                    preserve_index=False,
                )

    return sets.select("doc", "component", "set").mapInArrow(first, "token long, doc long, component long, n long, at long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) and kept, for each row."""
    rows = stored(sketches(docs, size, percent), "near-sketches")
    nodes = stored(
        rows.where("n > 0 and doc_id is not null").groupBy("node")
        .agg(F.min_by(F.struct("doc_id", "n", "keys"), "doc_id").alias("x"))
        .select("node", F.col("x.doc_id").alias("doc"), "x.n", "x.keys"),
        "near-nodes",
    )
    in_band = nodes.select("doc", "n", F.explode("keys").alias("key"))
    shared = in_band.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(in_band.join(shared, "key"), "near-members")
    sets = stored(_sets(docs, members.select("doc").distinct(), size), "near-sets")

    company = members.groupBy("doc").agg(F.sum("size").alias("company"))
    pivots = (
        members.join(company, "doc").groupBy("key").agg(F.max(F.struct("company", "doc", "n")).alias("p"))
        .select("key", F.col("p.doc").alias("b"), F.col("p.n").alias("m"))
    )
    star = members.join(pivots, "key").where((F.col("doc") != F.col("b")) & _alike("n", "m", percent))
    links = stored(_linked(star.select(F.col("doc").alias("a"), "b").distinct(), sets, percent), "near-links")
    component = connected_components(links.toDF("u", "v"))

    inside = members.where("size > 2").join(component, members["doc"] == component["vertex"], "left").select(
        "key", "doc", F.coalesce("component", "doc").alias("component")
    )
    mixed = inside.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    several = stored(inside.join(mixed, "key").select("doc", "component").distinct(), "near-open")
    if not several.isEmpty():
        tokens = stored(_prefixes(sets.join(several, "doc"), percent), "near-prefixes")
        late = stored(_linked(_across(tokens, percent), sets, percent), "near-late-links")
        low, high = several.toDF("a", "u"), several.toDF("b", "v")
        joined = connected_components(late.join(low, "a").join(high, "b").select("u", "v"))
        component = _followed(component, joined)

    alone = F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")
    key = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("node")).otherwise(alone)
    labels = nodes.select("node", "doc").join(component, nodes["doc"] == component["vertex"], "left").select(
        "node", F.coalesce("component", "doc").alias("component")
    )
    return (
        rows.select("doc_id", F.col("n").alias("n_shingles"), key.alias("node")).join(labels, "node", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _across(tokens: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of documents of two components that share a token early enough to be similar."""
    common = tokens.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    several = tokens.join(common.select("token"), "token")
    a, b = several.alias("x"), several.alias("y")
    rest = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    near = (
        (F.col("x.token") == F.col("y.token")) & (F.col("x.component") < F.col("y.component"))
        & _alike("x.n", "y.n", percent) & ((100 + percent) * rest >= percent * (F.col("x.n") + F.col("y.n")))
    )
    return a.join(b, near).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()


def _followed(component: DataFrame, joined: DataFrame) -> DataFrame:
    """``component`` after its components were joined by ``joined``, both (vertex, component)."""
    next_ = joined.toDF("c", "d")
    moved = component.join(next_, component["component"] == next_["c"], "left").select(
        "vertex", F.coalesce("d", "component").alias("component")
    )
    own = joined.join(component.select("vertex"), "vertex", "left_anti")
    return moved.unionByName(own)


def keep_one_each(docs: DataFrame, size: int = 5, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group, one row for each doc_id.

    Rows with a null doc_id all stay.
    """
    groups = stored(near_duplicates(docs, size, percent), "near-groups")
    kept = groups.where("kept and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    own = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("__id"), "left_semi")
    return own.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))
