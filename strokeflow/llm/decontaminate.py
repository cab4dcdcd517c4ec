"""Benchmark decontamination by a distributed positional inverted index.

1. The corpus is split into words once. The postings of all benchmark terms are stored: term,
   document and position; one more posting of each document, of the term '', has its number of words.
2. Every ``width`` consecutive words of an item are a window (an item of fewer words is one). The
   postings of each term are counted, and a window's places ranked, the rarest term first.
3. A posting shifted by its place in a window is a possible start. The starts of the rarest term are
   intersected with those of the second rarest, and what is left with the postings at all further
   places. Starts that every place confirms are phrase matches.
4. For proximity, where up to e of a window's distinct terms may be absent, the e + 1 rarest are
   anchors, so at least one of them stands in every match; absent terms count among them. At least
   ``near`` of the window's distinct terms within ``width - 1`` words of an anchor, in any order, make
   a match. Every run of up to ``width`` document words with so many of the terms is found.

Only DataFrame functions are used. Null texts have no words and are never hit; an empty table
gives an empty result. A document is identified by its doc_id and text, so repeated rows (and a
null doc_id) get the same answer on each row. Extra columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strokeflow.llm.common import ascii_lower, bounded_broadcast, stored

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Benchmark tables of up to this many windows are sent to every executor, larger ones shuffled.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """The words of a text: runs of digits, letters and non-ASCII characters, A-Z in lower case."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATORS), "")


def windows(items: DataFrame, width: int) -> DataFrame:
    """Rows (item_id, at, window): every ``width`` consecutive words of each item."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
    n = F.size("w")
    starts = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)))
    return (
        w.where(n > 0).select("item_id", "w", F.explode(starts).alias("at"))
        .select("item_id", "at", F.slice("w", F.col("at") + 1, width).alias("window"))
    )


def _same(columns: list[str], a: str, b: str) -> Column:
    """Equality of these columns of two aliased tables; nulls are equal."""
    return functools.reduce(Column.__and__, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])


class PositionalIndex:
    """Postings of a corpus for the terms of a set of benchmark windows."""

    def __init__(self, docs: DataFrame, items: DataFrame, width: int = 13):
        self.width = width
        text = F.col("text")
        self.docs = docs.select("doc_id", text, F.xxhash64(text).alias("th"))
        every = stored(windows(items, width), "bench-windows")
        # Windows go by a number, so that shuffles carry no words; it holds once it is written.
        numbered = every.select("window").distinct().withColumn("no", F.monotonically_increasing_id())
        self.windows = stored(numbered, "bench-numbers")
        self.items = every.join(self.windows, "window").groupBy("no").agg(F.collect_set("item_id").alias("items"))
        terms = every.select(F.explode(F.concat("window", F.array(F.lit("")))).alias("term")).distinct()
        # Without items there are no terms, but each document still has its number of words.
        terms = terms.unionAll(docs.sparkSession.createDataFrame([("",)], "term string")).distinct()
        self.postings = stored(self._tokens().join(bounded_broadcast(terms, BROADCAST_ROWS), "term"), "postings")
        counts = self.postings.groupBy("term").agg(F.count("*").alias("df"))
        order = W.partitionBy("no").orderBy(F.coalesce("df", F.lit(0)), "term", "offset")
        places = (
            self.windows.select("no", F.size("window").alias("n"), F.posexplode("window").alias("offset", "term"))
            .join(counts, "term", "left").withColumn("rank", F.row_number().over(order))
        )
        self.places = stored(places, "bench-places")

    def _tokens(self) -> DataFrame:
        w = self.docs.select("doc_id", "th", F.concat(words(F.col("text")), F.array(F.lit(""))).alias("w"))
        return w.select("doc_id", "th", F.posexplode("w").alias("pos", "term"))

    def _starts(self, rank: int) -> DataFrame:
        """(doc_id, th, start, no, n): where windows would start by the postings of one rank."""
        places = self.places.where(F.col("rank") == rank).select("term", "offset", "no", "n")
        return (
            self.postings.join(bounded_broadcast(places, BROADCAST_ROWS), "term")
            .select("doc_id", "th", (F.col("pos") - F.col("offset")).alias("start"), "no", "n").where("start >= 0")
        )

    def phrases(self) -> DataFrame:
        """(doc_id, th, start, n, no) of each exact occurrence of a window."""
        key = ["doc_id", "th", "start", "no"]
        first, second = self._starts(1).distinct(), self._starts(2).select(*key)
        two = stored(
            first.where("n = 1").unionByName(first.where("n > 1").alias("a").join(second.alias("b"), _same(key, "a", "b"), "left_semi")),
            "phrase-starts",
        )
        further = bounded_broadcast(self.places.where("rank > 2").select("no", "offset", "term"), BROADCAST_ROWS * self.width)
        awaited = two.where("n > 2").join(further, "no").select(*key, "n", "term", (F.col("start") + F.col("offset")).alias("pos"))
        held = bounded_broadcast(two.where("n > 2").select("doc_id", "th").distinct(), BROADCAST_ROWS)
        there = self.postings.alias("a").join(held.alias("b"), _same(["doc_id", "th"], "a", "b"), "left_semi")
        met = awaited.alias("a").join(there.alias("b"), _same(["doc_id", "th", "pos", "term"], "a", "b"), "left_semi")
        whole = met.groupBy(*key, "n").agg(F.count("*").alias("met")).where("met = n - 2")
        return two.where("n <= 2").unionByName(whole.drop("met")).select("doc_id", "th", "start", "n", "no")

    def _near_candidates(self, absent: Column) -> DataFrame:
        """Anchor postings of each window, with the words around them."""
        order = W.partitionBy("no").orderBy(F.coalesce("df", F.lit(0)), "term")
        ranked = (
            self.places.join(self.windows, "no").groupBy("no", "window", "term", "df").agg(F.min("offset").alias("offset"))
            .withColumn("rank", F.row_number().over(order))
        )
        anchors = ranked.where((F.col("rank") <= absent + 1) & (F.col("df") > 0)).select("term", "offset", "no", "window")
        anchors = stored(anchors, "bench-anchors")
        reach = self.width - 1
        first = F.greatest(F.col("pos") - reach, F.lit(0))
        w = self.docs.select("doc_id", "th", words(F.col("text")).alias("w"))
        tokens = w.select("doc_id", "th", "w", F.posexplode("w").alias("pos", "term"))
        around = F.slice("w", first + 1, F.col("pos") - first + self.width).alias("around")
        wanted = anchors.select("term").distinct()
        kept = ["doc_id", "th", "pos", "term"]
        if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            postings = tokens.join(F.broadcast(wanted), "term").select(*kept, around)
        else:  # a shuffle should carry the words around a posting, not the whole text
            postings = tokens.select(*kept, around).join(wanted, "term")
        return postings.join(bounded_broadcast(anchors, BROADCAST_ROWS), "term").withColumn("start", F.col("pos") - F.col("offset"))

    def _lengths(self) -> DataFrame:
        return self.postings.where("term = ''").select("doc_id", "th", F.col("pos").cast("long").alias("n_words"))

    def proximity(self, near: float = 0.8) -> DataFrame:
        """(doc_id, th, start, window, share): windows of which ``near`` of the terms stand together."""
        return (
            self._near(near).groupBy("doc_id", "th", "start", "window").agg(F.max("share").alias("share"))
        )

    def _near(self, near: float) -> DataFrame:
        distinct = F.size(F.array_distinct("window"))
        absent = F.floor(distinct * (1 - near) + F.lit(1e-9))
        share = F.size(F.array_intersect("around", "window")) / distinct
        return self._near_candidates(absent).withColumn("share", share).where(F.col("share") >= near)

    def near_report(self, near: float = 0.8) -> DataFrame:
        """One row for each document row: n_words, n_near (windows), n_near_items, near_items and best_share."""
        key = ["doc_id", "th"]
        found = self._near(near).groupBy(*key, "no").agg(F.max("share").alias("share"))
        found_in = (
            found.join(bounded_broadcast(self.items, BROADCAST_ROWS), "no")
            .groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
            .agg(F.count("*").alias("n_near"), F.max("share").alias("share"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        )
        rows = self._lengths()
        same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))
        items = F.coalesce("items", F.array().cast("array<string>"))
        return (
            rows.join(stored(found_in, "near-passages"), same, "left")
            .select("doc_id", "th", "n_words", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                    F.size(items).cast("long").alias("n_near_items"), items.alias("near_items"),
                    F.round(F.coalesce("share", F.lit(0.0)), 6).alias("best_share"))
        )

    def report(self, one_in: int = 20) -> DataFrame:
        """One row for each document row: n_words, n_hit, n_items, items and contaminated."""
        found = stored(self.phrases(), "phrases")
        key = ["doc_id", "th"]
        hit = (
            found.select(*key, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("at"))
            .distinct().groupBy(*key).agg(F.count("*").alias("n_hit"))
        )
        which = (
            found.select(*key, "no").distinct().join(bounded_broadcast(self.items, BROADCAST_ROWS), "no")
            .select(*key, F.explode("items").alias("item_id"))
            .groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        )
        found_in = (
            hit.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "n_hit")
            .join(which.select(F.col("doc_id").alias("__id2"), F.col("th").alias("__th2"), "items"),
                  F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__th") == F.col("__th2")))
        )
        rows = self._lengths()
        same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))
        n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
        return (
            rows.join(found_in, same, "left")
            .select("doc_id", "th", "n_words", n_hit.alias("n_hit"),
                    F.size(items).cast("long").alias("n_items"), items.alias("items"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))
        )


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 13, one_in: int = 20) -> DataFrame:
    """The documents that are not contaminated: fewer than one in ``one_in`` of
    their words is hit."""
    report = PositionalIndex(docs, items, width).report(one_in)
    bad = report.where("contaminated").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th"))
    return docs.join(bad, same, "left_anti")
