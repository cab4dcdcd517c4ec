"""URL filtering: ordered host/path rules, then exact list membership by a cascade of Bloom filters.

Level 0 of the cascade encodes the listed keys. Level 1 encodes the keys of the corpus that
level 0 reports although they are not listed, level 2 the listed keys that level 1 reports, and
so on until no key of the corpus is reported wrongly. Walking the levels then answers membership
exactly for every key that the corpus holds, and no join is needed to judge a page.

Null or malformed URLs have an empty host and path, fit no rule, and are allowed. Repeated rows
are judged alike; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strokeflow.llm.common import ascii_lower, stored

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and ``/ ? #`` or the end, A-Z in lower case."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def domains(host: Column) -> Column:
    """The host and every parent domain of it, e.g. ``a.b.c``, ``b.c``, ``c``; none for ''."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    every = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(every)


@dataclass(frozen=True)
class Rule:
    """Allows or blocks a host with all its subdomains below a path prefix."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        own = (host == self.host) | host.endswith("." + self.host)
        return own & path.startswith(self.path)


def match_rules(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule (then the first by text); null if none fits."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = rule.fits(host, path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def _hashed(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit("a"), key).alias("h1"), F.xxhash64(F.lit("b"), key).alias("h2")]


def _slots(h1, h2, level: int, k: int, m: int) -> np.ndarray:
    """The k bit numbers of each key at a level, as a (keys, k) array."""
    a = np.asarray(h1, dtype=np.int64).view(np.uint64)
    b = np.asarray(h2, dtype=np.int64).view(np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        a = (a ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        a ^= a >> np.uint64(31)
        return (a[:, None] + np.arange(k, dtype=np.uint64) * b[:, None]) % np.uint64(m)


@dataclass
class BloomCascade:
    """Levels of (words, number of bits); ``contains`` walks them."""

    levels: list[tuple[np.ndarray, int]]
    k: int

    def _in_level(self, h1, h2, level: int) -> np.ndarray:
        words, m = self.levels[level]
        slots = _slots(h1, h2, level, self.k, m)
        bits = words[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))
        return (bits & np.uint64(1)).astype(bool).all(axis=1)

    def contains_hashed(self, h1, h2) -> np.ndarray:
        """Exact for the keys of the universe that the cascade was built over."""
        found = np.zeros(len(h1), dtype=bool)
        open_ = np.arange(len(h1))
        for level in range(len(self.levels)):
            open_ = open_[self._in_level(h1[open_], h2[open_], level)]
            found[open_] = level % 2 == 0
        return found

    def any_listed(self, keys: Column) -> Column:
        """True if any string of an array column is listed."""
        cascade = keys_broadcast(self)

        @F.pandas_udf("boolean")
        def judge(h1: pd.Series, h2: pd.Series) -> pd.Series:
            sizes = h1.map(len).to_numpy()
            if not sizes.sum():
                return pd.Series(np.zeros(len(h1), dtype=bool))
            flat = [np.concatenate([np.asarray(x, dtype=np.int64) for x in h]) for h in (h1, h2)]
            rows = np.repeat(np.arange(len(h1)), sizes)
            hits = cascade.value.contains_hashed(*flat)
            return pd.Series(np.bincount(rows[hits], minlength=len(h1)) > 0)

        a = F.transform(keys, lambda x: F.xxhash64(F.lit("a"), x))
        b = F.transform(keys, lambda x: F.xxhash64(F.lit("b"), x))
        return judge(a, b)


def keys_broadcast(cascade: BloomCascade):
    from pyspark import SparkContext

    return SparkContext.getOrCreate().broadcast(cascade)


def marked_keys(universe: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, h1, h2, listed) of the distinct keys of ``universe(key)``, all that will ever be asked for.

    Listed keys are hosts, so their A-Z are lower-cased as those of a URL's host are.
    """
    marked = listed.select(ascii_lower(F.col("key")).alias("key")).where("key is not null").distinct().withColumn("listed", F.lit(True))
    return stored(
        universe.select("key").where("key is not null").distinct().join(marked, "key", "left")
        .select("key", *_hashed(F.col("key")), F.coalesce("listed", F.lit(False)).alias("listed")),
        "cascade-keys",
    )


def build_cascade(keys: DataFrame, bits_per_key: int = 10) -> BloomCascade:
    """The cascade over ``keys(h1, h2, listed)``.

    The filters are the only thing that reaches the driver and the executors whole, ``bits_per_key``
    bits for each listed key and about a tenth more for the further levels.
    """
    k = max(1, round(bits_per_key * math.log(2)))
    keys = keys.select("h1", "h2", "listed")
    cascade = BloomCascade([], k)
    encoded, others = keys.where("listed"), keys.where("not listed")
    while n := encoded.count():
        m = 64 * math.ceil(max(64, n * bits_per_key) / 64)
        level = len(cascade.levels)

        def bits(batches, level=level, m=m):
            for x in batches:
                slots = np.unique(_slots(x["h1"], x["h2"], level, k, m))
                word, bit = (slots >> np.uint64(6)).astype(np.int64), slots & np.uint64(63)
                first = np.flatnonzero(np.diff(word, prepend=-1))
                value = np.bitwise_or.reduceat(np.uint64(1) << bit, first) if len(word) else bit
                yield pd.DataFrame({"word": word[first], "value": value.view(np.int64)})

        rows = (
            encoded.select("h1", "h2").mapInPandas(bits, "word long, value long")
            .groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()
        )
        words = np.zeros(m // 64, dtype=np.uint64)
        words[rows["word"].to_numpy()] = rows["value"].to_numpy().view(np.uint64)
        cascade.levels.append((words, m))

        def wrong(batches, level=level, m=m, words=words):
            one = BloomCascade([(words[:0], 64)] * level + [(words, m)], k)
            for x in batches:
                yield x[one._in_level(x["h1"].to_numpy(), x["h2"].to_numpy(), level)]

        reported = stored(others.mapInPandas(wrong, keys.schema), "cascade-level")
        encoded, others = reported, encoded
    return cascade


def listed_hosts(hosts: DataFrame, keys: DataFrame, blocks: int, bits_per_key: int) -> DataFrame:
    """The ``hosts(host)`` of which a domain is listed, by one cascade for each block of the keys.

    One cascade at a time is in memory, so any number of listed keys can be asked for.
    """
    found = []
    for i in range(blocks):
        some = keys.where(F.pmod(F.xxhash64("h2"), F.lit(blocks)) == i)
        hit = build_cascade(some, bits_per_key).any_listed(F.array("key"))
        found.append(stored(some.where(hit).select("key"), "cascade-hits"))
    hits = functools.reduce(DataFrame.unionAll, found)
    return hosts.select("host", F.explode(domains(F.col("host"))).alias("key")).join(hits, "key").select("host").distinct()


def filter_urls(
    pages: DataFrame, rules: list[Rule], listed: DataFrame, url: str = "url", bits_per_key: int = 10, max_bytes: int = 32 << 20
) -> DataFrame:
    """Add host, path, rule and verdict to ``pages``; columns of these names are replaced.

    The longest fitting rule decides. Where no rule fits, a page is blocked if its host or a
    parent domain is in ``listed(key)``, by a cascade over all domains of the table. If that would take
    over ``max_bytes``, hosts are judged first, by a cascade for each block of the keys.
    """
    host, path = url_host(F.col(url)), url_path(F.col(url))
    hosts = pages.select(host.alias("host")).distinct()
    keys = marked_keys(hosts.select(F.explode(domains(F.col("host"))).alias("key")), listed)
    blocks = math.ceil(keys.where("listed").count() * bits_per_key * 1.25 / 8 / max_bytes)
    text, verdict = match_rules(F.col("host"), F.col("path"), rules)
    judged = pages.withColumns({"host": host, "path": path}).withColumns({"rule": text, "verdict": verdict})
    if blocks <= 1:
        listed_column = build_cascade(keys, bits_per_key).any_listed(domains(F.col("host")))
    else:
        hit = listed_hosts(hosts, keys, blocks, bits_per_key).select(F.col("host").alias("__host"))
        judged = judged.join(hit, F.col("host") == F.col("__host"), "left")
        listed_column = F.col("__host").isNotNull()
    return (
        judged.withColumn("__listed", listed_column)
        .withColumn("verdict", F.coalesce("verdict", F.when(F.col("__listed"), "block").otherwise("allow")))
        .drop("__listed", "__host")
    )
