"""Spelling variants: groups of words that are one edit apart, found through a reduced alphabet.

1. Letters are hashed to a few symbols; a word's symbols are its reduced word. The more words there
   are, the more symbols: ``reduction`` takes the seed that spreads the letters of the vocabulary best.
2. Every word generates the one-edit neighbourhood of its reduced word, as hashes: the reduced word
   itself, its deletions and its replacements by a higher symbol. Insertions and replacements by a
   lower symbol are the same pairs seen from the other word, which generates them.
3. The neighbours are joined with the reduced words of the vocabulary, and the pairs confirmed on the
   original strings. A reduced word that over ``DENSE`` words share is left to a second round
   with more symbols, for it and the words that reach it, so no group makes all its pairs.
4. A word's form is its most frequent neighbour if that is ``factor`` times as frequent. Forms are
   followed by pointer jumping; n rises tenfold with each step, so chains are short.

Words are told apart by their code points. Null words and counts are left out, words that repeat count
once with the sum of their counts; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strokeflow.llm.common import ascii_lower, stored
from strokeflow.llm.shingles import mix

DENSE = 64
#: A round with so many symbols tells nearly all letters apart and has no next one.
MOST_SYMBOLS = 256
SEEDS = 64
#: Numbers that are worked on at once.
CELLS = 1 << 20

_BASE = np.uint64(0xD1B54A32D192ED03)
_INVERSE = np.uint64(pow(0xD1B54A32D192ED03, -1, 2**64))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def runs(text: Column, least: int) -> Column:
    """The maximal runs of Latin letters of at least ``least`` code points, A-Z in lower case."""
    letters = "[A-Za-zÀ-ÿ]"
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{letters}{{{least},}}"), F.lit(0)), ascii_lower)


def corpus_words(docs: DataFrame, least: int = 7, times: int = 2, slip_in: int | None = None) -> DataFrame:
    """(word, n): the words of ``docs(doc_id, text)`` of at least ``least`` code points that occur ``times`` times.

    With ``slip_in`` a run loses a code point where that number divides the CRC-32 of
    ``<doc_id>:<run>``: the remainder of the CRC by its length says which. A null doc_id is ''.
    """
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs(F.col("text"), least)).alias("word"))
    if slip_in:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = (h % F.length("word")).cast("int")
        short = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        run = run.select(F.when(h % slip_in == 0, short).otherwise(F.col("word")).alias("word"))
    return run.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def _symbols(letters: np.ndarray, k: int, seed: int) -> np.ndarray:
    return mix((letters.astype(np.uint64) + np.uint64(seed << 32)) * _STEP) % np.uint64(k)


def letter_counts(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words and how often each occurs; summed in each task first."""

    def run(parts):
        for part in parts:
            points, n = np.unique(np.frombuffer("".join(part.column(0).to_pylist()).encode("utf-32-le"), dtype=np.uint32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(points.astype(np.int64)), pa.array(n)], ["letter", "n"])

    rows = words.select("word").mapInArrow(run, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).orderBy("letter").toPandas()
    return rows["letter"].to_numpy(dtype=np.uint64), rows["n"].to_numpy(dtype=float)


def reduction(letters: np.ndarray, n: np.ndarray, k: int) -> int:
    """The seed under which two letters of the vocabulary are least likely to share a symbol."""
    spread = [np.square(np.bincount(_symbols(letters, k, seed).astype(np.int64), weights=n, minlength=k)).sum() for seed in range(SEEDS)]
    return int(np.argmin(spread))


def _neighbourhoods(word: pa.Array, k: int, seed: int, probes: bool):
    """(rows, keys): the key of each word's reduced word, or with ``probes`` its neighbours' keys.

    Words of one length are worked on together; a key is a hash of symbols and length.
    """
    text = word.to_pylist()
    length = np.array([len(x) for x in text], dtype=np.int64)
    order = np.argsort(length, kind="stable")
    at = 0
    while at < len(order):
        size = length[order[at]]
        end = min(int(np.searchsorted(length[order], size, "right")), at + max(1, CELLS // max(int(size) * (k if probes else 1), 1)))
        rows, at = order[at:end], end
        if not size:
            continue
        points = np.frombuffer("".join([text[i] for i in rows]).encode("utf-32-le"), dtype=np.uint32).reshape(len(rows), size)
        symbol = _symbols(points, k, seed) + np.uint64(1)
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, dtype=np.uint64)]))
        value = symbol * power
        sums = np.cumsum(value, axis=1, dtype=np.uint64)
        whole = sums[:, -1:]
        tag, tag_shorter = np.array([size, size - 1]).astype(np.uint64) * _STEP
        yield rows, mix(whole[:, 0] + tag), 0
        if not probes:
            continue
        # A deletion: what stands behind moves down by one place. Any of a run of equal symbols gives the same.
        fresh = np.ones(symbol.shape, dtype=bool)
        fresh[:, 1:] = symbol[:, 1:] != symbol[:, :-1]
        shorter = sums - value + (whole - sums) * _INVERSE
        i, j = np.nonzero(fresh)
        if size > 1:
            yield rows[i], mix(shorter[i, j] + tag_shorter), 1
        for c in range(2, k + 1):
            i, j = np.nonzero(symbol < c)
            yield rows[i], mix(whole[i, 0] + (np.uint64(c) - symbol[i, j]) * power[j] + tag), 1


def _keys(words: DataFrame, k: int, seed: int, probes: bool) -> DataFrame:
    """(key, id, other) of ``words(id, word)``; ``other`` is 1 where the key is not the word's own."""

    def run(parts):
        for part in parts:
            for rows, keys, other in _neighbourhoods(part.column(1), k, seed, probes):
                for lo in range(0, len(keys), CELLS):
                    some = slice(lo, lo + CELLS)
                    ids = part.column(0).take(pa.array(rows[some]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[some].view(np.int64)), ids, pa.array(np.full(len(ids), other, dtype=np.int8))], ["key", "id", "other"]
                    )

    return words.select("id", "word").mapInArrow(run, "key long, id long, other byte")


def near_pairs(words: DataFrame, k: int | None = None) -> DataFrame:
    """(a, b, a_word, b_word, a_n, b_n): every pair of ``words(id, word, n)`` one edit apart, once."""
    letters, n = letter_counts(words)
    if k is None:
        shortest = words.agg(F.min(F.length("word"))).first()[0] or 1
        k = min(MOST_SYMBOLS, max(4, math.ceil(words.count() ** (1 / max(shortest, 4))) + 1))
    seed = reduction(letters, n, k)
    probes, own = _keys(words, k, seed, probes=True), _keys(words, k, seed, probes=False).select("key", "id")
    later = None
    if k < MOST_SYMBOLS:
        dense = stored(own.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > DENSE).select("key"), "variants-dense")
        if not dense.isEmpty():
            reach = probes.join(dense, "key").select("id").distinct()
            later = near_pairs(stored(words.join(reach, "id"), "variants-words"), min(MOST_SYMBOLS, 4 * k))
            own = own.join(dense, "key", "left_anti")
    b = own.withColumnRenamed("id", "b")
    met = probes.select("key", F.col("id").alias("a"), "other").join(b.hint("shuffle_hash"), "key").where("other = 1 or a < b").select("a", "b")
    left, right = (words.select(*(F.col(c).alias(d) for c, d in zip(("id", "word", "n"), (x, f"{x}_word", f"{x}_n"), strict=True))) for x in "ab")
    near = met.join(left, "a").join(right, "b").where(F.levenshtein("a_word", "b_word", 1) == 1).select("a", "b", "a_word", "b_word", "a_n", "b_n")
    if later is None:
        return near
    # A pair may be found in both rounds, from either side.
    swapped = F.col("a") > F.col("b")
    pair = [F.when(swapped, F.col(f"{y}{c}")).otherwise(F.col(f"{x}{c}")).alias(f"{x}{c}") for c in ("", "_word", "_n") for x, y in ("ab", "ba")]
    return near.unionByName(later).select(*pair).dropDuplicates(["a", "b"]).select(*near.columns)


def followed(links: DataFrame) -> DataFrame:
    """(word, root) of ``links(word, form)``: the last word that following the forms reaches."""
    roots = stored(links.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(step, "root", "left_semi").isEmpty():
            return roots
        roots = stored(roots.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variants-roots")


def group_variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near and form_n of each of ``words(word, n)``.

    ``form`` is the most frequent near word (the first in code-point order among equals) if it is at least ``factor``
    times as frequent as the word, else null; ``root`` is where the forms lead, the word itself if it has none.
    """
    if factor < 2:
        raise ValueError("factor is 2 at least, else forms may lead in a circle")
    counted = words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    numbered = stored(counted.withColumn("id", F.monotonically_increasing_id()), "variants-vocabulary")
    pairs = near_pairs(numbered)
    both = F.explode(F.array(
        F.struct(F.col("a").alias("id"), (-F.col("b_n")).alias("less"), F.col("b_word").alias("word")),
        F.struct(F.col("b").alias("id"), (-F.col("a_n")).alias("less"), F.col("a_word").alias("word")),
    ))
    best = (
        pairs.select(both.alias("x")).select("x.id", F.struct("x.less", "x.word").alias("one"))
        .groupBy("id").agg(F.count("*").alias("n_near"), F.min("one").alias("one"))
        .select("id", "n_near", (-F.col("one.less")).alias("top_n"), F.col("one.word").alias("top"))
    )
    has = F.col("top_n") >= factor * F.col("n")
    formed = stored(
        numbered.join(best, "id", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("top")).alias("form"), F.when(has, F.col("top_n")).alias("form_n")),
        "variants-forms",
    )
    roots = followed(formed.where("form is not null").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
