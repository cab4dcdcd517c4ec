"""Language identification with hyperdimensional profiles.

Every letter has a random vector of -1 and 1, drawn from its code point. A trigram is bound by
multiplying the vectors of its letters, rotated by two, one and no places; a text bundles the
vectors of its trigrams by adding them. A language's prototype bundles all training texts of that
language. A text gets the language whose prototype has the largest cosine with it.

Letters are lower-cased; each stretch of other characters is one space, also at both ends. Null
texts and texts without letters are ``und`` with score 0. Ties go to the first language by name.
Repeated rows are judged alike, an empty table gives an empty result, and without training rows
every text is ``und``. Columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strokeflow.llm.common import stored

DIM = 1024
#: Prototypes of this many languages are compared with a text at once.
BLOCK_LANGUAGES = 2_000
_SPACE = 32
_CODE_BITS = 21


@functools.lru_cache(maxsize=50_000)
def _letter(code: int, dim: int) -> np.ndarray:
    """The vector of a code point."""
    bits = np.random.Generator(np.random.PCG64(0x5EED0000 + code)).integers(0, 2, dim, dtype=np.int8)
    return bits * 2 - 1


@functools.lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), dtype=bool)


def _trigrams(text: str | None) -> np.ndarray:
    """The trigrams of a text as packed code points; empty without letters."""
    if not text:
        return np.empty(0, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    codes = np.where(_is_letter()[codes], codes, _SPACE)
    if not (codes != _SPACE).any():
        return np.empty(0, np.int64)
    codes = np.concatenate(([_SPACE], codes, [_SPACE]))
    codes = codes[np.concatenate(([True], (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)))]
    return (codes[:-2] << 2 * _CODE_BITS) | (codes[1:-1] << _CODE_BITS) | codes[2:]


def _vectors(grams: np.ndarray, dim: int) -> np.ndarray:
    """Bound vectors of packed trigrams, as float32 rows."""
    mask = (1 << _CODE_BITS) - 1
    out = None
    for place, shift in ((2, 2 * _CODE_BITS), (1, _CODE_BITS), (0, 0)):
        codes, at = np.unique((grams >> shift) & mask, return_inverse=True)
        rows = np.stack([np.roll(_letter(int(c), dim), place) for c in codes])[at]
        out = rows if out is None else out * rows
    return out.astype(np.float32)


def bundle(texts: list[str | None], dim: int, groups: np.ndarray | None = None, n_groups: int = 0, block: int = 2048):
    """One bundled vector for each text, or for each group of texts; trigrams in blocks of bounded size."""
    rows, counts, owner = [], [], []
    for i, text in enumerate(texts):
        g, n = np.unique(_trigrams(text), return_counts=True)
        rows.append(g)
        counts.append(n)
        owner.append(np.full(len(g), i if groups is None else groups[i]))
    size = len(texts) if groups is None else n_groups
    total = np.zeros((size, dim), dtype=np.float64 if groups is not None else np.float32)
    if not rows or not (grams := np.concatenate(rows)).size:
        return total
    known, at = np.unique(grams, return_inverse=True)
    owner, counts = np.concatenate(owner), np.concatenate(counts)
    order = np.argsort(at, kind="stable")
    at, owner, counts = at[order], owner[order], counts[order]
    for start in range(0, len(known), block):
        lo, hi = np.searchsorted(at, [start, start + block])
        table = np.zeros((size, min(block, len(known) - start)), dtype=np.float32)
        np.add.at(table, (owner[lo:hi], at[lo:hi] - start), counts[lo:hi])
        total += table @ _vectors(known[start : start + block], dim)
    return total


def learn_prototypes(rows: DataFrame, dim: int = DIM) -> DataFrame:
    """(lang, v): a table of the languages' prototypes, from all of ``rows(text, lang)``.

    Each task adds up its texts by language and passes one vector for each on; Spark adds these.
    """

    def run(parts):
        sums: dict[str, np.ndarray] = {}
        for part in parts:
            for at in range(0, len(part), 512):
                some = part.iloc[at : at + 512]
                names, groups = np.unique(some["lang"].to_numpy(dtype=str), return_inverse=True)
                for name, v in zip(names, bundle(list(some["text"]), dim, groups, len(names)), strict=True):
                    sums[name] = sums.get(name, 0) + v
        for name, v in sums.items():
            yield pd.DataFrame({"lang": name, "place": np.arange(dim), "value": v})

    known = rows.where("lang is not null and text is not null").select("text", F.col("lang").cast("string").alias("lang"))
    return stored(
        known.mapInPandas(run, "lang string, place int, value double")
        .groupBy("lang", "place").agg(F.sum("value").alias("value"))
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v"))
        .select("lang", F.col("v.value").alias("v")),
        "prototypes",
    )


def blocks_of(prototypes: DataFrame, block: int = BLOCK_LANGUAGES) -> Iterator[dict[str, np.ndarray]]:
    """The prototypes in groups of about ``block`` languages; the driver holds one group at a time."""
    n = max(1, math.ceil(prototypes.count() / block))
    for i in range(n):
        some = prototypes.where(F.pmod(F.xxhash64("lang"), F.lit(n)) == i).collect()
        yield {r["lang"]: np.array(r["v"]) for r in sorted(some, key=lambda r: r["lang"])}


def predict(text: Column, prototypes: dict[str, np.ndarray]) -> Column:
    """struct(lang_pred, score) of a text column: the best of some languages and its cosine."""
    names = list(prototypes)
    dim = len(next(iter(prototypes.values()))) if names else DIM
    unit = np.stack([v / (np.linalg.norm(v) or 1) for v in prototypes.values()]) if names else np.zeros((0, dim))

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        pred, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
        for at in range(0, len(texts) if names else 0, 256):
            v = bundle(list(texts.iloc[at : at + 256]), dim).astype(np.float64)
            norm = np.linalg.norm(v, axis=1)
            some = np.flatnonzero(norm > 0)
            cosine = np.round((v[some] @ unit.T) / norm[some, None], 9)
            best = cosine.argmax(axis=1)
            pred[at + some] = np.array(names, dtype=object)[best]
            score[at + some] = cosine[np.arange(len(some)), best]
        return pd.DataFrame({"lang_pred": pred, "score": score})

    return judge(text)


def held_out(doc_id: Column) -> Column:
    """Documents kept out of training: CRC-32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, dim: int = DIM, block: int = BLOCK_LANGUAGES) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    prototypes = learn_prototypes(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"), dim)
    each = [predict(F.col("text"), some).alias(f"p{i}") for i, some in enumerate(blocks_of(prototypes, block))]
    judged = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *each)
    lang, score = F.col("p0.lang_pred"), F.col("p0.score")
    for i in range(1, len(each)):
        other, value = F.col(f"p{i}.lang_pred"), F.col(f"p{i}.score")
        better = (value > score) | ((value == score) & (other < lang))
        lang, score = F.when(better, other).otherwise(lang), F.when(better, value).otherwise(score)
    return judged.select("doc_id", "held_out", lang.alias("lang_pred"), F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)).alias("score"))
