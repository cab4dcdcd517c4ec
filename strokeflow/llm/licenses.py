"""License scans: winnowed fingerprints pick candidates, banded alignment confirms them.

1. Each document's word k-grams are hashed and winnowed over its whole text. Only fingerprints that
   the inverted index of the templates holds go on, with the words around them: a region. Winnowing
   is sure to keep a shared run of K + WINDOW - 1 words. For templates whose matches may share less
   (short ones, or those that changed words cut into short runs) every k-gram of the document is
   looked up, and k is as small as the longest run that a match with changed words must share.
2. Spark joins the fingerprints with the index; regions and templates that share one are candidates.
3. The template's words are aligned with the region's in a band around the diagonals of the shared
   fingerprints. Matched share of the template (coverage) and spans in words and characters come
   from the alignment.

Words are runs of ASCII letters and digits in lower case. Null texts have no words and no matches;
a template may match a document several times;
words put in between the template's are allowed as long as one such run stays whole; repeated rows are reported once for each row's
doc_id and text; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokeflow.llm.common import bounded_broadcast, stored
from strokeflow.llm.shingles import slices, word_hashes

K, WINDOW = 3, 2
#: Diagonals further apart than this belong to different occurrences; nearer ones may as well.
BAND = 16
#: Templates of about this many words are looked for at once; their index is sent to every executor.
BLOCK_WORDS = 500_000

#: Notices by which works commonly name their licence.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "All-rights-reserved": "All rights reserved.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the"
        " rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met"
    ),
    "ISC-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "Apache-2.0-notice": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        " \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation"
    ),
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

_WORD = re.compile(r"[A-Za-z0-9]+")


_OTHER = np.array([not (c < 128 and chr(c).isalnum()) for c in range(256)])  # bytes that are in no word


def words_of(text: str) -> np.ndarray:
    """Hashes of a text's words."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return word_hashes(data, np.array([0, len(data)]), _OTHER)[0]


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    grams = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(k if n > 0 else 0):
        grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return grams


def winnow(h: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) for the words' hashes: the smallest k-gram hash of every window, the rightmost of equal ones."""
    n = len(h) - k + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grams = _grams(h, k)
    if window == 1:
        return grams.view(np.int64), np.arange(n)
    width = min(window, n)
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    at = np.unique(np.arange(len(view)) + width - 1 - view[:, ::-1].argmin(axis=1))
    return grams[at].view(np.int64), at


def needed(size: int, least: float) -> int:
    """Words of a template of ``size`` words that a match must have."""
    return next(m for m in range(1, size + 2) if m >= least * size)


def lookup(size: int, least: float) -> tuple[int, int]:
    """(k, window) that find every match of a template of ``size`` words in which words are changed."""
    must = min(needed(size, least), size)
    run = -(-must // (size - must + 1))
    return (K, WINDOW) if run >= K + WINDOW - 1 else (min(K, run), 1)


def template_index(spark: SparkSession, templates: dict[str, str], least: float = 0.8) -> DataFrame:
    """Inverted index (hash, template, tpos, k, window) of the templates' winnowed fingerprints."""
    rows = []
    for name, text in templates.items():
        h = words_of(text)
        if not len(h):
            continue
        k, window = lookup(len(h), least)
        hashes, places = winnow(h, k, window)
        rows += [(int(h), name, int(at), k, window) for h, at in zip(hashes, places, strict=True)]
    return spark.createDataFrame(rows, "hash long, template string, tpos int, k int, window int")


def regions(docs: DataFrame, index: DataFrame, reach: int) -> DataFrame:
    """Stretches of documents around fingerprints that the index holds."""
    kinds: dict[tuple[int, int], set[int]] = {}
    for r in index.select("k", "window", "hash").distinct().collect():
        kinds.setdefault((r["k"], r["window"]), set()).add(r["hash"])
    known = docs.sparkSession.sparkContext.broadcast({kind: np.array(sorted(h), dtype=np.int64) for kind, h in kinds.items()})

    def maybe(h: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Numbers of the rows that may have hits: all with a k-gram of the index, and some in which two rows meet."""
        row = np.repeat(np.arange(len(words)), words)
        found = [np.empty(0, np.int64)]
        for (k, _), wanted in known.value.items():
            grams = _grams(h, k).view(np.int64)
            at = np.minimum(np.searchsorted(wanted, grams), len(wanted) - 1)
            found.append(row[: len(grams)][wanted[at] == grams])
        return np.unique(np.concatenate(found))

    def hits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = []
        for (k, window), wanted in known.value.items():
            grams, at = winnow(h, k, window)
            there = np.isin(grams, wanted)
            some.append(np.stack([at[there], grams[there]]))
        both = np.unique(np.concatenate(some, axis=1), axis=1) if some else np.empty((2, 0), np.int64)
        return both[1], both[0]

    def run(parts):
        for part in parts:
            yield batch(list(regions_of(part)))

    def regions_of(part):
        for first, _, data, bounds in slices(part.column(1)):
            codes, counts = word_hashes(data, bounds, _OTHER)
            ends = np.cumsum(counts)
            for i in maybe(codes, counts).tolist():
                h, at = hits(codes[ends[i] - counts[i] : ends[i]])
                if not len(at):
                    continue
                doc, text = part.column(0)[first + i].as_py(), part.column(1)[first + i].as_py()
                found = list(_WORD.finditer(text))
                words = [m.group().lower() for m in found]
                for group in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > reach) + 1):
                    lo = max(0, int(at[group[0]]) - reach)
                    hi = min(len(words), int(at[group[-1]]) + K + reach)
                    yield (
                        doc, xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1, lo, words[lo:hi],
                        [m.start() for m in found[lo:hi]], [m.end() for m in found[lo:hi]], h[group].tolist(), at[group].tolist(),
                    )

    def batch(out):
        columns = zip(*out, strict=True) if out else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))

    ints, types = pa.list_(pa.int32()), {"doc_id": pa.int64(), "th": pa.int64(), "lo": pa.int32(), "words": pa.list_(pa.string())}
    types |= {"starts": ints, "ends": ints, "hashes": pa.list_(pa.int64()), "places": ints}
    schema = (
        "doc_id long, th long, lo int, words array<string>, starts array<int>, ends array<int>, hashes array<long>, places array<int>"
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.where("text is not null").mapInArrow(run, schema).dropDuplicates(["doc_id", "th", "lo"])


def align(template: list[str], words: list[str], low: int, high: int) -> tuple[int, int, int]:
    """Longest common subsequence within diagonals ``low`` to ``high`` (word minus template place).

    Returns matched words and the first and last matched place in ``words``; the tightest such span.
    """
    empty = (0, -1, -1)
    before: dict[int, tuple] = {}
    best = empty
    # In a cell the later start leads to the tighter span, wherever the alignment ends.
    for i, t in enumerate(template):
        row: dict[int, tuple] = {}
        left = empty
        for j in range(max(0, i + low), min(len(words), i + high + 1)):
            cell = max(before.get(j, empty), left)
            if words[j] == t:
                diagonal = before.get(j - 1, empty)
                here = (diagonal[0] + 1, diagonal[1] if diagonal[0] else j, j)
                if (here[0], here[1] - j) > (best[0], best[1] - best[2]):
                    best = here
                cell = max(cell, here)
            row[j] = left = cell
        before = row
    return best


def occurrences(template: list[str], words: list[str], low: int, high: int, need: int) -> list[tuple[int, int, int]]:
    """All disjoint alignments with at least ``need`` matched words: the best one, then left and right of it.

    Beside the best one, words are read in pieces that any alignment of up to half their length lies in
    as a whole, so the work grows with the number of words and not with its square.
    """
    out = []
    half = 2 * len(template) + BAND
    start, end = max(0, low), min(len(words), high + len(template))
    best = align(template, words, low, high)
    if best[0] < need:
        return out
    out.append(best)
    todo = [(start, best[1]), (best[2] + 1, end)]
    while todo:
        a, b = todo.pop()
        if b - a < need:
            continue
        c = min(b, a + 2 * half)
        n, first, last = align(template, words[a:c], low - a, high - a)
        if n < need:
            if c < b:
                todo.append((a + half, b))
        elif c < b and first >= half:  # the piece may end before the alignment does
            todo += [(a, a + first), (a + first, b)]
        else:
            out.append((n, a + first, a + last))
            todo += [(a, a + first), (a + last + 1, b)]
    return sorted(out, key=lambda m: m[1])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, block: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, license, coverage, matched, and the span in words and characters, of each match.

    Templates are looked for in blocks of bounded size, so there can be any number of them.
    """
    templates = TEMPLATES if templates is None else templates
    some: list[dict[str, str]] = [{}]
    size = 0
    for name, text in templates.items():
        n = len(_WORD.findall(text))
        if size and size + n > block:
            some.append({})
            size = 0
        some[-1][name] = text
        size += n
    return functools.reduce(DataFrame.unionAll, [_scan(docs, x, least) for x in some])


def _scan(docs: DataFrame, templates: dict[str, str], least: float) -> DataFrame:
    spark = docs.sparkSession
    split = {name: [w.lower() for w in _WORD.findall(text)] for name, text in templates.items()}
    index = template_index(spark, templates, least)
    reach = max([len(w) for w in split.values()], default=1) + BAND
    found = stored(regions(docs, index, reach), "license-regions")
    key = ["doc_id", "th", "lo"]
    hits = found.select(*key, F.explode(F.arrays_zip("hashes", "places")).alias("x"))
    candidates = (
        hits.join(bounded_broadcast(index, 2 * BLOCK_WORDS), hits["x.hashes"] == index["hash"])
        .groupBy(*key, "template").agg(F.array_sort(F.collect_set(F.col("x.places") - F.col("tpos"))).alias("diagonals"))
    )

    @F.pandas_udf("array<struct<matched:int,first:int,last:int>>")
    def aligned(template: pd.Series, words: pd.Series, lo: pd.Series, diagonals: pd.Series) -> pd.Series:
        out = []
        for name, w, start, d in zip(template, words, lo, diagonals, strict=True):
            d, w = np.asarray(d) - start, list(w)
            some = []
            for group in np.split(d, np.flatnonzero(np.diff(d) > BAND) + 1):
                low, high = int(group[0]) - BAND // 2, int(group[-1]) + BAND // 2
                for m in occurrences(split[name], w, low, high, needed(len(split[name]), least)):
                    some.append({"matched": m[0], "first": m[1], "last": m[2]})
            out.append(some)
        return pd.Series(out)

    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    joined = candidates.alias("c").join(found.alias("r"), same[0] & same[1] & same[2])
    sizes = F.create_map(*[F.lit(x) for name, w in split.items() for x in (name, len(w))]) if split else F.create_map(F.lit(""), F.lit(1))
    return (
        joined.select("c.doc_id", "r.lo", "r.starts", "r.ends", "template", aligned("template", "r.words", "r.lo", "diagonals").alias("m"))
        .select("doc_id", "lo", "starts", "ends", "template", F.explode("m").alias("m"))
        .select(
            "doc_id", F.col("template").alias("license"),
            F.round(F.col("m.matched") / sizes[F.col("template")], 6).alias("coverage"), F.col("m.matched").alias("matched"),
            (F.col("lo") + F.col("m.first")).alias("first_word"), (F.col("lo") + F.col("m.last")).alias("last_word"),
            F.get("starts", F.col("m.first")).alias("first_char"), F.get("ends", F.col("m.last")).alias("end_char"),
        )
    )
