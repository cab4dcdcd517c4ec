"""Quality classifier by co-training of a text view and a metadata view.

The text view sees which words a text has, hashed to ``GRAMS`` slots, and what they look like. The slots are sparse: how much
each speaks for a good text is the log-ratio of its smoothed shares among good and bad labelled documents (a diagonal fit,
one sum over all rows), and a text's total of these is a feature of the regression; a labelled document
is left out of its own ratios while the regression is fitted. The metadata view sees the record's fields and the
page's layout (language, source, length, lines). Each view has a logistic regression. In a round,
each view gives the documents that it is sure about, among those without a label, to the other as
pseudo-labels, and both are fitted again. Platt scaling on the labelled documents then calibrates
each view, and a last regression on both calibrated log-odds scores every document.

Every fit is Newton's method over all rows: a task adds up gradient and curvature of its rows,
a few numbers a task, and the driver solves a system as small as the number of features. No row
reaches the driver and nothing is sampled.

A label is 1 (good) or 0; documents without a label, or with a null one, are unlabelled; of several
labels of one doc_id the lowest counts. Null text counts as empty. Without labels of both classes
every score is 0.5. Repeated rows score alike; an empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strokeflow.llm.common import stored
from strokeflow.llm.shingles import slices, word_hashes

SLOTS = 16
_WORD = re.compile(r"\S+")
GRAMS = 1 << 15  # slots of the hashed words
SMOOTH = 4.0  # documents' worth of the classes' own shares in each slot
_SURFACE = 17
_CONTENT = 1
_TEXT_NAMES = _SURFACE + _CONTENT
_META_NAMES = 6 + 2 * SLOTS


def word_slots(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, offsets): text i has the distinct ``slots[offsets[i]:offsets[i + 1]]``."""
    found, sizes = [], []
    for lo, hi, data, bounds in slices(pa.array(texts, pa.string())):
        h, n = word_hashes(data, bounds)
        key = np.unique(np.repeat(np.arange(hi - lo), n) * GRAMS + (h % np.uint64(GRAMS)).astype(np.int64))
        found.append((key % GRAMS).astype(np.uint16))
        sizes.append(np.bincount(key // GRAMS, minlength=hi - lo))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
    return (np.concatenate(found) if found else np.empty(0, np.uint16)), offsets.astype(np.int64)


def packed(slots: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The ascending slots of each text as the gaps between them, a byte each; 255 goes on in the next byte."""
    gaps = np.diff(slots.astype(np.int64), prepend=0)
    first = offsets[:-1][np.diff(offsets) > 0]
    gaps[first] = slots[first]
    ends = np.cumsum(gaps // 255 + 1)
    out = np.full(ends[-1] if len(ends) else 0, 255, dtype=np.uint8)
    out[ends - 1] = gaps % 255
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.concatenate([[0], ends])[offsets]), pa.py_buffer(out)]).cast(pa.binary())


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(slots, offsets) of what :func:`packed` made."""
    raw = column.to_pylist()
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    gaps = np.frombuffer(b"".join(raw), dtype=np.uint8)
    sums = np.concatenate([[0], np.cumsum(gaps, dtype=np.int64)])
    ends = np.flatnonzero(gaps < 255)
    offsets = np.searchsorted(ends, bounds)
    return sums[ends + 1] - np.repeat(sums[bounds[:-1]], np.diff(offsets)), offsets


def content(slots: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Total weight of each text's slots over the root of their number; 0 without words."""
    n = np.diff(offsets)
    total = np.zeros(len(n))
    if len(slots):
        total[n > 0] = np.add.reduceat(weights[slots], offsets[:-1][n > 0])
    return np.clip(total / np.sqrt(np.maximum(n, 1)) / 4, -3, 3)[:, None]


def slot_weights(good: np.ndarray, bad: np.ndarray, n_good: float, n_bad: float) -> np.ndarray:
    """How much each slot speaks for a good text, from the numbers of labelled documents that have it; 0 where none has."""
    total = max(n_good + n_bad, 1.0)
    share = [(np.maximum(x, 0) + SMOOTH * max(n, 0.5) / total) / (max(n, 0.0) + SMOOTH) for x, n in ((good, n_good), (bad, n_bad))]
    none = SMOOTH * np.array([max(n, 0.5) / (max(n, 0.0) + SMOOTH) for n in (n_good, n_bad)]) / total
    return np.log(share[0] / share[1]) - np.log(none[0] / none[1])


def text_view(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """The features of the text view, one row for each text."""
    surface = np.array([text_features(t) for t in texts]).reshape(-1, _SURFACE)
    return np.hstack([surface, content(*word_slots(texts), weights)])


def text_features(text: str | None) -> np.ndarray:
    """What the words look like; shares lie between 0 and 1."""
    text = text or ""
    words = _WORD.findall(text)
    n, chars = max(len(words), 1), max(len(text), 1)
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ascii_ = raw[raw < 128]
    counts = np.bincount(ascii_, minlength=128)
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    digits, space = counts[48:58].sum(), counts[[9, 10, 11, 12, 13, 32]].sum()
    usual = counts[[44, 46]].sum()
    marks = len(ascii_) - upper - lower - digits - space - usual
    bytes_ = text.encode("utf-8", "surrogatepass")
    packed = len(zlib.compress(bytes_, 1)) / max(len(bytes_), 1)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    distinct = len(set(words)) / n
    ends = sum(not w[-1].isalnum() for w in words) / n
    share = counts[33:].astype(float) / max(counts[33:].sum(), 1)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    return np.array([
        1.0, upper / chars, digits / chars, 10 * marks / chars, 10 * usual / chars, space / chars,
        (len(raw) - len(ascii_)) / chars, min(packed, 1.5), same, distinct, ends, entropy / 6,
        min(len(text) / n, 40) / 10, counts[33] / n, counts[124] / n, (counts[35:39].sum() + counts[42]) / n,
        np.log1p(len(words)) / 5,
    ])


def meta_features(lang: str | None, source: str | None, n_chars: int | None, text: str | None) -> np.ndarray:
    """Fields of the record and layout of the page."""
    lines = (text or "").split("\n")
    lengths = np.array([len(x) for x in lines])
    size = n_chars if n_chars is not None else int(lengths.sum())
    out = np.zeros(_META_NAMES)
    out[:6] = (
        1.0, np.log1p(max(size, 0)) / 8, np.log1p(len(lines)) / 4, np.log1p(lengths.mean()) / 6,
        np.log1p(lengths.max()) / 6, len(set(lines)) / len(lines),
    )
    for at, value in ((6, lang), (6 + SLOTS, source)):
        if value is not None:
            out[at + zlib.crc32(value.encode("utf-8", "surrogatepass")) % SLOTS] = 1
    return out


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, text_view, meta_view, slots) of each row; the text view's content is still missing."""

    def run(parts):
        for part in parts:
            ids, lang, source, size, texts = (c.to_pylist() for c in part.columns)
            a = np.array([text_features(t) for t in texts]).reshape(-1, _SURFACE)
            slots, at = word_slots(texts)
            b = np.array([meta_features(*x) for x in zip(lang, source, size, texts, strict=True)]).reshape(-1, _META_NAMES)
            views = [
                pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32), v.astype(np.float32).ravel())
                for v in (a, b)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *views, packed(slots, at)], ["doc_id", "text_view", "meta_view", "slots"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"), "text",
    )
    return rows.mapInArrow(run, "doc_id long, text_view array<float>, meta_view array<float>, slots binary")


def count_slots(rows: DataFrame) -> np.ndarray:
    """(2, GRAMS + 1): bad and good labelled documents of each slot, and of all; summed in each task first."""
    width = GRAMS + 1

    def run(parts):
        sums = np.zeros(2 * width, dtype=np.int64)
        for part in parts:
            slots, offsets = unpacked(part.column(0))
            good = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            sums += np.bincount(slots + width * np.repeat(good, np.diff(offsets)), minlength=2 * width)
            sums[[GRAMS, width + GRAMS]] += np.bincount(good, minlength=2)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["place", "n"])

    known = rows.where("label is not null").select("slots", "label").mapInArrow(run, "place long, n long")
    got = known.groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(2 * width)
    out[got["place"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=float)
    return out.reshape(2, width)


def with_content(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """The rows with the content in the text view, a labelled row's own words left out, and as it is (``content``)."""
    (bad, n_bad), (good, n_good) = ((x[:-1], x[-1]) for x in counts)
    tables = [slot_weights(good, bad, n_good, n_bad), slot_weights(good, bad - 1, n_good, n_bad - 1), slot_weights(good - 1, bad, n_good - 1, n_bad)]
    shared = rows.sparkSession.sparkContext.broadcast(tables)

    def run(parts):
        for part in parts:
            ids, views, meta, slots, label = part.columns
            found = [content(*unpacked(slots), t) for t in shared.value]
            y = label.to_numpy(zero_copy_only=False).astype(float)
            own = np.where(np.isnan(y)[:, None], found[0], np.where((y == 0)[:, None], found[1], found[2]))
            a = np.hstack([np.array(views.to_pylist(), dtype=np.float32).reshape(-1, _SURFACE), own.astype(np.float32)])
            lists = [pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32), v.astype(np.float32).ravel()) for v in (a, found[0])]
            yield pa.RecordBatch.from_arrays([ids, *lists, meta, label], ["doc_id", "text_view", "content", "meta_view", "label"])

    chosen = rows.select("doc_id", "text_view", "meta_view", "slots", "label")
    return chosen.mapInArrow(run, "doc_id long, text_view array<float>, content array<float>, meta_view array<float>, label double")


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


@dataclass
class Model:
    """Weights of both views, their Platt scaling, the final weights and the confidence bounds."""

    text: np.ndarray
    meta: np.ndarray
    platt: np.ndarray  # (2, 2): offset and slope of each view
    final: np.ndarray  # offset, text, meta
    words: np.ndarray  # weight of each slot

    def views(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log-odds of both views."""
        raw = (a @ self.text, b @ self.meta)
        return tuple(p[0] + p[1] * np.clip(x, -30, 30) for p, x in zip(self.platt, raw, strict=True))

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.views(a, b)
        return _sigmoid(self.final[0] + self.final[1] * x + self.final[2] * y)


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, width))


class CoTrainer:
    """Fits a :class:`Model` on ``rows(text_view, meta_view, label)``; label is 1, 0 or null."""

    def __init__(self, rows: DataFrame, rounds: int = 2, sure: float = 0.95, steps: int = 6, ridge: float = 1e-3):
        self.rows, self.rounds, self.sure, self.steps, self.ridge = rows, rounds, sure, steps, ridge

    def _sums(self, design, sizes: list[int], weights: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """Gradient, curvature and total weight of several regressions in one pass; ``design(a, b, label)`` gives
        for each a (matrix, target, weight)."""
        total = sum(n + n * n + 1 for n in sizes)

        def run(parts):
            acc = np.zeros(total)
            for part in parts:
                if not len(part):
                    continue
                a, b = _matrix(part["text_view"], _TEXT_NAMES), _matrix(part["meta_view"], _META_NAMES)
                at = 0
                for (x, y, w), beta, n in zip(design(a, b, part["label"].to_numpy(float)), weights, sizes, strict=True):
                    p = _sigmoid(x @ beta)
                    acc[at : at + n] += x.T @ (w * (y - p))
                    acc[at + n : at + n + n * n] += ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()
                    acc[at + n + n * n] += w.sum()
                    at += n + n * n + 1
            yield pd.DataFrame({"place": np.arange(total), "value": acc})

        got = (
            self.rows.select("text_view", "meta_view", "label").mapInPandas(run, "place int, value double")
            .groupBy("place").agg(F.sum("value").alias("value")).collect()
        )
        flat = np.zeros(total)
        for r in got:
            flat[r["place"]] = r["value"]
        out, at = [], 0
        for n in sizes:
            out.append((flat[at : at + n], flat[at + n : at + n + n * n].reshape(n, n), flat[at + n + n * n]))
            at += n + n * n + 1
        return out

    def _fit(self, design, weights: list[np.ndarray], steps: int) -> list[np.ndarray]:
        sizes = [len(w) for w in weights]
        for _ in range(steps):
            moved = 0.0
            new = []
            for (g, h, total), beta in zip(self._sums(design, sizes, weights), weights, strict=True):
                # A penalty in proportion to the rows keeps the weights finite where classes separate.
                scale = self.ridge * max(total, 1.0)
                step = np.linalg.solve(h + scale * np.eye(len(beta)), g - scale * beta)
                step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
                moved = max(moved, np.abs(step).max())
                new.append(beta + step)
            weights = new
            if moved < 1e-3:
                break
        return weights

    def fit(self, prior: float, words: np.ndarray) -> Model:
        """``prior``: share of good ones among the labelled; ``words``: the weights that the text view's content was made with."""
        m = Model(np.zeros(_TEXT_NAMES), np.zeros(_META_NAMES), np.array([[0.0, 1.0], [0.0, 1.0]]), np.array([0.0, 1.0, 1.0]), words)
        sure = self.sure
        # A view must be this sure, in each class, beyond what the class's share alone gives.
        high, low = _logit(max(sure, prior + (1 - prior) * 0.8)), _logit(min(1 - sure, prior * 0.2))

        def labelled(a, b, y):
            w = (~np.isnan(y)).astype(float)
            y = np.nan_to_num(y)
            return [(a, y, w), (b, y, w)]

        def platt(m):
            def design(a, b, y):
                w = (~np.isnan(y)).astype(float)
                y = np.nan_to_num(y)
                one = np.ones(len(a))
                return [(np.column_stack([one, np.clip(x, -30, 30)]), y, w) for x in (a @ m.text, b @ m.meta)]

            return np.array(self._fit(design, list(m.platt), 3))

        def taught(m):
            def design(a, b, y):
                known = ~np.isnan(y)
                out = []
                for x, teacher in zip((a, b), reversed(m.views(a, b)), strict=True):
                    told = ~known & ((teacher >= high) | (teacher <= low))
                    out.append((x, np.where(known, np.nan_to_num(y), teacher > 0), known + 0.5 * told))
                return out

            return design

        m.text, m.meta = self._fit(labelled, [m.text, m.meta], self.steps)
        for _ in range(self.rounds):
            m.platt = platt(m)
            m.text, m.meta = self._fit(taught(m), [m.text, m.meta], 2)
        m.platt = platt(m)

        def both(a, b, y):
            w = (~np.isnan(y)).astype(float)
            x, z = m.views(a, b)
            return [(np.column_stack([np.ones(len(a)), x, z]), np.nan_to_num(y), w)]

        (m.final,) = self._fit(both, [m.final], 4)
        return m


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rounds: int = 2, words: bool = True) -> tuple[Model | None, DataFrame]:
    """The model (None without labels of both classes) and the features of each row, as a table.

    Without ``words`` the text view sees only what words look like.
    """
    known = (
        labels.where(f"{label} in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(label).cast("double").alias("label"))
    )
    seen = stored(features(docs).join(known, "doc_id", "left"), "quality-words")
    counts = count_slots(seen)
    (n_bad, n_good) = counts[:, -1]
    if not words:
        counts[:, :-1] = 0
    rows = stored(with_content(seen, counts), "quality-features")
    if not (n_bad and n_good):
        return None, rows
    return CoTrainer(rows, rounds).fit(n_good / (n_good + n_bad), slot_weights(counts[1, :-1], counts[0, :-1], n_good, n_bad)), rows


def _scores(model: Model | None, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    if model is None or not len(a):
        return pd.DataFrame({c: np.full(len(a), 0.5) for c in ("score", "text_score", "meta_score")})
    views = [np.round(_sigmoid(v), 9) for v in model.views(a, b)]
    return pd.DataFrame({"score": np.round(model.score(a, b), 9), "text_score": views[0], "meta_score": views[1]})


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", rounds: int = 2, words: bool = True) -> DataFrame:
    """doc_id, score (probability of being good), text_score, meta_score and kept of each row."""
    model, rows = fit_quality(docs, labels, label, rounds, words)

    @F.pandas_udf("score double, text_score double, meta_score double")
    def judge(a: pd.Series, c: pd.Series, b: pd.Series) -> pd.DataFrame:
        x = _matrix(a, _TEXT_NAMES)
        x[:, _SURFACE:] = _matrix(c, _CONTENT)
        return _scores(model, x, _matrix(b, _META_NAMES))

    return (
        rows.select("doc_id", judge("text_view", "content", "meta_view").alias("s")).select("doc_id", "s.*")
        .withColumn("kept", F.col("score") >= 0.5)
    )


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", rounds: int = 2, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``; they are judged where they lie, unshuffled."""
    model, _ = fit_quality(docs, labels, label, rounds)

    @F.pandas_udf("double")
    def judge(lang: pd.Series, source: pd.Series, size: pd.Series, text: pd.Series) -> pd.Series:
        size = [None if pd.isna(x) else int(x) for x in size]
        lang, source = ([None if pd.isna(x) else x for x in c] for c in (lang, source))
        text = [None if pd.isna(x) else x for x in text]
        a = text_view(text, np.zeros(GRAMS) if model is None else model.words)
        b = np.array([meta_features(*x) for x in zip(lang, source, size, text, strict=True)]).reshape(-1, _META_NAMES)
        # As float32, like the table that the model was fitted on.
        return _scores(model, a.astype(np.float32).astype(float), b.astype(np.float32).astype(float))["score"]

    fields = [F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"), F.col("text")]
    return docs.where(judge(*fields) >= least)
