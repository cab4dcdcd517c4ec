"""Ranked lexical search by document FP-trees.

1. Each document is restricted to the terms that the items use: a vector of (term, tf), beside its
   number of terms n. These vectors are stored once; N, L and the df of the terms are sums over them.
2. Every task orders the vectors' terms by falling df and puts them into a tree, a chunk of documents at a
   time: documents that begin with the same terms share a path. A node knows the largest tf of each term
   and the smallest m below it, so the score of anything below is bounded: scores rise with tf and fall with m.
3. For each item the tree is searched depth first, and a node goes once its bound is below the score
   of the item's worst document so far. The items still open at a node are carried together. What is
   left at a leaf is scored exactly.
4. The best documents of each task meet by item, salted first.

An item's score of a document is the sum over the item's terms, repeats included, of
``w * ((1000000000 * tf) div (1000 * tf + 12 * m))`` with
``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` and ``m = 100 - 25 + (25 * n * N) div L``.

Items are searched for in blocks, so that what reaches every executor stays below ``BLOCK_CELLS``
numbers. Terms are runs of ASCII digits, ASCII letters (A-Z in lower case) and all characters
beyond ASCII; they go by 64-bit hashes. Null texts have no terms: such a document has no rank and
such an item no rows. Rows of items that repeat id and text are one item; repeated rows of documents are
ranked each, a null doc_id behind equal scores. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strokeflow.llm.common import bounded_broadcast, stored
from strokeflow.llm.shingles import as_binary, slices, word_hashes

#: Terms times items of a block: its weights take eight bytes for each.
BLOCK_CELLS = 4 << 20
#: A chunk of documents that becomes one tree ends beyond so many documents or (term, tf) pairs.
CHUNK_DOCS, CHUNK_PAIRS = 16_384, 2 << 20
#: A node of up to so many documents is not divided further.
LEAF = 32
SALTS = 16

_BETWEEN = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def _counts(data: np.ndarray, bounds: np.ndarray, wanted: np.ndarray | None):
    """(terms of each row, row, term, tf) of a slice; only terms of the sorted hashes ``wanted``, by their place there."""
    h, n = word_hashes(data, bounds, _BETWEEN)
    row = np.repeat(np.arange(len(n)), n)
    if wanted is None:
        wanted, place = np.unique(h, return_inverse=True)
    else:
        place = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1) if len(wanted) else np.zeros(len(h), dtype=np.int64)
        known = wanted[place] == h if len(wanted) else np.zeros(len(h), dtype=bool)
        row, place = row[known], place[known]
    key, tf = np.unique(row * max(len(wanted), 1) + place, return_counts=True)
    row, place = np.divmod(key, max(len(wanted), 1))
    return n, row, wanted, place, tf


def item_terms(items: DataFrame) -> DataFrame:
    """(no, term, times) of ``items(no, text)``; a term is its hash."""

    def run(parts):
        for part in parts:
            for lo, _, data, bounds in slices(part.column(1)):
                _, row, hashes, place, times = _counts(data, bounds, None)
                no = part.column(0).take(pa.array(row + lo))
                yield pa.RecordBatch.from_arrays([no, pa.array(hashes[place].view(np.int64)), pa.array(times)], ["no", "term", "times"])

    return items.select("no", "text").mapInArrow(run, "no long, term long, times long")


def restricted(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs) of each row: places in the sorted ``terms`` and occurrences, as packed numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(parts):
        for part in parts:
            for lo, hi, data, bounds in slices(part.column(1)):
                n, row, _, place, tf = _counts(data, bounds, shared.value)
                at = np.searchsorted(row, np.arange(len(n) + 1))
                pairs = [as_binary(x.astype(np.int64), at).cast(pa.binary()) for x in (place, tf)]
                yield pa.RecordBatch.from_arrays([part.column(0)[lo:hi], pa.array(n, pa.int64()), *pairs], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def document_frequencies(vectors: DataFrame, terms: int) -> np.ndarray:
    """Documents of each term, summed in each task first."""

    def run(parts):
        sums = np.zeros(terms, dtype=np.int64)
        for part in parts:
            sums += np.bincount(np.frombuffer(b"".join(part.column(0).to_pylist()), dtype=np.int64), minlength=terms)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["term", "df"])

    rows = vectors.where("length(terms) > 0").select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(terms, dtype=np.int64)
    df[rows["term"].to_numpy()] = rows["df"].to_numpy()
    return df


def part_score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds; it rises with tf and falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class DocumentTree:
    """The tree of one chunk. Documents are rows of (first pair, pairs), terms by their rank in falling df."""

    def __init__(self, first: np.ndarray, size: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray):
        self.first, self.size, self.term, self.tf, self.m = first, size, term, tf, m
        self.children: list[list[int]] = []
        self.docs: list[np.ndarray | None] = []
        self.most: list[tuple[np.ndarray, np.ndarray]] = []
        self.least: list[int] = []
        self.root = self._grow(np.flatnonzero(size > 0)) if (size > 0).any() else None

    def _node(self) -> int:
        self.children.append([])
        self.docs.append(None)
        self.most.append((np.empty(0, np.int64), np.empty(0, np.int64)))
        self.least.append(0)
        return len(self.docs) - 1

    def _grow(self, docs: np.ndarray) -> int:
        root = self._node()
        open_ = [(root, docs, 0)]
        while open_:
            node, docs, depth = open_.pop()
            groups = [docs] if len(docs) <= LEAF else None
            while groups is None:  # down to the next place where paths part
                more = self.size[docs] > depth
                here = np.where(more, self.term[np.minimum(self.first[docs] + depth, len(self.term) - 1)], -1)
                if here[0] >= 0 and (here == here[0]).all():
                    depth += 1
                    continue
                order = np.argsort(here, kind="stable")
                docs, here = docs[order], here[order]
                cuts = np.flatnonzero(np.diff(here)) + 1
                groups = np.split(docs, cuts)
                ended = here[0] < 0
            if len(groups) == 1 and len(docs) <= LEAF:
                self.docs[node] = docs
                continue
            depth += 1
            small: list[np.ndarray] = []
            if ended:  # these have one set of terms: nothing parts them
                own = groups.pop(0)
                small.extend(own[i : i + LEAF] for i in range(0, len(own), LEAF))
            for group in groups:
                if len(group) > LEAF:
                    child = self._node()
                    self.children[node].append(child)
                    open_.append((child, group, depth))
                else:
                    small.append(group)
            held: list[np.ndarray] = []
            for group in [*small, None]:  # neighbours share a leaf
                if group is None or sum(map(len, held)) + len(group) > LEAF:
                    if held:
                        child = self._node()
                        self.children[node].append(child)
                        self.docs[child] = np.concatenate(held)
                    held = []
                held.append(group)
        for node in range(len(self.docs) - 1, -1, -1):  # children have higher numbers
            if self.docs[node] is not None:
                docs = self.docs[node]
                at = self._pairs(docs)
                term, tf, self.least[node] = self.term[at], self.tf[at], int(self.m[docs].min())
            else:
                below = self.children[node]
                term, tf = (np.concatenate([self.most[c][i] for c in below]) for i in (0, 1))
                self.least[node] = min(self.least[c] for c in below)
            order = np.argsort(term, kind="stable")
            term, tf = term[order], tf[order]
            begins = np.flatnonzero(np.diff(term, prepend=-1))
            self.most[node] = (term[begins], np.maximum.reduceat(tf, begins))
        return root

    def _pairs(self, docs: np.ndarray) -> np.ndarray:
        size = self.size[docs]
        ends = np.cumsum(size)
        return np.arange(ends[-1]) - np.repeat(ends - size - self.first[docs], size)

    def search(self, weights: np.ndarray, best: Best) -> None:
        """Puts every document of the tree that may be among an item's best into ``best``.

        ``weights`` has a row for each term and a column for each item.
        """
        if self.root is None:
            return
        every = np.arange(weights.shape[1])
        open_ = [(self.root, every, self._bounds([self.root], weights, every)[0])]
        while open_:
            node, items, bound = open_.pop()
            left = bound >= best.floor[items]  # the floors have risen since the node was put there
            items = items[left]
            if not len(items):
                continue
            if self.docs[node] is not None:
                self._score(self.docs[node], weights, items, best)
                continue
            children = self.children[node]
            bounds = self._bounds(children, weights, items)
            # The most promising child is taken from the stack first.
            open_.extend((children[i], items, bounds[i]) for i in np.argsort(bounds.max(axis=1), kind="stable"))

    def _bounds(self, nodes: list[int], weights: np.ndarray, items: np.ndarray) -> np.ndarray:
        """(nodes, items): no document below a node has a higher score."""
        at_once = max(1, BLOCK_CELLS // len(weights))
        if len(nodes) > at_once:
            return np.concatenate([self._bounds(nodes[i : i + at_once], weights, items) for i in range(0, len(nodes), at_once)])
        added = np.zeros((len(nodes), len(weights)), dtype=weights.dtype)
        for i, node in enumerate(nodes):
            term, tf = self.most[node]
            added[i, term] = part_score(tf, np.int64(self.least[node]))
        if len(items) * 4 > weights.shape[1]:
            return (added @ weights)[:, items]
        return added @ weights[:, items]

    def _score(self, docs: np.ndarray, weights: np.ndarray, items: np.ndarray, best: Best) -> None:
        at = self._pairs(docs)
        leaf = np.unique(self.term[at])
        row = np.repeat(np.arange(len(docs)), self.size[docs])
        added = np.zeros((len(docs), len(leaf)), dtype=weights.dtype)
        added[row, np.searchsorted(leaf, self.term[at])] = part_score(self.tf[at], self.m[docs][row])
        best.take(docs, items, added @ weights[np.ix_(leaf, items)])


class Best:
    """The k best documents of each item so far; ``floor`` is the score that one must reach."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.floor = np.ones(items)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, bool), np.empty(0, np.int64))] * items
        self.ids = self.null = np.empty(0, np.int64)

    def chunk(self, ids: np.ndarray, null: np.ndarray) -> None:
        self.ids, self.null = ids, null

    def take(self, docs: np.ndarray, items: np.ndarray, scores: np.ndarray) -> None:
        reach = scores >= self.floor[items]
        for j in np.flatnonzero(reach.any(axis=0)):
            item, chosen = items[j], np.flatnonzero(reach[:, j])
            score, null, ids = (np.concatenate(x) for x in zip(self.rows[item], (scores[chosen, j], self.null[docs[chosen]], self.ids[docs[chosen]]), strict=True))
            order = np.lexsort((ids, null, -score))[: self.k]
            self.rows[item] = (score[order], null[order], ids[order])
            if len(order) == self.k:
                self.floor[item] = score[order[-1]]


def search_block(vectors: DataFrame, entries, stats: tuple[int, int], k: int) -> DataFrame:
    """(no, doc_id, score): each task's best documents for the items of ``entries(no, term, times)``.

    ``vectors`` are restricted to the sorted distinct terms of the entries; ``stats`` are N and L.
    """
    spark, (n_docs, n_terms) = vectors.sparkSession, stats
    terms, place = np.unique(entries["term"].to_numpy().view(np.uint64), return_inverse=True)
    numbers, column = np.unique(entries["no"].to_numpy(), return_inverse=True)
    df = document_frequencies(vectors, len(terms))
    w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
    rank = np.empty(len(terms), dtype=np.int64)
    rank[np.lexsort((np.arange(len(terms)), -df))] = np.arange(len(terms))
    times = entries["times"].to_numpy()
    # Doubles hold whole numbers up to 2 ** 53, whatever the order of the sum.
    exact = np.bincount(column, weights=(w[place] * times).astype(float)).max() * 1e6 < 2**53
    weights = np.zeros((len(terms), len(numbers)), dtype=np.float64 if exact else np.int64)
    weights[rank[place], column] = w[place] * times
    shared = spark.sparkContext.broadcast((rank, weights, numbers))

    def run(parts):
        rank, weights, numbers = shared.value
        best = Best(len(numbers), k)
        for chunk in _chunks(parts):
            ids, n, terms, tfs = (chunk.column(i) for i in range(4))
            size = np.array([len(x) // 8 for x in terms.to_pylist()], dtype=np.int64)
            term, tf = (np.frombuffer(b"".join(x.to_pylist()), dtype=np.int64) for x in (terms, tfs))
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((rank[term], row))
            m = np.array([75 + 25 * x * n_docs // n_terms for x in n.to_pylist()], dtype=np.int64)
            best.chunk(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False))
            DocumentTree(np.cumsum(size) - size, size, rank[term][order], tf[order], m).search(weights, best)
        for no, (score, null, ids) in zip(numbers.tolist(), best.rows, strict=True):
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(score), no)), pa.array(ids, mask=null), pa.array(score.astype(np.int64))], ["no", "doc_id", "score"]
                )

    return vectors.where("length(terms) > 0").select("doc_id", "n", "terms", "tfs").mapInArrow(run, "no long, doc_id long, score long")


def _chunks(parts):
    """The batches of a task, put together or cut into chunks of bounded size."""
    held, docs, pairs = [], 0, 0
    for part in parts:
        at = 0
        sizes = np.cumsum([len(x) // 8 for x in part.column(2).to_pylist()])
        while at < part.num_rows:
            before = sizes[at - 1] if at else 0
            end = min(at + CHUNK_DOCS - docs, int(np.searchsorted(sizes, before + CHUNK_PAIRS - pairs, "right")), part.num_rows)
            end = max(end, at + (not held))
            if end > at:
                held.append(part.slice(at, end - at))
                docs, pairs, at = docs + end - at, pairs + int(sizes[end - 1] - before), end
            if at < part.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, docs, pairs = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents above 0 of each item."""
    spark = docs.sparkSession
    # A number stands for an item; it holds once it is written.
    numbered = items.select("item_id", "text").where("text is not null").distinct().withColumn("no", F.monotonically_increasing_id())
    numbered = stored(numbered, "search-items")
    entries = stored(item_terms(numbered), "search-item-terms")
    total, n_items = entries.agg(F.count("*"), F.countDistinct("no")).first()
    blocks = max(1, math.ceil(math.sqrt(total * n_items / BLOCK_CELLS)))
    stats, found = None, []
    for block in range(blocks):
        some = entries.where(F.pmod(F.xxhash64("no"), F.lit(blocks)) == block).toPandas()
        if not len(some):
            continue
        terms = np.unique(some["term"].to_numpy().view(np.uint64))
        vectors = stored(restricted(docs, terms), "search-vectors")
        if stats is None:
            stats = tuple(int(x or 0) for x in vectors.where("n > 0").agg(F.count("*"), F.sum("n")).first())
        if stats[0]:
            found.append(search_block(vectors, some, stats, k))
    if not found:
        kind = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    best_first = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = functools.reduce(DataFrame.unionAll, found).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(W.partitionBy("no", "salt").orderBy(*best_first))).where(F.col("rank") <= k)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("no").orderBy(*best_first))).where(F.col("rank") <= k)
    names = bounded_broadcast(numbered.select("no", "item_id"), 200_000)
    return ranked.join(names, "no").select("item_id", "rank", "doc_id", "score")
