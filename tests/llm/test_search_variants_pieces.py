"""Ranked search, spelling variants and SentencePiece encoding against brute force and the library."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strokeflow.llm import pieces, queries, ranked_search, variants

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return [] if text is None else TERM.findall(text.translate(LOWER))


def ranked_by_force(docs, items, k=20):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c) for i, c in docs if c]
    n, total, df = len(docs), sum(sum(c.values()) for _, c in docs), Counter(t for _, c in docs for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for doc, c in docs:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            scores.append((-s, doc is None, doc or 0))
        best = sorted(x for x in scores if x[0] < 0)[:k]
        out += [(item, r, None if null else doc, -s) for r, (s, null, doc) in enumerate(best, 1)]
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdeÄé") for _ in range(r.randint(1, 4))) for _ in range(60)]
    texts = [" ".join(r.choices(words, weights=range(60, 0, -1), k=r.randint(0, 30))) for _ in range(400)]
    texts += ["A-b_C 12.x", None, "", " .,; ", texts[3], texts[3].upper(), " ".join(words * 300), "x" * 5000, "7 8 9"] + [texts[5]] * 60
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[5]), (None, None)]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 12)))) for i in range(25)] + [(25, None), (26, ""), (27, "nowhere"), (28, "ab AB ab. ab"), (0, "ab"), (28, "ab AB ab. ab")]
    frame = spark.createDataFrame([(*x, "t", "s", 1) for x in docs], "doc_id long, text string, term string, score string, n int").repartition(6)
    return docs, items, frame, spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, no int")


@pytest.mark.parametrize("leaf, cells, chunk", [(32, 4 << 20, 16_384), (2, 150, 37)])
def test_ranked_search_by_force(spark, corpus, monkeypatch, leaf, cells, chunk):
    for name, value in (("LEAF", leaf), ("BLOCK_CELLS", cells), ("CHUNK_DOCS", chunk), ("CHUNK_PAIRS", 50 * chunk)):
        monkeypatch.setattr(ranked_search, name, value)
    docs, items, frame, asked = corpus
    got = ranked_search.search(frame, asked)
    assert sorted(str((x.item_id, x.rank, x.doc_id, x.score)) for x in got.collect()) == ranked_by_force(docs, [x for x in items if x[1] is not None])
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_ranked_search_of_empty_tables(spark, corpus):
    _, _, frame, asked = corpus
    for a, b in ((frame.where("false"), asked), (frame, asked.where("false")), (frame.where("text is null"), asked)):
        assert ranked_search.search(a, b).count() == 0


def test_bounds_of_the_tree_hold(monkeypatch):
    monkeypatch.setattr(ranked_search, "LEAF", 3)
    r = np.random.default_rng(1)
    size = r.integers(0, 8, 200)
    term = np.concatenate([np.sort(r.choice(12, n, replace=False)) for n in size]).astype(np.int64)
    tf, m, weights = r.integers(1, 6, size.sum()), r.integers(75, 200, 200), r.integers(0, 50, (12, 4)).astype(float)
    tree = ranked_search.DocumentTree(np.cumsum(size) - size, size, term, tf, m)

    def below(node):
        return list(tree.docs[node]) if tree.docs[node] is not None else [d for c in tree.children[node] for d in below(c)]

    assert sorted(below(tree.root)) == np.flatnonzero(size).tolist()
    first = np.cumsum(size) - size
    for node in range(len(tree.docs)):
        bound = tree._bounds([node], weights, np.arange(4))[0]
        for d in below(node):
            at = slice(first[d], first[d] + size[d])
            assert (ranked_search.part_score(tf[at], m[d]) @ weights[term[at]] <= bound).all()


def near_by_force(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_force(counts, factor=10):
    near = {w: [x for x in counts if near_by_force(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= factor * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(map(str, out))


@pytest.mark.parametrize("dense, k", [(64, None), (1, None), (2, 2)])
def test_spelling_variants_by_force(spark, monkeypatch, dense, k):
    monkeypatch.setattr(variants, "DENSE", dense)
    if k:
        plain = variants.near_pairs
        monkeypatch.setattr(variants, "near_pairs", lambda words, given=None: plain(words, given or k))
    r = random.Random(dense)
    base = ["".join(r.choice("abcé𝄞") for _ in range(r.randint(1, 9))) for _ in range(60)]
    words = dict.fromkeys([*base, "aaaaaaa", "aaaaaab", "aaaaaa", "a" * 3000, "a" * 2999 + "b", "b"], 1)
    for w in base:
        at = r.randrange(len(w))
        words |= dict.fromkeys([w[:at] + w[at + 1 :] or "z", w[:at] + "x" + w[at:], w[:at] + "b" + w[at + 1 :]], 1)
    counts = {w: r.choice([1, 2, 3, 10, 25, 100, 1000, 30_000]) for w in words}
    rows = [(w, n - 1, "id", "n") for w, n in counts.items()] + [(w, 1, "id", "n") for w in counts] + [(None, 5, "", ""), ("nothing", None, "", "")]
    got = variants.group_variants(spark.createDataFrame(rows, "word string, n long, id string, key string").repartition(4))
    assert sorted(str(tuple(x)) for x in got.select("word", "form", "root", "n", "n_near", "form_n").collect()) == variants_by_force(counts)


def test_words_of_a_corpus(spark):
    texts = ["Straßen straßen STRASSEN Straßen2 x" * 3, None, "", "ÀÉÎÕÜŸß àéîõüß÷× abcdefg_hijklmn", "longword " * 40, "longword longword"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (None, "longword nullword nullword")]
    want = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 3 == 0 else run] += 1
    frame = spark.createDataFrame([(*x, "w") for x in docs], "doc_id long, text string, word string")
    got = {x.word: x.n for x in variants.corpus_words(frame, slip_in=3).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2} and got
    assert variants.group_variants(variants.corpus_words(frame.where("false"))).count() == 0


@pytest.fixture(scope="module")
def model():
    with open(queries.tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def normalised_as(model, prefix, trim, escape, charsmap):
    """The model with other settings of its normaliser."""
    body = b"\x12" + _varint(len(charsmap)) + charsmap + bytes([3 << 3, prefix, 4 << 3, trim, 5 << 3, escape])
    return model + b"\x1a" + _varint(len(body)) + body


def encoded(model, texts):
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    return [(i.tolist(), b.tolist(), e.tolist()) for i, b, e in pieces.PieceEncoder(model).encode(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds)]


@pytest.mark.parametrize("mapped", [False, True])
@pytest.mark.parametrize("prefix, trim, escape", [(1, 0, 1), (1, 1, 1), (0, 0, 1), (0, 1, 0), (1, 1, 0)])
def test_pieces_and_spans_are_the_librarys(model, mapped, prefix, trim, escape):
    import sentencepiece

    spec = pieces.fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())[0][1]
    charsmap = dict(pieces.fields(spec))[pieces.CHARSMAP] if mapped else b""
    changed = normalised_as(model, prefix, trim, escape, charsmap)
    library, r = sentencepiece.SentencePieceProcessor(model_proto=changed), random.Random(2)
    letters = "ab  ▁éÅﬁ̊½😀\n\t　ｆ①㍿語x ́ \xad\x07ﾊﾟ"
    texts = ["", " ", "   ", "  a  b ", "▁a ▁▁b▁", "a" * 400, " " * 70 + "x", "x ▁ ▁ "] + ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(300)]
    for text, (ids, begins, ends) in zip(texts, encoded(changed, texts), strict=True):
        found = library.encode(text, out_type="offset_mapping")
        at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])])
        assert ids == library.encode(text) and list(zip(begins, ends, strict=True)) == [(at[a], at[b]) for a, b in found["offsets"]], text


def test_encoded_table(spark, model, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = [None, "", " ", "Hello\nworld", "Ünï cödé 😀", "long word " * 20_000, "x" * 20_000, "same", "same"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(7, "same", "x", 1), (None, "no id", "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    got = pieces.encode_texts(frame, queries.tokenizer_path("piece_bpe_32k.model")).collect()
    want = [(i, library.encode(t or ""), library.decode(library.encode(t or "")), len((t or "").encode())) for i, t, *_ in rows]
    assert sorted(map(str, ((x.doc_id, x.ids, x.decoded, x.span_bytes) for x in got))) == sorted(map(str, want))
    assert pieces.encode_texts(frame.where("false"), queries.tokenizer_path("piece_bpe_32k.model")).count() == 0
    bad = spark.createDataFrame([(1, b"a\xe2\x96b\xff")], "doc_id long, text binary").select("doc_id", F.expr("cast(text as string)").alias("text"))
    x = pieces.encode_texts(bad, queries.tokenizer_path("piece_bpe_32k.model")).first()
    assert x.decoded == "a��b�" and (x.begins[0], x.ends[-1]) == (0, 5)
