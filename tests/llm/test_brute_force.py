"""Registered queries and the pipeline against plain versions that know nothing of Spark."""

import hashlib
import html
import math
import random
import re
import struct
import zlib

import corpus_pipeline
import numpy as np
import pytest

from strokeflow.llm import language, licenses, quality, queries
from tests.llm.test_operators import SCHEMA, components_by_force, make, prose


def test_media_of_every_text(spark, tmp_path):
    texts = [None, "", "a", prose(1, 9), prose(2, 4000), "ß" * 32, "x" * 64, prose(1, 9)]
    make(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    want = []
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        body = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        rows = b"".join(b"\0" + body[at : at + 64] for at in range(0, len(body), 64))
        image = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, len(body) // 64, 8, 0, 0, 0, 0))
        image += chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")
        n, mean = len(body), sum(body) / len(body)
        spread = math.sqrt(sum((x - mean) ** 2 for x in body) / n)
        entropy = -sum(c / n * math.log2(c / n) for c in (body.count(x) for x in set(body)))
        step = sum(abs(a - b) for a, b in zip(body, body[1:], strict=False)) / (n - 1)
        feature = f"mean={mean:.4f};std={spread:.4f};entropy={entropy:.4f};step={step:.4f}".replace("=-0.0000", "=0.0000")
        want.append((i, len(raw), n, hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature))
    got = [tuple(r) for r in queries.op1_media_columns(spark, str(tmp_path)).collect()]
    assert sorted((*g[:7], g[7].replace("=-0.0000", "=0.0000")) for g in got) == want


def article(r):
    """(HTML, lines) of an article with blocks of several kinds."""
    out, lines = [], []
    for _ in range(r.randint(6, 12)):
        text = prose(r.random(), r.randint(15, 40))
        shown = f"{text} & <{prose(r.random(), 2)}> ü"
        kind = r.choice(["p", "p", "p", "blockquote", "h2", "li"])
        inner = html.escape(shown).replace("ü", "&uuml;").replace(" ", r.choice([" ", "  \n"]), 2)
        if r.random() < 0.3:
            inner = f"<b>{inner}</b>"
        out.append(f"<ul><li>{inner}</ul>" if kind == "li" else f"<{kind}>{inner}</{kind}>")
        lines.append(shown)
    return "".join(out), lines


def test_main_text_of_made_up_pages(spark, tmp_path):
    r, rows, want = random.Random(4), [], {}
    shells = ["<article class='a{i}'>{x}</article>", "<main><div class=body>{x}</div></main>", "<div id=c{i} class='post post-{i}'>{x}</div>"]
    junk = ["<nav><a href=/>Home</a></nav>", "<div class=sidebar><p>Side text</p></div>", "<footer>All rights</footer>", "<form><p>Your name</p></form>",
            "<script>var a = '<p>no</p>'</script>", "<div class='cookie-notice'><p>We use cookies</p></div>", "<div id=comments><p>I say so</p></div>"]
    for i in range(60):
        body, lines = article(r)
        some = r.sample(junk, 4)
        rows.append((i, f"http://h{i % 3}.example/{i}", f"<html><body>{some[0]}{some[1]}{shells[i % 3].format(i=i, x=body)}{some[2]}{some[3]}</body></html>"))
        want[i] = "\n".join(lines)
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {x.page_id: (x.text, x.n_chars) for x in queries.op2_html_text(spark, str(tmp_path)).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_languages_by_plain_loops(spark):
    r = random.Random(9)
    words = {"en": "the and with that house water", "de": "und der nicht schön wasser häuser", "fr": "le la avec maison été eau"}
    rows = [(i, " ".join(r.choice(words[k].split()) for _ in range(r.randint(1, 12))), k) for i in range(90) for k in [sorted(words)[i % 3]]]
    rows += [(90, None, "en"), (91, "12 34", "de"), (92, "Häuser, WASSER", None)]
    dim = 64

    def bundled(text):
        total = np.zeros(dim)
        letters = re.sub(r"[\W\d_]+", " ", f" {(text or '').lower()} ")
        for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
            total += np.roll(language._letter(ord(a), dim), 2) * np.roll(language._letter(ord(b), dim), 1) * language._letter(ord(c), dim)
        return total if letters.strip() else np.zeros(dim)

    out = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    prototypes = {k: sum((bundled(t) for i, t, lang in rows if lang == k and not out[i]), np.zeros(dim)) for k in words}
    got = {x.doc_id: x for x in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dim).collect()}
    for i, text, _ in rows:
        v = bundled(text)
        cosine = {k: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for k, p in prototypes.items()} if v.any() else {"und": 0.0}
        best = max(sorted(cosine), key=lambda k: round(cosine[k], 9))
        assert (got[i].held_out, got[i].lang_pred) == (out[i], best) and got[i].score == pytest.approx(max(0.0, cosine[best]), abs=1e-6)


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def test_licenses_by_comparing_everything(spark):
    r, texts = random.Random(12), []
    for name in licenses.TEMPLATES:
        notice = licenses.TEMPLATES[name].split()
        for changes in (0, 1, len(notice) // 6, len(notice) // 3, len(notice) // 2):
            words = list(notice)
            for at in r.sample(range(len(words)), min(changes, len(words))):
                words[at] = prose(r.random(), 1)
            texts.append(f"{prose(r.random(), r.randint(0, 20))} {' '.join(words)} {prose(r.random(), r.randint(0, 20))}")
    split = {name: re.findall("[a-z0-9]+", text.lower()) for name, text in licenses.TEMPLATES.items()}
    want = set()
    for i, text in enumerate(texts):
        words = re.findall("[a-z0-9]+", text.lower())
        for name, t in split.items():
            best = max(common(t, words[at : at + len(t)]) for at in range(len(words)))
            if best >= 0.8 * len(t):
                want.add((i, name))
    assert {(x.doc_id, x.license) for x in licenses.scan_licenses(make(spark, texts)).collect()} == want


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def without_repeats(docs):
    """Texts of ``docs`` (id to text) after line deduplication."""
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in docs.items():
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    gone = lambda i, x: len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != i
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in docs.items()}


def contaminated(text, items):
    words = re.findall(WORD, low(text))
    hit = set()
    for item in items:
        w = re.findall(WORD, low(item))
        for at in range(max(1, len(w) - 12) if w else 0):
            window = w[at : at + 13]
            for start in range(len(words) - len(window) + 1):
                if words[start : start + len(window)] == window:
                    hit.update(range(start, start + len(window)))
    return bool(hit) and 20 * len(hit) >= len(words)


def mixed(docs):
    """(id, text, copy, key) rows of ``docs`` (id to (source, text)) at the target weights."""
    sizes = {}
    for source, _ in docs.values():
        sizes[source] = sizes.get(source, 0) + 1
    weight = {s: queries.WEIGHTS.get(s, queries.OTHER_WEIGHT) for s in sizes}
    out = set()
    for i, (source, text) in docs.items():
        rate = weight[source] * (len(docs) / sum(weight.values())) / sizes[source]
        parts = max(1, math.ceil(rate / 16))
        mean = rate / parts
        for part in range(1, parts + 1):
            u = int(hashlib.md5(f"{queries.MIX_SEED}:{i}:{part}".encode()).hexdigest()[:13], 16) / 2**52
            k, p, c = 0, math.exp(-mean), math.exp(-mean)
            while c < u and k < 96:
                k += 1
                p *= mean / k
                c += p
            for n in range(1, k + 1):
                out.add((i, text, n + (part - 1) * 96, hashlib.md5(f"{queries.MIX_SEED}/order:{i}:{part}:{n}".encode()).hexdigest()))
    return out


def test_pipeline_by_plain_loops(spark, tmp_path):
    r = random.Random(21)
    items, line, passage = [prose(1, 30), prose(2, 9), "two words"], prose(3, 8), prose(4, 55)
    texts = [f"{prose(100 + i, r.randint(20, 90)).capitalize()}.\n{prose(700 + i, 30)}" for i in range(90)]
    texts += [" ".join(w.upper() + "!!" for w in prose(900 + i, 60).split()) for i in range(40)]
    for i in range(0, 30, 3):
        texts[i] += "\n" + line
    for i in range(1, 30, 7):
        texts[i] += "\n" + passage
    for i in range(2, 30, 5):
        texts[i] = f"{texts[i]} {items[i % 3]}"
    for i in range(40, 70, 4):  # near copies on both sides of the threshold
        words = texts[40].split(" ")
        for _ in range(i - 40):
            words[r.randrange(len(words))] = prose(r.random(), 1)
        texts[i] = " ".join(words)
    texts += [texts[8], texts[9].upper(), None, "", "   "]
    rows = [(i, t, "en", ("src0", "src1", "elsewhere", None)[i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(not 90 <= i < 130), 0) for i in range(0, len(texts), 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    got = {(x.doc_id, x.text, x.copy, x.mix_key) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    # A classifier has no plain version; what it says is taken from its operator.
    judged = quality.score_documents(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = without_repeats({x.doc_id: texts[x.doc_id] for x in judged.where("kept").collect()})
    ids = sorted(left)
    component = dict(zip(ids, components_by_force([left[i] for i in ids]), strict=True))
    left = {i: left[i] for n, i in enumerate(ids) if component[i] == n}
    left = {i: t for i, t in left.items() if not contaminated(t, items)}
    assert 40 < len(left) < len(ids) < len(texts)
    assert got == mixed({i: (rows[i][3], t) for i, t in left.items()})
