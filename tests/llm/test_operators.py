"""The training-data operators against brute force, and on awkward input."""

import hashlib
import os
import random
import re
import time
import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from strokeflow.llm import common, html_text, language, licenses, line_dedup, media, mixing, near_dedup, quality, queries, url_filter
from strokeflow.llm.components import connected_components
from strokeflow.llm.decontaminate import PositionalIndex, decontaminate

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, extra=False):
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for c in ("n", "node", "keys", "score", "rate", "copy", "host", "term", "h1", "at", "items", "doc", "th", "kept", "label"):
            df = df.withColumn(c, F.lit("x"))
    return df


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeinrst") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    long = prose(1, 30_000)
    df = make(spark, [None, "", "   \n\t", "one", "one two three four five six", long, long, "Ünïcode ÄÖ " * 40, "same\nsame\nsame"], extra=True)
    null_id = df.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long"))
    return df.unionByName(df.where("doc_id in (4, 5)")).unionByName(null_id)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components_by_force(texts, percent=85):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(5)
    texts = [prose(i, r.randint(1, 120)) for i in range(25)]
    shared = prose(99, 60)
    for i in range(12):  # documents that share a long passage without being alike
        texts.append(f"{prose(200 + i, 50)} {shared}")
    base = prose(7, 150).split()
    for _ in range(60):  # near copies on both sides of the threshold
        copy = list(base)
        for _ in range(r.randint(1, 6)):
            copy[r.randrange(len(copy))] = prose(r.random(), 1)
        texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper(), None, ""]
    got = {x.doc_id: x for x in near_dedup.near_duplicates(make(spark, texts)).collect()}
    assert [got[i].component_id for i in range(len(texts))] == components_by_force(texts)
    assert [got[i].n_shingles for i in range(len(texts))] == [len(shingles(t)) for t in texts]


def test_near_duplicates_on_awkward_rows(spark, awkward):
    got = near_dedup.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    by = {x.doc_id: x for x in got}
    assert by[6].component_id == 5 and not by[6].kept and by[5].kept
    assert by[0].component_id == 0 and by[1].component_id == 1 and by[1].n_shingles == 0
    assert by[None].component_id is None and by[None].kept
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    kept = near_dedup.keep_one_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in kept.collect()) == [*[(False, i) for i in (0, 1, 2, 3, 4, 5, 7, 8)], (True, 0)]


def test_near_duplicates_at_another_threshold(spark):
    r = random.Random(6)
    base, texts = prose(8, 100).split(), []
    for _ in range(80):
        copy = list(base)
        for _ in range(r.randint(1, 12)):
            copy[r.randrange(len(copy))] = prose(r.random(), 1)
        texts.append(" ".join(copy))
    for percent in (60, 95):
        got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(make(spark, texts), percent=percent).collect()}
        assert [got[i] for i in range(len(texts))] == components_by_force(texts, percent)
    with pytest.raises(ValueError, match="percent"):
        near_dedup.near_duplicates(make(spark, texts), percent=20)


@pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="needs the test data")
def test_near_duplicates_recall_over_a_table(spark):
    """Every document whose id is divisible by 50, compared with all rows by force."""
    docs = spark.read.parquet(DOCUMENTS)
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(docs).collect()}
    sets = {x.doc_id: shingles(x.text) for x in docs.collect()}
    links = [
        (i, j) for i in sets if i % 50 == 0 for j in sets
        if i != j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    ]
    assert sum(got[i] == got[j] for i, j in links) == len(links)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5)]
    got = {x.vertex: x.component for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}


def lines_by_force(texts):
    docs = {}
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(" \t\n\x0b\x0c\r"))
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                docs.setdefault(key(line), set()).add(i)
    out = []
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(docs.get(key(x), ())) < 3 or max(docs[key(x)]) == i]
        out.append((len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup_matches_brute_force(spark, batches):
    r = random.Random(3)
    pool = [prose(i, 4) for i in range(30)] + ["short", "", "  " + prose(2, 4).upper() + "\t", "é" * 19, "é" * 20]
    texts = [None, ""] + ["\n".join(r.choice(pool) for _ in range(r.randint(1, 12))) for _ in range(60)]
    got = {x.doc_id: x for x in line_dedup.dedup_lines(make(spark, texts), batches=batches).collect()}
    assert [(got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) for i in range(len(texts))] == lines_by_force(texts)


def test_line_dedup_on_awkward_rows(spark, awkward):
    got = line_dedup.dedup_lines(awkward)
    assert got.count() == awkward.count() and set(awkward.columns) <= set(got.columns)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def hits_by_force(texts, items, width=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    grams = {}
    for i, t in enumerate(items):
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            grams.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for g, ids in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= ids
        out.append((len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination_matches_brute_force(spark):
    items = [prose(i, 20) for i in range(6)] + ["tiny item", None, "", prose(0, 20)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [prose(50 + i, 60) for i in range(20)]
    texts[1] = items[0].upper() + " " + texts[1]
    texts[2] = " ".join(items[1].split()[:13])
    texts[3] = " ".join(items[1].split()[:12])
    texts[4] = f"a Tiny-item b tiny item {prose(9, 300)}"
    texts[5] = prose(8, 247) + " " + " ".join(items[2].split()[3:16])
    texts += [None, "", texts[1]]
    got = {x.doc_id: x for x in PositionalIndex(make(spark, texts, extra=True), bench).report().collect()}
    want = hits_by_force(texts, items)
    assert [(got[i].n_words, got[i].n_hit, list(got[i]["items"]), got[i].contaminated) for i in range(len(texts))] == want
    kept = {x.doc_id for x in decontaminate(make(spark, texts), bench).collect()}
    assert kept == {i for i, w in enumerate(want) if not w[3]}


def test_decontamination_finds_scrambled_terms_near_each_other(spark):
    item = prose(3, 13)
    mixed = item.split()
    random.Random(1).shuffle(mixed)
    index = PositionalIndex(make(spark, [" ".join(mixed), prose(77, 40)]), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert index.phrases().count() == 0
    assert {x.doc_id for x in index.proximity().collect()} == {0}


def test_decontamination_finds_passages_with_changed_words(spark):
    r = random.Random(4)
    items = [prose(i, 16) for i in range(5)] + [prose(9, 5)]
    texts = [prose(60 + i, 40) for i in range(5)] + [None]
    for n in (1, 2, 3, 4):
        for item in items:
            w = item.split()
            for at in r.sample(range(len(w)), n):
                w[at] = f"changed{at}"
            texts.append(f"{prose(r.random(), r.randint(0, 20))} {' '.join(w)} {prose(r.random(), 9)}")
    index = PositionalIndex(make(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    got = {x.doc_id: x for x in index.near_report().collect()}

    def by_force(text, runs):
        w = (text or "").split()
        ids = set()
        for i, item in enumerate(items):
            v = item.split()
            for k in range(max(1, len(v) - 12)):
                terms = set(v[k : k + 13])
                ids |= {str(i) for run in runs(w) if len(terms & set(run)) / len(terms) >= 0.8}
        return ids

    some = 0
    for i, t in enumerate(texts):
        sure = by_force(t, lambda w: [w[p : p + 13] for p in range(len(w))])
        most = by_force(t, lambda w: [w[max(0, p - 12) : p + 13] for p in range(len(w))])
        assert sure <= set(got[i].near_items) <= most and (got[i].n_near > 0) == bool(got[i].near_items)
        some += bool(sure)
    assert len(got) == len(texts) and some >= 12


def test_decontamination_on_awkward_rows(spark, awkward):
    bench = spark.createDataFrame([(1, "one two three four five six"), (None, None)], "item_id long, text string")
    got = PositionalIndex(awkward, bench).report().collect()
    assert len(got) == awkward.count()
    assert {x.doc_id for x in got if x.contaminated} == {4, None}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(awkward, none).count() == awkward.count()
    assert PositionalIndex(empty(spark), bench).report().count() == 0


def test_mixing_reaches_the_target_weights(spark):
    rows = [(i, "t", "big" if i % 10 else "small", 1) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0), ("absent", 5.0)], "source string, weight double")
    got = mixing.mix_sources(docs, weights, seed=3)
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["big"] - 10_000) < 400 and abs(n["small"] - 10_000) < 400
    keys = [r.mix_key for r in got.select("mix_key").collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_mixing_splits_large_rates_and_takes_awkward_rows(spark, awkward):
    weights = spark.createDataFrame([("a", 1.0), (None, 1.0)], "source string, weight double")
    got = mixing.mix_sources(awkward, weights, total=6000.0)
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert set(n) == {"a", None} and all(abs(x - 3000) < 300 for x in n.values())
    assert got.dropDuplicates(["doc_id", "copy", "n_chars"]).count() <= got.count()
    assert mixing.mix_sources(empty(spark), weights).count() == 0
    assert mixing.mix_sources(awkward, weights.where("false")).count() == 0


def test_mixing_keeps_unlisted_and_null_sources(spark, tmp_path):
    rows = [(i, "t", "en", ("src0", "new site", None)[i % 3], 1) for i in range(9_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    mixed = [queries.op4_mix_sources(spark, str(tmp_path)), corpus_pipeline.mix(spark, docs, str(tmp_path))]
    for got in mixed:  # three parts of src0 to one part of each other
        n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
        assert set(n) == {"src0", "new site", None}
        assert abs(n["src0"] - 5400) < 400 and abs(n["new site"] - 1800) < 250 and abs(n[None] - 1800) < 250
    weights = spark.createDataFrame([("src0", 1.0), ("new site", 0.0)], "source string, weight double")
    assert {r.source for r in mixing.mix_sources(docs, weights, default=1.0).select("source").distinct().collect()} == {"src0", None}
    assert {r.source for r in mixing.mix_sources(docs, weights).select("source").distinct().collect()} == {"src0"}


def test_media_round_trip(spark, awkward, tmp_path):
    got = media.media_features(awkward, f"file://{tmp_path}/media").collect()
    texts = [(r.doc_id, r.text) for r in awkward.collect()]
    assert len(got) == len(texts)

    def want(t):
        raw = (t or "").encode()
        pay = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        return len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:])

    assert sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted((i or -1, *want(t)) for i, t in texts)
    assert media.media_features(empty(spark), f"file://{tmp_path}/none").count() == 0


def test_media_ranges_and_broken_members(spark, tmp_path):
    docs = make(spark, [prose(i, 200) for i in range(50)]).coalesce(1)
    media.store_texts(docs, str(tmp_path))
    small = spark.read.format("mediaarchive").option("rangeBytes", 4096).load(str(tmp_path))
    assert small.rdd.getNumPartitions() > 5 and small.select("name").distinct().count() == 50
    (archive,) = tmp_path.glob("*.tar")
    offsets = sorted(r.offset for r in small.collect())
    with archive.open("r+b") as f:
        f.seek(offsets[7])
        f.write(b"\xff" * 512)
    got = spark.read.format("mediaarchive").option("mode", "permissive").option("retries", 1).load(str(tmp_path)).collect()
    assert [r.offset for r in got if r.error] == [offsets[7]] and sum(r.media is not None for r in got) == 49
    with pytest.raises(Exception, match="after 1 tries"):
        spark.read.format("mediaarchive").option("retries", 1).load(str(tmp_path)).collect()
    (tmp_path / archive.name.replace(".tar", ".idx")).unlink()
    other = make(spark, ["x", None]).coalesce(1)
    media.store_texts(other, str(tmp_path / "b"))
    (tmp_path / "b" / next((tmp_path / "b").glob("*.idx")).name).unlink()
    assert spark.read.format("mediaarchive").load(str(tmp_path / "b")).count() == 2


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="home"><nav><a href=x>Menu entry</a></nav><header>Site name</header>
<div class="cookie-notice"><p>We use cookies, a long text about them and about them again and again.</p></div>
<div id="c12"><div class="post post-%d"><h2>Head &amp; line</h2><p>First&nbsp;&eacute; paragraph<br>goes   on <b>here.<p>Second one<script>var p = "</p>";</script> ends.
<div class="ad">Buy</div><ul><li>item one<li>item two</ul><form><p>Name</p><input></form><div class="comments"><p>I comment at great length on this and on that.</p></div></div>
<div class="sidebar"><p>Side</p></div></div><footer>Foot</footer></body></html>"""
MAIN = "Head & line\nFirst é paragraph goes on here.\nSecond one ends.\nitem one\nitem two"


def test_html_text_by_host_paths(spark):
    rows = [(i, f"http://h.example/{i}", PAGE % i) for i in range(6)]
    # A page whose own best container is another: the host's path wins.
    rows.append((6, "http://h.example/6", PAGE.replace('<div class="sidebar"><p>Side</p>', '<div class="big"><p>' + prose(4, 200) + "</p>") % 6))
    rows += [(7, None, None), (8, "x", ""), (9, "http://other/", "just &lt;text&gt;\n and more"), (10, "http://other/", "<p>cut <b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash"))
    got = {r.page_id: r for r in html_text.extract_text(pages).collect()}
    assert all(got[i].text == MAIN for i in range(7))
    assert got[7].text == "" and got[8].text == "" and got[9].text == "just <text> and more" and got[10].text == "cut"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.extract_text(pages.where("false")).count() == 0


def test_html_text_keeps_the_whole_article(spark):
    long, lead, more = prose(1, 300), prose(2, 25), prose(3, 30)
    parts = f'<h1>Head</h1><section class=lead><p>{lead}</p></section><div class="entry-content"><p>{long}</p></div><section class=more><p>{more}</p></section>'
    whole = f"Head\n{lead}\n{long}\n{more}"
    wraps = ["<article>%s</article>", "<main><article>%s</article></main>", "<div class=post>%s</div>", '<div class="content has-sidebar">%s</div>', '<div class="main no-comments">%s</div>',
             "<div class=share-price>%s</div>", "<form id=aspnet><div>%s</div></form>", '<div class="sidebar">%s</div>']
    junk = '<div class="sidebar-left"><p>Side</p></div><div class="site-footer">Foot</div><div id="comments"><p>I say</p></div><div class="share-buttons">Share</div><nav>Menu</nav>'
    pages = [(100 * h + i, f"http://h{h}.example/{i}", f"<html><body>{junk}{w % parts}</body></html>") for h, w in enumerate(wraps) for i in range(3)]
    pages.append((999, "http://c.example/", f"<body><article><h1>Head</h1><p>{lead}</p></article><div class=comments><p>{long}</p></div></body>"))
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got.pop(999) == f"Head\n{lead}"
    assert {i: t for i, t in got.items() if t != whole} == {}
    small = f'<body><article><p>{long}</p><div class="share-price"><p>{lead}</p></div><p class="no-comments">{more}</p></article></body>'
    assert html_text.main_text(small, None) == f"{long}\n{lead}\n{more}"


def test_html_text_of_odd_rows(spark):
    big, body = 2**60 + 1, prose(5, 60)
    page = f"<body><article><header><h3>Head</h3></header><p>{body} <math><mi>x</mi></math></p></article></body>"
    rows = [(big, "http://a.example/", page), (big, "http://a.example/", page), (None, "http://a.example/", page), (big + 1, None, None)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, f"Head\n{body} x"), *[(big, f"Head\n{body} x")] * 2, (big + 1, "")]


@pytest.mark.parametrize(
    "page",
    [
        "<body>" + "text <hr>" * 50_000, "<body>" + "<div>a" * 40_000, "<b>" * 20_000 + "<p>x</p>" * 20_000, "<div " + "a" * 300_000 + ">x",
        "<div>" * 20_000 + "</span>" * 20_000 + "x", "<article>" + "<header>" * 20_000 + "<h3>t</h3>", "<body>" + "<a>link</a> t <hr>" * 20_000,
    ],
)
def test_long_pages_take_time_in_proportion(page):
    began = time.process_time()
    path, path_id, _ = html_text.vote(page)
    assert html_text.main_text(page, path_id) == html_text.main_text(page, None)
    assert time.process_time() - began < 20


def test_languages_in_blocks_give_the_same_answer(spark, awkward):
    rows = [(i, prose(i % 7, 30 + i), f"l{i % 7}") for i in range(60)] + [(60, "same words", "b"), (61, "same words", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(awkward.select("doc_id", "text", "lang"))
    one, many = (language.identify(docs, block=n).collect() for n in (2000, 2))
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_language_of_held_out_documents(spark, awkward):
    words = {"en": "the and with that house water under little", "de": "und der nicht schön wasser über kleine häuser", "fr": "le la avec maison été sous petite eau"}
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(words[k].split()) for _ in range(r.randint(3, 60))), k) for i in range(300) for k in [sorted(words)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language.identify(docs).collect()}
    held = [i for i, _, _ in rows if got[i].held_out]
    assert held == [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.95 * len(held)
    assert all(0 <= x.score <= 1 for x in got.values())
    more = {x.doc_id: x for x in language.identify(awkward).collect()}
    assert more[0].lang_pred == more[1].lang_pred == more[2].lang_pred == "und" and more[3].lang_pred != "und"
    assert language.identify(empty(spark)).count() == 0
    assert {x.lang_pred for x in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_hyperdimensional_bundles_do_not_depend_on_blocks():
    texts = ["Hello there", None, "123", "ß über"]
    a, b = language.bundle(texts, 128), language.bundle(texts, 128, block=3)
    assert abs(a - b).max() < 1e-3 and not a[1].any() and not a[2].any()


def test_url_rules_and_list(spark):
    rules = [url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "com", "/de/")]
    listed = spark.createDataFrame([("bad.net",), ("bad.net",), (None,), ("elsewhere.net",)], "key string")
    urls = ["http://A.Example.org/es/1", "https://example.org/x?y", "http://notexample.org/es/", "http://x.com/de/", "http://x.com/de", "http://bad.net", "http://a.bad.net/p#f",
            "http://goodbad.net/", None, "no scheme", "", "http://", "http://u:p@bad.net:80/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules, listed).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("example.org", "/x", "org/", "allow") and got[2][2] == "org/"
    assert got[3][2] == "com/de/" and got[4][2] is None and got[4][3] == "allow"
    assert got[5] == ("bad.net", "", None, "block") and got[6] == ("a.bad.net", "/p", None, "block") and got[7][3] == "allow"
    assert all(got[i] == ("", "", None, "allow") for i in (8, 9, 10, 11)) and got[12][0] == "u:p@bad.net:80"
    assert url_filter.filter_urls(pages.where("false"), rules, listed).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, [], listed.where("false")).collect()} == {"allow"}


def test_bloom_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    keys = url_filter.marked_keys(universe, universe.where("key % 7 = 0"))
    cascade = url_filter.build_cascade(keys, bits_per_key=3)
    assert len(cascade.levels) > 2
    wrong = universe.select("key", cascade.any_listed(F.array("key")).alias("in")).where("in <> (key % 7 = 0)")
    assert wrong.count() == 0


def test_url_filter_by_blocks_gives_the_same_verdicts(spark):
    pages = spark.createDataFrame([(i, f"http://a{i % 40}.b{i % 90}.net/{'x' * (i % 5)}") for i in range(400)] + [(400, None), (7, "http://b7.net/" + "y" * 200_000)] * 2, "page_id long, url string")
    listed = spark.createDataFrame([(f"b{i}.net",) for i in range(0, 90, 4)], "key string")
    whole = url_filter.filter_urls(pages, [], listed)
    blocks = url_filter.filter_urls(pages, [], listed, max_bytes=4)
    assert blocks.columns == whole.columns and sorted(map(str, blocks.collect())) == sorted(map(str, whole.collect()))
    assert {(r.page_id % 90 % 4 == 0, r.verdict) for r in whole.where("page_id < 400 and length(url) < 100").collect()} == {(True, "block"), (False, "allow")}


def test_license_scan(spark, awkward):
    mit = licenses.TEMPLATES["MIT-grant"]
    changed = mit.replace("free of charge, to any person", "gratis to any person")
    texts = [f"{prose(1, 40)}\nLicensed under the Apache License, Version 2.0.\n{prose(2, 40)} licensed under cc-by-nc 4.0", f"{prose(3, 300)} {changed}", prose(4, 100), None, "", "the MIT License"]
    docs = make(spark, texts)
    got = sorted((r.doc_id, r.license, r.coverage, texts[r.doc_id][r.first_char : r.end_char]) for r in licenses.scan_licenses(docs).collect())
    assert [g[:2] for g in got] == [(0, "Apache-2.0"), (0, "CC-BY-NC-4.0"), (1, "MIT-grant")]
    assert got[0][2:] == (1.0, "Licensed under the Apache License, Version 2.0") and got[1][2] == 1.0
    assert 0.85 < got[2][2] < 1 and got[2][3].startswith("Permission") and got[2][3].endswith("Software")
    twice = make(spark, [f"{texts[0]} {texts[0]}"])
    assert licenses.scan_licenses(twice).count() == 4
    assert licenses.scan_licenses(awkward).count() == 0 and licenses.scan_licenses(empty(spark)).count() == 0
    assert licenses.scan_licenses(docs, {}).count() == 0


def test_license_scan_in_blocks_and_with_large_ids(spark):
    notices = [f"{prose(i, 30)}\n{t}" for i, t in enumerate(licenses.TEMPLATES.values())]
    docs = spark.createDataFrame([(2**60 + 1 + i, t) for i, t in enumerate(notices)] + [(None, notices[0])], "doc_id long, text string")
    whole, blocks = (sorted(map(str, licenses.scan_licenses(docs, block=n).collect())) for n in (licenses.BLOCK_WORDS, 30))
    assert whole == blocks
    ids = {r.doc_id for r in licenses.scan_licenses(docs).collect()}
    assert ids == {2**60 + 1 + i for i in range(len(notices))} | {None}


def test_license_scan_finds_short_notices_wherever_they_stand(spark):
    texts = [f"{prose(i, 20 + i)}\nAll rights reserved." for i in range(30)]
    texts += [f"{prose(50 + i, 30)} released under {w} MIT license {prose(90 + i, i)}" for i, w in enumerate(("a", "this", "our"))]
    texts += [f"{prose(70, 9)} all rights waived, every right reserved", "All rights reserved"]
    got = sorted((r.doc_id, r.license, r.coverage, texts[r.doc_id][r.first_char : r.end_char]) for r in licenses.scan_licenses(make(spark, texts)).collect())
    assert got[:30] == [(i, "All-rights-reserved", 1.0, "All rights reserved") for i in range(30)]
    assert [g[:3] for g in got[30:]] == [(30, "MIT", 0.8), (31, "MIT", 0.8), (32, "MIT", 0.8), (34, "All-rights-reserved", 1.0)]
    assert {r.license for r in licenses.scan_licenses(make(spark, ["x public domain y"]), {"pd": "Public domain", "none": "..."}).collect()} == {"pd"}


def test_license_scan_reports_repeats_close_together(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    texts = [mit * 2, "\n".join(f"{prose(i, 1 + i % 12)}: {mit}" for i in range(200)), f"{mit} {apache} {mit} x {apache}"]
    texts += [f"{prose(5, 30)} {mit} released under that MIT license {mit} {prose(6, 30)}", "\n".join([licenses.TEMPLATES["MPL-2.0-notice"]] * 3)]
    texts += ["All rights reserved. " * 5]
    got = {}
    for r in licenses.scan_licenses(make(spark, texts)).collect():
        got.setdefault((r.doc_id, r.license), []).append((r.first_char, r.coverage, texts[r.doc_id][r.first_char : r.end_char]))
    full = lambda text, notice: [(m.start(), 1.0, notice[:-1]) for m in re.finditer(re.escape(notice), text)]
    for i in range(3):
        assert sorted(got[i, "MIT"]) == full(texts[i], mit)
    assert sorted(got[2, "Apache-2.0"]) == full(texts[2], apache)
    assert [c for _, c, _ in sorted(got[3, "MIT"])] == [1.0, 0.8, 1.0]
    assert sorted(got[4, "MPL-2.0-notice"]) == full(texts[4], licenses.TEMPLATES["MPL-2.0-notice"])
    assert sorted(got[5, "All-rights-reserved"]) == full(texts[5], "All rights reserved.")


def test_quality_by_co_training(spark, awkward):
    r = random.Random(8)
    good = [prose(i, r.randint(20, 200)).capitalize() + "." for i in range(160)]
    bad = [" ".join(w.upper() + "!!" for w in prose(1000 + i, r.randint(20, 200)).split()) for i in range(80)]
    texts = good + bad
    docs = make(spark, texts, extra=True)
    labels = spark.createDataFrame([(i, int(i < 160), None) for i in range(0, 240, 3)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.score_documents(docs, labels).collect()}
    assert sum(got[i].kept == (i < 160) for i in range(240)) >= 236
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i in got if got[i].kept}
    assert quality.score_documents(awkward, labels).count() == awkward.count()
    none = labels.where("false")
    assert {x.score for x in quality.score_documents(docs, none).collect()} == {0.5}
    assert quality.keep_good(empty(spark), labels).count() == 0


@pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="needs the test data")
def test_quality_of_held_out_labels(spark):
    docs, labels = spark.read.parquet(DOCUMENTS), spark.read.parquet(DOCUMENTS.replace("documents", "labels"))
    known = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = quality.score_documents(docs, labels.where(~held)).where(held).collect()
    judged = [r.kept == bool(known[r.doc_id]) for r in got if r.doc_id in known]
    assert len(judged) >= 20 and sum(judged) >= 0.95 * len(judged)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    session = type("Session", (), {"conf": Conf()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session, "x")


_LONG = " ".join(f"Sentence number {i} of the article goes on." for i in range(30))


@pytest.mark.parametrize(
    "inside, kept",
    [
        ("<script src=//cdn.example/x/>var leak=1;</script>", []), ("<script src='a'/>leak</script>", []), ("<svg><svg></svg><text>leak</text></svg>", []),
        ("<svg width=5/><text>leak</text></svg>", []), ("<svg/><p>kept</p>", ["kept"]), ("<template><template></template>leak</template>", []),
        ("<textarea><textarea></textarea><p>kept</p>", ["kept"]), ("<a href=/x/>link</a>", ["link"]),
        ("<h2 id=search>Search</h2>", ["Search"]), ("<h2 id=login>Login</h2>", ["Login"]), ("<p id=menu>para</p>", ["para"]),
        ("<section id=discussion><h2>Discussion</h2><p>We find it.</p></section>", ["Discussion", "We find it."]),
        ("<section id=search><form><input></form>Find</section>", []), ("<section id=menu><a href=a>One</a> <a href=b>Two</a></section>", []),
        ("<section id=comments><p>Nice one.</p></section>", []), ("<div class=share-buttons>x</div>", []), ("<p class=notice>n</p>", []),
    ],
)
def test_html_text_of_scripts_anchors_and_sections(inside, kept):
    page = f"<html><body><article><h1>Head</h1><p>{_LONG}</p>{inside}<p>tail of it</p></article></body></html>"
    assert html_text.main_text(page, None).split("\n") == ["Head", _LONG, *kept, "tail of it"]


@pytest.mark.parametrize(
    "page",
    [
        "<svg>" + "</svg" * 48_000, "<svg>" + '<svg "' * 40_000 + ">", "<script>" + "</script " * 27_000, "<li><ul>" + "<b>" * 20_000 + "<li>x</li>" * 17_000,
        "<li><ul>" + "<div>" * 20_000 + "<li>x</li>" * 9_000, "<p>" + "<b>" * 20_000 + "<div>x</div>" * 9_000, "<li><dt>" * 30_000,
    ],
)
def test_pages_of_repeated_tags_take_time_in_proportion(page):
    began = time.process_time()
    html_text.vote(page)
    assert time.process_time() - began < 4


def test_html_text_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "http://a.org/x", f"<article><p>{_LONG}</p></article>", "p", "h", "t", 3)], "page_id long, url string, html string, path string, host string, text string, path_id int")
    assert [r.text for r in html_text.extract_text(rows).collect()] == [_LONG]


def test_listed_hosts_in_upper_case(spark):
    pages = spark.createDataFrame([(1, "http://Ads-track.example.com/x"), (2, "http://b.example.com/")], "page_id long, url string")
    listed = spark.createDataFrame([("Ads-Track.example.com",)], "key string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, [], listed).collect()}
    assert got == {1: "block", 2: "allow"}


def test_quality_tells_vocabularies_apart_by_their_words(spark):
    r = random.Random(9)
    vocabulary = [["".join(r.choice("aeinrst") for _ in range(6)) for _ in range(150)] for _ in range(2)]
    texts = [" ".join(r.choice(vocabulary[i % 2]) for _ in range(40)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    right = []
    for words in (True, False):
        got = quality.score_documents(docs, labels, words=words).where("doc_id >= 200").collect()
        right.append(sum(x.kept == bool(x.doc_id % 2) for x in got))
    assert right[0] >= 190 and right[1] <= 140


def test_quality_of_odd_rows(spark, awkward):
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    got = quality.score_documents(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= x.score <= 1 for x in got)
    by = {}
    for x in got:
        by.setdefault(x.doc_id, set()).add(x.score)
    assert all(len(v) == 1 for v in by.values())
    kept = sorted(str(x.doc_id) for x in quality.keep_good(awkward, labels).collect())
    assert kept == sorted(str(x.doc_id) for x in got if x.kept)
