"""The stages one after another, each against what its operator says of its own input."""

import random

import corpus_pipeline
import pytest

from strokeflow.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeinrst") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted copies, lines and passages, labels and a benchmark."""
    path = tmp_path_factory.mktemp("docs")
    item, line = prose(1, 30), prose(2, 8)
    texts = [f"{prose(10 + i, 80).capitalize()}.\n{prose(500 + i, 30)}" for i in range(60)]
    texts += [" ".join(w.upper() + "!!" for w in prose(900 + i, 60).split()) for i in range(30)]
    for i in (3, 4, 5, 6):
        texts[i] += "\n" + line
    texts[7] = f"{texts[7]} {item}"
    texts += [texts[8], texts[9] + " end", None, ""]
    rows = [(i, t, "en", f"src{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(not 60 <= i < 90), 0) for i in range(0, 94, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), texts, line


def test_each_stage_takes_effect(spark, folder):
    path, texts, line = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).persist()
        seen.append((name, docs.count()))
        if name != "mix":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name != "mix":
            ids = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality":
            assert not any(60 <= i < 90 for i in ids) and set(range(60)) <= set(ids)
        if name == "lines":
            assert [i for i in ids if ids[i] and line in ids[i]] == [6]
        if name == "near duplicates":
            assert {8, 9} <= set(ids) and not {90, 91} & set(ids)
        if name == "benchmark":
            assert 7 not in ids and set(range(60)) - {7} <= set(ids)
        if name == "mix":
            assert {r.doc_id for r in docs.collect()} <= set(ids)
    assert seen[-1][1] > 20


def test_stages_take_empty_documents(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0


def test_every_query_has_rows(spark):
    for name, query in queries().items():
        assert query(spark, SF).limit(1).count() == 1, name
    assert set(oracle_sql()) <= set(queries())
