"""From raw documents to a training mix, in five stages of the training-data operators.

Each stage works on all that its predecessor kept and is written as Parquet before the next one
reads it. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokeflow.llm.common import shared_dir
from strokeflow.llm.decontaminate import decontaminate
from strokeflow.llm.line_dedup import dedup_lines
from strokeflow.llm.mixing import mix_sources
from strokeflow.llm.near_dedup import keep_one_each
from strokeflow.llm.quality import keep_good
from strokeflow.llm.queries import MIX_SEED, OTHER_WEIGHT, WEIGHTS, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; ``n_chars`` follows the text; a null text stays null."""
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    return dedup_lines(docs).withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_one_each(docs).select(COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources, listed or not, are repeated to their target weights and shuffled."""
    weights = spark.createDataFrame(list(WEIGHTS.items()), "source string, weight double")
    return mix_sources(docs, weights, seed=MIX_SEED, default=OTHER_WEIGHT).select(*COLUMNS, "copy", "mix_key")


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("mix", mix),
]

#: SQL cannot express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name.replace(' ', '-')}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
