"""From raw documents to packed training sequences: five stages, each over all that its predecessor kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again
as the next one's ``docs``. All but the last return the columns of ``documents``, and further columns of the input,
whatever their names. Empty tables pass every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from multirun.llm import decontaminate, forest, langid, packing, pii
from multirun.llm.common import own_columns, row_keys, shared_dir, stored
from multirun.llm.queries import vocabulary

#: Keys to be removed up to which they are sent to every task; more are joined.
BROADCAST_KEYS = 200_000


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose ``_row`` is not among ``keys``, which are distinct. They are stored, so that what found them runs once."""
    keys = stored(keys, "gone")
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return docs.join(keys, "_row", "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay; those without letters (null and empty texts among them), or of no language the model knows, go.

    The declared language is evidence, as no row is scored by counts that hold its label. Rows with null or repeated ids are judged one by one.
    """
    rows, _ = row_keys(docs, "_row")
    found = langid.verdicts(rows, langid.fit(docs), "_row", declared=F.col("lang"), host=F.col("source"))
    return without(rows, found.where("rejected").select(F.col("key").alias("_row"))).select(*own_columns(docs))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the least id, or the first row where ids are null or repeat.

    A document without words is its own group and stays.
    """
    rows, _ = row_keys(docs, "_row")
    found = forest.linked(rows.select(F.col("_row").alias("doc_id"), "text"))
    return without(rows, found.where("doc_id <> class_id").select(F.col("doc_id").alias("_row"))).select(*own_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; an empty benchmark removes none, and a document without words stays."""
    rows, _ = row_keys(docs, "_row")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contaminated(rows.select(F.col("_row").alias("doc_id"), "text"), items)
    return without(rows, found.where("n_hit > 0").select(F.col("doc_id").alias("_row"))).select(*own_columns(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays, and a null text stays null."""
    found = pii.detect(docs, pii.fit(docs))
    text = pii.redact(F.col("text"), F.col("pii_spans"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*own_columns(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; a null or empty text is one piece with the end id."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("pii", personal_data), ("packing", best_fit_packing),
]

#: Model scores, MinHash trees and a tokenizer have no SQL form; tests hold run() against plain-Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
