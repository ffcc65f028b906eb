"""The corpus pipeline: toxicity, near duplicates, benchmark passages, personal data, mixing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which :func:`run` writes as Parquet below ``spark.checkpoint.dir`` and reads again as
the next stage's docs. Every stage works on all rows that its predecessor kept. All stages but the
last return the columns of ``documents``; those that change a text also set ``n_chars``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balsam.llm import decontam, minhash_odd, mixing, pii, toxicity
from balsam.llm.common import read
from balsam.session import scratch_path, ship_package

#: A classifier and a similarity join are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.3 or more for toxicity."""
    ship_package(spark)
    model = toxicity.train(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.keep_clean(docs, model, threshold=0.3)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates (five words, 0.8)."""
    ship_package(spark)
    return minhash_odd.keep_representatives(docs, shingle=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages of the benchmark; documents that are mostly such passages go."""
    ship_package(spark)
    return _counted(decontam.remove_contamination(docs, read(spark, sf_dir, "benchmark", "item_id", "text")))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data replaced by its kind."""
    ship_package(spark)
    return _counted(pii.mask_pii(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the place of each document in the mix of its sources."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", not_toxic),
    ("near-duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("personal-data", without_pii),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
