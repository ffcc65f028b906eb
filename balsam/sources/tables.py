"""Parquet tables of a scale-factor folder, with the derived inputs the operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_path(sf_dir: str, name: str) -> str:
    """A table's parquet file, or the folder of its part files."""
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table_glob(sf_dir: str, name: str) -> str:
    """A pattern for the same: a stream takes a single file by a pattern only."""
    return table_path(sf_dir, name)[:-1] + "[t]"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One parquet table; naming columns here keeps the scan pruned."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def labelled_documents(spark: SparkSession, sf_dir: str, target: str = "toxic") -> DataFrame:
    """W: documents joined with their labels -> (id, text, lang, target).

    A plain equi-join on the key: Catalyst picks broadcast or sort-merge from the
    statistics, AQE re-plans at run time.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels", "doc_id", target)
    return (docs.join(labels, "doc_id")
            .select(F.col("doc_id").alias("id"), "text", "lang",
                    F.col(target).cast("int").alias("target")))


def learnable_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L: (id, x array<double>, target): a target that the first four coordinates determine."""
    x = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(
        F.col("vec_id").alias("id"), x.alias("x"), (x[0] + x[1] + x[2] + x[3] > 0.15).cast("int").alias("target"))


def embedding_set(spark: SparkSession, sf_dir: str, positive_label: int = 0) -> DataFrame:
    """E: (id, x array<double>, target) with target = (label == positive_label)."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return e.select(F.col("vec_id").alias("id"),
                    F.col("embedding").cast("array<double>").alias("x"),
                    (F.col("label") == positive_label).cast("int").alias("target"))
