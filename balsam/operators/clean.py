"""Projection, parsing, ordering and row identity (inventory B)."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balsam.functions.text import fill_text as _fill
from balsam.operators.order import positions

def drop_columns(df: DataFrame, columns: list[str], strict: bool = True) -> DataFrame:
    """Drop columns; a missing name raises when ``strict`` (Spark alone ignores it)."""
    missing = [c for c in columns if c not in df.columns]
    if strict and missing:
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*columns)


def parse_date(c: Column, fmt: str = "yyyy-MM-dd", strict: bool = True) -> Column:
    """String -> date. Strict: a malformed non-null value fails the job (any ANSI mode);
    lenient: it becomes null."""
    lenient = F.to_date(F.try_to_timestamp(c, F.lit(fmt)))
    if not strict:
        return lenient
    return F.when(c.isNotNull() & lenient.isNull(),
                  F.raise_error(F.concat(F.lit("malformed date: "), c.cast("string")))
                  ).otherwise(lenient)


def parse_dates(df: DataFrame, column: str, fmt: str = "yyyy-MM-dd",
                strict: bool = True) -> DataFrame:
    return df.withColumn(column, parse_date(F.col(column), fmt, strict))


def sort_by(df: DataFrame, order_col: str, key: str) -> DataFrame:
    """Ascending sort with the key as tie-break (pandas' sort is unstable on ties)."""
    return df.orderBy(F.col(order_col).asc_nulls_last(), F.col(key))


def fill_text(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, _fill(F.col(column)))


def feature_select(df: DataFrame, id_col: str, features: list[str], target: str) -> DataFrame:
    """(id, x array<double>, target) from scalar feature columns and/or array columns."""
    parts = []
    for c in features:
        dt = df.schema[c].dataType.typeName()
        parts.append(F.col(c).cast("array<double>") if dt == "array"
                     else F.array(F.col(c).cast("double")))
    x = parts[0] if len(parts) == 1 else F.concat(*parts)
    return df.select(F.col(id_col).alias("id"), x.alias("x"), F.col(target).cast("int").alias("target"))


def expand_embedding(df: DataFrame, column: str, width: int | None = None,
                     prefix: str | None = None) -> DataFrame:
    """Spread an array column into ``{prefix}_emb_{i}`` scalar columns, same row."""
    if width is None:
        width = df.select(F.max(F.size(column))).first()[0] or 0
    prefix = prefix or column
    return df.select("*", *[F.col(column)[i].alias(f"{prefix}_emb_{i}") for i in range(width)])



def exclude_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Drop rows whose key is listed (anti join; Catalyst/AQE pick the strategy)."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def row_positions(df: DataFrame, order_cols: list, out: str = "pos") -> DataFrame:
    """Dense 0-based position (``reset_index``) without a single-partition window."""
    return positions(df, order_cols, out)


def drop_positions(df: DataFrame, order_cols: list, drop: list[int],
                   check: bool = True) -> DataFrame:
    """Drop rows by 0-based position in ``order_cols`` order; re-number the rest.

    A position beyond the row count raises (pandas ``drop(index=...)``)."""
    spark = df.sparkSession
    pos = positions(df, order_cols, "__pos")
    if check and drop:
        n = df.count()
        bad = [p for p in drop if p < 0 or p >= n]
        if bad:
            raise KeyError(f"positions not found: {bad}")
    gone = spark.createDataFrame([(int(p),) for p in drop], "__pos long")
    kept = pos.join(F.broadcast(gone), "__pos", "left_anti").drop("__pos")
    return kept


def class_distribution(df: DataFrame, target: str = "target") -> DataFrame:
    """``value_counts``: (class, count) by count desc, class asc."""
    return (df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.col(target)))


def head_n(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """First n rows by key (TakeOrderedAndProject: a top-k, not a full sort)."""
    return df.orderBy(key).limit(n)
