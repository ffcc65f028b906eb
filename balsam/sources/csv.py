"""CSV source and sink (the reference's only file format).

Reading always takes an explicit schema (no inference pass over 100 TB), RFC 4180
quoting (doubled quotes, quoted line breaks) and the pandas notion of missing
values, which Spark does not have: the NA tokens below become null after the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# The strings pandas' CSV reader treats as missing by default.
PANDAS_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

_CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def normalise_na(df: DataFrame, columns: list[str] | None = None,
                 tokens: list[str] = PANDAS_NA_TOKENS) -> DataFrame:
    """String cells equal to an NA token become null (exact, whole-cell match)."""
    cols = columns if columns is not None else [
        f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.select(*[
        F.when(F.col(c).isin(tokens), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
        if c in cols else F.col(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: StructType | str,
             na_tokens: list[str] | None = PANDAS_NA_TOKENS, multi_line: bool = True) -> DataFrame:
    """CSV scan with an explicit schema; string NA tokens normalised to null.

    Cells with line breaks need ``multi_line``, which makes one task of each file; files without
    such cells are split over tasks with ``multi_line=False``.

    Non-string columns are read as strings first and cast after NA removal, so a
    token such as ``NA`` in an int column gives null rather than a parse error.
    """
    target = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    as_text = StructType([type(f)(f.name, StringType(), True) for f in target.fields])
    raw = spark.read.options(**_CSV_OPTIONS).option("multiLine", multi_line).schema(as_text).csv(path)
    if na_tokens is not None:
        raw = normalise_na(raw, tokens=na_tokens)
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.fields])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV sink. Parallel part files (one per partition): no single-task funnel."""
    df.write.mode(mode).options(**_CSV_OPTIONS).csv(path)
    return path
