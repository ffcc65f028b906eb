"""Small column helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Everything of ASCII but digits and letters separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Runs of digits, a-z and non-ASCII characters after ``ascii_lower``; null: none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(c, F.lit(""))), SEPARATORS), "")


def once(c: Column) -> Column:
    """``c`` as a generated column: a row-wise barrier, so that lambdas which use it
    read a value and do not evaluate ``c`` anew for each element."""
    return F.explode(F.array(c))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def held_out(key: Column) -> Column:
    """True for the quarter of the keys that no classifier learns from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, limit: int, key: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(text, y) of at most ``limit`` labelled keys that are not held out, the same keys each
    time: those with the smallest hashes. Of several labels of a key the largest holds; null
    labels and null keys are left out. The ids are few by that limit, so they are broadcast."""
    ids = labels.filter(F.col(key).isNotNull() & F.col(target).isNotNull() & ~held_out(F.col(key))) \
        .groupBy(key).agg(F.max(F.col(target).cast("int")).alias("y__")) \
        .orderBy(F.xxhash64(key), key).limit(limit)
    return docs.select(key, text_col).join(F.broadcast(ids), key) \
        .select(F.col(text_col).alias("text"), F.col("y__").alias("y"), F.xxhash64(key).alias("h"))


def give_back() -> None:
    """Return freed memory of this worker process to the host; Spark reuses workers, and what one
    task had at its peak would stay with the process for the stages that follow."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def fitted(rows: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """``fit`` of all ``rows``, which a parameter of the caller bounds, run in one task in the order
    of the columns; only the model comes to the driver. Without rows ``fit`` gets None."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        model = pickle.dumps(fit(pa.Table.from_batches(got) if got else None))
        got.clear()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    got = rows.repartition(1).sortWithinPartitions(*rows.columns).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(got[0][0])) if got else fit(None)
