"""Structured Streaming: the same masking and scoring plans on a stream.

The reference's end goal is to attribute unlabelled records as they arrive.
Every operator here is a stateless projection (masking, hashing encoder-free
scoring via a fitted ``PipelineModel``), so the batch code runs unchanged on a
streaming DataFrame; the stream's progress lives in a checkpoint under the
shared ``spark.checkpoint.dir`` so a restarted job resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from balsam.operators.text import mask_text
from balsam.session import scratch_path


def masked_stream(spark: SparkSession, folder: str, schema: StructType | str, text_cols: list[str],
                  glob: str = "*.parquet", max_files_per_trigger: int = 32, **mask_kw) -> DataFrame:
    """File-source stream of the parquet files in ``folder`` matching ``glob``, with
    the masking plan applied. ``folder`` may be a table: one file, or the folder of its part files."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .option("pathGlobFilter", glob).parquet(folder))
    return mask_text(src, text_cols, **mask_kw)


def score_stream(stream: DataFrame, model, keep: list[str]) -> DataFrame:
    """Apply a fitted PipelineModel to a stream (prediction + probability)."""
    from balsam.operators.score import with_score
    out = model.transform(stream)
    cols = keep + ["prediction"] + [c for c in ("probability", "rawPrediction") if c in out.columns]
    return with_score(out.select(*cols))


def run_to_table(stream: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """Run the stream to completion on what is available (``availableNow``), writing
    to a table folder in the shared checkpoint area; return it as a batch DataFrame."""
    spark = stream.sparkSession
    out = scratch_path(spark, f"stream-{name}")
    q = (stream.writeStream.format(fmt).option("path", out)
         .option("checkpointLocation", out + "-checkpoint")
         .trigger(availableNow=True).outputMode("append").start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).format(fmt).load(out)  # a stream without rows writes no file
