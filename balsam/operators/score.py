"""Scoring (H1-H5) and score-column choice (I12)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balsam.functions.vectors import argmax, softmax


def predict(model, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Apply a fitted PipelineModel (its own preprocessors included)."""
    out = model.transform(df)
    cols = (keep or [c for c in df.columns if c not in ("features",)]) + ["prediction"]
    return out.select(*cols)


def predict_proba(model, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """prediction plus class probabilities as array<double> and a positive score."""
    out = model.transform(df)
    cols = keep or [c for c in df.columns if c not in ("features",)]
    res = out.select(*cols, "prediction", *(c for c in ("probability", "rawPrediction") if c in out.columns))
    return with_score(res)


def with_score(scored: DataFrame, out: str = "score") -> DataFrame:
    """probability[1] when the model has probabilities, else the decision value
    rawPrediction[1]; a model with neither leaves no score (I12)."""
    if "probability" in scored.columns:
        arr = vector_to_array("probability")
        return scored.withColumn("probability", arr).withColumn(out, F.col("probability")[1])
    if "rawPrediction" in scored.columns:
        return scored.withColumn(out, vector_to_array("rawPrediction")[1])
    return scored


def softmax_argmax(df: DataFrame, logits: str = "logits") -> DataFrame:
    """Probabilities from logits (stable softmax) and argmax (lowest index on ties)."""
    return df.withColumn("probability", softmax(F.col(logits))).withColumn("prediction", argmax(F.col(logits)))


def score_unlabelled(model, df: DataFrame, keep: list[str]) -> DataFrame:
    """Batch scoring of unlabelled rows: prediction, probability, margin and entropy."""
    s = predict_proba(model, df, keep)
    p = F.col("probability")
    ent = -F.aggregate(p, F.lit(0.0), lambda a, v: a + F.when(v > 0, v * F.log(v)).otherwise(0.0))
    srt = F.sort_array(p, asc=False)
    return s.withColumn("margin", srt[0] - srt[1]).withColumn("entropy", ent)
