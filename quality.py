"""
models x samplers with nested CV on the training part and macro metrics on the
untouched test part, over the embeddings table, with a target that four of their
coordinates determine.

    QUALITY_SF_DIR=/root/testdata/sf0.1 python quality.py > QUALITY.md

Uses the fast grids (two points per model); the numbers describe this data set,
not the reference's (its event data is not available).
"""

from __future__ import annotations

import os
import sys
import time


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from balsam.operators import split
    from balsam.operators import train as TR
    from balsam.operators.resample import RESAMPLERS
    from balsam.session import get_spark
    from balsam.sources.tables import learnable_set

    sf = os.environ.get("QUALITY_SF_DIR", "/root/testdata/sf0.1")
    models = os.environ.get("QUALITY_MODELS", "rfc,gbt,mlpc").split(",")
    k = int(os.environ.get("QUALITY_FOLDS", "3"))
    spark = get_spark("local[8]", app="balsam-quality")
    e = learnable_set(spark, sf)
    train, test = split.train_test(e, test_size=0.4, seed="42")
    t0 = time.time()
    tr = TR.Trainer(spark, fast=True, k=k, inner_k=2).fit_all(train, models=models, samplers=list(RESAMPLERS))
    tr.evaluate(test)
    rows = tr.results_table().collect()
    print(f"# QUALITY\n\nEmbeddings table `{sf}` (target from four coordinates), exact stratified 60/40 split, "
          f"{k}-fold nested CV on the training part (scaler and resampler fitted inside each fold), "
          f"fast grids, seed 42. Wall time {time.time() - t0:.0f} s on local[8].\n")
    print("| model | CV macro-F1 | test macro-F1 | accuracy | macro precision | macro recall |")
    print("| --- | --- | --- | --- | --- | --- |")
    for r in rows:
        print(f"| {r['model']} | {r['cv_score']:.4f} | {r['test_f1_macro']:.4f} | {r['test_accuracy']:.4f} | "
              f"{r['test_precision']:.4f} | {r['test_recall']:.4f} |")
    best = max(rows, key=lambda r: r["cv_score"])
    print(f"\nBest by CV macro-F1: {best['model']} (test macro-F1 {best['test_f1_macro']:.4f}).")
    spark.stop()


if __name__ == "__main__":
    main()
