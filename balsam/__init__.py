"""balsam — imbalanced text-and-event classification analytics on Spark DataFrames.

Everything is ``DataFrame -> DataFrame``: label curation, text masking and leakage
auditing, exact stratified splits and folds, kNN-based rebalancing, population
scaling, nested cross-validation, scoring and exact evaluation tables.
"""

__version__ = "0.1.0"
