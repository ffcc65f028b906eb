"""Label policies, flags and one-hot features (inventory C).

Null logic: pandas treats NaN as "not equal, not in" so every flag is
``coalesce(condition, false)``; Spark's three-valued logic would otherwise
leave nulls.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The reference's actor names and their labels.
UNATTRIBUTED_ACTORS = [
    "Unidentified Armed Group (Afghanistan)",
    "Taliban and/or Islamic State Khorasan Province (ISKP)",
]
TALIBAN_ACTORS = ["Taliban", "Taliban - Red Unit", "Mutiny of Taliban"]
ISKP_ACTORS = ["Islamic State Khorasan Province (ISKP)"]
ACTOR_LABELS = {**{a: 0 for a in TALIBAN_ACTORS}, **{a: 1 for a in ISKP_ACTORS}}

# Whole-string tag values of the violence-against-women flag.
VIOLENCE_AGAINST_WOMEN_TAGS = [
    "women targeted: government officials",
    "women targeted: girls",
    "women targeted: girls; women targeted: relatives of targeted groups or persons",
    "local administrators",
    "women targeted: government officials; women targeted: relatives of targeted groups or persons",
    "women targeted: candidates for office",
    "women targeted: activists/human rights defenders/social leaders",
    "women targeted: relatives of targeted groups or persons",
    "local administrators; women targeted: politicians",
    "women targeted: activists/human rights defenders/social leaders; women targeted: government officials",
]
VIOLENCE_SUB_EVENT = "Sexual violence"
VIOLENCE_EXCLUDED_TAG = "local administrators"


def unlabelled_subset(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows whose ``column`` is one of ``names`` (exact match; pushed to the scan)."""
    return df.where(F.col(column).isin(names))


def label_expr(column: str, policy: dict[str, int]) -> Column:
    """name -> int label via a literal map (no join; the policy is a short list)."""
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(int(v))) for k, v in policy.items()))
    return F.element_at(m, F.col(column))


def labelled_subset(df: DataFrame, column: str, policy: dict[str, int],
                    target: str = "target") -> DataFrame:
    """Keep rows whose name is in the policy and add the int label; the rest is dropped."""
    return (df.where(F.col(column).isin(list(policy)))
            .withColumn(target, label_expr(column, policy).cast("int")))


def curate_labels(df: DataFrame, policy: dict[str, int], unlabelled: list[str],
                  column: str, target: str = "target") -> tuple[DataFrame, DataFrame]:
    """(labelled, unlabelled) pair off one parent, both lazy."""
    return labelled_subset(df, column, policy, target), unlabelled_subset(df, column, unlabelled)


def tag_flag(eq_col: str, eq_value: str, tag_col: str, tag_values: list[str],
             excluded: str | None) -> Column:
    """int flag: eq_col == eq_value OR (tag_col in tag_values AND tag_col != excluded).

    Whole-string comparison (not per tag); nulls give 0, never null."""
    in_list = F.col(tag_col).isin(tag_values)
    if excluded is not None:
        in_list = in_list & (F.col(tag_col) != F.lit(excluded))
    cond = (F.col(eq_col) == F.lit(eq_value)) | in_list
    return F.coalesce(cond, F.lit(False)).cast("int")


def violence_against_women(df: DataFrame, out: str = "violence_against_women") -> DataFrame:
    return df.withColumn(out, tag_flag("sub_event_type", VIOLENCE_SUB_EVENT, "tags",
                                       VIOLENCE_AGAINST_WOMEN_TAGS, VIOLENCE_EXCLUDED_TAG))


def presence_flag(c: Column) -> Column:
    """not null -> 1, null -> 0."""
    return c.isNotNull().cast("int")


def one_hot(df: DataFrame, column: str, categories: list[str] | None = None,
            drop_source: bool = True) -> DataFrame:
    """``get_dummies``: one int column ``{column}_{value}`` per sorted category.

    Categories are discovered with one aggregation unless given; there is a column for each, so
    their number is that of the result's columns. For a column with very many values use
    :func:`one_hot_vector`. A null row is all zeros.
    """
    if categories is None:
        categories = sorted(r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().collect())
    cols = [F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{column}_{v}")
            for v in categories]
    out = df.select("*", *cols)
    return out.drop(column) if drop_source else out


def one_hot_vector(df: DataFrame, column: str, out: str = "one_hot") -> DataFrame:
    """The same encoding as one sparse vector (place in order of value), for any number of values;
    a null row is all zeros."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    index = StringIndexer(inputCol=column, outputCol="__index", handleInvalid="keep", stringOrderType="alphabetAsc")
    encode = OneHotEncoder(inputCol="__index", outputCol=out, dropLast=True)
    return Pipeline(stages=[index, encode]).fit(df).transform(df).drop("__index")


def curate_from_actors(df: DataFrame, actor_cols: list[str], policy: dict[str, int],
                       target: str = "target") -> DataFrame:
    """Label from several actor columns: keep rows whose mapped labels agree.

    Mixed (coalition) rows map to two different labels and are excluded; rows
    with no mapped actor are excluded too.
    """
    labels = F.array_distinct(F.filter(F.array(*[label_expr(c, policy) for c in actor_cols]),
                                       lambda v: v.isNotNull()))
    return (df.withColumn("__labels", labels).where(F.size("__labels") == 1)
            .withColumn(target, F.col("__labels")[0].cast("int")).drop("__labels"))
