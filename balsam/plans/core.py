"""Plans for sources, projection/row identity, labels and splits (A, B, C, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from balsam.functions.text import GROUP_NAME_PATTERNS, PROVINCE_NAMES
from balsam.operators import clean, labels, split
from balsam.operators.baselines import baseline_stratified
from balsam.operators.metrics import attach, macro_metrics
from balsam.operators.text import mask_text
from balsam.plans.registry import query
from balsam.plans.sql import U, W, lits, mask_chain, mask_sequential, normalize_ws, split_flags
from balsam.session import cut_lineage, scratch_path
from balsam.sources import read_csv, write_csv
from balsam.sources.csv import PANDAS_NA_TOKENS
from balsam.sources.tables import labelled_documents, table

SEED = "42"
R6 = 6


def _round(c, n=R6):
    return F.round(c.cast("double"), n)


# ------------------------------------------------------------------ flagship

#: The places, and words that do occur in the given documents.
FLAGSHIP_TERMS = PROVINCE_NAMES + ["the", "of the", "and"]


def flagship(spark, sf_dir):
    """W -> fillna -> mask group names and places -> exact stratified 60/40 split ->
    stratified baseline from training priors -> macro metrics on the test part."""
    w = labelled_documents(spark, sf_dir)
    masked = cut_lineage(mask_text(w, ["text"], location_terms=FLAGSHIP_TERMS))
    flagged = split.stratified_split(masked, test_size=0.4, seed=SEED)
    train = flagged.where(~F.col("is_test"))
    test = flagged.where(F.col("is_test"))
    pred = baseline_stratified(train, test, seed="baseline")
    m = macro_metrics(pred, "target", "prediction")
    digest = masked.agg(F.sum(F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long")).alias("masked_digest"))
    return attach(m, digest).select(*[_round(F.col(c)).alias(c) for c in
                                      ("f1_macro", "precision_macro", "recall_macro", "accuracy")], "n", "masked_digest")


_FLAG_SQL = f"""
WITH s AS {split_flags(W, 0.4, SEED)},
tr AS (SELECT target AS cls, count(*) AS n FROM s WHERE NOT is_test GROUP BY target),
pr AS (SELECT cls, sum(n) OVER (ORDER BY cls) / sum(n) OVER () AS cum FROM tr),
p AS (SELECT s.id, s.target,
        coalesce((SELECT min(cls) FROM pr WHERE pr.cum > {U('baseline', 's.id')}), (SELECT max(cls) FROM pr)) AS prediction
      FROM s WHERE is_test),
lab AS (SELECT target AS l FROM p UNION SELECT prediction FROM p),
per AS (SELECT l,
          count(*) FILTER (WHERE p.target = l AND p.prediction = l) AS tp,
          count(*) FILTER (WHERE p.target = l) AS sup,
          count(*) FILTER (WHERE p.prediction = l) AS pp
        FROM lab, p GROUP BY l),
dig AS (SELECT CAST(sum(('0x' || substr(md5(t), 1, 8))::BIGINT) AS BIGINT) AS d FROM (SELECT {normalize_ws(mask_sequential(
    normalize_ws(mask_chain("coalesce(text, '')", GROUP_NAME_PATTERNS)), FLAGSHIP_TERMS))} AS t FROM {W}))
SELECT round(avg(CASE WHEN sup + pp = 0 THEN 0 ELSE 2.0 * tp / (sup + pp) END), 6) AS f1_macro,
       round(avg(CASE WHEN pp = 0 THEN 0 ELSE tp::DOUBLE / pp END), 6) AS precision_macro,
       round(avg(CASE WHEN sup = 0 THEN 0 ELSE tp::DOUBLE / sup END), 6) AS recall_macro,
       round(sum(tp)::DOUBLE / sum(sup), 6) AS accuracy,
       CAST(sum(sup) AS BIGINT) AS n, (SELECT d FROM dig) AS masked_digest
FROM per
"""

query("flagship_masked_split_baseline", _FLAG_SQL)(flagship)

# ------------------------------------------------------------------ A: sources

_DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@query("csv_scan", f"""SELECT doc_id,
  CASE WHEN text IN ({lits(PANDAS_NA_TOKENS)}) THEN NULL ELSE text END AS text,
  CASE WHEN lang IN ({lits(PANDAS_NA_TOKENS)}) THEN NULL ELSE lang END AS lang,
  CASE WHEN source IN ({lits(PANDAS_NA_TOKENS)}) THEN NULL ELSE source END AS source,
  n_chars FROM documents""")
def q_csv_scan(spark, sf):
    """Documents written as RFC 4180 CSV (quoted line breaks, doubled quotes) to the
    shared scratch folder and scanned back with an explicit schema."""
    path = scratch_path(spark, "csv-scan")
    write_csv(table(spark, sf, "documents", "doc_id", "text", "lang", "source", "n_chars"), path)
    return read_csv(spark, path, _DOC_SCHEMA)


@query("csv_roundtrip", """SELECT event_type, CAST(count(*) AS BIGINT) AS n,
  round(sum(value), 6) AS total_value FROM events GROUP BY event_type""")
def q_csv_roundtrip(spark, sf):
    """A result table through the CSV sink and back."""
    agg = (table(spark, sf, "events", "event_type", "value").groupBy("event_type")
           .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total_value")))
    path = scratch_path(spark, "csv-result")
    write_csv(agg, path)
    return read_csv(spark, path, "event_type string, n long, total_value double")


# ------------------------------------------------------------------ B: projection, order, identity

@query("drop_columns", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def q_drop_columns(spark, sf):
    return clean.drop_columns(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority", "o_orderdate"])


@query("parse_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date FROM orders")
def q_parse_dates(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    s = o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"))
    return clean.parse_dates(s, "order_date", strict=True)


@query("sort_by_date", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date,
  CAST(row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) - 1 AS BIGINT) AS pos FROM orders""")
def q_sort_by_date(spark, sf):
    """Sort by date with the key as tie-break; the position records the order."""
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    o = o.select("o_orderkey", F.to_date("o_orderdate").alias("order_date"))
    return clean.row_positions(o, [F.col("order_date"), F.col("o_orderkey")], "pos")


@query("fill_text", "SELECT doc_id, coalesce(nullif(lang, 'de'), '') AS lang FROM documents")
def q_fill_text(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "lang").withColumn("lang", F.expr("nullif(lang, 'de')"))
    return clean.fill_text(d, "lang")


@query("feature_select", """SELECT vec_id AS id, CAST(len(embedding) + 1 AS INTEGER) AS n_features,
  round(list_sum(CAST(embedding AS DOUBLE[])) + label, 6) AS x_sum, CAST(label = 0 AS INTEGER) AS target
  FROM embeddings""")
def q_feature_select(spark, sf):
    e = table(spark, sf, "embeddings", "vec_id", "embedding", "label").withColumn(
        "target", (F.col("label") == 0).cast("int"))
    fs = clean.feature_select(e, "vec_id", ["embedding", "label"], "target")
    return fs.select("id", F.size("x").alias("n_features"),
                     _round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("x_sum"), "target")


_EXPAND_SQL = "SELECT vec_id, " + ", ".join(
    f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) AS embedding_emb_{i}" for i in range(64)) + " FROM embeddings"


@query("expand_embedding", _EXPAND_SQL)
def q_expand_embedding(spark, sf):
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    wide = clean.expand_embedding(e, "embedding")
    return wide.select("vec_id", *[_round(F.col(c)).alias(c) for c in wide.columns if "_emb_" in c])


@query("optional_columns", f"""SELECT doc_id,
  {normalize_ws(mask_chain("coalesce(text, '')", GROUP_NAME_PATTERNS))} AS text
  FROM documents""")
def q_optional_columns(spark, sf):
    """Mask a column list that names a missing column: it is skipped with a warning."""
    d = table(spark, sf, "documents", "doc_id", "text")
    return mask_text(d, ["text", "notes"], mask_entities=True, mask_locations=False)


@query("exclude_keys", """SELECT event_id, event_type FROM events e WHERE NOT EXISTS (
  SELECT 1 FROM events x WHERE x.event_type = 'error' AND x.value > 50 AND x.user_id = e.user_id)""")
def q_exclude_keys(spark, sf):
    """Drop every event of users listed in an exclusion table derived from the data."""
    ev = table(spark, sf, "events", "event_id", "event_type", "user_id")
    bad = (table(spark, sf, "events", "user_id", "event_type", "value")
           .where((F.col("event_type") == "error") & (F.col("value") > 50)).select("user_id"))
    return clean.exclude_keys(ev, bad, "user_id").select("event_id", "event_type")


DROP_POS = [2, 289, 311]


@query("drop_positions", f"""SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS pos
FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS p0 FROM events)
WHERE p0 NOT IN ({", ".join(map(str, DROP_POS))})""")
def q_drop_positions(spark, sf):
    ev = table(spark, sf, "events", "event_id", "ts")
    kept = clean.drop_positions(ev, [F.col("ts"), F.col("event_id")], DROP_POS)
    return clean.row_positions(kept, [F.col("ts"), F.col("event_id")], "pos").select("event_id", "pos")


@query("row_positions", """SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS pos
FROM events""")
def q_row_positions(spark, sf):
    ev = table(spark, sf, "events", "event_id", "ts")
    return clean.row_positions(ev, [F.col("ts"), F.col("event_id")], "pos").select("event_id", "pos")


@query("class_distribution", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def q_class_distribution(spark, sf):
    return clean.class_distribution(table(spark, sf, "events", "event_type"), "event_type")


@query("head_n", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 10")
def q_head_n(spark, sf):
    return clean.head_n(table(spark, sf, "documents", "doc_id", "lang", "n_chars"), "doc_id", 10)


# ------------------------------------------------------------------ C: labels and flags

ORDER_POLICY = {"F": 0, "O": 1}
ORDER_UNLABELLED = ["P"]


@query("unlabelled_subset", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('P')")
def q_unlabelled_subset(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus")
    return labels.unlabelled_subset(o, "o_orderstatus", ORDER_UNLABELLED)


@query("labelled_subset", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')")
def q_labelled_subset(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus")
    return labels.labelled_subset(o, "o_orderstatus", ORDER_POLICY).select("o_orderkey", "o_orderstatus")


@query("label_policy", """SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS INTEGER)
  AS target FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def q_label_policy(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus")
    lab, _ = labels.curate_labels(o, ORDER_POLICY, ORDER_UNLABELLED, "o_orderstatus")
    return lab.select("o_orderkey", "target")


TAG_VALUES = ['{"k": 1}', '{"k": 2}', '{"k": 3}', '{"k": 4}', '{"k": 5}']


@query("tag_flag", f"""SELECT event_id, CAST(coalesce(nullif(event_type, 'view') = 'error'
  OR (nullif(props, '{{"k": 3}}') IN ({lits(TAG_VALUES)}) AND nullif(props, '{{"k": 3}}') <> '{{"k": 2}}'), false)
  AS INTEGER) AS flag FROM events""")
def q_tag_flag(spark, sf):
    """Whole-string tag flag with an excluded list item and nulls (-> 0)."""
    ev = (table(spark, sf, "events", "event_id", "event_type", "props")
          .withColumn("event_type", F.expr("nullif(event_type, 'view')"))
          .withColumn("props", F.expr("""nullif(props, '{"k": 3}')""")))
    return ev.select("event_id", labels.tag_flag("event_type", "error", "props", TAG_VALUES,
                                                 '{"k": 2}').alias("flag"))


@query("presence_flag", """SELECT event_id, CAST(nullif(props, '{"k": 0}') IS NOT NULL AS INTEGER) AS flag
FROM events""")
def q_presence_flag(spark, sf):
    ev = table(spark, sf, "events", "event_id", "props")
    return ev.select("event_id", labels.presence_flag(F.expr("""nullif(props, '{"k": 0}')""")).alias("flag"))


@query("one_hot", """SELECT event_id,
  CAST(coalesce(nullif(event_type, 'signup') = 'click', false) AS INTEGER) AS event_type_click,
  CAST(coalesce(nullif(event_type, 'signup') = 'error', false) AS INTEGER) AS event_type_error,
  CAST(coalesce(nullif(event_type, 'signup') = 'purchase', false) AS INTEGER) AS event_type_purchase,
  CAST(coalesce(nullif(event_type, 'signup') = 'view', false) AS INTEGER) AS event_type_view
  FROM events""")
def q_one_hot(spark, sf):
    """Categories discovered from the data (sorted); a null row is all zeros."""
    ev = table(spark, sf, "events", "event_id", "event_type").withColumn(
        "event_type", F.expr("nullif(event_type, 'signup')"))
    return labels.one_hot(ev, "event_type")


# ------------------------------------------------------------------ E: splits

@query("stratified_split", f"SELECT id, target, is_test FROM {split_flags(W, 0.4, SEED)}")
def q_stratified_split(spark, sf):
    w = labelled_documents(spark, sf).select("id", "target")
    return split.stratified_split(w, test_size=0.4, seed=SEED)


@query("validation_split", f"""SELECT id, target, is_test AS is_val FROM
  {split_flags(f"(SELECT id, target FROM {split_flags(W, 0.4, SEED)} WHERE NOT is_test)", 0.1, SEED + ':val')}""")
def q_validation_split(spark, sf):
    w = labelled_documents(spark, sf).select("id", "target")
    train, _ = split.train_test(w, test_size=0.4, seed=SEED)
    return split.stratified_split(train, test_size=0.1, seed=SEED + ":val", out="is_val")


_KFOLD_SQL = f"""SELECT id, target, CAST((row_number() OVER (ORDER BY target, {U(SEED, 'id')}, id) - 1) % 5 AS INTEGER)
  AS fold FROM {W}"""


@query("stratified_kfold", _KFOLD_SQL)
def q_stratified_kfold(spark, sf):
    w = labelled_documents(spark, sf).select("id", "target")
    return split.stratified_kfold(w, k=5, seed=SEED)


@query("fold_guard", f"""SELECT fold, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT target) AS BIGINT) AS n_classes,
  count(DISTINCT target) >= 2 AS usable FROM ({_KFOLD_SQL}) GROUP BY fold""")
def q_fold_guard(spark, sf):
    w = labelled_documents(spark, sf).select("id", "target")
    return split.fold_guard(split.stratified_kfold(w, k=5, seed=SEED))


UNDER_N = 500


@query("undersample", f"""SELECT event_id, target FROM (
  SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS target,
    row_number() OVER (PARTITION BY event_type = 'error' ORDER BY {U(SEED, 'event_id')}, event_id) AS rn FROM events)
  WHERE target = 1 OR rn <= {UNDER_N}""")
def q_undersample(spark, sf):
    ev = table(spark, sf, "events", "event_id", "event_type").select(
        "event_id", (F.col("event_type") == "error").cast("int").alias("target"))
    return split.undersample(ev, majority=0, size=UNDER_N, id_col="event_id", seed=SEED)


@query("temporal_split", """SELECT o_orderkey, CAST(o_orderdate AS DATE) >= DATE '1997-01-01' AS is_test FROM orders""")
def q_temporal_split(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate").select(
        "o_orderkey", F.to_date("o_orderdate").alias("d"))
    return split.temporal_split(o, "d", "1997-01-01").select("o_orderkey", "is_test")


@query("grouped_kfold", f"""SELECT event_id, user_id, CAST(floor({U(SEED, 'user_id')} * 5) AS INTEGER) AS fold
FROM events""")
def q_grouped_kfold(spark, sf):
    ev = table(spark, sf, "events", "event_id", "user_id")
    return split.grouped_kfold(ev, "user_id", k=5, seed=SEED)
