"""Plans for calibration (J15), stacking (J14), temporal and grouped folds (J11) and hold-outs (J17)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from balsam.operators import calibrate as C
from balsam.operators import drift as DR
from balsam.operators import ensemble as EN
from balsam.operators import split
from balsam.operators.asof import nearest_milestones
from balsam.operators.text import embed_text
from balsam.plans.registry import query
from balsam.plans.sql import E, U
from balsam.sources.tables import embedding_set, labelled_documents, learnable_set, table

SEED = "42"
_P = "1.0 / (1.0 + exp(-5.0 * x[1]))"
_PS = f"(SELECT id, target, 5.0 * x[1] AS z, {_P} AS p FROM {E})"


def _scored(spark, sf):
    z = 5.0 * F.col("x")[0]
    return embedding_set(spark, sf).select("id", "target", z.alias("z"), (1.0 / (1.0 + F.exp(-z))).alias("p"))


# max over a <= i of the min over b >= i of the mean of a..b
@query("isotonic", f"""WITH s AS (SELECT p, sum(target) AS y, count(*) AS n FROM {_PS} GROUP BY p),
i AS (SELECT *, row_number() OVER (ORDER BY p) AS k, sum(y) OVER (ORDER BY p) AS cy, sum(n) OVER (ORDER BY p) AS cn FROM s),
m AS (SELECT a.k AS a, b.k AS b, (b.cy - a.cy + a.y)::DOUBLE / (b.cn - a.cn + a.n) AS v FROM i a JOIN i b ON a.k <= b.k),
r AS (SELECT a, b AS k, min(v) OVER (PARTITION BY a ORDER BY b DESC) AS v FROM m),
f AS (SELECT k, max(v) AS value FROM r GROUP BY k)
SELECT id, round(value, 6) AS calibrated FROM {_PS} JOIN i USING (p) JOIN f USING (k)""")
def q_isotonic(spark, sf):
    """Scores of a rule calibrated by isotonic regression."""
    rows = _scored(spark, sf)
    steps = C.isotonic_fit(rows, "target", "p")
    return C.isotonic_apply(rows, steps, "p").select("id", F.round("calibrated", 6).alias("calibrated"))


@query("platt", f"""WITH RECURSIVE f AS (SELECT 0 AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL
  SELECT k + 1, a - (bb * ga - ab * gb) / (aa * bb - ab * ab), b - (aa * gb - ab * ga) / (aa * bb - ab * ab) FROM (
    SELECT k, a, b, sum((q - target) * z) AS ga, sum(q - target) AS gb, sum(q * (1 - q) * z * z) + 1e-6 AS aa,
           sum(q * (1 - q)) + 1e-6 AS bb, sum(q * (1 - q) * z) AS ab
    FROM (SELECT k, a, b, target, z, 1 / (1 + exp(-(a * z + b))) AS q FROM f, {_PS} WHERE k < 8) GROUP BY k, a, b))
SELECT id, round(1 / (1 + exp(-(a * z + b))), 6) AS calibrated FROM {_PS}, f WHERE k = 8""")
def q_platt(spark, sf):
    """The same scores by Platt scaling, eight Newton steps."""
    rows = _scored(spark, sf)
    a, b = C.platt_fit(rows, "target", "z")
    return rows.select("id", F.round(C.platt_apply(F.col("z"), a, b), 6).alias("calibrated"))


_CUTS = ["1996-06-01", "1998-01-01", "2000-01-01"]


@query("expanding_windows", f"""WITH w AS (SELECT i AS "window", c[i + 1]::DATE AS a, c[i + 2]::DATE AS b
  FROM (SELECT unnest(range({len(_CUTS)})) AS i, [{', '.join(repr(c) for c in _CUTS)}, NULL] AS c))
SELECT CAST("window" AS INTEGER) AS "window", o_orderdate >= a AS is_test, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys
FROM orders JOIN w ON b IS NULL OR o_orderdate < b GROUP BY ALL""")
def q_expanding_windows(spark, sf):
    """Temporal cross-validation with growing training parts: sizes and key sums of all parts."""
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    w = EN.expanding_windows(o, "o_orderdate", [datetime.date.fromisoformat(c) for c in _CUTS])
    return w.groupBy("window", "is_test").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


_ZEROS = "[0, 0, 0, 0, 0]::BIGINT[]"


@query("balanced_group_folds", f"""WITH RECURSIVE g AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS positives
  FROM events GROUP BY user_id),
lim AS (SELECT CAST(sum(n) AS BIGINT) // {EN.LARGE} AS l FROM g),
big AS (SELECT user_id, n, positives, row_number() OVER (ORDER BY n DESC, positives DESC, user_id) AS rk FROM g, lim WHERE n > l),
st AS (SELECT 0::BIGINT AS rk, NULL::BIGINT AS user_id, -1::BIGINT AS fold, {_ZEROS} AS lp, {_ZEROS} AS ln
  UNION ALL SELECT rk, user_id, f, list_transform(range(5), lambda i: lp[i + 1] + CASE WHEN i = f THEN positives ELSE 0 END),
    list_transform(range(5), lambda i: ln[i + 1] + CASE WHEN i = f THEN n ELSE 0 END) FROM (
    SELECT big.rk, big.user_id, big.n, big.positives, lp, ln, list_sort(list_transform(range(5), lambda i: CASE WHEN big.positives > 0
      THEN {{'a': lp[i + 1], 'b': ln[i + 1], 'c': i}} ELSE {{'a': ln[i + 1], 'b': i, 'c': i}} END))[1].c AS f
    FROM st JOIN big ON big.rk = st.rk + 1)),
small AS (SELECT user_id, (row_number() OVER (ORDER BY CAST(positives > 0 AS INTEGER), {U(SEED, 'user_id')}, user_id) - 1) % 5 AS fold
  FROM g, lim WHERE n <= l)
SELECT user_id, CAST(fold AS INTEGER) AS fold, n, positives FROM (SELECT user_id, fold FROM st WHERE rk > 0 UNION ALL SELECT * FROM small) JOIN g USING (user_id)""")
def q_balanced_group_folds(spark, sf):
    """Users dealt to five folds, balanced in rows and in errors."""
    ev = table(spark, sf, "events", "user_id", "event_type")
    rows = ev.select("user_id", (F.col("event_type") == "error").cast("int").alias("target"))
    return EN.balanced_group_folds(rows, "user_id", k=5, seed=SEED)


@query("model_stack")
def q_model_stack(spark, sf):
    """A forest and a logistic regression stacked by out-of-fold scores: test predictions."""
    train, test = split.train_test(learnable_set(spark, sf), test_size=0.4, seed=SEED)
    return EN.Stack(train, ["lr", "rfc"], k=3).predict_proba(test).select("id", "target", "prediction", "score")


@query("out_of_fold_scores")
def q_out_of_fold_scores(spark, sf):
    """The second level's inputs: each row's score by a model of the other folds."""
    return EN.out_of_fold(learnable_set(spark, sf), ["lr"], k=3)


@query("hold_out_gaps")
def q_hold_out_gaps(spark, sf):
    """Each language held out: metrics there, on the others, and the gap."""
    w = labelled_documents(spark, sf)
    emb = embed_text(w, "text", "id", dim=64, out="x")
    return EN.hold_outs(w.select("id", "target", "lang").join(emb, "id"), "lang")


@query("nearest_milestones", """WITH m AS (SELECT o_orderpriority AS pr, min(o_orderdate)::DATE AS d FROM orders
  GROUP BY o_orderpriority, year(o_orderdate))
SELECT o_orderkey, CAST(date_diff('day', (SELECT max(d) FROM m WHERE pr = o_orderpriority AND d <= o_orderdate), o_orderdate::DATE) AS INTEGER) AS since,
  CAST(date_diff('day', o_orderdate::DATE, (SELECT min(d) FROM m WHERE pr = o_orderpriority AND d > o_orderdate)) AS INTEGER) AS until
FROM orders""")
def q_nearest_milestones(spark, sf):
    """Days since and until the nearest milestone of an order's priority, its first order of each year."""
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_orderpriority").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    m = o.groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.min("o_orderdate").alias("d"))
    r = nearest_milestones(o, m, "o_orderdate", "d", ["o_orderpriority"])
    return r.select("o_orderkey", F.datediff("o_orderdate", "previous").alias("since"), F.datediff("next", "o_orderdate").alias("until"))


_SHARES = """WITH c AS (SELECT year(o_orderdate) AS period, unnest([{'column': 'o_orderpriority', 'value': o_orderpriority},
  {'column': 'o_orderstatus', 'value': o_orderstatus}], recursive := true) FROM orders),
s AS (SELECT "column", period, value, n / sum(n) OVER (PARTITION BY "column", period) AS share
      FROM (SELECT "column", period, value, count(*)::DOUBLE AS n FROM c GROUP BY "column", period, value)),
k AS (SELECT DISTINCT a."column", a.period, b.value FROM s a JOIN s b ON a."column" = b."column" AND b.period IN (a.period, 1995) WHERE a.period <> 1995),
v AS (SELECT k."column", k.period, coalesce(p.share, 0) + 1e-6 AS p, coalesce(q.share, 0) + 1e-6 AS q FROM k
  LEFT JOIN s p ON p."column" = k."column" AND p.value = k.value AND p.period = 1995
  LEFT JOIN s q ON q."column" = k."column" AND q.value = k.value AND q.period = k.period)"""


@query("category_drift", f"""{_SHARES}
SELECT "column", CAST(period AS INTEGER) AS period, round(sum((q - p) * ln(q / p)), 6) AS psi,
  round(sum(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2, 6) AS js FROM v GROUP BY "column", period""")
def q_category_drift(spark, sf):
    """Order priorities and states of each year against 1995."""
    o = table(spark, sf, "orders", "o_orderdate", "o_orderpriority", "o_orderstatus").withColumn("year", F.year("o_orderdate"))
    d = DR.category_drift(o, ["o_orderpriority", "o_orderstatus"], "year", 1995)
    return d.select("column", "period", F.round("psi", 6).alias("psi"), F.round("js", 6).alias("js"))


@query("numeric_drift")
def q_numeric_drift(spark, sf):
    """Order prices of each year against 1995, from one quantile sketch a year."""
    o = table(spark, sf, "orders", "o_orderdate", "o_totalprice").withColumn("year", F.year("o_orderdate"))
    return DR.numeric_drift(DR.sketches(o, ["o_totalprice"], "year"), 1995)
