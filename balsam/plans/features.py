"""Plans for the README-declared features and analyses (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from balsam.operators import features as FT
from balsam.operators import metrics as M
from balsam.operators import split
from balsam.operators.baselines import baseline_majority, baseline_stratified
from balsam.operators.knn import knn
from balsam.operators.labels import curate_from_actors
from balsam.operators.text import embed_text
from balsam.plans.evaluation import macro_sql
from balsam.plans.registry import query
from balsam.plans.sql import E, U, W, normalize_ws, split_flags
from balsam.plans.text_plans import _TOKS
from balsam.sources.tables import embedding_set, labelled_documents, learnable_set, table

SEED = "42"


def _r(c, n=6):
    return F.round(F.col(c).cast("double"), n).alias(c)


@query("dedupe_exact", f"""SELECT doc_id FROM documents WHERE doc_id IN (
  SELECT min(doc_id) FROM documents GROUP BY lower({normalize_ws('text')}))""")
def q_dedupe_exact(spark, sf):
    """One row per normalised text (smallest key kept)."""
    d = table(spark, sf, "documents", "doc_id", "text")
    return FT.dedupe_exact(d, "text", "doc_id").select("doc_id")


@query("dedupe_near", f"""WITH base AS (SELECT doc_id, {_TOKS} AS ts FROM documents WHERE doc_id IN (
  SELECT min(doc_id) FROM documents GROUP BY lower({normalize_ws('text')}))),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ts) < 3 THEN [array_to_string(ts, ' ')] ELSE
  list_transform(range(len(ts) - 2), lambda i: ts[i + 1] || ' ' || ts[i + 2] || ' ' || ts[i + 3]) END) AS g FROM base),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
p AS (SELECT b.doc_id, a.n AS na, b.n AS nb, count(*) AS c FROM u a JOIN u b ON a.t = b.t AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n)
SELECT doc_id FROM base WHERE doc_id NOT IN (SELECT doc_id FROM p WHERE c >= 0.7 * (na + nb - c))""")
def q_dedupe_near(spark, sf):
    """Exact copies, then MinHash-band near copies verified by Jaccard >= 0.7."""
    d = table(spark, sf, "documents", "doc_id", "text")
    return FT.dedupe_near(d, "text", "doc_id", threshold=0.7).select("doc_id")


@query("tfidf", f"""WITH toks AS (SELECT doc_id, {_TOKS} AS ts FROM documents),
t AS (SELECT doc_id, unnest(ts) AS term FROM toks
      UNION ALL SELECT doc_id, unnest(list_transform(range(len(ts) - 1), lambda i: ts[i + 1] || ' ' || ts[i + 2])) FROM toks),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS nd FROM documents)
SELECT doc_id, term, CAST(tf AS BIGINT) AS tf, round(tf * ln((nd + 1.0) / (df + 1.0)), 6) AS tfidf
FROM tf JOIN dfq USING (term), n""")
def q_tfidf(spark, sf):
    """Unigram + bigram TF-IDF over whole documents (long form)."""
    d = table(spark, sf, "documents", "doc_id", "text")
    return FT.tfidf(d, "text", "doc_id").select("doc_id", "term", "tf", _r("tfidf"))


PHRASES = {"has_of_the": r"(?i)\bof the\b", "has_digit": "[0-9]", "has_question": r"\?",
           "starts_upper": "^[A-Z]"}


@query("phrase_flags", "SELECT doc_id, " + ", ".join(
    f"CAST(coalesce(regexp_matches(text, '{p}'), false) AS INTEGER) AS {n}" for n, p in PHRASES.items())
    + " FROM documents")
def q_phrase_flags(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    return FT.phrase_flags(d, "text", PHRASES).drop("text")


@query("calendar_features", """SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month,
  CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'spring'
       WHEN month(o_orderdate) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season,
  CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS day_of_week,
  CAST(dayofweek(o_orderdate) IN (0, 6) AS INTEGER) AS is_weekend FROM orders""")
def q_calendar_features(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    return FT.calendar_features(o, "o_orderdate").drop("o_orderdate")


PERIODS = [("p1992_93", "1992-01-01", "1994-01-01"), ("p1994_95", "1994-01-01", "1996-01-01"),
           ("p1996_98", "1996-01-01", "1999-01-01"), ("mid1995", "1995-06-01", "1995-09-01")]


@query("period_join", "SELECT o_orderkey, period FROM orders JOIN (VALUES " + ", ".join(
    f"('{n}', TIMESTAMP '{s}', TIMESTAMP '{e}')" for n, s, e in PERIODS)
    + ") p(period, s, e) ON o_orderdate >= p.s AND o_orderdate < p.e")
def q_period_join(spark, sf):
    """Orders in named calendar periods (overlapping periods allowed)."""
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    periods = spark.createDataFrame(PERIODS, "period string, start string, end string").select(
        "period", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"))
    return FT.period_join(o, "o_orderdate", periods).select("o_orderkey", "period")


@query("grid_cell", f"""SELECT id, CAST(floor(x[1] / 0.25) AS BIGINT) AS cell_row, CAST(floor(x[2] / 0.25) AS BIGINT) AS cell_col,
  concat_ws(':', CAST(floor(x[1] / 0.25) AS BIGINT), CAST(floor(x[2] / 0.25) AS BIGINT)) AS cell_id FROM {E}""")
def q_grid_cell(spark, sf):
    """Square grid cell of a 2-D point (first two embedding coordinates)."""
    e = embedding_set(spark, sf).select("id", F.col("x")[0].alias("y"), F.col("x")[1].alias("x"))
    return FT.grid_cell(e, "y", "x", 0.25).select("id", "cell_row", "cell_col", "cell_id")


@query("prior_centroid_distance", """SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS n_prior,
  round(sqrt(pow(value - avg(value) OVER w, 2) + pow(user_id - avg(user_id) OVER w, 2)), 6) AS dist_prior_centroid
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def q_prior_centroid_distance(spark, sf):
    """Distance of each event to the mean (value, user) point of earlier events of its type."""
    ev = table(spark, sf, "events", "event_id", "ts", "event_type", "value", "user_id").withColumn(
        "user_id", F.col("user_id").cast("double"))
    r = FT.prior_centroid_distance(ev, "event_type", [F.col("ts")], "event_id", "value", "user_id")
    return r.select("event_id", F.col("n_prior").cast("long"), _r("dist_prior_centroid"))


SPLITS = [0.0, 1.0, 5.0, 10.0, 50.0, 1e9]


@query("value_buckets", """SELECT event_id, CAST(CASE WHEN value >= 0 AND value < 1 THEN 0 WHEN value >= 1 AND value < 5 THEN 1
  WHEN value >= 5 AND value < 10 THEN 2 WHEN value >= 10 AND value < 50 THEN 3 WHEN value >= 50 AND value <= 1e9 THEN 4 END
  AS INTEGER) AS bucket FROM events""")
def q_value_buckets(spark, sf):
    ev = table(spark, sf, "events", "event_id", "value")
    return FT.value_buckets(ev, "value", SPLITS).select("event_id", "bucket")


@query("repeat_rate", """SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts
  RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)
  - count(*) OVER (PARTITION BY user_id, ts) AS BIGINT) AS n_prior FROM events""")
def q_repeat_rate(spark, sf):
    """Events of the same user in the preceding 24 hours, those of the same time left out."""
    ev = table(spark, sf, "events", "event_id", "user_id", "ts")
    return FT.repeat_count(ev, "user_id", "ts", "event_id", 86400).select("event_id", "n_prior")


ACTOR_POLICY = {"F": 0, "O": 1, "1-URGENT": 1, "5-LOW": 0}


@query("label_curation", """SELECT o_orderkey, CAST(coalesce(a, b) AS INTEGER) AS target FROM (
  SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS a,
         CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 0 END AS b FROM orders)
WHERE (a IS NOT NULL OR b IS NOT NULL) AND (a IS NULL OR b IS NULL OR a = b)""")
def q_label_curation(spark, sf):
    """Label from two actor-like columns; rows whose mapped labels disagree are excluded."""
    o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return curate_from_actors(o, ["o_orderstatus", "o_orderpriority"], ACTOR_POLICY).select("o_orderkey", "target")


_WS = split_flags(W, 0.4, SEED)


@query("baseline_majority", f"""WITH s AS {_WS}
SELECT id, (SELECT arg_max(target, (n, -target)) FROM (SELECT target, count(*) AS n FROM s WHERE NOT is_test GROUP BY target))
  AS prediction FROM s WHERE is_test""")
def q_baseline_majority(spark, sf):
    w = labelled_documents(spark, sf).select("id", "target")
    train, test = split.train_test(w, test_size=0.4, seed=SEED)
    return baseline_majority(train, test).select("id", "prediction")


@query("baseline_stratified", f"""WITH s AS {_WS},
tr AS (SELECT target AS cls, count(*) AS n FROM s WHERE NOT is_test GROUP BY target),
pr AS (SELECT cls, sum(n) OVER (ORDER BY cls) / sum(n) OVER () AS cum FROM tr)
SELECT id, CAST(coalesce((SELECT min(cls) FROM pr WHERE pr.cum > {U('baseline', 's.id')}), (SELECT max(cls) FROM pr)) AS INTEGER)
  AS prediction FROM s WHERE is_test""")
def q_baseline_stratified(spark, sf):
    w = labelled_documents(spark, sf).select("id", "target")
    train, test = split.train_test(w, test_size=0.4, seed=SEED)
    return baseline_stratified(train, test, seed="baseline").select("id", "prediction")


_EMB384 = f"""c AS (SELECT doc_id, (('0x' || substr(md5(tok), 1, 8))::BIGINT) % 384 AS b,
        sum(CASE WHEN ('0x' || substr(md5(tok), 9, 1))::INTEGER < 8 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v
      FROM (SELECT doc_id, unnest({_TOKS}) AS tok FROM documents) GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM c GROUP BY doc_id),
s AS (SELECT doc_id, sum(v / norm) AS s FROM c JOIN n USING (doc_id) WHERE norm > 0 GROUP BY doc_id)"""


@query("early_fusion", f"""WITH {_EMB384}
SELECT d.doc_id, 386 AS n_features, round(coalesce(s.s, 0) + ln(1 + d.n_chars) + CAST(d.lang = 'en' AS INTEGER), 6) AS x_sum
FROM documents d LEFT JOIN s USING (doc_id)""")
def q_early_fusion(spark, sf):
    """Text embedding (384-d hashing) concatenated with structured features."""
    d = table(spark, sf, "documents", "doc_id", "text", "n_chars", "lang")
    emb = embed_text(d, "text", "doc_id", dim=384)
    fused = d.join(emb, "doc_id").select(
        "doc_id", F.concat("embedding", F.array(F.log1p("n_chars"), (F.col("lang") == "en").cast("double"))).alias("x"))
    return fused.select("doc_id", F.size("x").alias("n_features"),
                        F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 6).alias("x_sum"))


_P = "1.0 / (1.0 + exp(-5.0 * x[{}]))"


def _prob(e, d):
    return 1.0 / (1.0 + F.exp(-5.0 * F.col("x")[d]))


@query("late_fusion", f"""SELECT id, round(({_P.format(1)} + {_P.format(2)}) / 2, 6) AS p_fused,
  CAST(({_P.format(1)} + {_P.format(2)}) / 2 >= 0.5 AS INTEGER) AS prediction FROM {E}""")
def q_late_fusion(spark, sf):
    """Two scorers' probabilities averaged after a key join."""
    e = embedding_set(spark, sf)
    a = e.select("id", _prob(e, 0).alias("pa"))
    b = e.select("id", _prob(e, 1).alias("pb"))
    f = FT.late_fusion(a, b, "id", "pa", "pb")
    return f.select("id", F.round("p_fused", 6).alias("p_fused"), (F.col("p_fused") >= 0.5).cast("int").alias("prediction"))


_PS = f"(SELECT id, target, {_P.format(1)} AS p FROM {E})"


def _scored_p(spark, sf):
    e = embedding_set(spark, sf)
    return e.select("id", "target", _prob(e, 0).alias("p"))


@query("brier", f"SELECT round(avg((p - target) * (p - target)), 6) AS brier FROM {_PS}")
def q_brier(spark, sf):
    return FT.brier(_scored_p(spark, sf), "target", "p").select(_r("brier"))


@query("ece", f"""SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM (
  SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(target) AS acc, avg(p) AS conf FROM {_PS} GROUP BY bin)""")
def q_ece(spark, sf):
    return FT.ece(_scored_p(spark, sf), "target", "p").select(_r("ece"))


def _pr_auc_sql(rel):
    return f"""(WITH g AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM {rel} GROUP BY score),
c AS (SELECT pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tps, sum(neg) OVER (ORDER BY score DESC) AS fps,
      sum(pos) OVER () AS tp_all FROM g)
SELECT round(sum(pos * (tps::DOUBLE / (tps + fps) + CASE WHEN tps - pos + fps - neg = 0 THEN 1.0
   ELSE (tps - pos)::DOUBLE / (tps - pos + fps - neg) END) / 2.0) / max(tp_all), 6) AS pr_auc FROM c)"""


@query("pr_auc_per_class", f"""SELECT 1 AS label, (SELECT * FROM {_pr_auc_sql(f"(SELECT p AS score, target AS y FROM {_PS})")}) AS pr_auc
UNION ALL SELECT 0, (SELECT * FROM {_pr_auc_sql(f"(SELECT 1 - p AS score, 1 - target AS y FROM {_PS})")})""")
def q_pr_auc_per_class(spark, sf):
    """One-vs-rest PR AUC per class (class 0 scored by 1 - p)."""
    s = _scored_p(spark, sf)
    a = M.pr_auc(s.select(F.col("target").alias("y"), F.col("p").alias("score")), "y", "score") \
        .select(F.lit(1).alias("label"), _r("pr_auc"))
    b = M.pr_auc(s.select((1 - F.col("target")).alias("y"), (1 - F.col("p")).alias("score")), "y", "score") \
        .select(F.lit(0).alias("label"), _r("pr_auc"))
    return a.unionByName(b)


def _poisson_case(u):
    parts = " ".join(f"WHEN {u} < {c!r}::DOUBLE THEN {i}" for i, c in enumerate(FT.POISSON1_CDF))
    return f"CASE {parts} ELSE {len(FT.POISSON1_CDF)} END"


_BOOT_KEY = "CAST(id AS VARCHAR) || ':' || CAST(rep AS VARCHAR)"


@query("bootstrap_ci", f"""WITH v AS (SELECT id, CAST(CAST(x[1] > 0 AS INTEGER) = target AS DOUBLE) AS v FROM {E}),
r AS (SELECT id, v, unnest(range(50)) AS rep FROM v),
w AS (SELECT rep, v, {_poisson_case(U(SEED, _BOOT_KEY))} AS w FROM r),
st AS (SELECT rep, sum(w * v) / sum(w) AS stat FROM w GROUP BY rep)
SELECT round(avg(stat), 6) AS mean, round(quantile_cont(stat, 0.025), 6) AS lo, round(quantile_cont(stat, 0.975), 6) AS hi,
  CAST(count(*) AS BIGINT) AS replicates FROM st""")
def q_bootstrap_ci(spark, sf):
    """Poisson bootstrap (50 replicates) of the accuracy of a rule model."""
    e = embedding_set(spark, sf)
    v = e.select("id", (((F.col("x")[0] > 0).cast("int")) == F.col("target")).cast("double").alias("v"))
    r = FT.bootstrap_ci(v, "id", "v", replicates=50, seed=SEED)
    return r.select(_r("mean"), _r("lo"), _r("hi"), "replicates")


@query("slice_metrics", f"""WITH s AS {_WS},
tr AS (SELECT target AS cls, count(*) AS n FROM s WHERE NOT is_test GROUP BY target),
pr AS (SELECT cls, sum(n) OVER (ORDER BY cls) / sum(n) OVER () AS cum FROM tr),
pl AS (SELECT s.lang, s.target, CAST(coalesce((SELECT min(cls) FROM pr WHERE pr.cum > {U('baseline', 's.id')}),
        (SELECT max(cls) FROM pr)) AS INTEGER) AS prediction FROM s WHERE is_test)
SELECT lang, round(f1_macro, 6) AS f1_macro, round(accuracy, 6) AS accuracy, n FROM {macro_sql('(SELECT * FROM pl)', ['lang'])}""")
def q_slice_metrics(spark, sf):
    """Macro metrics of the stratified baseline per language slice of the test part."""
    w = labelled_documents(spark, sf).select("id", "target", "lang")
    train, test = split.train_test(w, test_size=0.4, seed=SEED)
    p = baseline_stratified(train, test, seed="baseline")
    m = M.macro_metrics(p, "target", "prediction", ["lang"])
    return m.select("lang", _r("f1_macro"), _r("accuracy"), "n")


_TOP4 = """SELECT CAST(f AS INTEGER) AS {name}, true AS valid, f < 4 AS among_first_four FROM (
  SELECT unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS f)"""


def _ranked(df, name: str, value: str):
    """(name, valid, among_first_four): is the value one of the four largest. A row per coordinate."""
    rows = sorted(((float(r[value]), -int(r[name])) for r in df.select(name, value).collect()), reverse=True)
    top = {-i for _, i in rows[:4]}
    return df.sparkSession.createDataFrame(
        [(-i, -1.0 <= v <= 1.0, -i in top) for v, i in rows], f"{name} int, valid boolean, among_first_four boolean")


@query("feature_importance", _TOP4.format(name="feature"))
def q_feature_importance(spark, sf):
    """Random-forest importances per coordinate; the four that make the target come first."""
    from balsam.operators import train as TR
    tr, _ = split.train_test(learnable_set(spark, sf), test_size=0.4, seed=SEED)
    model = TR.fit_pipeline(tr, "rfc")
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return _ranked(spark.createDataFrame(list(enumerate(float(v) for v in imp)), "feature int, importance double"),
                   "feature", "importance")


@query("exemplars", f"""WITH s AS {split_flags(E, 0.4, SEED)},
nn AS (SELECT a.id AS q_id, b.id AS nn_id,
  row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS rk
  FROM (SELECT * FROM s WHERE is_test) a JOIN (SELECT * FROM s WHERE NOT is_test) b ON TRUE QUALIFY rk <= 3)
SELECT q_id, CAST(rk AS INTEGER) AS rank, nn_id FROM nn""")
def q_exemplars(spark, sf):
    """The 3 nearest training rows of every test row (evidence for a prediction)."""
    e = embedding_set(spark, sf)
    tr, te = split.train_test(e, test_size=0.4, seed=SEED)
    return knn(te, tr, 3, exclude_self=False).select("q_id", "rank", "nn_id")


_AUDIT_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
_AUDIT_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
                "o_totalprice": "double", "o_orderpriority": "string"}


@query("schema_audit", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{_AUDIT_TYPES[c]}' AS type, CAST(count(*) - count({c}) AS BIGINT) AS nulls,
  CAST(count(DISTINCT {c}) AS BIGINT) AS "distinct", CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max
  FROM orders""" for c in _AUDIT_COLS))
def q_schema_audit(spark, sf):
    return FT.schema_audit(table(spark, sf, "orders", *_AUDIT_COLS))


@query("class_by_period", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus, CAST(count(*) AS BIGINT) AS n
FROM orders GROUP BY ALL""")
def q_class_by_period(spark, sf):
    o = table(spark, sf, "orders", "o_orderdate", "o_orderstatus")
    return o.groupBy(F.year("o_orderdate").alias("year"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("missing_text_sensitivity", f"""WITH s AS {_WS},
tr AS (SELECT target AS cls, count(*) AS n FROM s WHERE NOT is_test GROUP BY target),
pr AS (SELECT cls, sum(n) OVER (ORDER BY cls) / sum(n) OVER () AS cum FROM tr),
pl AS (SELECT length(s.text) < 1000 AS short_text, s.target,
        CAST(coalesce((SELECT min(cls) FROM pr WHERE pr.cum > {U('baseline', 's.id')}),
        (SELECT max(cls) FROM pr)) AS INTEGER) AS prediction FROM s WHERE is_test)
SELECT short_text, round(f1_macro, 6) AS f1_macro, round(recall_macro, 6) AS recall_macro, n
FROM {macro_sql('(SELECT * FROM pl)', ['short_text'])}""")
def q_missing_text_sensitivity(spark, sf):
    """Macro metrics on the test part split by scarce (short) versus full text."""
    w = labelled_documents(spark, sf).select("id", "target", (F.length("text") < 1000).alias("short_text"))
    train, test = split.train_test(w, test_size=0.4, seed=SEED)
    p = baseline_stratified(train, test, seed="baseline")
    m = M.macro_metrics(p, "target", "prediction", ["short_text"])
    return m.select("short_text", _r("f1_macro"), _r("recall_macro"), "n")


@query("permutation_importance", _TOP4.format(name="dim"))
def q_permutation_importance(spark, sf):
    """Macro-F1 drop per permuted coordinate, all coordinates in one pass; the four that make the
    target come first."""
    from balsam.operators import train as TR
    e = learnable_set(spark, sf)
    tr, te = split.train_test(e, test_size=0.4, seed=SEED)
    model = TR.fit_pipeline(tr, "lr")
    dims = int(e.select(F.max(F.size("x"))).first()[0])
    return _ranked(FT.permutation_importance(model, te, dims, seed=SEED), "dim", "importance")
