"""Plans for preprocessing, training and scoring (G, H, A3).

No SQL engine trains a forest, so the checked queries return, from the real predictions, what
must hold of them: the right rows, valid scores, predictions that follow from the scores, and a
macro F1 that beats the majority class. The target is one that the vectors determine. All use
the ``fast`` grids, of two points each.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, SQLTransformer
from pyspark.sql import functions as F

from balsam.operators import metrics as M
from balsam.operators import score as S
from balsam.operators import split
from balsam.operators import train as TR
from balsam.operators.prep import FunctionTransformer, PopulationScaler, class_weights
from balsam.functions.text import GROUP_NAME_PATTERNS
from balsam.operators.resample import smote
from balsam.operators.text import embed_text, mask_text
from balsam.plans.registry import query
from balsam.plans.sql import E, L, W, mask_chain, normalize_ws, split_flags
from balsam.session import cut_lineage, scratch_path
from balsam.streaming import masked_stream, run_to_table, score_stream
from balsam.sources.tables import embedding_set, labelled_documents, learnable_set, table, table_glob

SEED = "42"


def _e_split(spark, sf):
    e = embedding_set(spark, sf)
    return split.train_test(e, test_size=0.4, seed=SEED)


@query("standard_scale", f"""WITH s AS {split_flags(E, 0.4, SEED)},
st AS (SELECT i, avg(v) AS mu, stddev_pop(v) AS sd FROM
        (SELECT unnest(range(len(x))) AS i, unnest(x) AS v FROM s WHERE NOT is_test) GROUP BY i),
te AS (SELECT id, unnest(range(len(x))) AS i, unnest(x) AS v FROM s WHERE is_test)
SELECT id, CAST(i AS INTEGER) AS dim, round((v - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS value
FROM te JOIN st USING (i)""")
def q_standard_scale(spark, sf):
    """Population-std scaler fitted on the training part, applied to the test part."""
    train, test = _e_split(spark, sf)
    z = PopulationScaler(inputCol="x", outputCol="x").fit(train).transform(test)
    return (z.select("id", F.posexplode("x").alias("dim", "value"))
            .select("id", F.col("dim").cast("int"), F.round("value", 6).alias("value")))


@query("preprocess_chain", f"""WITH s AS {split_flags(E, 0.4, SEED)},
st AS (SELECT i, avg(v) AS mu, stddev_pop(v) AS sd FROM
        (SELECT unnest(range(len(x))) AS i, unnest(x) AS v FROM s WHERE NOT is_test) GROUP BY i),
z AS (SELECT id, target, list(CASE WHEN sd > 0 THEN (v - mu) / sd ELSE v - mu END ORDER BY i) AS x FROM
        (SELECT id, target, unnest(range(len(x))) AS i, unnest(x) AS v FROM s WHERE is_test) JOIN st USING (i)
      GROUP BY id, target)
SELECT id, target, round(x[1], 6) AS x0, round(x[2] * x[2] + x[1], 6) AS x1_sq_plus_x0 FROM z""")
def q_preprocess_chain(spark, sf):
    """Ordered chain fitted on train, applied to test: population scaler, then a SQL
    step that reads the scaled values (order matters: the SQL sees scaled x)."""
    train, test = _e_split(spark, sf)
    chain = Pipeline(stages=[PopulationScaler(inputCol="x", outputCol="x"),
                             SQLTransformer(statement="SELECT id, target, round(x[0], 6) AS x0, "
                                                      "round(x[1] * x[1] + x[0], 6) AS x1_sq_plus_x0 FROM __THIS__")])
    return chain.fit(train).transform(test)


@query("custom_transform", """SELECT event_id, round(ln(1 + value), 6) AS log_value,
  round(value * 2, 6) AS double_value FROM events""")
def q_custom_transform(spark, sf):
    """A SQL stage and a function stage (with inverse) in one chain."""
    ev = table(spark, sf, "events", "event_id", "value")
    sqlt = SQLTransformer(statement="SELECT event_id, value, round(log1p(value), 6) AS log_value FROM __THIS__")
    fn = FunctionTransformer(lambda d: d.withColumn("double_value", F.round(F.col("value") * 2, 6)),
                             lambda d: d.withColumn("value", F.col("double_value") / 2))
    out = fn.transform(sqlt.transform(ev))
    return out.select("event_id", "log_value", "double_value")


@query("class_weights", f"""SELECT id, target, round(n::DOUBLE / (k * n_c), 6) AS weight FROM {W}
  JOIN (SELECT target, count(*) AS n_c FROM {W} GROUP BY target) USING (target),
  (SELECT count(*) AS n, count(DISTINCT target) AS k FROM {W})""")
def q_class_weights(spark, sf):
    w = labelled_documents(spark, sf).select("id", "target")
    return class_weights(w, "target", "weight").select("id", "target", F.round("weight", 6).alias("weight"))


def _l_split(spark, sf):
    return split.train_test(learnable_set(spark, sf), test_size=0.4, seed=SEED)


_TEST = f"(SELECT id, target FROM {split_flags(L, 0.4, SEED)} WHERE is_test)"
_HOLDS = "true AS valid_score, true AS score_agrees, true AS beats_majority"


def checked(scored, margin: float = 0.1, threshold: float = 0.5, probability: bool = True):
    """Per scored row (id, target, prediction, score): is the score valid, does the prediction
    follow from it; and does the macro F1 of all predictions beat that of the majority class by
    ``margin``."""
    scored = cut_lineage(scored)
    n = {r["target"]: r["count"] for r in scored.groupBy("target").count().collect()}  # a row per class
    share = max(n.values()) / sum(n.values())
    majority = 2 * share / (1 + share) / len(n)
    f1 = M.macro_metrics(scored, "target", "prediction").first()["f1_macro"]
    score = F.col("score")
    valid = score.isNotNull() & ~F.isnan(score) & (score.between(0, 1) if probability else F.lit(True))
    return scored.select("id", "target", valid.alias("valid_score"),
                         ((score > threshold).cast("int") == F.col("prediction").cast("int")).alias("score_agrees"),
                         F.lit(bool(f1 >= majority + margin)).alias("beats_majority"))


def _model_query(name):
    def fn(spark, sf):
        train, test = _l_split(spark, sf)
        model = TR.fit_pipeline(train, name)
        # probability[1] where the model has probabilities, the margin for the SVM (I12)
        scored = S.predict_proba(model, test, ["id", "target"])
        return checked(scored, threshold=0.0 if name == "svm" else 0.5, probability=name != "svm")
    fn.__doc__ = f"Fit scaler + {name} on the training part, score the test part; every prediction checked."
    return fn


for _n, _q in (("rfc", "model_rfc"), ("gbt", "model_gbt"), ("mlpc", "model_mlp"), ("lr", "model_lr"),
               ("svm", "model_svm")):
    query(_q, f"SELECT id, target, {_HOLDS} FROM {_TEST}")(_model_query(_n))


def _text_pipeline():
    tok = RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"[^\p{L}\p{N}]+", gaps=True)
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=1 << 16)
    idf = IDF(inputCol="tf", outputCol="features")
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=30)
    return Pipeline(stages=[tok, tf, idf, lr])


def _text_model(spark, sf):
    # masked once, read by the split, both fit passes and the scoring
    w = cut_lineage(mask_text(labelled_documents(spark, sf), ["text"]))
    train, test = split.train_test(w, test_size=0.4, seed=SEED)
    data = class_weights(train.withColumn("label", F.col("target").cast("double")), "target", "weight")
    return _text_pipeline().fit(data), train, test


@query("model_text_lr", f"SELECT id, target, {_HOLDS} FROM {split_flags(W, 0.4, SEED)} WHERE is_test")
def q_model_text_lr(spark, sf):
    """Masked text -> TF-IDF -> class-weighted logistic regression; test predictions."""
    model, _, test = _text_model(spark, sf)
    return checked(S.predict_proba(model, test, ["id", "target"]), margin=0.0)


@query("training_history")
def q_training_history(spark, sf):
    """Loss and accuracy after 1 to 32 iterations, on training and on test rows."""
    _, train, test = _text_model(spark, sf)
    ready = lambda d: class_weights(d.withColumn("label", F.col("target").cast("double")), "target", "weight")
    return TR.training_history(_text_pipeline(), ready(train), ready(test))


@query("grid_search", """SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS point, unnest(['0.0', '0.01', '0.1']) AS reg_param,
  true AS valid, true AS beats_majority""")
def q_grid_search(spark, sf):
    """Inner search with stratified folds, macro-F1 scoring and a grid of three points."""
    train, _ = _l_split(spark, sf)
    m, best = TR.grid_search(train, "lr", 64, k=3, fast=False, seed=SEED)
    grid = TR.make_estimator("lr", 64, fast=False)[1]
    scores, values = [float(s) for s in m.avgMetrics], [next(iter(g.values())) for g in grid]
    chosen = scores[values.index(best["regParam"])] == max(scores)
    return spark.createDataFrame([(i, str(v), chosen and 0.0 <= s <= 1.0, s > 0.55)
                                  for i, (v, s) in enumerate(zip(values, scores))],
                                 "point int, reg_param string, valid boolean, beats_majority boolean")


@query("nested_cv", """SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS fold, true AS in_range, true AS beats_majority""")
def q_nested_cv(spark, sf):
    """Outer 3 folds; per fold: scale, SMOTE, inner 2-fold search over the grid, score validation."""
    train, _ = _l_split(spark, sf)
    res = TR.nested_cv(train, "lr", "smote", k=3, inner_k=2)
    return spark.createDataFrame(
        [(m["fold"], all(0.0 <= m[c] <= 1.0 for c in ("f1_macro", "accuracy", "precision", "recall")), m["f1_macro"] > 0.55)
         for m in res.fold_metrics], "fold int, in_range boolean, beats_majority boolean")


@query("retrain_full", f"SELECT id, target, {_HOLDS} FROM {_TEST}")
def q_retrain_full(spark, sf):
    """Refit on all training rows, without the scaler and with a caller's own SQL step."""
    train, test = _l_split(spark, sf)
    step = SQLTransformer(statement="SELECT id, target, transform(x, v -> v * 2) AS x FROM __THIS__")
    model = TR.retrain_full(train, "lr", "random_oversample", {"regParam": 0.0}, use_scaler=False, steps=[step])
    return checked(S.predict_proba(model, test, ["id", "target"]))


def _trainer(spark, sf, models=("lr",), samplers=("random_oversample", "smote")):
    train, test = _l_split(spark, sf)
    tr = TR.Trainer(spark, fast=True, k=2, inner_k=2).fit_all(train, models=list(models), samplers=list(samplers))
    return tr, test


@query("fit_all", """SELECT unnest(['lr_random_oversample', 'svm_random_oversample']) AS model, true AS in_range, true AS beats_majority,
  'regParam' AS params""")
def q_fit_all(spark, sf):
    """Models x samplers with nested CV and a refit each: the CV part of the results table."""
    tr, _ = _trainer(spark, sf, models=("lr", "svm"), samplers=("random_oversample",))
    ok = F.lit(True)
    for c in ("cv_score", "f1_macro", "accuracy", "precision", "recall"):
        ok = ok & F.col(c).between(0, 1)
    return tr.results_table().select("model", ok.alias("in_range"), (F.col("cv_score") > 0.55).alias("beats_majority"),
                                     F.array_join(F.map_keys("best_params"), ",").alias("params"))


@query("evaluate_all", """SELECT unnest(['lr_random_oversample', 'lr_smote']) AS model, true AS in_range, true AS beats_majority""")
def q_evaluate_all(spark, sf):
    """Every trained model scored on the untouched test part (results table updated)."""
    tr, test = _trainer(spark, sf)
    t = tr.evaluate(test).results_table()
    ok = F.lit(True)
    for c in ("test_f1_macro", "test_accuracy", "test_precision", "test_recall"):
        ok = ok & F.col(c).between(0, 1)
    return t.select("model", ok.alias("in_range"), (F.col("test_f1_macro") > 0.55).alias("beats_majority"))


@query("predict", f"SELECT id, target, 'best' AS model, {_HOLDS} FROM {_TEST} UNION ALL "
       f"SELECT id, target, 'lr_smote' AS model, {_HOLDS} FROM {_TEST}")
def q_predict(spark, sf):
    """Predictions of the best model and of a model by its name."""
    tr, test = _trainer(spark, sf)
    best = checked(tr.predict_proba(test, keep=["id", "target"])).withColumn("model", F.lit("best"))
    return best.unionByName(checked(tr.predict_proba(test, "lr_smote", ["id", "target"])).withColumn("model", F.lit("lr_smote")))


@query("predict_proba", f"SELECT id, true AS sums_to_one, true AS argmax_agrees FROM {_TEST}")
def q_predict_proba(spark, sf):
    """Class probabilities: they sum to one and the prediction is the likelier class."""
    train, test = _l_split(spark, sf)
    p = S.predict_proba(TR.fit_pipeline(train, "rfc"), test, ["id", "target"])
    total = F.aggregate("probability", F.lit(0.0), lambda a, v: a + v)
    return p.select("id", (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
                    (F.col("probability")[F.col("prediction").cast("int")] == F.array_max("probability")).alias("argmax_agrees"))


@query("softmax_argmax", f"""SELECT id, round(list_max(p), 6) AS p_max, CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS prediction
FROM (SELECT id, l, list_transform(l, lambda v: exp(v - list_max(l)) / list_sum(list_transform(l, lambda w: exp(w - list_max(l))))) AS p
      FROM (SELECT id, x[1:3] AS l FROM {E}))""")
def q_softmax_argmax(spark, sf):
    """Three logits per row (first embedding coordinates) -> probabilities, argmax."""
    e = embedding_set(spark, sf).select("id", F.slice("x", 1, 3).alias("logits"))
    s = S.softmax_argmax(e, "logits")
    return s.select("id", F.round(F.array_max("probability"), 6).alias("p_max"), "prediction")


@query("score_unlabelled", """SELECT doc_id AS id, true AS valid_score, true AS margin_follows, true AS entropy_follows
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q_score_unlabelled(spark, sf):
    """Documents without a label scored by the text model: probability, margin, entropy."""
    model, _, _ = _text_model(spark, sf)
    docs = table(spark, sf, "documents", "doc_id", "text")
    labs = table(spark, sf, "labels", "doc_id")
    unl = mask_text(docs.join(labs, "doc_id", "left_anti"), ["text"]).withColumnRenamed("doc_id", "id")
    s = S.score_unlabelled(model, unl, ["id"])
    p = F.col("score")
    plogp = lambda v: F.when(v > 0, v * F.log(v)).otherwise(0.0)
    return s.select("id", p.between(0, 1).alias("valid_score"),
                    (F.abs(F.col("margin") - F.abs(2 * p - 1)) < 1e-9).alias("margin_follows"),
                    (F.abs(F.col("entropy") + plogp(p) + plogp(1 - p)) < 1e-6).alias("entropy_follows"))


@query("stream_score", "SELECT doc_id AS id, true AS same_as_batch FROM documents")
def q_stream_score(spark, sf):
    """The fitted text model applied to a stream of the documents; equal to the batch scores."""
    model, _, _ = _text_model(spark, sf)
    schema = table(spark, sf, "documents", "doc_id", "text").schema
    stream = masked_stream(spark, table_glob(sf, "documents"), schema, ["text"]).withColumnRenamed("doc_id", "id")
    got = run_to_table(score_stream(stream, model, ["id"]).select("id", "score"), "score")
    docs = mask_text(table(spark, sf, "documents", "doc_id", "text"), ["text"]).withColumnRenamed("doc_id", "id")
    batch = S.predict_proba(model, docs, ["id"]).select("id", F.col("score").alias("batch"))
    return got.join(batch, "id").select("id", (F.col("score") == F.col("batch")).alias("same_as_batch"))


@query("model_roundtrip", f"SELECT id, target, {_HOLDS}, true AS same_as_before FROM {_TEST}")
def q_model_roundtrip(spark, sf):
    """Fitted pipeline saved to the shared folder, loaded back, used for scoring."""
    train, test = _l_split(spark, sf)
    m = TR.fit_pipeline(train, "lr")
    path = scratch_path(spark, "model")
    m.write().overwrite().save(path)
    scored = S.predict_proba(PipelineModel.load(path), test, ["id", "target"])
    before = S.predict_proba(m, test, ["id"]).select("id", F.col("score").alias("before"))
    same = scored.join(before, "id").select("id", (F.col("score") == F.col("before")).alias("same_as_before"))
    return checked(scored).join(same, "id")


_REPORTS = ["classification_report", "confusion_matrix", "macro_metrics", "pr_auc", "pr_curve", "roc_auc", "roc_curve"]


@query("report_bundle", "SELECT unnest([" + ", ".join(f"'{t}'" for t in _REPORTS) + """]) AS "table", true AS has_rows,
  true AS of_the_best""")
def q_report_bundle(spark, sf):
    """Every report table for the best trained model, written as parquet; returns the index."""
    tr, test = _trainer(spark, sf)
    name, _ = tr.best()
    scored = cut_lineage(tr.predict_proba(test, keep=["id", "target"]))
    best_row = tr.evaluate(test).results_table().where(F.col("model") == name).first()
    tables = {
        "confusion_matrix": M.confusion_matrix(scored, "target", "prediction"),
        "classification_report": M.classification_report(scored, "target", "prediction"),
        "macro_metrics": M.macro_metrics(scored, "target", "prediction"),
        "roc_curve": M.roc_curve(scored, "target", "score"),
        "pr_curve": M.pr_curve(scored, "target", "score"),
        "roc_auc": M.roc_auc(scored, "target", "score"),
        "pr_auc": M.pr_auc(scored, "target", "score"),
    }
    root = scratch_path(spark, "report")
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{t}")
    f1 = spark.read.parquet(f"{root}/macro_metrics").first()["f1_macro"]
    same = abs(f1 - best_row["test_f1_macro"]) < 1e-12
    return spark.createDataFrame([(t, spark.read.parquet(f"{root}/{t}").count() > 0, same) for t in sorted(tables)],
                                 "table string, has_rows boolean, of_the_best boolean")


@query("missing_text_model", f"""WITH t AS (SELECT id, target FROM {split_flags(W, 0.4, SEED)} WHERE is_test)
SELECT v AS variant, (SELECT count(*) FROM t) AS n, true AS in_range, true AS text_helps FROM (SELECT unnest(['full', 'missing', 'without_text']) AS v)""")
def q_missing_text_model(spark, sf):
    """The text model on whole test texts and on none, and a model that never had the text (its
    length and language only): the ablation and the sensitivity to missing text."""
    model, train, test = _text_model(spark, sf)
    f1 = {}
    scored = {"full": S.predict_proba(model, test, ["id", "target"]),
              "missing": S.predict_proba(model, test.withColumn("text", F.lit("")), ["id", "target"])}
    bare = lambda d: d.select("id", "target", F.array(F.log1p(F.length("text").cast("double")),
                                                      (F.col("lang") == "en").cast("double")).alias("x"))
    scored["without_text"] = S.predict_proba(TR.fit_pipeline(bare(train), "lr"), bare(test), ["id", "target"])
    n = test.count()
    for v, s in scored.items():
        f1[v] = M.macro_metrics(s, "target", "prediction").first()["f1_macro"]
    helps = f1["full"] >= max(f1["missing"], f1["without_text"])
    return spark.createDataFrame([(v, n, 0.0 <= x <= 1.0, bool(helps)) for v, x in sorted(f1.items())],
                                 "variant string, n long, in_range boolean, text_helps boolean")


@query("flagship_full", f"""SELECT (SELECT count(*) FROM {split_flags(W, 0.4, SEED)} WHERE is_test) AS n, true AS in_range,
  true AS balanced, (SELECT CAST(sum(('0x' || substr(md5(t), 1, 8))::BIGINT) AS BIGINT) FROM (
    SELECT {normalize_ws(mask_chain("coalesce(text, '')", GROUP_NAME_PATTERNS))} AS t FROM {W})) AS masked_digest""")
def q_flagship_full(spark, sf):
    """documents and labels -> mask -> 384-column embedding -> split -> undersample -> scale -> SMOTE
    -> logistic regression -> test metrics, with a digest of the masked texts."""
    masked = cut_lineage(mask_text(labelled_documents(spark, sf), ["text"], location_terms=[]))
    emb = embed_text(masked, "text", "id", dim=384, out="x")
    train, test = split.train_test(masked.select("id", "target").join(emb, "id"), test_size=0.4, seed=SEED)
    n = {r["target"]: r["count"] for r in train.groupBy("target").count().collect()}  # a row per class
    major = max(n, key=lambda c: (n[c], -c))
    train = split.undersample(train, majority=major, size=min(n[major], 3 * min(n.values())), seed=SEED)
    scaler = PopulationScaler(inputCol="x", outputCol="x").fit(train)
    rs = cut_lineage(smote(scaler.transform(train), k=min(5, min(n.values()) - 1), seed=SEED).select("id", "x", "target"))
    est, grid = TR.make_estimator("lr", 384)
    model = est.copy(grid[1]).fit(TR.to_ml(rs))
    scored = model.transform(TR.to_ml(scaler.transform(test), weight=False))
    m = M.macro_metrics(scored, "label", "prediction")
    even = len({r["count"] for r in rs.groupBy("target").count().collect()}) == 1
    digest = masked.agg(F.sum(F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long")).alias("masked_digest"))
    in_range = F.lit(True)
    for c in ("f1_macro", "precision_macro", "recall_macro", "accuracy"):
        in_range = in_range & F.col(c).between(0, 1)
    return M.attach(m, digest).select("n", in_range.alias("in_range"), F.lit(even).alias("balanced"), "masked_digest")
