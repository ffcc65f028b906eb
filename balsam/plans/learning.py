"""Plans for the learners written here: second-order boosting (G6) and the ReLU network (G7).

What SQL can redo, it redoes from the data: the first tree with its gains and leaf values, the
scores of that tree, and loss and gradient of a network with given weights. The other queries return
the learners' own rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from balsam.operators import boost as B
from balsam.operators import neural as N
from balsam.operators import score as S
from balsam.operators import split
from balsam.operators import subwords as SW
from balsam.operators import svd as SV
from balsam.operators import textnet as TN
from balsam.operators import train as TR
from balsam.operators.text import build_vocabulary, mask_text
from balsam.plans.registry import query
from balsam.plans.sql import L
from balsam.sources.tables import labelled_documents, learnable_set, table

SEED = "42"
BINS, STEP = 16, 0.3

# The first tree of two levels by SQL: cuts at ranks ceil(j n / 16), gradients 1/2 - y and hessians
# 1/4, the best cut of each node by gain, then column, then cut.
_CELLS = f"""r AS (SELECT id, target, 0.5 - target AS g, unnest(range(len(x))) AS i, unnest(x) AS v FROM {L}),
k AS (SELECT i, v, row_number() OVER (PARTITION BY i ORDER BY v) AS rn, count(*) OVER (PARTITION BY i) AS n,
             max(v) OVER (PARTITION BY i) AS top FROM r),
cuts AS (SELECT DISTINCT i, v AS cut FROM k JOIN (SELECT unnest(range(1, {BINS})) AS j) ON rn = ceil(j::DOUBLE / {BINS} * n)
         WHERE v < top)"""


def _level(name: str, member: str) -> str:
    """CTE ``name``: (node, i, cut, gain, gl, nl, g, n) of the best split of each node of the relation
    ``member`` (id, node)."""
    side = lambda g, h: f"({g}) * ({g}) / ({h} + 1)"
    return f"""{name}_s AS (SELECT node, r.i, cut, sum(g) FILTER (v <= cut) AS gl, count(*) FILTER (v <= cut) AS nl,
       sum(g) AS g, count(*) AS n FROM r JOIN {member} USING (id) JOIN cuts ON cuts.i = r.i GROUP BY node, r.i, cut),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, i, cut) AS rk FROM (
  SELECT node, i, cut, gl, nl, g, n, {side('gl', 'nl / 4.0')} + {side('g - gl', '(n - nl) / 4.0')} - {side('g', 'n / 4.0')} AS gain
  FROM {name}_s WHERE nl > 0 AND nl < n AND nl / 4.0 >= 1 AND (n - nl) / 4.0 >= 1) WHERE gain > 1e-9) WHERE rk = 1)"""


_TREE = f"""{_CELLS}, m0 AS (SELECT DISTINCT id, 0 AS node FROM r), {_level('a', 'm0')},
m1 AS (SELECT r.id, CASE WHEN v <= cut THEN 1 ELSE 2 END AS node FROM r JOIN a ON r.i = a.i), {_level('b', 'm1')},
m2 AS (SELECT m1.id, CASE WHEN b.node IS NULL THEN m1.node ELSE 2 * b.node + CASE WHEN v <= cut THEN 1 ELSE 2 END END AS node
       FROM m1 LEFT JOIN b USING (node) LEFT JOIN r ON r.id = m1.id AND r.i = b.i WHERE b.node IS NULL OR r.id IS NOT NULL),
members AS (SELECT * FROM m0 UNION SELECT * FROM m1 UNION SELECT * FROM m2),
nodes AS (SELECT node, count(*) AS n, -{STEP} * sum(0.5 - target) / (count(*) / 4.0 + 1) AS value
          FROM members JOIN {L} USING (id) GROUP BY node)"""


def _first_tree(spark, sf):
    rows = TR.to_ml(learnable_set(spark, sf), weight=False)
    return B.SecondOrderBoost(maxIter=1, maxDepth=2, maxBins=BINS, stepSize=STEP, subsample=1.0, colsample=1.0).fit(rows), rows


@query("boost_first_tree", f"""WITH {_TREE}
SELECT CAST(node AS INTEGER) AS node, n, CAST(s.i AS INTEGER) AS "column", round(cut, 6) AS cut, round(gain, 6) AS gain, round(value, 6) AS value
FROM nodes LEFT JOIN (SELECT node, i, cut, gain FROM a UNION ALL SELECT node, i, cut, gain FROM b) s USING (node)""")
def q_boost_first_tree(spark, sf):
    """Splits, gains and leaf values of the first tree of the second-order boosting."""
    model, _ = _first_tree(spark, sf)
    rows = [(k, v["n"], v.get("column"), v.get("cut"), v.get("gain"), v["value"]) for k, v in model.getTrees()[0].items()]
    df = spark.createDataFrame(rows, "node int, n long, column int, cut double, gain double, value double")
    return df.select("node", "n", "column", *[F.round(c, 6).alias(c) for c in ("cut", "gain", "value")])


@query("boost_margins", f"WITH {_TREE} SELECT id, round(value, 6) AS margin FROM m2 JOIN nodes USING (node)")
def q_boost_margins(spark, sf):
    """Every row scored by that tree."""
    model, rows = _first_tree(spark, sf)
    return S.with_score(model.transform(rows).select("id", "rawPrediction")).select("id", F.round("score", 6).alias("margin"))


def _fitted(spark, sf, name, **params):
    train, test = split.train_test(learnable_set(spark, sf), test_size=0.4, seed=SEED)
    est, _ = TR.make_estimator(name, 64)
    est = est.copy({est.getParam(k): v for k, v in params.items()})
    return est.fit(TR.to_ml(train)), TR.to_ml(test, weight=False)


@query("model_boost")
def q_model_boost(spark, sf):
    """Twenty trees of depth 3 with drawn rows and columns: predictions of the test part."""
    model, test = _fitted(spark, sf, "xgb", maxIter=20, maxDepth=3, stepSize=0.3)
    return S.predict_proba(model, test, ["id", "target"]).select("id", "target", "prediction", "score")


# A network of 4 inputs, 2 hidden units and given weights, by SQL over all rows.
_W1 = [[(j + 2 * k) % 5 / 2.0 - 1.0 for k in range(2)] for j in range(4)]
_B1, _W2, _B2 = [0.0, 0.1], [0.5, -0.75], 0.05
_SUM = lambda k: " + ".join(f"{_W1[j][k]} * x[{j + 1}]" for j in range(4)) + f" + {_B1[k]}"
_BACK = lambda k: f"CASE WHEN h{k} > 0 THEN d * {_W2[k]} ELSE 0 END"


@query("net_gradient", f"""WITH a AS (SELECT id, x, target, greatest({_SUM(0)}, 0) AS h0, greatest({_SUM(1)}, 0) AS h1 FROM {L}),
z AS (SELECT *, {_W2[0]} * h0 + {_W2[1]} * h1 + {_B2} AS z FROM a),
p AS (SELECT *, 1 / (1 + exp(-z)) - target AS d FROM z),
v AS (SELECT unnest([{', '.join([f"{{'place': {j * 2 + k}, 'value': {_BACK(k)} * x[{j + 1}]}}" for j in range(4) for k in range(2)]
      + [f"{{'place': {8 + k}, 'value': {_BACK(k)}}}" for k in range(2)] + [f"{{'place': {10 + k}, 'value': d * h{k}}}" for k in range(2)]
      + ["{'place': 12, 'value': d}", "{'place': -1, 'value': ln(1 + exp(z)) - target * z}"])}]) AS c FROM p)
SELECT CAST(c.place AS INTEGER) AS place, round(avg(c.value), 6) AS value FROM v GROUP BY c.place""")
def q_net_gradient(spark, sf):
    """Loss (place -1) and gradient of a small network with given weights, averaged over all rows."""
    rows = learnable_set(spark, sf).select(F.slice("x", 1, 4).alias("x"), F.col("target").cast("double").alias("y"), F.lit(1.0).alias("w"))
    flat = np.array([v for r in _W1 for v in r] + _B1 + _W2 + [_B2])
    loss, n, _, grad = N.total(rows, flat, [4, 2, 1])
    return spark.createDataFrame([(i - 1, float(v) / n) for i, v in enumerate([loss, *grad])], "place int, value double") \
        .select("place", F.round("value", 6).alias("value"))


@query("net_history")
def q_net_history(spark, sf):
    """Training of the full 100-50 network: losses and accuracy of each epoch, with the one whose weights were taken."""
    model, _ = _fitted(spark, sf, "net", maxIter=12, learningRate=0.01, patience=4)
    return spark.createDataFrame([(e["epoch"], e["train_loss"], e["val_loss"], e["val_accuracy"], e["best"]) for e in model.getHistory()],
                                 "epoch int, train_loss double, val_loss double, val_accuracy double, best boolean")


@query("model_net")
def q_model_net(spark, sf):
    """Predictions of the 100-50 network on the test part."""
    model, test = _fitted(spark, sf, "net", maxIter=12, learningRate=0.01, patience=4)
    return S.predict_proba(model, test, ["id", "target"]).select("id", "target", "prediction", "score")


# Subwords: the pieces are words of the corpus vocabulary, which begin or continue a word, and all
# letters and digits that occur.
WORDS, MAX_LEN = 2000, 128


def _pieces(docs):
    top = build_vocabulary(docs, "text", WORDS).select("token", F.col("token_id").alias("rank"))
    tokens = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)
    chars = docs.select(F.explode(F.array_distinct(F.split(F.array_join(tokens, ""), ""))).alias("token")).filter("token <> ''").distinct()
    both = top.unionByName(chars.join(top, "token", "left_anti").select("token", F.lit(None).cast("int").alias("rank")))
    w = Window.orderBy(F.col("rank").asc_nulls_last(), "token")  # at most the vocabulary and the alphabet
    ids = both.select("token", (2 * F.row_number().over(w) + 2).alias("i"))
    return ids.select(F.col("token").alias("piece"), F.col("i").alias("token_id")).unionByName(
        ids.select(F.concat(F.lit("##"), "token").alias("piece"), (F.col("i") + 1).alias("token_id")))


_LOW = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
_SUBWORD_SQL = rf"""WITH RECURSIVE toks AS (SELECT doc_id, {_LOW} AS ts FROM documents),
dfreq AS (SELECT tok AS token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(ts) AS tok FROM toks) GROUP BY tok),
top AS (SELECT token, row_number() OVER (ORDER BY df DESC, token) AS rank FROM dfreq ORDER BY df DESC, token LIMIT {WORDS}),
chars AS (SELECT DISTINCT unnest(string_split(token, '')) AS token FROM dfreq),
pieces AS (SELECT token, 2 * row_number() OVER (ORDER BY rank NULLS LAST, token) + 2 AS i
           FROM (SELECT token, rank FROM top UNION ALL SELECT token, NULL FROM chars WHERE token NOT IN (SELECT token FROM top))),
m AS (SELECT token, 0 AS k, []::BIGINT[] AS ids FROM dfreq
      UNION ALL
      SELECT token, k + n, list_append(ids, i + CASE WHEN k > 0 THEN 1 ELSE 0 END) FROM (
        SELECT m.token, m.k, m.ids, p.i, length(p.token) AS n,
               row_number() OVER (PARTITION BY m.token, m.k ORDER BY length(p.token) DESC) AS rk
        FROM (SELECT *, unnest(range(1, length(token) - k + 1)) AS l FROM m WHERE k < length(token)) m
        JOIN pieces p ON p.token = substr(m.token, m.k + 1, l)) WHERE rk = 1),
seqs AS (SELECT token, ids FROM m WHERE k = length(token)),
pos AS (SELECT doc_id, unnest(ts) AS token, unnest(range(len(ts))) AS p FROM toks),
flat AS (SELECT doc_id, flatten(list(ids ORDER BY p)) AS ids FROM pos JOIN seqs USING (token) GROUP BY doc_id)
SELECT doc_id, array_to_string([2] || coalesce(ids, [])[1:{MAX_LEN - 2}] || [3]
         || list_transform(range({MAX_LEN - 2} - least({MAX_LEN - 2}, len(coalesce(ids, [])))), lambda x: 0), ',') AS input_ids,
       CAST(least({MAX_LEN}, len(coalesce(ids, [])) + 2) AS BIGINT) AS n_real, CAST(len(coalesce(ids, [])) AS BIGINT) AS n_tokens
FROM toks LEFT JOIN flat USING (doc_id)"""


@query("encode_subwords", _SUBWORD_SQL)
def q_encode_subwords(spark, sf):
    """Greedy longest match of words, their beginnings and continuations; signs are left out here."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    automaton = SW.from_table(_pieces(docs))
    bare = docs.withColumn("text", F.array_join(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0), " "))
    enc = SW.encode_subwords(bare, "text", "doc_id", automaton, MAX_LEN)
    return enc.select("doc_id", F.array_join("input_ids", ",").alias("input_ids"),
                      F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, v: a + v).alias("n_real"), "n_tokens")


def _text_net(spark, sf):
    w = mask_text(labelled_documents(spark, sf), ["text"])
    train, test = split.train_test(w, test_size=0.4, seed=SEED)
    docs = table(spark, sf, "documents", "doc_id", "text")
    return TN.fit_text(train, test, SW.from_table(_pieces(docs)), epochs=5, rate=0.05), test


@query("text_epochs")
def q_text_epochs(spark, sf):
    """The text classifier trained by epochs: losses and accuracies of each, from one run."""
    return _text_net(spark, sf)[0].history()


@query("model_text_net")
def q_model_text_net(spark, sf):
    """Test rows scored by the classifier's best epoch."""
    model, test = _text_net(spark, sf)
    return model.transform(test).join(test.select("id", "target"), "id")


@query("embed_learned")
def q_embed_learned(spark, sf):
    """Embedding of 384 columns learned from the documents by a truncated SVD of TF-IDF."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    return SV.fit_svd(docs, "text", dim=384).transform(docs, "text", "doc_id")
