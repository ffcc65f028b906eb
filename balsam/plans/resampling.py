"""Plans for kNN and rebalancing (F) on the embeddings table.

E: (id = vec_id, x = embedding as double, target = (label = 0)), about 10 %
positives, so class 1 is the minority. The oracles spell out the same
deterministic draws and rank neighbours by (distance, id) with a plain join.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from balsam.functions.vectors import vsum
from balsam.operators import resample as RS
from balsam.operators.knn import knn, knn_approx
from balsam.plans.registry import ORACLES, query
from balsam.plans.sql import E, U
from balsam.sources.tables import embedding_set

SEED = "42"
K = 5


def _out(df):
    """Checked projection of a resampled set: lineage and a rounded vector checksum."""
    return df.select("id", "target", "base_id", "nn_id", F.round("step", 6).alias("step"),
                     F.round(vsum(F.col("x")), 6).alias("x_sum"))


_OUT_SQL = "SELECT id, target, base_id, nn_id, round(step, 6) AS step, round(list_sum(x), 6) AS x_sum FROM {rel}"


def _nn_sql(name, left, right, k, extra_left="", extra_right=""):
    return f"""{name} AS (SELECT a.id AS q, b.id AS n, a.target AS t, b.target AS nt,
  row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS rk
  FROM {left} a JOIN {right} b ON a.id <> b.id QUALIFY rk <= {k})"""


_BASE = f"""e AS {E},
cnt AS (SELECT count(*) FILTER (WHERE target = 1) AS nmin, count(*) FILTER (WHERE target = 0) AS nmaj FROM e),
mino AS (SELECT id, x, target, row_number() OVER (ORDER BY id) - 1 AS pos FROM e WHERE target = 1),
{_nn_sql('nnmin', 'mino', 'mino', K)}"""


def _lerp_sql(scale="1.0"):
    return f"list_transform(list_zip(b.x, p.x), lambda z: z[1] + (d.step * {scale}) * (z[2] - z[1]))"


def _draws_sql(n_sql, nbase_sql, seed=SEED, offset="0"):
    return f"""(SELECT g, CAST(floor({U(seed + ':b', 'g')} * {nbase_sql}) AS BIGINT) AS bpos,
  CAST(floor({U(seed + ':n', 'g')} * {K}) + 1 AS BIGINT) AS rk, {U(seed + ':s', 'g')} AS step
  FROM (SELECT {offset} + unnest(range({n_sql})) AS g))"""


_SMOTE_SYN = f"""syn AS (SELECT -(d.g + 1) AS id, {_lerp_sql()} AS x, 1 AS target, b.id AS base_id, nn.n AS nn_id, d.step
  FROM {_draws_sql('(SELECT nmaj - nmin FROM cnt)', '(SELECT nmin FROM cnt)')} d
  JOIN mino b ON b.pos = d.bpos JOIN nnmin nn ON nn.q = b.id AND nn.rk = d.rk JOIN mino p ON p.id = nn.n)"""

_ALL = """(SELECT id, x, target, NULL::BIGINT AS base_id, NULL::BIGINT AS nn_id, NULL::DOUBLE AS step FROM e
  UNION ALL SELECT id, x, target, base_id, nn_id, step FROM syn)"""


@query("knn_exact", f"""WITH e AS {E}, {_nn_sql('nn', 'e', 'e', K)}
SELECT q AS q_id, CAST(rk AS INTEGER) AS rank, n AS nn_id,
  round((SELECT list_distance(a.x, b.x) FROM e a, e b WHERE a.id = nn.q AND b.id = nn.n), 6) AS dist FROM nn""")
def q_knn_exact(spark, sf):
    """Exact 5-NN of every row among all rows (self excluded)."""
    e = embedding_set(spark, sf)
    return knn(e, e, K).select("q_id", "rank", "nn_id", F.round(F.sqrt("d2"), 6).alias("dist"))


@query("knn_exact_blocked", f"""WITH e AS {E}, {_nn_sql('nn', 'e', 'e', K)}
SELECT q AS q_id, CAST(rk AS INTEGER) AS rank, n AS nn_id FROM nn""")
def q_knn_exact_blocked(spark, sf):
    """Same search forced through the blocked layout (reference side over the cap)."""
    e = embedding_set(spark, sf)
    return knn(e, e, K, cells=5, block_rows=128).select("q_id", "rank", "nn_id")


@query("knn_approx")
def q_knn_approx(spark, sf):
    """The nearest cells only, top 5 per row."""
    e = embedding_set(spark, sf)
    return knn_approx(e, e, K)


@query("knn_approx_recall", f"SELECT count(*) AS n, true AS recall_from_90 FROM {E}")
def q_knn_approx_recall(spark, sf):
    """Recall of the approximate search against the exact one over all rows."""
    e = embedding_set(spark, sf)
    exact = knn(e, e, K).select("q_id", "nn_id")
    found = knn_approx(e, e, K).select("q_id", "nn_id", F.lit(1).alias("hit"))
    per = exact.join(found, ["q_id", "nn_id"], "left").groupBy("q_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r"))
    return per.agg(F.count(F.lit(1)).alias("n"), (F.avg("r") >= 0.9).alias("recall_from_90"))


@query("random_oversample", f"""WITH {_BASE},
syn AS (SELECT -(d.g + 1) AS id, b.x, 1 AS target, b.id AS base_id, NULL::BIGINT AS nn_id, NULL::DOUBLE AS step
  FROM {_draws_sql('(SELECT nmaj - nmin FROM cnt)', '(SELECT nmin FROM cnt)')} d JOIN mino b ON b.pos = d.bpos)
{_OUT_SQL.format(rel=_ALL)}""")
def q_random_oversample(spark, sf):
    return _out(RS.random_oversample(embedding_set(spark, sf), seed=SEED))


@query("smote", f"WITH {_BASE}, {_SMOTE_SYN} {_OUT_SQL.format(rel=_ALL)}")
def q_smote(spark, sf):
    return _out(RS.smote(embedding_set(spark, sf), K, SEED))


_ADASYN = f"""WITH {_BASE},
{_nn_sql('nnall', 'mino', 'e', K)},
sh AS (SELECT q AS id, count(*) FILTER (WHERE nt <> 1) AS m FROM nnall GROUP BY q),
gi AS (SELECT id, CAST(round_even((SELECT nmaj - nmin FROM cnt)::DOUBLE * m / sum(m) OVER (), 0) AS BIGINT) AS gi FROM sh),
off AS (SELECT id, gi, CAST(sum(gi) OVER (ORDER BY id) - gi AS BIGINT) AS cum FROM gi),
rws AS (SELECT id AS base_id, cum + unnest(range(gi)) AS g FROM off WHERE gi > 0),
syn AS (SELECT -(d.g + 1) AS id, {_lerp_sql()} AS x, 1 AS target, d.base_id, nn.n AS nn_id, d.step
  FROM (SELECT g, base_id, CAST(floor({U(SEED + ':n', 'g')} * {K}) + 1 AS BIGINT) AS rk, {U(SEED + ':s', 'g')} AS step FROM rws) d
  JOIN mino b ON b.id = d.base_id JOIN nnmin nn ON nn.q = d.base_id AND nn.rk = d.rk JOIN mino p ON p.id = nn.n)
{_OUT_SQL.format(rel=_ALL)}"""


@query("adasyn", _ADASYN)
def q_adasyn(spark, sf):
    return _out(RS.adasyn(embedding_set(spark, sf), K, SEED))


_BORDER = f"""WITH {_BASE},
{_nn_sql('nnm', 'mino', 'e', 10)},
dg AS (SELECT q AS id FROM nnm GROUP BY q
       HAVING count(*) FILTER (WHERE nt <> 1) * 2 >= 10 AND count(*) FILTER (WHERE nt <> 1) < 10),
dpos AS (SELECT m.id, m.x, m.target, row_number() OVER (ORDER BY m.id) - 1 AS pos FROM mino m JOIN dg USING (id)),
{_nn_sql('nnd', 'dpos', 'mino', K)},
syn AS (SELECT -(d.g + 1) AS id, {_lerp_sql()} AS x, 1 AS target, b.id AS base_id, nn.n AS nn_id, d.step
  FROM {_draws_sql('(SELECT nmaj - nmin FROM cnt)', '(SELECT count(*) FROM dg)')} d
  JOIN dpos b ON b.pos = d.bpos JOIN nnd nn ON nn.q = b.id AND nn.rk = d.rk JOIN mino p ON p.id = nn.n)
{_OUT_SQL.format(rel=_ALL)}"""


@query("borderline_smote", _BORDER)
def q_borderline_smote(spark, sf):
    return _out(RS.borderline_smote(embedding_set(spark, sf), K, 10, SEED))


@query("svm_smote")
def q_svm_smote(spark, sf):
    return _out(RS.svm_smote(embedding_set(spark, sf), K, 10, SEED))


@query("svm_smote_checked", f"""WITH c AS (SELECT count(*) FILTER (WHERE target = 1) AS nmin, count(*) FILTER (WHERE target = 0) AS nmaj FROM {E})
SELECT CAST(-(g + 1) AS BIGINT) AS id, true AS on_line, true AS from_minority
FROM (SELECT unnest(range((SELECT nmaj - nmin FROM c))) AS g)""")
def q_svm_smote_checked(spark, sf):
    """Every new row of SVM-SMOTE: its id, whether it lies on the line through its base and
    neighbour at the drawn step (towards the neighbour, or half as far away from it), and whether
    both are minority rows. There are as many as the classes differ by."""
    e = embedding_set(spark, sf)
    new = RS.svm_smote(e, K, 10, SEED).where("id < 0")
    rows = lambda p: e.select(F.col("id").alias(f"{p}_id"), F.col("x").alias(f"{p}_x"), F.col("target").alias(f"{p}_t"))
    j = new.join(rows("base"), "base_id").join(rows("nn"), "nn_id")
    off = lambda scale: F.aggregate(F.zip_with(
        F.zip_with("x", "base_x", lambda x, b: x - b),
        F.zip_with(F.zip_with("nn_x", "base_x", lambda n, b: n - b), F.array_repeat("step", F.size("x")), lambda d, t: d * t * scale),
        lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v)
    return j.select("id", (F.least(off(1.0), off(-0.5)) < 1e-9).alias("on_line"),
                    ((F.col("base_t") == 1) & (F.col("nn_t") == 1)).alias("from_minority"))


def _edit_sql(rel_ctes: str, src: str) -> str:
    return f"""{rel_ctes},
{_nn_sql('nn3', src, src, 3)},
bad AS (SELECT DISTINCT q FROM nn3 WHERE nt <> t)
SELECT id, target FROM {src} WHERE id NOT IN (SELECT q FROM bad)"""


def _tomek_sql(rel_ctes: str, src: str) -> str:
    return f"""{rel_ctes},
{_nn_sql('nn1', src, src, 1)},
links AS (SELECT x.q FROM nn1 x JOIN nn1 y ON x.n = y.q AND y.n = x.q WHERE x.t <> x.nt)
SELECT id, target FROM {src} WHERE id NOT IN (SELECT q FROM links)"""


_S_REL = f"WITH {_BASE}, {_SMOTE_SYN}, s AS (SELECT id, x, target FROM e UNION ALL SELECT id, x, target FROM syn)"


@query("smote_enn", _edit_sql(_S_REL, "s"))
def q_smote_enn(spark, sf):
    return RS.smote_enn(embedding_set(spark, sf), K, SEED).select("id", "target")


@query("smote_tomek", _tomek_sql(_S_REL, "s"))
def q_smote_tomek(spark, sf):
    return RS.smote_tomek(embedding_set(spark, sf), K, SEED).select("id", "target")


@query("edited_nn", _edit_sql(f"WITH e AS {E}", "e"))
def q_edited_nn(spark, sf):
    return RS.edited_nn(embedding_set(spark, sf), 3).select("id", "target")


@query("tomek_links", _tomek_sql(f"WITH e AS {E}", "e"))
def q_tomek_links(spark, sf):
    return RS.tomek_links(embedding_set(spark, sf)).select("id", "target")


@query("resample_by_name", f"""WITH {_BASE}, {_SMOTE_SYN}
SELECT target, CAST(count(*) AS BIGINT) AS n FROM {_ALL} GROUP BY target""")
def q_resample_by_name(spark, sf):
    r = RS.resample_by_name(embedding_set(spark, sf), "smote", seed=SEED)
    return r.groupBy("target").agg(F.count(F.lit(1)).alias("n"))


_BY_METHOD = {"random_oversample": "random_oversample", "smote": "smote", "adasyn": "adasyn",
              "borderline_smote": "borderline_smote", "smote_enn": "smote_enn", "smote_tomek": "smote_tomek"}


@query("resample_summary", " UNION ALL ".join(
    [f"SELECT '{m}' AS method, target, CAST(count(*) AS BIGINT) AS n FROM ({ORACLES[q]}) GROUP BY target"
     for m, q in _BY_METHOD.items()]
    + [f"""SELECT 'svm_smote' AS method, CAST(unnest([0, 1]) AS INTEGER) AS target,
  (SELECT count(*) FROM {E} WHERE target = 0) AS n"""]))
def q_resample_summary(spark, sf):
    """Class counts after each of the seven methods."""
    return RS.resample_summary(embedding_set(spark, sf), seed=SEED)
