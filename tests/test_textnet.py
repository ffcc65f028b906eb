import duckdb
import numpy as np
import pytest

from balsam.operators import subwords as SW
from balsam.operators import textnet as TN


def plain(pieces, word):
    first, rest = ({p[0]: p[1] for p in pieces if p[2] == f} for f in (True, False))
    out, at = [], 0
    while at < len(word):
        table = rest if at else first
        n = next((n for n in range(len(word) - at, 0, -1) if word[at:at + n] in table), None)
        if n is None:
            return [SW.UNK]
        out.append(table[word[at:at + n]])
        at += n
    return out


def test_longest_match_equals_a_plain_search():
    rng = np.random.default_rng(0)
    pieces, seen = [], set()
    for i in range(300):
        p = ("".join(rng.choice(list("abcé"), rng.integers(1, 5))), bool(rng.integers(2)))
        if p not in seen:
            seen.add(p)
            pieces.append((p[0], i + 4, p[1], None))
    auto = SW.Automaton(pieces)
    for _ in range(500):
        w = "".join(rng.choice(list("abcéz"), rng.integers(1, 12)))
        assert auto.word(w) == plain(pieces, w)


def test_public_file_and_edges(spark, monkeypatch):
    import public_tokenizers
    auto = SW.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert SW.UNK not in auto.text("Tokenization isn't 日 hard_ 42")
    d = spark.createDataFrame([(1, "a cat"), (1, "a cat"), (2, None), (3, ""), (4, "word " * 1000), (None, "x")], "id long, text string")
    got = {(r["id"], r["n_tokens"], tuple(r["input_ids"])[:2], sum(r["attention_mask"]), len(r["input_ids"])) for r in SW.encode_subwords(d, "text", "id", auto, 16).collect()}
    assert {g[0]: g[1] for g in got} == {1: 2, 2: 0, 3: 0, 4: 1000, None: 1}
    assert all(g[4] == 16 and g[3] == min(16, g[1] + 2) for g in got)
    small = SW.from_table(spark.createDataFrame([("un", 4), ("##able", 5), ("##a", 6)], "piece string, token_id int"))
    assert small.text("unable una able un!") == [4, 5, 4, 6, SW.UNK, 4, SW.UNK]


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(1)
    net = TN.Net.new(9, 3, 4, 0)
    net.w[2] = net.w[2] + 0.3
    ids = rng.integers(0, 9, (6, 5))
    mask = (np.arange(5) < rng.integers(1, 6, 6)[:, None]).astype(int)
    y, weight = rng.integers(0, 2, 6).astype(float), rng.uniform(0.5, 3, 6)
    _, rows, grad, rest = net.gradient(ids, mask, y, weight)
    full = np.zeros_like(net.w[0])
    full[rows] = grad
    for w, g in zip(net.w, [full, *rest]):
        for i in np.ndindex(*w.shape):
            keep = w[i]
            loss = []
            for e in (1e-6, -1e-6):
                w[i] = keep + e
                loss.append(net.gradient(ids, mask, y, weight)[0])
            w[i] = keep
            assert g[i] == pytest.approx((loss[0] - loss[1]) / 2e-6, abs=1e-6)


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(3)
    words = ["red", "blue", "green", "stone", "river", "bad", "worse", "house"]
    rows = []
    for i in range(240):
        t = list(rng.choice(words[:5] + words[7:], 8))
        y = int(rng.random() < 0.3)
        rows.append((i, " ".join(t + (["bad worse"] if y else [])), y))
    auto = SW.Automaton([(w, i + 4, True, None) for i, w in enumerate(words)])
    df = spark.createDataFrame(rows, "id long, text string, target int")
    return df, auto, TN.fit_text(df.filter("id < 180"), df.filter("id >= 180"), auto, epochs=6, rate=0.1, parts=3, dim=8, hidden=8, batch=8, max_length=16)


def test_history_equals_sql_over_the_emitted_predictions(fitted):
    _, _, model = fitted
    p = model.predictions().toPandas()  # noqa: F841
    assert len(p) == 6 * 240
    sql = duckdb.sql("""SELECT epoch,
      sum(-weight * ln(CASE WHEN target = 1 THEN p ELSE 1 - p END)) FILTER (part = 'train') / sum(weight) FILTER (part = 'train') AS train_loss,
      avg(CAST((p > 0.5) = (target = 1) AS INT)) FILTER (part = 'train') AS train_accuracy,
      sum(-weight * ln(CASE WHEN target = 1 THEN p ELSE 1 - p END)) FILTER (part = 'validation') / sum(weight) FILTER (part = 'validation') AS val_loss,
      avg(CAST((p > 0.5) = (target = 1) AS INT)) FILTER (part = 'validation') AS val_accuracy FROM p GROUP BY epoch ORDER BY epoch""").fetchall()
    got = sorted(tuple(r)[:5] for r in model.history().collect())
    assert np.allclose(got, sql)
    assert got[-1][1] < got[0][1] and max(g[4] for g in got) > 0.95
    assert [r["epoch"] for r in model.history().filter("best").collect()] == [min(got, key=lambda g: g[3])[0]]


def test_the_best_epoch_is_kept_and_scores_follow(fitted):
    df, _, model = fitted
    scores = {r["id"]: r["score"] for r in model.transform(df).collect()}
    kept = {r["id"]: r["p"] for r in model.predictions().filter(f"epoch = {model.best}").collect()}
    assert scores.keys() == kept.keys() and all(abs(scores[i] - kept[i]) < 1e-12 for i in kept)


def test_results_do_not_depend_on_partitions(spark, fitted):
    df, auto, _ = fitted
    small = df.filter("id < 60").coalesce(1).sortWithinPartitions("id")
    run = lambda d: TN.fit_text(d, None, auto, epochs=1, parts=2, dim=4, hidden=4, max_length=16)
    a, b = run(small), run(small)
    assert all(np.allclose(x, y) for x, y in zip(a.net().w, b.net().w))
    assert a.best == 1 and a.history().first()["val_loss"] is None
    with pytest.raises(ValueError):
        run(df.limit(0))
