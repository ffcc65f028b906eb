import random

from balsam.llm import tokens


def brute(scores, data):
    longest = max(map(len, scores))
    best = [(0.0, 0)] + [None] * len(data)
    for i in range(1, len(data) + 1):
        best[i] = max((best[j][0] + scores[data[j:i]], best[j][1] - 1)
                      for j in range(max(0, i - longest), i) if data[j:i] in scores)
    return -best[-1][1]


def test_counts_match_a_plain_programme(monkeypatch):
    scores = tokens.load_vocabulary(tokens.default_vocabulary())
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(["the", " of", "tion", "é", "ß", "日", "  ", "\n", "1", "23", "!!", "_", "abc"])
                     for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    texts += ["", None, "x" * 700, "the " * 500 + "é" * 400]
    plain = [(len(tokens.PRETOKEN.findall(t or "")),
              sum(brute(scores, p.encode()) for p in tokens.PRETOKEN.findall(t or ""))) for t in texts]
    assert [tokens.Trie(scores).counts(t) for t in texts[:5]] == plain[:5]
    trie = tokens.Trie(scores)
    assert [trie.counts(t) for t in texts] == plain
    # beginning the trie anew changes nothing
    monkeypatch.setattr(tokens, "MAX_NODES", 50)
    trie = tokens.Trie(scores)
    assert [trie.counts(t) for t in texts] == plain


def test_shared_prefixes_are_scored_once():
    trie = tokens.Trie({b"a": -1.0, b"b": -1.0, b"ab": -1.5})
    for w in ("abab", "abaa", "abab"):
        trie.count(w)
    assert len(trie.parent) == 1 + 4 + 1
    assert trie.known == {"abab": 2, "abaa": 3}


def test_query_on_edge_rows(spark):
    d = spark.createDataFrame([(1, "the cat", "x"), (1, "the cat", "x"), (None, "a", "y"), (2, None, "z"), (3, "", "w"),
                               (4, "word " * 50_000, "v")], "doc_id long, text string, key string")
    got = tokens.count_tokens(d).collect()
    n = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in got}
    assert len(got) == 6 and n[2] == (0, 0) and n[3] == (0, 0)
    assert n[1] == (2, 2) and n[4][0] == 50_001
    assert tokens.count_tokens(d.limit(0)).count() == 0
