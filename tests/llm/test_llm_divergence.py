import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from balsam.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, min_docs, top=10):
    count, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source, found = lang or "", source or "", terms(text)
        groups[lang].add(source)
        count[lang, source].update(found)
        seen[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        share = lambda c: {t: 1 + 10 ** 9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p = {s: share(count[lang, s]) for s in sources}
        q = share(sum((count[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            best = [(t, f(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, rows, last in (("pair", pairs, None), ("term", best, top)):
                rows.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, i, v, n + 1) for n, (i, v) in enumerate(rows[:last])]
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(6)
    vocab = ["a", "B", "eightchr", "ninechars", "ÉtÉ", "straße", "日本語", "sixteen_chars", "sixteencharslong", "seventeencharslon", "x" * 40,
             "X" * 40, "y" * 40, "z" * 41, "Ünïcödeünïcödeünï", "0", "9zz", "don't", " nb", "é"]
    vocab += [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    docs = []
    for i in range(400):
        lang = rnd.choice(["en", "en", "fr", None, ""])
        source = rnd.choice(["s1", "s1", "s2", "é3", None, ""])
        docs.append((" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 40))), lang, source))
    docs += [(None, "en", "s1"), ("", "en", "only-empty"), (None, "xx", "u"), ("12 34", "xx", "v"), (" a" * 200_000, "en", "s2"),
             ("lone word here", "de", "one")]
    return docs + [docs[0]] * 3


@pytest.mark.parametrize("cells", [D.CELLS, 7])
def test_rows_match_brute_force(spark, docs, monkeypatch, cells):
    monkeypatch.setattr(D, "CELLS", cells)
    d = spark.createDataFrame(docs, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS n", "3 AS value")
    got = sorted(tuple(r) for r in D.audit(d.repartition(5), min_docs=8).collect())
    assert got == brute(docs, 8)
    assert {r[2] for r in got} == {"pair", "term"}


def test_empty_table_and_no_kept_terms(spark, docs):
    d = spark.createDataFrame(docs, "text string, lang string, source string")
    assert D.audit(d.limit(0)).count() == 0
    got = sorted(tuple(r) for r in D.audit(d, min_docs=10 ** 6).collect())
    assert got == brute(docs, 10 ** 6) and all(r[4] == 0 for r in got)


def test_counting_by_length_matches_plain_counts():
    rnd = random.Random(7)
    alphabet = "abcXYZéß日 .1"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 300))) for _ in range(50)] + ["", "abc", "abc", "q" * 70 + " " + "Q" * 70]
    data = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(b) for b in data]))
    group = np.array([i % 3 for i in range(len(texts))], np.uint32)
    got = Counter()
    docs = Counter()
    for of, length, rows, n, n_docs in D.count_terms(np.frombuffer(b"".join(data), np.uint8), offsets, group):
        for i in range(len(of)):
            key = int(of[i]), rows[i, :length[i]].tobytes().decode()
            got[key] += int(n[i])
            docs[key] += int(n_docs[i])
    want, want_docs = Counter(), Counter()
    for i, t in enumerate(texts):
        want.update((i % 3, w) for w in terms(t))
        want_docs.update((i % 3, w) for w in set(terms(t)))
    assert got == want and docs == want_docs


def test_chunks_cover_all_texts_once():
    sizes = np.array([0, 5, D.CHUNK, 3, 4, D.CHUNK + 9, 0, D.CHUNK - 4, 4, 1])
    parts = list(D._chunks(sizes))
    assert [i for a, b in parts for i in range(a, b)] == list(range(len(sizes)))
    assert all(b == a + 1 or sizes[a:b].sum() <= D.CHUNK for a, b in parts)
    assert list(D._chunks(sizes[:0])) == []


def test_radix_order_and_exact_shares():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2 ** 64, 5000, dtype=np.uint64), rng.integers(0, 3, 5000).astype(np.uint32)
    a[::2] = a[0]
    assert (D.radix_order([b, a]) == np.lexsort((a, b))).all()
    assert len(D.radix_order([a[:0]])) == 0
    n = np.array([0, 5, 4 * 10 ** 15], np.int64)
    assert D.share(n, 4 * 10 ** 15 + 5, 3).tolist() == [1 + 10 ** 9 * (int(x) + 2) // (4 * 10 ** 15 + 11) for x in n]
