import functools
import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from balsam.llm import token_align as T
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def pair():
    return T.Pair(*map(T._file, T.default_files()))


@functools.cache
def plain(pair, text):
    """Groups of a text as (a ids, b ids, links that end together, overlapping pairs)."""
    if not text:
        return []
    data = (" " + text).encode()
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    if b"".join(pair.bytes_a[i] for i in a) != data or b"".join(pair.bytes_b[i] for i in b) != data:
        return []

    def spans(ids, table):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(table[i]), i))
            at += len(table[i])
        return out
    x, y = spans(a, pair.bytes_a), spans(b, pair.bytes_b)
    cuts = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
    groups, begin = [], 0
    for cut in cuts:
        inside = [[t for t in side if begin < t[1] <= cut] for side in (x, y)]
        ends = [(p[2], q[2]) for p in inside[0] for q in inside[1] if p[1] == q[1]]
        over = [(p[2], q[2]) for p in inside[0] for q in inside[1] if max(p[0], q[0]) < min(p[1], q[1])]
        groups.append((begin, cut, [p[2] for p in inside[0]], [q[2] for q in inside[1]], ends, over))
        begin = cut
    return groups


def brute(pair, rows, kind):
    found = [plain(pair, t) for _, t in rows]
    links = [[link for g in f for link in g[4 if kind == "end" else 5]] for f in found]
    count = Counter(x for d in links for x in d)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for (key, _), f, d in zip(rows, found, links):
        text = ";".join(",".join(map(str, g[2])) + "|" + ",".join(map(str, g[3])) for g in f)
        out.append((key, sum(len(g[2]) for g in f), sum(len(g[3]) for g in f), len(f), len(d),
                    sum(count[x] == most[x[1]] for x in d), sum(count[x] for x in d),
                    hashlib.sha256(text.encode()).hexdigest() if f else ""))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    bits = ["the ", "tokenization", " isn't", "\n\n", "\t", "日本語", "é", "😀", "👩‍👩‍👧", "▁", "<s>", "<|endoftext|>", "<0x41>", "1234567", "   ", "\x00", "\x7f",
            "ß", "!!!", "\r\n", " ", " ", "﻿", "naïve", "İ"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))) for i in range(150)]
    rows += [(i, b) for i, b in enumerate(bits, 200)] + [(500, None), (501, ""), (None, "a null key"), (3, "again"), (3, "again"), (502, "word é " * 400)]
    con = duckdb.connect()
    return rows + [(1000 + i, t) for i, t in con.execute(f"SELECT doc_id, text FROM '{SF_SMALL}/documents.parquet' WHERE length(text) < 3000 ORDER BY doc_id LIMIT 60").fetchall()]


@pytest.mark.parametrize("kind, max_pairs, share", [("end", T.MAX_PAIRS, 1), ("overlap", T.MAX_PAIRS, 1), ("end", 0, 1), ("end", 0, 10_000)])
def test_rows_match_brute_force(spark, pair, rows, monkeypatch, kind, max_pairs, share):
    monkeypatch.setattr(T, "HOT_SHARE", share)
    d = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, codes string, row int")
    got = T.link_statistics(d.repartition(3), links=kind, max_pairs=max_pairs).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(pair, rows, kind)


def test_groups_of_texts(spark, pair, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], [(g["start"], g["end"], g["a"], g["b"]) for g in r["groups"]]) for r in T.align(d).collect()), key=repr)
    assert got == sorted(((k, [g[:4] for g in plain(pair, t)]) for k, t in rows), key=repr)


def test_special_strings_and_marks(pair):
    a, b = pair.encode(["x<|endoftext|><s>", "▁", None, "", "ok"])
    assert a[0] and 50256 not in a[0] and 1 not in b[0]
    assert a[1:4] == [[], [], []] and b[1:4] == [[], [], []] and a[4] and b[4]


def test_long_text_in_one_go(pair):
    text = "word é 日本 " * 30_000
    al = T.Alignment(*pair.encode([text]), pair.len_a, pair.len_b)
    one = plain(pair, "word é 日本 word é 日本 ")
    assert al.end_a[-1] == al.end_b[-1] == len(text.encode()) + 1 and al.n_groups > 60_000 and len(one) > 3
    x, y = al.links()
    assert len(x) == al.n_groups


def test_without_tokens(spark, pair):
    al = T.Alignment([[], []], [[], []], pair.len_a, pair.len_b)
    assert al.n_groups == 0 and al.digests(pair) == ["", ""] and len(al.links()[0]) == 0
    d = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in T.link_statistics(d).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    assert T.link_statistics(d.limit(0)).count() == 0 and T.align(d.limit(0)).count() == 0
    assert np.array_equal(al.doc_of_group, [])


def test_merging_on_ids_gives_the_tokens_of_the_file(pair):
    file_a, file_b = map(T._file, T.default_files())
    fast = T.Pair(file_a, file_b, T._fast(file_a))
    assert fast.fast is not None
    rng = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", " ", "　", "'s", "'", "é", "中", "٣", "½", "_", "!", "<|endoftext|>",
             "\U0001f642", "\x00", "́", "Ⅷ", "1", "'ll", "then", "ing", "x" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(500)]
    assert fast.encode_a(texts) == [x.ids for x in pair.a.encode_batch_fast(texts, add_special_tokens=False)]


def test_other_files_keep_their_own_library():
    import json

    spec = json.loads(T._file(T.default_files()[0]))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]  # ids do not ascend as the merges do
    assert T._ranks(json.dumps(spec).encode()) is None
    spec = json.loads(T._file(T.default_files()[0])) | {"normalizer": {"type": "Lowercase"}}
    assert T._ranks(json.dumps(spec).encode()) is None
