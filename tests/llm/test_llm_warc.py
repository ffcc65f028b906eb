import base64
import hashlib
import random

import pytest

from balsam.llm import warc
from balsam.session import scratch_path


def expected(rows):
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    top, size = {}, {}
    for k, _, h in rows:
        size[h or ""] = size.get(h or "", 0) + 1
        if k is not None:
            top[h or ""] = max(top.get(h or "", k), k)
    out = []
    for k, _, h in rows:
        first = top.get(h or "") if size[h or ""] > 1 else None
        again = first is not None and k != first
        out.append((k, len((h or "").encode()), sha(h), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choice("aé日\r\n <>x") for _ in range(n))
    rows = [(i, f"http://h/{i}", text(rnd.choice([0, 5, 300, 5000]))) for i in range(40)]
    rows += [(100 + i, "http://copy/", rows[3][2]) for i in range(5)] + [(200, None, None), (201, "http://e/", "")]
    rows += [(300, "http://tricky/", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" * 3), (301, "http://tri cky/\r\nX: y", "é" * 9000)]
    rows += [(None, "http://nokey/", "lone"), (7, "http://again/", "twice"), (7, "http://again/", "twice")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = scratch_path(spark, "test-warc")
    warc.write_archives(d.selectExpr("*", "html as sha", "url as n"), path, segment=900, chunk=128)
    got = warc.read_archives(spark, path).collect()
    out = sorted(((int(r["page"]) if r["page"] else None, r["payload_bytes"], r["payload_digest"], r["record_type"],
                   int(r["refers_to"]) if r["refers_to"] else None) for r in got), key=repr)
    assert out == expected(rows)
    stored = {(r["page"], r["payload"].decode()) for r in got if r["record_type"] == "response"}
    assert ("301", "é" * 9000) in stored and ("300", rows[-5][2]) in stored
    kinds = [f["warc-type"] for (data,) in spark.read.format("binaryFile").load(path).select("content").collect()
             for f, _ in warc.parse(bytes(data))]
    assert kinds.count("continuation") > 20 and kinds.count("revisit") == sum(r[3] == "revisit" for r in out)


def test_empty_table(spark):
    path = scratch_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_framing():
    for n in (0, 1, 9, 10, 11, 1000):
        data = bytes(range(256)) * 4
        assert warc.dechunked(warc.chunked(data[:n], 10)) == data[:n]
    assert warc.dechunked(b"4;ext=1\r\nWiki\r\n0\r\nTrailer: x\r\n\r\n") == b"Wiki"
    with pytest.raises(ValueError):
        warc.dechunked(b"4\r\nWikipedia\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort\r\n\r\n"))


def test_a_lost_segment_is_an_error(spark):
    recs = warc.records(1, "5", "http://x/", b"z" * 5000, None, "2024-01-01T00:00:00Z", 1000, 500)
    assert len(recs) > 3
    path = scratch_path(spark, "test-warc")
    keep = [r for i, r in enumerate(recs) if i != 2]
    spark.createDataFrame([(r.decode(),) for r in keep], "value string").coalesce(1) \
        .write.option("lineSep", "\r\n\r\n").text(path)
    with pytest.raises(Exception, match="segments"):
        warc.read_archives(spark, path).collect()
