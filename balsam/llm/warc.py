"""WARC archives: written with segments, chunked framing and revisits, and read back.

A page becomes a response record whose block is an HTTP message with the payload in chunks. Of
pages with equal payloads only that with the largest key is stored; the others are revisit records
with the HTTP head alone. A block of more than ``segment`` bytes is split: the record holds the
first segment and continuation records, which name its identifier as their origin, the others; the
last one tells the total length.

Archives are files of Spark's text writer: the bytes of a record are one value, and the separator
of lines is the two line ends that close a record. A file ends after ``RECORDS`` records. They are
read as binary files, record by record by Content-Length, so payloads may hold anything.
Continuations are grouped by their origin, put in order and checked against the total length.

Cases: a null payload is an empty one; pages with equal keys are records of their own, and if they
share the largest key of their payload all are responses; null keys revisit unless no page with
that payload has a key.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balsam.session import scratch_path

RECORDS = 2_000
END = b"\r\n\r\n"
#: Up to so many groups of equal payloads go to all executors instead of shuffling the pages.
MAX_BROADCAST = 500_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(payload[i:i + size]), payload[i:i + size])
             for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Payload of a chunked body; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";", 1)[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n:at + n + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its length says")
        out.append(body[at:at + n])
        at += n + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def records(serial: int, key: str, url: str, payload: bytes, refers: str | None, date: str,
            segment: int, chunk: int) -> list[bytes]:
    """The records of a page."""
    rid = f"urn:page:{serial}:{key}"
    fields = [("WARC-Type", "revisit" if refers is not None else "response"), ("WARC-Record-ID", f"<{rid}>"),
              ("WARC-Date", date), ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
              ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", f"<urn:page:{refers}>")]
        return [_record(fields, head + b"Content-Length: %d\r\n\r\n" % len(payload))]
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    if len(block) <= segment:
        return [_record(fields, block)]
    parts = [block[i:i + segment] for i in range(0, len(block), segment)]
    out = [_record([*fields, ("WARC-Segment-Number", "1")], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{rid}:segment:{n}>"), ("WARC-Date", date),
                ("WARC-Segment-Origin-ID", f"<{rid}>"), ("WARC-Segment-Number", str(n))]
        if n == len(parts):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(more, part))
    return out


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_payload: int = 0, segment: int = 16_384,
                   chunk: int = 4_096, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the archives of ``pages`` to the folder ``path``. Payloads of fewer than
    ``min_payload`` bytes are never revisits."""
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col(key).alias("key"), F.coalesce(url_col, F.lit("")).alias("url"), body.alias("payload")) \
        .withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    groups = scratch_path(pages.sparkSession, "warc-groups")
    base.filter(F.col("n") >= min_payload).groupBy("sha", "n") \
        .agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1") \
        .select("sha", "n", "first").write.parquet(groups)
    equal = pages.sparkSession.read.parquet(groups)
    if equal.count() <= MAX_BROADCAST:
        equal = F.broadcast(equal)
    marked = base.join(equal, ["sha", "n"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    rows = marked.select(F.monotonically_increasing_id().alias("serial"),
                         F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), "url", "payload",
                         F.when(revisit, F.col("first").cast("string")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                cols = [batch.column(i).slice(at, 500).to_pylist() for i in range(5)]
                out = [r for row in zip(*cols) for r in records(*row, date, segment, chunk)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")) \
        .write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive."""
    at = 0
    while at < len(data):
        if data[at:at + 10] != b"WARC/1.1\r\n":
            raise ValueError(f"no record begins at byte {at}")
        end = data.index(END, at)
        fields = {}
        for line in data[at + 10:end].split(b"\r\n"):
            k, _, v = line.partition(b":")
            fields[k.decode().lower()] = v.strip().decode()
        n = int(fields["content-length"])
        block = data[end + 4:end + 4 + n]
        if len(block) != n or data[end + 4 + n:end + 8 + n] != END:
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield fields, block
        at = end + 8 + n


_COLS = ("record_id string, record_type string, url string, digest string, refers_to string, "
         "segment int, origin string, total long, block binary")
_OUT = ("record_id string, page string, url string, record_type string, refers_to string, "
        "payload binary, payload_bytes long, payload_digest string")


def _decoded(rid: str, kind: str, url: str, sha: str, refers: str | None, block: bytes) -> tuple:
    head, _, body = block.partition(END)
    names = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    page = rid[len("urn:page:"):].split(":", 1)[1]
    if kind == "revisit":
        return rid, page, url, kind, refers, None, int(names[b"content-length"]), sha
    payload = dechunked(body) if names.get(b"transfer-encoding") == b"chunked" else body
    if digest(payload) != sha:
        raise ValueError(f"the payload of {rid} does not have its digest")
    return rid, page, url, kind, None, payload, len(payload), sha


def _out(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.binary(), pa.int64(), pa.string()]
    cols = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      names=[c.split()[0] for c in _OUT.split(", ")])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per page of the archives at ``path``: record_id, page (its key as text), url,
    record_type, refers_to (the response's key as text), payload (null for revisits), and the full
    payload's length and digest."""
    files = spark.read.format("binaryFile").load(path).select("content")
    kinds = [pa.string()] * 5 + [pa.int32(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in _COLS.split(", ")]

    def found(data: bytes, segmented: bool) -> Iterator[tuple]:
        plain = lambda k: f[k][1:-1] if k in f else None
        for f, block in parse(data):
            if ("warc-segment-number" in f) == segmented:
                yield (plain("warc-record-id"), f["warc-type"], f.get("warc-target-uri"),
                       f.get("warc-payload-digest", "")[len("sha1:"):],
                       (plain("warc-refers-to") or "")[len("urn:page:"):] or None,
                       int(f.get("warc-segment-number", 0)), plain("warc-segment-origin-id"),
                       int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, block)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = [_decoded(*r[:5], r[8]) for r in found(data.as_py(), False)]
                for at in range(0, len(rows), 500):
                    yield _out(rows[at:at + 500])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = list(found(data.as_py(), True))
                for at in range(0, len(rows), 500):
                    cols = zip(*rows[at:at + 500])
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for origin, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                numbers = [p["segment"] for p in parts]
                if numbers != list(range(1, len(parts) + 1)):
                    raise ValueError(f"{origin} has the segments {numbers}")
                block = b"".join(p["block"] for p in parts)
                if parts[-1]["total"] != len(block):
                    raise ValueError(f"{origin} has {len(block)} bytes, not {parts[-1]['total']}")
                f = parts[0]
                rows.append(_decoded(origin, f["record_type"], f["url"], f["digest"], f["refers_to"], block))
            yield _out(rows)

    segments = files.mapInArrow(split, _COLS).groupBy(F.coalesce("origin", "record_id").alias("origin")) \
        .agg(F.sort_array(F.collect_list(F.struct("segment", "total", "record_type", "url", "digest",
                                                  "refers_to", "block"))).alias("parts"))
    return files.mapInArrow(whole, _OUT).unionByName(segments.mapInArrow(joined, _OUT))
