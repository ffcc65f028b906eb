"""How the vocabulary of each source differs from that of the other sources of its language.

Terms are runs of letters and non-ASCII characters with A-Z lower-cased. Every map task counts its
terms in numpy over the bytes of many texts at once, packed by length: a term of up to 8 bytes is
one big-endian uint64, one of up to 16 bytes two, and each is sorted by radix passes of 16 bits and
counted by runs; longer terms fall into one bucket for each length, whose byte rows are sorted as
bytes. A document's number is the order inside a run, so that the same pass also counts documents.
The packing has no ambiguity, since no term holds a zero byte.

Counts are summed by Spark per (language, source, term). The terms of a language that occur in at
least ``min_docs`` of its documents are kept; for p = 1 + floor(SCALE * (count + 2) / (N + 2 V)) of
the group and q of another source or of the whole language, f = floor((p - q)^2 / (p + q)). Sums of
f over all kept terms for all pairs of sources come from blocks of terms: a block is a dense
(terms x sources) table inside one task. All arithmetic is in 64-bit integers without overflow
while N + 2 V < 9e15.

Cases: null text, language or source is the empty string; a group without terms has counts of 0;
without kept terms all pairs have 0 and there are no term rows; a language with one source has no
pairs; repeated rows count each; an empty table gives no rows; further columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from balsam.llm.common import give_back
from balsam.session import scratch_path

SCALE_STEPS = 3  # SCALE = 1000 ** 3
#: Bytes of text that are counted at once (a longer text is counted alone).
CHUNK = 6 << 20
#: Cells (kept terms x sources of the language) of a block of the pair table.
CELLS = 20_000

_BYTE = np.arange(256)
_IN_TERM = (_BYTE >= 0x80) | ((_BYTE >= 0x41) & (_BYTE <= 0x5A)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A))
_LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """Stable order of rows by unsigned integer columns, the first one most significant: counting
    passes over 16 bits from the last digit to the first; digits that are all the same are skipped."""
    order = None
    for column in reversed(columns):
        for shift in range(0, column.dtype.itemsize * 8, 16):
            digit = (column >> column.dtype.type(shift)).astype(np.uint16) if column.dtype.itemsize > 2 else column.astype(np.uint16)
            if not len(digit) or (digit == digit[0]).all():
                continue
            order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(columns[0])) if order is None else order


def _runs(columns: list[np.ndarray], doc: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that begin a run, rows in it, different documents in it)."""
    changed = np.zeros(len(order), bool)
    changed[0] = True
    for c in columns:
        s = c[order]
        changed[1:] |= s[1:] != s[:-1]
    d = doc[order]
    fresh = changed.copy()
    fresh[1:] |= d[1:] != d[:-1]
    at = np.flatnonzero(changed)
    return order[at], np.diff(np.append(at, len(order))), np.add.reduceat(fresh.astype(np.int64), at)


def count_terms(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Count the terms of the texts ``data[offsets[i]:offsets[i + 1]]`` of the groups ``group[i]``.
    Returns parts (group, term lengths, term bytes as rows, occurrences, documents)."""
    inside = _IN_TERM[data]
    if not inside.any():
        return []
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    length = np.flatnonzero(ends) + 1 - start
    doc = np.searchsorted(offsets, start, side="right") - 1
    lower = np.append(_LOWER[data], np.zeros(16, np.uint8))
    parts = []
    for low, high in ((1, 8), (9, 16)):
        at = np.flatnonzero((length >= low) & (length <= high))
        if not len(at):
            continue
        rows = lower[start[at, None] + np.arange(high)]
        rows[np.arange(high) >= length[at, None]] = 0
        packed = rows.view(">u8").astype(np.uint64)
        words = [np.ascontiguousarray(packed[:, i]) for i in range(high // 8)]
        parts.append(_counted(at, rows, length, doc, group, words, radix_order))
    for n in np.unique(length[length > 16]):
        at = np.flatnonzero(length == n)
        rows = lower[start[at, None] + np.arange(n)]
        parts.append(_counted(at, rows, length, doc, group, [rows.view(f"S{n}").ravel()], _byte_order))
    return parts


def _byte_order(columns: list[np.ndarray]) -> np.ndarray:
    group, rows = columns
    by_rows = np.argsort(rows, kind="stable")
    return by_rows[np.argsort(group[by_rows], kind="stable")]


def _counted(at, rows, length, doc, group, words, order_of):
    of = group[doc[at]]
    columns = [of, *words]
    first, n, docs = _runs(columns, doc[at], order_of(columns))
    return of[first], length[at[first]], rows[first], n, docs


def _strings(rows: np.ndarray, length: np.ndarray) -> pa.Array:
    data = rows[np.arange(rows.shape[1]) < length[:, None]]
    offsets = np.append(0, np.cumsum(length)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    a = total = 0
    for b, n in enumerate(sizes.tolist()):
        if b > a and total + n > CHUNK:
            yield a, b
            a, total = b, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, n_docs) of every group, with one row of term '' and n = 0 for each
    group that occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pairs = pa.table({"l": batch.column(1), "s": batch.column(2)})
            known = pairs.group_by(["l", "s"]).aggregate([])
            index = {k: i for i, k in enumerate(zip(known["l"].to_pylist(), known["s"].to_pylist()))}
            group = np.fromiter((index[k] for k in zip(pairs["l"].to_pylist(), pairs["s"].to_pylist())), np.uint32, batch.num_rows)
            langs, sources = known["l"].combine_chunks(), known["s"].combine_chunks()
            none = np.zeros(known.num_rows, np.int64)
            yield _batch(langs, sources, pa.array([""] * known.num_rows), none, none)
            order = np.argsort(group, kind="stable")  # texts of a group side by side: fewer rows leave
            text, group = batch.column(0).cast(pa.string()).take(pa.array(order)), group[order]
            size = np.diff(np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4))
            for a, b in _chunks(size):
                part = text.slice(a, b - a)
                offsets = np.frombuffer(part.buffers()[1], np.int32, b - a + 1, part.offset * 4).astype(np.int64)
                data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
                for of, length, rows, n, n_docs in count_terms(data, offsets - offsets[0], group[a:b]):
                    of = pa.array(of)
                    yield _batch(langs.take(of), sources.take(of), _strings(rows, length), n, n_docs)
        give_back()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    got = docs.select(text(text_col).alias("text"), text(lang_col).alias("lang"), text(source_col).alias("source")) \
        .mapInArrow(run, "lang string, source string, term string, n long, n_docs long")
    return got.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def _batch(langs, sources, terms, n, n_docs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs, sources, terms, pa.array(n, pa.int64()), pa.array(n_docs, pa.int64())],
                                      names=["lang", "source", "term", "n", "n_docs"])


def share(n: np.ndarray, total: np.ndarray | int, terms: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)) by long division, base 1000."""
    by = total + 2 * terms
    rest, out = n + 2, np.zeros_like(n)
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        out = out * 1000 + rest // by
        rest = rest % by
    return out + 1


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source") -> DataFrame:
    """Rows (lang, source, part, item, value, rank): ``pair`` for every other source of the language,
    ``term`` for the ``top`` terms that the source uses more than its language does."""
    spark = docs.sparkSession
    path = scratch_path(spark, "terms")
    term_counts(docs, text_col, lang_col, source_col).write.parquet(path)
    counts = spark.read.parquet(path)
    groups = counts.filter("term = ''").select("lang", "source")
    kept = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("n_docs").alias("docs")) \
        .filter(F.col("docs") >= min_docs).drop("docs")
    # one row per language, and one per group: as many as the output has pairs, at most
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n_lang").alias("total_lang"))
    used = counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang")
    used_path = scratch_path(spark, "kept-terms")
    used.write.parquet(used_path)
    used = spark.read.parquet(used_path)
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left") \
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "total_lang")])
    groups_path = scratch_path(spark, "groups")
    groups.write.parquet(groups_path)
    groups = spark.read.parquet(groups_path)
    return _ranked(_pairs(used, groups), "pair", None).unionByName(_ranked(_terms(used, groups), "term", top))


def _ranked(rows: DataFrame, part: str, top: int | None) -> DataFrame:
    """Ranks per group; with ``top`` Spark keeps the first rows of each group before it shuffles."""
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = rows.withColumn("rank", F.row_number().over(by))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _terms(used: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of terms with p > q."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, n_lang, total, terms, total_lang = (batch.column(i).to_numpy() for i in range(3, 8))
            p, q = share(n, total, terms), share(n_lang, total_lang, terms)
            at = np.flatnonzero((p > q) & (n > 0))
            value = (p[at] - q[at]) ** 2 // (p[at] + q[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(at)) for i in range(3)), pa.array(value)],
                                             names=["lang", "source", "item", "value"])

    return used.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "n_lang", "total", "terms", "total_lang") \
        .mapInArrow(run, "lang string, source string, item string, value long")


def _pairs(used: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): sums of f over all kept terms for all pairs of sources. The terms
    of a language are dealt to blocks of about ``CELLS`` cells, each with a copy of the language's
    groups; a block gives the sums of its pairs."""
    sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    sized = groups.filter("terms > 0").join(sources, "lang") \
        .withColumn("blocks", F.ceil(F.col("terms") * F.col("sources") / CELLS).cast("int"))
    sides = sized.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sized = used.join(sized.select("lang", "source", "blocks"), ["lang", "source"])
    dealt = sized.select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"))

    def run(counts: pa.Table, side: pa.Table) -> pa.Table:
        sources = side.column("source").to_pylist()
        index = {s: i for i, s in enumerate(sources)}
        terms = {t: i for i, t in enumerate(counts.column("term").unique().to_pylist())}
        n = np.zeros((len(sources), len(terms)), np.int64)
        at = np.fromiter((index[s] for s in counts.column("source").to_pylist()), np.int64, counts.num_rows)
        of = np.fromiter((terms[t] for t in counts.column("term").to_pylist()), np.int64, counts.num_rows)
        n[at, of] = counts.column("n").to_numpy()
        p = share(n, side.column("total").to_numpy()[:, None], side.column("terms").to_numpy()[:, None])
        value = np.zeros((len(sources), len(sources)), np.int64)
        for i in range(len(sources)):  # f is symmetric
            value[i, i + 1:] = ((p[i] - p[i + 1:]) ** 2 // (p[i] + p[i + 1:])).sum(1)
        value += value.T
        a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
        names = pa.array(sources, pa.string())
        return pa.table({"lang": pa.repeat(side.column("lang")[0], len(a)), "source": names.take(pa.array(a)),
                         "item": names.take(pa.array(b)), "value": pa.array(value[a, b])})

    summed = dealt.groupBy("lang", "block").cogroup(sides.groupBy("lang", "block")) \
        .applyInArrow(run, "lang string, source string, item string, value long")
    others = groups.select("lang", F.col("source").alias("item"))
    empty = groups.filter("terms = 0").join(others, "lang").filter("source <> item") \
        .select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    return summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).unionByName(empty)
