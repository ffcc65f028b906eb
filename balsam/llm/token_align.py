"""Alignment of the tokens of two tokenizers over the same bytes, by interval coalescing.

A text is encoded by a byte-level BPE (A) and a sentence-piece model (B); both cover the bytes of a
space and the text. All A and B tokens of many texts, as byte intervals one text after the other,
are sorted by start with one stable sort; the running maximum of their ends (``maximum.accumulate``)
tells the groups: a group breaks where a start reaches the maximum so far, which is where tokens of
both sides end. Within a group the overlaps are expanded: at each start of a token the latest A and
the latest B token overlap, and no other pair does. Pairs that end together are the links
(``links="overlap"`` links all overlapping pairs).

:func:`align` gives the groups themselves. :func:`link_statistics` encodes each text once, writes the
distinct id pairs of each document with their numbers to the shared folder, sums them over the
corpus and reads the table again to score every document's links. The corpus-wide pairs are sent to
the tasks where they are at most ``MAX_PAIRS``; beyond that the documents' pairs are joined with
them: those in more than a ``HOT_SHARE``-th of all rows, which are no more than that number, by
broadcast, the others by a shuffle.

A is encoded by merging on ids where the driver has found that this gives the tokens of A's file, for
texts up to U+FFFF, and else by the file's own library.

The tokenizer files are read by the driver, whose paths are parameters, and are at most ``MAX_FILE``
bytes each.

Cases: a null or empty text, and one whose joined A or B bytes differ from space and text, has no
tokens; strings of special tokens are plain text; repeated rows and null or repeated keys each
give their own row; a text of any length is encoded whole; further columns are never read; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balsam.llm.common import give_back
from balsam.session import scratch_path

MAX_FILE = 64 << 20
#: Largest table of id pairs (17 bytes each) that is sent to the tasks.
MAX_PAIRS = 4_000_000
HOT_SHARE = 10_000
#: Bytes of text that are encoded at once (a longer text is encoded alone).
CHUNK = 1 << 20
#: List entries that a task looks at at once.
VALUES = 2_000_000


def default_files() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _file(path: str) -> bytes:
    if os.path.getsize(path) > MAX_FILE:
        raise ValueError(f"{path} has more than {MAX_FILE} bytes")
    with open(path, "rb") as f:
        return f.read()


#: The pattern of the byte-level pre-tokenizer.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranks(tokenizer: bytes) -> dict[bytes, int] | None:
    """Ids by token bytes if merging the neighbours whose joined bytes have the smallest id gives the
    tokenizer's own tokens; else None.

    Both ways do so when ids ascend as the merges do and every token's own bytes are encoded as that
    token. For a pair that is next to each other and whose bytes are a token's was merged from those
    bytes alone, as their encoding merges them; its last two parts are the ones of the token's rule."""
    from tokenizers import Tokenizer

    spec = json.loads(tokenizer)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (not any(spec.get(x) for x in ("normalizer", "post_processor", "truncation", "padding"))
             and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
             and all(x["special"] for x in spec.get("added_tokens") or ()) and model.get("type") == "BPE"
             and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                                "fuse_unk", "byte_fallback", "ignore_merges")))
    byte_of, vocab = _byte_of_char(), model["vocab"]
    if not plain or not all(c in vocab for c in byte_of):
        return None
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(x >= y for x, y in zip(merged, merged[1:])) or len(merged) + len(byte_of) != len(vocab):
        return None
    own = Tokenizer.from_str(tokenizer.decode("utf-8")).model
    if any([x.id for x in own.tokenize(t)] != [i] for t, i in vocab.items()):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}


def _fast(tokenizer: bytes) -> dict[bytes, int] | None:
    """``_ranks``, if the library that works on them classes each character up to U+FFFF alike."""
    try:
        import tiktoken
    except ImportError:
        return None
    ranks = _ranks(tokenizer)
    if ranks is None:
        return None
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(tokenizer.decode("utf-8"))
    own.encode_special_tokens = True
    other = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    signs = [chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(signs), 4096):  # after a letter, a digit, a sign, and before a space
        text = "".join(f"a{c}1{c}!{c} " for c in signs[at:at + 4096])
        if own.encode(text, add_special_tokens=False).ids != other.encode_ordinary(text):
            return None
    return ranks


def _byte_of_char() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others, in order, for
    the characters from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers and the bytes of their ids."""

    def __init__(self, a: bytes, b: bytes, ranks: dict[bytes, int] | None = None):
        """``ranks``: see ``_fast``; without them the tokenizer's own library encodes A."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode("utf-8"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        byte_of = _byte_of_char()
        size = self.a.get_vocab_size()
        vocab = self.a.get_vocab()
        size = max([size, *(i + 1 for i in vocab.values())])
        self.bytes_a = [b""] * size
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode("utf-8")
                        for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        top = max(len(self.bytes_a), len(self.bytes_b))
        width = len(str(top - 1))
        self.digits = np.array([list(str(i).zfill(width).encode()) for i in range(top)], np.uint8)
        self.n_digits = np.array([len(str(i)) for i in range(top)], np.int64)
        self.fast = None
        if ranks is not None:
            import tiktoken
            self.fast = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        """Ids of A."""
        low = [self.fast is not None and len(t.encode("utf-16-le")) == 2 * len(t) for t in texts]  # all up to U+FFFF
        rest = iter(self.a.encode_batch_fast([t for t, x in zip(texts, low) if not x], add_special_tokens=False))
        return [self.fast.encode_ordinary(t) if x else next(rest).ids for t, x in zip(texts, low)]

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B by text; both empty for texts without tokens."""
        a, b = [[] for _ in texts], [[] for _ in texts]
        live = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in live]
        got_a = self.encode_a(spaced)
        got_b = self.b.encode([texts[i] for i in live], num_threads=1)
        for i, text, x, y in zip(live, spaced, got_a, got_b):
            data = text.encode("utf-8")
            if b"".join([self.bytes_a[t] for t in x]) == data and b"".join([self.bytes_b[t] for t in y]) == data:
                a[i], b[i] = x, y
        return a, b


class Alignment:
    """Tokens of consecutive texts as byte intervals, coalesced into groups."""

    def __init__(self, a: list[list[int]], b: list[list[int]], len_a: np.ndarray, len_b: np.ndarray):
        self.n_a, self.n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        self.a, self.b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, self.n_a), (b, self.n_b)))
        self.doc_a = np.repeat(np.arange(len(a)), self.n_a)
        size_a, size_b = len_a[self.a], len_b[self.b]
        self.end_a, self.end_b = np.cumsum(size_a), np.cumsum(size_b)
        self.start_a, self.start_b = self.end_a - size_a, self.end_b - size_b
        n = len(self.a)
        start, end = np.concatenate([self.start_a, self.start_b]), np.concatenate([self.end_a, self.end_b])
        is_b = np.arange(len(start)) >= n
        self.order = np.argsort(start, kind="stable")  # two sorted runs, A before B
        self._start, self._is_b = start[self.order], is_b[self.order]
        reach = np.maximum.accumulate(end[self.order]) if len(start) else end
        self.group = np.zeros(len(start), np.int64)  # of the tokens in order
        self.group[1:] = np.cumsum(self._start[1:] >= reach[:-1])
        self.group_a, self.group_b = self.group[~self._is_b], self.group[self._is_b]
        self.n_groups = int(self.group[-1]) + 1 if len(start) else 0
        first = np.searchsorted(self.group_a, np.arange(self.n_groups))
        self.doc_of_group = self.doc_a[first]

    def links(self, kind: str = "end") -> tuple[np.ndarray, np.ndarray]:
        """Positions of the linked A and B tokens."""
        n = len(self.a)
        at = np.arange(len(self.order))
        last_a = self.order[np.maximum.accumulate(np.where(self._is_b, 0, at))] if len(at) else at
        last_b = self.order[np.maximum.accumulate(np.where(self._is_b, at, 0))] - n if len(at) else at
        whole = np.ones(len(at), bool)  # all tokens with this start have been seen
        whole[:-1] = self._start[1:] != self._start[:-1]
        x, y = last_a[whole], last_b[whole]
        if kind == "overlap":
            return x, y
        together = self.end_a[x] == self.end_b[y]
        return x[together], y[together]

    def digests(self, pair: Pair) -> list[str]:
        """SHA-256 of `a1,a2|b1;a3|b2` by text; '' without tokens."""
        order = np.argsort(2 * self.group + self._is_b, kind="stable")
        token, is_b, group = self.order[order], self._is_b[order], self.group[order]
        doc = self.doc_of_group[group]
        ids = np.concatenate([self.a, self.b])[token]
        after = np.full(len(ids), ord(","), np.uint8)
        after[:-1][is_b[1:] != is_b[:-1]] = ord("|")
        after[:-1][group[1:] != group[:-1]] = ord(";")
        ends = np.ones(len(ids), bool)
        ends[:-1] = doc[1:] != doc[:-1]
        rows = np.concatenate([pair.digits[ids], after[:, None]], axis=1)
        width = pair.digits.shape[1]
        shown = np.arange(width + 1) >= width - pair.n_digits[ids][:, None]
        shown[ends, width] = False
        data = rows[shown].tobytes()
        stop = np.cumsum(pair.n_digits[ids] + 1 - ends)
        out = [""] * len(self.n_a)
        begin = 0
        for d, e in zip(doc[ends].tolist(), stop[ends].tolist()):
            out[d] = hashlib.sha256(data[begin:e]).hexdigest()
            begin = e
        return out


_LOADED: dict[int, Pair] = {}


def _pair(files) -> Pair:
    if files.id not in _LOADED:  # once per worker process
        _LOADED.clear()
        _LOADED[files.id] = Pair(*files.value)
    return _LOADED[files.id]


class _Files:
    """Broadcast contents of both files, with a name for the workers' cache."""

    def __init__(self, shared, name: str):
        self.shared, self.id = shared, name

    @property
    def value(self):
        return self.shared.value


def _files(docs: DataFrame, a: str | None, b: str | None) -> _Files:
    own = default_files() if a is None or b is None else (a, b)
    data = _file(a or own[0]), _file(b or own[1])
    return _Files(docs.sparkSession.sparkContext.broadcast((*data, _fast(data[0]))), hashlib.sha256(data[0] + b"|" + data[1]).hexdigest())


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list]]:
    """(first row, texts) of at most ``CHUNK`` characters, or one text."""
    texts, size, first = [], 0, 0
    for i, t in enumerate(batch.column(column)):
        t = t.as_py()
        n = len(t or "")
        if texts and size + n > CHUNK:
            yield first, texts
            texts, size, first = [], 0, i
        texts.append(t)
        size += n
    if texts:
        yield first, texts


def align(docs: DataFrame, a: str | None = None, b: str | None = None, key: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """A row per row: key and ``groups``, an array of (start, end, a, b): byte range in space + text
    and the ids of both tokenizers."""
    files = _files(docs, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(files)
        for batch in batches:
            for first, texts in _chunks(batch, 1):
                al = Alignment(*pair.encode(texts), pair.len_a, pair.len_b)
                n = np.arange(al.n_groups + 1)
                off_a, off_b = np.searchsorted(al.group_a, n), np.searchsorted(al.group_b, n)
                begin = al.start_a[off_a[:-1]] if al.n_groups else np.zeros(0, np.int64)
                end = al.end_a[off_a[1:] - 1] if al.n_groups else begin
                per_doc = np.bincount(al.doc_of_group, minlength=len(texts))
                offsets = np.append(0, np.cumsum(per_doc))
                base = begin[offsets[:-1][per_doc > 0]]
                base = np.repeat(base, per_doc[per_doc > 0])
                lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v, pa.int32()))
                         for o, v in ((off_a, al.a), (off_b, al.b))]
                rows = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base), *lists], ["start", "end", "a", "b"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)],
                    names=["key", "groups"])
        give_back()

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, groups array<struct<start: long, end: long, a: array<int>, b: array<int>>>"
    return docs.select(key, text_col).mapInArrow(run, schema).withColumnRenamed("key", key)


def _encoded(docs: DataFrame, files: _Files, sizes: tuple[int, int], key: str, text_col: str, links: str) -> DataFrame:
    """(key, row, n_a, n_b, n_groups, n_links, groups_sha256, codes, ns): ``codes`` are the distinct
    linked pairs a * |B| + b of the text and ``ns`` their numbers."""
    code_type = "int" if sizes[0] * sizes[1] < 2 ** 31 else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(files)
        for batch in batches:
            for first, texts in _chunks(batch, 1):
                al = Alignment(*pair.encode(texts), pair.len_a, pair.len_b)
                x, y = al.links(links)
                doc = al.doc_a[x]
                code = al.a[x] * sizes[1] + al.b[y]
                both = np.sort(doc * (sizes[0] * sizes[1]) + code)
                at = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
                count = np.diff(np.append(at, len(both)))
                doc_s, code_s = np.divmod(both[at], sizes[0] * sizes[1])
                offsets = pa.array(np.searchsorted(doc_s, np.arange(len(texts) + 1)), pa.int32())
                per_doc = lambda d: pa.array(np.bincount(d, minlength=len(texts)), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), batch.column(2).slice(first, len(texts)),
                     pa.array(al.n_a), pa.array(al.n_b), per_doc(al.doc_of_group), per_doc(doc), pa.array(al.digests(pair), pa.string()),
                     pa.ListArray.from_arrays(offsets, pa.array(code_s, pa.int32() if code_type == "int" else pa.int64())),
                     pa.ListArray.from_arrays(offsets, pa.array(count, pa.int32()))],
                    names=["key", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "ns"])
        give_back()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_col, F.monotonically_increasing_id().alias("row")).mapInArrow(
        run, f"key {kind}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
             f"codes array<{code_type}>, ns array<int>")


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``VALUES`` list entries in ``column``, a row at least."""
    for batch in batches:
        total = np.append(0, np.cumsum(batch.column(column).value_lengths().to_numpy().astype(np.int64)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + VALUES, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64)


def pair_counts(encoded: DataFrame, size_b: int) -> DataFrame:
    """(code, n, rows, best) of all documents: links that hold the pair, documents that have it, and
    whether no pair of the same B id is more frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "codes"):  # summed inside each part before anything is shuffled
            codes, ns = _flat(batch.column(0)), _flat(batch.column(1))
            order = np.argsort(codes, kind="stable")
            codes, ns = codes[order], ns[order]
            at = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
            n = np.add.reduceat(ns, at) if len(at) else ns
            yield pa.RecordBatch.from_arrays([pa.array(codes[at]), pa.array(n), pa.array(np.diff(np.append(at, len(codes))))],
                                             names=["code", "n", "rows"])
        give_back()

    summed = encoded.select("codes", "ns").mapInArrow(run, "code long, n long, rows long") \
        .groupBy("code").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    path = scratch_path(encoded.sparkSession, "pairs")
    summed.write.parquet(path)
    summed = encoded.sparkSession.read.parquet(path)
    most = summed.groupBy((F.col("code") % size_b).alias("b")).agg(F.max("n").alias("most"))  # as many as B ids
    return summed.join(most, F.col("code") % size_b == F.col("b")) \
        .select("code", "n", "rows", (F.col("n") == F.col("most")).alias("best"))


def link_statistics(docs: DataFrame, a: str | None = None, b: str | None = None, key: str = "doc_id",
                    text_col: str = "text", links: str = "end", max_pairs: int = MAX_PAIRS) -> DataFrame:
    """A row per row: key, n_a, n_b, n_groups, n_links, ``n_best`` (links whose pair is the most
    frequent of its B id in the corpus), ``count_sum`` (of the pairs' counts over the links) and
    groups_sha256."""
    spark = docs.sparkSession
    files = _files(docs, a, b)
    pair = Pair(*files.value)
    size_b = len(pair.bytes_b)
    path = scratch_path(spark, "aligned")
    _encoded(docs, files, (len(pair.bytes_a), size_b), key, text_col, links).write.parquet(path)
    encoded = spark.read.parquet(path)
    counts_path = scratch_path(spark, "pair-counts")
    pair_counts(encoded, size_b).write.parquet(counts_path)
    counts = spark.read.parquet(counts_path)
    if counts.count() <= max_pairs:
        scored = _scored_in_task(encoded, counts)
    else:
        scored = _scored_by_join(encoded, counts)
    return scored.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _scored_in_task(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    table = counts.select("code", "n", "best").toArrow().sort_by("code")  # at most max_pairs rows
    shared = encoded.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("code", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = shared.value
        for batch in _slices(batches, "codes"):
            codes, ns = _flat(batch.column("codes")), _flat(batch.column("ns"))
            at = np.searchsorted(code, codes)
            lists = batch.column("codes")
            offsets = np.append(0, np.cumsum(lists.value_lengths().to_numpy().astype(np.int64)))
            sums = []
            for value in (ns * best[at], ns * n[at]):
                total = np.append(0, np.cumsum(value))  # exact modulo 2^64, and so are the differences
                sums.append(pa.array(total[offsets[1:]] - total[offsets[:-1]], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *sums], names=[*kept, "n_best", "count_sum"])
        give_back()

    kept = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = ", ".join(f"{c} {encoded.schema[c].dataType.simpleString()}" for c in kept)
    return encoded.mapInArrow(run, f"{schema}, n_best long, count_sum long")


def _scored_by_join(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    pairs = encoded.select("row", F.explode(F.arrays_zip("codes", "ns")).alias("p")) \
        .select("row", F.col("p.codes").cast("long").alias("code"), F.col("p.ns").cast("long").alias("k"))
    share = (counts.agg(F.sum("rows")).first()[0] or 0) // HOT_SHARE + 1
    hot, cold = counts.filter(F.col("rows") > share).drop("rows"), counts.filter(F.col("rows") <= share).drop("rows")
    first = pairs.join(F.broadcast(hot), "code", "left")
    both = first.filter("n is not null").unionByName(first.filter("n is null").drop("n", "best").join(cold, "code"))
    sums = both.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"),
                                   F.sum(F.col("k") * F.col("n")).alias("count_sum"))
    return encoded.drop("codes", "ns").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
