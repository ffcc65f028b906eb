"""Text operators on DataFrames (inventory D)."""

from __future__ import annotations

import hashlib
import re
import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balsam.functions import text as T


def optional_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Keep the names present in ``df``; warn about (and skip) the others."""
    present = []
    for c in columns:
        if c in df.columns:
            present.append(c)
        else:
            warnings.warn(f"Column '{c}' not found in DataFrame; skipped")
    return present


def mask_text(df: DataFrame, columns: list[str], mask_entities: bool = True,
              mask_locations: bool = True, group_patterns: list[str] = T.GROUP_NAME_PATTERNS,
              location_terms: list[str] | None = None, fill: bool = True) -> DataFrame:
    """Mask group names (listed order) then place names (longest first), per column.

    Switches are plan-time ``if``s; a missing column warns and is skipped. With
    ``fill`` the text is ``fillna('')`` first, as the reference does before masking.
    """
    terms = T.PROVINCE_NAMES if location_terms is None else location_terms
    out = df
    for c in optional_columns(df, columns):
        e = T.fill_text(F.col(c)) if fill else F.col(c)
        if mask_entities:
            e = T.mask_patterns_ordered(e, group_patterns)
        if mask_locations:
            e = T.mask_terms_longest(e, terms)
        out = out.withColumn(c, e)
    return out


def leakage_scan(df: DataFrame, text_col: str, key: str,
                 term_sets: dict[str, list[str]] = T.LEAK_TERMS) -> DataFrame:
    """Full-table leakage audit: per term set, rows scanned, rows hit, hit rate and
    the smallest key among the hits. Lower-cased substring test, one pass, one
    tiny aggregate (partial aggregation map-side)."""
    low = F.lower(F.col(text_col))
    flags = {name: F.coalesce(
        F.greatest(*[low.contains(t) for t in ts]) if len(ts) > 1 else low.contains(ts[0]),
        F.lit(False)) for name, ts in term_sets.items()}
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, (name, fl) in enumerate(flags.items()):
        aggs += [F.sum(fl.cast("long")).alias(f"h{i}"), F.min(F.when(fl, F.col(key))).alias(f"k{i}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(name).alias("term_set"), F.col(f"h{i}").alias("n_hits"),
                     F.col(f"k{i}").alias("first_key")) for i, name in enumerate(flags)]
    return (one.select("n_rows", F.explode(F.array(*rows)).alias("s"))
            .select("s.term_set", "n_rows", F.coalesce("s.n_hits", F.lit(0)).cast("long").alias("n_hits"),
                    (F.coalesce("s.n_hits", F.lit(0)) / F.col("n_rows")).alias("hit_rate"),
                    "s.first_key"))


def embed_text(df: DataFrame, text_col: str, key: str, dim: int = 384,
               out: str = "embedding") -> DataFrame:
    """Feature-hashing sentence encoder -> (key, embedding array<double>[dim]).

    Tokens are lower-cased letter/digit runs; each token adds +-1 to the bucket md5(token) mod
    dim; the sum is L2-normalised (all zeros for empty text). All tokens of a document are in one
    row, so they are folded there and nothing is shuffled.
    """
    return embed_with(df, text_col, key, lambda: hashing_encoder(dim), out=out, name=f"hashing-{dim}")


PAD, UNK, CLS, SEP = 0, 1, 2, 3
FIRST_ID = 4
#: A vocabulary goes to every task, so it has a bound.
MAX_VOCABULARY = 1_000_000


def build_vocabulary(df: DataFrame, text_col: str, size: int = 30000) -> DataFrame:
    """Corpus vocabulary: the ``size`` tokens with the highest document frequency
    (ties by token), ids from 4 (0 pad, 1 unknown, 2 start, 3 end).

    The vocabulary size is the feature; the ranked table has at most ``size`` rows.
    """
    dfreq = (df.select(F.explode(F.array_distinct(T.word_tokens(F.col(text_col)))).alias("token"))
             .groupBy("token").agg(F.count(F.lit(1)).alias("df")))
    top = dfreq.orderBy(F.desc("df"), F.col("token")).limit(size)
    from pyspark.sql import Window
    w = Window.orderBy(F.desc("df"), F.col("token"))
    return top.select("token", "df", (F.row_number().over(w) + FIRST_ID - 1).cast("int").alias("token_id"))


def encode_sequences(df: DataFrame, text_col: str, key: str, vocab: DataFrame,
                     max_length: int = 128) -> DataFrame:
    """Fixed-length encoding: [start] ids [end] then padding, with attention mask. A row per row.

    The whole text is tokenised (``n_tokens`` counts all tokens); ids beyond
    ``max_length - 2`` are truncated, as the reference's tokenizer does. The vocabulary, of
    ``MAX_VOCABULARY`` tokens at most, goes to the tasks, which look ids up inside the row.
    """
    body = max_length - 2
    known = {r[0]: r[1] for r in vocab.select("token", "token_id").limit(MAX_VOCABULARY + 1).collect()}
    if len(known) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary has at most {MAX_VOCABULARY} tokens")

    def run(batches):
        get, place = known.get, np.arange(max_length)
        for batch in batches:
            toks = batch.column(2)
            n = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False)[:, None]
            ids = np.full((batch.num_rows, max_length), PAD, np.int32)
            # row by row, as the tokens lie in the column
            ids[(place >= 1) & (place <= n)] = [get(t, UNK) for t in toks.flatten().to_pylist()]
            ids[:, 0] = CLS
            ids[np.arange(len(n)), n[:, 0] + 1] = SEP
            on = (place <= n + 1).astype(np.int32)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * max_length
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.ListArray.from_arrays(ends, x.ravel()) for x in (ids, on)), batch.column(1)],
                names=["k", "input_ids", "attention_mask", "n_tokens"])

    toks = T.word_tokens(F.col(text_col))
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, toks.alias("__toks")) \
        .select(key, F.size("__toks").cast("long").alias("__n"), F.slice("__toks", 1, body).alias("__toks")) \
        .mapInArrow(run, f"k {kind}, input_ids array<int>, attention_mask array<int>, n_tokens long") \
        .withColumnRenamed("k", key)


# ---------------------------------------------------------------- user encoder hook

_ENCODERS: dict = {}
_TOKEN = re.compile(r"[^\W_]+")
#: Tokens remembered by an encoder; a memory bound without effect on results.
_TOKEN_CACHE = 500_000


class _Cells(dict):
    """Token -> its bucket, and its sign as the sign of the number (bucket + 1 or its negative)."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) >= _TOKEN_CACHE:
            self.clear()
        h = hashlib.md5(token.encode("utf-8", "surrogatepass")).hexdigest()
        b = int(h[:8], 16) % self.dim + 1
        r = self[token] = b if int(h[8], 16) < 8 else -b
        return r


def hashing_encoder(dim: int = 384):
    """The default encoder: ``encode(texts) -> ndarray[n, dim]`` by feature hashing."""

    cells = _Cells(dim)

    def encode(texts):
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            c = np.array(list(map(cells.__getitem__, _TOKEN.findall((t or "").lower()))), np.int64)
            if len(c):
                out[i] = np.bincount(np.abs(c) - 1, weights=np.sign(c), minlength=dim)
        norm = np.sqrt((out * out).sum(axis=1))
        return out / np.where(norm > 0, norm, 1.0)[:, None]
    return encode


def _encoder(name: str | None, factory):
    """The encoder called ``name`` of this worker, built at its first use; without a name a new one."""
    if name is None:
        return factory()
    if name not in _ENCODERS:
        _ENCODERS[name] = factory()
    return _ENCODERS[name]


def embed_with(df: DataFrame, text_col: str, key: str, factory=None, dim: int = 384,
               out: str = "embedding", batch_size: int = 32, name: str | None = None) -> DataFrame:
    """Embed text with a user-supplied model over Arrow batches.

    ``factory()`` returns ``encode(list[str]) -> ndarray[n, dim]``. With a ``name`` a worker
    builds the model once and keeps it under that name for later tasks; without one each task
    builds its own. Rows come in chunks of ``batch_size``, as the reference encodes them; the model
    never sees the whole corpus at once."""
    if factory is None:
        factory, name = (lambda: hashing_encoder(dim)), f"hashing-{dim}"

    def run(batches):
        encode = _encoder(name, factory)
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                v = np.asarray(encode(part.column(1).to_pylist()), dtype=np.float64)
                rows = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1], pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), rows], names=["key", out])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text_col).mapInArrow(run, f"key {kind}, {out} array<double>").withColumnRenamed("key", key)
