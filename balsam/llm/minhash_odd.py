"""Near-duplicate groups: MinHash bands propose pairs, odd sketches screen them, full sets decide.

1. One pass over the texts gives each document its number of distinct word shingles, a 128-bit
   digest of the sorted set, ``bands`` keys made of ``rows`` MinHash values each, and an odd
   sketch: the MinHash samples of one permutation (the smallest hash of each of many bins) flip
   one bit each of a bitmap. The XOR of two bitmaps holds the samples in which two documents
   differ, so its population count tells how many these are. Small sets have more bins than
   members, which makes the estimate nearly exact; large ones have fewer bins than members.
2. Equal sets become one node; a text copied any number of times is one row from here on.
3. Nodes that share a band key are paired with one node of that key only, that with the most
   neighbours. Pairs with more differing samples than a pair at the threshold has, by several
   standard deviations, go; the rest are confirmed on their full sets. Linked nodes merge.
4. Where a key still has nodes of several components, those outside its largest component are
   compared with the others of the key, under the same screen and each pair in the first key
   that it shares. So every pair that shares a key ends in one component or has been decided, and
   the pairs inside a large group are never made.

With the defaults a pair at similarity 0.8 shares no key with probability (1 - 0.8^6)^48, about
5e-7.

Cases: a null or empty text, or one without words, has an empty set and is linked with nothing;
a text of fewer words than a shingle has its whole word sequence as its one shingle; equal keys
are separate rows; a null key joins the groups, and a row without one represents a group only if
no row of the group has a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balsam.llm.common import free_name, give_back
from balsam.llm.components import components
from balsam.session import scratch_path

BITS = 4096
#: Bins of the permutation for sets of at most ``SMALL`` shingles, and for larger ones.
SMALL, FINE, COARSE = 1_000, 65_536, 2_048
#: Standard deviations by which a screened pair may exceed the threshold's expectation.
MARGIN = 5.0
#: Words remembered by a task; the memory bound of the cache, without effect on results.
CACHE = 150_000
#: Up to so many node ids go to all executors instead of shuffling the texts for them.
MAX_BROADCAST = 2_000_000


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, w: bytes) -> int:
        import xxhash
        if len(self) >= CACHE:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def _shingles(text: str | None, size: int, cache: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles (bytes.split and bytes.lower know ASCII
    white space and letters only)."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.array(list(map(cache.__getitem__, w)), np.uint64)
    k = min(size, len(h))
    x = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        x = (x ^ h[i:len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return np.unique(x)


def _samples(u: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set, in pieces of bounded size."""
    x, best = (u >> np.uint64(32)).astype(np.uint32), np.full(len(mul), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        best = np.minimum(best, (mul[:, None] * x[None, i:i + 2048] + add[:, None]).min(axis=1))
    return best


def _longs(x: np.ndarray) -> pa.Array:
    """A list column of 64-bit values from the rows of a matrix."""
    flat = np.ascontiguousarray(x).view(np.int64)
    return pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1],
                                    pa.array(flat.ravel(), pa.int64()))


def _sketch(u: np.ndarray, bins: int) -> np.ndarray:
    """Bit places of the samples of a sorted set: the smallest hash of each bin."""
    b = u >> np.uint64(64 - bins.bit_length() + 1)
    first = u[np.append(True, b[1:] != b[:-1])]
    return ((first * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - BITS.bit_length())).astype(np.int64)


def _bitmaps(sets: list[np.ndarray], bins: int, wanted: list[bool]) -> pa.Array:
    """A parity bitmap of 64-bit words for each wanted set, null for the others."""
    at = [_sketch(u, bins) if w else np.empty(0, np.int64) for u, w in zip(sets, wanted)]
    flat = np.concatenate([x + i * BITS for i, x in enumerate(at)])
    odd = (np.bincount(flat, minlength=len(sets) * BITS) & 1).astype(np.uint8)
    out = np.packbits(odd.reshape(len(sets), BITS), axis=1).view(np.int64)
    return pa.array([r if w else None for r, w in zip(out, wanted)], pa.list_(pa.int64()))


def _sketcher(shingle: int, percent: int, bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        k = bands * rows
        mul = rng.integers(0, 2**32, k, dtype=np.uint32) | np.uint32(1)
        add = rng.integers(0, 2**32, k, dtype=np.uint32)
        poly = rng.integers(0, 2**63, rows, dtype=np.uint64) | np.uint64(1)
        salt = rng.integers(0, 2**63, bands, dtype=np.uint64)
        cache = _Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [_shingles(t, shingle, cache) for t in part.column(1).to_pylist()]
                m = np.array([_samples(s, mul, add) for s in sets], np.uint32).astype(np.uint64)
                keys = (m.reshape(len(sets), bands, rows) * poly).sum(axis=2, dtype=np.uint64) + salt
                keys ^= keys >> np.uint64(31)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), _longs(keys),
                     _bitmaps(sets, FINE, [0 < len(s) <= SMALL for s in sets]),
                     _bitmaps(sets, COARSE, [100 * len(s) > percent * SMALL for s in sets])],
                    names=["key", "n", "digest", "bands", "fine", "coarse"])
        del cache
        give_back()
    return run


def _confirm(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, last, last_set = _Words(), None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                if last is None or a[i] != last:
                    last, last_set = a[i], _shingles(ta[i].as_py(), shingle, cache)
                other = _shingles(tb[i].as_py(), shingle, cache)
                both = len(np.intersect1d(last_set, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(last_set) + len(other) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        del cache
        give_back()
    return run


def screened(a: str, b: str, percent: int) -> Column:
    """Whether two rows (n, cls, sk) can be at the threshold. ``cls`` 0 is the fine sketch, that
    both small sets have; 1 the coarse one, for the other pairs."""
    t = percent / 100
    n = lambda x: F.col(f"{x}.n").cast("double")
    bins = F.when(F.col(f"{a}.cls") == 0, FINE).otherwise(COARSE).cast("double")
    xor = [F.bit_count(F.get(f"{a}.sk", F.lit(i)).bitwiseXOR(F.get(f"{b}.sk", F.lit(i)))) for i in range(BITS // 64)]
    differ = xor[0]
    for x in xor[1:]:
        differ = differ + x
    union = (n(a) + n(b)) / (1 + t)
    filled = lambda m: bins * (1 - F.exp(-m / bins))
    both = filled(union)
    mean = F.greatest(filled(n(a)) + filled(n(b)) - 2 * t * both, F.lit(0.0))
    x = 4 * mean / BITS
    spread = 4 * t * (1 - t) * both * F.greatest(1 - both / union, F.lit(0.0)) + BITS / 4 * (F.exp(x) - 1 - x)
    most = mean + MARGIN * F.sqrt(spread) + 1
    # the count of odd bits that so many differing samples leave
    bits = BITS / 2 * (1 - F.exp(-2 * most / BITS))
    small = (F.col(f"{a}.n") <= SMALL) & (F.col(f"{b}.n") <= SMALL)
    return (100 * F.least(n(a), n(b)) >= percent * F.greatest(n(a), n(b))) \
        & ((F.col(f"{a}.cls") == 0) | ~small) & (differ <= bits)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 80, bands: int = 48, rows: int = 6, seed: int = 11) -> DataFrame:
    """A row per row of ``docs``: key, n_shingles, component_id (smallest key of the group).

    Documents are linked when 100 * |intersection| >= ``percent`` * |union| of their sets of
    ``shingle``-word shingles.
    """
    rows_of, of_node = _groups(docs, key, text_col, shingle, percent, bands, rows, seed)
    return rows_of.join(of_node, "digest", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "key").alias("component_id"))


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _groups(docs: DataFrame, key: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80,
            bands: int = 48, rows: int = 6, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(key, n, digest) of each row, the digest null without words, and (digest, label, component_id)
    of each set: its group and the smallest key of the group, null if no row of it has a key."""
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    rows_of = kept(texts.mapInArrow(
        _sketcher(shingle, percent, bands, rows, seed),
        f"key {kind}, n long, digest binary, bands array<long>, fine array<long>, coarse array<long>"), "odd-rows")
    nodes = kept(rows_of.filter("digest is not null").groupBy("digest")
                 .agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("bands").alias("bands"),
                      F.first("fine").alias("fine"), F.first("coarse").alias("coarse"))
                 .withColumn("v", F.monotonically_increasing_id()), "odd-nodes")
    sketch = nodes.select("v", "n", F.posexplode(F.array("fine", "coarse")).alias("cls", "sk")).filter("sk is not null")
    member = nodes.select(F.posexplode("bands").alias("band", "k"), "v")
    shared = kept(member.groupBy("k").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "odd-keys")
    member = kept(member.join(shared, "k"), "odd-members")
    texts_of = kept(_node_texts(texts, nodes.join(member.select("v").distinct(), "v", "left_semi"), shingle),
                    "odd-texts")

    def confirmed(near: DataFrame) -> DataFrame:
        """The pairs (a, b) that the full sets link."""
        pair = near.join(texts_of.select(F.col("v").alias("b"), F.col("text").alias("tb")), "b") \
            .join(texts_of.select(F.col("v").alias("a"), F.col("text").alias("ta")), "a") \
            .select("a", "b", "ta", "tb")
        return kept(pair.mapInArrow(_confirm(shingle, percent), "a long, b long"), "odd-links")

    # each key's node with the most neighbours, against the others
    degree = member.groupBy("v").agg(F.sum("size").alias("degree"))
    centre = member.join(degree, "v").groupBy("k").agg(F.max_by("v", F.struct("degree", "v")).alias("c"))
    pairs = member.join(centre, "k").filter("v <> c").select(F.col("c").alias("a"), F.col("v").alias("b")).distinct()
    near = pairs.join(sketch.select(F.col("v").alias("a"), F.struct("n", "cls", "sk").alias("x")), "a") \
        .join(sketch.select(F.col("v").alias("b"), F.struct("n", "cls", "sk").alias("y")), "b") \
        .filter((F.col("x.cls") == F.col("y.cls")) & screened("x", "y", percent)).select("a", "b")
    links = confirmed(near)
    label = components(links)

    # keys with nodes of several components: those outside the largest against the others
    of = member.filter("size > 2").join(label, "v", "left") \
        .select("k", "band", "v", F.coalesce("label", "v").alias("label"))
    major = of.groupBy("k", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("k") \
        .agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.count(F.lit(1)).alias("parts")) \
        .filter("parts > 1").select("k", "major")
    of = kept(of.join(major, "k"), "odd-open")
    full = of.join(sketch.join(nodes.select("v", "bands"), "v"), "v")
    x = full.filter("label <> major").select("k", F.col("cls").alias("xc"), "band", F.col("v").alias("a"),
                                             F.col("label").alias("la"), F.struct("n", "cls", "sk", "bands").alias("x"))
    y = full.select("k", F.col("cls").alias("yc"), "major", F.col("v").alias("b"), F.col("label").alias("lb"),
                    F.struct("n", "cls", "sk", "bands").alias("y"))
    first = F.array_position(F.zip_with("x.bands", "y.bands", lambda p, q: p == q), True) == F.col("band") + 1
    rest = x.join(y, (x["k"] == y["k"]) & (F.col("xc") == F.col("yc")) & (F.col("la") != F.col("lb"))
                  & ((F.col("lb") == F.col("major")) | (F.col("la") < F.col("lb"))) & screened("x", "y", percent)
                  & first).select("a", "b")
    more = confirmed(rest)
    if not more.isEmpty():
        label = components(links.union(more))
    of_node = nodes.select("v", "digest", "key").join(label, "v", "left") \
        .select("digest", "key", F.coalesce("label", "v").alias("label"))
    smallest = of_node.groupBy("label").agg(F.min("key").alias("component_id"))
    return rows_of.select("key", "n", "digest"), of_node.join(smallest, "label").select("digest", "label", "component_id")


def _node_texts(texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(v, text): a text of each node. The ids go to the texts where they are few enough."""
    wanted = nodes.filter("key is not null").select("v", "key", "digest")
    if nodes.count() <= MAX_BROADCAST:
        wanted = F.broadcast(wanted)
    found = texts.join(wanted, "key").select("v", "text", "digest")
    lone = nodes.filter("key is null").select("v", "digest")
    if not lone.isEmpty():  # nodes that only rows without a key have
        found = found.union(texts.filter("key is null").mapInArrow(
            _with_digest(shingle), "text string, digest binary")
            .join(lone, "digest").select("v", "text", "digest"))
    # rows of one key may have different texts
    return found.mapInArrow(_of_digest(shingle), "v long, text string")


def _digest(u: np.ndarray) -> bytes:
    import hashlib
    return hashlib.blake2b(u.tobytes(), digest_size=16).digest()


def _with_digest(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for batch in batches:
            d = [_digest(_shingles(t.as_py(), shingle, cache)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(d, pa.binary())],
                                             names=["text", "digest"])
    return run


def _of_digest(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for batch in batches:
            same = [_digest(_shingles(t.as_py(), shingle, cache)) == d.as_py()
                    for t, d in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)],
                                             names=["v", "text"]).filter(pa.array(same, pa.bool_()))
        del cache
        give_back()
    return run


def _row_digest(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for batch in batches:
            sets = (_shingles(t.as_py(), shingle, cache) for t in batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary())],
                names=["row", "digest"])
        del cache
        give_back()
    return run


def keep_representatives(docs: DataFrame, key: str = "doc_id", text_col: str = "text", shingle: int = 5,
                         **options) -> DataFrame:
    """``docs`` with exactly one row of each group: that with the smallest key (any row of equal
    keys, or of rows without a key). Rows without words stay.

    A key that only one row has tells whether that row goes. The rows of the other keys, and those
    without a key, are written with a row id and decided one by one by their own texts.
    """
    rows_of, of_node = _groups(docs, key, text_col, shingle, **options)
    often = kept(rows_of.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
                 .filter("rows > 1").select("key"), "odd-often")
    found = rows_of.filter("key is not null").join(of_node, "digest")
    gone = kept(found.filter(~F.col("key").eqNullSafe(F.col("component_id"))).select("key").union(often).distinct(),
                "odd-gone")

    def ids(x: DataFrame) -> DataFrame:
        x = x.withColumnRenamed("key", key)
        return F.broadcast(x) if x.count() <= MAX_BROADCAST else x

    out = docs.filter(F.col(key).isNotNull()).join(ids(gone), key, "left_anti").select(*docs.columns)
    lone = rows_of.filter("key is null")
    if often.isEmpty() and lone.isEmpty():
        return out
    row = free_name(docs, "row__")
    unclear = docs.filter(F.col(key).isNotNull()).join(ids(often), key, "left_semi").select(*docs.columns) \
        .union(docs.filter(F.col(key).isNull()))
    unclear = kept(unclear.withColumn(row, F.monotonically_increasing_id()), "odd-unclear")
    digest = kept(unclear.select(row, text_col).mapInArrow(_row_digest(shingle), "row long, digest binary"),
                  "odd-row-digests")
    of_row = digest.join(of_node, "digest").join(
        unclear.select(F.col(row).alias("row"), F.col(key).alias("key")), "row")
    first = of_row.filter(F.col("key").eqNullSafe(F.col("component_id"))).groupBy("label").agg(F.min("row").alias("row"))
    stay = digest.filter("digest is null").select("row").union(first.select("row")).withColumnRenamed("row", row)
    return out.union(unclear.join(stay, row, "left_semi").select(*docs.columns))
