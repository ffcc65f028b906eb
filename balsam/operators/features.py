"""Features and analyses declared in the reference's README (J1-J20).

Hot keys: every per-key computation here is either an aggregation with map-side
combine (dedupe, document frequency, period counts) or a prefix sum over a
range-partitioned total order (running centroids, repeat rates), so one key
holding a third of the rows is spread over many tasks rather than one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from balsam.functions import text as T
from balsam.functions.random import uniform
from balsam.operators.chunks import BUCKET_BYTES, PACKET, Grams, narrow, pack, tally, token_chunks, unpack
from balsam.operators.metrics import attach
from balsam.operators.order import running_totals
from balsam.session import cut_lineage


# ------------------------------------------------------------------ J1 dedupe

def normalised_text(c: Column) -> Column:
    return F.lower(T.normalize_ws(c))


def dedupe_exact(df: DataFrame, text_col: str, key: str) -> DataFrame:
    """Keep the smallest key per normalised text; the shuffle carries a 256-bit digest of it."""
    return df.join(_first_keys(df, text_col, key), key, "left_semi")


def _first_keys(df: DataFrame, text_col: str, key: str) -> DataFrame:
    return df.groupBy(F.sha2(normalised_text(F.col(text_col)), 256).alias("__t")).agg(F.min(key).alias(key)).select(key)


def minhash_signature(df: DataFrame, text_col: str, key: str, num_hashes: int = 16,
                      shingle: int = 3) -> DataFrame:
    """(key, shingles array<long>, sig array<long>) over word shingles of the whole text."""
    df = df.select(key, T.word_tokens(F.col(text_col)).alias("__toks"))
    toks = F.col("__toks")
    grams = ngrams_of(toks, shingle)
    # texts shorter than one shingle contribute their whole token run
    grams = F.when(F.size(grams) > 0, grams).otherwise(F.array(F.array_join(toks, " ")))
    sh = F.transform(grams, lambda g: F.xxhash64(g))
    base = df.select(key, F.array_distinct(sh).alias("shingles"))
    sig = F.array(*[F.array_min(F.transform("shingles", _seeded_hash(j))) for j in range(num_hashes)])
    return base.withColumn("sig", sig)


def bands_for(threshold: float, band_rows: int, miss: float = 1e-6) -> int:
    """How many bands a pair at ``threshold`` needs to share none with a probability below ``miss``."""
    share = min(threshold ** band_rows, 1 - 1e-9)
    return max(1, math.ceil(math.log(miss) / math.log(1 - share)))


#: Documents of a shingle from which on its exact frequency decides its place in the order.
COMMON = 8
#: Common shingles that are sent to the tasks (16 bytes each); see :func:`rare_first` for more.
MAX_COMMON = 4_000_000
#: Keys that are broadcast to the rows that have them; more are joined.
MAX_KEYS = 1_000_000
#: Last bits of a shingle's hash that its frequency and its candidate groups do without. Shingles that agree in
#: the other 40 count as one, which changes the order for all documents alike and adds candidates, but loses none.
LAST_BITS = 24


def _shingle_sets(df: DataFrame, text_col: str, key: str, shingle: int) -> DataFrame:
    """(key, shingles): the different word shingles as hashes; shorter texts are one shingle."""
    toks = df.select(key, F.explode(F.array(T.word_tokens(F.col(text_col)))).alias("__toks"))
    grams = F.when(F.size("__toks") >= shingle, ngrams_of(F.col("__toks"), shingle)) \
        .otherwise(F.array(F.array_join("__toks", " ")))
    return toks.select(key, F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g))).alias("shingles"))


def shingle_counts(sets: DataFrame, least: int) -> DataFrame:
    """(h, df): the shingles, without ``LAST_BITS``, of more than ``least`` documents. Each batch sends a range of
    hashes its different ones as packed differences, about three bytes each."""
    buckets = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = batch.column(0).flatten().to_numpy(zero_copy_only=False) >> LAST_BITS
            h, docs = np.unique(short, return_counts=True)
            begins = np.searchsorted(((h + (1 << 63 - LAST_BITS)) * buckets) >> 64 - LAST_BITS, np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(begins))
            data = [pack(first=pa.array(h[a:a + 1]), docs=narrow(docs[a:b]),
                         steps=pa.array(np.diff(h[a:b]).view(np.uint8).reshape(-1, 8).T.ravel()))  # bytes of one place together
                    for a, b in zip(begins[full], begins[full + 1])]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])

    def add_up(rows: pa.Table) -> pa.Table:
        h, docs = [], []
        for x in map(unpack, rows["data"].to_pylist()):
            steps = x["steps"].to_numpy(zero_copy_only=False).reshape(8, -1).T.copy().view(np.int64).ravel()
            h.append(np.cumsum(np.append(x["first"].to_numpy(), steps)))
            docs.append(x["docs"].to_numpy(zero_copy_only=False))
        different, place = np.unique(np.concatenate(h), return_inverse=True)
        df = np.bincount(place, weights=np.concatenate(docs)).astype(np.int64)
        return pa.table({"h": different[df > least], "df": df[df > least]})

    return sets.select("shingles").mapInArrow(deal, "bucket int, data binary") \
        .groupBy("bucket").applyInArrow(add_up, "h long, df long")


def _arranged(sets: DataFrame, key: str, common: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``sets`` with ``sketch``, bits as longs: whether an odd number of the set's shingles has that
    remainder. A set of n shingles has the least power of two bits that is not below 2 n and 64. With
    ``common`` (shingles in order, without ``LAST_BITS``, and their frequencies) also put into order."""
    shared = sets.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                h = part.column(1).flatten().to_numpy(zero_copy_only=False)
                size = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(size)), size)
                if shared.value is not None and len(shared.value[0]):
                    known, times = shared.value
                    short = h >> LAST_BITS
                    place = np.minimum(np.searchsorted(known, short), len(known) - 1)
                    h = h[np.lexsort((h, np.where(known[place] == short, times[place], 0), row))]
                elif shared.value is not None:
                    h = h[np.lexsort((h, row))]
                bits = 1 << np.ceil(np.log2(np.maximum(2 * size.astype(np.int64), 64))).astype(np.int64)
                end = np.cumsum(bits)
                odd = np.bincount((end - bits)[row] + (h & (bits - 1)[row]), minlength=int(bits.sum())) & 1
                words = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
                lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(size)).astype(np.int32), pa.array(h))
                sketch = pa.ListArray.from_arrays(np.append(0, end // 64).astype(np.int32), pa.array(words))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, sketch], names=["k", "shingles", "sketch"])

    kind = sets.schema[key].dataType.simpleString()
    return sets.select(key, "shingles").mapInArrow(run, f"k {kind}, shingles array<bigint>, sketch array<bigint>") \
        .withColumnRenamed("k", key)


def rare_first(sets: DataFrame, key: str) -> DataFrame:
    """``sets`` with the shingles in one order for all documents: those in at most ``COMMON`` documents
    by hash, then the common ones by frequency; and with their sketches (:func:`_arranged`). Up to
    ``MAX_COMMON`` common ones go to the tasks. If there are more, those count as common that are in twice, four
    times, ... as many documents, up to the square root of the rows, so that the others share no more pairs a shingle
    than there are rows. If that is not enough, the common ones are looked up by a join and regrouped, as they are
    where a key repeats, whose rows share their common ones."""
    common = cut_lineage(shingle_counts(sets, COMMON))
    rows, most = sets.groupBy(key).count().agg(F.sum("count"), F.max("count")).first()
    cuts = [COMMON << i for i in range(40) if i == 0 or (COMMON << i) ** 2 <= (rows or 0)]
    sizes = common.agg(*[F.count_if(F.col("df") > c) for c in cuts]).first()
    cut = next((c for c, n in zip(cuts, sizes) if n <= MAX_COMMON), None)
    if cut is not None and (most or 0) < 2:
        got = common.where(F.col("df") > cut).orderBy("h").toPandas()
        return _arranged(sets, key, (got["h"].to_numpy(np.int64), got["df"].to_numpy(np.int64)))
    cells = sets.select(key, F.explode("shingles").alias("__h"))
    last = cells.join(common, F.shiftright("__h", LAST_BITS) == F.col("h")).groupBy(key).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("df", "__h"))), lambda s: s["__h"]).alias("__last"))
    none = F.array().cast("array<bigint>")
    return _arranged(sets.join(last, key, "left").withColumn("__last", F.coalesce("__last", none))
                     .select(key, F.concat(F.array_sort(F.array_except("shingles", "__last")), "__last").alias("shingles")), key)


def _among(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` with a key of the (materialised) ``keys``."""
    return df.join(F.broadcast(keys) if keys.count() <= MAX_KEYS else keys, key, "left_semi")


def dedupe_near(df: DataFrame, text_col: str, key: str, threshold: float = 0.7,
                num_hashes: int | None = None, band_rows: int = 3, shingle: int = 3, rounds: int = 2) -> DataFrame:
    """Near-copy removal by a prefix filter: a row goes when a row of a smaller key is similar
    enough (exact Jaccard of shingle sets). Exact copies go first.

    Two sets of n and m shingles that reach the threshold t share a shingle among the first
    n - ceil(t n) + 1 and m - ceil(t m) + 1 in any common order, so no pair is missed; with rare shingles
    first, few others share one. At the first shared shingle the lengths, and what is left of both sets
    behind it, must still allow the threshold. Rows that share such a shingle form a candidate group. In
    each of ``rounds`` rounds the open rows of a group, those not dropped yet, are compared with its next
    centre, the smallest open key; large families of copies go here, at one pair per row and shingle. What
    is still open is then compared with all smaller keys of its groups, dropped ones too. The bits in which
    two sketches differ are at most as many as the shingles that only one of the sets has, so pairs with too
    many of them are out; the sets of the others alone are made again from their texts and joined.
    ``num_hashes`` and ``band_rows`` are without effect; earlier versions drew candidates by MinHash.
    """
    first = cut_lineage(_first_keys(df, text_col, key))
    copies = cut_lineage(df.select(key).join(first, key, "left_anti").distinct())
    # the few keys that go are broadcast, so that the texts stay where they are
    base = df.where(F.col(key).isNotNull()).join(F.broadcast(copies), key, "left_anti") if copies.count() <= MAX_KEYS \
        else df.join(first, key, "left_semi")
    least = lambda n: F.ceil(F.lit(threshold) * n - 1e-9)
    n = F.size("shingles")
    first_ones = F.slice("shingles", F.lit(1), (n - least(n) + 1).cast("int"))
    # materialised (reliable checkpoints), as they feed all branches of the plan; sets are made from the texts where they are needed
    sig = cut_lineage(rare_first(_shingle_sets(base, text_col, key, shingle), key)
                      .select(key, n.alias("__n"), "sketch", F.transform(first_ones, lambda h: F.shiftright(h, LAST_BITS)).alias("__first")))
    prefix = sig.select(key, "__n", F.posexplode("__first").alias("__i", "h"))
    shared = F.count(F.lit(1)).over(Window.partitionBy("h"))  # one shuffle for the size of a group and its members
    members = cut_lineage(prefix.withColumn("__size", shared).where("__size > 1").drop("__size"))
    sketch = sig.select(key, "sketch", F.col("__n").alias("__sn"))
    r_sketch = sketch.select(F.col(key).alias("__rep"), F.col("sketch").alias("__rsketch"), F.col("__sn").alias("__sm"))
    common = F.size(F.array_intersect("shingles", "__rs"))
    jac = common / (F.size("shingles") + F.size("__rs") - common)
    # shingles that both can still share from this one on, against those that the threshold needs
    reach = F.least(F.col("__n") - F.col("__i"), F.col("__m") - F.col("__j"))
    needed = lambda n, m: F.ceil(F.lit(threshold / (1 + threshold)) * (F.col(n) + F.col(m)) - 1e-9)
    need = needed("__n", "__m")
    differ = lambda a, b: F.aggregate(F.zip_with(a, b, lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda s, c: s + c)
    a_words, b_words = F.size("sketch"), F.size("__rsketch")
    # the bits of half a sketch's size are the exclusive or of its halves
    half = lambda c, n: F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, n + 1, n), lambda v, w: v.bitwiseXOR(w))
    apart = F.when(a_words == b_words, differ(F.col("sketch"), F.col("__rsketch"))) \
        .when(a_words == 2 * b_words, differ(half("sketch", b_words), F.col("__rsketch"))) \
        .when(b_words == 2 * a_words, differ(F.col("sketch"), half("__rsketch", a_words))).otherwise(0)

    def similar(cand: DataFrame) -> DataFrame:
        """Keys of the pairs (key, __rep) that are similar enough."""
        pairs = cand.where((F.least("__n", "__m") >= (threshold - 1e-9) * F.greatest("__n", "__m")) & (reach >= need)) \
            .select(key, "__rep").distinct()
        pairs = cut_lineage(pairs.join(sketch, key).join(r_sketch, "__rep")
                            .where(apart <= F.col("__sn") + F.col("__sm") - 2 * needed("__sn", "__sm"))
                            .select(key, "__rep").distinct())
        keys = cut_lineage(pairs.select(key).union(pairs.select("__rep")).distinct())
        s = _shingle_sets(_among(base, keys, key), text_col, key, shingle)
        r = s.select(F.col(key).alias("__rep"), F.col("shingles").alias("__rs"))
        return pairs.join(s, key).join(r, "__rep").where(jac >= threshold).select(key).distinct()

    still, dup = members, None
    for _ in range(rounds):
        centre = still.groupBy("h").agg(F.min(F.struct(F.col(key).alias("__rep"), F.col("__n").alias("__m"), F.col("__i").alias("__j"))).alias("c")) \
            .select("h", "c.*")
        # the centre has been compared with all that follow; it stays a candidate of the last step
        behind = cut_lineage(still.join(centre, "h").where(F.col(key) > F.col("__rep")))
        found = cut_lineage(similar(behind))
        dup = found if dup is None else dup.union(found)
        still = behind.select(*members.columns).join(found, key, "left_anti")
    left = members.select(key).distinct() if dup is None else members.select(key).distinct().join(dup, key, "left_anti")
    x = members.join(left, key)
    y = members.select("h", F.col(key).alias("__rep"), F.col("__n").alias("__m"), F.col("__i").alias("__j"))
    found = similar(x.join(y, "h").where(F.col("__rep") < F.col(key)))
    dup = found if dup is None else dup.union(found)
    return base.join(dup.distinct(), key, "left_anti")


# ------------------------------------------------------------------ J2 tf-idf

def ngrams_of(toks: Column, n: int) -> Column:
    """Word n-grams joined by a blank. Built by zipping shifted copies of the token
    array, so the lambda touches only its own element (a lambda that indexes the
    outer array would re-evaluate the tokenizer per position)."""
    if n == 1:
        return toks
    shifted = [toks] + [F.slice(toks, k + 1, 1 << 30) for k in range(1, n)]
    names = [f"a{k}" for k in range(n)]
    z = F.arrays_zip(*[s.alias(nm) for s, nm in zip(shifted, names)])
    full = F.filter(z, lambda e: e[names[-1]].isNotNull())
    return F.transform(full, lambda e: F.concat_ws(" ", *[e[nm] for nm in names]))


def _seeded_hash(j: int):
    return lambda s: F.xxhash64(F.lit(j), s)


def tfidf(df: DataFrame, text_col: str, key: str, ngrams: tuple[int, ...] = (1, 2), frequent: int = 500_000) -> DataFrame:
    """(key, term, tf, idf, tfidf); idf = ln((N + 1) / (df + 1)) as pyspark.ml's IDF. A row is a
    document, whatever its key.

    Documents are kept in chunks (:mod:`balsam.operators.chunks`). A chunk's different terms are shuffled, its
    rows are not: they are counted again where the document frequencies come back to the chunk.
    ``frequent`` is without effect; earlier versions broadcast that many terms.
    """
    lengths = dict(Counter(n for n in ngrams if n > 0))
    kind = df.schema[key].dataType.simpleString()
    # the words in chunks, compressed, written once: the frequencies and the result both read them
    chunks = cut_lineage(token_chunks(df, text_col, key))
    all_docs, chars = chunks.agg(F.sum("docs"), F.sum("chars")).first()
    buckets = max(1, -(-(chars or 0) * sum(lengths) // BUCKET_BYTES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from Grams(data.as_py(), lengths, buckets).packets(chunk)

    def rows(group: pa.Table) -> pa.Table:
        own = group.filter(pc.is_valid(group["words"]))
        back = group.filter(pc.is_valid(group["data"]))
        g = Grams(own["words"][0].as_py(), lengths, buckets)
        times = g.everywhere(back["bucket"].to_pylist(), back["data"].to_pylist())
        keys = own["keys"].combine_chunks().flatten()
        return pa.table({"k": keys.take(pa.array(g.doc)), "term": g.terms.take(pa.array(g.term)),
                         "tf": pa.array(g.tf), "df": pa.array(times[g.term])})

    sums = tally(chunks.select("chunk", "data").mapInArrow(deal, PACKET))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    both = chunks.select("chunk", "keys", F.col("data").alias("words"), none("bucket", "int"), none("data", "binary")) \
        .unionByName(sums.select("chunk", none("keys", f"array<{kind}>"), none("words", "binary"), "bucket", "data"))
    found = both.groupBy("chunk").applyInArrow(rows, f"k {kind}, term string, tf long, df long").withColumnRenamed("k", key)
    idf = F.log((F.lit(all_docs or 0).cast("long") + 1) / (F.col("df") + 1))
    return found.select(key, "term", "tf", idf.alias("idf")).withColumn("tfidf", F.col("tf") * F.col("idf"))


# ------------------------------------------------------------------ J3, J4, J6, J8

def phrase_flags(df: DataFrame, text_col: str, patterns: dict[str, str]) -> DataFrame:
    return df.select("*", *[F.coalesce(F.col(text_col).rlike(p), F.lit(False)).cast("int").alias(n)
                            for n, p in patterns.items()])


def season(month: Column) -> Column:
    return (F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring")
            .when(month.isin(6, 7, 8), "summer").otherwise("autumn"))


def calendar_features(df: DataFrame, ts_col: str) -> DataFrame:
    m = F.month(ts_col)
    return df.select("*", m.alias("month"), season(m).alias("season"),
                     F.dayofweek(ts_col).alias("day_of_week"),
                     F.dayofweek(ts_col).isin(1, 7).cast("int").alias("is_weekend"))


def grid_cell(df: DataFrame, y_col: str, x_col: str, size: float) -> DataFrame:
    """Fixed square grid (an H3 stand-in): integer row/column and a cell id."""
    r = F.floor(F.col(y_col) / size).cast("long")
    c = F.floor(F.col(x_col) / size).cast("long")
    return df.select("*", r.alias("cell_row"), c.alias("cell_col"),
                     F.concat_ws(":", r.cast("string"), c.cast("string")).alias("cell_id"))


def value_buckets(df: DataFrame, col: str, splits: list[float], out: str = "bucket") -> DataFrame:
    """Bucketizer semantics: i for splits[i] <= v < splits[i+1]; the last upper bound
    is inclusive; outside or null -> null."""
    e = None
    for i in range(len(splits) - 1):
        lo, hi = splits[i], splits[i + 1]
        last = i == len(splits) - 2
        cond = (F.col(col) >= lo) & ((F.col(col) <= hi) if last else (F.col(col) < hi))
        e = F.when(cond, F.lit(i)) if e is None else e.when(cond, F.lit(i))
    return df.withColumn(out, e.cast("int"))


# ------------------------------------------------------------------ J5 period join

def period_join(df: DataFrame, ts_col: str, periods: DataFrame) -> DataFrame:
    """Attach the periods (name, start, end) whose [start, end) holds ``ts_col``.

    Range join made an equi-join: a period belongs to the level whose bins (2^level days) are the
    smallest that are not shorter than it, and lies in one or two bins of that level, whatever
    its length. A row looks into its one bin of each level that occurs (a few dozen at most), and
    the exact bounds are applied to what it finds."""
    day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")
    bin_of = lambda d, level: F.floor(d / F.pow(F.lit(2.0), level)).cast("long")
    p = periods.withColumn("__level", F.ceil(F.log2(F.greatest(day("end") - day("start") + 1, F.lit(1)))).cast("int"))
    levels = sorted(r[0] for r in p.select("__level").distinct().collect() if r[0] is not None)
    if not levels:
        return df.join(p.drop("__level").limit(0), F.lit(True))
    p = p.select("*", F.explode(F.array_distinct(F.array(bin_of(day("start"), F.col("__level")),
                                                         bin_of(day("end"), F.col("__level"))))).alias("__bin"))
    rows = df.select("*", F.explode(F.array(*[F.lit(x) for x in levels])).alias("__level"))
    j = rows.withColumn("__bin", bin_of(day(ts_col), F.col("__level"))).join(p, ["__level", "__bin"])
    return j.where((F.col(ts_col) >= F.col("start")) & (F.col(ts_col) < F.col("end"))).drop("__level", "__bin")


# ------------------------------------------------------------------ J7 prior centroid

def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    r = math.pi / 180
    a = (F.sin((lat2 - lat1) * r / 2) ** 2
         + F.cos(lat1 * r) * F.cos(lat2 * r) * F.sin((lon2 - lon1) * r / 2) ** 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(a))


def prior_centroid_distance(df: DataFrame, class_col: str, order_cols: list, key: str,
                            y_col: str, x_col: str, metric: str = "euclidean",
                            out: str = "dist_prior_centroid") -> DataFrame:
    """Distance from each row to the mean point of the earlier rows of its class.

    Prefix sums in the total order (class, order..., key) are range-partitioned, so a dominant
    class still spreads over all tasks, and begin anew at each class."""
    base = df.withColumn("__one", F.lit(1).cast("long"))
    cum = running_totals(base, [F.col(class_col), *order_cols, F.col(key)], [y_col, x_col, "__one"],
                         ["__cy", "__cx", "__cn"], inclusive=False, group_col=class_col)
    n = F.col("__cn")
    my, mx = F.try_divide("__cy", n), F.try_divide("__cx", n)
    d = (haversine_km(F.col(y_col), F.col(x_col), my, mx) if metric == "haversine"
         else F.sqrt((F.col(y_col) - my) ** 2 + (F.col(x_col) - mx) ** 2))
    return cum.withColumn(out, F.when(n > 0, d)).withColumn("n_prior", n).drop("__one", "__cy", "__cx", "__cn")


# ------------------------------------------------------------------ J9 repeat rate

def repeat_count(df: DataFrame, group_col: str, ts_col: str, key: str, seconds: int,
                 out: str = "n_prior") -> DataFrame:
    """Number of earlier rows of the same group with ts - seconds <= t < ts.

    Each row adds two probes, at ts and at ts - seconds, which come before the rows of their
    time; one prefix count over the total order (group, time, probe first, key) gives the rows
    before each, and their difference is the window's count. Rows of one time do not count for
    each other. No per-group window, no pairs."""
    t = F.col(ts_col)
    common = [F.col(key).alias("__k"), F.col(group_col).alias("__g")]
    one = lambda n: F.lit(n).cast("long").alias("__one")
    real = df.select(*common, t.alias("__t"), F.lit(2).alias("__kind"), one(1))
    at = df.select(*common, t.alias("__t"), F.lit(1).alias("__kind"), one(0))
    before = df.select(*common, (t - F.expr(f"INTERVAL {int(seconds)} SECONDS")).alias("__t"),
                       F.lit(0).alias("__kind"), one(0))
    cum = running_totals(real.unionByName(at).unionByName(before),
                         [F.col("__g"), F.col("__t"), F.col("__kind"), F.col("__k")],
                         ["__one"], ["__c"], inclusive=False)
    sign = F.when(F.col("__kind") == 1, F.col("__c")).otherwise(-F.col("__c"))
    cnt = cum.where(F.col("__kind") < 2).groupBy("__k").agg(F.sum(sign).alias(out)) \
        .withColumnRenamed("__k", key)
    return df.join(cnt, key)


# ------------------------------------------------------------------ J14-J16

def late_fusion(a: DataFrame, b: DataFrame, key: str, pa: str, pb: str, out: str = "p_fused") -> DataFrame:
    """Average of two scorers' positive probabilities, joined by key."""
    return (a.select(key, F.col(pa).alias("__a")).join(b.select(key, F.col(pb).alias("__b")), key)
            .select(key, ((F.col("__a") + F.col("__b")) / 2).alias(out)))


def brier(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"))


def ece(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width probability bins."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    per = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("acc"),
                                         F.avg(p).alias("conf"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


# Fixed values rule: Poisson(1) cumulative probabilities, computed, not listed.
POISSON1_CDF = [sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) for i in range(20)]


def poisson1(u: Column) -> Column:
    """Inverse-CDF draw of Poisson(1) from a uniform: the number of cumulative probabilities that
    ``u`` has passed."""
    return F.size(F.filter(F.array(*[F.lit(p) for p in POISSON1_CDF]), lambda p: p <= u))


def bootstrap_ci(df: DataFrame, key: str, value: str, replicates: int = 50, seed: str = "42",
                 alpha: float = 0.05) -> DataFrame:
    """Poisson-bootstrap of a weighted mean: per replicate r, weight u(seed, key:r) ->
    Poisson(1); mean over replicates and the (alpha/2, 1-alpha/2) percentiles."""
    rows = df.select(F.col(key).cast("string").alias("__k"), F.col(value).cast("double").alias("__v"))
    # all replicates in one pass: rows are aggregated as they are, not repeated
    draw = lambda r: poisson1(uniform(seed, F.concat(F.col("__k"), F.lit(":"), r.cast("string"))))
    weights = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), draw)
    ws = rows.select("__v", F.explode(F.array(weights)).alias("w"))  # a generated column is evaluated once
    w = lambda r: F.get("w", F.lit(r))
    sums = ws.agg(*[(F.sum(w(r) * F.col("__v")) / F.sum(w(r))).alias(f"s{r}") for r in range(replicates)])
    per = sums.select(F.explode(F.array(*[F.col(f"s{r}") for r in range(replicates)])).alias("stat"))
    return per.agg(F.avg("stat").alias("mean"), F.percentile("stat", alpha / 2).alias("lo"),
                   F.percentile("stat", 1 - alpha / 2).alias("hi"), F.count(F.lit(1)).alias("replicates"))


# ------------------------------------------------------------------ J20

def schema_audit(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: type, null count, distinct count, min and max as text. Nulls, bounds and, with
    ``approx``, HyperLogLog++ distinct counts take one pass; exact distinct counts come from one
    aggregation of (column, value)."""
    fields = df.schema.fields
    aggs = []
    for f in fields:
        c = F.col(f.name)
        aggs += [F.sum(c.isNull().cast("long")).alias(f"{f.name}__nulls"),
                 F.min(c).cast("string").alias(f"{f.name}__min"), F.max(c).cast("string").alias(f"{f.name}__max")]
        if approx:
            aggs.append(F.approx_count_distinct(c).alias(f"{f.name}__distinct"))
    rows = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                     F.col(f"{f.name}__nulls").cast("long").alias("nulls"),
                     *([F.col(f"{f.name}__distinct").cast("long").alias("distinct")] if approx else []),
                     F.col(f"{f.name}__min").alias("min"), F.col(f"{f.name}__max").alias("max"))
            for f in fields]
    out = df.agg(*aggs).select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    if approx:
        return out
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.col(f.name).cast("string").alias("value")) for f in fields])).alias("s"))
    distinct = cells.select("s.*").where("value is not null").groupBy("column", F.xxhash64("value").alias("h"),
                                                                      F.md5("value").alias("m")).count() \
        .groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    return out.join(distinct, "column", "left").select(
        "column", "type", "nulls", F.coalesce("distinct", F.lit(0)).cast("long").alias("distinct"), "min", "max")


# ------------------------------------------------------------------ J18 permutation importance

def permutation_importance(model, test: DataFrame, dims: int, seed: str = "42",
                           id_col: str = "id", target: str = "target") -> DataFrame:
    """Macro-F1 drop when one coordinate of ``x`` is permuted across rows.

    One permutation for all coordinates: rows ranked by u(seed, id) take the vector
    of the next row in that order (cyclic), so every coordinate is scrambled by the
    same derangement. All coordinates are scored in ONE pass (rows x coordinates),
    never one job per feature."""
    from balsam.operators.metrics import macro_metrics
    from balsam.operators.order import positions

    ranked = positions(test.withColumn("__u", uniform(seed, F.col(id_col))),
                       [F.col("__u"), F.col(id_col)], "__pos").drop("__u")
    n = test.count()
    donor = ranked.select(((F.col("__pos") - 1 + n) % n).alias("__pos"), F.col("x").alias("__dx"))
    paired = ranked.join(donor, "__pos")
    perm = paired.select(id_col, target, "x", "__dx",
                         F.explode(F.sequence(F.lit(-1), F.lit(dims - 1))).alias("dim"))
    swapped = F.transform(F.col("x"), lambda v, i: F.when(i == F.col("dim"), F.col("__dx")[i]).otherwise(v))
    scored = model.transform(perm.withColumn("x", swapped).drop("__dx"))
    m = macro_metrics(scored, target, "prediction", ["dim"])
    base = m.where(F.col("dim") == -1).select(F.col("f1_macro").alias("__base"))
    return (attach(m.where(F.col("dim") >= 0), base)
            .select("dim", "f1_macro", (F.col("__base") - F.col("f1_macro")).alias("importance")))
