"""Exact duplicates through a cuckoo-filter index of live digests.

A text's digest is the SHA-256 of its normalised form (A-Z lower-cased, null as empty). The index is
cut into shards by the digest's leading bits. A shard holds

* a cuckoo filter: buckets of four 16-bit fingerprints of 64-bit keys, two buckets a key, so that
  keys can be inserted and deleted; when an insertion finds no place after ``KICKS`` moves, the
  filter gets twice the buckets and is filled again from the keys that the shard stores;
* buckets of content by 64-bit key: digest, length, number of live rows and the row that stays. A
  hit of the filter counts only when a digest and length in the key's bucket are the same; a false
  hit becomes an entry of its own.

:func:`find_duplicates` sends the digests of all rows through such indexes twice: each map task runs
one over its own rows, so that a text copied n times leaves the task as one entry, and each shard
runs one over the entries of all tasks. Texts are never shuffled. Entries of more than a
``HOT_SHARE``-th of the rows, of which there can be no more than that number, are broadcast to the
rows; the others are joined by digest. The number of shards follows the number of rows.

:func:`build`, :func:`insert`, :func:`delete` and :func:`lookup` keep an index as Parquet tables in a
folder; every change writes a new folder, so that a lost executor's task can be repeated.

Cases: null and empty texts are equal; of equal texts the row with the largest key stays, a null key
is smaller than any other, and of rows with the same key exactly one stays; an empty table gives no
rows; further columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from balsam.llm.common import ascii_lower, free_name, give_back
from balsam.session import scratch_path

SLOTS = 4
KICKS = 200
#: Rows that a shard is meant to hold; the number of shards is the number of rows by this.
SHARD_ROWS = 500_000
#: At most so many groups can hold more than a 1/HOT_SHARE of all rows each.
HOT_SHARE = 10_000
#: Copies of a shard's filter and entries that a lookup spreads its rows over.
SALTS = 8
#: Entries that a map task holds before it gives them out.
LIVE = 200_000
#: Rows of one Python batch of the index.
BATCH = 20_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    """Set of 64-bit keys as fingerprints. ``insert`` takes keys that are not live, ``delete`` keys
    that are; ``contains`` has false hits (about one in 8,000 keys) but never misses a live key."""

    def __init__(self, capacity: int = 1024, slots: np.ndarray | None = None):
        size = 1 << max(4, int(np.ceil(np.log2(max(capacity, 1) / SLOTS / 0.85))))
        self.slots = np.zeros((size, SLOTS), np.uint16) if slots is None else slots
        self.rng = np.random.default_rng(1)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.slots) - 1)
        fp = (keys >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)
        first = (keys * _MIX >> np.uint64(20)) & mask
        return fp.astype(np.uint16), first.astype(np.int64), self._other(first.astype(np.int64), fp)

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        jump = (fp.astype(np.uint64) * _MIX >> np.uint64(24)) & np.uint64(len(self.slots) - 1)
        return bucket ^ jump.astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, a, b = self._places(keys)
        return (self.slots[a] == fp[:, None]).any(1) | (self.slots[b] == fp[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Put distinct keys in; the keys for which there was no place are returned."""
        fp, a, b = self._places(keys)
        left = np.arange(len(keys))
        for at in (a, b):
            left = left[~self._fill(at[left], fp[left])]
        for n, i in enumerate(left):
            if not self._kick(int(b[i]), fp[i]):
                return keys[left[n:]]
        return keys[:0]

    def _fill(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """Put fingerprints into the free slots of their buckets; tells which found one."""
        done = np.zeros(len(bucket), bool)
        order = np.argsort(bucket, kind="stable")
        run = bucket[order]
        rank = np.arange(len(run)) - np.searchsorted(run, run)
        free = self.slots[run] == 0
        nth = np.cumsum(free, axis=1) - 1 == rank[:, None]
        slot = np.argmax(free & nth, axis=1)
        fits = (free & nth).any(1)
        self.slots[run[fits], slot[fits]] = fp[order[fits]]
        done[order[fits]] = True
        return done

    def _kick(self, bucket: int, fp: np.uint16) -> bool:
        moves = []
        for _ in range(KICKS):
            row = self.slots[bucket]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = fp
                return True
            j = int(self.rng.integers(SLOTS))
            moves.append((bucket, j, row[j]))
            fp, row[j] = row[j], fp
            bucket = int(self._other(np.array([bucket]), np.array([fp]))[0])
        for bucket, j, old in reversed(moves):  # as it was, so that no live key is lost
            self.slots[bucket, j] = old
        return False

    def delete(self, keys: np.ndarray) -> None:
        fp, a, b = self._places(keys)
        for f, *places in zip(fp, a, b):
            for at in places:
                j = np.flatnonzero(self.slots[at] == f)
                if len(j):
                    self.slots[at, j[0]] = 0
                    break
            else:
                raise KeyError("a key to delete is not live")


class Shard:
    """A filter and the content buckets behind it. An entry is [digest, length, rows, best, row]:
    ``best`` and ``row`` are key and row number of the row that stays."""

    def __init__(self, slots: bytes | None = None):
        self.buckets: dict[int, list[list]] = {}
        self.filter = CuckooFilter(slots=np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy() if slots else None)

    def _live(self) -> np.ndarray:
        return np.fromiter((k for k, b in self.buckets.items() for _ in b), np.uint64)

    def _enter(self, keys: np.ndarray) -> None:
        # entries whose digests share a 64-bit key are fingerprints each; more than fit in two
        # buckets cannot be, short of 2^-64 collisions in number
        left = self.filter.insert(keys)
        while len(left):
            live = self._live()
            self.filter = CuckooFilter(2 * SLOTS * len(self.filter.slots))
            left = self.filter.insert(live)

    def restore(self, entry: list) -> None:
        """An entry whose fingerprint the filter already has."""
        self.buckets.setdefault(_key(entry[0]), []).append(entry)

    def add(self, rows: Iterator[list]) -> None:
        """Rows or entries of other shards: [digest, length, rows, best, row]."""
        fresh: dict[tuple, list] = {}  # equal rows of this call are merged first
        for r in rows:
            have = fresh.setdefault((r[0], r[1]), r)
            if have is not r:
                _merge(have, r)
        if not fresh:
            return
        keys = np.fromiter((_key(d) for d, _ in fresh), np.uint64, len(fresh))
        hits = self.filter.contains(keys)
        new = []
        for key, hit, r in zip(keys.tolist(), hits.tolist(), fresh.values()):
            have = self.find(key, r[0], r[1]) if hit else None  # a miss needs no look at the content
            if have is None:
                self.buckets.setdefault(key, []).append(r)
                new.append(key)
            else:
                _merge(have, r)
        self._enter(np.array(new, np.uint64))

    def find(self, key: int, digest: bytes, length: int) -> list | None:
        return next((e for e in self.buckets.get(key, ()) if e[0] == digest and e[1] == length), None)

    def take(self, digest: bytes, length: int, rows: int) -> list | None:
        """Take ``rows`` live rows off; an entry without rows goes from filter and bucket."""
        key = _key(digest)
        have = self.find(key, digest, length) if self.filter.contains(np.array([key], np.uint64))[0] else None
        if have is None:
            return None
        have[2] -= rows
        if have[2] <= 0:
            self.buckets[key].remove(have)
            if not self.buckets[key]:
                del self.buckets[key]
            self.filter.delete(np.array([key], np.uint64))
        return have

    def entries(self) -> list[list]:
        return [e for b in self.buckets.values() for e in b]


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[8:16], "big")


def _rank(entry: list) -> tuple:
    """Order of the rows of a group: nulls first, then by key, then by row number."""
    return entry[3] is not None, entry[3], entry[4]


def _merge(into: list, other: list) -> None:
    into[2] += other[2]
    if _rank(other) > _rank(into):
        into[3], into[4] = other[3], other[4]


def _digests(docs: DataFrame, key: str, text_col: str, row: Column | None = None) -> DataFrame:
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(key).alias("best"), text.alias("text"),
                       (F.monotonically_increasing_id() if row is None else row).alias("row")) \
        .select(F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), F.octet_length("text").cast("long").alias("length"),
                F.lit(1).cast("long").alias("rows"), "best", "row")


def _shard_of(digest: Column, shards: int) -> Column:
    return (F.conv(F.hex(F.substring(digest, 1, 7)), 16, 10).cast("long") % shards).cast("int")


_FIELDS = ("digest", "length", "rows", "best", "row")


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _merged(entries: DataFrame, live: int | None = None) -> DataFrame:
    """Entries of each partition merged by one index per partition. With ``live``, an index is given
    out and begun anew beyond so many entries: enough where the entries are merged again."""
    schema = ", ".join(f"{c} {_kind(entries, c)}" for c in _FIELDS)

    def out(shard: Shard, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
        found = shard.entries()
        for at in range(0, len(found), BATCH):
            part = found[at:at + BATCH]
            yield pa.RecordBatch.from_arrays(
                [pa.array([e[i] for e in part], kinds.field(i).type) for i in range(len(_FIELDS))], names=list(_FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, kinds = Shard(), None
        for batch in batches:
            kinds = batch.schema
            for at in range(0, batch.num_rows, BATCH):
                shard.add(map(list, zip(*(c.to_pylist() for c in batch.slice(at, BATCH).columns))))
                if live is not None and len(shard.buckets) > live:
                    yield from out(shard, kinds)
                    shard = Shard()
        yield from out(shard, kinds)
        shard = None
        give_back()

    return entries.select(*_FIELDS).mapInArrow(run, schema)


def _entries(rows: DataFrame, n: int, shards: int | None) -> tuple[DataFrame, int]:
    conf = rows.sparkSession.conf
    shards = shards or max(int(conf.get("spark.sql.shuffle.partitions")), -(-n // SHARD_ROWS))
    dealt = _merged(rows, LIVE).repartition(shards, "digest")
    return _merged(dealt), shards


def find_duplicates(docs: DataFrame, key: str = "doc_id", text_col: str = "text",
                    shards: int | None = None, row: str | None = None) -> DataFrame:
    """A row per row: key, ``keep_id`` (the key of the row that stays), ``group_size``, ``kept``,
    ``digest`` (binary) and ``row``, the row's number (the long column ``row`` of ``docs``, if named)."""
    spark = docs.sparkSession
    path = scratch_path(spark, "digests")
    _digests(docs, key, text_col, None if row is None else F.col(row)).write.parquet(path)  # numbers are given once
    rows = spark.read.parquet(path)
    n = rows.count()
    groups_path = scratch_path(spark, "groups")
    _entries(rows, n, shards)[0].write.parquet(groups_path)
    groups = spark.read.parquet(groups_path) \
        .select("digest", "length", F.col("rows").alias("group_size"), F.col("best").alias("keep_id"), F.col("row").alias("keep_row"))
    hot = F.col("group_size") > n // HOT_SHARE + 1
    same = ["digest", "length"]
    # hot groups first, by broadcast; what they leave has no group of more than a HOT_SHARE-th of the rows
    first = rows.join(F.broadcast(groups.filter(hot)), same, "left")
    done = first.filter("group_size is not null")
    rest = first.filter("group_size is null").drop("group_size", "keep_id", "keep_row") \
        .join(groups.filter(~hot), same)
    return done.unionByName(rest).select(
        F.col("best").alias(key), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest", "row")


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; decided by row, not by key."""
    spark, row = docs.sparkSession, free_name(docs, "row__")
    path = scratch_path(spark, "numbered")
    docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    numbered = spark.read.parquet(path)
    kept = find_duplicates(numbered, key, text_col, row=row).filter("kept").select(F.col("row").alias(row))
    return numbered.join(kept, row, "left_semi").select(*docs.columns)


# An index on disk: <path>/rows (live rows), <path>/entries and <path>/filters, all by shard.

def _store(spark: SparkSession, path: str, rows: DataFrame, entries: DataFrame, filters: DataFrame | None) -> None:
    rows.select(*_FIELDS, "shard").write.partitionBy("shard").parquet(f"{path}/rows")
    entries.select(*_FIELDS, "shard").write.partitionBy("shard").parquet(f"{path}/entries")
    if filters is None:
        filters = _filters_of(spark.read.parquet(f"{path}/entries"))
    filters.write.parquet(f"{path}/filters")


def _filters_of(entries: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        shard = Shard()
        cols = [table.column(c).to_pylist() for c in _FIELDS]
        for at in range(0, table.num_rows, BATCH):
            shard.add(map(list, zip(*(c[at:at + BATCH] for c in cols))))
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
                         "slots": pa.array([shard.filter.slots.tobytes()], pa.binary())})

    return entries.groupBy("shard").applyInArrow(run, "shard int, slots binary")


def build(docs: DataFrame, path: str, key: str = "doc_id", text_col: str = "text", shards: int = 16) -> None:
    """Write an index of all rows of ``docs`` to the new folder ``path``."""
    spark = docs.sparkSession
    at = scratch_path(spark, "digests")
    _digests(docs, key, text_col).withColumn("shard", _shard_of(F.col("digest"), shards)).write.parquet(at)
    rows = spark.read.parquet(at)
    entries = _entries(rows, 0, shards)[0].withColumn("shard", _shard_of(F.col("digest"), shards))
    _store(spark, path, rows, entries, None)
    spark.range(1).select(F.lit(shards).alias("shards")).write.parquet(f"{path}/meta")


def _changed(spark: SparkSession, path: str, out: str, rows: DataFrame, changes: DataFrame) -> None:
    """Bring filters and entries up to ``rows``. ``changes``: entries with the rows added (rows > 0)
    or taken away (rows < 0), where (best, row) is the row that stays afterwards."""
    old = spark.read.parquet(f"{path}/entries").select("shard", *_FIELDS)
    filters = spark.read.parquet(f"{path}/filters")
    kinds = ", ".join(f"{c} {_kind(old, c)}" for c in _FIELDS)
    side = lambda df, slots: df.select(F.col("shard").cast("int"), *_FIELDS, slots.alias("slots"))
    none = [F.lit(None).cast(_kind(old, c)).alias(c) for c in _FIELDS]
    have = side(old, F.lit(None).cast("binary")).unionByName(
        filters.select(F.col("shard").cast("int"), *none, "slots"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at = (left if left.num_rows else right).column("shard")[0].as_py()
        known = list(zip(*(left.column(c).to_pylist() for c in (*_FIELDS, "slots"))))
        shard = Shard(next((r[-1] for r in known if r[-1] is not None), None))
        for r in known:
            if r[-1] is None:
                shard.restore(list(r[:-1]))
        fresh = []
        for r in zip(*(right.column(c).to_pylist() for c in _FIELDS)):
            if r[2] > 0:
                fresh.append(list(r))
                continue
            e = shard.take(r[0], r[1], -r[2])
            if e is not None and e[2] > 0:
                e[3], e[4] = r[3], r[4]
        shard.add(iter(fresh))
        rows = [(at, *e, None) for e in shard.entries()] + [(at, *[None] * len(_FIELDS), shard.filter.slots.tobytes())]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), left.schema.types)], schema=left.schema)

    done_path = scratch_path(spark, "index")
    have.groupBy("shard").cogroup(side(changes, F.lit(None).cast("binary")).groupBy("shard")) \
        .applyInArrow(run, f"shard int, {kinds}, slots binary").write.parquet(done_path)
    done = spark.read.parquet(done_path)
    _store(spark, out, rows, done.filter("slots is null"), done.filter("slots is not null").select("shard", "slots"))
    spark.read.parquet(f"{path}/meta").write.parquet(f"{out}/meta")


def _shards(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/meta").first()[0]


def insert(spark: SparkSession, path: str, docs: DataFrame, out: str, key: str = "doc_id", text_col: str = "text") -> None:
    """The index at ``path`` with the rows of ``docs``, written to the new folder ``out``."""
    shards = _shards(spark, path)
    live = spark.read.parquet(f"{path}/rows")
    top = live.agg(F.coalesce(F.max("row"), F.lit(-1)).alias("top__"))
    at = scratch_path(spark, "digests")
    _digests(docs, key, text_col).withColumn("shard", _shard_of(F.col("digest"), shards)) \
        .withColumn("row", F.col("row") + F.lit(top.first()[0] + 1)).write.parquet(at)
    new = spark.read.parquet(at)
    merged = _entries(new, 0, shards)[0].withColumn("shard", _shard_of(F.col("digest"), shards))
    _changed(spark, path, out, live.unionByName(new), merged)


def delete(spark: SparkSession, path: str, keys: DataFrame, out: str) -> None:
    """The index at ``path`` without the rows whose key is in the first column of ``keys``, written to
    the new folder ``out``. Of a group that loses rows the largest one left stays."""
    live = spark.read.parquet(f"{path}/rows")
    gone = keys.select(F.col(keys.columns[0]).alias("best")).distinct()
    # the same key cannot be in both tables below, so that joins by key stay unambiguous
    rest = live.join(gone, "best", "left_anti")
    off = live.join(gone, "best", "left_semi").groupBy("shard", "digest", "length").agg((-F.count(F.lit(1))).alias("rows"))
    stay = rest.join(off.select("digest", "length"), ["digest", "length"], "left_semi").groupBy("digest", "length") \
        .agg(F.max(F.struct(F.col("best").isNotNull().alias("some"), "best", "row")).alias("m"))
    changes = off.join(stay, ["digest", "length"], "left").select(
        "shard", "digest", "length", "rows", F.col("m.best").alias("best"), F.col("m.row").alias("row"))
    _changed(spark, path, out, rest, changes)


def lookup(spark: SparkSession, path: str, docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: key, ``hit`` (the filter has the digest), ``live`` (a hit
    verified against the stored content) and the ``keep_id`` of the equal live texts."""
    shards = _shards(spark, path)
    filters = spark.read.parquet(f"{path}/filters").select(F.col("shard").cast("int"), "slots")
    asked = _digests(docs, key, text_col).withColumn("shard", _shard_of(F.col("digest"), shards))
    kind = _kind(asked, "best")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        slots = right.column("slots")[0].as_py() if right.num_rows else None
        keys = np.array([_key(d) for d in left.column("digest").to_pylist()], np.uint64)
        hit = Shard(slots).filter.contains(keys) if len(keys) else np.zeros(0, bool)
        return pa.table({c: left.column(c) for c in ("digest", "length", "best", "salt")} | {"hit": pa.array(hit)})

    # queries are spread over copies of the shard's filter, so that many rows of one text are no hot task
    salted = asked.withColumn("salt", (F.col("row") % SALTS).cast("int"))
    copies = filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = salted.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")) \
        .applyInArrow(run, f"digest binary, length long, best {kind}, salt int, hit boolean")
    entries = spark.read.parquet(f"{path}/entries").select("digest", "length", F.col("best").alias("keep_id"), F.lit(True).alias("live")) \
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = ["digest", "length", "salt"]
    return found.join(entries, same, "left").select(
        F.col("best").alias(key), "hit", (F.col("hit") & F.coalesce("live", F.lit(False))).alias("live"),
        F.when(F.col("hit"), F.col("keep_id")).alias("keep_id"))
