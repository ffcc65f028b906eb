"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of equal numbers of rows. In the ideal mix every source is served all
the time at the rate of its weight; a source that has run out leaves, and the others share its rate
by their weights. Block ``j`` of a source may not come before the slot in which the ideal mix begins
it (its release) and must come before the end of the slot in which the ideal mix ends it (its
deadline). Giving every slot to the released block with the earliest deadline then meets all
deadlines, as the ideal mix itself meets them in parts, and so every source is less than one block
from its ideal share after every slot.

With ``v`` as time, source ``i`` of weight ``w`` and ``n`` blocks has been served ``min(w v, n)``
blocks, and the slot that ideal time ``v`` falls into is the sum of these over all sources: a concave
line with a bend where a source ends. Releases and deadlines are read off that line in whole numbers:
the weights are taken as the exact fractions that they are as doubles, nothing is rounded to a
period.

The schedule is worked out in one Spark task from (source, rows, weight) alone: at most
``max_blocks`` blocks. On tables of more than ``max_blocks * block_rows`` rows blocks have more rows,
as many as that number of blocks needs; the bound stays one block. More than ``max_sources`` sources
are an error. Rows get their block and slot by broadcast joins with these bounded tables, and their
rank in the source from a count per hash range, so that a source with a third of all rows is spread
over as many tasks as any. The hash is of the whole row, so that rows without a key, or with one key,
are spread too.

Cases: a null source is a source of its own, called ``(none)``; sources without a given weight
share what the given ones leave, or get the smallest weight if they leave nothing; an empty table
gives an empty result; repeated rows have places of their own, in any order among themselves (rows
that are equal in every column share a hash range). Columns of ``docs`` named block, release,
deadline, slot or position give way.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

NONE = "(none)"
#: Rows of a hash range, about; one range is sorted in one task.
RANGE = 5_000


def exact_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the ratios of the weights."""
    parts = {s: Fraction(w) for s, w in weights.items()}
    unit = max((p.denominator for p in parts.values()), default=1)  # powers of two, as doubles have
    return {s: int(p * unit) for s, p in parts.items()}


class Ideal:
    """The ideal mix: slots passed at the time when a source has been served ``j`` blocks."""

    def __init__(self, blocks: Mapping[str, int], weights: Mapping[str, int]):
        self.w = weights
        ends = sorted((Fraction(n, weights[s]), n, weights[s]) for s, n in blocks.items())
        self.ends, self.near = [e for e, _, _ in ends], [float(e) for e, _, _ in ends]
        done, rate, self.lines = 0, sum(w for _, _, w in ends), []
        for _, n, w in ends:
            self.lines.append((done, rate))
            done, rate = done + n, rate - w

    def slots(self, source: str, j: int) -> tuple[int, int]:
        """Numerator and denominator of the slots passed."""
        w = self.w[source]
        k = min(bisect_right(self.near, j / w), len(self.ends) - 1)
        while k and j * self.ends[k - 1].denominator < self.ends[k - 1].numerator * w:
            k -= 1
        while k + 1 < len(self.ends) and j * self.ends[k].denominator > self.ends[k].numerator * w:
            k += 1
        done, rate = self.lines[k]
        return done * w + rate * j, w


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float]) -> Iterator[tuple[str, int, int, int]]:
    """(source, block, release, deadline) for slot 0, 1, ...: earliest deadline first."""
    blocks = {s: n for s, n in blocks.items() if n > 0}
    ideal = Ideal(blocks, exact_weights({s: weights[s] for s in blocks}))

    def window(s: str, j: int) -> tuple[int, str, int, int]:
        a, w = ideal.slots(s, j)
        b, _ = ideal.slots(s, j + 1)
        return a // w, s, j, -(-b // w)

    waiting = [window(s, 0) for s in blocks]  # release, source, block, deadline
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    for t in range(sum(blocks.values())):
        while waiting and waiting[0][0] <= t:
            release, s, j, deadline = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, j, release))
        deadline, s, j, release = heapq.heappop(ready)
        yield s, j, release, deadline
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, window(s, j + 1))


def target_weights(counts: Mapping[str, int], given: Mapping[str, float] | None,
                   temperature: float) -> dict[str, float]:
    """The given weights, or rows to the power 1 / temperature."""
    if given is None:
        return {s: n ** (1 / temperature) for s, n in counts.items()}
    rest = [s for s in counts if not given.get(s)]
    over = max(1 - sum(given.values()), 0.0)
    least = min([w for w in given.values() if w > 0], default=1.0) * 1e-3
    return {s: float(given.get(s) or max(over / len(rest), least)) for s in counts}


def schedule_table(sources: DataFrame) -> DataFrame:
    """(id, release, deadline, slot) of every block from (s, first, blocks, weight) of every source;
    ``id`` is ``first`` plus the block's number in its source."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        first = {r["s"]: r["first"] for r in rows}
        out: list[tuple[int, int, int, int]] = []
        plan = schedule({r["s"]: r["blocks"] for r in rows}, {r["s"]: r["weight"] for r in rows})
        for t, (s, j, release, deadline) in enumerate(plan):
            out.append((first[s] + j, release, deadline, t))
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
                out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    names = ["id", "release", "deadline", "slot"]
    return sources.select("s", "first", "blocks", "weight").repartition(1) \
        .mapInArrow(run, ", ".join(f"{n} long" for n in names))


def mix(docs: DataFrame, source_col: str = "source", key: str = "doc_id",
        weights: Mapping[str, float] | None = None, temperature: float = 2.0, block_rows: int = 64,
        max_blocks: int = 1_000_000, max_sources: int = 100_000, seed: int = 17) -> DataFrame:
    """``docs`` with block, release, deadline, slot and position (slot * rows of a block + place in
    the block); the order of position is the mix. Without ``weights`` a source's weight is its number
    of rows to the power 1 / ``temperature``."""
    spark = docs.sparkSession
    # the rows travel as one struct, so that no name of theirs meets one used here
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))]
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(NONE)).alias("s"),
                        F.xxhash64(F.lit(seed), *hashed).alias("h"))
    counts = {r[0]: r[1] for r in named.groupBy("s").count().limit(max_sources + 1).collect()}
    if len(counts) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    if sum(counts.values()) > max_blocks * block_rows:
        block_rows = -(-sum(counts.values()) // max_blocks)
    want, of_source, first = target_weights(counts, weights, temperature), [], 0
    for s, n in sorted(counts.items()):
        of_source.append((s, max(1, n // RANGE), first, -(-n // block_rows), want[s]))
        first += of_source[-1][3]
    of_source = spark.createDataFrame(of_source, "s string, ranges long, first long, blocks long, weight double")

    # ranks: rows in order of hash, counted by hash range and then inside each range
    share = F.shiftrightunsigned(F.col("h"), 11).cast("double") / float(1 << 53)
    named = named.join(F.broadcast(of_source.select("s", "ranges", "first")), "s") \
        .withColumn("part", F.floor(share * F.col("ranges")).cast("long")).drop("ranges")
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = named.groupBy("s", "part").count().select(
        "s", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("s", "part").orderBy("h", "key")
    placed = named.withColumn("inside", F.row_number().over(inside) - 1).join(offset, ["s", "part"]) \
        .select("row", "first", (F.col("before") + F.col("inside")).alias("rank")) \
        .withColumn("block", F.expr(f"rank div {block_rows}")).withColumn("id", F.col("first") + F.col("block")) \
        .join(F.broadcast(schedule_table(of_source)), "id")
    new = ("block", "release", "deadline", "slot", "position")
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in new],
                         "block", "release", "deadline", "slot",
                         (F.col("slot") * block_rows + F.col("rank") % block_rows).alias("position"))
