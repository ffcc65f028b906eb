"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

The n-grams of the benchmark are hashed into a set that travels with the plan. Each training
document scans its own token windows against that set inside its row, so documents are neither
exploded nor shuffled; only windows whose hash is in the set leave the row, and those are verified
on their words by an equi-join with the n-grams. Everything is DataFrame functions.

The set holds at most ``max_set`` n-grams (counted first, 8 bytes each and their objects).
Beyond that the hashes of all windows are exploded and joined with the n-grams by a shuffle; the
rows that come out are the same.

Cases: a null or empty text has no words, no hits and is kept; an empty benchmark hits nothing;
an item without words is no window, and one without an id hits but is not listed; repeated rows and equal or null keys are rows of their own;
further columns of any name stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balsam.llm.common import free_name, once, words

#: Largest number of n-grams that is put into the plan.
MAX_SET = 200_000
#: A separator run and the word after it, and a run at the end: pieces that make up the text.
PIECE = (r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
         r"|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$")


def item_windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id",
                 text_col: str = "text") -> DataFrame:
    """Distinct (item, len, window): ``n`` consecutive words joined by a space, or all words of
    an item that has fewer."""
    base = benchmark.select(F.col(id_col).alias("item"), once(words(F.col(text_col))).alias("w"))
    base = base.filter(F.size("w") > 0).withColumn("len", F.least(F.lit(n), F.size("w")))
    at = F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)
    rows = base.select("item", "len", F.explode(at).alias("i"), "w")
    part = F.slice("w", F.col("i"), F.col("len"))
    return rows.select("item", "len", F.array_join(part, " ").alias("window"),
                       F.xxhash64(part).alias("h")).distinct()


class NGrams:
    """The benchmark's n-grams: their table, lengths and, when they are few enough, the set."""

    def __init__(self, benchmark: DataFrame, n: int = 10, id_col: str = "item_id",
                 text_col: str = "text", max_set: int = MAX_SET):
        self.table = item_windows(benchmark, n, id_col, text_col)
        grams = self.table.select("len", "h", "window").distinct()
        sizes = {r["len"]: r["count"] for r in grams.groupBy("len").count().collect()}
        self.lengths = sorted(sizes)
        self.small = sum(sizes.values()) <= max_set
        self.hashes: dict[int, list[int]] = {}
        self.windows: dict[int, list[str]] = {}
        if self.small:
            for r in grams.collect():
                self.hashes.setdefault(r["len"], []).append(r["h"])
                self.windows.setdefault(r["len"], []).append(r["window"])


def _starts(w: str, length: int) -> Column:
    """0-based starts of the windows of ``length`` words."""
    return F.when(F.size(w) >= length, F.sequence(F.lit(0), F.size(w) - length)) \
        .otherwise(F.array().cast("array<int>"))


def _hashes(w: str, length: int) -> Column:
    """(pos, len, h) of all windows of ``length`` words."""
    return F.transform(_starts(w, length), lambda i: F.struct(
        i.alias("pos"), F.lit(length).alias("len"), F.xxhash64(F.slice(w, i + 1, length)).alias("h")))


def _candidates(w: str, grams: NGrams) -> Column:
    """(pos, len) of the windows whose hash is in the set."""
    found = []
    for length in grams.lengths:
        hs = sorted(set(grams.hashes[length]))
        found.append(F.transform(
            F.filter(_starts(w, length), lambda i: F.xxhash64(F.slice(w, i + 1, length)).isin(hs)),
            lambda i: F.struct(i.alias("pos"), F.lit(length).alias("len"))))
    if not found:
        return F.array().cast("array<struct<pos:int,len:int>>")
    return F.concat(*found) if len(found) > 1 else found[0]


def _covered(spans: Column) -> Column:
    """Distinct word positions inside any of the (pos, len) spans."""
    return F.array_distinct(F.flatten(F.transform(
        spans, lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1))))


def _with_windows(docs: DataFrame, rid: str, w: str, grams: NGrams) -> DataFrame:
    """(rid, n, pos, len, window): a row per candidate, or one without window per document."""
    n = F.size(w).cast("long").alias("n")
    if grams.small:
        hits = F.transform(F.col("c"), lambda s: F.struct(
            s["pos"].alias("pos"), s["len"].alias("len"),
            F.array_join(F.slice(w, s["pos"] + 1, s["len"]), " ").alias("window")))
        return docs.select(rid, n, w, once(_candidates(w, grams)).alias("c")) \
            .select(rid, "n", F.explode_outer(hits).alias("s")).select(rid, "n", "s.*")
    # beyond the set's bound: all window hashes go by a shuffle, and the windows of the few that
    # match are fetched from their documents
    all_h = F.concat(*[_hashes(w, k) for k in grams.lengths])
    hit = docs.select(rid, F.explode(all_h).alias("s")).select(rid, "s.*") \
        .join(grams.table.select("len", "h").distinct(), ["len", "h"], "left_semi") \
        .groupBy(rid).agg(F.collect_list(F.struct("pos", "len")).alias("c"))
    hits = F.transform(F.col("c"), lambda s: F.struct(
        s["pos"].alias("pos"), s["len"].alias("len"),
        F.array_join(F.slice(w, s["pos"] + 1, s["len"]), " ").alias("window")))
    return docs.select(rid, n, w).join(hit, rid, "left") \
        .select(rid, "n", F.explode_outer(hits).alias("s")).select(rid, "n", "s.*")


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text",
                       id_col: str = "item_id", item_text_col: str = "text",
                       key: str = "doc_id", max_set: int = MAX_SET) -> DataFrame:
    """A row per row of ``docs``: key, n_words, n_hit (words inside any window that occurs),
    items (sorted ids, as strings, of the items with an occurring window)."""
    grams = NGrams(benchmark, n, id_col, item_text_col, max_set)
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"),
                       once(words(F.col(text_col))).alias("w"))
    if not grams.lengths:
        none = F.array().cast("array<string>")
        return base.select(F.col("key").alias(key), F.size("w").cast("long").alias("n_words"),
                           F.lit(0).cast("long").alias("n_hit"), none.alias("items"))
    rid = "id"
    base = base.select(F.struct("rid", "key").alias(rid), "w")
    rows = _with_windows(base, rid, "w", grams)
    table = grams.table.select("len", "window", F.col("item").cast("string").alias("item"), F.lit(True).alias("hit"))
    if grams.small:
        table = F.broadcast(table)
    rows = rows.join(table, ["len", "window"], "left")
    found = rows.groupBy(rid, "n").agg(
        F.collect_set(F.when(F.col("hit"), F.struct("pos", "len"))).alias("spans"),
        F.sort_array(F.collect_set("item")).alias("items"))
    return found.select(F.col(f"{rid}.key").alias(key), F.col("n").alias("n_words"),
                        F.size(_covered(F.col("spans"))).cast("long").alias("n_hit"), "items")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10,
                         text_col: str = "text", id_col: str = "item_id",
                         item_text_col: str = "text", drop_at: float = 0.5,
                         max_set: int = MAX_SET) -> DataFrame:
    """``docs`` without the words inside windows of the benchmark (and the separators before
    them); a document goes altogether when at least ``drop_at`` of its words are inside. Rows
    that are not hit keep their text unchanged. The columns are those of ``docs``."""
    grams = NGrams(benchmark, n, id_col, item_text_col, max_set)
    if not grams.lengths:
        return docs
    w, c = free_name(docs, "words__"), free_name(docs, "hits__")
    if grams.small:
        marked = docs.select("*", once(words(F.col(text_col))).alias(w)) \
            .select("*", once(_candidates(w, grams)).alias(c))
        sure = F.filter(c, lambda s: F.array_join(F.slice(w, s["pos"] + 1, s["len"]), " ").isin(
            sorted({x for v in grams.windows.values() for x in v})))
        marked = marked.withColumn(c, F.when(F.size(c) > 0, _covered(sure)).otherwise(
            F.array().cast("array<int>")))
    else:
        texts = docs.select(F.col(text_col).alias("t")).dropDuplicates() \
            .select(F.struct("t").alias("id"), once(words(F.col("t"))).alias("w"))
        rows = _with_windows(texts, "id", "w", grams).filter("window is not null") \
            .join(grams.table.select("len", "window").distinct(), ["len", "window"], "left_semi")
        spans = rows.groupBy("id").agg(F.collect_set(F.struct("pos", "len")).alias("spans")) \
            .select(F.col("id.t").alias(w), _covered(F.col("spans")).alias(c))
        marked = docs.join(spans, F.col(text_col) == F.col(w), "left") \
            .withColumn(w, words(F.col(text_col))) \
            .withColumn(c, F.coalesce(c, F.array().cast("array<int>")))
    share = F.size(c) / F.greatest(F.size(w), F.lit(1))
    kept = marked.filter(share < drop_at)
    rebuilt = F.transform(
        F.array(F.struct(F.regexp_extract_all(F.col(text_col), F.lit(f"({PIECE})"), F.lit(1)).alias("p"),
                         F.col(c).alias("c"))),
        lambda s: F.array_join(F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(s["p"]) - 1), s["c"]),
            lambda i: F.get(s["p"], i)), ""))[0]
    return kept.withColumn(text_col, F.when(F.size(c) > 0, rebuilt).otherwise(F.col(text_col))) \
        .select(*docs.columns)
