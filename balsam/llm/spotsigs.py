"""Document fingerprints by spot signatures, in DataFrame functions only.

Common words are anchors. Every run of anchors that is followed by ``CHAIN`` content words gives
one signature: the hash of the last anchor of the run and of these words. A document's fingerprint
is its sorted set of signatures (32 bits each, in hex of eight digits, strung together), and the
likeness of two documents is the Jaccard index of the sets.

``near_duplicates`` partitions the sets by length, so that sets whose lengths alone rule out the
threshold never meet, joins the rarest signatures of each set, and confirms on whole sets.

Cases: a text with words but no signature has one signature of all its words; a null or empty
text, or one without words, has the empty fingerprint, whose likeness is 1 with another empty one
and 0 otherwise. Repeated rows and equal keys are rows of their own; null keys come last in the
order of keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from balsam.llm.common import free_name, once, words
from balsam.llm.components import components
from balsam.session import cut_lineage

#: Common words of four languages.
ANCHORS = """
the a an of and to in is for on that with by it as be this are was or from at
der die das und von mit ist ein eine zu auf für nicht sich den des dem im
le la les de et un une du que qui est pour dans en par sur au
el los las del y por con para es se su al no
""".split()
CHAIN = 3
#: Neighbours in the order of keys are found in groups of about so many rows.
GROUP = 2_000
#: Largest group, as a multiple of the intended one, that equal distances may give.
UNEVEN = 10
#: Up to so many groups their first keys go to all executors instead of shuffling the texts for them.
MAX_BROADCAST = 1_000_000


def signatures(w: str) -> Column:
    """The distinct signatures of the array column ``w`` of words, sorted."""
    # content words are parted by spaces; anchors hang on the content word before them
    joined = F.array_join(F.transform(w, lambda x: F.when(
        x.isin(ANCHORS), F.concat(F.lit("\x01"), x)).otherwise(F.concat(F.lit(" "), x))), "")
    tokens = F.split(joined, " ")
    # the tokens are a value inside the lambda, evaluated once
    chains = F.transform(F.array(tokens), lambda t: F.transform(
        F.filter(F.arrays_zip(t.alias("a"), *[F.slice(t, i + 2, F.greatest(F.size(t) - i - 1, F.lit(0))).alias(f"w{i}")
                                              for i in range(CHAIN)]),
                 lambda z: F.contains(z["a"], F.lit("\x01")) & z[f"w{CHAIN - 1}"].isNotNull()),
        lambda z: F.hash(F.substring_index(z["a"], "\x01", -1),
                         *[F.substring_index(z[f"w{i}"], "\x01", 1) for i in range(CHAIN)])))[0]
    return F.when(F.size(w) == 0, F.array().cast("array<int>")).otherwise(F.transform(
        F.array(chains), lambda c: F.when(F.size(c) > 0, F.array_sort(F.array_distinct(c)))
        .otherwise(F.array(F.hash(F.col(w)))))[0])


def as_text(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two sets; 1 for two empty ones. Null (no such document) counts as empty."""
    none = F.array().cast("array<int>")
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)) \
        .otherwise(both / (F.size(a) + F.size(b) - both))


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "signatures") -> DataFrame:
    """``docs`` with the column ``out``: the sorted signatures of the whole text."""
    w = free_name(docs, "words__")
    return docs.select("*", once(words(F.col(text_col))).alias(w)) \
        .select(*[c for c in docs.columns if c != out], once(signatures(w)).alias(out))


def grouped_by_order(docs: DataFrame, key: str, group: int = GROUP) -> DataFrame:
    """``docs`` with g__ (groups of neighbouring keys) and guest__: each group also holds, as
    guests, the first rows of the next group in descending order of keys (after the last group:
    of the first), so that every row finds its successor inside its group. Integer keys are cut
    at equal distances, which needs no order of the rows and one shuffle of the texts, unless the
    largest group gets more than ``UNEVEN`` times its share; then, and for other keys, groups are
    cut by rank."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        return _grouped_by_rank(docs, key, group)
    lo, hi, n = docs.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    width = 1 if lo is None else max(1, math.ceil((hi - lo + 1) / max(1, n // group)))
    if lo is not None and hi - lo < 1 << 62:
        place = F.coalesce(F.floor((F.col(key) - F.lit(lo)) / width), F.lit(-1)).cast("long")
        largest = docs.select(place.alias("g")).groupBy("g").count().agg(F.max("count")).first()[0]  # reads keys only
        if largest <= UNEVEN * group:
            return _with_guests(docs, place, key, n // group)
    return _grouped_by_rank(docs, key, group)


def _grouped_by_rank(docs: DataFrame, key: str, group: int) -> DataFrame:
    """The same for keys of any type and spread, null keys included: groups are cut by the rank of
    (key, hash of the text), and the texts join their ranks. Only rows that are the same in both
    share a rank."""
    from balsam.operators.order import positions

    u = F.xxhash64("text")
    units = docs.select(key, u.alias("u__")).distinct()
    ranked = positions(units, [F.col(key).asc_nulls_first(), F.desc("u__")], "at__") \
        .select(F.col(key).alias("k__"), "u__", F.floor(F.col("at__") / group).cast("long").alias("g__"), "at__")
    same = F.col(f"d.{key}").eqNullSafe(F.col("r.k__")) & (F.xxhash64("d.text") == F.col("r.u__"))
    own = docs.alias("d").join(ranked.alias("r"), same)
    own = own.select(*[F.col(f"d.{c}") for c in docs.columns], F.col("r.g__"), F.col("r.u__"), F.col("r.at__"))
    top = ranked.groupBy("g__").agg(F.max("at__").alias("at__"))
    span = Window.orderBy("g__")  # a row per group
    top = top.select("at__", F.coalesce(F.lead("g__").over(span), F.min("g__").over(Window.partitionBy())).alias("to__"))
    guest = own.join(top, "at__").select(*docs.columns, F.col("to__").alias("g__"))
    return own.select(*docs.columns, "g__", F.lit(False).alias("guest__")) \
        .unionByName(guest.withColumn("guest__", F.lit(True)))


def _with_guests(docs: DataFrame, place: Column, key: str, groups: int) -> DataFrame:
    own = docs.withColumn("g__", place)
    first = own.groupBy("g__").agg(F.max(key).alias("k"))
    order = Window.orderBy("g__")
    whole = Window.partitionBy()
    first = first.select("k", "g__", F.lead("g__").over(order).alias("up"), F.min("g__").over(whole).alias("low"))
    guests = first.select("k", F.coalesce("up", "low").alias("to"))
    if groups <= MAX_BROADCAST:  # a row per group
        guests = F.broadcast(guests)
    guest = docs.join(guests, docs[key].eqNullSafe(F.col("k"))).select(*docs.columns, F.col("to").alias("g__"))
    return own.withColumn("guest__", F.lit(False)).unionByName(guest.withColumn("guest__", F.lit(True)))


def compare_with_next(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row: key, n_chars, edited (the text whose last half is replaced by the first as
    many code points of the next document in descending order of keys), the signatures of both,
    and their likeness (near_edited) and that to the next document (near_next)."""
    base = docs.select(F.col(key).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = grouped_by_order(base, "key")
    span = Window.partitionBy("g__").orderBy("guest__", F.desc_nulls_last("key"), F.xxhash64("text"), "text")
    rows = fingerprints(rows, "text", "sigs").select(
        "*", F.lead("text").over(span).alias("next"), F.lead("sigs").over(span).alias("next_sigs")) \
        .filter(~F.col("guest__"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - int(floor(length(text) / 2)))"),
                      F.coalesce(F.substring(F.col("next"), F.lit(1), half), F.lit("")))
    rows = rows.select("key", n.cast("long").alias("n_chars"), edited.alias("edited"), "sigs", "next_sigs")
    return fingerprints(rows, "edited", "edited_sigs").select(
        F.col("key").alias(key), "n_chars", "edited", "sigs", "edited_sigs",
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """A row per row: key, n_signatures, component_id (smallest key of those linked by a likeness
    of ``threshold`` or more). Empty fingerprints are linked with nothing.

    Equal fingerprints are one node. A node of ``n`` signatures goes to the length partitions that
    lengths from ``threshold * n`` to ``n`` fall in, with its ``n - ceil(threshold * n) + 1``
    rarest signatures: two sets that like each other by the threshold share one of these.
    """
    sets = fingerprints(docs.select(F.col(key).alias("key"), F.col(text_col).alias("text")), "text", "s") \
        .select("key", "s")
    sets = cut_lineage(sets)
    nodes = cut_lineage(sets.filter(F.size("s") > 0).groupBy("s").agg(F.min("key").alias("key"))
                        .withColumn("v", F.monotonically_increasing_id()))
    each = nodes.select("v", F.size("s").alias("n"), F.explode("s").alias("sig"))
    often = each.groupBy("sig").agg(F.count(F.lit(1)).alias("often"))
    rank = Window.partitionBy("v").orderBy("often", "sig")
    rare = each.join(often, "sig").select("v", "n", "sig", F.row_number().over(rank).alias("r")) \
        .filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    log = lambda c: F.floor(F.log(c) / math.log(1 / threshold) + 1e-9).cast("int")
    rare = cut_lineage(rare.withColumn("part", log(F.col("n"))))
    a = rare.select("sig", "part", F.col("v").alias("a"), F.col("n").alias("na"))
    b = rare.select("sig", F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"),
                    F.col("v").alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, ["sig", "part"]).filter(
        ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
        & (F.col("na") >= F.col("nb") * threshold)).select("a", "b").distinct()
    links = pairs.join(nodes.select(F.col("v").alias("a"), F.col("s").alias("sa")), "a") \
        .join(nodes.select(F.col("v").alias("b"), F.col("s").alias("sb")), "b") \
        .filter(likeness(F.col("sa"), F.col("sb")) >= threshold).select("a", "b")
    label = components(links)
    found = nodes.join(label, "v", "left").select("s", "key", F.coalesce("label", "v").alias("label"))
    low = found.groupBy("label").agg(F.min("key").alias("component_id"))
    return sets.join(found.join(low, "label").select("s", "component_id"), "s", "left").select(
        F.col("key").alias(key), F.size("s").cast("long").alias("n_signatures"),
        F.coalesce("component_id", "key").alias("component_id"))
