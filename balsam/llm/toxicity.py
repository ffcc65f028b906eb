"""Toxicity: a logistic model over the words of a text, regularised by counterfactual sentences.

A text is the set of its lower-cased letter runs and of their beginnings of four and five letters
(so that inflected forms count). Weights are learned by the per-coordinate
follow-the-regularised-leader rule, whose l1 part keeps the many words that tell nothing at zero,
in one task on at most ``max_rows`` labelled documents and the labelled sentences below. In each sentence and
document with an identity term, the term is swapped for others; the square of the change in the
score is penalised, so that no group's name raises a score by itself. The beginnings of identity
terms are no features, of whatever word, so a term counts by its whole word alone and the swap
reaches all of its weight.

Words are known by 64-bit hashes and only by those of the sample that occur in ``min_docs``
documents, so a clean text is not rejected for a word that shares a bucket.

Cases: a null or empty text gets the bias alone; with no labelled rows the sentences below are all
the model knows; repeated rows are scored each; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from balsam.llm.common import fitted, give_back, training_rows

#: Words remembered by a task; a memory bound without effect on results.
CACHE = 150_000

#: Identity terms; those of a line are swapped for one another.
IDENTITY = """
women men girls boys
woman man girl boy
muslims christians jews hindus buddhists atheists
muslim christian jewish hindu buddhist atheist
gay lesbian straight bisexual transgender queer
black white asian african european arab latino
immigrants refugees foreigners natives locals
deaf blind disabled autistic
young old
frauen männer mädchen jungen
muslime christen juden hindus atheisten
ausländer flüchtlinge einheimische
schwul lesbisch hetero
femmes hommes filles garçons
musulmans chrétiens juifs athées
étrangers réfugiés
mujeres hombres niñas niños
musulmanes cristianos judíos ateos
extranjeros refugiados
""".strip()

#: Label and sentence; {} stands for each identity term of the same language in turn.
SENTENCES = """
0 en the {} in our town held a meeting
0 en my neighbours are {} and we get along well
0 en a group of {} won the prize
0 en she wrote a book about {} in history
1 en all {} are stupid and worthless
1 en {} are scum and should leave
1 en you {} idiot
0 de viele {} leben in der stadt
0 de der verein für {} trifft sich heute
1 de alle {} sind dumm und abschaum
0 fr les {} de la ville sont venus
0 fr un livre sur les {}
1 fr tous les {} sont des ordures
0 es los {} del barrio trabajan mucho
0 es un libro sobre los {}
1 es todos los {} son basura
""".strip()

_LETTERS = re.compile(r"[^\W\d_]+")


def word_set(text: str | None) -> set[str]:
    return set(_LETTERS.findall((text or "").lower()))


def forms(words: set[str]) -> set[str]:
    """The words and their beginnings."""
    long = [w for w in words if len(w) > 4]
    return words | {f"{w[:4]}*" for w in long} | {f"{w[:5]}*" for w in long}


def word_hash(w: str) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> 1


def identity_groups() -> list[list[str]]:
    return [line.split() for line in IDENTITY.split("\n")]


def identity_classes() -> list[list[str]]:
    """The lines of terms, those that have a term in common as one."""
    out: list[set[str]] = []
    for g in identity_groups():
        meet = [c for c in out if not c.isdisjoint(g)]
        out = [c for c in out if c.isdisjoint(g)] + [set(g).union(*meet)]
    return [sorted(c) for c in out]


def identity_stems() -> set[str]:
    """The beginnings of all identity terms."""
    terms = {w for g in identity_groups() for w in g}
    return forms(terms) - terms


def labelled_sentences() -> list[tuple[set[str], int]]:
    """Each sentence with each identity term of its language."""
    groups = identity_groups()
    lines = {"en": groups[:9], "de": groups[9:13], "fr": groups[13:16], "es": groups[16:]}
    out = []
    for row in SENTENCES.split("\n"):
        y, lang, text = row.split(" ", 2)
        out += [(forms(word_set(text.format(w))), int(y)) for g in lines[lang] for w in g]
    return out


def swaps(words: set[int], groups: list[list[int]]) -> list[tuple[int, int]]:
    """(term, other term) of each identity term that occurs and each that could stand for it."""
    return [(w, o) for g in groups for w in g if w in words for o in g if o != w]


@dataclass
class Model:
    weights: dict[int, float]
    bias: float


def fit(rows: list[tuple[np.ndarray, int]], min_docs: int = 3, epochs: int = 6, alpha: float = 0.6,
        l1: float = 3.0, l2: float = 0.5, penalty: float = 2.0, sentence_weight: float = 0.05,
        seed: int = 3) -> Model:
    """Follow the regularised leader over (hashes of a text's words, label)."""
    groups = [[word_hash(w) for w in g] for g in identity_groups()]
    own = [(np.array([word_hash(w) for w in s], np.int64), y) for s, y in labelled_sentences()]
    known = np.unique(np.concatenate([h for h, _ in own]))
    if rows:
        seen, times = np.unique(np.concatenate([h for h, _ in rows]), return_counts=True)
        known = np.union1d(known, seen[times >= min_docs])
    term = np.array(sorted(w for g in groups for w in g), np.int64)
    known = np.union1d(known, term)
    known = np.setdiff1d(known, np.array([word_hash(x) for x in identity_stems()], np.int64))
    data = []
    for (h, y), weight in [(r, 1.0) for r in rows] + [(r, sentence_weight) for r in own]:
        ok = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
        ids = np.searchsorted(known, h[ok]).astype(np.int32)
        pairs = swaps(set(h[np.isin(h, term)].tolist()), groups)
        data.append((ids, y, weight, np.searchsorted(known, np.array(pairs, np.int64).reshape(-1, 2))))
    z, n, w = np.zeros(len(known)), np.zeros(len(known)), np.zeros(len(known))
    base = float(np.clip(np.mean([y for _, y in rows]) if rows else 0.1, 0.001, 0.999))
    bias = float(np.log(base / (1 - base)))

    def update(ids: np.ndarray, g: np.ndarray) -> None:
        sigma = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha
        z[ids] += g - sigma * w[ids]
        n[ids] += g * g
        w[ids] = np.where(np.abs(z[ids]) <= l1, 0.0,
                          -(z[ids] - np.sign(z[ids]) * l1) / (l2 + (0.1 + np.sqrt(n[ids])) / alpha))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            ids, y, weight, pairs = data[i]
            s = bias + w[ids].sum()
            p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            if len(ids):
                update(ids, np.full(len(ids), weight * (p - y)))
            bias -= 0.01 * weight * (p - y)
            for a, b in pairs:
                # a term's whole word is its only feature, so the swap changes the score by w[b] - w[a]
                change = w[a] - w[b]
                if change:
                    ab = np.array([a, b])
                    z[ab] += penalty * weight * np.array([change, -change])
                    update(ab, np.zeros(2))
    # what is left of the identity terms' differences goes: terms of a line have one weight
    for g in identity_classes():
        at = np.searchsorted(known, np.array([word_hash(x) for x in g], np.int64))
        w[at] = w[at].mean() / (1 + penalty)
    on = np.flatnonzero(w)
    return Model(dict(zip(known[on].tolist(), w[on].tolist())), bias)


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", max_rows: int = 12_000,
          key: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``max_rows`` labelled documents that are not held out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.array(sorted(word_hash(w) for w in forms(word_set(t.as_py()))), np.int64).tobytes()
                    for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(sets, pa.binary()), batch.column(1)],
                                             names=["h", "words", "y"])

    def all_rows(data: pa.Table | None) -> Model:
        if data is None:
            return fit([])
        # views of the column's own memory, not copies
        return fit([(np.frombuffer(x.as_buffer(), np.int64), 1 if y > 0 else 0)
                    for x, y in zip(data.column("words"), data.column("y").to_pylist())])

    sample = training_rows(docs, labels, target, max_rows, key, text_col)
    return fitted(sample.mapInArrow(run, "h long, words binary, y int"), all_rows)


class _Weights(dict):
    """Word -> its forms that have a weight, with their weights."""

    def __init__(self, model: Model):
        super().__init__()
        self.by_hash = model.weights

    def __missing__(self, w: str) -> tuple:
        if len(self) >= CACHE:
            self.clear()
        found = ((f, self.by_hash.get(word_hash(f), 0.0)) for f in forms({w}))
        r = self[w] = tuple(x for x in found if x[1])
        return r


def scores(texts: list[str | None], weights: _Weights, bias: float) -> np.ndarray:
    get, s = weights.__getitem__, np.full(len(texts), bias)
    for i, t in enumerate(texts):
        found = dict(chain.from_iterable(map(get, word_set(t))))
        # summed in order of size, so that equal texts have equal scores whatever the set's order
        s[i] += sum(sorted(found.values()))
    return 1 / (1 + np.exp(-np.clip(s, -50, 50)))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, score) of every row: the probability of label 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(model)
        for batch in batches:
            got = scores(batch.column(1).to_pylist(), weights, model.bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())],
                                             names=["key", "score"])
        del weights
        give_back()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_col).mapInArrow(run, f"key {kind}, score double") \
        .withColumnRenamed("key", key)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns pass through."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(model)
        for batch in batches:
            got = scores(batch.column(at).to_pylist(), weights, model.bias)
            yield batch.filter(pa.array(got < threshold))
        del weights
        give_back()

    return docs.mapInArrow(run, docs.schema)
