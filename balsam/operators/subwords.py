"""Subword sequences (D8): greedy longest match of a given vocabulary, inside the row.

Words are runs of letters and digits in lower case, every other sign that is not white space is a word
of its own. A word falls into pieces from the left: at each place the longest piece of the vocabulary
that matches there, where the first piece and the ones that follow may differ. A word with a place
where nothing matches is the unknown id as a whole. The vocabulary is given, as a table or a public
file; none is learned. Its pieces go into an automaton of characters that is broadcast, and a word's
ids are kept for its next occurrences, up to ``MAX_WORDS`` of them in a task.

Cases: a null or empty text has the start and end ids only; texts are tokenised whole, and
``n_tokens`` counts all pieces also where ``max_length`` cuts the sequence.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from balsam.operators.text import CLS, PAD, SEP, UNK

MAX_WORDS = 500_000
#: Largest vocabulary that is sent to the tasks.
MAX_PIECES = 1_000_000
WORD = re.compile(r"[^\W_]+|[^\w\s]|_")


class Automaton:
    """Longest match over characters. ``pieces``: (text, id, first, last) - whether the piece can begin
    a word, and whether it must end one (None: it may stand anywhere in that respect)."""

    def __init__(self, pieces: list[tuple[str, int, bool, bool | None]]):
        if len(pieces) > MAX_PIECES:
            raise ValueError(f"the vocabulary has {len(pieces)} pieces, more than {MAX_PIECES}")
        self.step: dict[tuple[int, str], int] = {}
        #: of a node, the id by (first, last) of the piece that ends there
        self.ids: list[dict[tuple[bool, bool], int]] = [{}]
        for text, i, first, last in pieces:
            at = 0
            for c in text:
                nxt = self.step.get((at, c))
                if nxt is None:
                    nxt = self.step[at, c] = len(self.ids)
                    self.ids.append({})
                at = nxt
            for end in (False, True) if last is None else (last,):
                self.ids[at][first, end] = i
        self.known: dict[str, list[int]] = {}

    def word(self, w: str) -> list[int]:
        got = self.known.get(w)
        if got is None:
            if len(self.known) >= MAX_WORDS:
                self.known.clear()
            got = self.known[w] = self._match(w)
        return got

    def _match(self, w: str) -> list[int]:
        out, begin = [], 0
        while begin < len(w):
            at, found, j = 0, None, begin
            while j < len(w):
                nxt = self.step.get((at, w[j]))
                if nxt is None:
                    break
                at, j = nxt, j + 1
                i = self.ids[at].get((begin == 0, j == len(w)))
                if i is not None:
                    found = i, j
            if found is None:
                return [UNK]
            out.append(found[0])
            begin = found[1]
        return out

    def text(self, t: str | None) -> list[int]:
        return [i for w in WORD.findall((t or "").lower()) for i in self.word(w)]


def from_table(vocab: DataFrame) -> Automaton:
    """Pieces of a table (piece, token_id): '##x' continues a word, 'x' begins one."""
    rows = vocab.select("piece", "token_id").limit(MAX_PIECES + 1).collect()
    return Automaton([(r["piece"][2:] if r["piece"].startswith("##") else r["piece"], r["token_id"], not r["piece"].startswith("##"), None)
                      for r in rows])


def from_file(path: str, end: str = "</w>", offset: int = 4) -> Automaton:
    """Pieces of a public JSON vocabulary in which ``end`` marks a word's last piece and other pieces
    stand before the end; characters are stored in the byte-level alphabet. ``offset`` keeps the lowest
    ids free for padding, unknown, start and end."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    pieces = []
    for piece, i in vocab.items():
        last = piece.endswith(end)
        data = bytes(byte_of.get(c, 0) for c in (piece[:-len(end)] if last else piece))
        try:
            pieces += [(data.decode("utf-8"), i + offset, first, last) for first in (True, False)]
        except UnicodeDecodeError:
            continue  # a part of a character; words are matched by whole characters
    return Automaton(pieces)


def encode_subwords(df: DataFrame, text_col: str, key: str, automaton: Automaton, max_length: int = 128) -> DataFrame:
    """A row per row: key, input_ids, attention_mask (``max_length`` entries each) and n_tokens."""
    shared = df.sparkSession.sparkContext.broadcast(automaton)
    body = max_length - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared.value.text
        for batch in batches:
            ids = np.full((batch.num_rows, max_length), PAD, np.int32)
            mask = np.zeros((batch.num_rows, max_length), np.int32)
            count = np.zeros(batch.num_rows, np.int64)
            for i, t in enumerate(batch.column(1)):
                got = encode(t.as_py())
                count[i] = len(got)
                row = [CLS, *got[:body], SEP]
                ids[i, :len(row)], mask[i, :len(row)] = row, 1
            at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * max_length)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.ListArray.from_arrays(at, pa.array(m.ravel())) for m in (ids, mask)), pa.array(count)],
                names=["key", "input_ids", "attention_mask", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text_col).mapInArrow(run, f"key {kind}, input_ids array<int>, attention_mask array<int>, n_tokens long") \
        .withColumnRenamed("key", key)
