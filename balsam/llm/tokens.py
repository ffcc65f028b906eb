"""Token counts by a trie-shared dynamic programme.

A text falls into pre-tokens (letters, digits, other signs or white space, with one leading
space). The count of a pre-token is that of its best segmentation under a unigram model over the
byte pieces of a public vocabulary; the log-probability of a piece follows Zipf's law from its
rank in the file. Every task inserts the distinct pre-tokens it meets into a trie: a node holds
the best forward score of its prefix and the number of pieces on the best path, computed once for
all pre-tokens that share the prefix, and the count at the node where a pre-token ends is kept for
its next occurrences. Pieces that end at a node are found by walking up the trie and down a trie of
reversed pieces. No row is shuffled.

The trie is dropped and begun anew beyond ``MAX_NODES`` nodes, and pre-tokens of more than ``LONG``
bytes are scored outside it, with a window of the longest piece; neither changes a count.

Cases: a null or empty text has 0 pre-tokens and 0 tokens; repeated rows are counted each; other
columns are never read.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_NODES = 500_000
LONG = 256
#: Largest vocabulary that is sent to the tasks.
MAX_PIECES = 1_000_000
PRETOKEN = re.compile(r" ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_vocabulary(path: str) -> dict[bytes, float]:
    """Piece -> log-probability, from lines of a base64 piece and its rank. All single bytes are
    pieces, so that everything can be segmented."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if len(ranks) > MAX_PIECES:
        raise ValueError(f"the vocabulary has {len(ranks)} pieces, more than {MAX_PIECES}")
    n = max(ranks.values(), default=0) + 257
    norm = math.log(sum(1 / r for r in range(1, n + 1)))
    scores = {p: -math.log(r + 1) - norm for p, r in ranks.items()}
    for b in range(256):
        scores.setdefault(bytes([b]), -math.log(n) - norm)
    return scores


class Trie:
    """Prefixes of pre-tokens with their best forward scores."""

    def __init__(self, scores: dict[bytes, float]):
        # reversed pieces: (node, byte) -> node, and the score of a piece that ends there
        self.back: dict[int, int] = {}
        self.piece: list[float | None] = [None]
        for p, s in scores.items():
            v = 0
            for b in reversed(p):
                nxt = self.back.get(v << 8 | b)
                if nxt is None:
                    nxt = self.back[v << 8 | b] = len(self.piece)
                    self.piece.append(None)
                v = nxt
            self.piece[v] = s
        self.longest = max(map(len, scores))
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.parent, self.byte, self.best, self.pieces = [0], [0], [0.0], [0]
        self.known: dict[str, int] = {}

    def _grow(self, at: int, b: int) -> int:
        new = self.child[at << 8 | b] = len(self.parent)
        self.parent.append(at)
        self.byte.append(b)
        back, piece, parent, byte, best, pieces = self.back, self.piece, self.parent, self.byte, self.best, self.pieces
        top, few, v, m = -math.inf, 0, 0, new
        while m:
            v = back.get(v << 8 | byte[m])
            if v is None:
                break
            m = parent[m]
            s = piece[v]
            if s is not None and (best[m] + s > top or best[m] + s == top and pieces[m] + 1 < few):
                top, few = best[m] + s, pieces[m] + 1
        best.append(top)
        pieces.append(few)
        return new

    def count(self, token: str) -> int:
        """Pieces of the best segmentation; of equal scores that with fewer pieces counts."""
        data = token.encode("utf-8", "surrogatepass")
        if len(data) > LONG:
            return self._outside(data)
        if len(self.parent) > MAX_NODES:
            self.clear()
        at, child = 0, self.child
        for b in data:
            nxt = child.get(at << 8 | b)
            at = self._grow(at, b) if nxt is None else nxt
        n = self.known[token] = self.pieces[at]
        return n

    def _outside(self, data: bytes) -> int:
        keep = self.longest + 1
        best, pieces = [0.0] * keep, [0] * keep
        for i in range(1, len(data) + 1):
            top, few, v = -math.inf, 0, 0
            for j in range(i - 1, max(-1, i - keep), -1):
                v = self.back.get(v << 8 | data[j])
                if v is None:
                    break
                s = self.piece[v]
                if s is not None:
                    x, n = best[j % keep] + s, pieces[j % keep] + 1
                    if x > top or x == top and n < few:
                        top, few = x, n
            best[i % keep], pieces[i % keep] = top, few
        return pieces[len(data) % keep]

    def counts(self, text: str | None) -> tuple[int, int]:
        """(pre-tokens, tokens) of a text."""
        tokens = PRETOKEN.findall(text or "")
        known, total = self.known, 0
        get = known.get
        for t in tokens:
            n = get(t)
            total += self.count(t) if n is None else n
            if known is not self.known:  # begun anew
                known = self.known
                get = known.get
        return len(tokens), total


def count_tokens(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """A row per row: key, n_pretokens, n_tokens. ``vocabulary`` is the path of a file that the
    driver reads; its pieces are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary or default_vocabulary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for batch in batches:
            found = [trie.counts(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a for a, _ in found], pa.int64()),
                 pa.array([b for _, b in found], pa.int64())], names=["key", "n_pretokens", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_col).mapInArrow(run, f"key {kind}, n_pretokens long, n_tokens long") \
        .withColumnRenamed("key", key)
