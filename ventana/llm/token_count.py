"""Word-piece token counts by a linear longest-match automaton (operator 6).

Greedy longest match takes, from the start of a word, the longest piece that begins words, then
again and again the longest piece that continues them. The automaton finds the number of these
pieces in one pass over the word's bytes: a trie of the beginning pieces and one of the continuing
pieces, and for every node a failure link to the node reached after popping the pieces that are
then settled, with the number of those pieces. Each byte is read once; a failed step adds the
popped number and follows the link. The pieces themselves are never built. A word that cannot be
cut into pieces counts as one unknown token.

``pieces_of`` takes the pieces from a byte-level vocabulary file: tokens written with a leading
space begin words, all others continue them, and single bytes do both, so no word is unknown. Any
other two sets of pieces can be given instead.

Words are runs of characters other than Unicode white space. Defined cases: a null or empty text
has 0 tokens; a word of any length takes time in proportion to it. Other columns pass through;
output columns replace those of their names.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import bound_batches, free, once, shared, text_or_empty

#: Words whose counts a worker remembers between batches.
MEMO_WORDS = 400_000
#: Count of a word that cannot be cut.
UNKNOWN = -1


def pieces_of(path: str) -> tuple[list[bytes], list[bytes]]:
    """(beginning, continuing) pieces of a byte-level vocabulary file."""
    letter = byte_letters()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    spelled = [bytes(letter[c] for c in k) for k in vocab]
    single = {bytes([b]) for b in range(256)}
    begin = {p[1:] for p in spelled if p[:1] == b" " and len(p) > 1} | single
    inside = {p for p in spelled if p[:1] != b" "} | single
    return sorted(begin), sorted(inside)


class Automaton:
    """Trie with failure links and popped counts. Node 0 starts words, node 1 continues them."""

    def __init__(self, begin: list[bytes], inside: list[bytes]):
        step: dict[int, int] = {}          # node * 256 + byte -> node
        parent: list[int] = [-1, -1]
        by: list[int] = [-1, -1]
        final: list[bool] = [False, False]
        for root, pieces in ((0, begin), (1, inside)):
            for p in pieces:
                at = root
                for b in p:
                    nxt = step.get(at << 8 | b)
                    if nxt is None:
                        nxt = len(parent)
                        step[at << 8 | b] = nxt
                        parent.append(at)
                        by.append(b)
                        final.append(False)
                    at = nxt
                if at != root:
                    final[at] = True
        n = len(parent)
        depth = [0] * n
        for v in range(2, n):
            depth[v] = depth[parent[v]] + 1
        fail, popped = [-1] * n, [0] * n
        for v in sorted(range(2, n), key=depth.__getitem__):
            if final[v]:
                fail[v], popped[v] = 1, 1
                continue
            u = parent[v]
            z, count = fail[u], popped[u]
            while z != -1 and (z << 8 | by[v]) not in step:
                count += popped[z]
                z = fail[z]
            if z != -1:
                fail[v], popped[v] = step[z << 8 | by[v]], count
        self.step, self.fail, self.popped = step, fail, popped

    def count(self, word: bytes) -> int:
        """Number of greedy pieces of a word, or ``UNKNOWN``."""
        step, fail, popped = self.step, self.fail, self.popped
        at, n = 0, 0
        for b in word:
            nxt = step.get(at << 8 | b)
            while nxt is None:
                if fail[at] == -1:
                    return UNKNOWN
                n += popped[at]
                at = fail[at]
                nxt = step.get(at << 8 | b)
            at = nxt
        while at != 1:
            if fail[at] == -1:
                return UNKNOWN if word else 0
            n += popped[at]
            at = fail[at]
        return n


class Counter:
    """Counts of texts in one worker."""

    def __init__(self, begin: list[bytes], inside: list[bytes]):
        self.automaton = Automaton(begin, inside)
        self.memo: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[int, int, int]:
        """(tokens, words, unknown words) of a text."""
        words = text.split()
        memo, count = self.memo, self.automaton.count
        for w in set(words):
            if w not in memo:
                memo[w] = count(w.encode("utf-8"))
        each = list(map(memo.__getitem__, words))
        unknown = each.count(UNKNOWN)
        if len(memo) > MEMO_WORDS:
            memo.clear()
        return sum(each) + 2 * unknown, len(words), unknown


def token_counts(docs: DataFrame, path: str | None = None, *, pieces: tuple | None = None,
                 text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_words and n_unknown of each whole text."""
    spark = docs.sparkSession
    bound_batches(spark)
    state = shared(spark, {"path": path, "pieces": pieces})

    def build() -> Counter:
        given = state.value["pieces"]
        return Counter(*(given if given is not None else pieces_of(state.value["path"])))

    @F.pandas_udf("n_tokens long, n_words long, n_unknown long")
    def count(texts: pd.Series) -> pd.DataFrame:
        counter = once(state.value, "counter", build)
        rows = np.array([counter(t) for t in texts], np.int64).reshape(-1, 3)
        return pd.DataFrame(rows, columns=["n_tokens", "n_words", "n_unknown"])

    mark = free(docs, "_found")
    rows = docs.withColumn(mark, count(text_or_empty(text_col)))
    for name in ("n_tokens", "n_words", "n_unknown"):
        rows = rows.withColumn(name, F.col(f"{mark}.{name}"))
    return rows.drop(mark)
