"""Byte-level BPE encoding and decoding by speculating and verifying (operator 3).

A text is cut at special tokens, then into words by the tokenizer's pattern. For each word that
the worker has not met yet:

* **speculate**: greedy longest match over the vocabulary proposes a row of tokens;
* **verify**: the proposals of a whole batch go through one vectorised test of every adjacent pair
  (``PairTest``). A row of tokens is the encoding of its bytes if and only if each token is its
  own encoding and each pair of neighbours is the encoding of the two tokens' bytes;
* **merge**: only words with a failing pair go through exact merging by rank.

A pair (x, y) is incompatible if, while the merges that build x and y run in order of rank, a
merge across their border comes up at its turn: some token ending x's part and some token
starting y's part, both standing at the border at the same time, form a merge of a lower rank
than the merges that would take either of them away. The test walks down both right and left
spines at once, for all pairs of a batch, with one table look-up a step.

Ids follow the vocabulary file (a ``tokenizers`` JSON of a byte-level BPE without dropout, prefix
space or normaliser; anything else is refused). Words are found by Python's ``re`` where the text
holds only code points that it classes like the library does, otherwise by the library's own
pre-tokenizer.

Defined cases: null and empty texts have no ids and decode to the empty string; ids outside the
vocabulary are refused; bytes that are not UTF-8 after decoding become U+FFFD. Very long words
are matched in linear and merged in n log n time. Other columns pass through; an output column
replaces one of its name.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, map_arrow, once, quoted, shared

#: Words whose codes a worker remembers between batches (about 60 MB); others are encoded again.
MEMO_WORDS = 250_000
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Code points that ``PATTERN`` classes as the library does (fixed ranges, covered by a test).
PLAIN = ("\t-\r -~ -±´-¸»¿-ɏΑ-ΡΣ-Ͽ"
         "Ѐ-ҁҊ-ԯ‐-‧ぁ-ゖァ-ヺ一-龥가-힣")
#: Words of up to so many bytes are merged together, longer ones by a heap.
SHORT = 24
NONE = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte, as letter -> byte."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


class Vocabulary:
    """Tokens as bytes, merges by rank, special tokens, and how each token is built."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        m, pre = j["model"], j.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")
               if m.get(k)] + [k for k in ("byte_fallback", "ignore_merges") if m.get(k)]
        if m["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") \
                or not pre.get("use_regex", True) or j.get("normalizer") or odd:
            raise ValueError(f"{path}: not a plain byte-level BPE {odd}")
        self.path = path
        letter = byte_letters()
        spell = {k: bytes(letter[c] for c in k) for k in m["vocab"]}
        self.ids = {spell[k]: v for k, v in m["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in j["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes: list[bytes | None] = [None] * size
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}    # pair -> (rank, token)
        self.rank = np.full(size, -1, np.int64)       # rank of the merge that makes a token
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        for r, pair in enumerate(m["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y = m["vocab"][a], m["vocab"][b]
            z = m["vocab"][a + b]
            self.merges.setdefault((x, y), (r, z))
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        self.longest = max(map(len, self.ids))
        # tokens that merging never makes as a whole must not be proposed
        self.proposed = {b: i for b, i in self.ids.items() if self.merge(b) == [i]}
        self.reach: dict[bytes, int] = {}
        for b in self.proposed:
            self.reach[b[:2]] = max(self.reach.get(b[:2], 1), len(b))
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(
            self.special, key=len, reverse=True)) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: lowest rank first, leftmost among equals."""
        ids = [self.ids[word[i:i + 1]] for i in range(len(word))]
        n = len(ids)
        if n < 2:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        heap = []
        for i in range(n - 1):
            hit = merges.get((ids[i], ids[i + 1]))
            if hit:
                heap.append((hit[0], i, ids[i], ids[i + 1], hit[1]))
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != x or ids[j] != y:
                continue
            ids[i], ids[j] = z, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                hit = merges.get((z, ids[k]))
                if hit:
                    heapq.heappush(heap, (hit[0], i, z, ids[k], hit[1]))
            h = before[i]
            if h >= 0:
                hit = merges.get((ids[h], z))
                if hit:
                    heapq.heappush(heap, (hit[0], h, ids[h], z, hit[1]))
        return [t for t in ids if t >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        known, reach, out, at, n = self.proposed, self.reach, [], 0, len(word)
        while at < n:
            end = min(n, at + reach.get(word[at:at + 2], 1))
            while end > at + 1 and word[at:end] not in known:
                end -= 1
            out.append(known[word[at:end]])
            at = end
        return out


class PairTest:
    """Vectorised test whether two tokens can stand next to each other."""

    def __init__(self, v: Vocabulary):
        size = len(v.bytes)
        pairs = np.array([(x * size + y, r) for (x, y), (r, _) in v.merges.items()], np.int64)
        pairs = pairs[np.argsort(pairs[:, 0])] if len(pairs) else np.empty((0, 2), np.int64)
        self.size, self.keys, self.ranks = size, pairs[:, 0], pairs[:, 1]
        self.made, self.left, self.right = v.rank, v.left, v.right
        self.made_by = np.full(1 + max([r for r, _ in v.merges.values()], default=0), -1, np.int64)
        for r, z in v.merges.values():
            self.made_by[r] = z

    def rank_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(x), NONE)
        key = x * self.size + y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Each step looks at one pair of tokens that face each other at the border.

        ``xe`` and ``ye`` are the ranks at which the facing tokens are taken into the next larger
        token of their own side (never, at the top). The pair merges across the border if its rank
        comes before both (on the right side also at the same rank: the left of two equal merges
        goes first). Then the side whose token was made last is taken apart: before that moment
        its right (or left) half faced the other token.
        """
        x, y = x.astype(np.int64), y.astype(np.int64)
        good = np.ones(len(x), bool)
        live = np.arange(len(x))
        xe = np.full(len(x), NONE)
        ye = np.full(len(x), NONE)
        while len(live):
            r = self.rank_of(x, y)
            clash = (r != NONE) & (r < xe) & (r <= ye)
            good[live[clash]] = False
            mx, my = self.made[x], self.made[y]
            go = ~clash & ((mx >= 0) | (my >= 0))
            live, x, y, xe, ye, mx, my = (a[go] for a in (live, x, y, xe, ye, mx, my))
            open_x = mx >= my          # equal ranks: the left one is merged first, so undo y first
            tie = (mx == my)
            open_x = open_x & ~tie
            xe, ye = np.where(open_x, mx, xe), np.where(open_x, ye, my)
            x, y = np.where(open_x, self.right[x], x), np.where(open_x, y, self.left[y])
        return good


def merge_short(v: Vocabulary, test: PairTest, words: list[bytes]) -> list[list[int]]:
    """Exact merging of many short words at once: every step merges the lowest pair of each word.

    Rows hold the tokens of a word, then -1; ``rank`` holds the rank of each neighbouring pair.
    """
    n, width = len(words), max(map(len, words))
    sizes = np.fromiter(map(len, words), np.int64, n)
    inside = np.arange(width) < sizes[:, None]
    tokens = np.full((n, width), -1, np.int64)
    of_byte = np.array([v.ids[bytes([b])] for b in range(256)], np.int64)
    tokens[inside] = of_byte[np.frombuffer(b"".join(words), np.uint8)]
    rank = np.full((n, width), NONE)
    pair = inside[:, 1:]
    rank[:, :-1][pair] = test.rank_of(tokens[:, :-1][pair], tokens[:, 1:][pair])
    live, col = np.arange(n), np.arange(width)
    while True:
        at = rank[live].argmin(axis=1)
        low = rank[live, at]
        go = low != NONE
        live, at, low = live[go], at[go], low[go]
        if not len(live):
            break
        shift = np.minimum(col + (col > at[:, None]), width - 1)
        t = np.take_along_axis(tokens[live], shift, axis=1)
        r = np.take_along_axis(rank[live], shift, axis=1)
        sizes[live] -= 1
        i = np.arange(len(live))
        t[i, at] = test.made_by[low]
        t[i, sizes[live]] = -1
        last = sizes[live] - 1
        r[i, last] = NONE
        r[:, -1] = NONE
        has = at < last
        r[i[has], at[has]] = test.rank_of(t[i[has], at[has]], t[i[has], at[has] + 1])
        has = at > 0
        r[i[has], at[has] - 1] = test.rank_of(t[i[has], at[has] - 1], t[i[has], at[has]])
        tokens[live], rank[live] = t, r
    flat = tokens[np.arange(width) < sizes[:, None]].tolist()
    ends = np.cumsum(sizes).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    """Encodes batches of texts in one worker."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.test = PairTest(self.vocab)
        self.word = re.compile(PATTERN)
        self.odd = re.compile(f"[^{PLAIN}]")
        self.memo: dict[str, bytes] = {}
        self.library = None
        self.merged = self.met = 0

    def pieces(self, text: str) -> list[str]:
        if self.odd.search(text) is None:
            return self.word.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer
            self.library = Tokenizer.from_file(self.vocab.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Codes of words (little-endian 32-bit ids)."""
        raw = [w.encode("utf-8") for w in words]
        whole = self.vocab.proposed
        rows = [[whole[b]] if b in whole else self.vocab.propose(b) for b in raw]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter(chain.from_iterable(rows), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(rows)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        both, back = np.unique(flat[inner] * self.test.size + flat[inner + 1], return_inverse=True)
        good = self.test(both // self.test.size, both % self.test.size)
        failing = np.unique(owner[inner[~good[back]]]).tolist()
        short = [i for i in failing if len(raw[i]) <= SHORT]
        for a in range(0, len(short), 4096):
            part = short[a:a + 4096]
            for i, r in zip(part, merge_short(self.vocab, self.test, [raw[i] for i in part])):
                rows[i] = r
        for i in failing:
            if len(raw[i]) > SHORT:
                rows[i] = self.vocab.merge(raw[i])
        self.met += len(words)
        self.merged += len(failing)
        ends = (4 * np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))).tolist()
        codes = np.fromiter(chain.from_iterable(rows), "<u4", ends[-1] // 4 if ends else 0).tobytes()
        return {w: codes[a:b] for w, a, b in zip(words, [0, *ends], ends)}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        vocab, memo = self.vocab, self.memo
        parts: list[list] = []
        for t in texts:
            if vocab.cut is None or not any(s in t for s in vocab.special):
                parts.append(self.pieces(t))
            else:
                row: list = []
                for p in vocab.cut.split(t):
                    row.extend([vocab.special[p]] if p in vocab.special else self.pieces(p) if p else [])
                parts.append(row)
        new = {w for row in parts for w in row if w not in memo}
        special = {w for w in new if isinstance(w, int)}
        fresh = self.learn(list(new - special)) | {w: np.array([w], "<u4").tobytes() for w in special}
        memo.update(fresh)
        get = memo.__getitem__
        out = [np.frombuffer(b"".join(map(get, row)), "<u4") for row in parts]
        for w in list(fresh)[:max(0, len(memo) - MEMO_WORDS)]:
            del memo[w]
        return out


def encode(docs: DataFrame, path: str, *, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text (array<int>).

    A map over Arrow batches rather than a column function: what is made from the ids later would
    otherwise be merged into the same step with a second copy of the encoding.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    state = shared(spark, {"path": path})
    rest = docs.select([quoted(c) for c in docs.columns if c != out])
    schema = T.StructType([*rest.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    at = rest.columns.index(text_col)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = once(state.value, "encoder", lambda: Encoder(state.value["path"]))
        for batch in batches:
            rows = enc.encode([t or "" for t in batch.column(at).to_pylist()])
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            flat = np.concatenate([np.empty(0, "<u4"), *rows]).view(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, f"c{batch.num_columns}"])

    return map_arrow(rest, codes, schema)


def decode(rows: DataFrame, path: str, *, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of each row of ids; special tokens are written out."""
    spark = rows.sparkSession
    bound_batches(spark)
    state = shared(spark, {"path": path})

    @F.pandas_udf("string")
    def texts(ids: pd.Series) -> pd.Series:
        spell = once(state.value, "bytes", lambda: Vocabulary(state.value["path"]).bytes)
        return pd.Series([b"".join(map(spell.__getitem__, row.tolist())).decode("utf-8", "replace")
                          if row is not None and len(row) else "" for row in ids], dtype=object)

    return rows.withColumn(out, texts(ids_col))
