"""SentencePiece BPE encoding and decoding by a table of prefixes (operator 11).

The library merges, again and again, the adjacent pair whose joined text is the piece of the highest
score (the leftmost among equals). Merges on the two sides of a border that stays never touch each
other, so

* cutting an encoding at a border gives the encodings of the two parts, and
* two encodings side by side are the encoding of the whole text if and only if the two pieces that
  meet at the border are the encoding of their joined text (they are *compatible*).

So every prefix of a word has one last piece: among the pieces that end there (an Aho-Corasick
automaton lists them) the one that encodes to itself and is compatible with the last piece of the
prefix in front of it. The table of these last pieces is filled from left to right, one look at each
match, and the ids are read from its end backwards. Characters that are no piece stand alone, merge
with nothing and become their UTF-8 bytes. Compatibility is tested once a pair by merging the two
pieces' text; workers remember pairs and whole words within bounds, which only saves time.

A text is cut into words where no piece of the vocabulary has such a border inside it (before white
space; after letters, too, if no piece goes on after a letter with something else), which is read from the
vocabulary. Work is linear in the text times the longest piece, also for words of any length.

Models that do more than escape spaces and put one in front (a normaliser, stripped spaces, a unigram
model, user-defined pieces) are refused.

Defined cases: null and empty texts have no ids and decode to the empty string; null ids decode to the empty
string; ids outside the vocabulary are refused; control ids decode to nothing, the unknown id to
its surface, bytes that are not UTF-8 to one U+FFFD each. Other columns pass through under any name; an
output column replaces one of its name.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from itertools import chain
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, map_arrow, once, quoted, shared

#: Words (about 200 bytes each) and pairs of pieces that a worker remembers; others are worked out again.
MEMO_WORDS = 500_000
MEMO_PAIRS = 1_000_000
SPACE = "▁"
#: A character that is no piece, and no piece at all, in the table of prefixes.
UNKNOWN, NOTHING = -1, -2
_LETTER = re.compile(r"[^\W\d_]")
MOST_ODD = 50


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("ventana-each-byte", _each_byte)


class Model:
    """Pieces with their scores, and how texts are cut into words."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.path = path
        self.id: dict[str, int] = {}
        self.spell: list[bytes] = []
        self.leads: list[bool] = []          # whether a leading space of a text is taken off this piece
        self.silent: set[int] = set()
        self.byte = [-1] * 256
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[1:-1], 16)
                self.byte[b] = i
                self.spell.append(bytes([b]))
            elif sp.is_control(i):
                self.silent.add(i)
                self.spell.append(b"")
            elif sp.is_unknown(i):
                self.spell.append(sp.decode([i]).encode())
            else:
                self.id[piece] = i
                self.spell.append(piece.replace(SPACE, " ").encode())
            self.leads.append(piece.startswith(SPACE) and self.id.get(piece) == i)
        self.text = {i: p for p, i in self.id.items()}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        if min(self.byte) < 0 or not set().union(*self.id) <= {p for p in self.id if len(p) == 1}:
            raise ValueError(f"{path}: no byte pieces, or characters of pieces that are no pieces")
        self._refuse_other_models(sp)
        self.word = re.compile(self._pattern())

    def merge(self, text: str) -> list[str]:
        """Exact merging of a short text: the pair of the highest score, the leftmost among equals."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def ids_of(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            if p in self.id:
                out.append(self.id[p])
            else:
                out.extend(self.byte[b] for b in p.encode())
        return out

    def _refuse_other_models(self, sp) -> None:
        pieces = [p for p in self.id if len(p) > 1][::max(1, len(self.id) // 200)]
        probes = [" x  y ﬁ ½\ta ", *(a + b for a, b in zip(pieces, pieces[1:]))]
        for probe in probes:
            if sp.encode(probe) != self.ids_of(self.merge(SPACE + probe.replace(" ", SPACE))):
                raise ValueError(f"{self.path}: not a plain byte-fallback BPE model")

    def _pattern(self) -> str:
        """Words end where no piece of the vocabulary goes on."""
        pairs = {ab for p in self.id for ab in zip(p, p[1:])}
        # signs that the pattern counts as letters, but that pieces join to other signs (a few like "²")
        odd = {a for a, b in pairs if _LETTER.match(a) and b != SPACE and not _LETTER.match(b)}
        odd = "".join(sorted(odd)) if len(odd) <= MOST_ODD else ""
        letter = re.compile(rf"[^\W\d_{odd}]")

        def kind(c: str) -> str:
            return "s" if c == SPACE else "l" if letter.match(c) else "o"
        inside = {kind(a) + kind(b) for a, b in pairs}
        s, letters, others = f"{SPACE}*", letter.pattern + "+", rf"(?:[^{SPACE}\w]|[\d_{odd}])+"
        if inside & {"ls", "os"}:
            return r"(?s:.+)"
        if "lo" in inside:
            return rf"{s}[^{SPACE}]+|{SPACE}+"
        if "ol" in inside:
            return rf"{s}(?:{letters}|{others}{letter.pattern}*)|{SPACE}+"
        return rf"{s}(?:{letters}|{others})|{SPACE}+"


class Encoder:
    """Encodes batches of texts in one worker."""

    def __init__(self, path: str):
        import ahocorasick
        self.model = m = Model(path)
        self.size = len(m.spell)
        self.matches = ahocorasick.Automaton()
        for p, i in m.id.items():
            if m.merge(p) == [p]:            # merging never makes the others as a whole
                self.matches.add_word(p, (i, len(p)))
        self.matches.make_automaton()
        self.alone = {p for p in m.id if len(p) == 1}
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}

    def compatible(self, x: int, y: int) -> bool:
        """Whether the pieces x and y are the encoding of their joined text; anything may follow a text's start or an
        unknown character. Remembered under ``x * size + y``."""
        good = True
        if x >= 0:
            a, b = self.model.text[x], self.model.text[y]
            good = self.model.merge(a + b) == [a, b]
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        self.pairs[x * self.size + y] = good
        return good

    def prefixes(self, word: str) -> tuple[list[int], list[int]]:
        """The last piece of each prefix (by its end) and the piece's length."""
        n, pairs, size_ = len(word), self.pairs, self.size
        last, size = [NOTHING] * (n + 1), [0] * (n + 1)
        if not self.alone.issuperset(word):
            for i, c in enumerate(word):
                if c not in self.alone:      # no piece ends here but the character itself
                    last[i + 1], size[i + 1] = UNKNOWN, 1
        for end, (piece, length) in self.matches.iter(word):
            end += 1
            if last[end] == NOTHING:
                before = last[end - length]
                good = pairs.get(before * size_ + piece)
                if good is None:
                    good = self.compatible(before, piece)
                if good:
                    last[end], size[end] = piece, length
        return last, size

    def word_ids(self, word: str) -> list[int]:
        last, size = self.prefixes(word)
        out: list[int] = []
        at = len(word)
        while at:
            piece = last[at]
            if piece == UNKNOWN:
                out.extend(self.model.byte[b] for b in reversed(word[at - 1].encode()))
            else:
                out.append(piece)
            at -= size[at]
        out.reverse()
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        memo, find = self.memo, self.model.word.findall
        rows = [find(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh = set(chain.from_iterable(rows)).difference(memo)
        for w in fresh:
            ids = self.word_ids(w)
            memo[w] = pack(f"<{len(ids)}i", *ids)
        get = memo.__getitem__
        out = [np.frombuffer(b"".join(map(get, row)), "<i4") for row in rows]
        if len(memo) > MEMO_WORDS:
            for w in list(memo)[MEMO_WORDS // 2:]:     # the words met first are mostly the frequent ones
                del memo[w]
        return out


class Decoder:
    """Texts of rows of ids."""

    def __init__(self, path: str):
        m = Model(path)
        self.spell, self.leads, self.silent = m.spell, m.leads, m.silent

    def decode(self, ids: list[int]) -> str:
        if not ids:
            return ""
        raw = b"".join(map(self.spell.__getitem__, ids))
        first = next((i for i in ids if i not in self.silent), None)
        if first is not None and self.leads[first]:
            raw = raw[1:]                    # the space that encoding put in front
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("utf-8", "ventana-each-byte")


def encode(docs: DataFrame, path: str, *, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text (array<int>); ``path`` names a SentencePiece BPE model."""
    spark = docs.sparkSession
    bound_batches(spark)
    state = shared(spark, {"path": path})
    rest = docs.select([quoted(c) for c in docs.columns if c != out])
    text = docs.select(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias(out),
                       *[quoted(c) for c in docs.columns if c != out])
    schema = T.StructType([*rest.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    names = [f"c{i}" for i in range(len(schema))]

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = once(state.value, "encoder", lambda: Encoder(state.value["path"]))
        for batch in batches:
            rows = enc.encode(batch.column(0).to_pylist())
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            flat = np.concatenate([np.empty(0, "<i4"), *rows]).astype(np.int32, copy=False)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], ids], names=names)

    return map_arrow(text, codes, schema)


def decode(rows: DataFrame, path: str, *, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of each row of ids."""
    spark = rows.sparkSession
    bound_batches(spark)
    state = shared(spark, {"path": path})

    @F.pandas_udf("string")
    def texts(ids: pd.Series) -> pd.Series:
        dec = once(state.value, "decoder", lambda: Decoder(state.value["path"]))
        return pd.Series([dec.decode(row.tolist()) if row is not None else "" for row in ids], dtype=object)

    return rows.withColumn(out, texts(F.col(quoted(ids_col))))
