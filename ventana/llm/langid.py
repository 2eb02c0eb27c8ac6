"""Language identification: words first, shorter and shorter n-grams for unseen words (operator 2).

Each language has the log frequency of its words and of the character n-grams of its words (with
the word's borders). A word that any language knows scores its log frequencies; an unseen word is
scored by its n-grams of the longest length (down from ``ORDER``) of which at least one is known,
as the mean over its n-grams. A text's score per language is the sum over its words; the prediction
is the largest, its score the softmax share. As that share is near 1 whatever the text, ``known`` tells how well the model knows
a text at all: the mean over its words of 1 for a known word, else the length of the n-grams that score it as a share of
``ORDER`` times the share of them that are known. Random letters and other languages stay well below texts of
the learned languages.

``learn`` counts words and n-grams over a hash sample of at most about ``SAMPLE`` labelled rows and
keeps at most the ``WORDS`` most frequent words and ``GRAMS`` most frequent n-grams of each language
(entries of one frequency stay or go together); these bounds are parameters of the model. Prediction reads every word of every text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with no labelled row
every text is ``und``. Ties go to the language first in alphabetical order. Other columns pass
through; output columns replace those of their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, bound_batches, bounded_sample, free, held_out, once, shared, text_or_empty

#: Most labelled rows that learning reads; most words and n-grams kept for a language.
SAMPLE, WORDS, GRAMS = 30_000, 50_000, 50_000
#: Longest n-gram, and words whose scores a worker remembers between batches.
ORDER, MEMO_WORDS = 5, 200_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def lettered(words: list[str]) -> list[str]:
    """The words, or only those with a letter if none is all letters (the pattern also takes signs
    such as superscript digits)."""
    if any(map(str.isalpha, words)):
        return words
    return [w for w in words if any(map(str.isalpha, w))]


def grams(word: str, n: int) -> list[str]:
    w = f"<{word}>"
    return [w[i:i + n] for i in range(max(1, len(w) - n + 1))] if n > 1 else list(word)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally: Counter = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        if tally:
            lang, word = zip(*tally)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()),
                                              pa.array(list(tally.values()), pa.int64())],
                                             names=["lang", "entry", "n"])
            tally.clear()

    for batch in batches:
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            for w, n in Counter(_WORD.findall("\n".join(texts).lower())).items():
                tally[lang, w] += n
        if len(tally) > 300_000:
            yield from out()
    yield from out()


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tally: Counter = Counter()
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            for k in range(1, ORDER + 1):
                for g in grams(word, k):
                    tally[lang, g] += n
        if tally:
            lang, gram = zip(*tally)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(gram, pa.string()),
                                              pa.array(list(tally.values()), pa.int64())],
                                             names=["lang", "entry", "n"])


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample: int = SAMPLE, words: int = WORDS, ngrams: int = GRAMS) -> dict:
    """The model (a plain dict) from labelled documents outside the held-out part."""
    bound_batches(docs.sparkSession)
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    some = bounded_sample(known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
                                       text_or_empty(text_col).alias("text")), "id", sample).select("lang", "text")
    tally = Table(some.mapInArrow(_count, "lang string, entry string, n long")
                  .groupBy("lang", "entry").agg(F.sum("n").alias("n")), "words")
    sums = {r.lang: r.n for r in tally.df.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(sums)
    model: dict = {"langs": langs, "totals": [float(sums[x]) for x in langs]}
    split = Table(tally.df.mapInArrow(_split, "lang string, entry string, n long")
                  .groupBy("lang", "entry").agg(F.sum("n").alias("n")), "grams")
    for name, rows, most in (("words", tally, words), ("grams", split, ngrams)):
        model[name], model[f"{name}_n"] = _most_frequent(rows.df, langs, most)
        rows.drop()
    return model


def _most_frequent(rows: DataFrame, langs: list[str], most: int) -> tuple[list[str], np.ndarray]:
    """Entries (sorted) of the highest frequencies, at most ``most`` a language, and their counts per
    language.

    The least frequency of a language is read off the number of entries per frequency (a few
    thousand numbers), so nothing is sorted and no language is gathered in one task.
    """
    by: dict[str, list[tuple[int, int]]] = {x: [] for x in langs}
    for r in rows.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("k")).collect():
        by[r.lang].append((r.n, r.k))
    least = {}
    for lang, counts in by.items():
        room = most
        least[lang] = 1 + max([n for n, _ in counts], default=0)
        for n, k in sorted(counts, reverse=True):
            if k > room:
                break
            room -= k
            least[lang] = n
    if not langs:
        return [], np.zeros((0, 0), np.int64)
    bar = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(least[lang]))])
    kept = rows.filter(F.col("n") >= bar[F.col("lang")])
    wide = kept.groupBy("entry").agg(*[F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0))
                                       .alias(f"c{i}") for i, x in enumerate(langs)]).toArrow()
    entries = wide.column("entry").to_pylist()
    order = sorted(range(len(entries)), key=entries.__getitem__)
    table = np.stack([wide.column(f"c{i}").to_numpy() for i in range(len(langs))], axis=1).astype(np.int64)
    return [entries[i] for i in order], table[order]


class Scorer:
    """Log scores of words in one worker."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.memo: dict[str, int] = {}          # word -> row of ``table``
        self.table = np.zeros((1024, len(self.langs) + 1))
        words, grams_ = model["words"], model["grams"]
        total = np.array(model["totals"] or [1.0])
        self.word_at = {w: i for i, w in enumerate(words)}
        self.word_log = np.log((model["words_n"] + 0.1) / (total + 0.1 * max(1, len(words))))
        size = np.array([min(len(g), ORDER) for g in grams_], np.int64)
        by_size = np.ones((ORDER + 1, len(self.langs)))
        np.add.at(by_size, size, model["grams_n"])
        self.gram_at = {g: i for i, g in enumerate(grams_)}
        # after the known n-grams, one row per length for the unknown ones
        counts = np.concatenate([model["grams_n"], np.zeros((ORDER + 1, len(self.langs)))])
        size = np.concatenate([size, np.arange(ORDER + 1)])
        self.gram_log = np.log((counts + 0.1) / (by_size[size] + 0.1 * max(1, len(grams_))))

    def word(self, w: str) -> tuple[np.ndarray, float]:
        """Log score per language, and how well the word is known."""
        at = self.word_at.get(w)
        if at is not None:
            return self.word_log[at], 1.0
        get, first = self.gram_at.get, len(self.gram_at)
        for k in range(ORDER, 0, -1):
            rows = [get(g, first + k) for g in grams(w, k)]
            if min(rows) < first:
                return self.gram_log[rows].mean(axis=0), k / ORDER * sum(r < first for r in rows) / len(rows)
        return np.zeros(len(self.langs)), 0.0

    def texts(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, softmax share, and how well the text is known."""
        memo = self.memo
        split = [lettered(_WORD.findall(t.lower())) for t in texts]
        new = {w for s in split for w in s if w not in memo}
        if len(memo) + len(new) > len(self.table):
            more = max(len(new), len(self.table))
            self.table = np.concatenate([self.table, np.zeros((more, len(self.langs) + 1))])
        for w in new:
            memo[w] = at = len(memo)
            self.table[at, :-1], self.table[at, -1] = self.word(w)
        table = self.table
        langs, scores, known = [], np.zeros(len(texts)), np.zeros(len(texts))
        get = memo.__getitem__
        for i, s in enumerate(split):
            if not s or not self.langs:
                langs.append(UNKNOWN)
                continue
            z = table[np.fromiter(map(get, s), np.int64, len(s))].sum(axis=0)
            z, known[i] = z[:-1], z[-1] / len(s)
            best = int(z.argmax())
            langs.append(self.langs[best])
            scores[i] = 1 / np.exp(np.clip(z - z[best], -700, 0)).sum()
        if len(memo) > MEMO_WORDS:
            memo.clear()
        return langs, scores, known


def predict(docs: DataFrame, model: dict, *, text_col: str = "text", out: str = "lang_pred",
            score: str = "score", known: str | None = None) -> DataFrame:
    """``docs`` with the predicted language of each whole text, its score (0 to 1) and, if ``known`` names a column, how well
    the model knows the text (0 to 1)."""
    spark = docs.sparkSession
    bound_batches(spark)
    state = shared(spark, model)

    @F.pandas_udf("lang string, score double, known double")
    def of(texts: pd.Series) -> pd.DataFrame:
        scorer = once(state.value, "scorer", lambda: Scorer(state.value))
        langs, scores, sure = scorer.texts(texts.tolist())
        return pd.DataFrame({"lang": langs, "score": scores, "known": sure})

    mark = free(docs, "_found")
    rows = (docs.withColumn(mark, of(text_or_empty(text_col)))
            .withColumn(out, F.col(f"{mark}.lang")).withColumn(score, F.col(f"{mark}.score")))
    return (rows.withColumn(known, F.col(f"{mark}.known")) if known else rows).drop(mark)
