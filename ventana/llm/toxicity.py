"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton (operator 1).

A text is folded (lower case, homoglyphs of other scripts and full-width forms to Latin letters,
invisible characters dropped, digits and signs that stand for letters inside a word replaced,
every other non-letter a space) and scanned once by one automaton that holds

* **stems** with weights: a stem matches at the start of a word; the longest stem of a word counts;
* **words** with weights: a whole word;
* **exception phrases**: words inside a matched phrase do not count.

An entry that matches k times adds its weight 1 + ln k times.

The sum of the matched weights is normalised by the length of the text (words), and a logistic
curve over (weight, weight per hundred words), neither of which may lower it, gives a score of 0 to 1.

``learn`` builds lexicon and curve from labelled texts: stems and words are those far more frequent
among toxic than other documents (smoothed log ratio of document frequencies). Of stems that only
extend one another the longest with about the same support stays, then the shortest of the pure
ones. Entries are then taken in order of the toxic documents they explain, until every toxic
document of the sample has ``COVER`` of them or what is left explains too few; this leaves out the
ordinary words of toxic texts that exist in many near copies. Learning reads a hash sample of at most about ``SAMPLE`` labelled rows; the lexicon keeps at
most ``LEXICON`` entries. Both bounds are parameters of the model, not of the data that is scored:
every row is scored over its whole text.

Defined cases: a null text counts as empty; an empty text gets the score of no match; a null or
unlabelled row is not learned from; several labels of one id count as toxic if one is; without
any labelled row of either kind the lexicon is empty and scores are the toxic share (0 without
rows). Other columns pass through; output columns replace those of their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, bounded_sample, free, held_out, once, shared, text_or_empty

#: Most labelled rows that learning reads, and most entries of a learned lexicon.
SAMPLE, LEXICON = 60_000, 5_000
#: Least documents of an entry, least log ratio, and prefix lengths that are considered.
SUPPORT, RATIO, STEMS = 4, 3.0, (3, 12)
#: Entries that explain a toxic document, and the least share of toxic documents an entry adds.
COVER, ADDS = 3, 0.0025
#: Fixed phrases in which a lexicon word is not an insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "pond scum",
              "idiot proof", "idiot savant", "sore loser award")
#: Fixed look-alikes, written as runs of letters and what they stand for.
LOOKALIKES = ("аɑαа", "a"), ("вΒβЬ", "b"), ("сϲс", "c"), ("ԁ", "d"), ("еҽεе", "e"), ("ɡ", "g"), \
    ("һн", "h"), ("іιɩӏ", "i"), ("јϳ", "j"), ("кκ", "k"), ("ⅼ", "l"), ("мϻ", "m"), ("пη", "n"), \
    ("оοσӧ", "o"), ("рρ", "p"), ("ԛ", "q"), ("г", "r"), ("ѕ", "s"), ("тτ", "t"), ("υս", "u"), \
    ("ѵν", "v"), ("ѡω", "w"), ("хχ", "x"), ("уγү", "y"), ("ᴢ", "z")
#: Digits and signs that stand for letters inside a word.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i",
         "|": "i"}
_SIGN_RUN = re.compile(r"(?<![0-9])[013457 8@$!|]".replace(" ", "") + r"+(?=[^\W\d_])")
_HIDDEN = "­​‌‍⁠﻿"


class _Fold(dict):
    """Translation table that decides each code point once."""

    def __init__(self):
        super().__init__({ord(c): to for run, to in LOOKALIKES for c in run})
        self.update(dict.fromkeys(map(ord, _HIDDEN)))

    def __missing__(self, code: int):
        c = chr(code)
        wide = unicodedata.normalize("NFKC", c)
        c = wide if 0x1D400 <= code <= 0x1D7FF or 0xFF01 <= code <= 0xFF5E or 0x2460 <= code <= 0x24FF else c
        low = c.lower()
        to = "".join(x if x.isalpha() or unicodedata.category(x) == "Mn" else " " for x in low) or " "
        if len(to) == 1 and ord(to) != code and ord(to) in self:
            to = self[ord(to)]
        self[code] = to
        return to


_FOLD = _Fold()


def fold(text: str) -> str:
    """The text as words of lower-case letters with one space before and after each run."""
    low = unicodedata.normalize("NFC", text) if not text.isascii() else text
    low = _SIGN_RUN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), low)
    return f" {low.translate(_FOLD)} "


@dataclass
class Model:
    stems: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-6.0, 3.0, 1.0)    # bias, weight, density

    def settings(self) -> dict:
        return {"stems": dict(self.stems), "words": dict(self.words),
                "exceptions": tuple(self.exceptions), "curve": tuple(self.curve)}


class Matcher:
    """The automaton of one worker."""

    def __init__(self, settings: dict):
        import ahocorasick

        self.any = ahocorasick.Automaton()
        for w, x in settings["words"].items():
            self._add(f" {w} ", (0, x))
        for w, x in settings["stems"].items():
            self._add(f" {w}", (0, x))
        for p in settings["exceptions"]:
            self._add(f" {' '.join(p.split())} ", (1, 0.0))
        self.empty = not len(self.any)
        if not self.empty:
            self.any.make_automaton()
        self.curve = settings["curve"]

    def _add(self, key: str, value: tuple) -> None:
        self.any.add_word(key, (*value, len(key)))

    def __call__(self, text: str) -> tuple[int, float, int]:
        """(matches, their weight, words) of a text."""
        folded = fold(text)
        n = len(folded.split())
        if self.empty:
            return 0, 0.0, n
        hits: dict[int, tuple[int, float]] = {}
        spans = []
        for end, (kind, weight, size) in self.any.iter(folded):
            start = end - size + 1
            if kind:
                spans.append((start, end))
            elif start not in hits or hits[start][0] < size:
                hits[start] = (size, weight)
        if spans:
            hits = {s: h for s, h in hits.items()
                    if not any(a <= s and s + h[0] - 1 <= b for a, b in spans)}
        by: dict[str, tuple[int, float]] = {}
        for s, (size, weight) in hits.items():
            key = folded[s:s + size]
            by[key] = (by.get(key, (0, 0))[0] + 1, weight)
        return len(hits), sum(w * (1 + math.log(k)) for k, w in by.values()), n

    def entries(self, text: str) -> list[str]:
        """The lexicon entries found in a text, each once."""
        folded = fold(text)
        return sorted({folded[end - size + 1:end + 1].lstrip() for end, (kind, _, size)
                       in self.any.iter(folded) if not kind}) if not self.empty else []


def features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Columns: 1, weight, weight by length (log scales)."""
    per = weight / np.maximum(words, 1) * 100
    return np.stack([np.ones(len(weight)), np.log1p(np.maximum(weight, 0)),
                     np.log1p(np.maximum(per, 0))], axis=1)


def _match_udf(spark: SparkSession, model: Model):
    state = shared(spark, model.settings())

    @F.pandas_udf("matches long, weight double, words long, score double")
    def match(texts: pd.Series) -> pd.DataFrame:
        matcher = once(state.value, "matcher", lambda: Matcher(state.value))
        rows = np.array([matcher(t) for t in texts], float).reshape(-1, 3)
        z = features(rows[:, 1], rows[:, 2]) @ np.array(matcher.curve)
        return pd.DataFrame({"matches": rows[:, 0].astype(np.int64), "weight": rows[:, 1],
                             "words": rows[:, 2].astype(np.int64), "score": 1 / (1 + np.exp(-z))})

    return match


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out: str = "score",
          details: bool = False) -> DataFrame:
    """``docs`` with the score of each whole text (and the matches, weight and words behind it)."""
    bound_batches(docs.sparkSession)
    found = _match_udf(docs.sparkSession, model)(text_or_empty(text_col))
    mark = free(docs, "_found")
    rows = docs.withColumn(mark, found)
    for name in ("matches", "weight", "words") if details else ():
        rows = rows.withColumn(name, F.col(f"{mark}.{name}"))
    return rows.withColumn(out, F.col(f"{mark}.score")).drop(mark)


def labelled(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(text, y) of the labelled documents outside the held-out part, a bounded sample.

    The ids of the sample are at most about ``sample``, whatever the size of the tables; the texts
    are therefore not shuffled.
    """
    marks = (labels.filter(F.col(label_col).isNotNull() & ~held_out(id_col))
             .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y")))
    some = bounded_sample(marks, "id", sample)
    return (docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
            .join(F.broadcast(some), "id").select("text", "y"))


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally: tuple[Counter, Counter] = (Counter(), Counter())
    low, high = STEMS
    schema = ["feature", "y", "n"]

    def out() -> Iterator[pa.RecordBatch]:
        for y in (0, 1):
            if tally[y]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(tally[y]), pa.string()), pa.array([y] * len(tally[y]), pa.int32()),
                     pa.array(list(tally[y].values()), pa.int64())], names=schema)
                tally[y].clear()

    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen = set()
            for w in set(fold(text).split()):
                top = min(high, len(w))
                seen.update([w[:k] for k in range(low, top + 1)])
                if len(w) <= high:
                    seen.add(w + "$")
            seen.add("")
            tally[1 if y else 0].update(seen)
        if len(tally[0]) + len(tally[1]) > 400_000:
            yield from out()
    yield from out()


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample: int = SAMPLE, lexicon: int = LEXICON,
          exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Lexicon and curve from the labelled documents outside the held-out part."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = labelled(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample=sample)
    counts = (rows.mapInArrow(_count_features, "feature string, y int, n long")
              .groupBy("feature").agg(F.sum(F.col("n") * F.col("y")).alias("t"),
                                      F.sum(F.col("n") * (1 - F.col("y"))).alias("c")))
    # the candidates are few: support and ratio are tested before anything reaches the driver
    base = F.lit(SUPPORT)
    kept = (counts.filter((F.col("t") >= base) & ((F.col("feature") == "") | (F.col("t") * 2 > F.col("c"))))
            .orderBy(F.desc("t"), "feature").limit(40 * lexicon).collect())
    tally = {r.feature: (r.t, r.c) for r in kept}
    toxic, clean = tally.pop("", (0, None))
    if clean is None:
        totals = rows.agg(F.sum("y"), F.count("y")).first()
        toxic, clean = totals[0] or 0, (totals[1] or 0) - (totals[0] or 0)
    if not toxic or not clean:
        total = toxic + clean
        share = toxic / total if total else 0.0
        return Model({}, {}, exceptions, (_logit(share), 0.0, 0.0))
    weight = {f: math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
              for f, (t, c) in tally.items()}
    stems, words = choose(tally, weight)
    model = Model(stems, words, exceptions)
    model = explain(rows.filter("y = 1"), model, toxic, lexicon)
    model.curve = fit_curve(rows, model)
    return model


def explain(rows: DataFrame, model: Model, toxic: int, lexicon: int) -> Model:
    """Only the entries needed to explain the toxic documents of the (bounded) sample."""
    state = shared(rows.sparkSession, model.settings())

    @F.pandas_udf("array<string>")
    def entries(texts: pd.Series) -> pd.Series:
        matcher = once(state.value, "matcher", lambda: Matcher(state.value))
        return pd.Series([matcher.entries(t) for t in texts], dtype=object)

    sets = [(r.e, r.n) for r in rows.select(entries("text").alias("e")).groupBy("e")
            .agg(F.count(F.lit(1)).alias("n")).collect()]
    where: dict[str, list[int]] = {}
    for i, (e, _) in enumerate(sets):
        for x in e:
            where.setdefault(x, []).append(i)
    lacks = [COVER] * len(sets)
    gain = {x: sum(sets[i][1] for i in at) for x, at in where.items()}
    least = max(SUPPORT - 1, ADDS * toxic)
    chosen: set[str] = set()
    while gain and len(chosen) < lexicon:
        best = max(gain, key=lambda x: (gain[x], x))
        if gain.pop(best) < least:
            break
        chosen.add(best)
        for i in where[best]:
            lacks[i] -= 1
            if lacks[i] == 0:
                for x in sets[i][0]:
                    if x in gain:
                        gain[x] -= sets[i][1]
    return Model({k: x for k, x in model.stems.items() if k in chosen},
                 {k: x for k, x in model.words.items() if k + " " in chosen}, model.exceptions)


def choose(tally: dict[str, tuple[int, int]], weight: dict[str, float]) -> tuple[dict, dict]:
    """Stems and whole words of the lexicon from document counts (toxic, other) per feature."""
    pure = {f for f, x in weight.items() if x >= RATIO}
    stems: dict[str, float] = {}
    for f in sorted((f for f in pure if not f.endswith("$")), key=lambda f: (len(f), f)):
        if any(f[:k] in stems for k in range(STEMS[0], len(f))):
            continue
        stems[f] = weight[f]
    grown: dict[str, float] = {}
    children: dict[str, list[str]] = {}
    for g in tally:
        if g in pure and not g.endswith("$"):
            children.setdefault(g[:-1], []).append(g)
    for f in stems:
        # the longest form that nearly all documents of the stem have, so that "tra" becomes "trash"
        while True:
            longer = next((g for g in children.get(f, ()) if tally[g][0] >= 0.9 * tally[f][0]), None)
            if longer is None:
                break
            f = longer
        grown[f] = weight[f]
    words = {f[:-1]: weight[f] for f in pure if f.endswith("$")
             and not any(f[:k] in grown for k in range(1, len(f)))}
    return grown, words


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def fit_curve(rows: DataFrame, model: Model) -> tuple[float, float, float]:
    """Logistic regression on counts over a grid of the features (a few thousand cells at most)."""
    found = _match_udf(rows.sparkSession, model)(F.col("text"))
    weight = F.greatest("f.weight", F.lit(0.0))
    per = weight / F.greatest("f.words", F.lit(1)) * 100
    cell = rows.select("y", found.alias("f")).select(
        "y", F.round(F.log1p(weight) * 8).alias("w"), F.round(F.log1p(per) * 8).alias("d"))
    g = np.array([[r.w, r.d, r.y, r.k] for r in cell.groupBy("w", "d", "y")
                  .agg(F.count(F.lit(1)).alias("k")).collect()], float).reshape(-1, 4)
    x = np.stack([np.ones(len(g)), g[:, 0] / 8, g[:, 1] / 8], axis=1)
    use = [0, 1, 2]
    while True:
        b = _newton(x[:, use], g[:, 2], g[:, 3])
        worst = min(range(1, len(use)), key=lambda i: b[i], default=0)
        if worst == 0 or b[worst] >= 0:
            break
        use.pop(worst)
    out = np.zeros(3)
    out[use] = b
    return tuple(float(v) for v in out)


def _newton(x: np.ndarray, y: np.ndarray, k: np.ndarray) -> np.ndarray:
    b = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[0.05] * (x.shape[1] - 1)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (k * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (k * (y - p)) - ridge @ b)
        size = np.abs(step).max()
        b = b + step * min(1.0, 4.0 / size) if size else b
        if size < 1e-8:
            break
    return b
