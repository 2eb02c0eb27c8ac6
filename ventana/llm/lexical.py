"""Ranked lexical search over impact vectors in buckets of their length (operator 13).

Terms are runs of ASCII letters and digits and of all signs outside ASCII, A-Z lower-cased. A document is
the vector of its impacts x = (10^9 tf) div (1000 tf + 8 m), an item the vector of its term
counts, and a term's weight w belongs half to each: the score, the sum of count * w * x, is the inner
product of (count sqrt w) and (x sqrt w). For a block of items

1. the documents are read once: each becomes the counts of the block's terms (and its number of terms);
   document frequencies, N and L are aggregated from these;
2. impact vectors are written in ranges of falling length, every Arrow batch being a **bucket**;
3. the longest vectors come first and give each item a score that its best ``top`` documents reach at
   least; every task of the others starts from there and raises it as it goes down its buckets;
4. a bucket is **pruned** for an item if item length times the bucket's longest length stays below the item's score
   (Cauchy-Schwarz), and inside a bucket a document if the product on the item's focus coordinates (its
   heaviest, ``FOCUS`` of its squared length) plus the product of the remaining lengths stays below;
5. survivors are scored exactly in 64-bit integers, and each task passes on ``top`` documents an item.

Bounds are compared with a margin above all rounding, so that none of the best documents is pruned.

Items are dealt into blocks of about ``QUERY_TERMS`` terms (a block is what workers hold; an item alone makes up a
block of any size), each block against all documents. Copies of equal length are dealt over tasks by a hash.

Defined cases: null and empty texts have no terms and match nothing; documents without an id take part and come
after others of their score; each row of ``items`` is ranked by itself, also where ids repeat or are null; equal rows
of documents are documents of their own; no documents or items, no rows. Ids of documents are whole numbers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, bound_batches, once, quoted, shared

#: (item, term) entries in a block of items.
QUERY_TERMS = 200_000
#: Share of an item's squared length that its focus coordinates hold at least.
FOCUS = 0.8
#: The first 1/HEAD of the documents, by length, give the scores to start from.
HEAD = 32
#: Cells of a (document, item) table that a task holds at once.
CELLS = 2_000_000
#: Above the relative error of a sum of doubles of any length here.
MARGIN = 1e-7


def _is_term_byte(b: int) -> bool:
    return b >= 0x80 or chr(b).isalnum()


#: Separators become spaces, A-Z lower case; all other bytes stay.
FOLD = bytes(ord(chr(b).lower()) if b < 0x80 and _is_term_byte(b) else b if _is_term_byte(b) else 0x20
             for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _texts(batch: pa.RecordBatch, i: int) -> list[bytes]:
    return [t or b"" for t in batch.column(i).cast(pa.binary()).to_pylist()]


def _lists(rows: list, kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.concatenate([np.empty(0, kind), *rows]).astype(kind, copy=False)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def item_terms(items: DataFrame, text_col: str) -> DataFrame:
    """(item, term, n): the terms of each numbered item and how often it holds them."""
    given = items.select("item", F.col(quoted(text_col)).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t, n) for i, text in zip(batch.column(0).to_pylist(), _texts(batch, 1))
                    for t, n in Counter(terms(text)).items()]
            i, t, n = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(t, pa.binary()), pa.array(n, pa.int64())],
                                             names=["item", "term", "n"])

    return given.mapInArrow(count, "item long, term binary, n long")


def term_counts(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term: all its terms, and those of the vocabulary by number."""
    given = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = vocabulary.value
        number = once(state, "number", lambda: {t: i for i, t in enumerate(state["terms"])})
        for batch in batches:
            keep, sizes, ids, freq = [], [], [], []
            for row, text in enumerate(_texts(batch, 1)):
                words = terms(text)
                if words:
                    pairs = sorted((number[t], n) for t, n in Counter(words).items() if t in number)
                    keep.append(row)
                    sizes.append(len(words))
                    ids.append(np.array([t for t, _ in pairs], np.int32))
                    freq.append(np.array([n for _, n in pairs], np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()),
                 _lists(ids, np.int32), _lists(freq, np.int64)], names=["doc_id", "n", "terms", "counts"])

    return given.mapInArrow(count, "doc_id long, n long, terms array<int>, counts array<long>")


def document_frequencies(counted: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary, added up in each task before they are shuffled."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n_terms)[:n_terms]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in counted.select("terms").mapInArrow(add, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def impact_vectors(counted: DataFrame, weights, n_docs: int, n_terms: int) -> DataFrame:
    """(doc_id, length, terms, impacts) of the documents that hold a term of weight above 0."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(weights.value["weights"], np.float64)
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy()).astype(np.int64)
            # Python integers: 75 n N may pass 64 bits before the division
            m = np.array([25 + (75 * n * n_docs) // n_terms for n in batch.column(1).to_pylist()], np.int64)
            t = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            tf = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            x = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, sizes))
            row = np.repeat(np.arange(len(sizes)), sizes)
            square = np.bincount(row, w[t] * x.astype(np.float64) ** 2, minlength=len(sizes))
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.sqrt(square)), batch.column(2),
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(x))],
                names=["doc_id", "length", "terms", "impacts"])
            yield out.filter(pa.array(square > 0))

    return counted.mapInArrow(weigh, "doc_id long, length double, terms array<int>, impacts array<long>")


class Queries:
    """A block's items as vectors, and the best documents met so far."""

    def __init__(self, entries: list[tuple[int, int, int]], weights: list[int], floors: dict[int, int], top: int):
        """``entries`` are (item, term, count), ``floors`` scores that an item's best documents reach."""
        self.top = top
        self.items = np.unique(np.array([e[0] for e in entries], np.int64))
        w = np.array(weights, np.int64)
        q = np.searchsorted(self.items, np.array([e[0] for e in entries], np.int64))
        t = np.array([e[1] for e in entries], np.int64)
        n = np.array([e[2] for e in entries], np.int64)
        order = np.lexsort((t, q))
        self.q, self.t, self.n = q[order], t[order], n[order]
        self.gain = self.n * w[self.t]                                  # exact integers
        self.part = self.n * np.sqrt(w[self.t].astype(np.float64))      # coordinates
        self.root = np.sqrt(w.astype(np.float64))
        size = len(self.items)
        self.starts = np.searchsorted(self.q, np.arange(size + 1))
        self.length = np.sqrt(np.bincount(self.q, self.part ** 2, minlength=size))
        # focus: heaviest coordinates until they hold the share; the rest's length stays for the bound
        order = np.lexsort((-self.part, self.q))
        share = np.cumsum(self.part[order] ** 2)
        before = share - self.part[order] ** 2
        base = np.concatenate([[0.0], share])[self.starts[:-1]]
        focus = np.zeros(len(self.q), bool)
        focus[order] = before - base[self.q[order]] < FOCUS * self.length[self.q[order]] ** 2
        self.rest = np.sqrt(np.maximum(np.bincount(self.q, np.where(focus, 0.0, self.part ** 2), minlength=size), 0))
        at = np.flatnonzero(focus)
        at = at[np.argsort(self.t[at], kind="stable")]
        self.focus_q, self.focus_part = self.q[at], self.part[at]
        self.focus_starts = np.searchsorted(self.t[at], np.arange(len(w) + 1))
        self.n_terms = len(w)
        self.floor = np.array([floors.get(int(i), 0) for i in self.items], np.int64)
        self.best = tuple(np.empty(0, np.int64) for _ in range(4))      # item number, score, id, id is null
        self.asked = self.kept = 0

    def bucket(self, ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, t: np.ndarray,
               x: np.ndarray) -> bool:
        """Meets one bucket; whether any item needed it."""
        limit = self.floor * (1 - MARGIN)
        live = np.flatnonzero(self.length * lengths.max() >= limit)
        if not len(live):
            return False
        d, q = self.candidates(lengths, sizes, t, x, live, limit)
        self.asked += len(lengths) * len(self.items)
        self.kept += len(d)
        score = self.exact(d, q, sizes, t, x)
        good = (score > 0) & (score >= self.floor[q])
        self.keep(q[good], score[good], ids[d[good]], nulls[d[good]])
        return True

    def candidates(self, lengths, sizes, t, x, live, limit):
        """(document, item) pairs whose bound reaches the item's score."""
        n_docs, size = len(sizes), len(self.items)
        row = np.repeat(np.arange(n_docs), sizes)
        many = self.focus_starts[t + 1] - self.focus_starts[t]
        entry = np.repeat(np.arange(len(t)), many)
        at = np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many) + self.focus_starts[t][entry]
        p = x[entry] * self.root[t[entry]]
        cell = row[entry] * size + self.focus_q[at]
        near = np.bincount(cell, p * self.focus_part[at], minlength=n_docs * size).reshape(n_docs, size)
        square = np.bincount(cell, p * p, minlength=n_docs * size).reshape(n_docs, size)
        far = np.sqrt(np.maximum(lengths[:, None] ** 2 * (1 + MARGIN) - square[:, live], 0)) * self.rest[live]
        d, l = np.nonzero(near[:, live] + far >= limit[live])
        return d, live[l]

    def exact(self, d, q, sizes, t, x) -> np.ndarray:
        """Integer scores of the pairs: each item term is looked up in the document's sorted terms."""
        key = np.repeat(np.arange(len(sizes)), sizes) * self.n_terms + t
        score = np.zeros(len(d), np.int64)
        many = self.starts[q + 1] - self.starts[q]
        ends = np.cumsum(many)
        for a, b in _slices(ends, CELLS):
            m = many[a:b]
            pair = np.repeat(np.arange(a, b), m)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(self.starts[q[a:b]], m)
            want = d[pair] * self.n_terms + self.t[at]
            place = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = np.flatnonzero(key[place] == want)
            np.add.at(score, pair[hit], self.gain[at[hit]] * x[place[hit]])
        return score

    def keep(self, q, score, ids, nulls) -> None:
        if not len(q):
            return
        q, score, ids, nulls = (np.concatenate([a, b]) for a, b in zip(self.best, (q, score, ids, nulls.astype(np.int64))))
        order = np.lexsort((ids, nulls, -score, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        chosen = order[place < self.top]
        last = place == self.top - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[order[last]])
        self.best = (q[place < self.top], score[chosen], ids[chosen], nulls[chosen])


def _slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` entries; ``ends`` are cumulative entries."""
    a = 0
    while a < len(ends):
        base = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + most)))
        yield a, b
        a = b


def best_documents(vectors: DataFrame, block) -> DataFrame:
    """(item, score, doc_id): up to ``top`` documents of each item from each task. Rows of a partition come longest first."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = block.value
        found = Queries(s["entries"], s["weights"], s["floors"], s["top"])
        step = max(1, CELLS // max(1, len(found.items)))
        open_ = True
        for batch in batches:
            for a in range(0, batch.num_rows if open_ else 0, step):
                part = batch.slice(a, step)
                if part.num_rows:
                    lists = part.column(2)
                    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                    ids = part.column(0)
                    open_ = found.bucket(ids.fill_null(0).to_numpy(zero_copy_only=False),
                                         ids.is_null().to_numpy(zero_copy_only=False),
                                         part.column(1).to_numpy(), sizes,
                                         lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                                         part.column(3).flatten().to_numpy(zero_copy_only=False))
                    if not open_:
                        break            # all later vectors are shorter
        q, score, ids, nulls = found.best
        yield pa.RecordBatch.from_arrays([pa.array(found.items[q]), pa.array(score), pa.array(ids, mask=nulls.astype(bool))],
                                         names=["item", "score", "doc_id"])

    return vectors.select("doc_id", "length", "terms", "impacts").mapInArrow(search, "item long, score long, doc_id long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, *, top: int = 10, id_col: str = "doc_id", item_col: str = "item_id",
           text_col: str = "text", item_text: str = "text", query_terms: int = QUERY_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    bound_batches(spark)
    asked = Table(items.select(F.monotonically_increasing_id().alias("item"), F.col(quoted(item_col)).alias("item_id"),
                               F.col(quoted(item_text)).alias("text")), "items")
    entries = Table(item_terms(asked.df, "text"), "item-terms")
    blocks = max(1, math.ceil(entries.df.count() / query_terms))
    found: DataFrame | None = None
    for b in range(blocks):
        part = entries.df.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        rows = _search_block(docs, part, top, id_col, text_col)
        found = rows if found is None else found.unionByName(rows)
    return found.join(asked.df.select("item", "item_id"), "item").select(
        F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")


def _search_block(docs: DataFrame, entries: DataFrame, top: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    nothing = spark.createDataFrame([], "item long, score long, doc_id long, rank int")
    block = [(r.item, bytes(r.term), r.n) for r in entries.collect()]          # bounded by query_terms
    words = sorted({t for _, t, _ in block})
    if not words:
        return nothing
    counted = Table(term_counts(docs, shared(spark, {"terms": words}), id_col, text_col), "counts")
    n_docs, n_terms = counted.df.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return nothing
    df = document_frequencies(counted.df, len(words)).tolist()
    # a term that no document holds adds nothing to any score
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) if n else 0 for n in df]
    number = {t: i for i, t in enumerate(words)}
    held = [(i, number[t], n) for i, t, n in block if weights[number[t]] > 0]
    if not held:
        counted.drop()
        return nothing
    vectors = impact_vectors(counted.df, shared(spark, {"weights": weights}), n_docs, n_terms)
    # equal lengths (copies) are dealt over ranges by a hash of their row
    spread = F.xxhash64("doc_id", "terms")
    ranged = Table(vectors.repartitionByRange(F.desc("length"), spread).sortWithinPartitions(F.desc("length")), "impacts")
    counted.drop()
    cut = ranged.df.agg(F.percentile_approx("length", 1 - 1 / HEAD, 1000)).first()[0]
    if cut is None:
        return nothing
    base = {"entries": held, "weights": weights, "top": top}
    head = Table(_ranked(best_documents(ranged.df.filter(F.col("length") >= cut), shared(spark, {**base, "floors": {}})), top),
                 "best")
    floors = {r.item: r.score for r in head.df.filter(F.col("rank") == top).select("item", "score").collect()}
    others = best_documents(ranged.df.filter(F.col("length") < cut), shared(spark, {**base, "floors": floors}))
    best = Table(_ranked(head.df.drop("rank").unionByName(others), top), "best")
    head.drop()
    ranged.drop()
    return best.df


def oracle(top: int = 10) -> str:
    """SQL of the query ``op13_lexical_search``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    cut = "regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')" \
        % (upper, upper.lower())
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {cut} AS terms FROM documents),
n AS (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
df AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
       FROM tf, total GROUP BY term),
items AS MATERIALIZED (SELECT item_id, row_number() OVER () AS i, {cut} AS terms FROM benchmark),
q AS (SELECT i, item_id, term, count(*) AS k FROM (SELECT i, item_id, unnest(terms) AS term FROM items) GROUP BY i, item_id, term),
s AS (SELECT i, item_id, tf.r, n.doc_id,
             CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score
      FROM q JOIN df USING (term) JOIN tf USING (term) JOIN n ON n.r = tf.r, total
      GROUP BY i, item_id, tf.r, n.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= {top}"""
