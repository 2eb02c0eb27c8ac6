"""Document fingerprints by SimHash, and search within a Hamming radius (operator 4).

**Fingerprint**: the terms of a text are its runs of two words (lower case; a single word is its
own term). Each term votes with its weight, (1 + ln frequency) * letters of the term, for the bits
set in its XXH64 hash and against the others; a bit is 1 if its votes are positive. The likeness of
two fingerprints is the share of equal bits.

**Search**: 64 bits are cut into ``radius + spare`` blocks; two fingerprints within the radius
agree in at least ``spare`` blocks. One permuted table per choice of ``spare`` blocks lists every
distinct fingerprint under those blocks' bits; a query is looked up in each table and what meets
is checked bit by bit. Both sides hold distinct fingerprints with counts, so exact copies cost
nothing. With 5 blocks at radius 3 there are 10 tables with keys of 25 bits or more.

**Edited texts** (``with_next``): the last half of each text replaced by the start of the next
document in order of ids. Documents are dealt into blocks of neighbouring ids; only the first
document of a block is sent twice, to follow the last one of the block before. Every block is
streamed in order, so any number of documents may fall into one.

Defined cases: a null text counts as empty; a text without words has fingerprint 0; documents of
equal id follow one another in order of their texts; a null id comes before all others; a single
document is followed by itself. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, hamming, text_or_empty

#: Terms whose bits vote at once.
CHUNK = 1 << 15
BITS = 64
#: Blocks of neighbouring ids at most; each is streamed, so its size is not bounded by memory.
MOST_BLOCKS = 16_384


def fingerprint(text: str) -> int:
    """Signed 64-bit SimHash of a text."""
    words = text.lower().split()
    if not words:
        return 0
    terms = Counter(map(" ".join, zip(words, words[1:])) if len(words) > 1 else words)
    digest, log = xxhash.xxh64_intdigest, math.log
    hashes = np.fromiter((digest(t) for t in terms), np.uint64, len(terms))
    weights = np.fromiter(((1 + log(n)) * len(t) for t, n in terms.items()), np.float64, len(terms))
    votes = np.zeros(BITS)
    for i in range(0, len(terms), CHUNK):
        bits = np.unpackbits(hashes[i:i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += weights[i:i + CHUNK] @ bits
    mark = np.packbits(2 * votes > weights.sum()).tobytes()
    return int.from_bytes(mark, "big", signed=True)


def fingerprints(docs: DataFrame, *, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint (signed 64-bit number) of each whole text."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return docs.withColumn(out, of(text_or_empty(text_col)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1 - hamming(a, b) / BITS


def edited_text(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
              blocks: int | None = None) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint) of each
    document, the next one being that of the next id (after the last: the first)."""
    spark = docs.sparkSession
    bound_batches(spark)
    blocks = blocks or min(MOST_BLOCKS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    id_type = own.schema["id"].dataType.simpleString()
    # block borders: at most ``blocks`` numbers
    cuts = sorted(set(own.select(F.col("id").cast("double").alias("id")).stat.approxQuantile(
        "id", [i / blocks for i in range(1, blocks)], 0.2 / blocks))) if blocks > 1 else []
    edges = F.array(*[F.lit(x) for x in cuts]) if cuts else None
    block = F.size(F.filter(edges, lambda e: F.col("id").cast("double") >= e)) if cuts else F.lit(0)
    dealt = own.withColumn("block", F.when(F.col("id").isNull(), 0).otherwise(block))
    firsts = sorted((r.block, r.none, r.id) for r in dealt.groupBy("block").agg(
        F.min("id").alias("id"), F.max(F.col("id").isNull()).alias("none")).collect())
    if not firsts:
        return spark.createDataFrame([], f"id {id_type}, n_chars long, edited_sha256 string, fingerprint long, "
                                         "edited_fingerprint long, next_fingerprint long") \
            .withColumnRenamed("id", id_col)
    # the first document of each block also goes to the end of the block before (at most ``blocks``)
    to = [(b, None if none else i, firsts[k - 1][0]) for k, (b, none, i) in enumerate(firsts)]
    heads = spark.createDataFrame(to, f"block int, first {id_type}, goes int")
    lead = Window.partitionBy("block").orderBy("text")
    copies = (dealt.join(F.broadcast(heads), "block").filter(F.col("id").eqNullSafe(F.col("first")))
              .withColumn("k", F.row_number().over(lead)).filter("k = 1")
              .select("id", "text", F.col("goes").alias("block"), F.lit(1).alias("tail")))
    rows = (dealt.select("id", "text", "block", F.lit(0).alias("tail")).unionByName(copies)
            .repartition(blocks, "block").sortWithinPartitions("block", "tail", "id", "text"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                 # (id, text, fingerprint, block) of the row before
        for batch in batches:
            out: list[tuple] = []
            for i, text, b, tail in zip(*(batch.column(k).to_pylist() for k in range(4))):
                mark = fingerprint(text)
                if held is not None and held[3] == b:
                    edit = edited_text(held[1], text)
                    out.append((held[0], len(held[1]), hashlib.sha256(edit.encode()).hexdigest(), held[2],
                                fingerprint(edit), mark))
                held = None if tail else (i, text, mark, b)
            cols = list(zip(*out)) if out else [()] * 6
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["id", "n_chars", "edited_sha256", "fingerprint",
                                                    "edited_fingerprint", "next_fingerprint"])

    return rows.mapInArrow(follow, f"id {id_type}, n_chars long, edited_sha256 string, fingerprint long, "
                                   "edited_fingerprint long, next_fingerprint long") \
        .withColumnRenamed("id", id_col)


def block_tables(radius: int, spare: int) -> list[list[tuple[int, int]]]:
    """For each choice of ``spare`` of the radius + spare blocks, their (shift, width)."""
    n = radius + spare
    cuts = [BITS * i // n for i in range(n + 1)]
    return [list(c) for c in combinations([(a, b - a) for a, b in zip(cuts, cuts[1:])], spare)]


def search(queries: DataFrame, index: DataFrame, *, radius: int = 3, spare: int = 2,
           fp: str = "fingerprint") -> DataFrame:
    """(query, found, n): for each distinct fingerprint of ``queries`` the distinct fingerprints of
    ``index`` within the radius (its own included) and how many rows have them."""
    tables = block_tables(radius, spare)

    def keys(x: Column) -> Column:
        rows = []
        for t, blocks in enumerate(tables):
            key = F.lit(0).cast("long")
            for shift, width in blocks:
                part = F.shiftrightunsigned(x, shift).bitwiseAND((1 << width) - 1)
                key = F.shiftleft(key, width).bitwiseOR(part)
            rows.append(F.struct(F.lit(t).alias("table"), key.alias("key")))
        return F.inline(F.array(*rows))

    q = queries.select(F.col(fp).alias("query")).filter("query is not null").distinct()
    x = index.groupBy(F.col(fp).alias("found")).agg(F.count(F.lit(1)).alias("n")).filter("found is not null")
    met = (q.select("query", keys(F.col("query")))
           .join(x.select("found", "n", keys(F.col("found"))), ["table", "key"])
           .filter(hamming(F.col("query"), F.col("found")) <= radius))
    # a pair meets in several tables; it counts in the first one that holds it
    agree = F.col("query").bitwiseXOR(F.col("found"))
    first = F.lit(None)
    for t, blocks in reversed(list(enumerate(tables))):
        mask = sum(((1 << w) - 1) << s for s, w in blocks)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        first = F.when(agree.bitwiseAND(F.lit(mask)) == 0, F.lit(t)).otherwise(first)
    return met.filter(F.col("table") == first).select("query", "found", "n")
