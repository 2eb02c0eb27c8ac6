"""Near-duplicate removal by SimHash with pigeonring filtering (operator 7).

A 64-bit fingerprint has a bit set where over half of the document's word shingles have it set
in their XXH64 hash. Two fingerprints are linked if they differ in at most ``radius`` bits.

Pigeonring: cut the 64 bits into a ring of m = radius + 1 segments. If all segments together
differ in at most ``radius`` bits, some segment starts a chain whose first l segments differ in
at most floor(l * radius / m) bits, for every l. With m = radius + 1 these budgets are
0, 1, 2, ..., radius: the first segment is equal and the second differs in one bit at most. The
first two budgets are turned into an equality join: each fingerprint is listed under its own
(start, segment, next segment) and looked up under that key with every variant of the next
segment within one bit. Keys have about 2 * 64 / m bits (32 at radius 3), so a key's list stays
short where single segments (16 bits) would fill with unrelated fingerprints. Longer chains are
checked on the pairs that meet, then the full distance.

Only distinct fingerprints are compared, and groups are named by the smallest id of their rows; exact copies
meet in an aggregation that combines before the shuffle, whatever their number. A fingerprint
has at most sum C(64, 1..radius) others within the radius (43,744 at 3), so links grow with the
number of distinct fingerprints, not with the square of a group.

Defined cases: a null text counts as empty; a document without words has fingerprint 0 and links
like any other; repeated rows and ids share the group of their fingerprint. A row without id
keeps its row in the result, in the group of its fingerprint (component null if no row of the
group has an id). Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, components, free, hamming, text_or_empty, written

SEED = 42
#: Shingles whose bits are counted at once (64 bytes each).
CHUNK = 1 << 16


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words of the text with A-Z in lower case, in order.

    Words are runs of bytes other than space and 0x09-0x0D, which is what ``bytes.split`` cuts at.
    """
    parts = text.encode("utf-8").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED)
                        for a, b in zip(starts[:n].tolist(), ends[len(parts) - n:].tolist())),
                       np.uint64, n)


def majority_bits(hashes: np.ndarray) -> int:
    """Unsigned 64-bit number with a bit where over half of the hashes have it; 0 for none."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        rows = hashes[i:i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 words: int = 3) -> DataFrame:
    """(id, fingerprint as signed 64-bit number) for each row."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col), mark_of(text_col, words).alias("fingerprint"))


def mark_of(text_col: str, words: int) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        marks = [majority_bits(shingle_hashes(t, words)) for t in texts]
        return pd.Series(np.array(marks, np.uint64).view(np.int64))

    return of(text_or_empty(text_col))


def segments(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of the radius + 1 segments of 64 bits, from the low bits."""
    m = radius + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def links(marks: DataFrame, *, radius: int = 3, fp: str = "fingerprint", rep: str = "rep") -> DataFrame:
    """Pairs (a, b) of ``rep`` of distinct fingerprints that differ in at most ``radius`` bits.

    ``marks`` has one row per distinct fingerprint.
    """
    if radius < 1:
        return marks.select(F.col(rep).alias("a"), F.col(rep).alias("b")).limit(0)
    parts = segments(radius)
    m = len(parts)

    def part(c, i):
        shift, width = parts[i % m]
        return F.shiftrightunsigned(c, shift).bitwiseAND((1 << width) - 1)

    def key(c, i):
        return F.shiftleft(part(c, i), parts[(i + 1) % m][1]).bitwiseOR(part(c, i + 1))

    x = F.col(fp)
    index = marks.select(x.alias("fa"), F.col(rep).alias("a"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("start"), key(x, i).alias("key")) for i in range(m)])))

    def variants(i):
        flips = F.array(*[F.lit(v).cast("long")
                          for v in [0, *(1 << j for j in range(parts[(i + 1) % m][1]))]])
        return F.transform(flips, lambda v: F.struct(F.lit(i).alias("start"),
                                                     key(x, i).bitwiseXOR(v).alias("key")))

    probe = marks.select(x.alias("fb"), F.col(rep).alias("b"),
                         F.inline(F.flatten(F.array(*[variants(i) for i in range(m)]))))
    # sorted and merged: Spark takes the listed rows for no more than the file they come from, and would send them all
    # through the driver as a broadcast
    met = index.hint("merge").join(probe, ["start", "key"]).filter("fa < fb")
    d = F.col("fa").bitwiseXOR(F.col("fb"))
    chain = F.lit(False)
    for i in range(m):
        ok = F.lit(True)
        for length in range(3, m):
            spent = sum((F.bit_count(part(d, i + j)) for j in range(length)), F.lit(0))
            ok = ok & (spent <= length * radius // m)
        chain = chain | ((F.col("start") == i) & ok)
    return (met.filter(chain).filter(hamming(F.col("fa"), F.col("fb")) <= radius)
            .select("a", "b").distinct())


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
           radius: int = 3) -> DataFrame:
    """(id, fingerprint, component_id): the smallest id reachable over links, per row of ``docs``."""
    marked = written(fingerprints(docs, id_col=id_col, text_col=text_col, words=words)
                     .toDF("id", "fingerprint"), "marks")
    # links are between fingerprints: an id may have several
    reps = written(marked.groupBy("fingerprint").agg(F.min("id").alias("rep")), "reps")
    joined = components(links(reps, radius=radius, rep="fingerprint"))
    group = reps.join(joined, reps.fingerprint == joined.node, "left").select(
        "fingerprint", "rep", F.coalesce("component", "fingerprint").alias("group"))
    least = group.groupBy("group").agg(F.min("rep").alias("component_id"))
    comp = group.join(least, "group").select("fingerprint", "component_id")
    return (marked.join(comp, "fingerprint")
            .select(F.col("id").alias(id_col), "fingerprint", "component_id"))


def hex_digits(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
             radius: int = 3) -> DataFrame:
    """One row of ``docs`` for each group, that of the smallest id, with all its columns.

    Rows go by their own fingerprint, also where several texts share an id. Repeated rows of the id
    and fingerprint that stay are reduced to the first by a hash of the text, then by the other
    columns. Rows without an id cannot be told apart and stay.
    """
    bound_batches(docs.sparkSession)
    mark, nth = free(docs, "_mark"), free(docs, "_nth")
    named = written(docs.filter(F.col(id_col).isNotNull()).withColumn(mark, mark_of(text_col, words)), "marked")
    reps = written(named.groupBy(F.col(mark).alias("fingerprint")).agg(F.min(id_col).alias("rep")), "reps")
    joined = components(links(reps, radius=radius, rep="fingerprint"))
    first = (reps.join(joined, reps.fingerprint == joined.node, "left")
             .groupBy(F.coalesce("component", "fingerprint").alias("group"))
             .agg(F.min(F.struct("rep", "fingerprint")).alias("m"))
             .select(F.col("m.rep").alias(id_col), F.col("m.fingerprint").alias(mark)))
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]))
    order = Window.partitionBy(id_col, mark).orderBy(F.xxhash64(text_col), others)
    # merged like the links: one row a group, which would go through the driver; the window below needs these partitions anyway
    one = (named.join(first.hint("merge"), [id_col, mark], "left_semi").withColumn(nth, F.row_number().over(order))
           .filter(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns]))
    return one.unionByName(docs.filter(F.col(id_col).isNull()))
