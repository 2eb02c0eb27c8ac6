"""Packing documents into fixed-size sequences by large-item matching and best fit (operator 10).

Every document becomes its token ids plus an end id. A document longer than the capacity is cut
into pieces of exactly the capacity, the shorter remainder first. Pieces are then packed:

* pieces above a third of the capacity are matched greedily, the largest left with the largest
  other one that still fits, so a sequence holds at most two of them;
* smaller pieces go, longest first, to the sequence with the smallest gap that holds them, and
  open a sequence when no gap does.

Pieces of equal length are interchangeable, so the packing is decided on their counts per length
(at most ``capacity`` numbers, the only thing the driver sees): each step of the plan says that
pieces number lo..hi of a length go to a run of sequences, so many to each, from an offset on.
The plan has at most a few steps per (length, gap), whatever the number of documents; each piece
finds its place from its length and its number among the pieces of that length. Numbers are dealt
inside each partition and shifted by the counts of the partitions before, so no length is ever
gathered or sorted in one task.

Tokens come from the tokenizer library named by the caller's files: ``tiktoken`` ranks give the
ids of ordinary text, the special tokens of the ``tokenizers`` JSON are cut out first.

Defined cases: a null text counts as empty and is one piece holding the end id; repeated rows are
packed as often as they come; a null id stays null; an empty table gives no pieces. Only the id
and text columns are read.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, once, shared, text_or_empty, written

#: Words are cut as the byte-level vocabularies were trained on them.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Runs of one kind of character longer than this go to the ``tokenizers`` library, whose cost
#: stays in proportion to the run.
LONG_RUN = 5000


class Codes:
    """Ids of whole texts."""

    def __init__(self, json_path: str, ranks_path: str):
        import tiktoken

        self.json_path = json_path
        with open(json_path, encoding="utf-8") as f:
            self.special = {a["content"]: a["id"] for a in json.load(f)["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.run = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")
        self.library = None

    def __call__(self, text: str) -> list[int]:
        if len(text) > LONG_RUN and self.run.search(text):
            if self.library is None:
                from tokenizers import Tokenizer
                self.library = Tokenizer.from_file(self.json_path)
            return self.library.encode(text, add_special_tokens=False).ids
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain.encode_ordinary(text)
        out: list[int] = []
        for part in self.cut.split(text):
            out.extend([self.special[part]] if part in self.special else self.plain.encode_ordinary(part))
        return out


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first may be shorter."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((a, capacity) for a in range(first, n, capacity))] if n > capacity \
        else [(0, n)]


def pieces(docs: DataFrame, json_path: str, ranks_path: str, *, capacity: int = 1024, end_id: int = 2,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, nth [, ids]): ``nth`` numbers the pieces of a
    length within the partition ``part``."""
    spark = docs.sparkSession
    bound_batches(spark)
    state = shared(spark, {"json": json_path, "ranks": ranks_path})
    id_type = docs.select(id_col).schema[0].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = once(state.value, "codes", lambda: Codes(state.value["json"], state.value["ranks"]))
        met = [0] * (capacity + 1)
        for batch in batches:
            rows: list[tuple] = []
            own, ids_out = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*codes(text), end_id], "<u4")
                for p, (start, length) in enumerate(cut_points(len(ids), capacity)):
                    part = ids[start:start + length]
                    rows.append((p, start, length, zlib.crc32(part), met[length]))
                    met[length] += 1
                    own.append(k)
                    if with_ids:
                        ids_out.append(part.astype(np.int32))
            cols = list(zip(*rows)) if rows else [()] * 5
            take = pa.array(own, pa.int64())
            arrays = [batch.column(0).take(take), pa.array(cols[0], pa.int32()),
                      *(pa.array(c, pa.int64()) for c in cols[1:4]), batch.column(2).take(take),
                      pa.array(cols[4], pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"),
                         F.spark_partition_id().alias("part"))
    extra = ", ids array<int>" if with_ids else ""
    return source.mapInArrow(cut, f"id {id_type.simpleString()}, piece int, start long, length long, "
                                  f"ids_crc32 long, part int, nth long{extra}").withColumnRenamed("id", id_col)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Steps (length, lo, hi, first sequence, pieces a sequence, offset) and the number of sequences.

    Pieces lo <= number < hi of the length go, ``pieces a sequence`` at a time, to consecutive
    sequences from the first one, starting at the offset. ``gaps`` holds runs of sequences by the
    room they have left.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    met = dict.fromkeys(left, 0)
    steps: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    used = 0

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in gaps:
                gaps[room] = []
                insort(rooms, room)
            gaps[room].append((first, n))

    def put(length: int, n: int, first: int, each: int, offset: int) -> None:
        steps.append((length, met[length], met[length] + n, first, each, offset))
        met[length] += n
        left[length] -= n

    large = sorted(x for x in left if 3 * x > capacity)
    while large:
        a = large[-1]
        n = left[a]
        if not n:
            large.pop()
            continue
        i = bisect_left(large, capacity - a + 1) - 1
        while i >= 0 and not left[large[i]]:
            large.pop(i)
            i -= 1
        b = large[i] if i >= 0 else None
        if b is None or (b == a and n == 1):
            j = i - 1 if b == a else -1
            while j >= 0 and not left[large[j]]:
                large.pop(j)
                j -= 1
            if b == a and j >= 0:
                b = large[j]
            else:
                put(a, n, used, 1, 0)
                leave(capacity - a, used, n)
                used += n
                continue
        k = n // 2 if a == b else min(n, left[b])
        put(a, k, used, 1, 0)
        put(b, k, used, 1, a)
        leave(capacity - a - b, used, k)
        used += k

    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[length]:
            n = left[length]
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                runs = [(each, n // each), (n % each, 1)]
                for k, bins in runs:
                    if k and bins:
                        put(length, k * bins, used, k, 0)
                        leave(capacity - k * length, used, bins)
                        used += bins
                continue
            room = rooms[i]
            first, bins = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
                rooms.pop(i)
            each = room // length
            full = min(bins, n // each)
            if full:
                put(length, full * each, first, each, capacity - room)
                leave(room - each * length, first, full)
            rest = 0
            if full < bins and left[length]:
                rest = left[length]
                put(length, rest, first + full, rest, capacity - room)
                leave(room - rest * length, first + full, 1)
            done = full + (1 if rest else 0)
            leave(room, first + done, bins - done)
    return steps, used


def pack(docs: DataFrame, json_path: str, ranks_path: str, *, capacity: int = 1024, end_id: int = 2,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset [, ids]."""
    spark = docs.sparkSession
    cut = written(pieces(docs, json_path, ranks_path, capacity=capacity, end_id=end_id, id_col=id_col,
                         text_col=text_col, with_ids=with_ids), "pieces")
    counts = written(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps, _ = plan(total, capacity)
    steps.sort()
    state = shared(spark, {"steps": np.array(steps, np.int64).reshape(-1, 6)})
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        table = state.value["steps"]
        key = once(state.value, "key", lambda: table[:, 0] * (1 << 48) + table[:, 1])
        at = np.searchsorted(key, length.to_numpy() * (1 << 48) + number.to_numpy(), "right") - 1
        size, lo, _, first, each, offset = table[at].T
        i = number.to_numpy() - lo
        return pd.DataFrame({"sequence_id": first + i // each, "offset": offset + i % each * size})

    spot = place(F.col("length"), F.col("nth") + F.col("before")).alias("_spot")
    kept = [id_col, "piece", "start", "length", "ids_crc32"]
    return (cut.join(shift, ["length", "part"])
            .select(*kept, *(["ids"] if with_ids else []), spot)
            .select(*kept, "_spot.sequence_id", "_spot.offset", *(["ids"] if with_ids else [])))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence, from ``pack(..., with_ids=True)``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
