"""The plan places every piece once, gapless and within capacity; ids are the library's."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ventana.llm import packing

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def fill(steps):
    bins, met = {}, {}
    for length, lo, hi, first, each, offset in steps:
        for r in range(lo, hi):
            met.setdefault(length, []).append(r)
            bins.setdefault(first + (r - lo) // each, []).append((offset + (r - lo) % each * length, length))
    return bins, met


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([7, 16, 30, 64]).flatmap(lambda c: st.tuples(
    st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 40), max_size=12))))
def test_plan(case):
    capacity, counts = case
    steps, used = packing.plan(counts, capacity)
    bins, met = fill(steps)
    assert {k: sorted(v) for k, v in met.items()} == {k: list(range(n)) for k, n in counts.items()}
    assert sorted(bins) == list(range(used))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in parts) <= 2
    assert used >= -(-sum(k * n for k, n in counts.items()) // capacity)


def best_fit_decreasing(counts, capacity):
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [g for g in gaps if g >= length]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - length)
            else:
                gaps.append(capacity - length)
    return len(gaps)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 48), st.integers(1, 12), max_size=10))
def test_no_worse_than_best_fit_decreasing_by_more_than_one(counts):
    assert packing.plan(counts, 48)[1] <= best_fit_decreasing(counts, 48) + 1


def test_large_items_are_matched_at_most_twice():
    steps, used = packing.plan({60: 3, 40: 3, 35: 2, 5: 4}, 100)
    assert used == 4          # 60+40 three times, 35+35 with the small ones
    assert packing.plan({}, 100) == ([], 0)


def test_cut_points():
    assert packing.cut_points(5, 8) == [(0, 5)]
    assert packing.cut_points(8, 8) == [(0, 8)]
    assert packing.cut_points(9, 8) == [(0, 1), (1, 8)]
    assert packing.cut_points(24, 8) == [(0, 8), (8, 8), (16, 8)]


def test_long_runs_use_the_library():
    lib, codes = Tokenizer.from_file(JSON), packing.Codes(JSON, RANKS)
    for text in ("x" * 6000, " " * 7000 + "y", "a<|endoftext|>b", "", "word " * 3000):
        assert list(codes(text)) == lib.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("partitions", [1, 5])
def test_pack(spark, partitions):
    lib = Tokenizer.from_file(JSON)
    texts = [None, "", "one two three " * 40, "one two three " * 40, "a b c", "x " * 10] + [f"doc {i} " * i for i in range(30)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(2, texts[2], 1)],
                                 "doc_id long, text string, length int").repartition(partitions)
    out = packing.pack(docs, JSON, RANKS, capacity=64, with_ids=True)
    rows = out.collect()
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    by_doc = {}
    for r in rows:
        assert r.ids == ids[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4"))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for i, t in ids.items():
        want = [(p, *x) for p, x in enumerate(packing.cut_points(len(t), 64))]
        assert sorted(by_doc[i]) == sorted(want * (2 if i == 2 else 1))
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    joined = {r.sequence_id: r.ids for r in packing.sequences(out).collect()}
    assert {k: len(v) for k, v in joined.items()} == {k: sum(n for _, n in v) for k, v in seqs.items()}
    assert packing.pack(docs.limit(0), JSON, RANKS).count() == 0
