"""Edited texts, neighbours across blocks, search against brute force."""

import hashlib
import random

import pytest

from ventana.llm import fingerprint as P


def test_equal_texts_and_likeness(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, None), (4, "")], "doc_id long, text string")
    got = [r.fingerprint for r in P.fingerprints(docs).collect()]
    assert got[0] == got[1] != 0 and got[2] == got[3] == 0
    pair = spark.createDataFrame([(0, -1), (5, 5), (0, 7)], "a long, b long")
    assert [r[0] for r in pair.select(P.likeness(pair.a, pair.b)).collect()] == [0.0, 1.0, 1 - 3 / 64]


def test_edited_text():
    assert P.edited_text("abcde", "XYZ") == "abcXY"
    assert P.edited_text("abcdef", "X") == "abcX"
    assert P.edited_text("", "X") == "" and P.edited_text("a", "X") == "a"


@pytest.mark.parametrize("blocks", [1, 3, 17, 60])
def test_next_document_across_blocks(spark, blocks):
    rng = random.Random(blocks)
    texts = {i * 7: " ".join(rng.choice(["é", "of", "a", "longer", "word"]) for _ in range(rng.randint(0, 9))) for i in range(40)}
    rows = list(texts.items())
    rng.shuffle(rows)
    got = {r.doc_id: r for r in P.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3),
                                            blocks=blocks).collect()}
    order = sorted(texts)
    assert sorted(got) == order
    for k, i in enumerate(order):
        following = texts[order[(k + 1) % len(order)]]
        edit = P.edited_text(texts[i], following)
        r = got[i]
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint, r.next_fingerprint) == tuple(
            map(P.fingerprint, (texts[i], edit, following)))


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "x y", 1), (2, "b", 1), (2, "a c", 1), (2, "a c", 1), (3, None, 1)],
                                 "doc_id long, text string, block int")
    got = P.with_next(docs, blocks=2).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 3), (2, 1), (2, 3), (2, 3), (3, 0)]
    one = P.with_next(docs.limit(1)).collect()
    assert len(one) == 1 and one[0].fingerprint == one[0].next_fingerprint
    assert P.with_next(docs.limit(0)).count() == 0


def test_search_equals_brute_force(spark):
    rng = random.Random(8)
    marks = []
    for _ in range(15):
        centre = rng.getrandbits(64)
        for _ in range(20):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            marks += [x] * rng.choice([1, 1, 3])
    signed = [x - (1 << 64) if x >> 63 else x for x in marks]
    index = spark.createDataFrame([(x,) for x in signed] + [(None,)], "fingerprint long")
    asked = sorted(set(signed[::7]))
    for radius, spare in ((3, 2), (2, 1)):
        got = {(r.query, r.found): r.n for r in P.search(index.filter(index.fingerprint.isin(asked)), index,
                                                         radius=radius, spare=spare).collect()}
        want = {(q, f): signed.count(f) for q in asked for f in set(signed)
                if ((q ^ f) % (1 << 64)).bit_count() <= radius}
        assert got == want
