"""Fingerprints, links and groups against brute force."""

import random
import re

import pytest
import xxhash

from ventana.llm import simhash_dedup as S
from ventana.llm.common import _fingerprint, components

from paths import SF001


def brute_mark(text, words):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(marks, radius):
    label = {i: i for i, _ in marks}
    links = [(i, j) for a, (i, x) in enumerate(marks) for j, y in marks[a + 1:] if (x ^ y).bit_count() <= radius]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return label


TEXTS = [None, "", " \t\n", "One", "one two", "a b c", "A B C", "a\x0bb\x0cc", "Été É été", "x y", "ünïcode word two three"]


def test_fingerprints(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint % (1 << 64) for r in S.fingerprints(docs).collect()}
    assert got == {i: brute_mark(t, 3) for i, t in enumerate(TEXTS)}
    assert got[0] == got[1] == got[2] == 0


def test_chunks_do_not_change_bits(monkeypatch):
    h = S.shingle_hashes("a b c d e f g h i j k", 3)
    whole = S.majority_bits(h)
    monkeypatch.setattr(S, "CHUNK", 2)
    assert S.majority_bits(h) == whole


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_links_equal_brute_force(spark, radius):
    rng = random.Random(radius)
    marks = {}
    for c in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            marks.setdefault(x, len(marks))
    rows = [(x - (1 << 64) if x >> 63 else x, i) for x, i in marks.items()]
    got = S.links(spark.createDataFrame(rows, "fingerprint long, rep long"), radius=radius).collect()
    items = list(marks.items())
    want = {frozenset((i, j)) for a, (x, i) in enumerate(items) for y, j in items[a + 1:] if (x ^ y).bit_count() <= radius}
    assert {frozenset((r.a, r.b)) for r in got} == want and len(got) == len(want)


def test_listed_fingerprints_are_not_broadcast(spark, tmp_path):
    """the file of fingerprints is small, the keys and variants listed from it are 68 times as many rows."""
    spark.range(2000).selectExpr("xxhash64(id) AS fingerprint", "id AS rep").write.parquet(f"{tmp_path}/marks")
    met = S.links(spark.read.parquet(f"{tmp_path}/marks"))
    assert "BroadcastExchange" not in met._jdf.queryExecution().executedPlan().toString()
    met.collect()
    assert "BroadcastExchange" not in met._jdf.queryExecution().executedPlan().toString()


def test_groups_equal_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = {r.doc_id: r.component_id for r in S.groups(docs).collect()}
    marks = [(r.doc_id, brute_mark(r.text, 3)) for r in docs.collect()]
    assert got == brute_groups(marks, 3)


def test_odd_tables(spark):
    rows = [(5, "a b c d", "p"), (3, "a b c d", "q"), (5, "a b c d", "p"), (None, "a b c d", "r"), (9, None, None),
            (8, "", None), (None, "lonely words stand here", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in S.groups(docs).collect()
                 if r.component_id is not None)
    assert got == [(False, 3, 3), (False, 5, 3), (False, 5, 3), (False, 8, 8), (False, 9, 8), (True, 0, 3)]
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [
        (-1, "a b c d"), (-1, "lonely words stand here"), (3, "a b c d"), (8, "")]
    assert S.groups(docs.limit(0)).count() == 0 and S.keep_one(docs.limit(0)).count() == 0


def test_one_id_with_several_texts(spark):
    """Each text of a repeated id is in the group of its own fingerprint."""
    a, b, c, d = ("red apples fall from old trees", "grey stones lie under cold water",
                  "nine ships sail past green islands", "tall grass bends in warm wind")
    rows = [(1, a), (2, b), (2, a), (2, c), (1, d), (3, b), (1, a), (4, c)]
    for n in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        assert sorted(map(tuple, S.keep_one(docs).collect())) == [(1, a), (1, d), (2, b), (2, c)]


def test_groups_go_by_fingerprint_not_by_id(spark):
    """An id with two texts does not tie their groups together, however small the id is."""
    a, b = "red apples fall from old trees", "grey stones lie under cold water"
    for shared_id in (4, 7):
        docs = spark.createDataFrame([(5, a), (5, b), (2, a), (shared_id, b), (None, a), (None, "none of these words")],
                                     "doc_id long, text string")
        got = {(r.doc_id, r.fingerprint): r.component_id for r in S.groups(docs).collect()}
        mark = {t: brute_mark(t, 3) for t in (a, b)}
        signed = {t: m - (1 << 64) if m >= 1 << 63 else m for t, m in mark.items()}
        assert got[5, signed[a]] == got[2, signed[a]] == got[None, signed[a]] == 2
        assert got[5, signed[b]] == got[shared_id, signed[b]] == min(5, shared_id)
        assert sum(v is None for v in got.values()) == 1


def test_many_copies_are_one_group(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'the same text again and again' as text")
    assert S.groups(docs).filter("component_id = 0").count() == 3000
    assert S.keep_one(docs).count() == 1


def test_kept_rows_are_not_looked_up_through_a_broadcast(spark):
    """One row a group is no bounded number, also where its file looks small."""
    docs = spark.createDataFrame([(i, f"text number {i // 2} of a few") for i in range(40)], "doc_id long, text string")
    kept = S.keep_one(docs)
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    assert "LeftSemi" in plan
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "LeftSemi" in line]
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == list(range(0, 40, 2))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (3, 1), (1, 3), (2, None)]
    edges += [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(500, i) for i in range(501, 900)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}
    for a, b in edges:
        if b is not None and a != b:
            label[a], label[b] = a, b
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if b is not None and a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert got == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_of_many_edges(spark):
    """Twenty million edges: their number and hashes, without an overflow; one edge changed shows."""
    e = spark.range(20_000_000).selectExpr("id + 1 as u", "id div 3 as v")
    state = _fingerprint(e)
    assert state[0] == 20_000_000
    assert state != _fingerprint(e.selectExpr("u", "if(u = 77, 0L, v) as v"))
