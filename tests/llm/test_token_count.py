"""Automaton counts equal greedy longest match written out."""

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from ventana.llm import token_count as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


def greedy(word, begin, inside):
    n, at, pieces = 0, 0, begin
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return T.UNKNOWN
        n, at, pieces = n + 1, end, inside
    return n


words = st.text("abc", max_size=14).map(str.encode)
pieces = st.sets(st.text("abc", min_size=1, max_size=5).map(str.encode), max_size=12)


@settings(max_examples=400, deadline=None)
@given(pieces, pieces, st.lists(words, max_size=8))
def test_any_vocabulary(begin, inside, texts):
    a = T.Automaton(sorted(begin), sorted(inside))
    assert [a.count(w) for w in texts] == [greedy(w, begin, inside) for w in texts]


def test_public_vocabulary():
    begin, inside = T.pieces_of(PATH)
    a, b, i = T.Automaton(begin, inside), set(begin), set(inside)
    for w in ("the", "unbelievably", "Donaudampfschiff", "ééç", "x" * 3000, "naïveté", "🙂", "1234567", "a"):
        assert a.count(w.encode()) == greedy(w.encode(), b, i), w


def test_table(spark):
    docs = spark.createDataFrame([(1, "ab  abc\tx", 9), (2, None, 9), (3, "", 9), (1, "ab  abc\tx", 9), (None, "c", 9)],
                                 "doc_id long, text string, n_words int")
    out = T.token_counts(docs, pieces=([b"ab", b"a"], [b"c", b"b"])).collect()
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_words, r.n_unknown) for r in out)
    assert got == [(0, 1, 1, 1), (1, 4, 3, 1), (1, 4, 3, 1), (2, 0, 0, 0), (3, 0, 0, 0)]
    assert T.token_counts(docs.limit(0), PATH).count() == 0
