"""Ids and texts equal the sentencepiece library's; the prefix table equals plain merging."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from paths import SF01
from ventana.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(PATH)


@pytest.fixture(scope="module")
def decoder():
    return pieces.Decoder(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(encoder, decoder, library, texts):
    own = [a.tolist() for a in encoder.encode(texts)]
    assert own == library.encode(texts)
    assert [decoder.decode(r) for r in own] == [library.decode(r) for r in own]


def test_odd_texts(encoder, decoder, library):
    same(encoder, decoder, library, [
        "", " ", "  ", "a", " a ", "\n\n \t x", "a" * 5000, " " * 3000 + "x", "x" + " " * 47, "▁", "▁▁ ▁x▁", "<s>hi</s><unk>",
        "<0x41>", "²³ ½ ﬁ", "中文 한국어 日本語", "🙂👩‍👩‍👧", "don't we'll I'm", "é̀̂", "1234567890" * 30, "\x00\x00", "thth" * 900,
        "tthhee" * 500, "퟿ 龘", "a" + "​" * 5 + "b", "...com ,.x", "abc_def_12", "ʼn ŉ ẞ"])


@pytest.mark.parametrize("n", range(1, 70))
def test_runs_of_spaces(encoder, decoder, library, n):
    same(encoder, decoder, library, [" " * n, "x" + " " * n + "y", " " * n + "龘", "the" + " " * n + "the" + " " * n])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_any_texts(encoder, decoder, library, texts):
    same(encoder, decoder, library, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcdeinorsth '\n.é▁1", max_size=120), max_size=5))
def test_word_like_texts(encoder, decoder, library, texts):
    same(encoder, decoder, library, texts)


def test_joined_pieces(encoder, decoder, library):
    """Texts made of pieces that do not stand side by side in ordinary prose."""
    draw = random.Random(5)
    names = [p for p in encoder.model.id]
    same(encoder, decoder, library, ["".join(draw.choices(names, k=draw.randint(2, 12))) for _ in range(5000)])


def test_prefix_table_equals_merging_of_each_prefix(encoder):
    draw = random.Random(6)
    for _ in range(300):
        word = "".join(draw.choices("thineras▁龘", k=draw.randint(1, 14)))
        last, size = encoder.prefixes(word)
        for end in range(1, len(word) + 1):
            merged = encoder.model.merge(word[:end])
            assert merged[-1] == word[end - size[end]:end]
            assert (last[end] == pieces.UNKNOWN) == (merged[-1] not in encoder.model.id)


def test_decoding_any_ids(decoder, library):
    draw = random.Random(7)
    size = library.get_piece_size()
    for _ in range(3000):
        ids = [draw.choice([draw.randrange(size), draw.randrange(3, 259), draw.randrange(0, 3), 28705, 259])
               for _ in range(draw.randint(0, 8))]
        assert decoder.decode(ids) == library.decode(ids), ids


def test_memo_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_WORDS", 50)
    monkeypatch.setattr(pieces, "MEMO_PAIRS", 50)
    enc = pieces.Encoder(PATH)
    texts = [f"word{i} qz{i * 7919}x" for i in range(400)]
    first = [a.tolist() for a in enc.encode(texts)]
    assert len(enc.memo) <= 50 and len(enc.pairs) <= 50
    assert first == [a.tolist() for a in encoder.encode(texts)]


def test_other_models_are_refused():
    with pytest.raises(Exception):
        pieces.Model(public_tokenizers.path("byte_bpe_50k.json"))


def test_frames(spark):
    rows = [(1, None, "a"), (1, None, "a"), (2, "", None), (None, "two words", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `ids.x` string").withColumnRenamed("ids.x", "a.b")
    both = pieces.decode(pieces.encode(docs, PATH), PATH)
    assert both.columns == ["doc_id", "text", "a.b", "ids", "decoded"]
    got = sorted((r.doc_id or 0, r["a.b"] or "", r.ids, r.decoded) for r in both.collect())
    assert got == [(0, "x", [989, 3085], "two words"), (1, "a", [], ""), (1, "a", [], ""), (2, "", [], "")]
    clash = spark.createDataFrame([(1, "x y", "old", "old")], "doc_id long, text string, ids string, decoded string")
    r = pieces.decode(pieces.encode(clash, PATH), PATH).first()
    assert r.decoded == "x y" and len(r.ids) == 2
    assert pieces.encode(docs.limit(0), PATH).collect() == []
    nulls = spark.createDataFrame([(None,)], "ids array<int>")
    assert pieces.decode(nulls, PATH).first().decoded == ""


def test_query_equals_the_library(spark, library):
    want = {}
    for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op11_sentencepiece"](spark, SF01).collect()}
    assert got == want
