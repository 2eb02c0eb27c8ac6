"""Encoding equals the tokenizers library; pair test equals merging; decoding gives the text back."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ventana.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(encoder, library, texts):
    own = [a.tolist() for a in encoder.encode(texts)]
    assert own == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts(encoder, library):
    same(encoder, library, [
        "", " ", "\n\n \t x", "a" * 5000, " " * 3000 + "x", "thth" * 900, "²³ ½ \x1c\x1d ab", "中文 한국어 日本語",
        "🙂👩‍👩‍👧", "don't we'll I'm 's", "é̀̂", "1234567890" * 30, "!!!???", "՘֋ x", "<|endoftext|>",
        "a<|endoftext|>b <|endoftext|><|endoftext|>", "<|endoftext|", "x" * 30 + " " + "Ω≈ç√∫" * 40])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_texts(encoder, library, texts):
    same(encoder, library, texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abcdeinorst '\n.é", max_size=120), max_size=5))
def test_word_like_texts(encoder, library, texts):
    same(encoder, library, texts)


def test_plain_code_points_are_cut_as_by_the_library(encoder, library):
    plain = [c for c in map(chr, range(0x20000)) if not 0xD800 <= ord(c) < 0xE000 and encoder.odd.search(c) is None]
    assert len(plain) > 20_000
    for i in range(0, len(plain), 500):
        text = "".join(f"a{c}1{c}!{c} {c}x" for c in plain[i:i + 500])
        cut = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert encoder.word.findall(text) == cut


def test_pair_test_equals_merging(encoder):
    v, rng = encoder.vocab, np.random.default_rng(3)
    usual = np.array(list(v.proposed.values()))
    short = np.array([i for b, i in v.proposed.items() if len(b) <= 4])
    x = np.concatenate([rng.choice(usual, 6000), rng.choice(short, 14000)])
    y = np.concatenate([rng.choice(usual, 6000), rng.choice(short, 14000)])
    good = encoder.test(x, y)
    assert [v.merge(v.bytes[a] + v.bytes[b]) == [a, b] for a, b in zip(x.tolist(), y.tolist())] == good.tolist()
    assert 0 < good.sum() < len(good)


def test_merging_together_equals_merging_alone(encoder):
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 24))).encode() for _ in range(800)]
    assert bpe.merge_short(encoder.vocab, encoder.test, words) == [encoder.vocab.merge(w) for w in words]


def test_memo_limit_does_not_change_codes(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 3)
    enc = bpe.Encoder(PATH)
    texts = ["one two three four five six", "six five four", "one seven"]
    same(enc, library, texts)
    same(enc, library, texts)
    assert len(enc.memo) <= 3


def test_tables(spark, library):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (3, "", None), (1, "Hello world", "x"), (None, "naïve <|endoftext|>", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert len(out) == 5 and set(out[0].asDict()) == {"doc_id", "text", "ids", "decoded"}
    for r in out:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "")
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
