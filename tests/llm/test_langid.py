"""Held-out accuracy, back-off, undetermined texts, odd tables."""

import numpy as np
from pyspark.sql import functions as F

from ventana.llm import langid as L
from ventana.llm.common import held_out

from paths import SF01

TINY = [(i, t, g) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"),
                                              ("the house is the home", "en"), ("das haus und der garten", "de")] * 10)]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    out = L.predict(docs, L.learn(docs)).filter(held_out("doc_id") & F.col("lang").isNotNull())
    assert out.filter("lang_pred = lang").count() >= 0.97 * out.count()


def test_backoff(spark):
    model = L.learn(spark.createDataFrame(TINY, "doc_id long, text string, lang string"))
    s = L.Scorer(model)
    assert s.langs == ["de", "en"]
    assert s.texts(["the", "hund", "hundert", "katzen", "q"])[0][:4] == ["en", "de", "de", "de"]
    assert "hundert" not in model["words"]


def test_held_out_rows_are_not_read(spark):
    docs = spark.createDataFrame(TINY, "doc_id long, text string, lang string")
    changed = docs.withColumn("lang", F.when(held_out("doc_id"), "xx").otherwise(F.col("lang")))
    a, b = L.learn(docs), L.learn(changed)
    assert a.keys() == b.keys() and all(np.array_equal(a[k], b[k]) for k in a)


def test_model_bounds_keep_whole_frequencies(spark):
    docs = spark.createDataFrame(TINY, "doc_id long, text string, lang string")
    full, small = L.learn(docs), L.learn(docs, words=5, ngrams=7)
    assert 0 < (small["words_n"] > 0).sum(axis=0).max() <= 5 and (small["grams_n"] > 0).sum(axis=0).max() <= 7
    for i in range(2):
        kept = {w for w, n in zip(small["words"], small["words_n"][:, i]) if n}
        least = min(n for n in small["words_n"][:, i] if n)
        assert kept == {w for w, n in zip(full["words"], full["words_n"][:, i]) if n >= least}


def test_odd_tables(spark):
    docs = spark.createDataFrame(TINY, "doc_id long, text string, lang string")
    model = L.learn(docs)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "123 !? ²", 1), (None, "the dog", 1), (4, "the " * 40_000, 1),
                                 (4, "the dog", 1)], "doc_id long, text string, score int")
    got = [(r.lang_pred, 0 <= r.score <= 1) for r in L.predict(odd, model).collect()]
    assert got == [("und", True)] * 3 + [("en", True)] * 3
    assert L.predict(odd.limit(0), model).count() == 0
    empty = L.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in L.predict(odd, empty).collect()} == {"und"}


def test_memo_limit(monkeypatch, spark):
    model = L.learn(spark.createDataFrame(TINY, "doc_id long, text string, lang string"))
    want = L.Scorer(model).texts(["the cat", "der hund", "the garten"])
    monkeypatch.setattr(L, "MEMO_WORDS", 1)
    s = L.Scorer(model)
    assert [s.texts([t])[0][0] for t in ["the cat", "der hund", "the garten"]] == want[0]


def test_scores_equal_a_plain_version(spark):
    """Words, back-off and how well a text is known, with dictionaries and loops."""
    import math
    import random
    import re
    model = L.learn(spark.createDataFrame(TINY, "doc_id long, text string, lang string"))
    s = L.Scorer(model)
    n = len(model["langs"])
    words = {w: list(c) for w, c in zip(model["words"], model["words_n"].tolist())}
    grams = {g: list(c) for g, c in zip(model["grams"], model["grams_n"].tolist())}
    size = {k: [1 + sum(c[i] for g, c in grams.items() if min(len(g), L.ORDER) == k) for i in range(n)] for k in range(1, L.ORDER + 1)}

    def word(w):
        if w in words:
            return [math.log((words[w][i] + 0.1) / (model["totals"][i] + 0.1 * len(words))) for i in range(n)], 1.0
        for k in range(L.ORDER, 0, -1):
            gs = L.grams(w, k)
            if any(g in grams for g in gs):
                logs = [[math.log((grams.get(g, [0] * n)[i] + 0.1) / (size[min(len(g), L.ORDER) if g in grams else k][i] + 0.1 * len(grams)))
                         for i in range(n)] for g in gs]
                return [sum(x[i] for x in logs) / len(gs) for i in range(n)], k / L.ORDER * sum(g in grams for g in gs) / len(gs)
        return [0.0] * n, 0.0

    draw = random.Random(4)
    pool = ["the", "hund", "cat", "dogs", "haus", "q", "zzz", "thedog", "ö", "12", "katzen", "homely"]
    for _ in range(200):
        text = " ".join(draw.choices(pool, k=draw.randint(1, 8)))
        ws = re.findall(r"[^\W\d_]+", text)
        lang, score, known = s.texts([text])
        if not ws:
            assert lang == [L.UNKNOWN]
            continue
        each = [word(w) for w in ws]
        z = [sum(e[0][i] for e in each) for i in range(n)]
        assert lang == [model["langs"][z.index(max(z))]]
        assert math.isclose(score[0], 1 / sum(math.exp(v - max(z)) for v in z), rel_tol=1e-9)
        assert math.isclose(known[0], sum(e[1] for e in each) / len(each), rel_tol=1e-9, abs_tol=1e-12)
