"""Folding, exceptions, learning on a planted lexicon, held-out accuracy, odd tables."""

import random

import pytest
from pyspark.sql import functions as F

from ventana.llm import toxicity as X
from ventana.llm.common import held_out

from paths import SF01


@pytest.mark.parametrize("text", ["idiot", "IDIOT!", "1d10t", "іdіоt", "ｉｄｉｏｔ", "id​iot", "id!ot", "𝐢𝐝𝐢𝐨𝐭"])
def test_folding(text):
    assert X.Matcher(X.Model({}, {"idiot": 2.0}).settings())(f"you {text} there")[0] == 1


def test_words_stems_and_exceptions():
    m = X.Matcher(X.Model({"mor": 1.0, "moron": 3.0}, {"trash": 2.0}, ("trash can",)).settings())
    assert m("trash trashy") == (1, 2.0, 2)
    assert m("a trash can here")[0] == 0
    assert m("morons")[1] == 3.0 and m("more")[1] == 1.0
    assert m("")[:2] == (0, 0.0) and m("tumor")[0] == 0
    assert X.Matcher(X.Model().settings() | {"exceptions": ()})("anything") == (0, 0.0, 1)


def planted(spark, n=600):
    rng = random.Random(4)
    plain = ["".join(rng.choice("aeioulmnrst") for _ in range(6)) for _ in range(80)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.3
        if bad:
            words[2:2] = [rng.choice(["zorgak", "zorgaks", "blixt"]) for _ in range(2)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels))


def test_learning(spark):
    docs, labels, truth = planted(spark)
    model = X.learn(docs, labels)
    assert "zorgak" in model.stems
    out = X.score(docs, model).collect()
    assert all((r.score >= 0.5) == bool(truth[r.doc_id]) and 0 <= r.score <= 1 for r in out)
    for_new = X.score(spark.createDataFrame([(1, "Z0RGAK blixt now"), (2, "quite harmless words")], docs.schema), model)
    assert [r.score >= 0.5 for r in for_new.orderBy("doc_id").collect()] == [True, False]


def test_held_out_labels_are_not_read(spark):
    docs, labels, _ = planted(spark)
    flipped = labels.withColumn("toxic", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert X.learn(docs, labels) == X.learn(docs, flipped)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    out = X.score(docs, X.learn(docs, labels)).join(labels, "doc_id").filter(held_out("doc_id"))
    assert out.filter((F.col("score") >= 0.5) == (F.col("toxic") == 1)).count() >= 0.9 * out.count()


def test_odd_tables(spark):
    docs, labels, _ = planted(spark)
    model = X.learn(docs, labels)
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "zorgak zorgak", "c"), (2, "", "b"),
                                 (3, "word " * 50_000, "d")], "doc_id long, text string, score string")
    got = X.score(odd, model, details=True).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert [r.score < 0.5 for r in got] == [True, True, False, True, True]
    assert X.score(odd.limit(0), model).count() == 0
    none = X.learn(docs.limit(0), labels.limit(0))
    assert not none.stems and X.score(odd, none).filter("score < 0.5").count() == 5
    only = X.learn(docs, labels.withColumn("toxic", F.lit(None).cast("int")))
    assert not only.stems


def test_choose_equals_scanning_every_feature():
    """Growing stems by their indexed children finds what a scan of all features finds; many features are no trouble."""
    import random
    import time
    from ventana.llm import toxicity as X

    def scanning(tally, weight):
        pure = {f for f, x in weight.items() if x >= X.RATIO}
        stems = {}
        for f in sorted((f for f in pure if not f.endswith("$")), key=lambda f: (len(f), f)):
            if not any(f[:k] in stems for k in range(X.STEMS[0], len(f))):
                stems[f] = weight[f]
        grown = {}
        for f in stems:
            while True:
                longer = [g for g in tally if len(g) == len(f) + 1 and g.startswith(f) and not g.endswith("$")
                          and tally[g][0] >= 0.9 * tally[f][0] and g in pure]
                if not longer:
                    break
                f = longer[0]
            grown[f] = weight[f]
        words = {f[:-1]: weight[f] for f in pure if f.endswith("$") and not any(f[:k] in grown for k in range(1, len(f)))}
        return grown, words

    draw = random.Random(1)
    for _ in range(40):
        names = {"".join(draw.choices("abc", k=draw.randint(X.STEMS[0], 8))) + draw.choice(["", "", "$"]) for _ in range(150)}
        tally = {f: (draw.randint(1, 40), draw.randint(0, 3)) for f in sorted(names, key=lambda f: draw.random())}
        weight = {f: draw.choice([0.0, X.RATIO, X.RATIO + 1]) for f in tally}
        assert X.choose(tally, weight) == scanning(tally, weight)
    many = {f"w{draw.randrange(10 ** 9):09d}"[:draw.randint(X.STEMS[0], 9)]: (5, 0) for _ in range(200_000)}
    start = time.perf_counter()
    X.choose(many, dict.fromkeys(many, X.RATIO))
    assert time.perf_counter() - start < 20
