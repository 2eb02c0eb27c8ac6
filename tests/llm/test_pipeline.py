"""The pipeline against its steps written out, and each stage's contract."""

import corpus_pipeline as P
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
from ventana.llm import queries
from test_simhash_dedup import brute_groups, brute_mark

from paths import SF001, SF01


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and [n for n in queries.QUERIES if n in names] == list(queries.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = docs
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, rows, SF01)
        assert kept.columns == docs.columns, name
        n, m = rows.count(), kept.count()
        assert 0.8 * n < m <= n, name
        rows = kept
    marks = [(r.doc_id, brute_mark(r.text, 3)) for r in
             P.drop_unknown_language(spark, P.drop_toxic(spark, docs, SF01), SF01).collect()]
    ids = {r.doc_id for r in rows.collect()}
    assert ids == set(brute_groups(marks, 3).values())


def test_run(spark):
    out = P.run(spark, SF001).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    lengths = {}
    for r in out:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert 0 < len(lengths) < len(texts)
    assert lengths == {i: len(lib.encode(texts[i], add_special_tokens=False).ids) + 1 for i in lengths}


def test_language_stage_rejects_what_no_model_knows(spark):
    import random
    draw = random.Random(1)
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    letters = "abcdefghijklmnopqrstuvwxyz"
    gibberish = [(-10 - i, " ".join("".join(draw.choices(letters, k=draw.randint(2, 10))) for _ in range(40)), None, "s", 0)
                 for i in range(20)]
    unlearned = [(-100, "これは日本語の文章です 東京 にある", None, "s", 0), (-101, "это русский текст для проверки", None, "s", 0),
                 (-102, "wszystkie zwierzęta są równe ale niektóre są równiejsze", None, "s", 0)]
    texts = [r.text for r in docs.filter("length(text) > 200").limit(2).collect()]
    both = [(-200, texts[0][:150] + " " + texts[1][:150], None, "s", 0)]            # two texts of the tables: kept
    rows = docs.unionByName(spark.createDataFrame(gibberish + unlearned + both, docs.schema))
    kept = P.drop_unknown_language(spark, rows, SF01)
    left = {r.doc_id for r in kept.filter("doc_id < 0").collect()}
    assert left == {-200}
    assert kept.filter("doc_id >= 0").count() >= 0.99 * docs.filter("text is not null").count()


def test_stages_keep_columns_of_any_name(spark):
    from pyspark.sql import functions as F
    names = ["_toxicity", "_lang", "_share", "_known", "_found", "_mark", "_nth", "_TOXICITY_", "matches", "score", "a.b"]
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    docs = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names if n != "a.b"}) \
        .withColumn("a.b", F.lit("dotted"))
    rows = docs
    for name, stage in P.STAGES[:-1]:
        rows = stage(spark, rows, SF01)
        assert rows.columns == docs.columns, name
    r = rows.select("doc_id", *[f"`{n}`" for n in names]).first()
    assert [r[n] for n in names] == [f"{n}{r.doc_id}" if n != "a.b" else "dotted" for n in names]


def test_empty_and_null_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    odd = docs.limit(0).unionByName(spark.createDataFrame(
        [(-1, None, None, None, None), (-2, "", "en", "s", 0), (None, "the and attion", "en", "s", 3)], docs.schema))
    rows = docs.unionByName(odd)
    for _, stage in P.STAGES[:-1]:
        rows = stage(spark, rows, SF01)
    left = {r.doc_id for r in rows.filter("doc_id is null or doc_id < 0").collect()}
    assert left == {None}
    rows = docs.limit(0)
    for _, stage in P.STAGES:
        rows = stage(spark, rows, SF01)
    assert rows.count() == 0
