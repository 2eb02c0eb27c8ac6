"""Every query on tables with nulls, empty and repeated rows, ties, and on empty tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from test_lexical import plain as plain_search
from test_trie import plain as plain_trie
from ventana.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(0, "the first text of all", "en", "s", 1), (50, "the same words here", "en", None, None),
        (50, "other words altogether in this one", None, "s", 2), (50, "the same words here", "en", None, None),
        (51, None, "en", "s", 0), (52, "", "de", "s", 0), (None, "a text without id", "en", "s", 3), (53, "123 !", None, "s", 4),
        (100, "the same words here", "en", "s", 5), (101, "word " * 3000, "en", "s", 6), (102, "ein deutscher text", "de", "s", 7)]
LABELS = [(0, 1, 0), (50, 1, 0), (51, 0, None), (None, 1, 1), (100, 0, 0), (101, None, 1), (999, 1, 1)]
TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, 5, None, "x"), (None, 0, "user", "lost"),
         (3, None, "assistant", "<|im_end|>")]
ITEMS = [(1, "the SAME words"), (1, "text, word"), (None, "texter first"), (2, None), (3, "!?"), (4, "nowhere")]
VECTORS = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, None, 0), (None, [1.0, 0.0], 1), (4, [0.0, 0.0], 1)]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for name, keep in (("odd", True), ("empty", False)):
        d = str(tmp_path_factory.mktemp(name))
        for table, rows, schema in (("documents", ROWS, DOCS), ("labels", LABELS, "doc_id long, quality int, toxic int"),
                                    ("conversations", TURNS, "conv_id long, turn long, role string, text string"),
                                    ("benchmark", ITEMS, "item_id long, text string"),
                                    ("embeddings", VECTORS, "vec_id long, embedding array<float>, label int")):
            spark.createDataFrame(rows if keep else [], schema).repartition(2).write.parquet(f"{d}/{table}.parquet")
        out[name] = d
    return out


COUNTS = {"op1_toxicity": 11, "op2_language_id": 11, "op3_bpe": 11, "op4_fingerprints": 11, "op5_license_scan": 0,
          "op6_token_counts": 11, "op7_simhash_dedup": 11, "op8_chat_format": 4, "op9_embedding_dedup": 5,
          "op10_best_fit_packing": 13, "op11_sentencepiece": 11,
          "op12_conversation_trie": len(plain_trie(TURNS)), "op13_lexical_search": len(plain_search([r[:2] for r in ROWS], ITEMS))}


@pytest.mark.parametrize("name", list(COUNTS))
def test_odd_and_empty_tables(spark, folders, name):
    rows = queries.QUERIES[name](spark, folders["odd"]).collect()
    assert len(rows) == COUNTS[name]
    empty = queries.QUERIES[name](spark, folders["empty"])
    assert empty.count() == (1 if name == "op8_chat_format" else 0)      # the planted conversation
    if name == "op4_fingerprints":
        near = sorted(r.n_near for r in rows if r.doc_id == 50)
        assert near == [1, 3, 3] and {r.n_near for r in rows if r.doc_id in (51, 101, None)} == {None}
        first = next(r for r in rows if r.doc_id == 0)
        assert first.n_chars == 21 and first.near_edited <= 1
    if name == "op3_bpe":
        nothing = hashlib.sha256(b"").hexdigest()
        assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows if r.doc_id in (51, 52)} == {(0, nothing, nothing)}
    if name == "op12_conversation_trie":
        assert sorted(map(tuple, rows), key=str) == plain_trie(TURNS)
    if name == "op13_lexical_search":
        assert sorted(map(tuple, rows), key=str) == plain_search([r[:2] for r in ROWS], ITEMS)
    if name == "op2_language_id":
        assert {r.lang_pred for r in rows if r.doc_id in (51, 52, 53)} == {"und"}


def test_pipeline_on_odd_tables(spark, folders):
    import corpus_pipeline
    for name in ("odd", "empty"):
        rows = corpus_pipeline.run(spark, folders[name]).collect()
        assert {r.doc_id for r in rows} <= {0, 50, 100, 101, 102, None}


def test_columns_with_dots_pass_through(spark):
    """Operators that add columns to documents leave others alone, whatever their names."""
    import public_tokenizers
    from ventana.llm import bpe, langid, token_count, toxicity
    docs = spark.createDataFrame([(i, "the cat and the dog", "en", "x") for i in range(30)], "doc_id long, text string, lang string, v string") \
        .withColumnRenamed("v", "a.b").withColumn("_found", F.lit("kept"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    made = [bpe.decode(bpe.encode(docs, path), path), token_count.token_counts(docs, path), langid.predict(docs, langid.learn(docs)),
            toxicity.score(docs, toxicity.Model({"cat": 1.0}, {}, ()))]
    for df in made:
        r = df.filter("doc_id = 3").first()
        assert r["a.b"] == "x" and r["_found"] == "kept" and df.columns[:5] == docs.columns
