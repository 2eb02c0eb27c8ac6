"""From documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of ``documents``;
the last returns the packed pieces. ``run`` writes each stage's rows as Parquet in the shared folder
and reads them again for the next. Null texts count as empty: they have no toxic word, no language
(so the second stage rejects them). Rows without a doc_id cannot be named by a near-duplicate group
and stay until packing. Columns of the documents keep their values under any name.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ventana.llm import langid, packing, simhash_dedup, toxicity
from ventana.llm.common import free, written

#: A document whose best language has less than this share of the score has no clear language.
LEAST_SHARE = 0.4
#: A document that the language model knows less of has none of its languages: texts of the learned languages are known to
#: 0.8 and more (whole words, or long parts of them), random letters and other languages to less than 0.5.
LEAST_KNOWN = 0.6


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free(docs, "_toxicity")
    return toxicity.score(docs, model, out=score).filter(F.col(score) < 0.5).drop(score)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in one of the learned languages."""
    lang, share, known = (free(docs, name) for name in ("_lang", "_share", "_known"))
    found = langid.predict(docs, langid.learn(docs), out=lang, score=share, known=known)
    clear = (F.col(lang) != langid.UNKNOWN) & (F.col(share) >= LEAST_SHARE) & (F.col(known) >= LEAST_KNOWN)
    return found.filter(clear).drop(lang, share, known)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group."""
    return simhash_dedup.keep_one(docs, words=3, radius=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, placed in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=1024, end_id=2)


STAGES = [("toxicity", drop_toxic), ("language_id", drop_unknown_language),
          ("simhash_near_dedup", drop_near_duplicates), ("best_fit_packing", pack)]
#: Learned scores, fingerprints and token ids have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        rows = written(stage(spark, rows, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, rows, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
