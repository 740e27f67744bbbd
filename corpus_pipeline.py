"""The corpus pipeline: language, toxicity, near duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run``
writes each stage's rows as Parquet to the shared folder and reads them for the next.
Models are learned from the tables of ``sf_dir``, by the folds of the single queries.

Rows with a null or an empty text, or without a letter, have no language and go in the first stage;
later stages pass a null text on as it is, and the last packs it as its end mark alone.  Whole texts
are read, however long.  Rows that share an id are judged by their own texts in the first two stages,
and stay or go together as near duplicates, each then packed by itself; rows without an id are near
duplicates of none.  Of a group of near duplicates the smallest id stays, so there are no ties.  An
empty table passes through all stages.  Extra columns of documents, whatever their names, are dropped.
Pseudonyms are made with the key of the queries (``spark.plumbline.pii.key``).

Each stage makes the session write small Parquet row groups and read few rows at once, unless the
session has its own settings of these (``small_buffers``), so that tasks with whole texts fit a small heap.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import langid, neardup, packing, pii, toxicity
from plumbline.llm.common import fold_of, small_buffers, stored, table
from plumbline.llm.queries import pii_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose language is less certain than this is rejected.
MIN_LANGUAGE_SCORE = 0.5
MAX_TOXICITY = 0.7
#: Near duplicates share 80 percent of their five-word shingles.
SHINGLE, NUM, DEN = 5, 80, 100


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with a score of MIN_LANGUAGE_SCORE or more."""
    small_buffers(spark)
    model = langid.train(table(spark, sf_dir, "documents"), fold_of(F.col("doc_id"), 4) != 2)
    known = langid.predict(docs.select(COLUMNS), model)
    return known.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under MAX_TOXICITY."""
    small_buffers(spark)
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 3) != 1)
    return toxicity.score(docs.select(COLUMNS), model).filter(F.col("toxicity") < MAX_TOXICITY).select(COLUMNS)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; all without an id or without words."""
    small_buffers(spark)
    gone = neardup.near_duplicates(docs, SHINGLE, NUM, DEN).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms; n_chars counts the new text."""
    small_buffers(spark)
    return pii.pseudonymise(docs.select(COLUMNS), pii_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    small_buffers(spark)
    return packing.digests(packing.pack(docs.select(COLUMNS), public_tokenizers.path("byte_bpe_50k.tiktoken")))


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", duplicates), ("pii", private), ("packing", packed)]

#: Classifiers, tokens and keyed permutations have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
