"""A training corpus from the documents table, in five stages.

Each stage works on what its predecessor kept; all but the last return the columns of documents. ``run`` writes each
stage's rows as Parquet into the shared folder, rereads them for the next, and then deletes those of the stage before.

Every stage keeps all columns of documents, whatever others there are, but the last, whose result is pieces. Rows with nulls in any column go through:
a null text has no features, no letters (the language stage drops it), an empty fingerprint, no words to take and one token. Ties go by doc_id, text and
then the other columns; repeated rows are near duplicates of each other; very long texts are read whole. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import curriculum, langid, packing, simhash, toxicity
from eventloom.llm.common import read, remove, scratch, ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't find toxic."""
    ship(spark)
    return toxicity.keep_clean(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a mixture of the learned languages, one or several, explains better than letters at random."""
    ship(spark)
    return langid.keep_known(docs, langid.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each class of near duplicates; of several with that id, the smallest text."""
    ship(spark)
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as its source's target takes it."""
    ship(spark)
    return curriculum.training_order(docs, position=None)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned verdicts and fingerprints can't be had in SQL; tests hold each stage, and run, against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    top, before = scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if before:
            remove(spark, before)
        before = f"{top}/{name}"
    return docs
