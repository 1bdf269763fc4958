"""Tables that grow with the input and aren't broadcast, whatever Spark estimates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import queries


@pytest.fixture
def documents(spark, tmp_path):
    """A folder with 20,000 different texts in documents. Spark's threshold is as it comes, and a larger broadcast than 64 MB fails.

    A few thousand rows can take 32 MB, since that is a page here."""
    words = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.md5(F.concat_ws("-", "doc_id", k)))
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id").withColumn("text", F.concat_ws(" ", words))
    docs.withColumns({"lang": F.lit("en"), "source": F.lit("web"), "n_chars": F.length("text").cast("long")}).write.parquet(f"{tmp_path}/documents.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.maxBroadcastTableSize")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "64m")
    yield str(tmp_path)
    for k, v in before.items():
        spark.conf.set(k, v)


def test_pipeline_looks_up_fingerprints_without_broadcasting_them(spark, documents):
    docs = spark.read.parquet(f"{documents}/documents.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, documents)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0 and kept.count() == 20_000


def test_op2_looks_up_fingerprints_without_broadcasting_them(spark, documents):
    found = queries.QUERIES["op2_simhash_near_dedup"](spark, documents)
    assert found.where("doc_id = component_id").count() == 20_000


@pytest.fixture
def near_copies(spark, tmp_path):
    """A folder with 400 texts in groups of ten near copies and 40 rows of exact ones. Spark may broadcast what is under 10 MB, but every broadcast fails."""
    word = F.expr("transform(sequence(1, 120), k -> if(k = 120 - doc_id % 10, concat('w', doc_id % 10), substr(md5(concat_ws('-', doc_id div 10, k)), 1, 7)))")
    docs = spark.range(400).withColumnRenamed("id", "doc_id").withColumn("text", F.concat_ws(" ", word))
    docs = docs.unionByName(docs.where("doc_id % 10 = 3").withColumn("doc_id", F.col("doc_id") + 1000))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.maxBroadcastTableSize")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    yield str(tmp_path)
    for k, v in before.items():
        spark.conf.set(k, v)


def test_op2_finds_classes_of_near_copies_without_any_broadcast(spark, near_copies):
    rows = queries.QUERIES["op2_simhash_near_dedup"](spark, near_copies).collect()
    assert len(rows) == 440
    ids, bits = np.array([r.doc_id for r in rows]), np.array([int(r.fingerprint, 16) for r in rows], np.uint64)
    linked, named, before = np.bitwise_count(bits[:, None] ^ bits) <= 3, ids, None
    while before is None or (named != before).any():
        named, before = np.where(linked, named, ids.max()).min(axis=1), named
    assert [r.component_id for r in rows] == named.tolist()
    several = [len(set(bits[named == c].tolist())) for c in set(named.tolist())]
    assert max(several) > 2 and len(several) < 360
