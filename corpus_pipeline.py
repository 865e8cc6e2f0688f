"""A corpus made ready for training: toxic documents go, near-duplicates go, personal data is masked, sources are
mixed to their weights, and what is left is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.mixing import mixed
from quern.llm.packing import pack
from quern.llm.pii import mask_pii
from quern.llm.shared import written
from quern.llm.shingle_dedup import keep_one_alike
from quern.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not judged toxic by a chain fitted on the labels of these documents. A null text is judged as an empty
    one; without usable labels nothing is toxic; null ids, repeated rows and other columns go along; empty in, empty out."""
    return drop_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents alike (five-word shingles, Jaccard similarity 0.8 or more): the one of smallest
    id, null ids last. Texts without words, null ones among them, are one group; empty in, empty out."""
    return keep_one_alike(docs, width=5)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its personal data replaced by the name of its kind. Null texts stay null, repeated rows and
    null ids are treated like any; empty in, empty out."""
    return mask_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document. A null source is a source of its own, last in order; a text
    that is null or has no words is not taken; empty in, empty out."""
    return mixed(docs, weights=(1, 2, 3), most=3)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences, with their ids. A null text is an end id alone, a null id stays null, a
    repeated row is packed again; empty in, empty out."""
    return pack(docs, max_tokens=1024)


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: SQL cannot express a trained chain, SimHash groups or the packing; the tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
