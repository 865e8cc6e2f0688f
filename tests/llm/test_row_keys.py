"""One row of each group stays, though ids are null or repeat."""

from pyspark.sql import functions as F
from quern.llm import simhash


def test_rows_without_own_id(spark):
    """One null-id row that heads its group; a null-id copy of a document that stays; an id that heads one group and
    is a copy in another; rows alike in everything."""
    a, b, c, d = ("alpha beta gamma delta epsilon", "one two three four five six", "red green blue black white grey", "north south east west up down")
    rows = [(5, a, 1), (None, a, 2), (None, a, 3), (None, b, 4), (3, c, 5), (7, c, 6), (7, d, 7), (7, d, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, v int")
    for kept in (simhash.keep_one(docs), simhash.keep_one(docs.repartition(5))):
        assert kept.columns == docs.columns
        assert sorted(tuple(r) for r in kept.where(F.col("doc_id").isNotNull()).collect()) == [(3, c, 5), (5, a, 1), (7, d, 7)]
        assert [tuple(r) for r in kept.where(F.col("doc_id").isNull()).collect()] == [(None, b, 4)]
