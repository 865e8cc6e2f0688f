"""Small graphs are settled in a few jobs; writes leave no shuffle files behind."""

import os
import random

from quern.llm.shared import connected_components, written

SHUFFLE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def chain():
    random.seed(5)
    ids = list(range(-300, 700))
    random.shuffle(ids)
    return list(zip(ids, ids[1:], strict=False)) + [(9000 + k, 9000) for k in range(50)] + [(None, 1), (8, 8)]


def test_small_graph_takes_few_jobs(spark):
    edges = spark.createDataFrame(chain(), "a long, b long")
    spark.sparkContext.setJobGroup("small-graph", "")
    found = {r.node: r.component for r in connected_components(edges).collect()}
    spark.sparkContext.setJobGroup("", "")
    assert found == {k: -300 for k in range(-300, 700)} | {k: 9000 for k in range(9000, 9050)}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("small-graph")) <= 10


def test_rounds_and_one_task_agree(spark):
    edges = spark.createDataFrame(chain(), "a long, b long")
    want = sorted(connected_components(edges).collect())
    assert all(sorted(connected_components(edges, at_once=n).collect()) == want for n in (0, 100))
    assert connected_components(edges.where("a > 10000")).count() == 0


def shuffle_files(spark):
    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(x.startswith("shuffle_") for top in root for _, _, names in os.walk(top.getPath()) for x in names)


def test_writes_leave_no_shuffle_files(spark):
    before, had = shuffle_files(spark), spark.conf.get(SHUFFLE, None)
    table = written(spark.range(2000).repartition(4, "id").groupBy("id").count(), "counted")
    assert shuffle_files(spark) <= before
    assert table.count() == 2000 and spark.conf.get(SHUFFLE, None) == had


def test_driver_gets_bits_and_no_strings(spark):
    """What training sends to the driver for each labelled row: its id, labels and a bit for each word chosen."""
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    from quern.llm import toxicity

    sent, collect = [], Frame.collect
    Frame.collect = lambda self: sent.append(dict(self.dtypes)) or collect(self)
    try:
        docs = spark.createDataFrame([(k, f"word{k % 7} fine{k % 3} " + "vile " * (k % 2)) for k in range(60)], "doc_id long, text string")
        labels = spark.createDataFrame([(k, k % 2, 1) for k in range(60)], "doc_id long, toxic int, quality int")
        chain = toxicity.train(docs, labels)
    finally:
        Frame.collect = collect
    assert "array<string>" not in {kind for frame in sent for kind in frame.values()}
    assert [bool(p > 0.5) for p in chain.score(["vile word1", "fine1 word1"])[:, -1]] == [True, False]
