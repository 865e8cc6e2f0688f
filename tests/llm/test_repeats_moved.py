"""What removal of repeats moves and leaves: no text goes to its documents, no shuffle file stays."""

import re

import numpy as np

from quern.llm import passages, suffix_dedup
from tests.llm.test_small_graphs import shuffle_files


def test_texts_are_not_shuffled_to_their_documents(spark):
    same = "a passage that stands twice " * 30
    rows = [(1, same), (2, same), (3, "x" + same + "y"), (4, "short"), (4, "short"), (None, None), (5, "é" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before, limit = shuffle_files(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = suffix_dedup.remove_repeats(docs)
        assert shuffle_files(spark) <= before
        plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)
        assert moved and not any(re.search(r"\b(text|kept)#", x) for x in moved)
        got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    n = len(same)
    assert [g[:2] for g in got] == [(0, 0), (1, n), (2, n), (3, n + 2), (4, 5), (4, 5), (5, 600)]
    assert [g[2:] for g in got] == [(0, 0), (n, 1), (n, 1), (n, 1), (0, 0), (0, 0), (600, 1)]


def test_powers_kept():
    for count in (1, 5, 300, (1 << 18) + 3, 7):
        want = np.ones(count, np.uint64)
        np.cumprod(np.r_[np.uint64(1), np.full(count - 1, passages.ODD, np.uint64)], out=want)
        assert (passages.powers(passages.ODD, count) == want).all()
