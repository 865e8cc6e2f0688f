"""The pipeline against the same stages worked out one by one."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import mixing, pii, toxicity

from .test_operators import WORDS
from .test_shingle_dedup import alike_groups

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "pii", "mixing", "packing"]
    toxic, near, mask, mixed, packed = (f for _, f in corpus_pipeline.STAGES)
    kept = toxic(spark, docs, SF)
    chain = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    judged = {r.doc_id: r.toxic for r in toxicity.judge_toxicity(docs, chain).collect()}
    rows = sorted((r.doc_id, r.text) for r in kept.collect())
    assert [i for i, _ in rows] == sorted(i for i, t in judged.items() if not t) and any(judged.values())
    one = near(spark, kept, SF)
    assert one.columns == docs.columns
    # the stage's rule: five-word shingles, Jaccard similarity 0.8 or more; op10's own contract is tested with op10
    root = alike_groups([t for _, t in rows])
    assert sorted(r.doc_id for r in one.collect()) == sorted(rows[k][0] for k in set(root))
    clean = mask(spark, one, SF)
    assert clean.columns == docs.columns and clean.count() == one.count()
    left = pii.pii_report(clean).agg(*[F.sum(c).alias(c) for c in ("n_email", "n_ip", "n_card", "n_phone")]).first()
    assert sum(left) == 0
    mix = mixed(spark, clean, SF)
    assert mix.columns == docs.columns
    took, want = {}, {}
    for r in mix.collect():
        took[r.doc_id] = took.get(r.doc_id, 0) + len(WORDS.findall(r.text))
    for r in mixing.mix(clean).collect():
        want[r.doc_id] = r.taken
    assert took == {k: v for k, v in want.items() if v}


def test_run(spark):
    pieces = corpus_pipeline.run(spark, SF).collect()
    sizes: dict = {}
    for r in pieces:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert pieces and max(sizes.values()) <= 1024 and np.mean(list(sizes.values())) > 0.9 * 1024


def test_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and blank texts, repeated rows, clashing columns, no labels that count; empty tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars int, row string, fp string, component string"
    rows = [(1, None, None, None, None, "r", "f", "c"), (None, "", "en", "a", 0, None, None, None), (3, "a few plain words, mail me at x@y.org", "en", "a", 37, "r", "f", "c"), (3, "a few plain words, mail me at x@y.org", "en", "a", 37, "r", "f", "c"),
            (None, "no id at all here", None, "b", 17, "r", None, "c"), (5, " \t\n", "en", "b", 3, "r", "f", "c"), (6, "long " * 4000 + "end", "en", None, 20_003, "r", "f", "c")]
    for name, docs in (("odd", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(None, None, 1), (99, 1, None), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        pieces = corpus_pipeline.run(spark, folder).collect()
        # a source of a few words may be given no block of 32
        assert {r.doc_id for r in pieces} - {None, 3} == ({6} if docs else set())
        assert all(len(r.ids) == r.length for r in pieces)
