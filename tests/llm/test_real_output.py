"""Operators give what they make, not only digests of it."""

import zlib

import numpy as np
from pyspark.sql import functions as F
from quern.llm import bpe, packing, queries, suffix_dedup

SF = "/root/testdata/sf0.001"


def test_packed_ids(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").union(spark.createDataFrame([(900, None, "", "", 0)], "doc_id long, text string, lang string, source string, n_chars int")).repartition(2)
    found, pieces = packing.pack(docs, max_tokens=256).collect(), {}
    for r in found:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert {k: [x for _, ids in sorted(v) for x in ids] for k, v in pieces.items()} == {
        r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    assert "ids" not in queries.op7_packing(spark, SF).columns


def test_cut_texts(spark):
    line = "A passage of more than forty bytes, é, in two documents. "
    texts = [f"first {line}end", f"{line}other", "w" * 50, "w" * 50, None, "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (bytes(r.kept), [tuple(x) for x in r.spans]) for r in suffix_dedup.cut_repeats(docs, 40).collect()}
    n = len(line.encode())
    assert found == {0: (b"first end", [(6, 6 + n)]), 1: (b"other", [(0, n)]), 2: (b"", [(0, 50)]), 3: (b"", [(0, 50)]), 4: (b"", []), 5: (b"short", [])}


def test_pipeline_ids(spark):
    import corpus_pipeline

    pieces = corpus_pipeline.packing(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(20), SF)
    assert pieces.where(F.size("ids") != F.col("length")).count() == 0
