"""Bounds: decoding budgets, scratch space, options; totals with failures; attributes that a rewrite keeps."""

import gzip
import io
import os
import resource
import tarfile
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.functions import markup
from quern.operators import codecs, containers
from quern.operators.codecs import Options
from quern.plans.bulk import bulk
from quern.plans.summary import bulk_summary
from quern.plans.tables import shared_folder
from quern.sources.files import inventory


def bomb(mib):
    """A gzipped tar of one member of zeros."""
    sink = io.BytesIO()
    with gzip.GzipFile(fileobj=sink, mode="wb", compresslevel=9) as zipped, tarfile.open(fileobj=zipped, mode="w|") as archive:
        info = tarfile.TarInfo("zeros")
        info.size = mib << 20
        archive.addfile(info, io.BytesIO(bytes(mib << 20)))
    return sink.getvalue()


def test_budget():
    data = bomb(300)
    budget = Options().extract_budget(len(data))
    before, begun = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    assert containers.declared_size("tar.gz", data, budget) > budget
    assert codecs.decoded("gz", data, budget) is None
    assert time.perf_counter() - begun < 5 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 90 << 10
    assert containers.declared_size("tar.gz", bomb(1), 2 << 20) == 1 << 20
    assert Options(max_extract_bytes=0, max_extract_ratio=0).extract_budget(5) is None and Options(max_extract_bytes=7).extract_budget(5) == 7


def test_options():
    for wrong in ({"compression_level": 10}, {"jpeg_quality": 0}, {"png_quality": "best"}, {"pdf_profile": "ultra"}, {"min_size": 9, "max_size": 5}, {"min_savings": -1.0}):
        with pytest.raises(ValueError):
            Options(**wrong)
    assert Options(pdf_profile="/Ebook", jpeg_quality=1).keep_meta is False


def test_zip_keeps_remarks():
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as archive:
        info = zipfile.ZipInfo("a.txt")
        info.comment, info.extra = b"of a member", b"\x99\x99\x02\x00ab"
        archive.writestr(info, b"text")
        archive.comment = b"of all"
    some = list(containers.members("zip", sink.getvalue()))
    with zipfile.ZipFile(io.BytesIO(containers.rebuilt("zip", some, 9, containers.comment(sink.getvalue())))) as again:
        assert (again.comment, again.infolist()[0].comment, again.infolist()[0].extra) == (b"of all", b"of a member", b"\x99\x99\x02\x00ab")
    with zipfile.ZipFile(io.BytesIO(containers.rebuilt("zip", some, 9, b"", True))) as bare:
        assert bare.infolist()[0].extra == b""


def test_exact_numbers():
    assert markup.json_minified(b'{"a" : 12345678901234567890.5,  "b": "x  y\\" z" }') == b'{"a":12345678901234567890.5,"b":"x  y\\" z"}'
    assert markup.json_minified(b'[1e5, 0.1,  -2.50]') == b"[100000.0,0.1,-2.5]"


def test_totals_with_failures(spark):
    rows = spark.createDataFrame([("a", "packed", 100, 80), ("b", "failed", 1000, 10), ("c", "skipped", 50, 50), ("d", "packed", 40, 30)], "path string, status string, insize long, outsize long")
    on, off = bulk_summary(rows).first(), bulk_summary(rows, continue_on_error=False).first()
    assert (on.files_processed, on.files_failed, on.files_skipped, on.total_saved) == (2, 1, 1, 30)
    assert (off.files_processed, off.files_failed, off.files_skipped, off.total_saved, off.percent_saved) == (1, 1, 0, 20, 20.0)


def size_below(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs)


def test_bulk_leaves_no_bytes(spark, tmp_path):
    """Files that are passed over are never read into tables, and nothing of the work is left but the results."""
    big = os.urandom(2 << 20)
    os.makedirs(tmp_path / "in/deep/er")
    (tmp_path / "in/big.txt").write_bytes(big)
    (tmp_path / "in/deep/er/a.json").write_bytes(b"[1,  2]")
    with zipfile.ZipFile(tmp_path / "in/deep/b.epub", "w") as archive:
        archive.writestr("t.json", b"[1,  " + b" " * 4000 + b"2]")
    folder = shared_folder(spark).removeprefix("file:")
    before = size_below(folder)
    results, total = bulk(spark, str(tmp_path / "in"), Options(), output_dir=str(tmp_path / "out"))
    assert (tmp_path / "out/big.txt").read_bytes() == big and (tmp_path / "out/deep/er/a.json").read_bytes() == b"[1,2]"
    assert size_below(folder) - before < 100_000
    found = {r.path.rpartition("/")[2]: (r.status, r.reason, r.inner_count) for r in results.collect()}
    assert found == {"big.txt": ("skipped", "unsupported", 0), "a.json": ("packed", "", 0), "b.epub": ("packed", "", 1)}
    assert total.first().files_processed == 2


def test_unwritable(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_bytes(b"[1,  2]")
    (tmp_path / "out").write_bytes(b"a file where a folder should be")
    _, total = bulk(spark, str(tmp_path / "in"), output_dir=str(tmp_path / "out"))
    assert (total.first().files_failed, total.first().files_processed, total.first().total_saved) == (1, 0, 0)


def test_listing_is_spread(spark, tmp_path):
    for k in range(12):
        os.makedirs(tmp_path / f"one/sub{k}/more")
        (tmp_path / f"one/sub{k}/more/f").write_bytes(b"x")
    listed = inventory(spark, str(tmp_path))
    assert listed.count() == 12 and listed.select(F.spark_partition_id()).distinct().count() >= 12


def test_pages_hold_many_rows(spark, tmp_path):
    """Pages are few, as each costs a compressor's set-up."""
    import pyarrow.parquet as pq

    from quern.sources.recompress import recompress_parquet

    spark.range(0, 400_000, 1, 1).selectExpr("id", "id % 7 as few").coalesce(1).write.parquet(str(tmp_path / "in"))
    made = recompress_parquet(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert made.count() == 400_000 and made.selectExpr("sum(id)").first()[0] == 400_000 * 399_999 // 2
    pages = 0
    for name in os.listdir(tmp_path / "out"):
        if name.endswith(".parquet"):
            group = pq.ParquetFile(tmp_path / "out" / name).metadata.row_group(0)
            offsets = [group.column(k).has_offset_index for k in range(2)]
            assert all(offsets)
            data = (tmp_path / "out" / name).read_bytes()
            pages += data.count(b"\x28\xb5\x2f\xfd")  # frames of zstd: one for each page and dictionary
    assert pages <= 4 * spark.sparkContext.defaultParallelism


def test_workers_give_memory_back(spark):
    """Memory that a column's function used is given back as batches pass, and batches are bounded."""
    from quern.plans import catalog

    catalog.stream_roundtrip("lz4")(spark, "/root/testdata/sf0.001").count()
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    from quern.operators import worker

    calls, before = [], worker.release
    worker.release = lambda: calls.append(1)
    try:
        import pyarrow as pa

        column = pa.array([bytes(1 << 20)] * 8, pa.binary())
        for _ in range(8):
            worker.leanly(lambda x: x)(column)
        assert len(calls) >= 3
        assert list(worker.lean(lambda batches: batches)(iter([pa.record_batch([column], ["a"])] * 8))) and len(calls) >= 5
    finally:
        worker.release = before


def test_small_payloads_are_decoded_once(monkeypatch):
    seen, before = [], codecs.payload
    monkeypatch.setattr(codecs, "payload", lambda kind, data: (seen.append(kind), before(kind, data))[1])
    data = b"some text " * 1000
    for kind in ("gz", "xz", "bz2", "lzma", "zst", "br", "lz4"):
        seen.clear()
        stream = codecs.quickly_encoded(kind, data)
        made = codecs.stream(kind)(stream, Options())
        assert len(seen) == 2 and codecs.decoded(kind, made) == data
    monkeypatch.setattr(codecs, "HELD", 100)
    assert codecs.decoded("lzma", codecs.stream("lzma")(codecs.quickly_encoded("lzma", data), Options())) == data
    assert codecs.stream("gz")(b"not gzip", Options()) is None
