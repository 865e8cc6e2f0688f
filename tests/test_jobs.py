import gzip
import io
import os
import zipfile

from pyspark.sql import functions as F

from quern.operators.codecs import Options
from quern.operators.repack import repack
from quern.operators.sink import backup_names, commit
from quern.plans.summary import bulk_summary, doctor, exit_code, legacy_view
from quern.sources.files import inventory, read_binary, with_content

TEXT = b"Seven grey geese went by. " * 60


def zipped(*members):
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as archive:
        for name, data in members:
            archive.writestr(name, data)
    return sink.getvalue()


def run(spark, rows, **how):
    return {r.path: r for r in repack(spark.createDataFrame(rows, "path string, content binary"), Options(**how)).collect()}


def test_repack(spark):
    inner = zipped((".dot", TEXT), ("a.gz", gzip.compress(TEXT, 1)))
    rows = [
        ("x.json", b'{ "hello": "world",\n "n": 1 }'), ("n.epub", zipped(("mimetype", b"application/epub+zip"), ("in.cbz", inner))), ("p.zip", inner), ("z.apk", inner),
        ("u.txt", b"x"), ("n.png", b"\x89PNG"), ("bad.docx", b"PK"), ("nul.json", None), ("bad.json", b"{"), (".git/a.json", b"[1, 2]")]
    out = run(spark, rows)
    assert out["x.json"].content == b'{"hello":"world","n":1}' and out["x.json"].status == "packed"
    assert {p: out[p].reason for p in ("p.zip", "z.apk", "u.txt", "n.png", "bad.docx", "nul.json", "bad.json", ".git/a.json")} == {
        "p.zip": "zip skipped", "z.apk": "signed", "u.txt": "unsupported", "n.png": "tool missing", "bad.docx": "damaged", "nul.json": "no content", "bad.json": "no output", ".git/a.json": "excluded directory"}
    with zipfile.ZipFile(io.BytesIO(out["n.epub"].content)) as outer:
        assert outer.namelist() == ["mimetype", "in.cbz"]
        with zipfile.ZipFile(io.BytesIO(outer.read("in.cbz"))) as archive:
            assert archive.read(".dot") == TEXT and gzip.decompress(archive.read("a.gz")) == TEXT
    assert (out["n.epub"].inner_count, out["n.epub"].outsize) == (1, len(out["n.epub"].content))


def test_options(spark):
    book = zipped(("in.cbz", zipped(("t", TEXT))), ("a.json", b"[1,  2]"))
    dry = run(spark, [("b.epub", book)], dryrun=True)["b.epub"]
    real = run(spark, [("b.epub", book)])["b.epub"]
    assert (dry.outsize, dry.replaced, dry.content) == (real.outsize, False, book) and real.replaced
    assert run(spark, [("b.epub", book)], max_extract_bytes=10)["b.epub"].reason == "over extract limit"
    assert run(spark, [("b.epub", book)], max_depth=0)["b.epub"].reason == "too deep"
    assert run(spark, [("b.epub", book)], pack_archives=False)["b.epub"].inner_count == 1
    assert run(spark, [("a.json", b"[1, 2]")], min_savings=50.0)["a.json"].reason == "not smaller"
    assert run(spark, [("a.json", b"[1, 2]")], exclude=("json",))["a.json"].status == "skipped"
    assert run(spark, []) == {}


def test_folder_to_folder(spark, tmp_path):
    for name, data in {"a/x.json": b"[1,  2]", "b/x.json": b"[3,  4]", ".hid.json": b"[5,  6]", "node_modules/y.json": b"[ ]", "c/a_x.json": b"[ 1]"}.items():
        os.makedirs(tmp_path / "in" / os.path.dirname(name), exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    files = inventory(spark, str(tmp_path / "in"))
    assert sorted(r.rel_path for r in files.collect()) == [".hid.json", "a/x.json", "b/x.json", "c/a_x.json"]
    assert inventory(spark, str(tmp_path / "in"), recursive=False).count() == 1
    assert inventory(spark, str(tmp_path / "in"), exclude_dirs="b").count() == 3
    assert read_binary(spark, str(tmp_path / "in"), "*.json").count() == 4  # Spark's own reader: no dot-files, nothing pruned
    out = repack(with_content(files).select("path", "content"))
    planned = backup_names(out, str(tmp_path / "bak"))
    assert sorted(os.path.basename(r.backup_path) for r in planned.collect()) == [".hid.json", "a_x.json", "b_x.json", "x.json"]
    kept = planned.cache()
    assert sorted(r.written for r in commit(kept).collect()) == [True] * 4
    assert (tmp_path / "in/a/x.json").read_bytes() == b"[1,2]" and (tmp_path / "bak/x.json").read_bytes() == b"[1,  2]"
    assert [r.written for r in commit(kept).collect()] == [False] * 4  # again: nothing to do
    assert not [f for d, _, fs in os.walk(tmp_path / "in") for f in fs if f.startswith(".new-")]


def test_reports(spark):
    rows = spark.createDataFrame([("a", "packed", 100, 80, 20.0), ("b", "kept", 50, 50, 0.0), ("c", "skipped", 9, 9, 0.0)], "path string, status string, insize long, outsize long, savings_pct double")
    total = bulk_summary(rows).first()
    assert (total.files_processed, total.files_skipped, total.total_saved) == (2, 1, 20) and abs(total.percent_saved - 40 / 3) < 1e-9
    assert bulk_summary(rows.limit(0)).first().percent_saved == 0.0
    view = legacy_view(rows.where("path = 'a'")).first()
    assert view.stats == [1, 100, 80] and view.final == [100.0, 80.0, 20.0]
    assert doctor(spark).where(F.col("status").startswith("missing (required)")).count() <= 1
    assert (exit_code(0, True), exit_code(1, True), exit_code(1, False)) == (0, 2, 1)


def test_arrivals(spark, tmp_path):
    from quern.streaming.arrivals import pack_arrivals

    (tmp_path / "in").mkdir()
    for round_, names in enumerate((("a.json", "b.txt"), ("c.json",))):
        for name in names:
            (tmp_path / "in" / name).write_bytes(b"[1,  2]")
        query = pack_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination(120)
        found = {r.path.rpartition("/")[2]: r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert len(found) == 2 + round_ and found["a.json"] == "packed" and found["b.txt"] == "skipped"


def test_bulk(spark, tmp_path):
    from quern.plans.bulk import bulk

    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/a.json").write_bytes(b"[1,  2]")
    (tmp_path / "in/b.txt").write_bytes(b"text")
    results, total = bulk(spark, str(tmp_path / "in"), Options(dryrun=True))
    assert (tmp_path / "in/sub/a.json").read_bytes() == b"[1,  2]" and total.first().total_saved == 2
    bulk(spark, str(tmp_path / "in"), output_dir=str(tmp_path / "out"))
    assert (tmp_path / "out/sub/a.json").read_bytes() == b"[1,2]" and (tmp_path / "out/b.txt").read_bytes() == b"text"
    results, total = bulk(spark, str(tmp_path / "in"), backup=True)
    assert (tmp_path / "in/sub/a.json.bak").read_bytes() == b"[1,  2]" and (tmp_path / "in/sub/a.json").read_bytes() == b"[1,2]"
    assert {r.path.rpartition("/")[2]: r.status for r in results.collect()} == {"a.json": "packed", "b.txt": "skipped"}


def test_standalone(spark):
    from quern.operators.repack import folder_totals, repack_standalone

    rows = spark.createDataFrame([("a.json", b"[1,  2]"), ("b.docx", zipped(("a.json", b"[1,  2]"))), ("c.txt", b"x")], "path string, content binary")
    assert [(r.path, r.status) for r in repack_standalone(rows).collect()] == [("a.json", "packed")]
    total = folder_totals(repack_standalone(rows.union(spark.createDataFrame([("bad.json", b"{")], rows.schema)))).first()
    assert (total.inner_count, total.total_insize, total.total_outsize) == (1, 7, 5)
