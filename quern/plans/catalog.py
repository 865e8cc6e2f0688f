"""Queries over the test tables. The tables hold no files, so files are made of their columns: names from ids, contents
from texts and JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import registry as R
from quern.functions import plan, sizes
from quern.functions.decide import decision, savings_pct
from quern.functions.filters import category, exceeds_extract_limit, in_excluded_dir, is_plain_zip, media_gate, nested_gate, skip_reason
from quern.functions.identify import basename, compound_suffix, ext_keys, is_supported, kind, last_ext, looks_like_tar
from quern.functions.markup import image_uris, xml_without_gaps
from quern.functions.verify import is_pdf_header, verify
from quern.operators import codecs
from quern.operators.repack import best_candidate, dicom_is_packable, opened, packed, repack, with_name_reason
from quern.operators.sink import backup_names
from quern.operators.worker import leanly, spent
from quern.plans.summary import bulk_summary, container_totals, csv_rows, legacy_files, legacy_view, rates
from quern.plans.tables import bounded_batches, shared_folder, written

#: Extensions that the made-up names go through: all that are known, compounds, and some that are not.
NAMES = [*R.ARCHIVES, *R.STANDALONE, *R.COMPOUND, "txt", "deb", "otf", "TAR.GZ", "Jpeg", ""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, size): a name for every document; some lie in folders that are pruned."""
    ext = F.element_at(F.array(*[F.lit(x) for x in NAMES]), (F.col("doc_id") % len(NAMES) + 1).cast("int"))
    top = F.element_at(F.array(*[F.lit(x) for x in ("data", "Docs", "node_modules", "venv", "a\\b")]), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(top, F.lit("/"), F.col("source"), F.lit("/File"), F.col("doc_id").cast("string"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.octet_length("text").cast("long").alias("size"))


def identify_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).withColumn("kind", kind(F.col("path"))).select(
        "doc_id", basename(F.col("path")).alias("name"), last_ext(F.col("path")).alias("ext"), compound_suffix(F.col("path")).alias("compound"),
        F.col("kind.key").alias("key"), F.col("kind.family").alias("family"), F.col("kind.packer").alias("packer"), F.col("kind.is_archive").alias("is_archive"), is_supported(F.col("path")).alias("supported"))


def family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).withColumn("kind", kind(F.col("path"))).groupBy(F.coalesce("kind.family", F.lit("unsupported")).alias("family")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def ext_key_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select("doc_id", F.array_join(ext_keys(F.col("path")), ",").alias("keys"))


def filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = skip_reason(F.col("path"), F.col("size"), 500, 20000, (".docx", "gz", "jpg", "xml", "zip", "tar.xz"), ("kml", "tgz"))
    return paths(spark, sf_dir).select("doc_id", reason.alias("reason"), (reason == "").alias("keep"))


def dir_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select("doc_id", in_excluded_dir(F.col("path"), ("src3",)).alias("pruned"), is_plain_zip(F.col("path")).alias("plain_zip"))


def category_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paths(spark, sf_dir).withColumn("packer", kind(F.col("path"))["packer"])
    return rows.groupBy(F.coalesce(category(F.col("packer")), F.lit("none")).alias("category")).agg(F.count(F.lit(1)).alias("files"), F.count_if(media_gate(F.col("packer"), False)).alias("without_media"))


#: First bytes that verification meets: every prefix, and others right and wrong.
STARTS = [*R.PREFIXES.values(), b"II*\0", b"MM\0*", b"RIFF", b"\x1a\x45\xdf\xa3", b"  \n<a/>", b"\xef\xbb\xbf<a/>", b" {", b"[", b"P6", b"\x0a", b"\x47", b"\xff\x0a", b"....ftypjp2 ", b"CDF", b"ID3", b"\xff\xfb", b"nothing here", b""]
KINDS = [*R.PREFIXES, "tif", "webp", "mkv", "xml", "json", "pnm", "pcx", "ts", "jxl", "jp2", "nc", "mp3", "avif", "mp4", "tga", "lzma", "wv", "arrow", "unknown"]


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.element_at(F.array(*[F.lit(x) for x in STARTS]), (F.col("doc_id") % len(STARTS) + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (F.floor(F.col("doc_id") / 3) % len(KINDS) + 1).cast("int"))
    body = F.when(F.col("doc_id") % 7 == 0, F.lit(b"")).otherwise(F.encode("text", "utf-8"))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("kind"), F.concat(start, body).alias("content"))


def magic_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents(spark, sf_dir).select("doc_id", "kind", verify(F.col("kind"), F.col("content")).alias("valid"))


def tar_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.encode(F.rpad(F.regexp_replace(F.substring("text", 1, 200), "[^ -~]", "?"), 257, "\0"), "utf-8")
    tail = F.when(F.col("doc_id") % 3 == 0, F.lit(b"ustar\x0000")).when(F.col("doc_id") % 3 == 1, F.lit(b"usta")).otherwise(F.lit(b"xustar00"))
    return table(spark, sf_dir, "documents").select("doc_id", looks_like_tar(F.concat(lead, tail)).alias("is_tar"))


def _json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.lit("json").alias("packer"), F.encode("props", "utf-8").alias("content"))
    return packed(rows, codecs.Options()).withColumn("insize", F.octet_length("content").cast("long")).withColumn("outsize", F.octet_length("packed").cast("long"))


def json_minify_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _json_files(spark, sf_dir).withColumn("d", decision(F.col("insize"), F.col("outsize"), verify(F.lit("json"), F.col("packed"))))
    total = rows.groupBy("event_type").agg(F.count("d").alias("files"), F.sum("d.insize").alias("insize"), F.sum("d.outsize").alias("outsize"))
    return total.withColumn("saved", F.col("insize") - F.col("outsize")).withColumn("pct", savings_pct(F.col("insize"), F.col("outsize")))


def json_minify_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _json_files(spark, sf_dir).select("event_id", F.decode("packed", "utf-8").alias("text"))


def _xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("<part>\n  <key>"), F.col("p_partkey").cast("string"), F.lit("</key>\r\n\t<name> "), F.col("p_name"), F.lit(" </name> <size>"), F.col("p_size").cast("string"), F.lit("</size>\n\n</part>"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


def xml_minify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the packer, and by the expression that it amounts to on well-formed texts."""
    rows = packed(_xml(spark, sf_dir).select("p_partkey", "text", F.lit("xml").alias("packer"), F.encode("text", "utf-8").alias("content")), codecs.Options())
    return rows.select("p_partkey", F.decode("packed", "utf-8").alias("packed"), xml_without_gaps(F.col("text")).alias("minified"))


def data_uri_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind_ = F.element_at(F.array(*[F.lit(x) for x in ("png", "JPEG", "svg+xml", "webp")]), (F.col("doc_id") % 4 + 1).cast("int"))
    body = F.base64(F.encode("text", "utf-8"))
    text = F.concat(F.lit("<img src='data:image/"), kind_, F.lit(";base64,"), body, F.lit("'/><img src='data:image/gif;base64,R0lGODlh'/>"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(image_uris(text)).alias("u"))
    return rows.select("doc_id", "u.subtype", F.octet_length("u.data").cast("long").alias("bytes"), F.lower(F.hex("u.data")).alias("data"))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes before and after as a codec might leave them: smaller, as large, larger, empty."""
    insize, k = F.octet_length("text").cast("long"), F.col("doc_id") % 10
    outsize = F.when(k == 0, insize).when(k == 1, insize + 7).when(k == 2, F.lit(0)).when(k == 3, F.lit(None)).otherwise((insize * (k + 85) / 100).cast("long"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), insize.alias("insize"), outsize.cast("long").alias("outsize"), (F.col("doc_id") % 13 != 0).alias("valid"))


def _decisions(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    d = decision(F.col("insize"), F.col("outsize"), F.col("valid"), **how)
    return _outcomes(spark, sf_dir).select("doc_id", "source", "path", d.alias("d"))


def commit_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).select("doc_id", "d.*")


def min_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir, min_savings=9.0, only_smaller=False).select("doc_id", "d.*")


def dryrun_vs_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    dry = decision(F.col("insize"), F.col("outsize"), F.col("valid"), dryrun=True)
    real = decision(F.col("insize"), F.col("outsize"), F.col("valid"))
    return _outcomes(spark, sf_dir).select(
        F.coalesce(dry["outsize"] == real["outsize"], F.lit(True)).alias("same_size"), F.coalesce(dry["replaced"], F.lit(False)).alias("dry"), F.coalesce(real["replaced"], F.lit(False)).alias("real"),
    ).groupBy("same_size", "dry", "real").agg(F.count(F.lit(1)).alias("files"))


def best_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, k = F.octet_length("text").cast("long"), F.col("doc_id")
    three = F.array(*[F.struct(F.lit(n).alias("ordinal"), F.lit(tool).alias("tool"), size.cast("long").alias("size")) for n, (tool, size) in enumerate(
        [("first", base - k % 3), ("second", F.when(k % 4 != 0, base - k % 5)), ("third", base - k % 2)])])
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(three).alias("c")).select("doc_id", "c.*")
    return best_candidate(rows, F.col("doc_id"), F.col("size"), F.col("ordinal"), "tool")


def extract_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = F.octet_length("text").cast("long")
    unpacked = F.when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise(original * (F.col("doc_id") % 140)).cast("long")
    return table(spark, sf_dir, "documents").select(
        "doc_id", exceeds_extract_limit(unpacked, original).alias("by_default"), exceeds_extract_limit(unpacked, original, 100_000, 50.0).alias("strict"), exceeds_extract_limit(unpacked, original, 0, 0.0).alias("off"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _decisions(spark, sf_dir).withColumn("status", F.when(F.col("doc_id") % 17 == 0, "skipped").otherwise("processed"))
    size = _outcomes(spark, sf_dir).select(F.col("doc_id").alias("k"), F.col("insize").alias("size"))
    rows = rows.join(size, F.col("doc_id") == F.col("k"))
    return rows.select("doc_id", "source", "path", "status", F.coalesce("d.insize", "size").alias("insize"), F.coalesce("d.outsize", "size").alias("outsize"), F.coalesce("d.savings_pct", F.lit(0.0)).alias("savings_pct"))


def bulk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bulk_summary(_results(spark, sf_dir))


def container_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container_totals(_results(spark, sf_dir).where("status <> 'skipped'"), "source")


def legacy_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = legacy_view(_results(spark, sf_dir), "source")
    return view.select("source", F.col("stats")[0].alias("n"), F.col("stats")[1].alias("insize"), F.col("stats")[2].alias("outsize"), F.col("final")[2].alias("pct"), "first_path")


def legacy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy_files(_results(spark, sf_dir), "source").select("source", "file.*")


def bulk_totals_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals with files that could not be written, for a run that goes on and for one that stops at the first of them."""
    rows = _results(spark, sf_dir).withColumn("status", F.when(F.col("doc_id") % 19 == 18, "failed").otherwise(F.col("status")))
    on, off = bulk_summary(rows), bulk_summary(rows, continue_on_error=False)
    return on.withColumn("went_on", F.lit(True)).unionByName(off.withColumn("went_on", F.lit(False)))


def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_rows(_results(spark, sf_dir))


SIZES = ["100", "1KB", "1.5 kb", "2GB", "", "1K", "3TB", "0.25MB", " 7B "]


def size_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*[F.lit(x) for x in SIZES]), (F.col("doc_id") % len(SIZES) + 1).cast("int"))
    size = (F.col("n_chars") * F.pow(F.lit(2.0), (F.col("doc_id") % 44).cast("double"))).cast("long")
    q, level = (F.col("doc_id") % 110).cast("int"), (F.col("doc_id") % 12).cast("int")
    return table(spark, sf_dir, "documents").select(
        "doc_id", sizes.parse_size(text).alias("parsed"), sizes.format_size(size).alias("shown"), sizes.jpeg_qfactor(q).alias("qfactor"), sizes.rar_method(level).alias("rar"),
        sizes.zip_level(level).alias("zip_level"), sizes.pdf_profile(F.concat(F.lit(" /"), F.element_at(F.array(F.lit("EBOOK"), F.lit("ultra")), (F.col("doc_id") % 2 + 1).cast("int")))).alias("profile"),
        F.array_join(sizes.ext_list(F.concat(F.lit(" .Docx,,"), F.col("source"), F.lit(" , ..x"))), "|").alias("exts"))


#: Codecs whose streams may follow each other in a file.
DOUBLED = ("gz", "xz", "bz2", "zst")


def stream_roundtrip(codec: str) -> Callable[[SparkSession, str], DataFrame]:
    """Each text as a stream of ``codec``, packed again, decoded: the text. Where the codec allows, the stream is made of
    two, which a packer that does its work makes one and smaller."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)

        @F.arrow_udf("binary")
        @leanly
        def wrap(text):
            import pyarrow as pa

            # the streams to be packed are made quickly; packing is what counts
            made = lambda data: codecs.quickly_encoded(codec, data)

            def one(data: bytes) -> bytes:
                cuts = [0, len(data) // 2, len(data)] if codec in DOUBLED else [0, len(data)]
                return b"".join(made(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
            return pa.array([one((x or "").encode()) for x in text.to_pylist()], pa.binary())

        @F.arrow_udf("string")
        @leanly
        def unwrap(data):
            import pyarrow as pa

            return pa.array([codecs.decoded(codec, x).decode() for x in data.to_pylist()], pa.string())

        rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(codec).alias("packer"), wrap("text").alias("content"))
        made = packed(rows, codecs.Options()).select("doc_id", unwrap("packed").alias("text"), (F.octet_length("packed") < F.octet_length("content")).alias("less"))
        return made.select("doc_id", "text", F.when(F.octet_length("text") >= 1000, F.col("less")).alias("smaller")) if codec in DOUBLED else made.select("doc_id", "text")
    return query


def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from quern.sources.recompress import recompress_parquet

    return recompress_parquet(spark, f"{sf_dir}/lineitem.parquet", f"{shared_folder(spark)}/parquet-{uuid.uuid4().hex}")


def orc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from quern.sources.recompress import recompress_orc

    return recompress_orc(spark, table(spark, sf_dir, "orders"), f"{shared_folder(spark)}/orc-{uuid.uuid4().hex}")


def _archives(spark: SparkSession, sf_dir: str, family: str, per: int = 25) -> DataFrame:
    """One archive for every ``per`` documents of a source: their texts as members, each fourth one gzipped."""
    import pandas as pd

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        import gzip
        import io
        import tarfile
        import zipfile

        sink = io.BytesIO()
        rows = [(f"{i}.txt" if i % 4 else f"{i}.gz", (t or "").encode()) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True)]
        rows = sorted((n, gzip.compress(t, 1, mtime=0) if n.endswith("gz") else t) for n, t in rows)
        if family == "zip":
            with zipfile.ZipFile(sink, "w") as archive:
                for name, data in rows:
                    archive.writestr(name, data)
        else:
            with tarfile.open(fileobj=sink, mode="w") as archive:
                for name, data in rows:
                    info = tarfile.TarInfo(name)
                    info.size = len(data)
                    archive.addfile(info, io.BytesIO(data))
        ext = "docx" if family == "zip" else "tar"
        spent(2 * sink.tell())
        return pd.DataFrame({"path": [f"{pdf['source'].iloc[0]}/{pdf['part'].iloc[0]}.{ext}"], "content": [sink.getvalue()]})

    bounded_batches(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.floor(F.col("doc_id") / (per * 20)).cast("long").alias("part"))
    return rows.groupBy("source", "part").applyInPandas(build, "path string, content binary")


def _walk(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """Members of archives made from the documents, counted by archive, before and after the archives are repacked."""
    files = written(_archives(spark, sf_dir, family), "archives")
    new = repack(files).select(F.col("path").alias("id"), F.lit(family).alias("family"), "content")
    plain = codecs.decoded
    @F.arrow_udf("long")
    @leanly
    def payload(path, content):
        import pyarrow as pa

        return pa.array([len(plain("gz", c)) if p.endswith(".gz") else len(c) for p, c in zip(path.to_pylist(), content.to_pylist(), strict=True)], pa.int64())
    return opened(new).withColumn("bytes", payload("path", "content")).groupBy(F.col("parent").alias("archive")).agg(F.count(F.lit(1)).alias("members"), F.sum("bytes").alias("bytes"))


def zip_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark, sf_dir, "zip")


def tar_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark, sf_dir, "tar")


def nested_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives within archives, repacked level by level: members with a result, by outer archive."""
    import pandas as pd

    def nest(pdf: pd.DataFrame) -> pd.DataFrame:
        import io
        import zipfile

        sink = io.BytesIO()
        with zipfile.ZipFile(sink, "w") as archive:
            for path, content in sorted(zip(pdf["path"], pdf["content"], strict=True)):
                archive.writestr(path.rpartition("/")[2], content)
        spent(2 * sink.tell())
        return pd.DataFrame({"path": [f"{pdf['source'].iloc[0]}-{pdf['shelf'].iloc[0]}.epub"], "content": [sink.getvalue()]})

    inner = written(_archives(spark, sf_dir, "zip"), "inner").withColumn("source", F.substring_index("path", "/", 1))
    inner = inner.withColumn("shelf", F.expr("cast(regexp_extract(path, '/([0-9]+)[.]', 1) as long) div 8"))
    outer = written(inner.groupBy("source", "shelf").applyInPandas(nest, "path string, content binary"), "outer")
    return repack(outer, keep_content=False).select("path", "status", "inner_count", (F.col("outsize") < F.col("insize")).alias("smaller"))


def sqlite_vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database with deleted rows for each source, vacuumed: its rows are still there."""
    import pandas as pd

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        import os
        import sqlite3
        import tempfile

        with tempfile.TemporaryDirectory() as scratch:
            base = sqlite3.connect(os.path.join(scratch, "a.db"))
            base.execute("create table t (id integer, text text)")
            base.executemany("insert into t values (?, ?)", zip(pdf["doc_id"].tolist(), pdf["text"].fillna("").tolist(), strict=True))
            base.execute("delete from t where id % 2 = 1")
            base.commit()
            base.close()
            with open(os.path.join(scratch, "a.db"), "rb") as file:
                return pd.DataFrame({"source": [pdf["source"].iloc[0]], "part": [int(pdf["part"].iloc[0])], "content": [file.read()]})

    @F.arrow_udf("struct<n:long,bytes:long>")
    @leanly
    def read(data):
        import os
        import sqlite3
        import tempfile

        import pyarrow as pa

        out = []
        for content in data.to_pylist():
            with tempfile.TemporaryDirectory() as scratch:
                with open(os.path.join(scratch, "a.db"), "wb") as file:
                    file.write(content)
                base = sqlite3.connect(os.path.join(scratch, "a.db"))
                out.append(base.execute("select count(*), coalesce(sum(length(cast(text as blob))), 0) from t").fetchone())
                base.close()
        return pa.StructArray.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["n", "bytes"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.floor(F.col("doc_id") / 2000).cast("long").alias("part"))
    made = docs.groupBy("source", "part").applyInPandas(build, "source string, part long, content binary").withColumn("packer", F.lit("sqlite"))
    return packed(made, codecs.Options()).withColumn("r", read("packed")).groupBy("source").agg(F.sum("r.n").alias("n"), F.sum("r.bytes").alias("bytes"), F.max(F.octet_length("packed") <= F.octet_length("content")).alias("no_larger"))


def psd_rezip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layered images whose composite is each text, deflated weakly: the composite after packing."""
    @F.arrow_udf("binary")
    @leanly
    def build(text):
        import struct
        import zlib

        import pyarrow as pa

        head = b"8BPS" + struct.pack(">H6xHIIHH", 1, 3, 48, 48, 8, 3) + struct.pack(">III", 0, 0, 0)
        return pa.array([head + b"\0\2" + zlib.compress((x or "").encode(), 0) for x in text.to_pylist()], pa.binary())

    @F.arrow_udf("string")
    @leanly
    def composite(data):
        import zlib

        import pyarrow as pa

        return pa.array([zlib.decompress(x[40:]).decode() for x in data.to_pylist()], pa.string())

    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("psd").alias("packer"), build("text").alias("content"))
    made = packed(rows, codecs.Options()).withColumn("kept", F.coalesce("packed", "content"))
    return made.select("doc_id", composite("kept").alias("text"), (F.octet_length("kept") <= F.octet_length("content")).alias("no_larger"))


def dicom_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DICOM files with each text as pixels: transfer syntaxes that may be packed, and a signature after the pixels."""
    @F.arrow_udf("binary")
    @leanly
    def build(doc, text):
        import struct

        import pyarrow as pa

        def element(group, number, kind, value):
            value += b" " * (len(value) % 2)
            size = struct.pack("<2xI", len(value)) if kind in (b"OW", b"SQ") else struct.pack("<H", len(value))
            return struct.pack("<HH", group, number) + kind + size + value
        out = []
        for i, t in zip(doc.to_pylist(), text.to_pylist(), strict=True):
            syntax = (b"1.2.840.10008.1.2.1", b"1.2.840.10008.1.2.4.50", b"1.2.840.10008.1.2.5")[i % 3]
            data = bytes(128) + b"DICM" + element(2, 0x10, b"UI", syntax) + element(0x10, 0x10, b"PN", b"A^B")
            data += element(0x7FE0, 0x10, b"OW", (t or "").encode()) if i % 4 else b""
            out.append(data + (element(0xFFFA, 0xFFFA, b"SQ", b"") if i % 5 == 0 else b""))
        return pa.array(out, pa.binary())

    return table(spark, sf_dir, "documents").select("doc_id", dicom_is_packable(build("doc_id", "text")).alias("packable"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, size, packer, key, family and options as a user might ask for them)."""
    k = F.col("doc_id")
    pick = lambda items, n: F.element_at(F.array(*[F.lit(x).cast("string") for x in items]), (F.floor(k / n) % len(items) + 1).cast("int"))
    return paths(spark, sf_dir).withColumn("kind", kind(F.col("path"))).select(
        "doc_id", "path", "size", F.col("kind.packer").alias("packer"), F.col("kind.key").alias("key"), F.col("kind.family").alias("family"), (k % 3 == 0).alias("lossy"), F.when(k % 4 == 1, (k % 100 + 1).cast("int")).alias("quality"),
        pick([None, "/Ebook", "screen", "ultra"], 2).alias("profile"), pick([None, "high", "low", None], 3).alias("png"), (k % 2 == 0).alias("ultra"), (k % 7 < 3).alias("keep"), (k % 5 != 0).alias("convert"), pick([None, "0", "1.5KB", "10MB"], 1).alias("limit"))


def pdf_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("doc_id", plan.pdf_plan(F.col("lossy"), F.col("profile"), F.col("quality")).alias("p")).select("doc_id", "p.*")


def image_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    jpg, png = plan.jpg_plan(F.col("lossy"), F.col("quality"), F.col("keep")), plan.png_plan(F.col("lossy"), F.col("png"), F.col("ultra"))
    return _asked(spark, sf_dir).select("doc_id", F.array_join(jpg["steps"], ",").alias("steps"), jpg["quality"].alias("quality"), jpg["metadata"].alias("metadata"), F.array_join(png["candidates"], ",").alias("candidates"), png["speed"].alias("speed"))


def video_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asked(spark, sf_dir).where(F.col("packer").isin(R.CATEGORIES["video"].split()))
    return rows.select("doc_id", plan.video_plan(F.col("path"), F.col("packer"), F.col("convert"), F.col("ultra")).alias("p")).select("doc_id", "p.*")


def packer_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("doc_id", "packer", F.array_join(plan.options_of(F.col("packer")), ",").alias("options"))


def extract_limit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = plan.extract_limits(F.col("limit"))
    return _asked(spark, sf_dir).select("doc_id", limits["bytes"].alias("bytes"), limits["ratio"].alias("ratio"), exceeds_extract_limit(F.col("size") * 90, F.col("size"), limits["bytes"], limits["ratio"]).alias("over"))


def archive_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).where("family <> 'standalone'").groupBy(plan.archive_writer(F.col("key"), F.col("family")).alias("writer")).agg(F.count(F.lit(1)).alias("files"))


def name_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of an inventory is left alone before any bytes are read, and why."""
    rows = with_name_reason(paths(spark, sf_dir), codecs.Options(min_size=300, pack_images=False))
    return rows.groupBy(F.regexp_replace("barred", "[0-9]+ <", "n <").alias("reason")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def nested_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that may be packed where archives within archives are left alone, by depth."""
    rows = _asked(spark, sf_dir).where("family is not null").select((F.col("doc_id") % 3).cast("int").alias("depth"), (F.col("family") != "standalone").alias("is_archive"))
    return rows.groupBy("depth", "is_archive").agg(F.count_if(nested_gate(F.col("is_archive"), F.col("depth"), False)).alias("open"), F.count(F.lit(1)).alias("members"))


def pdf_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF by its header: at the start after blanks, or behind other text within the first KiB."""
    k, text = F.col("doc_id"), F.col("text")
    content = F.when(k % 4 == 0, F.concat(F.lit(" \n%PDF"), text)).when(k % 4 == 1, F.concat(text, F.lit("%PDF-1.5"))).when(k % 4 == 2, F.concat(F.lit("x%PDF "), text)).otherwise(text)
    return table(spark, sf_dir, "documents").select("doc_id", is_pdf_header(F.encode(content, "utf-8")).alias("is_pdf"))


def sound_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the codec that a description names, and whether they may become FLAC."""
    said = F.concat(F.lit("Stream #0:0: AUDIO: "), F.element_at(F.array(*[F.lit(x) for x in ("PCM", "Opus", "mp3 (Audio: flac)", "alac", "WavPack")]), (F.col("doc_id") % 5 + 1).cast("int")), F.lit(", "), F.col("text"))
    rows = table(spark, sf_dir, "documents").select(plan.sound_codec(said).alias("codec"))
    return rows.groupBy("codec").agg(F.count(F.lit(1)).alias("files"), F.count_if(plan.sound_gate(F.col("codec"), ["flac", "alac"])).alias("open"))


def covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options for images embedded in sound files, where some were not given."""
    c = F.col
    rows = _asked(spark, sf_dir).where(c("packer").isin(R.CATEGORIES["audio"].split()))
    made = plan.cover_options(F.when(c("convert"), c("convert")), F.when(c("keep"), True), F.when(c("doc_id") % 2 == 0, c("lossy")), c("ultra"), c("quality"), c("png"))
    return rows.select("doc_id", made.alias("o")).select("doc_id", "o.*")


def run_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = bulk_summary(_results(spark, sf_dir), "source").withColumn("seconds", F.col("files_failed") + F.col("files_skipped") * 0.5)
    return total.select("source", rates(F.col("files_processed"), F.col("seconds")).alias("r")).select("source", "r.*")


def dir_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("source"), F.lit("/, \\"), F.col("lang"), F.lit("\\,, "), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(sizes.dir_list(text), "|").alias("dirs"))


def backup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in one backup folder for files whose basenames repeat."""
    name = F.concat(F.lit("d/"), F.col("source"), F.lit("/f"), (F.col("doc_id") % 50).cast("string"), F.when(F.col("doc_id") % 2 == 0, ".json").otherwise(""))
    rows = table(spark, sf_dir, "documents").select(name.alias("path")).distinct()
    return backup_names(rows, "b")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [identify_kind, family_counts, ext_key_lists, filter_reasons, dir_prune, category_gate, magic_verify, tar_header, json_minify_savings, json_minify_text,
             xml_minify, data_uri_extract, commit_decision, min_savings, dryrun_vs_real, best_of_three, extract_guard, bulk_totals, container_rollup, legacy_final,
             legacy_rows, bulk_totals_failed, pdf_plans, image_plans, video_plans, packer_options, extract_limit_texts, archive_writers, name_gate, nested_members,
             pdf_headers, sound_codecs, covers, run_rates, dir_lists, backup_plan, report_csv, size_functions, parquet_roundtrip, orc_roundtrip, zip_walk, tar_walk, nested_walk, sqlite_vacuum, psd_rezip, dicom_gate]
    return {f.__name__: f for f in plain} | {f"stream_roundtrip_{c}": stream_roundtrip(c) for c in ("gz", "xz", "bz2", "lzma", "zst", "br", "lz4")}
