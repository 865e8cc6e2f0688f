import io
import math
import struct
import tarfile
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quern.functions import filters, identify, markup, sizes
from quern.functions.decide import best, decision, savings_pct
from quern.functions.verify import has_dicm, is_pdf_header, verify
from quern.operators import codecs, containers
from quern.operators.dicom import packable


def column(spark, values, kind, build):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[1] for r in rows.select("k", build(F.col("v")).alias("x")).orderBy("k").collect()]


def test_identify(spark):
    names = ["slides.pptx", "photos.tar.gz", "b/bundle.TGZ", "src.tlz", "comic.cbr", "c.cb7", "c.cbt", "pic.jfif", "notes.db", "icon.apng", "p.cur", "pkg.deb", "notes.txt", "f.otf", ".bashrc", "a\\b.JSON", None]
    found = column(spark, names, "string", identify.kind)
    assert [(x.key, x.family, x.packer) if x else None for x in found] == [
        ("pptx", "zip", None), ("tar.gz", "tar.gz", None), ("tgz", "tar.gz", None), ("tlz", "tar.lz", None), ("cbr", "rar", None), ("cb7", "7z", None), ("cbt", "tar", None),
        ("jfif", "standalone", "jpg"), ("db", "standalone", "sqlite"), ("apng", "standalone", "png"), ("cur", "standalone", "ico"), None, None, None, None, ("json", "standalone", "json"), None]
    assert column(spark, ["a.gz"], "string", lambda c: identify.kind(c, F.lit(True)))[0].family == "tar.gz"
    assert column(spark, ["a.lzo"], "string", lambda c: identify.kind(c, F.lit(True)))[0].family == "standalone"
    assert column(spark, ["f.otf"], "string", lambda c: identify.kind(c, None, F.lit(True)))[0].family == "zip"


def test_ext_keys(spark):
    assert column(spark, ["a.tar.gz", "a.tgz", "icon.apng", "x", "preview.thm"], "string", identify.ext_keys) == [["tar.gz", "gz"], ["tgz", "tar.gz"], ["apng", "png"], [], ["thm", "jpg"]]


def test_filters(spark):
    rows = [("a.tar.gz", 10), ("b.jpg", 10), ("c.docx", 5), ("c.docx", 500), ("c.docx", None)]
    df = spark.createDataFrame(rows, "p string, s long")
    reason = filters.skip_reason(F.col("p"), F.col("s"), 6, 100, ("docx", "gz"), ())
    assert [r[0] for r in df.select(reason).collect()] == ["", "Extension 'jpg' not in include list", "File size 5 < min_size 6", "File size 500 > max_size 100", "Cannot read file size"]
    assert column(spark, ["x/.git/y", "x/y.git", "venv/z", "venv"], "string", filters.in_excluded_dir) == [True, False, True, False]


@pytest.mark.parametrize(("unpacked", "original", "most", "ratio", "over"), [
    (None, 100, 8 << 30, 100.0, False), (101, 50, 100, 100.0, True), (50, 50, 100, 100.0, False), (10001, 100, 10**12, 100.0, True), (5000, 100, 10**12, 100.0, False), (10**12, 1, 0, 0.0, False)])
def test_extract_limit(spark, unpacked, original, most, ratio, over):
    assert column(spark, [unpacked], "long", lambda c: filters.exceeds_extract_limit(c, F.lit(original), most, ratio)) == [over]


def test_decision(spark):
    def one(i, o, **how):
        row = spark.range(1).select(decision(F.lit(i), F.lit(o), F.lit(how.pop("valid", True)), **how).alias("d")).first()["d"]
        return row and (row.outsize, row.replaced)
    assert one(2, 4) == (2, False) and one(4, 4) == (4, False) and one(4, 2) == (2, True)
    assert one(100, 99, min_savings=5.0) == (100, False) and one(100, 95, min_savings=5.0) == (95, True)
    assert one(4, 1, dryrun=True) == (1, False) and one(4, 9, only_smaller=False) == (9, True)
    assert one(4, 0) is None and one(4, 2, valid=False) is None
    assert spark.range(1).select(savings_pct(F.lit(5000), F.lit(4000)), savings_pct(F.lit(0), F.lit(0))).first()[:] == (20.0, 0.0)
    picked = spark.sql("select cast(array(struct(5L, 0), struct(3L, 2), struct(3L, 1), struct(cast(null as long), 3)) as array<struct<size:long,ordinal:int>>) as c").select(best(F.col("c")).alias("b")).first()["b"]
    assert (picked.size, picked.ordinal) == (3, 1)


def test_sizes(spark):
    assert column(spark, ["100", "1KB", "1MB", "2GB", "1TB", "1.5KB", "", None, "1000", "1K"], "string", sizes.parse_size) == [100, 1024, 1 << 20, 2 << 30, 1 << 40, 1536, 0, 0, 1000, 1]
    with pytest.raises(Exception, match="Invalid size"):
        column(spark, ["much"], "string", sizes.parse_size)
    values = [0, 100, 1024, 1 << 20, 1 << 30, 1 << 52, -5000, 1152]
    def shown(v):
        for unit in ("B", "KB", "MB", "GB", "TB"):
            if v < 1024:
                return f"{v:.2f} {unit}"
            v /= 1024
        return f"{v:.2f} PB"
    assert column(spark, values, "long", sizes.format_size) == [shown(float(v)) for v in values]
    assert column(spark, [0.125, 0.375, 2.5, 1 / 3], "double", sizes.two_places) == ["0.12", "0.38", "2.50", "0.33"]
    assert column(spark, [100, 1, 75, 200], "int", sizes.jpeg_qfactor) == [0.15, 2.4, round(0.15 + 25 * 2.25 / 99, 3), 0.15]
    assert column(spark, ["/ebook", "Prepress", "ultra"], "string", sizes.pdf_profile) == ["ebook", "prepress", None]
    assert column(spark, [".docx,.xlsx", "docx, xlsx , pptx", "", None], "string", sizes.ext_list) == [["docx", "xlsx"], ["docx", "xlsx", "pptx"], [], []]
    assert column(spark, ["a/, \\b\\,,a"], "string", sizes.dir_list) == [["a", "b"]]


def test_verify(spark):
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        z.writestr("a", "b")
    rows = [("pdf", b"%PDF-1.4", True), ("pdf", b"x", False), ("zip", sink.getvalue(), True), ("zip", b"PK\x03\x04", False), ("json", b"\xef\xbb\xbf {}", False), ("json", b" [1]", True),
            ("xml", b"\xef\xbb\xbf<a/>", True), ("mp3", b"\xff\xfb", True), ("tga", b"x" * 18, False), ("gz", b"", False), ("gz", None, False), ("odd", b"x", True), ("mp4", b"....ftypisom", True), ("png", b"\x89P", False)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(rows)], "k int, kind string, c binary")
    assert [r[0] for r in df.orderBy("k").select(verify(F.col("kind"), F.col("c"))).collect()] == [r[2] for r in rows]
    assert column(spark, [bytes(128) + b"DICM", b"DICM"], "binary", has_dicm) == [True, False]
    assert column(spark, [b" \n%PDF", b"xx%PDF-1", b"xx%PDF"], "binary", is_pdf_header) == [True, True, False]


def test_markup():
    assert markup.json_minified(b'\xef\xbb\xbf{ "a": 1e5, "a": [1,  2] }') == b'{"a":[1,2]}'
    assert markup.json_minified(b"{not json") is None and markup.json_minified(b'"\\ud800"') is None
    assert markup.xml_minified(b"<a>\n  <b> x </b>\r\n</a>") == b"<a><b> x </b></a>"
    assert markup.xml_minified(b"<a>") is None and markup.xml_minified(b'<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>') is None
    uri = "<i s='data:image/JPG;base64,QUJD\nREVG'/><i s='data:image/svg+xml;base64,QUJD'/>"
    assert markup.rewritten_uris(uri, lambda ext, data: b"A" if (ext, data) == ("jpg", b"ABCDEF") else None).startswith("<i s='data:image/jpeg;base64,QQ=='/>")
    assert markup.rewritten_uris(uri, lambda ext, data: data) == uri


@pytest.mark.parametrize("kind", ["gz", "xz", "bz2", "lzma", "zst", "br", "lz4"])
@pytest.mark.parametrize("payload", [b"", b"Rain on a tin roof; " * 70, bytes(range(256)) * 9])
def test_streams(kind, payload):
    weak = codecs.encoded(kind, payload, 1)
    strong = codecs.PACKERS[kind](weak, codecs.Options())
    assert codecs.decoded(kind, strong) == payload
    assert codecs.PACKERS[kind](b"damage" + weak[:3], codecs.Options()) is None


def test_psd():
    body = zlib.compress(b"abc" * 4000, 0)
    channel = b"\0\2" + body
    record = struct.pack(">iiiiH", 0, 0, 9, 9, 1) + struct.pack(">hI", 0, len(channel)) + b"8BIMnorm\xff\0\0\0" + struct.pack(">I", 0)
    info = struct.pack(">h", 1) + record + channel
    layers = struct.pack(">I", len(info)) + info + b"rest"
    head = b"8BPS" + struct.pack(">H6xHIIHH", 1, 3, 48, 48, 8, 3) + struct.pack(">II", 0, 0)
    data = head + struct.pack(">I", len(layers)) + layers + b"\0\2" + body
    small = codecs.pack_psd(data, codecs.Options())
    size = struct.unpack_from(">I", small, len(head))[0]
    section = small[len(head) + 4 : len(head) + 4 + size]
    assert len(small) < 400 and small.endswith(zlib.compress(b"abc" * 4000, 9)) and section.endswith(b"rest")
    inner = struct.unpack_from(">I", section, 0)[0]
    assert zlib.decompress(section[4 + 2 + len(record) + 2 : 4 + inner]) == b"abc" * 4000
    assert struct.unpack_from(">I", section, 4 + 2 + 20)[0] == inner - 2 - len(record)
    raw = head + struct.pack(">I", 0) + b"\0\0" + b"x" * 50
    assert codecs.pack_psd(raw, codecs.Options()) is None and codecs.pack_psd(b"8BPS", codecs.Options()) is None


def test_dicom():
    def element(group, number, kind, value):
        size = struct.pack("<2xI", len(value)) if kind in (b"OW", b"SQ") else struct.pack("<H", len(value))
        return struct.pack("<HH", group, number) + kind + size + value
    def file(syntax=b"1.2.840.10008.1.2.1\0", pixels=True, signed=False, mark=b"DICM"):
        data = bytes(128) + mark + element(2, 0x10, b"UI", syntax) + (element(0x7FE0, 0x10, b"OW", b"ab") if pixels else b"")
        return data + (element(0xFFFA, 0xFFFA, b"SQ", b"") if signed else b"")
    assert packable(file())
    assert not any(map(packable, (file(mark=b"xxxx"), file(syntax=b"1.2.840.10008.1.2.4.50"), file(pixels=False), file(signed=True), file()[:-1], b"")))


def test_containers():
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr(".dot", "x" * 100)
        z.writestr("d/", "")
    some = list(containers.members("zip", sink.getvalue()))
    again = containers.rebuilt("zip", some)
    assert list(containers.members("zip", again))[1][2] == b"x" * 100 and zipfile.ZipFile(io.BytesIO(again)).infolist()[0].compress_type == 0
    assert containers.declared_size("zip", sink.getvalue()) == 120 and containers.declared_size("zip", b"x") is None
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        info = tarfile.TarInfo("n" * 150)
        info.size, info.mtime, info.mode = 3, 12345, 0o600
        t.addfile(info, io.BytesIO(b"abc"))
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "n"
        t.addfile(link)
    again = containers.rebuilt("tar.xz", list(containers.members("tar", tar.getvalue())))
    with tarfile.open(fileobj=io.BytesIO(again)) as t:
        first, second = t.getmembers()
        assert (first.name, first.mtime, first.mode, t.extractfile(first).read(), second.linkname) == ("n" * 150, 12345, 0o600, b"abc", "n")
    assert containers.is_signed("apk", b"") and not containers.is_signed("zip", again)
    assert math.isclose(containers.declared_size("tar.xz", again), 3)
