"""Re-encoders: bytes to smaller bytes of the same content, or None where the format's tool is not at hand."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import os
import sqlite3
import struct
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import orc

from quern.functions import markup
from quern.functions.registry import MAX_EXTRACT_BYTES, MAX_EXTRACT_RATIO, PDF_PROFILES


@dataclass(frozen=True)
class Options:
    """What a run is asked to do; every field has the default of a plain lossless run."""

    dryrun: bool = False
    deep_walking: bool = True
    pack_images: bool = True
    pack_archives: bool = True
    compression_level: int = 9
    ultra: bool = False
    only_smaller: bool = True
    min_savings: float | None = None
    min_size: int = 0
    max_size: int = 0
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    exclude_dirs: tuple[str, ...] = ()
    skip_zip: bool = True
    jpeg_quality: int | None = None
    png_quality: str | None = None
    pdf_profile: str | None = None
    lossy: bool = False
    wmv_lossless: bool = False
    convert_container: bool = True
    keep_meta: bool = False
    max_extract_bytes: int | None = None
    max_extract_ratio: float | None = None
    max_depth: int = 4
    max_rebuilt_bytes: int = 1 << 30  # an archive's members meet in one task, and its bytes in one value

    def __post_init__(self) -> None:
        wrong = [
            ("compression_level", not 0 <= self.compression_level <= 9), ("jpeg_quality", self.jpeg_quality is not None and not 1 <= self.jpeg_quality <= 100),
            ("png_quality", self.png_quality not in (None, "high", "medium", "low")), ("min_savings", self.min_savings is not None and not 0 <= self.min_savings <= 100),
            ("pdf_profile", self.pdf_profile is not None and self.pdf_profile.strip().lower().lstrip("/") not in PDF_PROFILES),
            ("max_size", min(self.min_size, self.max_size) < 0 or 0 < self.max_size < self.min_size), ("max_depth", self.max_depth < 0)]
        if bad := [name for name, off in wrong if off]:
            raise ValueError(f"options out of range: {', '.join(bad)}")

    def extract_budget(self, size: int) -> int | None:
        """The most bytes that a file of ``size`` bytes may give when unpacked; None without a limit."""
        most = MAX_EXTRACT_BYTES if self.max_extract_bytes is None else self.max_extract_bytes
        ratio = MAX_EXTRACT_RATIO if self.max_extract_ratio is None else self.max_extract_ratio
        return min([x for x in (most, int(size * ratio)) if x > 0], default=None)


#: Kind -> a reader of the payload over the stream's bytes.
READERS: dict[str, Callable] = {
    **dict.fromkeys(("gz", "svgz"), lambda data: gzip.GzipFile(fileobj=io.BytesIO(data))),
    "bz2": lambda data: bz2.BZ2File(io.BytesIO(data)),
    **dict.fromkeys(("xz", "lzma"), lambda data: lzma.LZMAFile(io.BytesIO(data))),
    "zst": lambda data: zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True),
    "br": lambda data: pa.CompressedInputStream(pa.BufferReader(data), "brotli"),
    "lz4": lambda data: pa.CompressedInputStream(pa.BufferReader(data), "lz4"),
}
DAMAGE = (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError, zstandard.ZstdError)
CHUNK = 1 << 20


def payload(kind: str, data: bytes) -> Iterator[bytes]:
    """The payload of a compressed stream in pieces of at most 1 MiB; raises one of ``DAMAGE``."""
    reader = READERS[kind](data)
    while piece := reader.read(CHUNK):
        yield piece


def decoded(kind: str, data: bytes, most: int | None = None) -> bytes | None:
    """The whole payload; None if it is damaged, the codec is not at hand, or there are more than ``most`` bytes, of
    which no more than a piece is decoded beyond."""
    if kind not in READERS:
        return None
    out, size = [], 0
    try:
        for piece in payload(kind, data):
            size += len(piece)
            if most is not None and size > most:
                return None
            out.append(piece)
    except DAMAGE:
        return None
    return b"".join(out)


def fingerprint(kind: str, data: bytes) -> tuple[int, bytes] | None:
    """Length and SHA-256 of a payload, a piece at a time; None if it is damaged."""
    size, digest = 0, sha256()
    try:
        for piece in payload(kind, data):
            size += len(piece)
            digest.update(piece)
    except DAMAGE:
        return None
    return size, digest.digest()


def head(kind: str, data: bytes, size: int = 512) -> bytes:
    """The first bytes of a stream's payload, from the stream's first bytes; empty if they do not decode."""
    try:
        if kind == "gz":
            return zlib.decompressobj(31).decompress(data, size)
        if kind == "bz2":
            return bz2.BZ2Decompressor().decompress(data, size)
        if kind in ("xz", "lzma"):
            return lzma.LZMADecompressor().decompress(data, size)
        if kind == "zst":
            return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read(size)
        if kind in ("br", "lz4"):
            return pa.CompressedInputStream(pa.BufferReader(data), {"br": "brotli", "lz4": "lz4"}[kind]).read(size)
    except DAMAGE:
        return b""
    return b""


def encoded(kind: str, payload: bytes, level: int = 9) -> bytes | None:
    """The payload as a stream of ``kind`` at its strongest setting; None for kinds without a codec here."""
    return encoded_pieces(kind, [payload], len(payload), level)


def _dictionary(size: int) -> int:
    """A dictionary beyond the payload saves nothing and costs its allocation."""
    return min(64 << 20, max(4096, 1 << max(0, size - 1).bit_length()))


def encoded_pieces(kind: str, pieces: Iterable[bytes], size: int, level: int = 9) -> bytes | None:
    """``encoded`` for a payload of ``size`` bytes that comes in pieces."""
    if kind in ("br", "lz4"):
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, {"br": "brotli", "lz4": "lz4"}[kind]) as out:
            for piece in pieces:
                out.write(piece)
        return sink.getvalue().to_pybytes()
    if kind in ("gz", "svgz"):
        made = zlib.compressobj(min(9, max(1, level)), zlib.DEFLATED, 31)
    elif kind == "bz2":
        made = bz2.BZ2Compressor(9)
    elif kind in ("xz", "lzma"):
        chain = [{"id": lzma.FILTER_LZMA2 if kind == "xz" else lzma.FILTER_LZMA1, "preset": 9, "dict_size": _dictionary(size)}]
        made = lzma.LZMACompressor(lzma.FORMAT_XZ if kind == "xz" else lzma.FORMAT_ALONE, filters=chain)
    elif kind == "zst":
        made = zstandard.ZstdCompressor(level=19).compressobj(size=size)
    else:
        return None
    return b"".join([*map(made.compress, pieces), made.flush()])


def quickly_encoded(kind: str, payload: bytes) -> bytes | None:
    """The payload as a stream of ``kind`` at a weak setting where that takes less time."""
    if kind in ("xz", "lzma"):
        chain = [{"id": lzma.FILTER_LZMA2 if kind == "xz" else lzma.FILTER_LZMA1, "preset": 0, "dict_size": _dictionary(len(payload))}]
        return lzma.compress(payload, lzma.FORMAT_XZ if kind == "xz" else lzma.FORMAT_ALONE, filters=chain)
    if kind == "zst":
        return zstandard.ZstdCompressor(level=1).compress(payload)
    return encoded(kind, payload, 1)


#: Payloads up to this many bytes are held while they are encoded and checked, so that they are decoded once.
HELD = 4 << 20


def stream(kind: str) -> Callable[[bytes, Options], bytes | None]:
    """Packer of a stream kind. A payload of at most ``HELD`` bytes is decoded once to encode it and its stream once to
    check it; a larger one three times, to measure, to encode and to check, and never held."""
    def pack(data: bytes, options: Options) -> bytes | None:
        small = held(kind, data)
        if small is None:
            was = fingerprint(kind, data)
            out = encoded_pieces(kind, payload(kind, data), was[0]) if was is not None else None
            return out if out is not None and fingerprint(kind, out) == was else None
        out = encoded_pieces(kind, [small], len(small))
        return out if out is not None and held(kind, out) == small else None
    return pack


def held(kind: str, data: bytes) -> bytes | None:
    """The whole payload if it is sound and of at most ``HELD`` bytes."""
    return decoded(kind, data, HELD)


def holds_tar(kind: str, data: bytes) -> bool:
    """Whether a stream's payload begins like a tar; damage means no."""
    first = head(kind, data)
    return len(first) >= 262 and first[257:262] == b"ustar"


def pack_json(data: bytes, options: Options) -> bytes | None:
    return markup.json_minified(data)


def pack_xml(data: bytes, options: Options) -> bytes | None:
    return markup.xml_minified(data, lambda ext, image: PACKERS[ext](image, options) if ext in PACKERS else None)


def pack_svgz(data: bytes, options: Options) -> bytes | None:
    text = decoded("svgz", data, options.extract_budget(len(data)))
    small = pack_xml(text, options) if text is not None else None
    return encoded("svgz", small) if small is not None else None


def pack_sqlite(data: bytes, options: Options) -> bytes | None:
    """VACUUM into a new database, in a task-local scratch folder that goes with the call."""
    if not data.startswith(b"SQLite format 3\0"):
        return None
    with tempfile.TemporaryDirectory() as scratch:
        old, new = os.path.join(scratch, "old.db"), os.path.join(scratch, "new.db")
        with open(old, "wb") as file:
            file.write(data)
        base = sqlite3.connect(old)
        try:
            base.execute("VACUUM INTO ?", (new,))
        except sqlite3.DatabaseError:
            return None
        finally:
            base.close()
        with open(new, "rb") as file:
            return file.read()


def pack_arrow(data: bytes, options: Options) -> bytes | None:
    """Arrow IPC, file or stream, always written as a file with zstd; Feather likewise."""
    try:
        try:
            table = pa.ipc.open_file(pa.BufferReader(data)).read_all()
        except pa.ArrowInvalid:
            table = pa.ipc.open_stream(pa.BufferReader(data)).read_all()
    except (pa.ArrowException, OSError):
        return None
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def pack_parquet(data: bytes, options: Options) -> bytes | None:
    try:
        table = pq.read_table(pa.BufferReader(data))
    except (pa.ArrowException, OSError):
        return None
    sink = pa.BufferOutputStream()
    pq.write_table(table, sink, compression="zstd", compression_level=22 if options.ultra else 19)
    return sink.getvalue().to_pybytes()


def pack_orc(data: bytes, options: Options) -> bytes | None:
    try:
        table = orc.read_table(pa.BufferReader(data))
    except (pa.ArrowException, OSError):
        return None
    sink = pa.BufferOutputStream()
    orc.write_table(table, sink, compression="zstd")
    return sink.getvalue().to_pybytes()


def _rezipped(body: bytes) -> bytes:
    try:
        small = zlib.compress(zlib.decompress(body), 9)
    except zlib.error:
        return body
    return small if len(small) < len(body) else body


def pack_psd(data: bytes, options: Options) -> bytes | None:
    """ZIP-compressed channels deflated anew, lengths adjusted; raw and run-length channels, and layers that do not
    parse, stay as they are. None if nothing changes.

    The file is taken apart into spans: each channel's bytes, and each field that holds a length.
    """
    version = struct.unpack(">H", data[4:6])[0] if data[:4] == b"8BPS" and len(data) >= 26 else 0
    if version not in (1, 2):
        return None
    wide = ">Q" if version == 2 else ">I"

    def number(form: str, at: int) -> tuple[int, int]:
        return struct.unpack_from(form, data, at)[0], at + struct.calcsize(form)

    edits: list[tuple[int, int, bytes]] = []  # (from, to, instead), in any order
    try:
        at = 26
        for _ in range(2):  # colour table, resources
            size, at = number(">I", at)
            at += size
        section_field = at
        size, at = number(wide, at)
        section_end = at + size
        if section_end > len(data):
            return None
    except struct.error:
        return None
    if size:
        edits += _layers(data, at, section_end, wide, number)
    grown = sum(len(new) - (b - a) for a, b, new in edits)
    if grown:
        edits.append((section_field, section_field + struct.calcsize(wide), struct.pack(wide, size + grown)))
    if struct.unpack_from(">H", data, section_end)[0] in (2, 3) if section_end + 2 <= len(data) else False:
        edits.append((section_end + 2, len(data), _rezipped(data[section_end + 2 :])))
    out, done = [], 0
    for a, b, new in sorted(edits):
        out += [data[done:a], new]
        done = b
    packed = b"".join([*out, data[done:]])
    return packed if packed != data else None


def _layers(data: bytes, at: int, end: int, wide: str, number) -> list[tuple[int, int, bytes]]:
    """Edits within the layer section; none if it does not parse to its end."""
    try:
        info_field = at
        info, at = number(wide, at)
        stop = at + info
        if stop > end or not info:
            return []
        count, at = number(">h", at)
        fields: list[tuple[int, int]] = []  # where a channel's length stands, and the length
        for _ in range(abs(count)):
            channels, at = number(">H", at + 16)
            for _ in range(channels):
                field = at + 2
                length, at = number(wide, field)
                fields.append((field, length))
            extra, at = number(">I", at + 12)
            at += extra
        edits = []
        for field, length in fields:
            body = data[at : at + length]
            if at + length > stop:
                return []
            if body[:2] in (b"\0\2", b"\0\3") and len(small := _rezipped(body[2:])) < length - 2:
                edits += [(at + 2, at + length, small), (field, field + struct.calcsize(wide), struct.pack(wide, len(small) + 2))]
            at += length
        if stop - at not in (0, 1):
            return []
    except struct.error:
        return []
    grown = sum(len(new) - (b - a) for a, b, new in edits)
    return [*edits, (info_field, info_field + struct.calcsize(wide), struct.pack(wide, info + grown))] if edits else []


#: Packer key -> function. Keys of the registry that are missing need an external encoder.
PACKERS: dict[str, Callable[[bytes, Options], bytes | None]] = {
    **{kind: stream(kind) for kind in ("gz", "xz", "bz2", "lzma", "zst", "br", "lz4")},
    "json": pack_json, "xml": pack_xml, "svg": pack_xml, "svgz": pack_svgz, "psd": pack_psd, "parquet": pack_parquet, "orc": pack_orc,
    **dict.fromkeys(("feather", "arrow", "ipc"), pack_arrow), **dict.fromkeys(("sqlite", "sqlite3", "gpkg", "mbtiles"), pack_sqlite),
}
