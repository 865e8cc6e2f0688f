"""Archives: their members as rows, and archives put together again from rows."""

from __future__ import annotations

import io
import struct
import tarfile
import zipfile
from collections.abc import Iterator

from quern.functions import registry as R
from quern.operators.codecs import DAMAGE, READERS, decoded, encoded

#: Member attributes that a rewrite keeps: (name, header). Links, devices and folders are headers without content.
Member = tuple[str, bytes, bytes | None]


class OverBudget(Exception):
    pass


class Budgeted(io.RawIOBase):
    """A payload read forward only; more than ``most`` bytes of it raise ``OverBudget``."""

    def __init__(self, source, most: int | None):
        self.source, self.most, self.seen = source, most, 0

    def read(self, size: int = -1) -> bytes:
        data = self.source.read(size)
        self.seen += len(data)
        if self.most is not None and self.seen > self.most:
            raise OverBudget
        return data


def declared_size(family: str, data: bytes, most: int | None = None) -> int | None:
    """Bytes that extraction would give, by the archive's own tables; None if they cannot be read. A compressed tar is
    walked as a stream, and no further than ``most`` bytes: beyond, one more than ``most`` is the answer."""
    try:
        if family == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                return sum(x.file_size for x in archive.infolist())
        if family == "tar":
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as archive:
                return sum(x.size for x in archive)
        if family.removeprefix("tar.") not in READERS:
            return None
        source = Budgeted(READERS[family.removeprefix("tar.")](data), None if most is None else most + (1 << 16))
        with tarfile.open(fileobj=source, mode="r|", bufsize=1 << 16) as archive:
            total = 0
            for x in archive:
                total += x.size
                if most is not None and total > most:
                    break
            return total
    except OverBudget:
        return most + 1
    except (zipfile.BadZipFile, tarfile.TarError, struct.error, *DAMAGE):
        return None


def comment(data: bytes) -> bytes:
    """The comment of a ZIP as a whole."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            return archive.comment
    except (zipfile.BadZipFile, OSError, ValueError):
        return b""


def _tar_bytes(family: str, data: bytes) -> bytes | None:
    return data if family == "tar" else decoded(family.removeprefix("tar."), data) if family.startswith("tar.") else None


def is_signed(key: str, data: bytes) -> bool:
    """Whether a rewrite would break a signature: signed package types, or a signature block in META-INF."""
    if key in R.SIGNED:
        return True
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            return any(x.upper().startswith("META-INF/") and x.upper().endswith((".RSA", ".DSA", ".EC", ".SF")) for x in archive.namelist())
    except (zipfile.BadZipFile, OSError, ValueError):
        return False


def members(family: str, data: bytes) -> Iterator[Member]:
    """(name, header, content) in the archive's order, dot-files included; content is None for what is no file."""
    if family == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for x in archive.infolist():
                stored = int(x.compress_type == zipfile.ZIP_STORED)
                header = struct.pack(">6HIHBHH", *x.date_time, x.external_attr, x.create_system, stored, len(x.extra), len(x.comment)) + x.extra + x.comment
                yield x.filename, header, None if x.is_dir() else archive.read(x)
    else:
        payload = _tar_bytes(family, data)
        if payload is None:
            raise ValueError(f"{family}: not readable here")
        with tarfile.open(fileobj=io.BytesIO(payload)) as archive:
            for x in archive:
                file = archive.extractfile(x) if x.isreg() else None
                yield x.name, x.tobuf(tarfile.PAX_FORMAT), file.read() if file else None


def kept_extra(extra: bytes) -> bytes:
    """Extra fields but those that state sizes and offsets (tag 1), which are written anew where they are needed."""
    out, at = b"", 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        out += extra[at : at + 4 + size] if tag != 1 else b""
        at += 4 + size
    return out


def rebuilt(family: str, some: list[Member], level: int = 9, remark: bytes = b"", bare: bool = False) -> bytes | None:
    """The archive anew. A leading ``mimetype`` member stays uncompressed, as EPUB and OpenDocument require. ``remark``
    is a ZIP's own comment; ``bare``: members go without extra fields, as Office packages need."""
    sink = io.BytesIO()
    if family == "zip":
        with zipfile.ZipFile(sink, "w") as archive:
            for k, (name, header, content) in enumerate(some):
                *date, attributes, system, _, extra, note = struct.unpack_from(">6HIHBHH", header)
                at = struct.calcsize(">6HIHBHH")
                info = zipfile.ZipInfo(name, tuple(date))
                info.external_attr, info.create_system = attributes, system
                info.extra, info.comment = b"" if bare else kept_extra(header[at : at + extra]), header[at + extra : at + extra + note]
                plain = content is None or (k == 0 and name == "mimetype")
                info.compress_type = zipfile.ZIP_STORED if plain else zipfile.ZIP_DEFLATED
                archive.writestr(info, content or b"", compresslevel=None if plain else min(9, max(1, level)))
            archive.comment = remark
        return sink.getvalue()
    if not family.startswith("tar"):
        return None
    with tarfile.open(fileobj=sink, mode="w", format=tarfile.PAX_FORMAT) as archive:
        for _, header, content in some:
            with tarfile.open(fileobj=io.BytesIO(header + bytes(1024))) as one:
                info = one.next()
            if content is not None:
                info.size = len(content)
            archive.addfile(info, io.BytesIO(content) if content is not None else None)
    return sink.getvalue() if family == "tar" else encoded(family.removeprefix("tar."), sink.getvalue(), level)
