"""Whether a DICOM file can be repacked safely: no encoder is at hand here, the gate is."""

from __future__ import annotations

import struct

from quern.functions.registry import TRANSFER_SYNTAXES

LONG = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"}
PIXELS, SIGNATURES, ITEM, ITEM_END, SEQUENCE_END = (0x7FE0, 0x0010), (0xFFFA, 0xFFFA), (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)
OPEN, MOST = 0xFFFFFFFF, 100_000


class _Walk:
    """Elements of a data set, one after the other."""

    def __init__(self, data: bytes, at: int, order: str, explicit: bool):
        self.data, self.at, self.order, self.explicit, self.seen = data, at, order, explicit, 0

    def unpack(self, form: str) -> tuple:
        out = struct.unpack_from(self.order + form, self.data, self.at)
        self.at += struct.calcsize(self.order + form)
        return out

    def element(self) -> tuple[tuple[int, int], bytes, int]:
        self.seen += 1
        if self.seen > MOST:
            raise ValueError("too many elements")
        tag = self.unpack("HH")
        if tag[0] == 0xFFFE or not self.explicit:
            return tag, b"UN", self.unpack("I")[0]
        kind = self.unpack("2s")[0]
        return (tag, kind, self.unpack("2xI")[0]) if kind in LONG else (tag, kind, self.unpack("H")[0])

    def skip(self, length: int, depth: int = 0) -> None:
        if depth > 32:
            raise ValueError("nested too deep")
        if length != OPEN:
            self.at += length
            if self.at > len(self.data):
                raise ValueError("truncated")
            return
        while True:
            tag, _, size = self.element()
            if tag in (SEQUENCE_END, ITEM_END):
                return
            self.skip(size, depth + 1)


def packable(data: bytes) -> bool:
    """The DICM mark, a transfer syntax that allows it, pixel data, no digital signature anywhere; damage means no."""
    try:
        if data[128:132] != b"DICM":
            return False
        meta, syntax = _Walk(data, 132, "<", True), ""
        while data[meta.at : meta.at + 2] == b"\2\0":
            tag, _, length = meta.element()
            if tag == (0x0002, 0x0010):
                syntax = data[meta.at : meta.at + length].rstrip(b"\0 ").decode("ascii")
            meta.skip(length)
        if syntax not in TRANSFER_SYNTAXES:
            return False
        walk, pixels = _Walk(data, meta.at, ">" if syntax.endswith("1.2.2") else "<", syntax != TRANSFER_SYNTAXES[0]), False
        while walk.at < len(data):
            tag, _, length = walk.element()
            if tag == SIGNATURES:
                return False
            pixels |= tag == PIXELS
            walk.skip(length)
        return pixels
    except (struct.error, ValueError, UnicodeError):
        return False
