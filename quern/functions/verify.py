"""Whether bytes look like the kind they should be: by the first 16 bytes, the length, or the structure."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import registry as R
from quern.functions.identify import looks_like_tar

#: What the first 16 bytes must show (fixed values), by the way it is looked for. A kind may stand under several: one is
#: enough. Kinds that are told by a single prefix are in ``registry.PREFIXES``.
STARTS = {
    "tif tiff dng": [b"II", b"MM"], "webp": [b"RIFF"], "mkv webm": [b"\x1a\x45\xdf\xa3"], "pcx": [b"\x0a"], "cur": [b"\0\0\1\0", b"\0\0\2\0"],
    "pnm": [b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"], "ts mts m2ts": [b"\x47"], "jxl": [b"\xff\x0a"], "jp2 j2k jpf jpx": [b"\xff\x4f"],
    "feather arrow ipc": [b"ARROW1", b"FEA1"], "nc nc4 netcdf": [b"CDF", b"\x89HDF"], "mp3": [b"ID3"], "xml": [b"\xef\xbb\xbf<"],
}
CONTAINS = {"avif heic heif mp4 mov m4v m4a 3gp video": [b"ftyp"], "jxl": [b"JXL"], "jp2 j2k jpf jpx": [b"jP", b"ftypjp"]}
LONGER_THAN = {"tga": 18, "mp4 mov m4v m4a 3gp video": 32, "wv ape tta oga": 16, "lzma": 8, "feather arrow ipc": 7}
#: Patterns over the hexadecimal header; ^ stands before leading blanks, which do not count.
PATTERNS = {"svg": "^3C|^(?:..)*?3C[57]3[57]6[46]7", "xml": "^3C", "json": "^(?:EF|BB|BF)*(?:7B|5B)", "mp3": "^FF[EF]"}
BLANKS = "^(?:09|0A|0B|0C|0D|20)+"


def _starts(header: Column, needles: list[bytes]) -> Column:
    return any_of([F.substring(header, 1, len(n)) == F.lit(n) for n in needles])


def _contains(header: Column, needles: list[bytes]) -> Column:
    return any_of([F.hex(header).rlike(f"^(?:..)*?{n.hex().upper()}") for n in needles])


def any_of(tests: list[Column]) -> Column:
    return F.coalesce(reduce(operator.or_, tests), F.lit(False))


def has_dicm(content: Column) -> Column:
    return F.coalesce(F.substring(content, 129, 4) == F.lit(b"DICM"), F.lit(False))


def is_pdf_header(content: Column) -> Column:
    """``%PDF`` after blanks, or ``%PDF-`` within the first KiB."""
    text = F.hex(F.substring(content, 1, 1024))
    return F.coalesce(F.regexp_replace(text, BLANKS, "").startswith("25504446") | text.rlike("^(?:..)*?255044462D"), F.lit(False))


def zip_ends_well(content: Column) -> Column:
    """Whether an end-of-central-directory record closes the bytes, a comment after it included."""
    tail = F.hex(F.substring(content, -65557, 65557))
    return F.coalesce(tail.rlike("^(?:..)*504B0506(?:..){18,}$"), F.lit(False))


def verify(kind: Column, content: Column) -> Column:
    """Whether bytes can be of a kind: by its prefix, else by any rule that names it. Null or empty bytes never pass; a
    kind without a rule always does."""
    header, size = F.substring(content, 1, 16), F.octet_length(content)
    blanked = F.regexp_replace(F.hex(header), BLANKS, "")
    rules = [("zip ooxml jar epub cbz", zip_ends_well(content)), ("tar", looks_like_tar(content)), ("dcm dicom dic", has_dicm(content))]
    rules += [(kinds, _starts(header, v)) for kinds, v in STARTS.items()] + [(kinds, _contains(header, v)) for kinds, v in CONTAINS.items()]
    rules += [(kinds, size > v) for kinds, v in LONGER_THAN.items()]
    rules += [(kinds, (F.hex(header) if kinds == "mp3" else blanked).rlike(v)) for kinds, v in PATTERNS.items()]
    numbers: dict[str, tuple[int, ...]] = {}
    for n, (kinds, _) in enumerate(rules):
        for k in kinds.split():
            numbers[k] = (*numbers.get(k, ()), n)
    prefix = F.element_at(F.create_map(*[x for k, v in R.PREFIXES.items() for x in (F.lit(k), F.lit(v))]), kind)
    out = F.when(F.coalesce(size, F.lit(0)) == 0, False).when(prefix.isNotNull(), F.substring(content, F.lit(1), F.octet_length(prefix)) == prefix)
    for same in dict.fromkeys(numbers.values()):  # kinds with the same rules share a branch
        out = out.when(kind.isin([k for k, n in numbers.items() if n == same]), any_of([rules[n][1] for n in same]))
    return out.otherwise(True)
