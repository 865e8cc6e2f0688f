"""Which files are worked on, and why others are not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import registry as R
from quern.functions.identify import ext_keys, last_ext, lookup


def _listed(exts: Sequence[str]) -> Column:
    return F.array(*[F.lit(x.lower().removeprefix(".")) for x in exts])


def matches(path: Column, include: Sequence[str] = ()) -> Column:
    """Whether a key of the file is included; an empty list includes all."""
    return F.arrays_overlap(ext_keys(path), _listed(include)) if include else F.lit(True)


def excluded(path: Column, exclude: Sequence[str] = ()) -> Column:
    return F.arrays_overlap(ext_keys(path), _listed(exclude)) if exclude else F.lit(False)


def skip_reason(path: Column, size: Column, min_size: int = 0, max_size: int = 0, include: Sequence[str] = (), exclude: Sequence[str] = (),
                min_savings: float | None = None, savings: Column | None = None) -> Column:
    """The first failing check as text, empty if none: included, excluded, size readable, bounds (0: none, inclusive),
    savings so far."""
    ext = last_ext(path)
    shown = F.when(ext != "", ext).otherwise(F.array_join(ext_keys(path), ","))
    out = F.when(~matches(path, include), F.concat(F.lit("Extension '"), shown, F.lit("' not in include list")))
    out = out.when(excluded(path, exclude), F.concat(F.lit("Extension '"), shown, F.lit("' in exclude list")))
    out = out.when(size.isNull(), "Cannot read file size")
    if min_size:
        out = out.when(size < min_size, F.concat(F.lit("File size "), size.cast("string"), F.lit(f" < min_size {min_size}")))
    if max_size:
        out = out.when(size > max_size, F.concat(F.lit("File size "), size.cast("string"), F.lit(f" > max_size {max_size}")))
    if min_savings is not None and savings is not None:
        out = out.when(savings < min_savings, F.concat(F.lit("Savings below "), F.lit(str(min_savings))))
    return out.otherwise("")


def in_excluded_dir(path: Column, more: Sequence[str] = ()) -> Column:
    """Whether a directory on the way to the file is pruned, at any depth."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(x) for x in [*R.EXCLUDED_DIRS, *more]]))


def is_plain_zip(path: Column) -> Column:
    return last_ext(path) == "zip"


def category(packer: Column) -> Column:
    return lookup(R.CATEGORY_OF, packer)


def media_gate(packer: Column, pack_images: bool = True) -> Column:
    """False where image, audio and video packers are switched off; documents and data always pass."""
    return F.lit(True) if pack_images else ~F.coalesce(category(packer).isin("image", "audio", "video"), F.lit(False))


def nested_gate(is_archive: Column, depth: Column, pack_archives: bool = True) -> Column:
    """Archives inside archives can be left alone; a file at the top never is."""
    return F.lit(True) if pack_archives else ~(is_archive & (depth > 0))


def exceeds_extract_limit(uncompressed: Column, original: Column, max_bytes: Column | int | None = None, ratio: Column | float | None = None) -> Column:
    """Strictly above the byte limit (if over 0) or ``ratio`` times the original (if both are over 0); an unknown
    size never is. A limit of None stands for its default, 0 for no limit."""
    as_column = lambda x, default: (x if isinstance(x, Column) else F.lit(x)) if x is not None else F.lit(default)
    most = F.coalesce(as_column(max_bytes, R.MAX_EXTRACT_BYTES), F.lit(R.MAX_EXTRACT_BYTES))
    times = F.coalesce(as_column(ratio, R.MAX_EXTRACT_RATIO), F.lit(R.MAX_EXTRACT_RATIO))
    over = ((most > 0) & (uncompressed > most)) | ((times > 0) & (original > 0) & (uncompressed > original * times))
    return F.coalesce(uncompressed.isNotNull() & over, F.lit(False))
