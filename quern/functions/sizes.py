"""Sizes, levels and small parameter mappings: Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import registry as R
from quern.functions.identify import lookup


def parse_size(text: Column) -> Column:
    """Bytes of ``1.5KB``, ``2 gb``, ``1000``; null and '' are 0; anything else fails the query. A unit letter without
    B multiplies by 1."""
    up = F.upper(F.trim(text))
    shape = r"^([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?B?)$"
    number, unit = F.regexp_extract(up, shape, 1).try_cast("double"), F.regexp_extract(up, shape, 2)
    times = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, u in enumerate(("B", "KB", "MB", "GB", "TB")) for x in (u, float(1024**k))]), unit), F.lit(1.0))
    whole = up.rlike(r"^[+-]?[0-9]+$")
    return (
        F.when(text.isNull() | (text == ""), F.lit(0).cast("long"))
        .when(up.rlike(shape), (number * times).cast("long"))
        .when(whole, up.try_cast("long"))
        .otherwise(F.raise_error(F.concat(F.lit("Invalid size format: "), up)).cast("long"))
    )


def format_size(size: Column) -> Column:
    """``1.50 KB``; below 1024 in bytes, so any negative size in bytes; above TB in PB. Halves round to even."""
    out, units = None, ("B", "KB", "MB", "GB", "TB")
    for k, unit in enumerate(units):
        text = two_places(size / F.lit(float(1024**k)), f" {unit}")
        test = size / F.lit(float(1024**k)) < 1024.0
        out = F.when(test, text) if out is None else out.when(test, text)
    return out.otherwise(two_places(size / F.lit(float(1024**5)), " PB"))


def two_places(value: Column, suffix: str = "") -> Column:
    """Two decimals as C prints them: the double's exact value, halves to even (Spark's own formatting rounds halves up)."""
    return F.concat(F.bround(value.cast("decimal(38,18)"), 2).cast("decimal(30,2)").cast("string"), F.lit(suffix))


def jpeg_qfactor(quality: Column) -> Column:
    """100 -> 0.15 down to 1 -> 2.4, in three places; beyond that clamped."""
    return F.round(F.lit(0.15) + (F.lit(100) - F.least(F.lit(100), F.greatest(F.lit(1), quality))) * F.lit(2.25) / F.lit(99.0), 3)


def pdf_profile(text: Column) -> Column:
    """Trimmed, lower case, without leading slashes; null for a profile that is none of the five."""
    name = F.regexp_replace(F.lower(F.trim(text)), "^/+", "")
    return F.when(name.isin(R.PDF_PROFILES), name)


def rar_method(level: Column) -> Column:
    return F.when(level <= 2, "m3").when(level <= 4, "m4").otherwise("m5")


def zip_level(level: Column) -> Column:
    return F.least(F.lit(9), F.greatest(F.lit(1), level))


def png_speed(quality: Column) -> Column:
    return F.coalesce(lookup({"high": "1", "medium": "2", "low": "3"}, F.lower(quality)).cast("int"), F.lit(1))


def ext_list(text: Column) -> Column:
    """Items of a comma list, trimmed, lower case, without one leading dot; null and '' give none."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.lower(F.trim(x)))
    return F.transform(F.filter(items, lambda x: x != ""), lambda x: F.when(x.startswith("."), F.substring(x, 2, 1 << 20)).otherwise(x))


def dir_list(text: Column) -> Column:
    """Distinct directory names of a comma list, without slashes at their ends."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.regexp_replace(F.trim(x), r"^[/\\]+|[/\\]+$", ""))
    return F.array_distinct(F.filter(items, lambda x: x != ""))
