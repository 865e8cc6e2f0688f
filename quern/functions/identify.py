"""What a file is, from its name and what little of its bytes is at hand: Column builders only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import registry as R


def lookup(table: dict[str, str], key: Column) -> Column:
    """The table's value for ``key``, else null."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.element_at(F.create_map(*pairs), key)


def basename(path: Column) -> Column:
    """Last segment, lower case; a backslash separates like a slash."""
    return F.lower(F.substring_index(F.translate(path, "\\", "/"), "/", -1))


def last_ext(path: Column) -> Column:
    """What follows the last dot of the basename; empty without one."""
    name = basename(path)
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise("")


def compound_suffix(path: Column) -> Column:
    """``tar.gz`` and its like at the end of the name, else null."""
    found = F.regexp_extract(basename(path), r"\.(tar\.(?:" + "|".join(x[4:] for x in R.COMPOUND) + r"))$", 1)
    return F.when(found != "", found)


def ext_keys(path: Column) -> Column:
    """All keys by which a filter can name the file, in order: compound suffix, the last extension's, the extension,
    its archive family, its standalone alias."""
    ext, compound = last_ext(path), compound_suffix(path)
    known = F.when(ext != "", ext)
    after = F.when(compound.isNotNull(), F.substring_index(compound, ".", -1))
    every = F.array(compound, after, known, lookup(R.FAMILY_OF, ext), lookup(R.ALIAS_OF, ext))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull()))


def archive_family(key: Column) -> Column:
    """Family of an extension or compound suffix: itself for a compound, a special family, zip, or null."""
    return F.coalesce(F.when(key.isin(R.COMPOUND), key), lookup(R.FAMILY_OF, key), F.when(key.isin(R.ARCHIVES), "zip"))


def looks_like_tar(header: Column) -> Column:
    return F.coalesce(F.octet_length(header) >= 262, F.lit(False)) & (F.substring(header, 258, 5) == F.lit(b"ustar"))


def kind(path: Column, inner_is_tar: Column | None = None, is_zip: Column | None = None) -> Column:
    """struct<key, family, packer, is_archive>, null if unsupported.

    ``inner_is_tar``: whether a compressed stream holds a tar; ``is_zip``: whether the bytes are a ZIP, which alone
    makes an .otf (an OpenDocument formula) supported. Both default to no.
    """
    inner, zipped = inner_is_tar if inner_is_tar is not None else F.lit(False), is_zip if is_zip is not None else F.lit(False)
    ext, compound = last_ext(path), compound_suffix(path)
    def made(key: Column, family: Column, packer: Column) -> Column:
        return F.struct(key.alias("key"), family.alias("family"), packer.alias("packer"), (family != "standalone").alias("is_archive"))
    none = F.lit(None).cast("string")
    family, peeked = archive_family(ext), lookup(R.PEEK_FAMILY, ext)
    packer = F.coalesce(lookup(R.ALIAS_OF, ext), ext)
    return (
        F.when(compound.isNotNull(), made(compound, compound, none))
        .when(family.isNotNull(), made(ext, family, none))
        .when((ext == "otf") & F.coalesce(zipped, F.lit(False)), made(ext, F.lit("zip"), none))
        .when(ext.isin(R.STANDALONE) & F.coalesce(inner, F.lit(False)) & peeked.isNotNull(), made(ext, peeked, none))
        .when(ext.isin(R.STANDALONE), made(ext, F.lit("standalone"), packer))
    )


def is_supported(path: Column, is_zip: Column | None = None) -> Column:
    ext = last_ext(path)
    zipped = F.coalesce(is_zip, F.lit(False)) if is_zip is not None else F.lit(False)
    return compound_suffix(path).isNotNull() | ext.isin(R.ARCHIVES + R.STANDALONE) | ((ext == "otf") & zipped)
