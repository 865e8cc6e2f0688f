"""Whether new bytes replace old ones, and what that saves: Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def savings_pct(insize: Column, outsize: Column) -> Column:
    """Share saved in percent; 0 where nothing went in."""
    return F.when(insize > 0, (insize - outsize) * F.lit(100.0) / insize).otherwise(F.lit(0.0))


def decision(insize: Column, outsize: Column, valid: Column, only_smaller: bool = True, min_savings: float | None = None, dryrun: bool = False) -> Column:
    """struct<insize, outsize, savings_pct, replaced>; null where there is no output, an empty or an invalid one.

    An output that is not smaller is rejected (``only_smaller``), so is one that saves less than ``min_savings``
    percent (as much is kept); a rejected one leaves the sizes as they were. A dry run replaces nothing, but shows
    what an accepted output would save.
    """
    share = savings_pct(insize, outsize)
    reject = F.lit(False)
    if only_smaller:
        reject = reject | (outsize >= insize)
    if min_savings is not None:
        reject = reject | (share < min_savings)
    def made(out: Column, saved: Column, replaced: Column) -> Column:
        return F.struct(insize.cast("long").alias("insize"), out.cast("long").alias("outsize"), saved.alias("savings_pct"), replaced.alias("replaced"))
    kept = F.when(reject, made(insize, F.lit(0.0), F.lit(False))).otherwise(made(outsize, share, F.lit(not dryrun)))
    return F.when(F.coalesce(outsize, F.lit(0)) > 0, F.when(F.coalesce(valid, F.lit(False)), kept))


def best(candidates: Column) -> Column:
    """The smallest of array<struct<size, ordinal, ...>>, the first of equals; null sizes do not count."""
    return F.array_min(F.filter(candidates, lambda c: c["size"].isNotNull()))
