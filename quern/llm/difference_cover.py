"""Suffix sorting of many strings by the difference cover modulo 3, as DataFrame sorts, windows and joins.

Rows are symbols: (sid, run, idx, name, span); (sid, run) is a string, idx counts from 0, names are positive and order
the alphabet, span is what a symbol covers. All steps are range-partitioned sorts; the driver carries one number from
each range to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.shared import partitions, written


def in_order(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` sorted by ``keys`` in ranges, written: ``part`` numbers the ranges, ``rank`` grows along the order."""
    spread = rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return written(spread.withColumn("part", F.spark_partition_id()).withColumn("rank", F.monotonically_increasing_id() + 1), name)


def greatest_so_far(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``value`` replaced by the greatest up to there in the order of ``keys`` (0 if none)."""
    held = in_order(rows, keys, name)
    tops = held.groupBy("part").agg(F.max(value).alias("top")).orderBy("part").collect()
    carry, most = [], 0
    for r in tops:
        carry += [F.lit(r["part"]), F.lit(most)]
        most = max(most, r["top"] or 0)
    before = F.element_at(F.create_map(*carry), F.col("part")) if carry else F.lit(0)
    here = F.max(value).over(W.partitionBy("part").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow))
    return held.withColumn(value, F.greatest(F.coalesce(here, F.lit(0)), before)).drop("part", "rank")


def suffix_ranks(symbols: DataFrame, depth: int) -> DataFrame:
    """(sid, run, idx, rank): every position's rank in suffix order. Suffixes are told apart to at least ``depth`` in
    spans; those alike so far, or to their ends, get ranks in no given order."""
    zero, along = F.lit(0).cast("long"), W.partitionBy("sid", "run").orderBy("idx")
    ahead = lambda c, k: F.coalesce(F.lead(c, k).over(along), zero)
    # 1. triples at positions 1 and 2 modulo 3, sorted and named
    rows = written(symbols.select("sid", "run", "idx", "name", ahead("name", 1).alias("n1"), ahead("name", 2).alias("n2"), (F.col("span") + ahead("span", 1) + ahead("span", 2)).alias("span3")), "symbols")
    sampled = rows.where("idx % 3 <> 0")
    triples = in_order(sampled.groupBy("name", "n1", "n2").agg(F.min("span3").alias("span3"), F.count(F.lit(1)).alias("n")), ["name", "n1", "n2"], "triples")
    named = sampled.join(triples.select("name", "n1", "n2", F.col("rank").alias("triple")), ["name", "n1", "n2"])
    if triples.where((F.col("n") > 1) & (F.col("n2") != 0) & (F.col("span3") < depth)).limit(1).count():
        # 2. names that do not yet tell suffixes apart: sort the two strings of names that each string gives
        shorter = named.select("sid", (F.col("run") * 2 + (F.col("idx") % 3 == 2).cast("long")).alias("run"), F.expr("idx div 3").alias("idx"), F.col("triple").alias("name"), F.col("span3").alias("span"))
        found = suffix_ranks(shorter, depth)
        ranks = found.select("sid", F.expr("run div 2").alias("run"), (F.col("idx") * 3 + 1 + F.col("run") % 2).alias("idx"), "rank")
    else:
        ranks = named.select("sid", "run", "idx", F.col("triple").alias("rank"))
    # 3. the remaining suffixes: by their first symbol and the rank of the suffix after it, against either kind of sample
    known = rows.join(ranks, ["sid", "run", "idx"], "left")
    known = written(known.select("sid", "run", "idx", "name", "n1", F.col("rank").alias("own"), ahead("rank", 1).alias("r1"), ahead("rank", 2).alias("r2")), "ranked")
    kind = F.col("idx") % 3
    one = greatest_so_far(known.where(kind != 2).select("sid", "run", "idx", "name", "r1", F.when(kind == 1, F.col("own")).alias("below")), ["name", "r1"], "below", "merge-one")
    two = greatest_so_far(known.where(kind != 1).select("sid", "run", "idx", "name", "n1", "r2", F.when(kind == 2, F.col("own")).alias("below2")), ["name", "n1", "r2"], "below2", "merge-two")
    rest = one.where(kind == 0).join(two.where(kind == 0).select("sid", "run", "idx", "below2"), ["sid", "run", "idx"])
    rest = rest.select("sid", "run", "idx", F.greatest("below", "below2").alias("at"), F.lit(1).alias("late"), "name", "r1")
    taken = known.where(kind != 0).select("sid", "run", "idx", F.col("own").alias("at"), F.lit(0).alias("late"), zero.alias("name"), zero.alias("r1"))
    return in_order(taken.unionByName(rest), ["at", "late", "name", "r1"], "order").select("sid", "run", "idx", "rank")


def byte_symbols(texts: DataFrame) -> DataFrame:
    """Symbols of (sid, text): the bytes of each text, as names from 1 to 256 of span 1."""
    code = F.transform(F.sequence(F.lit(1), F.octet_length("text")), lambda k: F.conv(F.hex(F.substring(F.encode("text", "utf-8"), k, F.lit(1))), 16, 10).cast("long") + 1)
    spots = texts.where(F.octet_length("text") > 0).select("sid", F.posexplode(code).alias("idx", "name"))
    return spots.select("sid", F.lit(0).cast("long").alias("run"), F.col("idx").cast("long").alias("idx"), "name", F.lit(1).cast("long").alias("span"))
