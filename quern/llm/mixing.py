"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words."""

from __future__ import annotations

import heapq
import re
from collections.abc import Sequence
from fractions import Fraction

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.shared import WORD, bounded_batches, small, written
from quern.operators.worker import leanly


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Shares of all words by weight; a source stops at ``most`` times its size and the excess is shared anew, by
    weight, among the others, until none is above its limit. Exact fractions inside, doubles out."""
    total, caps = Fraction(sum(sizes)), [Fraction(most) * x for x in sizes]
    found: list[Fraction | None] = [None] * len(sizes)
    while open_ := [k for k, x in enumerate(found) if x is None]:
        share = sum(Fraction(weights[k]) for k in open_)
        over = [k for k in open_ if total * Fraction(weights[k]) / share > caps[k]]
        if not over:
            for k in open_:
                found[k] = total * Fraction(weights[k]) / share
            break
        for k in over:
            found[k] = caps[k]
            total -= caps[k]
    return [float(x) for x in found]


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """Seats by the highest quotients votes / (2 * held + 1), ties to the earlier party, none above its ``most``.

    Near the end of the sequence of quotients one divisor d gives each party about votes / d seats; so all but the
    last few seats are given at once, and those by the quotients themselves. ``seats`` above what the parties may
    hold are left over.
    """
    seats, total = min(seats, sum(most)), sum(votes)
    if not seats or not total:
        return [0] * len(votes)
    low, high = 0.0, float(seats) * 2 + 2
    given = lambda scale: [min(m, int(v / total * scale)) for v, m in zip(votes, most, strict=True)]
    while sum(given(high)) < seats and high < 1e30:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(given(mid)) <= max(0, seats - len(votes)) else (low, mid)
    held = [max(0, x - 1) for x in given(low)]
    heap = [(-v / (2 * h + 1), k) for k, (v, h, m) in enumerate(zip(votes, held, most, strict=True)) if h < m and v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(held)):
        if not heap:
            break
        _, k = heapq.heappop(heap)
        held[k] += 1
        if held[k] < most[k]:
            heapq.heappush(heap, (-votes[k] / (2 * held[k] + 1), k))
    return held


@F.arrow_udf(T.LongType())
@leanly
def word_count(text: pa.Array) -> pa.Array:
    """Words of a text column; 0 for a null."""
    return pc.fill_null(pc.count_substring_regex(text.cast(pa.large_string()), WORD), 0).cast(pa.int64())


def sizes(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """(doc_id, source, size, tag): words of each text, and a hash of the text that tells rows of one id apart."""
    return docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{source_column}`").cast("string").alias("source"),
        word_count(F.col(f"`{text_column}`")).alias("size"), F.xxhash64(f"`{text_column}`").alias("tag"))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = 3, block: int = 32, seed: int = 17, shard_words: int = 1 << 16, shards: int = 100_000,
        id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """Per document ``doc_id``, ``source``, ``size`` (words), ``source_size``, ``target`` (its source's, in words) and
    ``taken`` (words the mix takes of it, repeats counted).

    Sources in code-point order, null last, weigh ``weights`` in turn. The mix is as large as the corpus; see
    ``targets``. It is made of blocks of ``block`` words: Sainte-Laguë gives blocks to sources, then each source's
    blocks to its shards (by words, at most ``most`` times what a shard holds). A shard lays its documents on a
    line in an order seeded by ``seed``, takes every block as often as the quota holds the whole line, and the rest
    as a run of blocks from a seeded start, around the end; so few documents are cut and none is taken more than
    ``most`` times. A shard has about ``shard_words`` words, more where there would be over ``shards`` shards, and
    documents are dealt to a source's shards by hash: a hot source has more shards, not a larger one. The driver
    holds one row for each source and shard.

    A null text has size 0, and 0 is taken of it. Null ids and repeated rows count as rows of their own (equal
    rows are interchangeable). An empty table gives an empty result; other columns are not read.
    """
    laid = _lay(docs, None, weights, most, block, seed, shard_words, shards, id_column, text_column, source_column)
    return laid.select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = 3, block: int = 32, seed: int = 17, shard_words: int = 1 << 16, shards: int = 100_000,
          id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", length_column: str | None = "n_chars") -> DataFrame:
    """The mix itself: ``docs`` with a row for every time ``mix`` takes a document, columns as they were. Where only
    a run of words is taken, the text is that run and the length column (if given and there) its code points.
    Documents of which nothing is taken, those without words among them, are left out."""
    laid = _lay(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), weights, most, block, seed, shard_words, shards, id_column, text_column, source_column)
    every = F.array_repeat(F.struct(F.lit(0).cast("long").alias("a"), F.col("size").alias("b")), F.col("whole").cast("int"))
    times = laid.where("taken > 0").select("row", "size", F.explode(F.concat(every, F.filter("runs", lambda r: r["b"] > r["a"]))).alias("run"))
    text, length = F.col("row")[text_column], length_column if length_column in docs.columns else None
    part = words_between(text, F.col("run.a"), F.when(F.col("run.b") < F.col("size"), F.col("run.b")).otherwise(-1))
    out = times.select("row", part.alias("text"))
    new = {text_column: F.col("text")} | ({length: F.length("text").cast(docs.schema[length].dataType)} if length else {})
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


@F.arrow_udf(T.StringType())
@leanly
def words_between(text: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
    """The text from word ``first`` up to before word ``last`` (-1: the end), as it stands; whole texts untouched."""
    out = []
    for t, a, b in zip(text.to_pylist(), first.to_pylist(), last.to_pylist(), strict=True):
        if a or b >= 0:
            spots = [m.span() for m in re.finditer(WORD, t)]
            t = t[spots[a][0] : spots[b - 1][1] if b >= 0 else len(t)]
        out.append(t)
    return pa.array(out, pa.string())


def _lay(docs: DataFrame, row: Column | None, weights, most, block, seed, shard_words, shards, id_column, text_column, source_column) -> DataFrame:
    """What ``mix`` decides; with ``row`` (a struct) that goes along. ``whole`` passes over the document, and ``runs``
    of its words (a up to before b) besides."""
    spark = docs.sparkSession
    bounded_batches(spark)
    counted = written(sizes(docs, id_column, text_column, source_column), "sizes")
    found = [(r["source"], r["words"]) for r in counted.groupBy("source").agg(F.sum("size").alias("words")).collect()]
    found.sort(key=lambda x: (x[0] is None, x[0] or ""))
    words = [int(x) for _, x in found]
    aims = targets(words, [weights[k % len(weights)] for k in range(len(found))], most)
    span = max(shard_words, -(-sum(words) // shards))
    plan = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_no", T.IntegerType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("shards", T.IntegerType())])
    sources = spark.createDataFrame([(s, k, n, aims[k], max(1, -(-n // span))) for k, (s, n) in enumerate(found)], plan)
    rows = counted if row is None else docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{source_column}`").cast("string").alias("source"), word_count(F.col(f"`{text_column}`")).alias("size"),
        F.xxhash64(f"`{text_column}`").alias("tag"), row.alias("row"))
    extra = [] if row is None else ["row"]
    dealt = rows.join(small(sources, len(found)), rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    dealt = dealt.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "tag")).withColumn("shard", F.pmod(F.xxhash64("order", F.lit(3)), F.col("shards")).cast("int"))
    marks = counted.join(small(sources, len(found)), counted["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    marks = marks.withColumn("shard", F.pmod(F.xxhash64(F.xxhash64(F.lit(seed), "doc_id", "tag"), F.lit(3)), F.col("shards")).cast("int"))
    held = marks.groupBy("source_no", "shard").agg(F.sum("size").alias("words")).orderBy("source_no", "shard").collect()
    by_source: dict[int, list] = {}
    for r in held:
        by_source.setdefault(r["source_no"], []).append((r["shard"], int(r["words"])))
    blocks = {k: [-(-n // block) for _, n in x] for k, x in by_source.items()}
    quotas = sainte_lague(aims, round(sum(aims) / block), [most * sum(blocks.get(k, [0])) for k in range(len(found))])
    plan_rows = []
    for k, x in by_source.items():
        got = sainte_lague([n for _, n in x], quotas[k], [most * b for b in blocks[k]])
        plan_rows += [(k, shard, b, q) for (shard, _), b, q in zip(x, blocks[k], got, strict=True)]
    quota = spark.createDataFrame(plan_rows, "source_no int, shard int, blocks long, quota long")
    line = W.partitionBy("source_no", "shard").orderBy("order", "doc_id", "tag", "size")
    laid = dealt.withColumn("end", F.sum("size").over(line.rowsBetween(W.unboundedPreceding, W.currentRow)))
    laid = laid.join(small(quota, len(plan_rows)), ["source_no", "shard"])
    whole, rest = F.expr("if(blocks = 0, 0, quota div blocks)"), F.expr("if(blocks = 0, 0, quota % blocks)")
    first = F.expr(f"if(blocks = 0, 0, pmod(xxhash64({seed}, source_no, shard), blocks))")
    laid = laid.select("doc_id", "source", "size", "source_size", "target", (F.col("end") - F.col("size")).alias("start"), "end", "blocks", whole.alias("whole"), rest.alias("rest"), first.alias("first"), *extra)

    def overlap(a: Column, b: Column) -> Column:
        low, high = F.greatest(F.col("start"), a * block) - F.col("start"), F.least(F.col("end"), b * block) - F.col("start")
        return F.struct(low.cast("long").alias("a"), F.greatest(low, high).cast("long").alias("b"))

    run = F.col("first") + F.col("rest")
    runs = F.array(overlap(F.lit(0), F.greatest(F.lit(0), run - F.col("blocks"))), overlap(F.col("first"), F.least(run, F.col("blocks"))))
    laid = laid.withColumn("runs", runs)
    taken = F.col("whole") * F.col("size") + F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    return laid.withColumn("taken", taken.cast("long"))
