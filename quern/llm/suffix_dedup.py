"""Removal of long repeated byte strings from a corpus.

The suffixes of every byte of the corpus are compared to a fixed depth, the match length L, by way of a sample
that is the same wherever the text is the same (a difference cover by content instead of by residues modulo 3;
the README gives the reason and figures):

1. *Sample.* Anchors are positions whose 8-byte hash is least in some window of w positions. Two equal strings of
   L bytes have the same anchors from w bytes after their start to w + 8 bytes before their end, at least one. The
   first of these is the anchor of the string.
2. *Names.* All strings of an anchor hold the L - w bytes around it, its core. Anchors are named by their cores;
   a name that occurs once in the corpus has no partner and goes.
3. *Remaining suffixes.* The strings of an anchor start in the stretch before it. Anchors that agree in core and
   in the whole stretch around it (their context) are repeats of each other as they stand.
4. *Compare.* Where contexts of one core differ, their strings are compared byte by byte, start by start.

Each text is shuffled once, as a distinct text; everything else that moves is names and positions.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.passages import shared_words
from quern.llm.shared import arrow_schema, bounded_batches, partitions, shared_folder, shuffles_dropped, slices, small, written

GRAM = 8


def anchors(data: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Anchor positions in concatenated texts that end at ``ends``: the leftmost least hash of every ``window``
    consecutive grams that lie in one text, ascending."""
    if len(data) < GRAM + window - 1:
        return np.zeros(0, np.int64)
    value, step = data.astype(np.uint64) + np.uint64(1), 1
    while step < GRAM:  # the hash of 2, 4, 8 bytes from that of their halves
        left, right = value[:-step], value[step:]
        value = left * np.uint64(0x9E3779B97F4A7C15 + 2 * step) ^ (right * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(29)) ^ right
        step *= 2
    value *= np.uint64(0xD6E8FEB86659FD93)
    value &= np.uint64(0xFFFFFFFF00000000)
    value |= np.arange(len(value), dtype=np.uint64)  # ties to the left
    span = 1
    while span * 2 <= window:
        value = np.minimum(value[:-span], value[span:])
        span *= 2
    if span < window:
        value = np.minimum(value[: span - window], value[window - span :])
    inside, reach = np.ones(len(value), bool), window + GRAM - 1
    for end in ends[:-1]:
        inside[max(0, end - reach + 1) : max(0, min(end, len(value)))] = False
    at = (value[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at


def distinct_texts(docs: DataFrame, length: int) -> DataFrame:
    """(t1, t2, copies, text): each text of at least ``length`` bytes once, bucketed by its 128-bit name, so that
    joins on the name leave the texts where they are. Copies within a task fall together before the shuffle."""
    spark = docs.sparkSession

    def local(batches):
        for batch in batches:
            names = list(zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), strict=True))
            counts, first = Counter(names), {}
            for k, name in enumerate(names):
                first.setdefault(name, k)
            some = batch if len(first) == len(names) else batch.take(pa.array(list(first.values()), pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column("t1"), some.column("t2"), pa.array([counts[n] for n in first], pa.int64()), some.column("text")], ["t1", "t2", "copies", "text"])

    n = partitions(spark)
    rows = docs.where(F.octet_length("text") >= F.lit(length)).select("t1", "t2", "text").mapInArrow(local, "t1 long, t2 long, copies long, text string")
    rows = rows.repartition(n, "t1", "t2").groupBy("t1", "t2").agg(F.sum("copies").alias("copies"), F.any_value("text").alias("text"))
    name = f"texts_{uuid.uuid4().hex}"
    writer = rows.write.bucketBy(n, "t1", "t2").sortBy("t1", "t2").option("compression", "zstd")
    with shuffles_dropped(spark):
        writer.option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name, format="parquet")
    return spark.table(name)


def _cores(texts: DataFrame, length: int, window: int) -> DataFrame:
    """(core, t1, t2, at, gap): every anchor that strings of ``length`` bytes belong to; gap: from the anchor before."""
    def run(batches):
        digest, before, after = xxhash.xxh3_64_intdigest, window, length - 2 * window
        for batch in batches:
            for part in slices(batch, 4096, 256 << 10):  # what numpy goes over again and again stays in the cache
                rows = [x.encode() for x in part.column("text").to_pylist()]
                data, offsets = b"".join(rows), np.cumsum([0, *map(len, rows)])
                found, view = anchors(np.frombuffer(data, np.uint8), offsets[1:], window), memoryview(data)
                cuts = np.searchsorted(found, offsets)
                which, spots, gaps = [], [], []
                for k in range(len(rows)):
                    own = found[cuts[k] : cuts[k + 1]]
                    at, gap = own[1:] - offsets[k], np.diff(own)
                    # strings start from at - gap - window + 1 to at - window, and end in the text
                    fits = (at >= window) & (at - gap - window + 1 <= len(rows[k]) - length) & (at + after <= len(rows[k]))
                    which.append(np.full(int(fits.sum()), k))
                    spots.append(at[fits])
                    gaps.append(gap[fits])
                which, spots, gaps = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (which, spots, gaps))
                starts = (spots + offsets[which]).tolist()
                names = np.fromiter((digest(view[a - before : a + after]) for a in starts), np.uint64, len(starts)).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(names), part.column("t1").take(pa.array(which)), part.column("t2").take(pa.array(which)), pa.array(spots.astype(np.int32)), pa.array(gaps.astype(np.int32))],
                    ["core", "t1", "t2", "at", "gap"])

    return texts.select("t1", "t2", "text").mapInArrow(run, "core long, t1 long, t2 long, at int, gap int")


def _starts(at: np.ndarray, gap: np.ndarray, size: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the strings of each anchor."""
    return np.maximum(0, at - gap - window + 1), np.minimum(size - length, at - window)


def _contexts(texts: DataFrame, spots: DataFrame, length: int, window: int, bytes_too: bool) -> DataFrame:
    """Per anchor in ``spots`` (t1, t2, spots array<(core, at, gap)>) its core, context name, start of the core and
    first and last start of its strings; ``bytes_too``: the bytes before and after the core that these reach."""
    fields = {"core": pa.int64(), "context": pa.int64(), "t1": pa.int64(), "t2": pa.int64(), "copies": pa.int64(), "begin": pa.int32(), "first": pa.int32(), "last": pa.int32()}
    fields |= {"left": pa.binary(), "right": pa.binary()} if bytes_too else {}
    schema, ddl = arrow_schema(fields)

    def run(batches):
        digest, reach = xxhash.xxh3_64_intdigest, length - window
        for batch in batches:
            for part in slices(batch):
                rows = [x.encode() for x in part.column("text").to_pylist()]
                spots = part.column("spots")
                own, flat = np.repeat(np.arange(len(rows)), spots.value_lengths().to_numpy()), spots.flatten()
                at, gap = (flat.field(k).to_numpy().astype(np.int64) for k in (1, 2))
                first, last = _starts(at, gap, np.array([len(x) for x in rows], np.int64)[own], length, window)
                begin = at - window
                edges = list(zip(own.tolist(), first.tolist(), begin.tolist(), last.tolist(), strict=True))
                names = np.fromiter((digest(rows[k][a : c + length], b - a) ^ (c - a) for k, a, b, c in edges), np.uint64, len(edges)).view(np.int64)
                where = pa.array(own)
                columns = [flat.field(0), pa.array(names), *(part.column(c).take(where) for c in ("t1", "t2", "copies")), *(pa.array(c.astype(np.int32)) for c in (begin, first, last))]
                if bytes_too:
                    columns += [pa.array([rows[k][a:b] for k, a, b, _ in edges], pa.binary()), pa.array([rows[k][b + reach : c + length] for k, _, b, c in edges], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return texts.join(spots, ["t1", "t2"]).select("t1", "t2", "copies", "text", "spots").mapInArrow(run, ddl)


def _compare(members: DataFrame, window: int, most: int = 512) -> DataFrame:
    """(core, context, least, greatest): for contexts that share a core, the least and greatest number of bytes
    before the core at which one of its strings occurs in another context too, or in one that is repeated.

    Strings of one core are equal if they start equally far before it and agree in the ``window`` bytes besides.
    The contexts of a core are compared where they lie together, up to ``most`` of them. Those of a core that has more
    are not gathered at all: the names of their strings are counted by Spark, with sums before the shuffle.
    """
    members = written(members.select("core", "context", "begin", "first", "last", "left", "right", "repeated"), "members")
    hot = written(members.groupBy("core").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > most).select("core"), "hot-cores")
    hot = small(hot, hot.count())
    few = _compare_gathered(members.join(hot, "core", "left_anti"), window)
    return few.unionByName(_compare_counted(members.join(hot, "core", "left_semi"), window))


def _compare_counted(members: DataFrame, window: int) -> DataFrame:
    fields = {"core": pa.int64(), "context": pa.int64(), "back": pa.int32(), "h1": pa.int64(), "h2": pa.int64(), "weight": pa.int32()}
    schema, ddl = arrow_schema(fields)

    def run(batches):
        digest, low = xxhash.xxh3_128_intdigest, (1 << 64) - 1
        as_signed = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            for part in slices(batch, 512):
                out = []
                for core, context, begin, first, last, left, right, repeated in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for back in range(max(0, begin - last), min(window, begin - first + 1)):
                        name = digest(left[len(left) - back :] + right[: window - back])
                        out.append((core, context, back, as_signed(name >> 64), as_signed(name & low), 2 if repeated else 1))
                columns = list(zip(*out, strict=True)) if out else [[]] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    strings = written(members.mapInArrow(run, ddl), "hot-strings")
    string = ["core", "back", "h1", "h2"]
    twice = written(strings.groupBy(*string).agg(F.sum("weight").alias("n")).where("n > 1").select(*string), "hot-strings-twice")
    return strings.join(twice, string, "left_semi").groupBy("core", "context").agg(F.min("back").alias("least"), F.max("back").alias("greatest"))


def _compare_gathered(members: DataFrame, window: int) -> DataFrame:
    dealt = members.repartition(partitions(members.sparkSession), "core").sortWithinPartitions("core")
    schema, ddl = arrow_schema({"core": pa.int64(), "context": pa.int64(), "least": pa.int32(), "greatest": pa.int32()})

    def settle(group: list[tuple]):
        least, greatest = {}, {}
        for back in range(window):
            seen: dict[bytes, int] = {}
            keys = []
            for _, context, begin, first, last, left, right, repeated in group:
                if first <= begin - back <= last:
                    key = left[len(left) - back :] + right[: window - back] if back else right[:window]
                    seen[key] = seen.get(key, 0) + (2 if repeated else 1)
                    keys.append((context, key))
            for context, key in keys:
                if seen[key] > 1:
                    least.setdefault(context, back)
                    greatest[context] = back
        return [(group[0][0], c, least[c], greatest[c]) for c in least]

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    out += settle(held)
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
        if held and (out := settle(held)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return dealt.mapInArrow(run, ddl)


def _cut(texts: DataFrame) -> DataFrame:
    """(t1, t2, n_bytes, spans, kept, passage_words) for rows (t1, t2, text, spans, shared): maximal runs, and the bytes
    outside them."""
    pair = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("n_bytes", pa.int64()), ("spans", pair), ("kept", pa.binary()), ("passage_words", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = []
                for text, some, shared in zip(*(part.column(c).to_pylist() for c in ("text", "spans", "shared")), strict=True):
                    data, runs = text.encode(), merged((x["a"], x["b"]) for x in some or ())
                    edges = [0, *[e for r in runs for e in r], len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    out.append((len(data), [{"a": a, "b": b} for a, b in runs], kept, shared or 0))
                columns = list(zip(*out, strict=True)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([part.column("t1"), part.column("t2"), *(pa.array(c, t) for c, t in zip(columns, schema.types[2:], strict=True))], schema=schema)

    return texts.select("t1", "t2", "text", "spans", "shared").mapInArrow(run, "t1 long, t2 long, n_bytes long, spans array<struct<a:long,b:long>>, kept binary, passage_words long")


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs: spans that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_spans(texts: DataFrame, length: int, window: int) -> DataFrame:
    """(t1, t2, spans array<(a, b)>): byte spans covered by strings of ``length`` bytes that start elsewhere too, in
    the distinct ``texts``; spans may overlap. Left out: texts without any, and texts that have copies."""
    cores = written(_cores(texts, length, window), "cores")
    common = written(cores.groupBy("core").count().where("count > 1").select("core"), "common-cores")
    shared = cores.join(common.hint("shuffle_hash"), "core", "left_semi")
    spots = written(shared.groupBy("t1", "t2").agg(F.collect_list(F.struct("core", "at", "gap")).alias("spots")), "spots")
    found = written(_contexts(texts, spots, length, window, False), "contexts")
    # a context that occurs twice settles itself; in cores with several contexts the others are compared
    stats = found.groupBy("core", "context").agg((F.sum("copies") > 1).alias("repeated"), F.min(F.struct("t1", "t2", "begin", "first", "last")).alias("one"))
    several = written(found.groupBy("core").agg((F.min("context") != F.max("context")).alias("several")), "core-counts")
    stats = written(written(stats, "contexts-named").join(several, "core"), "context-counts")
    ask = stats.where("several").select("core", "context", "repeated", "one.*")
    again = ask.groupBy("t1", "t2").agg(F.collect_list(F.struct("core", (F.col("begin") + window).alias("at"), (F.col("begin") - F.col("first") + 1).alias("gap"))).alias("spots"))
    members = _contexts(texts, again, length, window, True).join(ask.select("core", "context", "repeated", "t1", "t2", "begin"), ["core", "context", "t1", "t2", "begin"])
    compared = _compare(members, window)
    settled = stats.join(compared, ["core", "context"], "left").where("repeated or least is not null").select("core", "context", "repeated", "least", "greatest")
    settled = written(settled, "settled")  # so that the join below stands alone and hot contexts can be split
    hits = found.where("copies = 1").join(settled, ["core", "context"])
    a = F.when(F.col("repeated"), F.col("first")).otherwise(F.col("begin") - F.col("greatest"))
    b = F.when(F.col("repeated"), F.col("last")).otherwise(F.col("begin") - F.col("least")) + length
    return hits.groupBy("t1", "t2").agg(F.collect_list(F.struct(a.alias("a"), b.alias("b"))).alias("spans"))


def cut_repeats(docs: DataFrame, length: int = 400, words: int = 51, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The cleaned corpus, one row per document: ``doc_id``, ``n_bytes`` (of the input), ``spans`` (maximal removed runs
    of bytes, from a up to before b), ``kept`` (the bytes left, concatenated; a cut may fall within a code point) and
    ``passage_words`` (words in runs of ``words`` or more that another document has too: passages shorter than ``length``
    bytes are seen by it, though they stay).
    Removed is each byte covered by a string of ``length`` bytes that also starts anywhere else in the corpus, in the
    same document or another; strings do not cross documents and are judged on the input.

    A null text is an empty one. Null ids and repeated rows count as documents of their own, so rows with equal
    texts of at least ``length`` bytes lose every byte. An empty table gives an empty result; other columns are
    not read. ``length`` is at least 32.
    """
    return _repeats(docs, length, words, id_column, text_column, lambda found: found)


def _repeats(docs: DataFrame, length: int, words: int, id_column: str, text_column: str, asked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``cut_repeats``, with what is ``asked`` of its columns taken once for each distinct text, where that text lies."""
    window = (length - GRAM) // 3
    if length < 32:
        raise ValueError("length: 32 or more")
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), text.alias("text")).withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(7), "text"))
    shortest = min(length, 2 * words - 1)
    texts = distinct_texts(rows, shortest)
    some = repeated_spans(texts.where(F.octet_length("text") >= length), length, window)
    copies = texts.where((F.col("copies") > 1) & (F.octet_length("text") >= length)).select("t1", "t2", F.array(F.struct(F.lit(0).alias("a"), F.octet_length("text").alias("b"))).alias("spans"))
    found = some.unionByName(copies).withColumn("shared", F.lit(0).cast("long")).unionByName(shared_words(texts, words).withColumn("spans", F.lit(None).cast("array<struct<a:int,b:int>>")))
    spans = written(found.groupBy("t1", "t2").agg(F.first("spans", ignorenulls=True).alias("spans"), F.max("shared").alias("shared")), "spans")
    # the texts lie where their names hash to, so only ids and what is asked of each text move
    cut = asked(_cut(texts.join(spans, ["t1", "t2"], "left")))
    of_texts = rows.where(F.octet_length("text") >= shortest).select("doc_id", "t1", "t2").join(cut, ["t1", "t2"]).drop("t1", "t2")
    brief = rows.where(F.octet_length("text") < shortest)
    kept, none = F.col("text").cast("binary"), F.array().cast("array<struct<a:bigint,b:bigint>>")
    return of_texts.unionByName(asked(brief.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("spans"), kept.alias("kept"), F.lit(0).cast("long").alias("passage_words"))))




def remove_repeats(docs: DataFrame, length: int = 400, words: int = 51, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``cut_repeats`` in figures, one row per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``,
    ``kept_sha256`` (of the bytes left) and ``passage_words``."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    figures = ["n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "passage_words"]
    found = _repeats(docs, length, words, id_column, text_column, lambda cut: cut.select(*[c for c in ("t1", "t2", "doc_id") if c in cut.columns], *figures))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "passage_words")
