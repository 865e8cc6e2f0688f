"""SimHash near-duplicates: a byte-position inverted index with count filtering, then exact verification."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.shared import arrow_schema, bounded_batches, connected_components, partitions, slices, small, texts, written

LOWER = {c: c + 32 for c in range(65, 91)}
BLANKS = {c: 32 for c in range(9, 14)}


def shingle_hashes(text: str, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``width`` words (A-Z lower-cased, space-joined); of the whole text if it has fewer words."""
    words = text.translate(LOWER | BLANKS).split(" ")
    data = " ".join(filter(None, words)).encode()
    if not data:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(data)]
    ends = ends[width - 1 :] or [len(data)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(data[a:b], seed) for a, b in zip(starts, ends, strict=False)), np.uint64, len(ends))


def simhash(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half the hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)), bitorder="little").view(np.uint64)[0])


def simhash_of(text: Column, shingle: int) -> Column:
    """The 64-bit SimHash of a text column as a signed long; zero for a null."""
    @F.arrow_udf("long")
    def prints(column: pa.Array) -> pa.Array:
        out = []
        for part in slices(pa.RecordBatch.from_arrays([column], ["text"])):
            out += [simhash(shingle_hashes(x, shingle)) for x in texts(part, "text")]
        return pa.array(np.array(out, np.uint64).view(np.int64), pa.int64())

    return prints(text)


def fingerprints(docs: DataFrame, shingle: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each text as a signed long."""
    return docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), simhash_of(F.col(f"`{text_column}`"), shingle).alias("fp"))


def key_positions(equal: int, picked: int = 3) -> list[tuple[int, ...]]:
    """Sets of ``picked`` byte positions such that any ``equal`` positions hold one of them (greedy covering)."""
    picked = min(picked, equal)
    open_sets = {frozenset(c) for c in combinations(range(8), equal)}
    chosen = []
    while open_sets:
        best = max(combinations(range(8), picked), key=lambda c: sum(set(c) <= s for s in open_sets))
        chosen.append(best)
        open_sets = {s for s in open_sets if not set(best) <= s}
    return chosen


def _tree_links(block: np.ndarray, other: np.ndarray | None, distance: int, equal: int) -> list[tuple[int, int]]:
    """Links that connect all fingerprints of ``block`` (or of block and other, only across them) that the rule connects.

    A breadth-first walk: each fingerprint reached is compared with those not reached yet, so a dense group of n
    costs about n comparisons and gives n - 1 links. First the equal byte positions are tallied; pairs with the
    guaranteed minimum are verified by their differing bits.
    """
    values = block if other is None else np.concatenate([block, other])
    side = np.zeros(len(values), bool)
    if other is not None:
        side[len(block) :] = True
    rest, links = np.arange(len(values)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            k = queue.pop()
            differs = values[rest] ^ values[k]
            tally = (differs.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = tally >= equal
            near[near] = np.bitwise_count(differs[near]) <= distance
            if other is not None:
                near &= side[rest] != side[k]
            if near.any():
                found = rest[near]
                links += [(int(values[k]), int(values[f])) for f in found]
                queue += found.tolist()
                rest = rest[~near]
    return links


def links_between(prints: DataFrame, distance: int = 4, block: int = 8192) -> DataFrame:
    """Edges (a, b) between distinct 64-bit values that connect exactly what pairs at ``distance`` bits or less connect.

    Such pairs share at least ``8 - distance`` of 8 byte positions. Each value is listed under keys of three byte
    positions chosen so that any such pair meets under one. A list of more than ``block`` values is split: its
    values fall in blocks by hash and each two blocks meet in a cell of their own, so no task holds a whole list.
    """
    if not 0 <= distance <= 7:
        raise ValueError("distance: 0 to 7")
    spark, equal = prints.sparkSession, 8 - distance
    sets = key_positions(equal)
    n = partitions(spark)
    masks = [sum(0xFF << (8 * p) for p in s) for s in sets]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("which", "key"))
    large = written(keyed.groupBy("which", "key").count().where(F.col("count") > block)
                    .select("which", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large-lists")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    cells = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("mine")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, mine).alias("x"), F.greatest(o, mine).alias("y"), mine.alias("mine"))))
    dealt = keyed.join(large, ["which", "key"], "left").select("fp", "which", "key", F.explode(cells).alias("c")).select("fp", "which", "key", "c.*")
    dealt = dealt.repartition(n, "which", "key", "x", "y").sortWithinPartitions("which", "key", "x", "y", "mine", "fp")
    schema, ddl = arrow_schema({"a": pa.int64(), "b": pa.int64()})

    def run(batches):
        held = None
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("which", "key", "x", "y", "mine", "fp")]
            held = new if held is None else [np.concatenate(p) for p in zip(held, new, strict=True)]
            changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in held[:4]], axis=0)) + 1
            if len(changes):
                yield from settle([c[: changes[-1]] for c in held], [0, *changes.tolist()])
                held = [c[changes[-1] :] for c in held]
        if held is not None and len(held[0]):
            yield from settle(held, [0, len(held[0])])

    def settle(columns, bounds):
        links: list[tuple[int, int]] = []
        x, y, mine, fp = columns[2], columns[3], columns[4], columns[5].view(np.uint64)
        bounds = np.array(bounds)
        for k in np.flatnonzero(np.diff(bounds) > 1):
            a, b = bounds[k], bounds[k + 1]
            if x[a] == y[a]:
                links += _tree_links(fp[a:b], None, distance, equal)
            else:
                m = a + int((mine[a:b] == x[a]).sum())
                links += _tree_links(fp[a:m], fp[m:b], distance, equal)
        if links:
            pairs = np.array(links, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    return dealt.mapInArrow(run, ddl)


def components(docs: DataFrame, shingle: int, distance: int, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, fp, component, component_id) per row: component is a fingerprint that names the group."""
    prints = written(fingerprints(docs, shingle, id_column, text_column), "fingerprints")
    groups = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    linked = connected_components(links_between(groups.select("fp"), distance))
    placed = groups.join(linked, groups.fp == linked.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    heads = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(placed.join(heads, "component").select("fp", "component", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 lowercase hex digits) and ``component_id``, the smallest
    doc_id that chains of fingerprints at ``distance`` differing bits or less reach, its own included.

    A null or empty text has fingerprint zero and links like any other. Copies collapse to one fingerprint before
    any comparison, so repeated rows cost nothing further. A row with a null id takes part in linking; the
    smallest id ignores it, and a group of null ids only has a null component. An empty table gives an empty
    result; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    found = components(docs, shingle, distance, id_column, text_column)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Columns that tell rows apart: id (absent ids last), 128 bits of the text, the row's other values.
ROW_KEY = ["k_none", "k_id", "k_1", "k_2", "k_row"]


def row_key(docs: DataFrame, id_column: str, text_column: str) -> list[Column]:
    own, text = F.col(f"`{id_column}`").cast("long"), F.col(f"`{text_column}`")
    values = [F.map_entries(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in docs.schema.fields]
    keys = own.isNull(), F.coalesce(own, F.lit(0).cast("long")), F.xxhash64(text), F.xxhash64(F.lit(7), text), F.xxhash64(F.struct(*values))
    return [k.alias(name) for k, name in zip(keys, ROW_KEY, strict=True)]


def one_of_each(docs: DataFrame, named: DataFrame, placed: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``docs`` with the first row, by ``ROW_KEY``, of each component. ``named``: (``ROW_KEY``, fp) of every row;
    ``placed``: (fp, component). Rows alike in their whole key are counted, and one of them stays."""
    copies = named.groupBy("fp", *ROW_KEY).agg(F.count(F.lit(1)).alias("copies"))
    first = copies.groupBy("fp").agg(F.min(F.struct(*ROW_KEY, "copies")).alias("head"))  # before the join: a text with many copies is one row there
    heads = first.join(placed, "fp").groupBy("component").agg(F.min("head").alias("head")).select("head.*")
    heads = written(heads, "heads")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key(docs, id_column, text_column))
    single = rows.join(heads.where("copies = 1"), ROW_KEY, "left_semi").select("row.*")
    more = heads.where("copies > 1")
    n = more.count()
    if not n:
        return single
    again = rows.join(small(more, n), ROW_KEY, "left_semi").groupBy(*ROW_KEY).agg(F.any_value("row").alias("row"))
    return single.unionByName(again.select("row.*"))


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, the one of smallest id; columns as they were.

    Rows are kept by a key of their own and not by id, so ids may repeat or be null: of equal ids the least hash of
    the text goes first, null ids come last, and of rows that are alike in everything one stays.
    """
    bounded_batches(docs.sparkSession)
    named = written(docs.select(*row_key(docs, id_column, text_column), simhash_of(F.col(f"`{text_column}`"), shingle).alias("fp")), "named-rows")
    prints = written(named.select("fp").distinct(), "distinct-prints")
    linked = connected_components(links_between(prints, distance))
    placed = prints.join(linked, prints.fp == linked.node, "left").select("fp", F.coalesce("component", "fp").alias("component"))
    return one_of_each(docs, named, placed, id_column, text_column)
