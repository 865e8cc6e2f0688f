"""Near-duplicates by exact Jaccard similarity of word shingles: SimHashes and a prefix filter propose, comparison decides.

SimHashes at a few bits' distance, from the byte-position index of ``simhash``, find most copies but not all pairs at a
given similarity; a prefix filter over rare shingles proposes the rest, across what SimHashes have linked. Every pair of distinct shingle sets at the wanted similarity is found; nothing is capped or sampled:

1. *Prefixes by hash.* Two sets that overlap enough share at least l of their lowest hashes, if each lists l more than
   it may lack. A set with fewer than l of them in any other row has no partner and goes.
2. *SimHashes.* Sets left that chains of SimHashes at ``distance`` bits or less connect are compared in full (4); those
   that are similar are linked and count as one from here on.
3. *Prefixes by rarity.* Shingles are ordered by the number of sets that hold them. A set with over its permitted
   share of shingles of its own goes; the others are listed under the rare end of their order. A list proposes pairs
   only across what step 2 has linked.
4. *Verification.* Sets that proposals connect are compared in full. Only links of a spanning tree come out, so a group
   of n copies gives n - 1 rows. A connected group of much text is dealt in blocks of which each two meet in a cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import arrow_schema, bounded_batches, connected_components, partitions, slices, small, texts, written
from quern.llm.simhash import links_between, one_of_each, row_key, shingle_hashes, simhash
from quern.operators.worker import lean, leanly

#: Jaccard similarity, as a fraction.
ALIKE = (4, 5)


def shingle_set(text: str, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def set_name(shingles: np.ndarray) -> int:
    """64 bits, signed; sets are told apart by it."""
    return signed(xxhash.xxh3_64_intdigest(shingles.tobytes()))


def names_of(text: Column, width: int) -> Column:
    @F.arrow_udf("long")
    @leanly
    def names(column: pa.Array) -> pa.Array:
        out = []
        for part in slices(pa.RecordBatch.from_arrays([column], ["text"])):
            out += [set_name(shingle_set(x, width)) for x in texts(part, "text")]
        return pa.array(out, pa.int64())

    return names(text)


def least_overlap(n: int, alike: tuple[int, int] = ALIKE) -> int:
    """Shingles that a set of ``n`` has in common with any set as similar as that."""
    return -(-n * alike[0] // alike[1])


def _flat(found: list[tuple[int, int, np.ndarray]], schema: pa.Schema) -> pa.RecordBatch:
    counts = [len(s) for *_, s in found]
    values = np.concatenate([s for *_, s in found]) if found else np.zeros(0, np.uint64)
    columns = [np.repeat(np.array([x[k] for x in found], np.int64), counts) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(values.view(np.int64))], schema=schema)


def _alive(docs: DataFrame, width: int, alike: tuple[int, int]) -> DataFrame:
    """(name): sets that the first step leaves."""
    schema, ddl = arrow_schema({"name": pa.int64(), "need": pa.int64(), "shingle": pa.int64()})

    def run(batches):
        for batch in batches:
            for part in slices(batch, 256):
                found = []
                for text in texts(part, "text"):
                    s = shingle_set(text, width)
                    n = len(s)
                    need = max(1, least_overlap(n, alike) // 10)  # what a partner, no smaller than that, lists at least
                    found.append((set_name(s), need, s[: n - least_overlap(n, alike) + max(1, n // 10)]))
                yield _flat(found, schema)

    listed = docs.mapInArrow(lean(run), ddl)
    common = written(listed.groupBy("shingle").count().where("count > 1").select("shingle"), "common-shingles")
    hits = listed.join(small(common, common.count(), 2_000_000), "shingle", "left_semi").groupBy("name", "need", "shingle").count()
    return written(hits.groupBy("name", "need").agg(F.count(F.lit(1)).alias("n")).where("n >= need").select("name"), "alive")


def _sets(docs: DataFrame, alive: DataFrame, width: int) -> DataFrame:
    """(name, n, fp, shingles): each distinct set of those ``alive`` once, its hashes ascending, and its SimHash."""
    schema, ddl = arrow_schema({"name": pa.int64(), "n": pa.int64(), "fp": pa.int64(), "shingles": pa.binary()})

    def run(batches):
        for batch in batches:
            for part in slices(batch, 256):
                found = [shingle_set(t, width) for t in texts(part, "text")]
                columns = [set_name(s) for s in found], [len(s) for s in found], [signed(simhash(s)) for s in found], [s.tobytes() for s in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    mine = docs.mapInArrow(lean(run), ddl).join(small(alive, alive.count(), 2_000_000), "name", "left_semi")
    return written(mine.groupBy("name", "n", "fp").agg(F.any_value("shingles").alias("shingles")), "sets")


def _hash_pairs(sets: DataFrame, distance: int) -> DataFrame:
    """(a, b): names of sets that chains of SimHashes at ``distance`` bits or less connect."""
    heads = written(sets.groupBy("fp").agg(F.min("name").alias("b"), F.max("name").alias("most")), "set-prints")
    same = sets.join(heads.where("b < most"), "fp").where("name <> b").select(F.col("name").alias("a"), "b")
    links = links_between(heads.select("fp"), distance).withColumnsRenamed({"a": "x", "b": "y"})
    one, other = (heads.select(F.col("fp").alias(k), F.col("b").alias(n)) for k, n in (("x", "a"), ("y", "b")))
    return same.union(links.join(one, "x").join(other, "y").select("a", "b"))


def _rare_pairs(sets: DataFrame, linked: DataFrame, alike: tuple[int, int]) -> DataFrame:
    """(a, b): heads of sets that the prefix filter proposes. A set's head is its component in ``linked`` (node,
    component), else itself; lists whose sets have one head, being linked as they are, propose nothing."""
    schema, ddl = arrow_schema({"name": pa.int64(), "n": pa.int64(), "shingle": pa.int64()})

    def run(batches):
        for batch in batches:
            for part in slices(batch, 256):
                rows = zip(*(part.column(c).to_pylist() for c in ("name", "n", "shingles")), strict=True)
                yield _flat([(name, n, np.frombuffer(s, np.uint64)) for name, n, s in rows], schema)

    held = sets.mapInArrow(lean(run), ddl)
    common = written(held.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"), "shared-shingles")
    ranked = held.join(common, "shingle").groupBy("name", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "shingle"))).alias("order"))
    spare = F.size("order") - F.expr(f"(n * {alike[0]} + {alike[1] - 1}) div {alike[1]}").cast("int")
    ranked = ranked.where(spare >= 0).join(linked, F.col("name") == F.col("node"), "left").withColumn("head", F.coalesce("component", "name"))
    listed = written(ranked.select("head", F.explode(F.slice("order", 1, spare + 1)).alias("o")).select("head", "o.shingle"), "rare-ends")
    first = listed.groupBy("shingle").agg(F.min("head").alias("b"), F.max("head").alias("most")).where("b < most").select("shingle", "b")
    return listed.join(first, "shingle").where("head <> b").select(F.col("head").alias("a"), "b").distinct()


def tree_links(names: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, alike: tuple[int, int] = ALIKE) -> list[tuple[int, int]]:
    """Links that connect all that similar pairs of ``sets`` (with ``side``: only pairs across it) connect."""
    sizes = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    values, spots = np.unique(np.concatenate(sets), return_inverse=True)
    rest, links = np.arange(len(sets)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            k = queue.pop()
            has = np.zeros(len(values), np.int32)
            has[spots[starts[k] : starts[k] + sizes[k]]] = 1
            overlap = np.add.reduceat(has[spots], starts)[rest]
            near = overlap * (alike[0] + alike[1]) >= alike[0] * (sizes[k] + sizes[rest])
            if side is not None:
                near &= side[rest] != side[k]
            links += [(int(names[k]), int(names[f])) for f in rest[near]]
            queue += rest[near].tolist()
            rest = rest[~near]
    return links


def similar_links(sets: DataFrame, alike: tuple[int, int] = ALIKE, distance: int = 4, block: int = 1 << 20) -> DataFrame:
    """(a, b) between names of ``sets`` that connect exactly what pairs of that similarity connect. What SimHashes
    propose is compared first; the prefix filter then proposes across what they have linked."""
    near = written(_compared(sets, connected_components(_hash_pairs(sets, distance)), alike, block), "simhash-links")
    linked = connected_components(near)
    groups = connected_components(_rare_pairs(sets, linked, alike)).withColumnsRenamed({"node": "head", "component": "group"})
    heads = sets.select("name").join(linked, F.col("name") == F.col("node"), "left").select(F.col("name").alias("node"), F.coalesce("component", "name").alias("head"))
    rest = written(heads.join(groups, "head").select("node", F.col("group").alias("component")), "rare-groups")
    return near.unionByName(_compared(sets, rest, alike, block))


def _compared(sets: DataFrame, groups: DataFrame, alike: tuple[int, int], block: int) -> DataFrame:
    """Links (a, b) that connect what similar pairs within ``groups`` (node, component) connect. Groups of more than
    ``block`` shingles are split in blocks of about that many, and each two blocks meet in a cell."""
    rows = written(sets.join(groups, sets.name == groups.node).select("component", "name", "n", "shingles"), "candidates")
    large = rows.groupBy("component").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks")).where("blocks > 1")
    mine = F.pmod(F.xxhash64("name", F.lit(7)), F.col("blocks")).cast("int")
    cells = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("mine")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, mine).alias("x"), F.greatest(o, mine).alias("y"), mine.alias("mine"))))
    dealt = rows.join(large, "component", "left").select("component", "name", "shingles", F.explode(cells).alias("c")).select("component", "c.*", "name", "shingles")
    dealt = dealt.repartition(partitions(sets.sparkSession), "component", "x", "y").sortWithinPartitions("component", "x", "y", "name")
    schema, ddl = arrow_schema({"a": pa.int64(), "b": pa.int64()})

    def settle(held: list[tuple]):
        (_, x, y, *_), side = held[0], np.array([r[3] for r in held])
        links = tree_links(np.array([r[4] for r in held]), [np.frombuffer(r[5], np.uint64) for r in held], None if x == y else side, alike)
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], schema=schema)

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    yield settle(held)
                    held = []
                held.append(row)
        if held:
            yield settle(held)

    return dealt.mapInArrow(lean(run), ddl)


def keep_one_alike(docs: DataFrame, width: int = 5, alike: tuple[int, int] = ALIKE, distance: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each group that chains of pairs at Jaccard similarity ``alike`` or more connect, over
    sets of ``width``-word shingles (A-Z lower-cased); the row of smallest id, columns as they were.

    A text of fewer words is one shingle. Texts without words, null ones among them, are alike. Rows are told apart as in
    ``simhash.keep_one``, so repeated rows and rows without id are kept once for their group. An empty table gives an
    empty result; the other columns, whatever their names, go along.
    """
    bounded_batches(docs.sparkSession)
    named = written(docs.select(*row_key(docs, id_column, text_column), names_of(F.col(f"`{text_column}`"), width).alias("fp")), "named-rows")
    only = docs.select(F.col(f"`{text_column}`").alias("text"))
    linked = written(connected_components(similar_links(_sets(only, _alive(only, width, alike), width), alike, distance)), "alike")
    names = named.select("fp").distinct()
    placed = names.join(linked, names.fp == linked.node, "left").select("fp", F.coalesce("component", "fp").alias("component"))
    return one_of_each(docs, named, placed, id_column, text_column)
