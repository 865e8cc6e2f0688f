"""Maximum inner product search: score-aware (anisotropic) product quantisation, four-bit table scans, exact reranking."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import arrow_schema, bounded_batches, partitions, written


class Codebooks(NamedTuple):
    """centres: (subspaces, 16, width of a subspace)."""

    centres: np.ndarray
    weight: float

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """(n, subspaces) four-bit codes that lower ``|r|^2 + (weight - 1) <r, x / |x|>^2`` one subspace at a time."""
        subspaces, _, width = self.centres.shape
        parts = x.reshape(len(x), subspaces, width)
        unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).reshape(parts.shape)
        codes = np.zeros((len(x), subspaces), np.uint8)
        along = np.zeros((len(x), subspaces))  # <r_m, unit_m>
        square, lean = [], []
        for m in range(subspaces):
            rest = parts[:, m, None, :] - self.centres[m][None]
            square.append((rest**2).sum(axis=2))
            lean.append((rest * unit[:, m, None, :]).sum(axis=2))
            codes[:, m] = square[m].argmin(axis=1)
            along[:, m] = np.take_along_axis(lean[m], codes[:, m, None].astype(np.intp), 1)[:, 0]
        for _ in range(rounds):
            for m in range(subspaces):
                others = along.sum(axis=1) - along[:, m]
                codes[:, m] = (square[m] + (self.weight - 1) * (lean[m] + others[:, None]) ** 2).argmin(axis=1)
                along[:, m] = np.take_along_axis(lean[m], codes[:, m, None].astype(np.intp), 1)[:, 0]
        return codes


def fit(sample: np.ndarray, width: int = 4, threshold: float = 0.2, rounds: int = 8, seed: int = 5) -> Codebooks:
    """Codebooks for the anisotropic loss. ``threshold`` is the cosine from which scores matter; it makes an error
    along the vector weigh (dimension - 1) t^2 / (1 - t^2) times one across it. Columns are padded to ``width``."""
    count, dimension = sample.shape
    weight = max(1.0, (dimension - 1) * threshold**2 / (1 - threshold**2))
    subspaces = dimension // width
    random = np.random.default_rng(seed)
    parts = sample.reshape(count, subspaces, width)
    unit = (sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-30)).reshape(parts.shape)
    centres = np.stack([parts[random.choice(count, 16, replace=count < 16), m] for m in range(subspaces)])
    for _ in range(rounds):
        books = Codebooks(centres, weight)
        codes = books.encode(sample, 1)
        for m in range(subspaces):
            near = np.stack([centres[j][codes[:, j]] for j in range(subspaces)], axis=1)
            along = ((parts - near) * unit).sum(axis=2)
            others = along.sum(axis=1) - along[:, m]
            for c in range(16):
                at = codes[:, m] == c
                if at.any():
                    u, x = unit[at, m], parts[at, m]
                    left = at.sum() * np.eye(width) + (weight - 1) * u.T @ u
                    right = x.sum(axis=0) + (weight - 1) * (u * ((u * x).sum(axis=1) + others[at])[:, None]).sum(axis=0)
                    centres[m, c] = np.linalg.solve(left, right)
    return Codebooks(centres, weight)


def scan(queries: np.ndarray, codes: np.ndarray, books: Codebooks) -> np.ndarray:
    """(queries, codes) approximate inner products from four-bit tables of eight-bit entries; a pair of subspaces is
    looked up at once through the 256 sums of its two tables."""
    subspaces, _, width = books.centres.shape
    tables = np.einsum("qmw,mcw->qmc", queries.reshape(len(queries), subspaces, width), books.centres)
    low = tables.min(axis=2, keepdims=True)
    step = np.maximum((tables.max(axis=2, keepdims=True) - low).max(axis=1, keepdims=True) / 255, 1e-30)
    table = np.rint((tables - low) / step).astype(np.uint16)
    total = np.zeros((len(queries), len(codes)), np.uint16 if subspaces * 255 < 1 << 16 else np.uint32)
    for m in range(0, subspaces - 1, 2):
        pair = (table[:, m, :, None] + table[:, m + 1, None, :]).reshape(len(queries), 256)
        total += pair[:, codes[:, m].astype(np.intp) * 16 + codes[:, m + 1]]
    if subspaces % 2:
        total += table[:, -1][:, codes[:, -1]]
    return total


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v): vectors that take part, as doubles; of rows with one id the least vector. Left out: a null id or
    vector, and vectors that are empty, zero or hold null, NaN or infinite components."""
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector_column}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def search(vectors: DataFrame, every: int = 20, k: int = 20, sample: int = 4096, width: int = 4, candidates: int = 768,
           row_block: int | None = None, at_once: int = 64, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """For each row whose id ``every`` divides, its ``k`` nearest among all other rows by inner product:
    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (in double precision, on the original vectors). Ties go
    to the smaller id.

    The codebooks are fitted on at most ``sample`` rows (those of least hash); every row is encoded, once. Rows are dealt
    in blocks of about ``row_block`` (if not given, so many that there are four blocks for each shuffle partition, within
    4,096 and 65,536 rows); each row moves to its block and each query to every block. A task holds one block, its
    vectors and codes, and the queries run past it, ``at_once`` of them: their tables are summed over the codes, the
    ``candidates`` best of the block and all that tie with the last of them are reranked exactly, so a block gives ``k``
    rows a query; these meet in one more top-k. With at most ``candidates`` rows in a block the result is exact.

    See ``usable`` for rows left out and repeated ids. Vectors of a length other than the commonest (the longest
    of several) take no part. An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = written(usable(vectors, id_column, vector_column), "vectors")
    schema, ddl = arrow_schema({"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()})
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension, count = lengths[0]["d"], lengths[0]["count"]
    rows = rows.where(F.size("v") == dimension)
    picked = np.array([r["v"] for r in rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()])
    wide = -(-dimension // width) * width
    pad = lambda x: np.pad(x, ((0, 0), (0, wide - dimension)))
    books = fit(pad(picked), width)
    block = row_block or min(1 << 16, max(1 << 12, -(-count // (4 * partitions(spark)))))
    blocks = -(-count // block)
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("rb"))
    held = rows.select("vec_id", "v", F.lit(False).alias("asks"), F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int").alias("rb"))
    dealt = held.unionByName(asked).repartition(max(blocks, partitions(spark)), "rb").sortWithinPartitions("rb", "asks", "vec_id")

    def nearest(asked_ids: np.ndarray, asked_values: np.ndarray, ids: np.ndarray, values: np.ndarray, codes: np.ndarray) -> list[tuple]:
        out = []
        for mine, vector, scores in zip(asked_ids, asked_values, scan(pad(asked_values), codes, books), strict=True):
            # one more than asked for, as the query itself may be among them
            least = np.partition(scores, -candidates - 1)[-candidates - 1] if len(scores) > candidates + 1 else 0
            some = np.flatnonzero(scores >= least)
            some = some[ids[some] != mine]
            exact = (values[some] * vector).sum(axis=1)
            best = np.lexsort((ids[some], -exact))[:k]
            out.append((np.full(len(best), mine), ids[some][best], exact[best]))
        return out

    def run(batches):
        now, parts, block_of = None, [], None  # number of the block, what has come of it, and it as a whole
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers, asks = batch.column("rb").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            ids, values = batch.column("vec_id").to_numpy(), batch.column("v").flatten().to_numpy().reshape(-1, dimension)
            edges = np.flatnonzero((np.diff(numbers) != 0) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if numbers[a] != now:
                    now, parts, block_of = numbers[a], [], None
                if not asks[a]:
                    parts.append((ids[a:b], values[a:b]))
                    continue
                if not parts:  # a block without rows
                    continue
                if block_of is None:
                    own, vectors_ = (np.concatenate([p[n] for p in parts]) for n in (0, 1))
                    block_of = own, vectors_, np.concatenate([books.encode(pad(vectors_[n : n + 4096])) for n in range(0, len(vectors_), 4096)])
                for at in range(a, b, at_once):
                    end = min(b, at + at_once)
                    columns = zip(*nearest(ids[at:end], values[at:end], *block_of), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], schema=schema)

    parts = dealt.mapInArrow(run, ddl)
    # the best k of each query's blocks: at most k * blocks rows a query, narrowed in two steps
    best = lambda c: F.slice(F.array_sort(c), 1, k)
    item = F.struct((-F.col("score")).alias("less"), F.col("vec_id"), F.col("score"))
    first = parts.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks // 16))).alias("part")).agg(best(F.collect_list(item)).alias("some"))
    last = first.groupBy("query_id").agg(best(F.flatten(F.collect_list("some"))).alias("some"))
    return last.select("query_id", F.posexplode("some").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
