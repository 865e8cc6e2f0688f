"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.worker import release
from quern.plans.tables import bounded_batches, shared_folder, shuffles_dropped, written

__all__ = ["WORD", "arrow_schema", "bounded_batches", "connected_components", "for_a_task", "partitions", "shared_folder", "shuffles_dropped", "slices", "small", "texts", "written"]

#: What the contracts call a word: a run of bytes other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """A table of short rows whose number is known: broadcast up to ``most``, else joined as Spark sees fit."""
    return F.broadcast(df) if rows <= most else df


def arrow_schema(fields: dict[str, pa.DataType]) -> tuple[pa.Schema, str]:
    """An Arrow schema and the same as a DDL string."""
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean", pa.binary(): "binary", pa.list_(pa.int32()): "array<int>"}
    return pa.schema(list(fields.items())), ", ".join(f"`{k}` {names[v]}" for k, v in fields.items())


def for_a_task(make: Callable, work: Callable) -> Callable:
    """``work(made, batches)`` for ``mapInArrow``, with something large that each task makes anew and gives back at its
    end: kept from task to task, idle Python workers would hold it through stages that do not ask for it."""
    def run(batches):
        try:
            yield from work(make(), batches)
        finally:
            gc.collect()
            release()
    return run


def slices(batch: pa.RecordBatch, rows: int = 1024, nbytes: int = 16 << 20):
    """``batch`` in pieces of at most ``rows`` rows and about ``nbytes``, so that few Python strings live at once."""
    step = max(1, min(rows, int(batch.num_rows * nbytes / max(1, batch.nbytes))))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """A string column, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def connected_components(edges: DataFrame, at_once: int = 200_000) -> DataFrame:
    """(node, component) for the undirected ``edges`` (a, b: long); component is the smallest node reachable. Nodes are
    those of edges between two different nodes; edges with a null count for nothing.

    Each round every node hooks to its smallest neighbour, if that is smaller; the trees that come of it are flattened
    to their roots, and the edges between roots are the next round's graph. Of the nodes that have neighbours, at most
    half are left after two rounds (a node left has taken in at least one), so rounds grow with the logarithm of
    the number of nodes, however ids lie along chains, and the graph shrinks as fast. A hub is only ever aggregated with
    ``min`` and joined; no neighbour list is built, and nothing but "how many more" reaches the driver. A graph of at most
    ``at_once`` edges, or what rounds have left of a larger one, is settled by one task: for so few, the plans of further
    rounds cost the driver more than their rows cost anyone.
    """
    graph = written(_ordered(edges.select("a", "b")), "edges")
    levels = []
    while (left := graph.count()) > at_once:
        up = _flattened(graph.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("up")))
        levels.append(up)
        for end in ("high", "low"):
            graph = graph.join(up, graph[end] == up.node, "left").withColumn(end, F.coalesce("up", end)).select("high", "low")
        graph = written(_ordered(graph.select(F.col("high").alias("a"), F.col("low").alias("b"))), "edges")
    empty = edges.sparkSession.range(0).select(F.col("id").alias("node"), F.col("id").alias("component"))
    found = written(_settled(graph), "components") if left else empty
    for up in reversed(levels):  # roots of one round are nodes of later ones; written, as the plan holds each twice
        here = up.join(found.select(F.col("node").alias("root"), "component"), F.col("up") == F.col("root"), "left")
        found = written(here.select("node", F.coalesce("component", "up").alias("component")).unionByName(found), "components")
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def _settled(graph: DataFrame) -> DataFrame:
    """(node, component) of the nodes that are not the smallest of theirs, for a few edges (high, low), by one task."""
    schema, ddl = arrow_schema({"node": pa.int64(), "component": pa.int64()})

    def run(batches):
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (above := up.get(x, x)) != x:
                up[x] = up.get(above, above)
                x = up[x]
            return x

        for batch in batches:
            for high, low in zip(batch.column("high").to_pylist(), batch.column("low").to_pylist(), strict=True):
                high, low = root(high), root(low)
                if high != low:
                    up[max(high, low)] = min(high, low)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], schema=schema)

    return graph.repartition(1).mapInArrow(run, ddl)


def _ordered(pairs: DataFrame) -> DataFrame:
    """Each pair (a, b) of different values once, as (high, low)."""
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()


def _flattened(up: DataFrame) -> DataFrame:
    """(node, up) with ``up`` replaced by the root that pointers lead to; their depth falls to a quarter each time."""
    while True:
        far = up
        for _ in range(2):
            next_ = far.select(F.col("node").alias("via"), F.col("up").alias("beyond"))
            far = far.join(next_, F.col("up") == F.col("via"), "left").select("node", F.coalesce("beyond", "up").alias("up"))
        far = written(far, "hooks")
        deep = far.join(far.select(F.col("node").alias("via")), F.col("up") == F.col("via"), "left_semi")
        if deep.isEmpty():
            return far
        up = far
