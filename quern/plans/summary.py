"""Totals and reports over results."""

from __future__ import annotations

import json
import os
import shutil
import socket

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.decide import savings_pct
from quern.functions.registry import BINARIES, REQUIRED, TOOLS
from quern.functions.sizes import two_places


def until_first_failure(results: DataFrame) -> DataFrame:
    """What a run that stops at its first failure gets to, in order of path: the rows up to that failure, all if none."""
    first = results.where("status = 'failed'").agg(F.min("path").alias("first_failed"))
    return results.join(F.broadcast(first), F.col("first_failed").isNull() | (F.col("path") <= F.col("first_failed"))).drop("first_failed")


def bulk_summary(results: DataFrame, *by: str | Column, continue_on_error: bool = True) -> DataFrame:
    """Counts by status (processed: neither failed nor skipped) and, over what was processed alone, sizes and the share
    saved; grouped as asked for. Without ``continue_on_error`` only what comes up to the first failure counts."""
    results = results if continue_on_error else until_first_failure(results)
    status = F.col("status")
    done = ~status.isin("failed", "skipped")
    total = results.groupBy(*by).agg(
        F.count_if(done).alias("files_processed"), F.count_if(status == "failed").alias("files_failed"), F.count_if(status == "skipped").alias("files_skipped"),
        F.coalesce(F.sum(F.when(done, F.col("insize"))), F.lit(0)).cast("long").alias("total_original_size"), F.coalesce(F.sum(F.when(done, F.col("outsize"))), F.lit(0)).cast("long").alias("total_final_size"))
    return total.withColumn("total_saved", F.col("total_original_size") - F.col("total_final_size")).withColumn("percent_saved", savings_pct(F.col("total_original_size"), F.col("total_final_size")))


def container_totals(members: DataFrame, *by: str | Column) -> DataFrame:
    """Members with a result, their sizes before and after, per container."""
    return members.groupBy(*by).agg(F.count(F.lit(1)).alias("inner_count"), F.sum("insize").cast("long").alias("inner_insize"), F.sum("outsize").cast("long").alias("inner_outsize"))


def legacy_view(results: DataFrame, *by: str | Column) -> DataFrame:
    """``stats`` [count, in, out], ``final`` [in, out, percent] and the first path; the files themselves are
    ``legacy_files``, as rows and not as a list, which would put a whole container into one task."""
    grouped = results.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("insize").cast("long").alias("i"), F.sum("outsize").cast("long").alias("o"), F.min("path").alias("first_path"))
    keys = [c for c in grouped.columns if c not in ("n", "i", "o", "first_path")]
    return grouped.select(*keys, F.array("n", "i", "o").alias("stats"), F.array(F.col("i").cast("double"), F.col("o").cast("double"), savings_pct(F.col("i"), F.col("o"))).alias("final"), "first_path")


def legacy_files(results: DataFrame, *by: str | Column) -> DataFrame:
    """One row per file: its container and ``file`` [path, in, out, percent] as a struct."""
    return results.select(*by, F.struct("path", "insize", "outsize", "savings_pct").alias("file"))


def rates(files: Column, seconds: Column) -> Column:
    return F.struct(F.try_divide(seconds, files).alias("seconds_per_file"), F.try_divide(files, seconds).alias("files_per_second"))


def csv_rows(results: DataFrame) -> DataFrame:
    """The report's columns, percent in two places."""
    return results.select(
        F.col("path").alias("file"), F.col("insize").alias("original_size"), F.col("outsize").alias("final_size"), two_places(F.col("savings_pct")).alias("savings_percent"),
        (F.col("insize") - F.col("outsize")).alias("savings_bytes"))


def write_csv(results: DataFrame, folder: str) -> None:
    """Files of the report with a header each; nothing at all, the header included, where there are no rows."""
    rows = csv_rows(results)
    rows.write.mode("overwrite").option("header", str(not rows.isEmpty()).lower()).csv(folder)


def write_json(results: DataFrame, folder: str) -> None:
    results.drop("content").write.mode("overwrite").json(folder)


def summary_json(row) -> str:
    """One summary row as the report's JSON text."""
    return json.dumps(row.asDict(recursive=True), indent=2, default=str)


def report_rows(results: DataFrame) -> DataFrame:
    """(document): the processed files of the report as JSON texts, a row each; ``summary_json`` is its head."""
    fields = F.struct(F.col("path").alias("file"), F.col("insize").alias("original_size"), F.col("outsize").alias("final_size"), F.col("savings_pct").alias("savings_percent"), (F.col("insize") - F.col("outsize")).alias("savings_bytes"))
    return results.where(~F.col("status").isin("failed", "skipped")).select(F.to_json(fields).alias("document"))


def exit_code(failed: int, continue_on_error: bool) -> int:
    """0 without failures; else 2 if the run went on, 1 if not."""
    return (2 if continue_on_error else 1) if failed else 0


def resolved(tool: str, configured: dict[str, str]) -> str | None:
    """Path of a tool on this machine: the variable QUERN_<TOOL>, then the configured path, then the first of its
    binaries that PATH has. A name that is no known tool is looked for as it is."""
    names = BINARIES.get(tool, tool).split()
    return os.environ.get(f"QUERN_{tool.upper()}") or configured.get(tool) or configured.get(names[0]) or next((p for x in names if (p := shutil.which(x))), None)


def doctor(spark: SparkSession, configured: dict[str, str] | None = None, probes: int | None = None) -> DataFrame:
    """Each external tool with its status where tasks run: ``ok``, ``missing (required)`` or ``missing (optional)``. Looked for
    by ``probes`` tasks (one a core, if not given), which Spark deals over the executors; a tool is ok if each of them
    finds it, and ``hosts`` counts the machines that have it."""
    own = dict(configured or {})
    probes = probes or spark.sparkContext.defaultParallelism
    tools = [(tool, serves) for serves, keys in TOOLS.items() for tool in keys.split()]

    def look(batches):
        import pyarrow as pa

        for batch in batches:
            for _ in range(batch.num_rows):
                rows = [{"tool": t, "serves": s, "path": resolved(t, own), "host": socket.gethostname()} for t, s in tools]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.string()) for c in ("tool", "serves", "path", "host")]))

    seen = spark.range(probes, numPartitions=probes).mapInArrow(look, "tool string, serves string, path string, host string")
    every = seen.groupBy("tool", "serves").agg(F.min("path").alias("path"), F.count_if(F.col("path").isNull()).alias("lacking"), F.count_distinct(F.when(F.col("path").isNotNull(), F.col("host"))).alias("hosts"))
    status = F.when(F.col("lacking") == 0, "ok").when(F.col("tool").isin(*REQUIRED), "missing (required)").otherwise("missing (optional)")
    return every.select("tool", "serves", "path", "hosts", status.alias("status"))
