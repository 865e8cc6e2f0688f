"""Writing results back: one atomic replacement per file, safe to run again."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def backup_names(results: DataFrame, backup_dir: str | None = None) -> DataFrame:
    """``results`` with ``backup_path``: beside the file, or in one folder with names made distinct before any task
    runs: the basename, then parent_stem.ext, then parent_stem_n.ext."""
    if not backup_dir:
        return results.withColumn("backup_path", F.concat("path", F.lit(".bak")))
    base, parent = F.substring_index("path", "/", -1), F.element_at(F.split("path", "/"), -2)
    ext = F.when(base.rlike(r"^.+\.[^.]*$"), F.concat(F.lit("."), F.substring_index(base, ".", -1))).otherwise("")
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(ext))
    named = results.withColumn("__base", base).withColumn("__second", F.concat(F.coalesce(parent, F.lit("")), F.lit("_"), stem)).withColumn("__ext", ext)
    named = named.withColumn("__n", F.row_number().over(W.partitionBy("__base").orderBy("path")))
    named = named.withColumn("__m", F.row_number().over(W.partitionBy("__second", "__ext", F.col("__n") == 1).orderBy("path")))
    name = F.when(F.col("__n") == 1, F.col("__base")).when(F.col("__m") == 1, F.concat("__second", "__ext")).otherwise(F.concat("__second", F.lit("_"), (F.col("__m") - 1).cast("string"), "__ext"))
    return named.withColumn("backup_path", F.concat(F.lit(backup_dir.rstrip("/") + "/"), name)).drop("__base", "__second", "__ext", "__n", "__m")


def _by_row(rows: DataFrame, work, go_on: bool, gone: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` without the columns ``gone``, with ``written`` and ``error``: what ``work(row)`` returns, and its OSError;
    with ``go_on`` off that error ends the job."""
    kept = [f for f in rows.schema.fields if f.name not in gone]
    schema = T.StructType([*kept, T.StructField("written", T.BooleanType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part, out = batch.slice(k, 64), []
                for row in part.to_pylist():
                    try:
                        out.append((bool(work(row)), None))
                    except OSError as error:
                        if not go_on:
                            raise
                        out.append((False, str(error)))
                done = [pa.array([r[n] for r in out], t) for n, t in enumerate((pa.bool_(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *done], [*(f.name for f in kept), "written", "error"])

    return rows.mapInArrow(run, schema)


def _replaced(dest: str, fill: Callable[[str], None], like: str) -> None:
    """``dest`` made by ``fill`` under another name in the same folder, with the mode of ``like``, then given its name."""
    os.makedirs(os.path.dirname(dest), exist_ok=True)
    handle, temp = tempfile.mkstemp(dir=os.path.dirname(dest), prefix=".new-")
    os.close(handle)
    try:
        fill(temp)
        if os.path.exists(like):
            shutil.copymode(like, temp)
        os.replace(temp, dest)
    finally:
        if os.path.exists(temp):
            os.unlink(temp)


def commit(results: DataFrame, everything: bool = False, go_on: bool = True) -> DataFrame:
    """Writes each replaced row's content (``everything``: each row's) to ``dest_path``, else ``path``, after a backup to
    ``backup_path`` if that is given. Returns the rows without their contents, with ``written`` and ``error``. The new
    bytes go to a temporary file in the same folder and take the name at once; a task that runs again finds the bytes
    in place and leaves the backup alone. ``go_on`` off: the first file that cannot be written ends the job."""
    def work(row: dict) -> bool:
        path, content, backup = row["path"], row["content"], row.get("backup_path")
        dest = row.get("dest_path") or path
        if content is None or not (everything or row["replaced"]):
            return False
        if os.path.exists(dest) and os.path.getsize(dest) == len(content):
            with open(dest, "rb") as file:
                if file.read() == content:
                    return False
        if backup and os.path.exists(path) and not os.path.exists(backup):
            os.makedirs(os.path.dirname(backup), exist_ok=True)
            shutil.copy2(path, backup)

        def fill(temp: str) -> None:
            with open(temp, "wb") as file:
                file.write(content)
        _replaced(dest, fill, path)
        return True

    columns = [c for c in results.columns if c not in ("dest_path", "backup_path")]
    return _by_row(results, work, go_on, ("content", "dest_path", "backup_path")).select(*[c for c in columns if c != "content"], "written", "error")


def mirrored(rows: DataFrame, go_on: bool = True) -> DataFrame:
    """Copies each ``path`` to its ``dest_path``, file to file; the rows with ``written`` and ``error``."""
    def work(row: dict) -> bool:
        _replaced(row["dest_path"], lambda temp: shutil.copyfile(row["path"], temp), row["path"])
        return True
    return _by_row(rows, work, go_on)
