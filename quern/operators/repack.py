"""The whole job: identify, filter, walk into archives, re-encode, verify, decide, and put archives together again.

Files are rows. Archives are opened level by level: the members of one level are rows of the next, so a large
archive's members are packed by many tasks; then levels are closed from the innermost out, one archive a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quern.functions import registry as R
from quern.functions.decide import decision
from quern.functions.filters import exceeds_extract_limit, in_excluded_dir, is_plain_zip, media_gate, nested_gate, skip_reason
from quern.functions.identify import kind, last_ext
from quern.functions.verify import verify
from quern.operators import containers
from quern.operators.codecs import PACKERS, Options, holds_tar
from quern.operators.dicom import packable
from quern.operators.worker import lean, leanly, spent
from quern.plans.tables import bounded_batches, written


@F.arrow_udf(T.BooleanType())
@leanly
def _peek(ext: pa.Array, start: pa.Array) -> pa.Array:
    return pa.array([data is not None and holds_tar(e, data) for e, data in zip(ext.to_pylist(), start.to_pylist(), strict=True)], pa.bool_())


@F.arrow_udf(T.BooleanType())
@leanly
def dicom_is_packable(content: pa.Array) -> pa.Array:
    return pa.array([data is not None and packable(data) for data in content.to_pylist()], pa.bool_())


def identified(files: DataFrame) -> DataFrame:
    """``files`` (path, content) with ``kind``; only the first 64 KiB of compressed streams are looked into."""
    ext, content = last_ext(F.col("path")), F.col("content")
    inner = _peek(ext, F.when(ext.isin(R.PEEKED), F.substring(content, 1, 1 << 16)))
    zipped = F.when(ext == "otf", F.substring(content, 1, 4) == F.lit(b"PK\x03\x04"))
    return files.withColumn("kind", kind(F.col("path"), inner, zipped))


def packed(rows: DataFrame, options: Options) -> DataFrame:
    """``rows`` (with packer and content) with ``packed``: the new bytes, null where none could be made."""
    schema = T.StructType([*rows.schema.fields, T.StructField("packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            step = max(1, min(64, batch.num_rows * (4 << 20) // max(1, batch.nbytes)))
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                out = []
                for packer, content in zip(part.column("packer").to_pylist(), part.column("content").to_pylist(), strict=True):
                    out.append(PACKERS[packer](content, options) if packer in PACKERS and content is not None else None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "packed"])

    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(lean(run), schema)


MEMBERS = {"parent": "string", "id": "string", "ord": "int", "path": "string", "header": "binary", "content": "binary"}
#: What putting an archive together again needs to know of it; it goes with each member, the remark with the first alone.
OUTER = {"outer": "string", "bare": "boolean", "remark": "binary"}


def opened(archives: DataFrame, outer: bool = False) -> DataFrame:
    """Member rows of archives (id, family, content); ids are the archive's, ``!/`` and the member's number and name.
    A damaged archive gives no rows. ``outer``: archives have key and remark too, and members say what ``OUTER`` lists."""
    fields = MEMBERS | (OUTER if outer else {})
    schema = pa.schema([(k, {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[v]) for k, v in fields.items()])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for parent, family, data, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found = list(containers.members(family, data))
                except Exception:  # damaged in any of the ways the readers know: the archive stays as it is
                    continue
                for part in runs_within(found):
                    rows = []
                    for n in part:
                        name, header, content = found[n]
                        rows.append((parent, f"{parent}!/{n}:{name}", n, name, header, content, *((family, more[0] in R.SENSITIVE, more[1] if n == 0 else None) if outer else ())))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return archives.select("id", "family", "content", *(("key", "remark") if outer else ())).mapInArrow(lean(run), ", ".join(f"{k} {v}" for k, v in fields.items()))


def runs_within(found: list[tuple], rows: int = 64, nbytes: int = 4 << 20) -> Iterator[range]:
    """Members in runs of at most ``rows`` and, but for a single one, about ``nbytes``."""
    first = size = 0
    for k, (_, _, content) in enumerate(found):
        size += len(content or b"")
        if k > first and (size > nbytes or k - first == rows):
            yield range(first, k)
            first, size = k, len(content or b"")
    if first < len(found):
        yield range(first, len(found))


KIND = T.StructType([T.StructField("key", T.StringType()), T.StructField("family", T.StringType()), T.StructField("packer", T.StringType()), T.StructField("is_archive", T.BooleanType())])
LOOK = T.StructType([*KIND.fields, T.StructField("unpacked", T.LongType()), T.StructField("signed", T.BooleanType()), T.StructField("remark", T.BinaryType())])


def _inspect(options: Options):
    """A kind with what its archive says: unpacked size, signature, remark."""
    @F.arrow_udf(LOOK)
    @leanly
    def look(kinds: pa.Array, archive: pa.Array) -> pa.Array:
        rows = []
        for k, content in zip(kinds.to_pylist(), archive.to_pylist(), strict=True):
            row = dict(k or {"is_archive": False}) | {"signed": False}
            if content is not None:
                row |= {"unpacked": containers.declared_size(row["family"], content, options.extract_budget(len(content)))}
                row |= {"signed": containers.is_signed(row["key"], content), "remark": containers.comment(content)} if row["family"] == "zip" else {}
            rows.append(row)
        return pa.array(rows, to_arrow_type(LOOK))
    # so that filters on what is found stay above it, and it is not worked out once more for each of them
    return look.asNondeterministic()


READABLE = ("zip", "tar", *(f"tar.{c}" for c in ("gz", "bz2", "xz", "zst", "br", "lz4", "lzma")))


def with_name_reason(files: DataFrame, options: Options, size: str = "size") -> DataFrame:
    """``files`` (path and a size) with ``barred``: why a file at the top is left alone, by its name and size, which is
    what can be told before its bytes are read. Empty if nothing bars it so far; an .otf and the streams that may hold
    a tar are only told apart by their bytes."""
    path, size, ext = F.col("path"), F.col(size), last_ext(F.col("path"))
    why = skip_reason(path, size, options.min_size, options.max_size, options.include, options.exclude)
    why = F.when(in_excluded_dir(path, options.exclude_dirs), "excluded directory").when(F.lit(options.skip_zip) & is_plain_zip(path), "zip skipped").otherwise(why)

    def by_kind(k: Column) -> Column:
        out = F.when(k["key"].isNull(), "unsupported").when(~media_gate(k["packer"], options.pack_images), "media off")
        out = out.when(k["is_archive"] & ~k["family"].isin(*READABLE), "tool missing")
        return out.when(~k["is_archive"] & ~F.coalesce(k["packer"].isin(list(PACKERS)), F.lit(False)), "tool missing").otherwise("")

    named = F.transform(F.array(kind(path)), by_kind)[0]  # the kind is worked out once, not for each of its fields
    return files.withColumn("barred", F.when(why != "", why).when(ext.isin("otf", *R.PEEKED), "").otherwise(named))


def _classified(rows: DataFrame, depth: int, options: Options) -> DataFrame:
    """Rows with key, family, packer, is_archive, an archive's remark and the reason, if any, that bars them from packing."""
    known = identified(rows)
    known = known.withColumn("look", _inspect(options)("kind", F.when(F.col("kind.is_archive"), F.col("content")))).drop("kind")
    known = known.select(*rows.columns, F.octet_length("content").alias("size"), "look.*")
    known = with_name_reason(known, options) if not depth else known.withColumn("barred", F.lit(""))
    archive, plain = F.col("is_archive"), ~F.col("is_archive")
    gate = F.when(F.col("content").isNull(), "no content").when(F.col("barred") != "", F.col("barred")).when(F.col("key").isNull(), "unsupported")
    gate = gate.when(~nested_gate(archive, F.lit(depth), options.pack_archives), "nested archive").when(~media_gate(F.col("packer"), options.pack_images), "media off")
    gate = gate.when(archive & ~F.col("family").isin(*READABLE), "tool missing").when(archive & F.col("unpacked").isNull(), "damaged").when(F.col("signed"), "signed")
    gate = gate.when(archive & exceeds_extract_limit(F.col("unpacked"), F.col("size"), options.max_extract_bytes, options.max_extract_ratio), "over extract limit")
    gate = gate.when(archive & (F.col("unpacked") > options.max_rebuilt_bytes), "too large to rebuild").when(archive & F.lit(depth >= options.max_depth), "too deep")
    gate = gate.when(plain & ~F.coalesce(F.col("packer").isin(list(PACKERS)), F.lit(False)), "tool missing")
    return known.withColumn("reason", gate.otherwise("")).drop("barred", "unpacked", "signed")


def _decided(rows: DataFrame, options: Options, dryrun: bool) -> DataFrame:
    """Rows with ``result``; a kind's own check, and for archives that of the container, must pass."""
    checks = F.when(F.col("family").startswith("tar."), F.substring_index("family", ".", -1)).when(F.col("is_archive"), F.col("family")).otherwise(F.col("packer"))
    result = decision(F.col("size"), F.octet_length("packed"), verify(checks, F.col("packed")), options.only_smaller, options.min_savings, dryrun)
    return rows.withColumn("result", result)


def repack(files: DataFrame, options: Options = Options(), keep_content: bool = True) -> DataFrame:
    """One row per file: ``path``, ``key``, ``family``, ``status`` (packed, kept, skipped), ``reason``, ``insize``,
    ``outsize``, ``savings_pct``, ``replaced``, ``inner_count``, ``inner_insize``, ``inner_outsize`` (members that got a
    result) and, unless left out, ``content``: the new bytes where replaced, else the old.

    ``files``: path (unique) and content. A null content is skipped. Members are really packed on a dry run too, so
    that an archive's size is that of a real run; only the file itself is not replaced.

    Nothing at the top is copied: the result is computed from ``files`` as it is read, so write it, or commit it, once.
    Members are opened, looked at and packed in one pass over the archives of the level above; to the shared folder go
    their bytes as they will be written, and those of archives within archives, from which the next level is opened.
    """
    bounded_batches(files.sparkSession)
    level = files.select(F.col("path").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("ord"), "path", F.lit(None).cast("binary").alias("header"), "content")
    top = _classified(level, 0, options).withColumn("walk", F.col("is_archive") & (F.col("reason") == "") & F.lit(options.deep_walking))
    archives, levels = top.where("walk"), []
    while options.deep_walking and len(levels) < options.max_depth:
        depth = len(levels) + 1
        rows = _classified(opened(archives, True).withColumnRenamed("remark", "outer_remark"), depth, options).withColumn("walk", F.col("is_archive") & (F.col("reason") == ""))
        rows = _decided(_packed_plain(rows, options), options, False)
        # an archive within an archive is opened from here
        rows = rows.withColumn("new", _new()).withColumn("content", F.when(F.col("walk"), F.col("content"))).drop("packed")
        levels.append(written(rows.withColumn("new", F.when(~F.col("walk"), F.col("new"))), f"packed{depth}"))
        archives = levels[-1].where("walk")
        if archives.isEmpty():
            break
    inner, members = None, ["parent", "ord", "path", "header", "outer", "bare", "outer_remark", "result", "new"]
    for depth in range(len(levels), 0, -1):
        rows = levels[depth - 1]
        if inner is None:
            inner = rows.select(*members)
            continue
        put = _decided(_closed(rows.where("walk").drop("result", "new"), inner, options), options, False).withColumn("new", _new())
        inner = rows.where("not walk").select(*members).unionByName(written(put.select(*members), f"closed{depth}"))
    rows = _packed_plain(top.where("not walk"), options).withColumns({c: F.lit(0).cast("long") for c in COUNTS})
    if inner is not None:
        rows = rows.unionByName(_closed(top.where("walk"), inner, options))
    inner = _decided(rows, options, options.dryrun).withColumn("new", _new())
    skipped = F.col("reason") != ""
    return inner.select(
        "path", "key", "family", F.when(skipped, "skipped").when(F.col("result.replaced"), "packed").otherwise("kept").alias("status"),
        F.when(skipped, F.col("reason")).when(F.col("result").isNull(), "no output").when(~F.col("result.replaced"), F.lit("dry run" if options.dryrun else "not smaller")).otherwise("").alias("reason"),
        F.col("size").cast("long").alias("insize"), F.coalesce("result.outsize", F.col("size").cast("long")).alias("outsize"), F.coalesce("result.savings_pct", F.lit(0.0)).alias("savings_pct"),
        F.coalesce("result.replaced", F.lit(False)).alias("replaced"), "inner_count", "inner_insize", "inner_outsize", *([F.col("new").alias("content")] if keep_content else []))


COUNTS = ("inner_count", "inner_insize", "inner_outsize")


def _new() -> Column:
    return F.when(F.coalesce(F.col("result.replaced"), F.lit(False)), F.col("packed")).otherwise(F.col("content"))


def _packed_plain(rows: DataFrame, options: Options) -> DataFrame:
    """``rows`` with ``packed``; what is barred, or waits for its members, gets none."""
    return packed(rows.withColumn("packer", F.when((F.col("reason") == "") & ~F.col("walk"), F.col("packer"))), options)


def _closed(archives: DataFrame, inner: DataFrame, options: Options) -> DataFrame:
    """``archives`` with ``packed``, put together from the rows of the level below; a group is one archive, which is
    within ``max_rebuilt_bytes``."""
    grouped = inner.select("parent", "ord", F.col("path").alias("name"), "header", "new", "outer", "bare", "outer_remark", F.col("result.insize").alias("i"), F.col("result.outsize").alias("o"))

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        top = pdf.iloc[0]
        some = [(n, h, None if c is None else bytes(c)) for n, h, c in zip(pdf["name"], pdf["header"], pdf["new"], strict=True)]
        whole = containers.rebuilt(top["outer"], some, options.compression_level, bytes(top["outer_remark"] or b""), bool(top["bare"]))
        done = pdf["i"].notna()
        spent(sum(len(h or b"") + len(c or b"") for _, h, c in some) + len(whole or b""))
        return pd.DataFrame({"parent": [top["parent"]], "whole": [whole], "inner_count": [int(done.sum())], "inner_insize": [int(pdf["i"][done].sum())], "inner_outsize": [int(pdf["o"][done].sum())]})

    made = grouped.groupBy("parent").applyInPandas(put, "parent string, whole binary, inner_count long, inner_insize long, inner_outsize long")
    joined = archives.join(made.withColumnRenamed("parent", "of"), F.col("id") == F.col("of"), "left").drop("of")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return joined.select(*archives.columns, F.col("whole").alias("packed"), *map(zero, COUNTS))


def best_candidate(candidates: DataFrame, group: Column, size: Column, ordinal: Column, *rest: str) -> DataFrame:
    """The smallest of a group's candidates, the first of equals."""
    item = F.struct(size.alias("size"), ordinal.alias("ordinal"), *rest)
    return candidates.where(size.isNotNull()).groupBy(group).agg(F.min(item).alias("best")).select("*", "best.*").drop("best")


def repack_standalone(files: DataFrame, options: Options = Options(), keep_content: bool = True) -> DataFrame:
    """``repack`` of the plain files alone: archives and unsupported files are no part of the result."""
    plain = identified(files).where(F.coalesce(F.col("kind.family") == "standalone", F.lit(False))).drop("kind")
    return repack(plain, options, keep_content)


def folder_totals(results: DataFrame) -> DataFrame:
    """Of the plain files of a folder, those that got a result: their number and sizes, which are the folder's own."""
    done = F.col("status") != "skipped"
    made = done & (F.col("reason") != "no output")
    sums = [F.coalesce(F.sum(F.when(made, F.col(c))), F.lit(0)).cast("long") for c in ("insize", "outsize")]
    total = results.agg(F.count_if(made).alias("inner_count"), sums[0].alias("inner_insize"), sums[1].alias("inner_outsize"))
    return total.withColumns({"total_insize": F.col("inner_insize"), "total_outsize": F.col("inner_outsize")})
