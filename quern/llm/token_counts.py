"""Token counts by prefix dynamic programming: one pass answers size, truncation and budget questions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.bpe import PrefixCounts, default_path
from quern.llm.shared import arrow_schema, bounded_batches, for_a_task, slices


def token_counts(docs: DataFrame, limit: int = 512, tokenizer: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (n_tokens > limit) and
    ``fits`` (code points of the longest prefix within ``limit`` tokens).

    Counts are those of the tokenizer file's own library, without special tokens added. A null text is an empty
    one (no bytes, no tokens); a null id stays null; repeated rows give repeated results; an empty table gives an
    empty result; other columns are not read. Narrow: no shuffle, a bounded memo that lives for a task.
    """
    bounded_batches(docs.sparkSession)
    path = tokenizer or default_path()
    schema, ddl = arrow_schema({"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_tokens": pa.int64(), "over_limit": pa.bool_(), "fits": pa.int64()})

    def run(counter, batches):
        for batch in batches:
            for part in slices(batch, rows=1 << 13):
                sizes, counts, fits = counter.column(part.column("text"), limit)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()),
                    pa.array(counts > limit, pa.bool_()), pa.array(fits, pa.int64())], schema=schema)

    return docs.selectExpr(f"cast(`{id_column}` as long) as doc_id", f"`{text_column}` as text").mapInArrow(for_a_task(lambda: PrefixCounts(path), run), ddl)
