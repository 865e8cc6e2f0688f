"""Passages: runs of words that occur in several documents, found by the same kind of sample as long byte strings.

A run of ``words`` words holds as many shingles of half its length. Of each such run the least shingle is listed, the
same one wherever the run stands; only texts with a listed shingle that another document lists too are looked at again,
and there all runs around such shingles are compared by their hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import arrow_schema, slices, written

ODD, BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """The first powers of ``base``, modulo 2^64; up to 2^18 of them are kept."""
    if len(out := _POWERS.get(base, ())) < count:
        out = _powers(base, max(count, 1024) if count > 1 << 18 else 1 << 18)
        if count <= 1 << 18:
            _POWERS[base] = out
    return out[: max(1, count)]


def _powers(base: int, count: int) -> np.ndarray:
    out, have = np.ones(max(1, count), np.uint64), 1
    while have < count:
        more = min(have, count - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


class Rolling:
    """Hashes of any run of a sequence of 64-bit values, from sums of the values times powers of an odd number."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(ODD, len(values)), out=self.sums[1:])
        self.back = powers(BACK, len(values) + 1)

    def runs(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the runs from ``first`` up to before ``end``, wherever they stand in the sequence."""
        value = (self.sums[end] - self.sums[first]) * self.back[first]
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        return value ^ (value >> np.uint64(32))


def word_hashes(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and for each row the number of words before it (and, last, of all)."""
    data = np.frombuffer(b"\n".join(rows) + b"\n", np.uint8)
    edges = np.diff(np.r_[True, BLANK[data]].astype(np.int8))
    first, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    begins = np.cumsum([0, *(len(r) + 1 for r in rows)])
    return Rolling(BYTES[data]).runs(first, end), np.searchsorted(first, begins)


def least_of(value: np.ndarray, window: int) -> np.ndarray:
    """For each ``window`` consecutive values the position of the least, by the upper half of their bits; ties to the left."""
    low = (value & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(value), dtype=np.uint64)
    span = 1
    while span * 2 <= window:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < window:
        low = np.minimum(low[: span - window], low[window - span :])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def sampled(rows: list[bytes], words: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per row: hashes of the listed shingles, and first and last start (in words) of the runs that each is least of."""
    hashes, before = word_hashes(rows)
    rolling, half, out = Rolling(hashes), (words + 1) // 2, []
    for a, b in zip(before, before[1:], strict=False):
        if b - a < words:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        starts = np.arange(a, b - half + 1)
        shingles = rolling.runs(starts, starts + half)
        least = least_of(shingles, words - half + 1)
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        out.append((shingles[least[first]], first, np.r_[first[1:], len(least)] - 1))
    return out


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _listed(texts: DataFrame, words: int) -> DataFrame:
    """(shingle, t1, t2, weight, first, last); weight: copies of the text, 0 where it lists the shingle again."""
    schema, ddl = arrow_schema({"shingle": pa.int64(), "t1": pa.int64(), "t2": pa.int64(), "weight": pa.int64(), "first": pa.int32(), "last": pa.int32()})

    def run(batches):
        for batch in batches:
            for part in slices(batch, 4096, 192 << 10):
                found = sampled([x.encode() for x in part.column("text").to_pylist()], words)
                counts = [len(x[0]) for x in found]
                own = np.repeat(np.arange(len(found)), counts)
                shingles, first, last = (np.concatenate([x[k] for x in found]) for k in range(3))
                weight = np.zeros(len(own), np.int64)
                fresh = np.unique(np.rec.fromarrays([own, shingles]), return_index=True)[1] if len(own) else []
                weight[fresh] = part.column("copies").to_numpy()[own[fresh]] if len(own) else 0
                where = pa.array(own)
                yield pa.RecordBatch.from_arrays([signed(shingles), part.column("t1").take(where), part.column("t2").take(where), pa.array(weight), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], schema=schema)

    return texts.select("t1", "t2", "copies", "text").mapInArrow(run, ddl)


def shared_words(texts: DataFrame, words: int) -> DataFrame:
    """(t1, t2, shared): words in runs of ``words`` words or more that another document has too, for distinct ``texts``
    (t1, t2, copies, text) that have any. Words are what stands between blanks; what blanks does not matter."""
    listed = written(_listed(texts, words), "shingles")
    common = written(listed.groupBy("shingle").agg(F.sum("weight").alias("n")).where("n > 1").select("shingle"), "common-shingles")
    spots = listed.join(common.hint("shuffle_hash"), "shingle", "left_semi").groupBy("t1", "t2").agg(F.collect_list(F.struct("first", "last")).alias("spots"))
    schema, ddl = arrow_schema({"run": pa.int64(), "t1": pa.int64(), "t2": pa.int64(), "weight": pa.int64(), "start": pa.int32()})

    def run(batches):
        for batch in batches:
            for part in slices(batch, 512, 192 << 10):
                hashes, before = word_hashes([x.encode() for x in part.column("text").to_pylist()])
                rolling, found = Rolling(hashes), []
                spots = part.column("spots")
                cuts, flat = np.cumsum([0, *spots.value_lengths().to_pylist()]), spots.flatten()
                first, last = (flat.field(c).to_numpy().astype(np.int64) for c in (0, 1))
                for k, copies in enumerate(part.column("copies").to_pylist()):
                    a, counts = first[cuts[k] : cuts[k + 1]], last[cuts[k] : cuts[k + 1]] - first[cuts[k] : cuts[k + 1]] + 1
                    starts = np.unique(np.repeat(a - np.cumsum(counts) + counts, counts) + np.arange(counts.sum()))
                    runs = rolling.runs(before[k] + starts, before[k] + starts + words)
                    weight = np.zeros(len(starts), np.int64)
                    weight[np.unique(runs, return_index=True)[1]] = copies
                    found.append((runs, np.full(len(starts), k), weight, starts.astype(np.int32)))
                runs, own, weight, starts = (np.concatenate(x) for x in zip(*found, strict=True))
                where = pa.array(own)
                yield pa.RecordBatch.from_arrays([signed(runs), part.column("t1").take(where), part.column("t2").take(where), pa.array(weight), pa.array(starts)], schema=schema)

    runs = written(texts.join(spots, ["t1", "t2"]).select("t1", "t2", "copies", "text", "spots").mapInArrow(run, ddl), "runs")
    twice = written(runs.groupBy("run").agg(F.sum("weight").alias("n")).where("n > 1").select("run"), "runs-twice")
    starts = runs.join(twice.hint("shuffle_hash"), "run", "left_semi").groupBy("t1", "t2").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    # runs overlap: each adds the words up to the next one's start, at most all of its own
    ahead = F.zip_with("starts", F.slice("starts", 2, 1 << 30), lambda a, b: F.least(F.coalesce(b - a, F.lit(words)), F.lit(words)))
    return starts.select("t1", "t2", F.aggregate(ahead, F.lit(0).cast("long"), lambda n, x: n + x).alias("shared"))
