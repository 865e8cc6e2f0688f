"""Vector bin packing of tokenised documents into fixed-length training sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quern.llm.bpe import Ids, default_path
from quern.llm.shared import arrow_schema, bounded_batches, for_a_task, slices

FIELDS = {
    "doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(),
    "sequence_id": pa.int64(), "offset": pa.int64(), "loss_tokens": pa.int64(), "ids": pa.list_(pa.int32()),
}


class Bins:
    """A bounded pool of pieces shorter than a sequence, packed by the dot-product heuristic.

    Each piece demands tokens, one segment and loss-bearing tokens; a bin offers ``limits`` of them. Into the open
    bin goes, time after time, the fitting piece whose demand has the largest dot product with what the bin has
    left (both as shares of the limits). When nothing fits and the gap is more than ``slack`` tokens, the smallest
    piece that overfills the gap is cut there and its rest returns to the pool.
    """

    def __init__(self, limits: tuple[int, int, int], slack: int, room: int = 512):
        self.limits, self.slack, self.room = np.array(limits, np.float64), slack, room
        self.demand, self.pieces = np.zeros((2 * room, 3)), []

    def add(self, piece: dict) -> None:
        if len(self.pieces) == len(self.demand):
            self.demand = np.vstack([self.demand, np.zeros_like(self.demand)])
        self.demand[len(self.pieces)] = (piece["length"], 1, piece["loss"])
        self.pieces.append(piece)

    def pop(self, k: int) -> dict:
        piece = self.pieces[k]
        last = self.pieces.pop()
        if k < len(self.pieces):
            self.pieces[k] = last
            self.demand[k] = self.demand[len(self.pieces)]
        return piece

    def bin(self) -> list[dict]:
        """The pieces of one sequence."""
        out, left = [], self.limits.copy()
        while self.pieces:
            demand = self.demand[: len(self.pieces)]
            fits = (demand <= left).all(axis=1)
            if fits.any():
                score = np.where(fits, (demand / self.limits) @ (left / self.limits), -1.0)
                piece = self.pop(int(score.argmax()))
            else:
                gap = int(min(left[0], left[2]))
                if gap <= self.slack or left[1] < 1:
                    break
                piece = self.pop(int(np.where(demand[:, 0] > gap, demand[:, 0], np.inf).argmin()))
                piece, rest = cut(piece, gap)
                self.add(rest)
            out.append(piece)
            left -= (piece["length"], 1, piece["loss"])
        return out


def cut(piece: dict, length: int) -> tuple[dict, dict]:
    """The first ``length`` tokens of a piece and the rest; loss-bearing tokens are the piece's last ones."""
    loss = max(0, piece["loss"] - (piece["length"] - length))
    head = piece | {"length": length, "loss": loss, "ids": piece["ids"][: 4 * length]}
    tail = piece | {"start": piece["start"] + length, "length": piece["length"] - length, "loss": piece["loss"] - loss, "ids": piece["ids"][4 * length :]}
    return head, tail


def pack(docs: DataFrame, max_tokens: int = 1024, max_segments: int = 128, max_loss_tokens: int | None = None, slack: int = 4,
         end_id: int = 0, pool: int = 512, tokenizer: str | None = None, id_column: str = "doc_id", text_column: str = "text", prompt_tokens_column: str | None = None) -> DataFrame:
    """Pieces of all documents laid into sequences; one row per piece: ``doc_id``, ``start`` (ids of its document
    before it), ``length``, ``ids_crc32``, ``doc_tokens`` (with the end id), ``sequence_id``, ``offset`` (gapless from
    0 in its sequence), ``loss_tokens`` and ``ids`` (its token ids; ``ids_crc32`` is the checksum of their little-endian
    bytes). The pieces of a sequence by ``offset``, ids joined, are the training sequence.

    A document's ids are the tokenizer's, without special tokens, then ``end_id``; each id lies in exactly one
    piece. Whole runs of ``max_tokens`` fill sequences alone; the remainders are packed by ``Bins`` within each
    input partition, holding at most ``pool`` of them. What is left at a partition's end is written as sequences
    of power-of-two lengths, which need no padding. ``prompt_tokens_column`` counts leading tokens that bear no
    loss (null: 0); by default every token bears loss. ``max_loss_tokens`` defaults to ``max_tokens``.

    A null or empty text is the end id alone; a null id stays null; repeated rows are packed as often as they
    occur; an empty table gives an empty result; other columns are not read. Narrow: no shuffle. Sequence ids
    are (partition, number within it), so a task that runs again gives the same rows.
    """
    bounded_batches(docs.sparkSession)
    path = tokenizer or default_path()
    schema, ddl = arrow_schema(FIELDS)
    limits = (max_tokens, max_segments, max_loss_tokens or max_tokens)
    end = np.array([end_id], "<u4").tobytes()
    simple = limits[2] >= max_tokens

    def run(encode, batches):
        bins = Bins(limits, slack, pool)
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        rows: list[tuple] = []

        def lay(pieces: list[dict]) -> None:
            nonlocal sequence
            at = 0
            for x in pieces:
                rows.append((x["doc"], x["start"], x["length"], zlib.crc32(x["ids"]), x["total"], sequence, at, x["loss"], np.frombuffer(x["ids"], "<i4")))
                at += x["length"]
            sequence += 1

        def out():
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(FIELDS)
            arrays = [pa.array(c, t) for c, t in zip(columns, FIELDS.values(), strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            for part in slices(batch, rows=1 << 13):
                prompts = part.column("prompt").to_pylist()
                for doc, found, prompt in zip(part.column("doc_id").to_pylist(), encode(part.column("text")), prompts, strict=True):
                    ids = memoryview(found + end)
                    total = len(ids) // 4
                    bare = min(total, prompt or 0)
                    piece = {"doc": doc, "start": 0, "length": total, "total": total, "loss": total - bare, "ids": ids}
                    while piece["length"] >= max_tokens or piece["loss"] > limits[2]:
                        room = max_tokens if simple else max(1, min(max_tokens, piece["length"], piece["length"] - piece["loss"] + limits[2]))
                        if room == piece["length"]:
                            break
                        head, piece = cut(piece, room)
                        lay([head])
                    if piece["length"] == max_tokens:
                        lay([piece])
                    elif piece["length"]:
                        bins.add(piece | {"ids": bytes(piece["ids"])})
                    while len(bins.pieces) > pool:
                        lay(bins.bin())
                yield out()
        while bins.pieces:
            last = bins.bin()
            size = sum(x["length"] for x in last)
            if bins.pieces or size + slack >= max_tokens:
                lay(last)
                continue
            while last:  # the rest in powers of two
                room, here, size = 1 << (size.bit_length() - 1), [], size - (1 << (size.bit_length() - 1))
                while room:
                    x = last.pop(0)
                    if x["length"] > room:
                        x, rest = cut(x, room)
                        last.insert(0, rest)
                    here.append(x)
                    room -= x["length"]
                lay(here)
        yield out()

    columns = [f"cast(`{id_column}` as long) as doc_id", f"`{text_column}` as text", f"cast({f'`{prompt_tokens_column}`' if prompt_tokens_column else 'null'} as long) as prompt"]
    return docs.selectExpr(*columns).mapInArrow(for_a_task(lambda: Ids(path), run), ddl)
