"""Toxicity by a classifier chain: categories in turn, each linear model fed with the probabilities before it.

The categories come from the labelled rows, not from a list of words: poor quality, as labelled; kinds of toxicity, as the
labelled toxic rows fall into clusters by the words that they share; and, last, toxicity itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import bounded_batches, slices, texts, written

LETTERS = re.compile(r"[^\W\d_]+")
def words(text: str) -> set[str]:
    return set(LETTERS.findall(text.lower()))


class Linear(NamedTuple):
    weights: np.ndarray
    bias: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30, start: Linear | None = None, rows: np.ndarray | None = None) -> Linear:
    """Logistic regression with a ridge penalty, by Newton's method until it settles, at the one optimum there is, wherever
    it starts; a constant where only one class is seen. ``rows``: a mask of the rows to fit on."""
    y = y if rows is None else y[rows]
    seen = len(y)
    if not seen or y.min() == y.max():
        rate = (y.sum() + 0.5) / (seen + 1) if seen else 0.0
        return Linear(np.zeros(x.shape[1]), float(np.log(rate / (1 - rate))) if 0 < rate < 1 else -30.0)
    wide = np.ones((seen, x.shape[1] + 1))
    wide[:, :-1] = x if rows is None else x[rows]
    penalty = np.full(wide.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(wide.shape[1]) if start is None else np.append(start.weights, start.bias)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(wide @ w, -30, 30)))
        gradient = wide.T @ (p - y) + penalty * w
        share, curve = (p * (1 - p))[:, None], np.diag(penalty)
        for at in range(0, wide.shape[1], 64):  # some columns at a time: no second copy of all rows
            curve[at : at + 64] += (wide[:, at : at + 64] * share).T @ wide
        move = np.linalg.solve(curve, gradient)
        w -= move / max(1.0, np.abs(move).max() / 5)
        if np.abs(move).max() < 1e-6:
            break
    return Linear(w[:-1], float(w[-1]))


class Chain(NamedTuple):
    """vocabulary: word -> column. models: one for each name, the last one the label itself."""

    vocabulary: dict[str, int]
    names: tuple[str, ...]
    models: tuple[Linear, ...]

    def score(self, rows: list[str]) -> np.ndarray:
        """(texts, names) probabilities."""
        x = np.zeros((len(rows), len(self.vocabulary) + len(self.names)))
        known = self.vocabulary.keys()
        for k, text in enumerate(rows):
            for word in known & words(text):
                x[k, self.vocabulary[word]] = 1
        for n, model in enumerate(self.models):
            x[:, len(self.vocabulary) + n] = model(x[:, : len(self.vocabulary) + n])
        return x[:, len(self.vocabulary) :]


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray, ridge: float = 1.0) -> list[Linear]:
    """One model per column of ``labels``. Later models are trained on out-of-fold probabilities of earlier ones:
    each comes from a model that did not see the row. The models that stay are fitted on all rows."""
    models = []
    for n in range(labels.shape[1]):
        models.append(fit_linear(x, labels[:, n], ridge))
        away = np.zeros(len(x))
        for fold in np.unique(folds):
            held = folds == fold
            away[held] = fit_linear(x, labels[:, n], ridge, start=models[-1], rows=~held)(x[held])
        x = np.hstack([x, away[:, None]])
    return models


def clusters(x: np.ndarray, count: int, rounds: int = 20) -> np.ndarray:
    """Cluster of each row of a 0/1 matrix, by cosine: k-means from rows that are least like each other. Words that many
    rows have weigh less. The same rows give the same clusters, numbered from the largest."""
    if not len(x):
        return np.zeros(0, np.int64)
    x = x * np.log(1 + len(x) / np.maximum(1, x.sum(axis=0)))
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = x[[int((x @ x.mean(axis=0)).argmax())]]
    while len(centres) < min(count, len(x)):
        centres = np.vstack([centres, x[int((x @ centres.T).max(axis=1).argmin())]])
    own = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        new = (x @ centres.T).argmax(axis=1)
        for k in range(len(centres)):
            if (new == k).any():
                mean = x[new == k].mean(axis=0)
                centres[k] = mean / max(np.linalg.norm(mean), 1e-12)
        if (new == own).all():
            break
        own = new
    order = np.argsort(-np.bincount(own, minlength=len(centres)), kind="stable")
    return np.argsort(order)[own]


def train(docs: DataFrame, labels: DataFrame, rows: int = 6000, vocabulary: int = 200, folds: int = 5, kinds: int = 3,
          id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", quality_column: str = "quality") -> Chain:
    """A chain fitted on at most ``rows`` labelled documents, those of least id hash (a row without id, label or
    document counts for nothing; of several labels of one id the greatest, and the least quality; no quality, or no such
    column, is not a poor one). Its words are, for poor quality and for toxicity, the ``vocabulary`` ones whose share
    of documents differs most, in standard errors. Spark counts the words; the driver gets the words chosen and, per
    sampled document, which of them it has. Links: ``poor``, ``kind_1`` to ``kind_<kinds>`` (see ``clusters``), ``toxic``.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    targets = ("poor", "toxic")
    quality = F.col(f"`{quality_column}`") if quality_column in labels.columns else F.lit(1)
    known = labels.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{label_column}`").cast("int").alias("toxic"), (F.coalesce(quality, F.lit(1)) <= 0).cast("int").alias("poor")).dropna()
    known = known.groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"), F.max("poor").alias("poor")).orderBy(F.xxhash64("id"), "id").limit(rows)
    sampled = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text")).join(F.broadcast(known), "id")

    def split(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch):
                held = [sorted(words(t)) for t in texts(part, "text")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", *targets)), pa.array(held, pa.list_(pa.string()))], ["id", *targets, "words"])

    sampled = written(sampled.select("id", *targets, "text").mapInArrow(split, "id long, poor int, toxic int, words array<string>"), "labelled")
    totals = sampled.agg(F.count(F.lit(1)).alias("all"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in targets]).first()
    counts = sampled.select(F.explode("words").alias("word"), *targets).groupBy("word").agg(F.count(F.lit(1)).alias("all"), *[F.sum(n).alias(n) for n in targets]).where("all >= 3")
    chosen: dict[str, set[str]] = {n: set() for n in targets}
    for n in targets:
        some, none = float(totals[n]), float(totals["all"] - totals[n])
        if some and none:
            a, b = F.col(n) / some, (F.col("all") - F.col(n)) / none
            error = F.sqrt(F.col("all") / totals["all"] * (1 - F.col("all") / (totals["all"] + 1.0)) * (1 / some + 1 / none))
            chosen[n] = {(r["word"], r["more"]) for r in counts.select("word", (a > b).alias("more"), (F.abs(a - b) / error).alias("z")).orderBy(F.desc("z"), "word").limit(vocabulary).collect()}
    index = {w: k for k, w in enumerate(sorted({w for found in chosen.values() for w, _ in found}))}

    def marks(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch):
                has = np.zeros((part.num_rows, len(index)), np.uint8)
                for k, own in enumerate(part.column("words").to_pylist()):
                    has[k, [index[w] for w in own if w in index]] = 1
                bits = pa.array([r.tobytes() for r in np.packbits(has, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", *targets)), bits], ["id", *targets, "has"])

    # a bit for each word: rows of strings, sorted by Spark, cost the driver most of what this stage asks of it
    had = [(r, np.unpackbits(np.frombuffer(r["has"], np.uint8), count=len(index))) for r in sampled.mapInArrow(marks, "id long, poor int, toxic int, has binary").collect()]
    had.sort(key=lambda h: (h[0]["id"], np.flatnonzero(h[1]).tolist()))
    x = np.stack([bits for _, bits in had]) if had else np.zeros((0, len(index)), np.uint8)
    had = [r for r, _ in had]
    toxic = np.array([r["toxic"] for r in had], bool)
    telling = sorted(index[w] for w, more in chosen["toxic"] if more)
    kind = np.full(len(had), -1)
    kind[toxic] = clusters(x[toxic][:, telling], kinds)
    y = np.stack([np.array([r["poor"] for r in had], np.float64), *(kind == k for k in range(kinds)), toxic], axis=1) if had else np.zeros((0, kinds + 2))
    fold = np.array([(r["id"] * 2654435761 >> 7) % folds for r in had], np.int64)
    return Chain(index, ("poor", *(f"kind_{k + 1}" for k in range(kinds)), "toxic"), tuple(fit_chain(x, y.astype(np.float64), fold)))


def toxicity_of(text: Column, chain: Chain) -> Column:
    """struct of ``p_<category>`` and ``p_toxic`` for a text column; a null text is an empty one."""
    kind = pa.struct([(f"p_{n}", pa.float64()) for n in chain.names])

    @F.arrow_udf("struct<" + ",".join(f"p_{n}:double" for n in chain.names) + ">")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            found = []
            for part in slices(pa.RecordBatch.from_arrays([column], ["text"])):
                found.append(chain.score(texts(part, "text")))
            every = np.concatenate(found) if found else np.zeros((0, len(chain.names)))
            yield pa.StructArray.from_arrays([pa.array(every[:, n]) for n in range(len(chain.names))], fields=list(kind))

    return score(text)


def judge_toxicity(docs: DataFrame, chain: Chain, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, the chain's probabilities and ``toxic`` (p_toxic of ``threshold`` or more).

    A null or empty text is judged like a text without known words. Null ids, repeated rows and empty tables pass
    through; other columns are not read. Narrow.
    """
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), toxicity_of(F.col(f"`{text_column}`"), chain).alias("p"))
    return rows.select("doc_id", "p.*").withColumn("toxic", F.col("p_toxic") >= threshold)


def drop_toxic(docs: DataFrame, chain: Chain, threshold: float = 0.5, text_column: str = "text") -> DataFrame:
    """``docs`` without the rows judged toxic; columns as they were. A null text is judged as an empty one; null ids,
    repeated rows and other columns go along; an empty table gives an empty result."""
    return docs.where(toxicity_of(F.col(f"`{text_column}`"), chain)["p_toxic"] < threshold)
