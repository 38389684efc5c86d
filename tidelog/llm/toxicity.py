"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, pairs of neighbours, and pairs with one word between, hashed to
2**BITS places. Each coordinate has its own learning rate, and the L1 term keeps most weights at
exactly zero, so the model is a short list of places and weights that every task gets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import textkit as tk

#: Labelled documents that the model is fitted on, at most; those with the smallest hash of doc_id.
SAMPLE = 12_000
BITS, FOLDS = 20, 5

_U = np.uint64


def features(batch: tk.Batch, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document, place) of all features of the batch, repeats included."""
    batch.words(tk.WORDY)
    hashes, doc = batch.word_hashes(data=tk.LOWER[batch.data]), batch.doc_of_word()
    found, owner = [hashes], [doc]
    for salt, gap in ((3, 1), (5, 2)):
        if len(hashes) > gap:
            same = doc[gap:] == doc[:-gap]
            found.append(tk.mix(hashes[:-gap] * _U(salt) + tk.mix(hashes[gap:] + _U(gap)))[same])
            owner.append(doc[gap:][same])
    return np.concatenate(owner), (np.concatenate(found) >> _U(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Non-zero weights by place, and the weight of the constant."""

    places: np.ndarray
    values: np.ndarray
    constant: float
    bits: int = BITS

    def score(self, batch: tk.Batch) -> np.ndarray:
        """Probability of label 1 for each text of the batch; an empty text has the constant's."""
        table = np.zeros(1 << self.bits, np.float32)
        table[self.places] = self.values
        doc, place = features(batch, self.bits)
        live = table[place] != 0
        pairs = np.unique(doc[live] << self.bits | place[live])
        total = np.bincount(pairs >> self.bits, table[pairs & ((1 << self.bits) - 1)].astype(np.float64), len(batch.counts))
        return 1 / (1 + np.exp(-np.clip(total + self.constant, -500, 500)))


def fit(texts: list[str | None], labels: np.ndarray, bits: int = BITS, rounds: int = 8, alpha: float = 2.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.0) -> Model:
    """FTRL-proximal over the texts in the order given, ``rounds`` times. No texts: a score of one half for all."""
    rows: list[np.ndarray] = []
    for _, _, batch in tk.batches(pa.array(texts, pa.large_string())):
        doc, place = features(batch, bits)
        pairs = np.unique(doc << bits | place)
        rows += [(p & ((1 << bits) - 1)).astype(np.int32) for p in np.split(pairs, np.searchsorted(pairs, np.arange(1, len(batch.counts)) << bits))]
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    spot = 1 << bits  # the constant, without L1

    def weight(at: np.ndarray) -> np.ndarray:
        zs, slack = z[at], np.where(at == spot, 0.0, l1)
        return np.where(np.abs(zs) <= slack, 0.0, (np.sign(zs) * slack - zs) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(rounds):
        for row, y in zip(rows, labels.tolist(), strict=True):
            at = np.append(row, spot)
            w = weight(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -500, 500))) - y
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    every = weight(np.arange(spot))
    places = np.flatnonzero(every)
    return Model(places, every[places].astype(np.float32), float(weight(np.array([spot]))[0]), bits)


def held_out() -> F.Column:
    """True for the fold that no label is learnt from. A null doc_id, which no label has, is in it."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From (doc_id, toxic) labels outside the held-out fold; nulls in either are left out. Documents that share an id all
    take its labels, those with several labels all of them, within the bounds of ``sampled``."""
    known = labels.select("doc_id", F.col("toxic").cast("double").alias("y")).where(~held_out())
    texts, y = tk.sampled(docs, known, sample, seed=7)
    return fit(texts, np.array(y, np.float64))


def scored(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named and ``score``, over whole texts; null texts score as empty ones."""
    kept = docs.select(*columns, F.col("text").cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [shared.value.score(x) for _, _, x in tk.batches(b.column("__text"))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(np.concatenate(parts) if parts else np.zeros(0))], [*columns, "score"])

    return kept.mapInArrow(work, kept.drop("__text").schema.add("score", "double"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of one half on).

    One row for each row of ``docs``, repeated ones included; null texts score as empty ones, null ids
    stay and are held out; other columns of either table are ignored; an empty table gives no rows.
    """
    return scored(docs, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
