"""Quality classifier: ordinal cumulative-link regression over hashed text.

P(grade > k) = sigmoid(w . x - threshold_k) with one weight vector for all grades and ordered
thresholds: the first is free, each next adds an exponential of a free step, so they can't cross.
Features of a text are its words, their shapes (length, capitals, digits, symbols, equal to the word
before), and the shapes of neighbours in pairs, hashed; values are logarithms of
counts, scaled to unit length by kind, so a text's length alone changes little. The expected grade
and the probability of each tail rank and select documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import textkit as tk

#: Rated documents that the model is fitted on, at most; those with the smallest hash of doc_id.
SAMPLE = 8_000
BITS = 18
#: Selected: at least this probability of a grade above the lowest.
LEAST = 0.5

_U = np.uint64
_CLASS = np.zeros(256, np.uint8)  # bits of the byte classes in a word
_CLASS[list(range(0x41, 0x5B))] = 1
_CLASS[list(range(0x30, 0x3A))] = 2
_CLASS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 4
_CLASS[list(b".,!?;:")] = 8


def features(batch: tk.Batch, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, value) with each place once a document, ordered by both."""
    batch.words(tk.SPACE_NOT)
    doc, hashes = batch.doc_of_word(), batch.word_hashes(data=tk.LOWER[batch.data])
    shape = np.zeros(len(hashes), _U)
    for k, flag in enumerate((1, 2, 4, 8)):
        sums = np.concatenate([[0], np.cumsum((_CLASS[batch.data] & flag) > 0)])
        shape |= ((sums[batch.ends] > sums[batch.starts]).astype(_U)) << _U(k)
    shape |= np.minimum(batch.ends - batch.starts, 15).astype(_U) << _U(4)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    shape |= again.astype(_U) << _U(9)
    kinds = [(doc, tk.mix(hashes + _U(1)))]
    shape = tk.mix(shape + _U(77))
    kinds.append((doc, shape))
    if len(hashes) > 1:
        same = doc[1:] == doc[:-1]
        kinds.append((doc[1:][same], tk.mix(shape[:-1] * _U(3) + tk.mix(shape[1:]))[same]))
    owners, places, values = [], [], []
    for k, (owner, keys) in enumerate(kinds):
        pairs, n = np.unique(owner << bits | (tk.mix(keys + _U(1000 + k)) >> _U(64 - bits)).astype(np.int64), return_counts=True)
        value = np.log1p(n)
        owner = pairs >> bits
        norm = np.sqrt(np.bincount(owner, value**2, len(batch.counts)))
        owners.append(owner)
        places.append(pairs & ((1 << bits) - 1))
        values.append(value / norm[owner])
    owner, place, value = map(np.concatenate, (owners, places, values))
    order = np.argsort(owner, kind="stable")
    return owner[order], place[order], value[order]


@dataclass(frozen=True)
class Model:
    """Weights by place (only those not zero), and rising thresholds, one fewer than the grades."""

    places: np.ndarray
    values: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def tails(self, batch: tk.Batch) -> np.ndarray:
        """P(grade > k) for each text and threshold k."""
        table = np.zeros(1 << self.bits, np.float32)
        table[self.places] = self.values
        owner, place, value = features(batch, self.bits)
        line = np.bincount(owner, table[place] * value, len(batch.counts))
        return 1 / (1 + np.exp(-np.clip(line[:, None] - self.thresholds[None, :], -500, 500)))


def fit(texts: list[str | None], grades: np.ndarray, n_grades: int, bits: int = BITS, rounds: int = 6, rate: float = 0.3, l2: float = 1e-5) -> Model:
    """Maximum likelihood by AdaGrad over the texts in the order given. No texts: even chances of all grades."""
    rows = []
    for _, _, batch in tk.batches(pa.array(texts, pa.large_string())):
        owner, place, value = features(batch, bits)
        cuts = np.searchsorted(owner, np.arange(1, len(batch.counts)))
        rows += list(zip(np.split(place, cuts), np.split(value, cuts), strict=True))
    counts = np.bincount(grades.astype(np.int64), minlength=n_grades) + 1.0
    above = 1 - np.cumsum(counts)[:-1] / counts.sum()
    start = np.log((1 - above) / above)
    steps = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    w, seen = np.zeros(1 << bits), np.full(1 << bits, 1e-6)
    seen_steps = np.full(len(steps), 1.0)

    def thresholds() -> np.ndarray:
        return np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])]))

    for _ in range(rounds):
        for (at, value), grade in zip(rows, grades.astype(int).tolist(), strict=True):
            line, cuts = w[at] @ value, thresholds()
            lower = 1.0 if grade == 0 else 1 / (1 + np.exp(-(line - cuts[grade - 1])))
            upper = 0.0 if grade == n_grades - 1 else 1 / (1 + np.exp(-(line - cuts[grade])))
            # of log(lower - upper): by line lower(1-lower) - upper(1-upper) over it is 1 - lower - upper
            g = lower + upper - 1
            by_cut = np.zeros(len(cuts))
            chance = max(lower - upper, 1e-9)
            if grade > 0:
                by_cut[grade - 1] += lower * (1 - lower) / chance
            if grade < n_grades - 1:
                by_cut[grade] -= upper * (1 - upper) / chance
            by_step = np.cumsum(by_cut[::-1])[::-1].copy()
            by_step[1:] *= np.exp(steps[1:])
            by_step = np.clip(by_step, -5, 5)
            seen_steps += by_step**2
            steps -= 0.1 * by_step / np.sqrt(seen_steps)
            by_w = g * value + l2 * w[at]
            seen[at] += by_w**2
            w[at] -= rate * by_w / np.sqrt(seen[at])
    places = np.flatnonzero(np.abs(w) > 1e-4)
    return Model(places, w[places].astype(np.float32), thresholds(), bits)


def grade_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Graded ratings from the two labels: 0 poor, 1 good but toxic, 2 good; null where they don't tell."""
    q, t = F.col(quality), F.col(toxic)
    return F.when(q == 0, 0).when(q.isNotNull() & (t == 1), 1).when(q.isNotNull() & (t == 0), 2)


def train(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, sample: int = SAMPLE) -> Model:
    """From (doc_id, grade) ratings; nulls in either are left out. Documents that share an id all take its ratings, those
    with several ratings all of them, within the bounds of ``sampled``. No ratings: even chances."""
    texts, grades = tk.sampled(docs, ratings.select("doc_id", F.col("grade").cast("double").alias("y")), sample, seed=5)
    return fit(texts, np.array(grades, np.int64), n_grades)


def graded(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named, ``expected_grade`` and ``tails`` (P(grade > k) by k), over whole texts; null texts as empty ones."""
    kept = docs.select(*columns, F.col("text").cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    width = len(model.thresholds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tails = np.concatenate([np.zeros((0, width)), *(shared.value.tails(x) for _, _, x in tk.batches(b.column("__text")))])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(tails) + 1) * width, pa.int32()), pa.array(tails.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(tails.sum(1)), lists], [*columns, "expected_grade", "tails"])

    return kept.mapInArrow(work, kept.drop("__text").schema.add("expected_grade", "double").add("tails", T.ArrayType(T.DoubleType())))


def digest(docs: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, expected_grade, tail_prob (of grade 1 and above), top_prob (of grade 2) and kept: tail_prob at least ``least``.

    One row for each row of ``docs``, repeated ones included; null texts are graded as empty ones, null
    ids stay; other columns of either table are ignored; an empty table gives no rows.
    """
    model = train(docs, labels.select("doc_id", grade_of().alias("grade")))
    tails = F.col("tails")
    return graded(docs, model).select("doc_id", "expected_grade", tails[0].alias("tail_prob"), tails[1].alias("top_prob"), (tails[0] >= least).alias("kept"))
