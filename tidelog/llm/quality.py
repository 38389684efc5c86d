"""Quality rules: document statistics, hard limits, and gradient-boosted trees over the statistics.

The trees are grown here by histograms on a bounded sample of labelled documents, with monotonic
constraints on the statistics of repetition and junk: more of those never raises a document's
probability. For scoring, all trees are flattened to arrays of nodes that numpy walks for a whole
batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import textkit as tk

#: Labelled documents that the trees are grown on, at most; those with the smallest hash of doc_id.
SAMPLE = 20_000
#: A document passes with this probability of label 1 and above.
LEAST = 0.3

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_LINE = np.ones(256, bool)
_LINE[0x0A] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?,;:")] = True

#: Names of the model's features and the sign each may act with: 0 any, -1 never upwards.
FEATURES = {"log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0, "digit_share": 0, "stop_share": 0, "words_per_line": 0, "pair_share": -1}


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _groups(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key of a document, how many it has; and flags of one of each group."""
    keys = tk.mix(keys + tk.mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    starts, ends = tk.runs(keys[order])
    n, lead = np.empty(len(keys), np.int64), np.zeros(len(keys), bool)
    n[order] = np.repeat(ends - starts, ends - starts)
    lead[order[starts]] = True
    return n, lead


def statistics(batch: tk.Batch) -> dict[str, np.ndarray]:
    """Counts of each document, then the features."""
    batch.words(tk.SPACE_NOT)
    solid, data, offsets = tk.SPACE_NOT[batch.data], batch.data, batch.offsets
    n = batch.counts.astype(np.int64)
    out = {"n_words": n, "word_chars": _per_doc(solid & ((data & 0xC0) != 0x80), offsets), "n_symbols": _per_doc(SYMBOLS[data], offsets)}
    hashes, doc = batch.word_hashes(), batch.doc_of_word()
    repeats = {}
    for width in (2, 3):
        inside = np.flatnonzero(tk.windows_inside(batch.at, width))
        many, _ = _groups(tk.window_hashes(hashes, width)[inside], doc[inside]) if len(inside) else (np.zeros(0), None)
        repeats[width] = _per_doc(tk.covered(inside[many > 1], width, len(hashes)), batch.at)
    out["n_repeat_words"] = repeats[3]
    _, lead = _groups(hashes, doc)
    distinct = np.bincount(doc[lead], minlength=len(n))
    lines = tk.Batch(data, offsets)
    lines.words(_LINE)
    some = np.concatenate([[0], np.cumsum(solid)])
    full = np.flatnonzero(some[lines.ends] > some[lines.starts])
    line_doc = lines.doc_of_word()[full]
    _, lead = _groups(lines.word_hashes()[full], line_doc)
    n_lines = np.bincount(line_doc, minlength=len(n))
    out["n_dup_lines"] = n_lines - np.bincount(line_doc[lead], minlength=len(n))
    words, chars = np.maximum(n, 1), np.maximum(out["word_chars"], 1)
    out |= {
        "log_words": np.log1p(n), "word_length": out["word_chars"] / words, "symbol_share": out["n_symbols"] / words, "dup_line_share": out["n_dup_lines"] / np.maximum(n_lines, 1),
        "repeat_share": out["n_repeat_words"] / words, "distinct_share": distinct / words, "digit_share": _per_doc(_DIGIT[data], offsets) / chars, "stop_share": _per_doc(_STOP[data], offsets) / words,
        "words_per_line": n / np.maximum(n_lines, 1), "pair_share": repeats[2] / words,
    }
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Trees:
    """All trees as arrays of nodes; a leaf is its own child. ``roots`` has each tree's first node."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, signs: tuple[int, ...], n_trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, smallest: int = 8) -> Trees:
    """Boosted trees for the log-odds of y. A split of a constrained feature must order its leaves by
    the sign, and bounds at the middle of the two hold for everything below it."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)] if n else []
    codes = [np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]
    rate_of_one = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(rate_of_one / (1 - rate_of_one)))
    nodes: list[list[float]] = []
    roots, total = [], np.full(n, base)

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def node(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = slope[rows], bend[rows]
        whole_g, whole_h = g.sum(), h.sum()
        here = float(np.clip(-whole_g / (whole_h + ridge), low, high))
        best = (1e-6, -1, 0, 0.0, 0.0)
        if level < depth and len(rows) >= 2 * smallest:
            for f in range(width):
                size = len(cuts[f]) + 1
                if size < 2:
                    continue
                c = codes[f][rows]
                gl, hl, nl = (np.cumsum(np.bincount(c, w, size))[:-1] for w in (g, h, None))
                a, b = np.clip(-gl / (hl + ridge), low, high), np.clip((gl - whole_g) / (whole_h - hl + ridge), low, high)
                worth = lambda v, gs, hs: -(gs * v + 0.5 * (hs + ridge) * v * v)
                gain = worth(a, gl, hl) + worth(b, whole_g - gl, whole_h - hl) - worth(here, whole_g, whole_h)
                gain[(nl < smallest) | (len(rows) - nl < smallest) | (signs[f] * (b - a) < 0)] = -np.inf
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k, float(a[k]), float(b[k]))
        _, f, k, a, b = best
        if f < 0:
            at = leaf(here * rate)
            total[rows] += here * rate
            return at
        at = len(nodes)
        nodes.append([f, float(cuts[f][k]), 0, 0, 0.0])
        middle = (a + b) / 2
        goes = codes[f][rows] <= k
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[f]]
        nodes[at][2] = node(rows[goes], level + 1, *bounds[0])
        nodes[at][3] = node(rows[~goes], level + 1, *bounds[1])
        return at

    for _ in range(n_trees if n else 0):
        p = 1 / (1 + np.exp(-total))
        slope, bend = p - y, p * (1 - p)
        roots.append(node(np.arange(n), 0, -np.inf, np.inf))
    flat = np.array(nodes, np.float64).reshape(-1, 5)
    return Trees(flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4], np.array(roots, np.int64), depth, base)


def with_statistics(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), trees: Trees | None = None, keep_text: bool = False) -> DataFrame:
    """The columns named and the counts as longs, then the features in one array ``features``, or with
    trees their probability ``quality``. Null texts have no words. keep_text: the text stays as ``__text``."""
    kept = docs.select(*columns, F.col("text").cast("string").alias("__text"))
    schema = T.StructType([f for f in kept.schema if keep_text or f.name != "__text"])
    same = tuple(schema.names)
    for c in COUNTS:
        schema = schema.add(c, "long")
    schema = schema.add("quality", "double") if trees else schema.add("features", T.ArrayType(T.DoubleType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.lean(batches):
            parts = [statistics(x) for _, _, x in tk.batches(b.column("__text"))]
            got = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in (*COUNTS, *FEATURES)}
            rows = np.column_stack([got[k] for k in FEATURES]).astype(np.float64)
            if trees:
                last = pa.array(trees.score(rows))
            else:
                last = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in same), *(pa.array(got[k].astype(np.int64)) for k in COUNTS), last], schema.names)

    return kept.mapInArrow(work, schema)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, target: str = "quality") -> Trees:
    """Trees from (doc_id, target) labels; nulls in either are left out. No labels: every document scores one half."""
    chosen = labels.select("doc_id", F.col(target).cast("double").alias("__y")).dropna().orderBy(F.xxhash64("doc_id"), "doc_id", "__y").limit(sample)
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), ("doc_id", "__y")).select("doc_id", "__y", "features").toPandas()
    rows = rows.sort_values(["doc_id", "__y"], kind="stable")
    x = np.array(rows["features"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return grow(x, rows["__y"].to_numpy(np.float64), tuple(FEATURES.values()))


def judged(docs: DataFrame, trees: Trees, columns: tuple[str, ...] = ("doc_id",), least: float = LEAST, keep_text: bool = False) -> DataFrame:
    """The columns named, the counts, ``base_failed``, ``quality`` (the trees' probability) and ``kept``.

    base_failed: under 50 words, or over half of the words in repeated windows. Such documents are
    never kept; others are if their probability is at least ``least``. Null and empty texts fail.
    """
    scored = with_statistics(docs, columns, trees, keep_text)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= least))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(docs, train(docs, labels)).select("doc_id", *COUNTS, "base_failed", "kept", "quality")


def kept(docs: DataFrame, trees: Trees, least: float = LEAST) -> DataFrame:
    """The documents that pass, with their columns, whatever the names of those."""
    plain, back = tk.renamed(docs)
    return back(judged(plain, trees, tuple(c for c in plain.columns if c != "text"), least, keep_text=True).where("kept"))
