"""Benchmark decontamination: one Aho-Corasick automaton over windows of all test items.

Texts are normalised to their words, ASCII in lower case, joined by one space. Every window of
WINDOW consecutive item words (an item of fewer: all its words) is a pattern, with a space at
either end so that it matches whole words only. A document is scanned once; matches give word
places, and those give code-point offsets in the original text.

The patterns are sent to all tasks only up to MAX_PATTERN_CHARS; a larger benchmark is cut into
slices of that size, scanned one after the other over written tables, and the hits add up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import textkit as tk

WINDOW = 10
MAX_PATTERN_CHARS = 48 << 20

#: ASCII bytes that are no letters or digits become spaces, capitals small letters.
_FOLD = bytes(int(tk.LOWER[b]) if tk.WORDY[b] else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def windows_of(words: list[bytes], window: int) -> set[str]:
    return {b" ".join(words[i : i + window]).decode() for i in range(max(1, len(words) - window + 1))} if words else set()


_made: dict[int, ahocorasick.Automaton] = {}


class Patterns:
    """Windows with the items that hold them; the automaton is made once a worker."""

    def __init__(self, items: Iterable[tuple[int | None, str | None]], window: int = WINDOW):
        owners: dict[str, set[int]] = {}
        for item, text in items:
            for w in windows_of(words_of(text), window):
                found = owners.setdefault(w, set())
                if item is not None:
                    found.add(item)
        self.windows = sorted(owners)
        self.owners = [tuple(sorted(owners[w])) for w in self.windows]
        self.key = int.from_bytes(hashlib.blake2b("\n".join(f"{w}{o}" for w, o in zip(self.windows, self.owners, strict=True)).encode(), digest_size=8).digest(), "big")

    def automaton(self) -> ahocorasick.Automaton:
        if self.key not in _made:
            _made.clear()
            made = ahocorasick.Automaton()
            for i, w in enumerate(self.windows):
                made.add_word(f" {w} ", (i, len(w), w.count(" ") + 1))
            made.make_automaton()
            _made[self.key] = made
        return _made[self.key]

    def scan(self, text: str | None) -> tuple[int, list[int], set[int]]:
        """Words of the text, flat [start, end) word places of the hit stretches, and the items found."""
        words = words_of(text)
        if not words or not self.windows:
            return len(words), [], set()
        line = b" ".join(words).decode()
        found = list(self.automaton().iter(f" {line} "))
        if not found:
            return len(words), [], set()
        begins = np.flatnonzero(np.frombuffer(f" {line}".encode("utf-32-le"), np.uint32) == 0x20)
        first = np.searchsorted(begins, [end - length - 1 for end, (_, length, _) in found])
        marks = np.zeros(len(words) + 1, np.int64)
        for a, (_, (_, _, n)) in zip(first.tolist(), found, strict=True):
            marks[a] += 1
            marks[a + n] -= 1
        inside = np.cumsum(marks[:-1]) > 0
        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        return len(words), edges.tolist(), {item for i in {i for _, (i, _, _) in found} for item in self.owners[i]}


def spans_of(text: str, stretches: list[int]) -> list[int]:
    """Flat [start, end) code-point offsets in the text of the stretches of words."""
    if not stretches:
        return []
    batch = tk.Batch(data := np.frombuffer(text.encode(), np.uint8), np.array([0, len(data)]))
    batch.words(tk.WORDY)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [int(points[batch.starts[x]] if k % 2 == 0 else points[batch.ends[x - 1]]) for k, x in enumerate(stretches)]


def _union(a: list[int], b: list[int]) -> list[int]:
    marks = sorted([(x, 1 - 2 * (k % 2)) for s in (a, b) for k, x in enumerate(s)], key=lambda m: (m[0], -m[1]))
    out, level = [], 0
    for x, step in marks:
        if level == 0 and step == 1 or level == 1 and step == -1:
            out.append(x)
        level += step
    return out


def _pattern_slices(benchmark: DataFrame, window: int, most: int) -> Iterator[Patterns]:
    """Patterns of all items, or of hashed slices of them if they are more than ``most`` characters."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    # each word is in up to ``window`` patterns
    size = window * tk.bytes_of(items)
    n = max(1, -(-size // most))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Patterns(part.toLocalIterator(), window)


def scanned(docs: DataFrame, benchmark: DataFrame, columns: tuple[str, ...] = ("doc_id",), window: int = WINDOW, most: int = MAX_PATTERN_CHARS) -> DataFrame:
    """The columns named, and n_words, ``hits`` (flat word places), ``spans`` (flat code points) and ``items``.

    Null and empty texts have no words; items without words have no windows; those without id have
    windows, whose words are hit, and are no item; an item in several rows counts once; an empty
    benchmark hits nothing. Repeated rows each keep their row; other columns are left out unless named.
    """
    start = docs.select(*columns, F.col("text").cast("string").alias("__text")).withColumn("n_words", F.lit(0).cast("long"))
    for c, kind in (("hits", "array<int>"), ("spans", "array<int>"), ("items", "array<long>")):
        start = start.withColumn(c, F.lit(None).cast(kind))
    found = None
    for patterns in _pattern_slices(benchmark, window, most):
        found = start if found is None else tk.written(found, "scanned")
        shared = found.sparkSession.sparkContext.broadcast(patterns)
        names = found.columns

        def work(batches: Iterator[pa.RecordBatch], shared=shared, names=names) -> Iterator[pa.RecordBatch]:
            patterns = shared.value
            for b in tk.lean(batches):
                n, hits, spans, items = [], [], [], []
                for text, old, before in zip(b.column("__text"), b.column("hits"), b.column("items"), strict=True):
                    text = text.as_py()
                    count, stretches, who = patterns.scan(text)
                    if old.is_valid:
                        stretches, who = _union(old.as_py(), stretches), who.union(before.as_py())
                    n.append(count)
                    hits.append(stretches)
                    spans.append(spans_of(text, stretches) if stretches else [])
                    items.append(sorted(who))
                new = {"n_words": pa.array(n, pa.int64()), "hits": pa.array(hits, pa.list_(pa.int32())), "spans": pa.array(spans, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_arrays([new.get(c, b.column(c) if c in b.schema.names else None) for c in names], names)

        found = found.mapInArrow(work, found.schema)
    return found


def digest(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    found = scanned(docs, benchmark, **options)
    lengths = F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long"))
    n_hit = F.aggregate(lengths, F.lit(0).cast("long"), lambda total, x: total + x)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The documents in which no window occurs, with their columns, whatever the names of those."""
    plain, back = tk.renamed(docs)
    return back(scanned(plain, benchmark, tuple(c for c in plain.columns if c != "text"), **options).where(F.size("hits") == 0))


def sql(window: int = WINDOW) -> str:
    """The digest for DuckDB, without the spans: windows of documents joined to those of items."""
    words = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
patterns AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), {window}) AS k, unnest(range(1, greatest(len(w) - {window}, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM patterns) WHERE len(w) >= k),
found AS (SELECT doc_id, i, places.k, item_id FROM places JOIN patterns ON places.k = patterns.k AND array_to_string(w[i:i + places.k - 1], ' ') = s),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(k)) AS j FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""
