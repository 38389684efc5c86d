"""Substring dedup: words inside long passages that also start earlier in the corpus are removed.

Difference-cover anchors. COVER modulo PERIOD is a difference cover: for any two places i and j
there is a shift below PERIOD that moves both onto cover places. So two equal windows of WINDOW
words share an equal anchor of WINDOW - PERIOD + 1 words at cover places of both documents, and
only anchors at cover places need be exchanged. An anchor seen twice is then extended: every
window of WINDOW words that holds it is a candidate, and candidates are settled by a 128-bit hash
of the whole window, exchanged once more to find where each starts first.

Documents are dealt to chunks by a hash of id and text, so rows that share an id (or have none) are spread
as others are. A chunk sends each anchor and each candidate
once, whatever its number of copies, so a passage held by a third of all documents costs one
entry a chunk. Entries travel packed by hash bucket, eight bytes an anchor; nothing is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import textkit as tk

WINDOW = 20
#: A perfect difference cover: differences of these give every residue.
PERIOD, COVER = 7, (0, 1, 3)
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20
LEAST = 64

_U = np.uint64
_FIRST = np.iinfo(np.int64).min


def _packed(keys: np.ndarray, n_buckets: int, *columns: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """Bucket numbers in use, and for each column the bytes of each bucket; bucket by the high bits."""
    bucket = ((keys >> _U(40)) % _U(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts, ends = tk.runs(bucket)
    return bucket[cuts], [[c[order][a:b].tobytes() for a, b in zip(cuts, ends, strict=True)] for c in columns]


class _Chunk:
    """The documents of a chunk in the order of their ids, as words; those that share an id by the hash of their text, then by it."""

    def __init__(self, table: pa.Table, window: int):
        ids = table.column("doc_id").combine_chunks()
        texts = tk.text_array(table.column("text"))
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        number = ids.fill_null(_FIRST).to_numpy()
        rank = table.column("rank").to_numpy()
        order = np.lexsort((rank, number))
        same = (number[order][1:] == number[order][:-1]) & (rank[order][1:] == rank[order][:-1])
        if same.any():  # alike but for chance: by the text itself
            order = np.array(sorted(range(len(number)), key=lambda i: (number[i], rank[i], texts[i].as_py())), np.int64)
        self.known, self.ids, self.rank = known[order], number[order], rank[order]
        data, offsets = tk.raw(texts.take(pa.array(order)))
        self.batch = tk.Batch(data, offsets)
        self.batch.words(tk.SPACE_NOT)
        self.hashes = self.batch.word_hashes()
        self.inside = tk.windows_inside(self.batch.at, window)
        self.place = np.arange(len(self.hashes)) - np.repeat(self.batch.at[:-1], self.batch.counts)

    def anchors(self, window: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the anchors, and their hashes."""
        width = window - period + 1
        full = tk.window_hashes(self.hashes, width)
        good = tk.windows_inside(self.batch.at, width)[: len(full)] & np.isin(self.place[: len(full)] % period, cover)
        # documents too short for a window have nothing to match
        good &= np.repeat(self.batch.counts >= window, self.batch.counts)[: len(full)]
        at = np.flatnonzero(good)
        return at, full[at]

    def candidates(self, shared: np.ndarray, window: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
        """Starts of the windows around anchors that are shared with other chunks or in this one."""
        at, keys = self.anchors(window, period, cover)
        _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
        at = at[(n[back] > 1) | np.isin(keys, shared)]
        near = np.zeros(len(self.hashes) + period, bool)
        for back in range(period):
            near[at - back] = True  # a negative place marks the spare end
        return np.flatnonzero(near[: len(self.hashes)] & self.inside)

    def window_keys(self, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for the windows at ``starts``."""
        first = tk.window_hashes(self.hashes, window)[starts] if len(starts) else np.zeros(0, _U)
        second = tk.window_hashes(self.batch.word_hashes("byte2"), window, "word2")[starts] if len(starts) else np.zeros(0, _U)
        return first, second


def _blobs(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of packed cells, and how many each cell holds."""
    cells = column.to_pylist()
    parts = [np.frombuffer(c, kind) for c in cells]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.array([len(p) for p in parts], np.int64)


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order of (a, b, as they come), and flags of where a new pair begins."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.ones(len(order), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return order, new


def remove_repeats(docs: DataFrame, finish: Callable, schema: str, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Apply ``finish(ids, words, removed)`` to each document of (doc_id, text), words as bytes.

    Null texts have no words; a null doc_id sorts before all others; rows that share a doc_id are
    separate documents, ordered by the hash of their text, then by it; rows alike in both lie in one chunk;
    other columns are ignored; an empty table gives no rows.
    """
    if {(a - b) % period for a in cover for b in cover} != set(range(period)) or window < period:
        raise ValueError("cover is no difference cover of the period, or the window is shorter than it")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = tk.bytes_of(docs)
    n_chunks, n_buckets = max(LEAST, -(-size // chunk_bytes)), max(LEAST, -(-size // bucket_bytes))
    chunked = docs.withColumn("rank", F.xxhash64("text")).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "rank"), F.lit(n_chunks)).cast("int"))

    def send_anchors(key: tuple, t: pa.Table) -> pa.Table:
        _, keys = _Chunk(t, window).anchors(window, period, cover)
        keys = np.unique(keys)
        buckets, (blobs,) = _packed(keys, n_buckets, keys)
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "chunk": pa.array(np.full(len(buckets), key[0].as_py()), pa.int32()), "keys": pa.array(blobs, pa.binary())})

    def find_shared(key: tuple, t: pa.Table) -> pa.Table:
        keys, sizes = _blobs(t.column("keys"), _U)
        owner = np.repeat(t.column("chunk").to_numpy(), sizes)
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        same = keys[1:] == keys[:-1]
        shared = np.zeros(len(keys), bool)
        shared[1:] |= same
        shared[:-1] |= same
        return _by_chunk(owner[shared], keys[shared])

    def _by_chunk(owner: np.ndarray, keys: np.ndarray) -> pa.Table:
        order = np.argsort(owner, kind="stable")
        owner, keys = owner[order], keys[order]
        cuts, ends = tk.runs(owner)
        return pa.table({"chunk": pa.array(owner[cuts], pa.int32()), "keys": pa.array([keys[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())})

    def send_windows(key: tuple, t: pa.Table, shared: pa.Table) -> pa.Table:
        c = _Chunk(t, window)
        starts = c.candidates(_blobs(shared.column("keys"), _U)[0], window, period, cover)
        one, two = c.window_keys(starts, window)
        order, new = _distinct(one, two)
        lead = order[new]  # a stable sort: the earliest start of each window in this chunk
        doc = np.searchsorted(c.batch.at, starts[lead], "right") - 1
        buckets, (a, b, ids, ranks) = _packed(one[lead], n_buckets, one[lead], two[lead], c.ids[doc], c.rank[doc])
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "chunk": pa.array(np.full(len(buckets), key[0].as_py()), pa.int32()), "one": pa.array(a, pa.binary()), "two": pa.array(b, pa.binary()), "ids": pa.array(ids, pa.binary()), "ranks": pa.array(ranks, pa.binary())})

    def find_later(key: tuple, t: pa.Table) -> pa.Table:
        one, sizes = _blobs(t.column("one"), _U)
        two, ids, ranks = _blobs(t.column("two"), _U)[0], *(_blobs(t.column(x), np.int64)[0] for x in ("ids", "ranks"))
        owner = np.repeat(t.column("chunk").to_numpy(), sizes)
        order = np.lexsort((ranks, ids, two, one))
        one, two, owner = one[order], two[order], owner[order]
        later = np.zeros(len(one), bool)
        later[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        pairs = np.column_stack([one[later], two[later]]) if later.any() else np.zeros((0, 2), _U)
        return _by_chunk(owner[later], pairs)

    def cut(key: tuple, t: pa.Table, shared: pa.Table, later: pa.Table) -> pa.Table:
        c = _Chunk(t, window)
        starts = c.candidates(_blobs(shared.column("keys"), _U)[0], window, period, cover)
        one, two = c.window_keys(starts, window)
        order, new = _distinct(one, two)
        gone = np.zeros(len(starts), bool)
        gone[order[~new]] = True
        pairs = _blobs(later.column("keys"), _U)[0].reshape(-1, 2)
        if len(pairs):
            both = np.concatenate([pairs[:, 0], one]), np.concatenate([pairs[:, 1], two])
            order, new = _distinct(*both)
            group = np.cumsum(new) - 1
            late = np.zeros(int(new.sum()), bool)
            late[group[order < len(pairs)]] = True
            gone |= late[group[np.argsort(order)][len(pairs) :]]
        removed = tk.covered(starts[gone], window, len(c.hashes))
        return finish(pa.array(c.ids, mask=~c.known), c.batch, removed)

    anchors = chunked.groupBy("chunk").applyInArrow(send_anchors, "bucket int, chunk int, keys binary")
    shared = anchors.groupBy("bucket").applyInArrow(find_shared, "chunk int, keys binary")
    shared = tk.written(shared, "anchors")
    windows = chunked.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(send_windows, "bucket int, chunk int, one binary, two binary, ids binary, ranks binary")
    later = windows.groupBy("bucket").applyInArrow(find_later, "chunk int, keys binary")
    news = shared.withColumn("later", F.lit(False)).unionByName(later.withColumn("later", F.lit(True)))

    def last(key: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
        flag = r.column("later")
        return cut(key, t, r.filter(pc.invert(flag)), r.filter(flag))

    return chunked.groupBy("chunk").cogroup(news.groupBy("chunk")).applyInArrow(last, schema)


def digest(docs: DataFrame, **options: object) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""

    def finish(ids: pa.Array, batch: tk.Batch, removed: np.ndarray) -> pa.Table:
        body, sums, gone = batch.data.tobytes(), [], []
        for d in range(len(batch.counts)):
            a, b = batch.at[d], batch.at[d + 1]
            words = body[batch.offsets[d] : batch.offsets[d + 1]].split()
            drop = removed[a:b]
            n = int(drop.sum())
            if n:
                words = [words[i] for i in np.flatnonzero(~drop)]
            gone.append(n)
            sums.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pa.table({"doc_id": ids, "n_words": pa.array(batch.counts, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sums, pa.string())})

    return remove_repeats(docs, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", **options)


def kept_text(docs: DataFrame, **options: object) -> DataFrame:
    """doc_id and the kept words joined by one space."""

    def finish(ids: pa.Array, batch: tk.Batch, removed: np.ndarray) -> pa.Table:
        body = batch.data.tobytes()
        words = [body[a:b] for a, b in zip(batch.starts.tolist(), batch.ends.tolist(), strict=True)]
        texts = [b" ".join(w for w, r in zip(words[batch.at[d] : batch.at[d + 1]], removed[batch.at[d] : batch.at[d + 1]], strict=True) if not r).decode() for d in range(len(batch.counts))]
        return pa.table({"doc_id": ids, "text": pa.array(texts, pa.string())})

    return remove_repeats(docs, finish, "doc_id long, text string", **options)


def sql(window: int = WINDOW) -> str:
    """The digest for DuckDB: every window as text, numbered by its first start."""
    return f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d WHERE len(w) >= {window}),
late AS (SELECT doc_id, i FROM starts QUALIFY row_number() OVER (PARTITION BY array_to_string(w[i:i + {window - 1}], ' ') ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS g FROM late, range({window}) r(k) GROUP BY doc_id),
cut AS (SELECT d.doc_id, w, CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END AS kept FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM cut"""
