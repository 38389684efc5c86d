"""Array kernels over batches of UTF-8 texts, and the few Spark helpers all operators share.

A batch is one byte array with document offsets. Every kernel works on all documents of the
batch at once; the byte classes used are ASCII, so they are safe on UTF-8.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that kernels take at once; a longer document is a batch of its own.
BATCH_BYTES = 2 << 20

#: Bytes of rows that Spark hands to a Python worker at once, where the session doesn't say; a longer row goes alone.
HANDED_BYTES = 4 << 20
HANDED = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Characters of labelled texts that a model is fitted on, at most.
SAMPLE_BYTES = 64 << 20
#: Rows of keys that are sent to all tasks at most, some 24 bytes each.
SMALL_ROWS = 1_000_000

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SPACE_NOT = ~SPACE
#: Bytes of words made of ASCII letters, digits and anything beyond ASCII.
WORDY = np.zeros(256, bool)
WORDY[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_U = np.uint64
_BASES = {"word": 0xD1342543DE82EF95, "word2": 0xE7037ED1A0B428DB}
_SEEDS = {"byte": 0x9E3779B97F4A7C55, "byte2": 0xA0761D6478BD642F}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}
#: Words of over LONG bytes are hashed one by one; of others, eight bytes at a time.
LONG = 64
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _powers.get(kind)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        base = _BASES[kind]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, _U)
            p[0] = 1
            out.append(np.cumprod(p, dtype=_U))
        have = (out[0], out[1])
        if size <= 8 * BATCH_BYTES:
            _powers[kind] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each input bit over 64 bits."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Batch:
    """Texts of a batch as bytes; ``words`` finds the maximal runs of the bytes in a class."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def words(self, inside: np.ndarray) -> None:
        n = len(self.data)
        flags = inside[self.data]
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = flags[:-1]
        before[self.offsets[:-1][self.offsets[:-1] < n]] = False
        self.starts = np.flatnonzero(flags & ~before)
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = flags[1:]
        ends = self.offsets[1:]
        after[ends[ends > 0] - 1] = False
        self.ends = np.flatnonzero(flags & ~after) + 1
        #: Word offsets of the documents.
        self.at = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.at)

    def word_hashes(self, kind: str = "byte", data: np.ndarray | None = None) -> np.ndarray:
        """64 bits for each word; words of equal length up to eight bytes never share theirs."""
        data = self.data if data is None else data
        size = self.ends - self.starts
        eights = np.lib.stride_tricks.as_strided(np.concatenate([data, np.zeros(8, np.uint8)]), (len(data) + 1, 8), (1, 1))
        out = size.astype(_U) * _U(0x9FB21C651E98DF25) + _U(_SEEDS[kind])
        which = np.flatnonzero(size <= LONG)
        for k in range(0, LONG, 8):
            which = which[size[which] > k] if k else which
            if not len(which):
                break
            part = eights[self.starts[which] + k].view("<u8").ravel() & _FIRST_BYTES[np.minimum(size[which] - k, 8)]
            out[which] = mix(out[which] ^ part)
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(data[self.starts[i] : self.ends[i]], _SEEDS[kind])
        return out

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def window_hashes(hashes: np.ndarray, width: int, kind: str = "word") -> np.ndarray:
    """Hash of the ``width`` hashes from each place on; places too near the end are left out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    up, down = powers(kind, len(hashes))
    sums = np.empty(len(hashes) + 1, _U)
    sums[0] = 0
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[width:] - sums[:n]) * down[:n])


def windows_inside(at: np.ndarray, width: int) -> np.ndarray:
    """Flags of the words from which ``width`` words of the same document follow (itself included)."""
    n = int(at[-1])
    lo, hi = at[:-1], np.maximum(at[1:] - width + 1, at[:-1])
    return np.cumsum((np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1))[:n]) > 0


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Flags of the n words inside any window that begins at one of ``starts``."""
    marks = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + width, n), minlength=n + 1)
    return np.cumsum(marks[:n]) > 0


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return starts, np.append(starts[1:], len(x))


def counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size in turn."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column.cast(pa.large_string()).fill_null("")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string array without copying."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(lengths: np.ndarray, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive documents of about ``limit`` bytes; each has one document at least."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    i, n = 0, len(lengths)
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, "right")) - 1)
        yield i, j
        i = j


def batches(column: pa.Array | pa.ChunkedArray, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int, Batch]]:
    """(first, end, Batch) over all texts of a column; nulls as empty texts."""
    whole = text_array(column)
    data, offsets = raw(whole)
    for i, j in pieces(np.diff(offsets), limit):
        yield i, j, Batch(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def release() -> None:
    """Gives back to the system what is free: workers outlive their tasks, and wait with all that they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(batches: Iterator[pa.RecordBatch], every: int = 0) -> Iterator[pa.RecordBatch]:
    """The batches of a task; what was held for one is given back before the next and at the end. Memory that is given back
    has to be asked for again, so short batches may go on together until they have ``every`` bytes."""
    release()
    passed = 0
    for b in batches:
        passed += b.nbytes if every else 0
        yield b
        del b
        if passed >= every:
            release()
            passed = 0
    if passed:
        release()


def short_batches(spark: SparkSession) -> None:
    """From here on the session hands rows to Python workers in batches of HANDED_BYTES, unless it has a limit of its own.

    Spark's own limit is 64 MB. Buffers of that size, one for each task at work, leave gaps in an executor's native memory that
    it never gives back.
    """
    if HANDED not in spark.conf.getAll:
        spark.conf.set(HANDED, str(HANDED_BYTES))


def values(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A table of a few values that the driver has.

    They go as Arrow: of Python's rows Spark makes an RDD of pickles, for which executors keep a second daemon with workers.
    """
    return spark.createDataFrame(pa.table(columns))


def renamed(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table under names that can't clash (but for ``text``), and what gives its columns back from
    a table that has the text as ``__text``."""
    names = {c: c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    return plain, lambda out: out.select(*(F.col("__text" if n == "text" else n).alias(c) for c, n in names.items()))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared folder. Where none is set, a temporary one of this machine in local mode, and
    else an error: executors on other machines would each write to a folder of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within are deleted at the end, but those marked to be kept: for steps whose result is written itself."""
    _scratch.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in _scratch.pop():
            hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop(path), True)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows as a table in the shared folder, which cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    if _scratch and not keep:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(keys: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A written table of a few plain columns, marked for broadcast if it has at most ``most`` rows; else joins deal it out."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sampled(docs: DataFrame, labels: DataFrame, rows: int, seed: int, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[float]]:
    """Texts and labels y of labelled documents, shuffled: those of the smallest hashes of doc_id, up to ``rows`` of them
    and ``most_bytes`` of text. They come to the driver one after the other, so it never holds more."""
    place = [F.xxhash64("doc_id"), "doc_id"]
    chosen = labels.select("doc_id", "y").dropna().orderBy(*place, "y").limit(rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", text.alias("__text")).join(F.broadcast(chosen), "doc_id").orderBy(*place, "y", "__text").limit(rows)
    texts, ys, held = [], [], 0
    for r in found.select("__text", "y").toLocalIterator():
        held += len(r["__text"])
        if held > most_bytes and texts:
            break
        texts.append(r["__text"])
        ys.append(r["y"])
    order = np.random.default_rng(seed).permutation(len(texts)).tolist()
    return [texts[i] for i in order], [ys[i] for i in order]


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def size_of(docs: DataFrame) -> int:
    """Bytes of a table as its plan estimates them, from its files; counted if there is no estimate."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else bytes_of(docs)


def bytes_of(docs: DataFrame, text: str = "text") -> int:
    """Bytes of text in all rows."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])
