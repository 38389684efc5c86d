"""SimHash near-dedup: fingerprints of word shingles, linked within a few differing bits.

Pigeonring filtering. The bits are cut into SEGMENTS pieces around a ring. If two fingerprints
differ in at most t bits in all, there is a piece from which every chain of l consecutive pieces
differs in at most t*l/SEGMENTS bits. The longest chain whose budget is below one bit must agree
exactly and is the join key; the budgets of the longer chains prune before the last one, which is
the whole Hamming distance.

The more pieces, the longer the chain that must agree (25 bits of 64 with 5 pieces, 30 with 15), so
their number follows the number of fingerprints, and keys of unlike ones stay small at any size.

Equal fingerprints are one row from the start. A key can then be large only where fingerprints crowd,
as those of near copies do. A key with over HOT of them is not joined with itself: its fingerprints are
linked through their neighbours at one bit, of which each has 65; two fingerprints within two bits share
one, and no neighbour has over 65 members. So no group is ever paired out, and no link is lost.
Components come from star contraction over written tables; AQE splits the partitions of star centres.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import textkit as tk

SHINGLE, MAX_BITS, HOT, SEED = 3, 2, 64, 42
#: Fingerprints of a key, on average, that the number of pieces is chosen for; and the most pieces.
PER_KEY, MOST_SEGMENTS = 4, 15


def fingerprints_of(batch: tk.Batch, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of a batch as unsigned 64-bit integers; a text without words has 0."""
    batch.words(tk.SPACE_NOT)
    n_docs, n = len(batch.counts), len(batch.starts)
    out = np.zeros(n_docs, np.uint64)
    if not n:
        return out
    # one space between the words of a document, ASCII in lower case
    solid = tk.SPACE_NOT[batch.data]
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    place = np.cumsum(keep) - 1
    body = np.where(solid, tk.LOWER[batch.data], 0x20).astype(np.uint8)[keep].tobytes()
    starts, ends = place[batch.starts], place[batch.ends - 1] + 1
    # a document has counts - shingle + 1 shingles, or one of all its words
    many = np.where(batch.counts >= shingle, batch.counts - shingle + 1, np.minimum(batch.counts, 1))
    at = np.concatenate([[0], np.cumsum(many)])
    first = np.arange(at[-1]) - np.repeat(at[:-1], many) + np.repeat(batch.at[:-1], many)
    final = np.minimum(first + shingle, np.repeat(batch.at[1:], many)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(body[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[final].tolist(), strict=True)), np.uint64, int(at[-1]))
    some = many > 0
    ones = np.add.reduceat(np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64), at[:-1][some], axis=0, dtype=np.int32)
    out[some] = np.packbits(ones * 2 > many[some][:, None], axis=1).view(">u8").ravel()
    return out


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named, and ``fp``, a long with the fingerprint's bits; ``text`` may be null."""
    kept = docs.select(*columns, F.col("text").cast("string").alias("__text"))
    schema = kept.drop("__text").schema.add("fp", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [fingerprints_of(x, shingle) for _, _, x in tk.batches(b.column("__text"))]
            fp = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(fp)], [*columns, "fp"])

    return kept.mapInArrow(work, schema)


def _mask(first: int, length: int, segments: int) -> int:
    """Signed mask of ``length`` consecutive pieces of the ring."""
    cuts = [64 * k // segments for k in range(segments + 1)]
    bits = sum(((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in ((first + j) % segments for j in range(length)))
    return bits - (1 << 64) if bits >> 63 else bits


def segments_for(n: int, max_bits: int = MAX_BITS) -> int:
    """The fewest pieces with which n fingerprints that are not alike come to PER_KEY a key at most."""
    for segments in range(2 * max_bits + 1, MOST_SEGMENTS, max_bits):
        exact = -(-segments // max_bits) - 1
        if n <= PER_KEY << (64 * exact // segments):
            return segments
    return MOST_SEGMENTS


def links(prints: DataFrame, max_bits: int = MAX_BITS, segments: int | None = None, hot: int = HOT) -> DataFrame:
    """Edges (u, v), u > v, between the distinct fingerprints in ``fp``: they join all that lie within max_bits.

    Within keys of up to ``hot`` fingerprints these are all pairs within max_bits; within larger ones
    they are a spanning set with the same components.
    """
    if max_bits != 2:
        raise ValueError("the neighbour scheme for large keys is for two bits")
    segments = segments or segments_for(prints.count(), max_bits)
    exact = -(-segments // max_bits) - 1
    if exact < 1:
        raise ValueError("too few segments for a chain without differences")
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(_mask(i, exact, segments))).alias("part")) for i in range(segments)])).alias("k")
    keyed = prints.select("fp", keys).select("fp", "k.*")
    sized = keyed.groupBy("start", "part").agg(F.count("*").alias("n"), F.min("fp").alias("low")).where("n > 1")
    sized = tk.written(sized, "keys")
    few = keyed.join(sized.where(F.col("n") <= hot), ["start", "part"]).select("start", "part", "fp")
    a, b = few.alias("a"), few.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))

    def chain(i: int) -> Column:
        budgets = [F.bit_count(differ.bitwiseAND(F.lit(_mask(i, n, segments)))) <= n * max_bits // segments for n in range(exact + 1, segments)]
        every = F.lit(True)
        for x in budgets:
            every = every & x
        return every & (F.bit_count(differ) <= max_bits)

    budget = F.lit(False)
    for i in reversed(range(segments)):
        budget = F.when(F.col("a.start") == i, chain(i)).otherwise(budget)
    cold = a.join(b, (F.col("a.start") == F.col("b.start")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.fp") > F.col("b.fp")) & budget).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    many = keyed.join(sized.where(F.col("n") > hot).select("start", "part"), ["start", "part"]).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << k) - ((1 << 64) if k == 63 else 0))) for k in range(64)])
    near = many.select("fp", F.explode(flips).alias("near")).groupBy("near").agg(F.min("fp").alias("v"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    warm = near.select(F.explode("all").alias("u"), "v").where("u > v")
    return cold.unionByName(warm).distinct()


def has_chain(differ: np.ndarray, most: np.ndarray, longest: int | None = None) -> np.ndarray:
    """Pigeonring on rows of differing bits by segment: whether from some segment on every chain, up to the ``longest``
    asked for, stays within its share of ``most``.

    True wherever a row adds up to ``most`` at most; false for many that don't.
    """
    n, segments = differ.shape
    ring = np.concatenate([differ, differ], axis=1).astype(np.int32)
    total, alive, most = np.zeros((n, segments), np.int32), np.ones((n, segments), bool), most.astype(np.int32)[:, None]
    for length in range(1, (longest or segments) + 1):
        total += ring[:, length - 1 : length - 1 + segments]
        alive &= segments * total <= length * most
    return alive.any(axis=1)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in (u, v), root being the smallest node of its component: large-star and small-star rounds."""
    edges = tk.written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = tk.written(small, "stars")


def groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, segments: int | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, fp and component_id, one row per row of (doc_id, text).

    Null, empty and blank texts have fingerprint zero and are linked like any other. Repeated rows
    each keep their row. A null doc_id is never a component_id unless its component has no other. Other
    columns are ignored, whatever their names; a text is hashed whole; an empty table gives no rows.
    """
    prints = tk.written(with_fingerprints(docs, shingle), "prints")
    distinct = tk.written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), max_bits, segments, hot))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
