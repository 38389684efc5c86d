"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

Shares p of the sources' tokens are raised to an exponent a and normalised. The exponent is found
by bisection: the largest a in [0, 1] whose weights reach the target entropy (as a share of the
greatest possible), but no smaller than the a at which the most repeated source is passed over
``repeats`` times for each pass over the least repeated one. The budget is the smallest with which
every source is passed over once, so no document is left out; it can be given instead.

Within a source, documents are dealt to blocks by a hash, and a hash permutes each block. A block
has its share of the source's passes: whole passes repeat all of it, and a fractional pass takes
documents in permuted order while their middle lies within the block's budget. So no order over a
whole source is needed, and no task holds more than the keys of a block. There are at most MOST_BLOCKS
blocks beside one a source; a row for each says up to which key its fractional pass goes, and that is
all a document is held against, so texts are read once and never shuffled.

The totals of up to MOST_SOURCES sources are planned on the driver. Of more, the exponent is found by
jobs over the written table of totals, each narrowing it 32-fold, and the plan is a table that joins
deal out: the same plan, without a bound on sources.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import textkit as tk

ENTROPY, REPEATS, BLOCK_DOCS, SEED = 0.95, 2.0, 1024, 17
#: Sources whose plan is made on the driver, and blocks beside one a source.
MOST_SOURCES, MOST_BLOCKS = 100_000, 65_536


def n_tokens(text: str = "text") -> Column:
    """Words between white space; null texts have none."""
    stripped = F.regexp_replace(F.col(text).cast("string"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(F.coalesce(F.length(stripped), F.lit(0)) == 0, 0).otherwise(F.size(F.split(stripped, r"[\x20\x09-\x0D]+"))).cast("long")


@dataclass(frozen=True)
class Plan:
    """exponent; by source: its weight, its passes (possibly fractional) and its number of blocks."""

    exponent: float
    weight: dict[str | None, float]
    passes: dict[str | None, float]
    blocks: dict[str | None, int]


def weights(tokens: list[int], exponent: float) -> list[float]:
    total = sum(tokens)
    raised = [(t / total) ** exponent for t in tokens]
    whole = sum(raised)
    return [r / whole for r in raised]


def entropy(shares: list[float]) -> float:
    return -sum(p * math.log(p) for p in shares if p > 0)


def _bisect(holds, steps: int = 60) -> float:
    """The largest a in [0, 1] where ``holds`` is true; it is true up to some a. 0 if nowhere."""
    if holds(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def plan(tokens: dict[str | None, int], docs: dict[str | None, int], target: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None, block_docs: int = BLOCK_DOCS) -> Plan:
    """Weights and passes. Sources without tokens have weight 0 and one pass; no sources: an empty plan."""
    names = sorted((s for s, t in tokens.items() if t > 0), key=lambda s: (s is not None, s or ""))
    some = [tokens[s] for s in names]
    per_block = max(block_docs, -(-sum(docs.values()) // MOST_BLOCKS))
    blocks = {s: max(1, -(-n // per_block)) for s, n in docs.items()}
    if not names:
        return Plan(1.0, dict.fromkeys(tokens, 0.0), dict.fromkeys(tokens, 1.0), blocks)
    by_entropy = _bisect(lambda a: entropy(weights(some, a)) >= target * math.log(len(some)) - 1e-12)
    spread = max(some) / min(some)
    by_repeats = 0.0 if spread <= repeats else 1.0 - _bisect(lambda x: spread**x <= repeats)
    exponent = max(by_entropy, by_repeats)
    w = weights(some, exponent)
    budget = max(t / x for t, x in zip(some, w, strict=True)) if budget is None else budget
    passes = dict.fromkeys(tokens, 1.0) | {s: round(budget * x / t, 9) for s, x, t in zip(names, w, some, strict=True)}
    return Plan(exponent, dict.fromkeys(tokens, 0.0) | dict(zip(names, w, strict=True)), passes, blocks)


def _narrow(holds: Callable[[list[float]], list[bool]], rounds: int = 12, width: int = 32) -> float:
    """Like _bisect, but ``holds`` tells of ``width`` places at once."""
    if holds([1.0])[0]:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(rounds):
        places = [low + (high - low) * k / width for k in range(1, width)]
        right = sum(holds(places))
        low, high = ([low, *places][right], [*places, high][right])
    return low


def plan_table(totals: DataFrame, target: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The plan of rows (source, t, n), tokens and documents of each, as rows (source, weight, passes, blocks)."""
    some = totals.where("t > 0")
    whole, most, least, n_some = some.agg(F.sum("t"), F.max("t"), F.min("t"), F.count("*")).first()
    n_docs = totals.agg(F.sum("n")).first()[0] or 0
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / max(block_docs, -(-n_docs // MOST_BLOCKS)))).cast("int").alias("blocks")
    if not n_some:
        return totals.select("source", F.lit(0.0).alias("weight"), F.lit(1.0).alias("passes"), blocks)
    share = F.col("t") / F.lit(float(whole))

    def entropies(places: list[float]) -> list[bool]:
        sums = some.agg(*(f for a in places for f in (F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share))))).first()
        # of weights p**a / z: log z less a times the mean of log p
        return [math.log(z) - a * pl / z >= target * math.log(n_some) - 1e-12 for a, z, pl in zip(places, sums[::2], sums[1::2], strict=True)]

    spread = most / least
    by_repeats = 0.0 if spread <= repeats else 1.0 - _bisect(lambda x: spread**x <= repeats)
    exponent = max(_narrow(entropies), by_repeats)
    z = some.agg(F.sum(F.pow(share, F.lit(exponent)))).first()[0]
    weight = F.when(F.col("t") > 0, F.pow(share, F.lit(exponent)) / F.lit(z)).otherwise(0.0)
    # passes are budget * weight / t; the smallest budget that gives all one pass is the largest t / weight
    least_budget = some.agg(F.max(F.col("t") / (F.pow(share, F.lit(exponent)) / F.lit(z)))).first()[0]
    passes = F.when(F.col("t") > 0, F.round(F.lit(float(least_budget if budget is None else budget)) * weight / F.col("t"), 9)).otherwise(1.0)
    return totals.select("source", weight.alias("weight"), passes.alias("passes"), blocks)


def planned(counted: DataFrame, most_sources: int = MOST_SOURCES, **options: object) -> DataFrame:
    """Rows (__source, weight, passes, blocks) for rows of (source, n_tokens); sent to all tasks if there are few."""
    totals = tk.written(counted.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")), "totals")
    rows = totals.limit(most_sources + 1).collect()
    if len(rows) > most_sources:
        return tk.written(plan_table(totals, **options), "plan").withColumnRenamed("source", "__source")
    p = plan({r.source: r.t for r in rows}, {r.source: r.n for r in rows}, **options)
    names = sorted(p.weight, key=lambda s: (s is not None, s or ""))
    columns = {"weight": pa.array([p.weight[s] for s in names], pa.float64()), "passes": pa.array([p.passes[s] for s in names], pa.float64()), "blocks": pa.array([p.blocks[s] for s in names], pa.int32())}
    return F.broadcast(tk.values(counted.sparkSession, __source=pa.array(names, pa.string()), **columns))


def _dealt(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Rows with doc_id, source and a hash of their text, with the plan of their source, ``block`` and ``__key``, their place's key in it."""
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    return joined.withColumn("block", F.pmod(F.xxhash64("doc_id", "hash", F.lit(seed)), F.col("blocks")).cast("int")).withColumn("__key", F.xxhash64("doc_id", "hash", F.lit(seed + 1)))


def _marked(counted: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """The rows with place, ``base``, the passes that are whole, and ``more``, 1 for those of the fractional pass."""
    within = Window.partitionBy("source", "block")
    ordered = within.orderBy("__key", "doc_id", "n_tokens")
    cumulated = _dealt(counted, plan, seed).withColumn("place", F.row_number().over(ordered)).withColumn("__upto", F.sum("n_tokens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    total = cumulated.withColumn("__all", F.sum("n_tokens").over(within))
    part = (F.col("passes") - F.floor("passes")) * F.col("__all")
    # keys rise along the block, so the last one inside says all
    last = F.max(F.when(F.col("__upto") - F.col("n_tokens") / 2 < part, F.col("__key"))).over(within)
    return total.withColumn("base", F.floor("passes").cast("int")).withColumn("more", F.coalesce((F.col("__key") <= last).cast("int"), F.lit(0))).drop("__upto", "__all", "passes", "blocks")


def realised(counted: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows of (doc_id, source, hash, n_tokens) with weight, block, place in the block's permutation, and ``copies``.

    Null sources are a source of their own. Rows alike in id and text stand together in one block, in
    any order, and are all taken as often as the one of them taken most.
    """
    return _marked(counted, plan, seed).withColumn("copies", F.col("base") + F.col("more")).drop("base", "more", "__key", "hash")


def _counted(docs: DataFrame) -> DataFrame:
    return tk.written(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("hash"), n_tokens().alias("n_tokens")), "counted")


def digest(docs: DataFrame, seed: int = SEED, **options: object) -> DataFrame:
    """One row per document: doc_id, source, n_tokens, weight, block, place, copies.

    Null and empty texts have no tokens; a null doc_id is one like others; an empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    counted = _counted(docs)
    return realised(counted, planned(counted, **options), seed)


def mixed(docs: DataFrame, seed: int = SEED, **options: object) -> DataFrame:
    """The documents, each as often as the plan takes it, with their columns, whatever the names of those.

    Rows alike in id, source and text are all taken alike. An empty table gives no rows.
    """
    names = docs.columns
    counted = _counted(docs)
    plan = planned(counted, **options)
    edges = _marked(counted, plan, seed).groupBy(F.col("source").alias("__s"), F.col("block").alias("__b")).agg(F.min("base").alias("base"), F.max(F.when(F.col("more") == 1, F.col("__key"))).alias("last"))
    edges = tk.written(edges, "edges")
    plain = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names))).alias("row"), F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("hash"))
    joined = _dealt(plain, plan, seed).join(tk.small(edges, 2 * MOST_BLOCKS + MOST_SOURCES), F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")))
    copies = F.col("base") + F.coalesce((F.col("__key") <= F.col("last")).cast("int"), F.lit(0))
    rows = joined.select("row", F.explode(F.array_repeat(F.lit(0), copies)).alias("pass"))
    return rows.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)))
