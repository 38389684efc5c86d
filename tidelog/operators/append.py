"""Appends as plans: conflicts of a batch of events with a log, and their versions and positions.

A batch may hold events of many aggregates. ``ordinal`` gives their order; ``expected_version`` is
-1 (any), 0 (no stream) or the exact version, the same for all events of an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.schema import AGGREGATE


def validated(rows: list[dict]) -> str | None:
    """The first fault of one aggregate's events, in order of events; None if there is none."""
    if not rows:
        return "no events to append"
    if not rows[0]["bounded_context"]:
        return "bounded context is required"
    for i, row in enumerate(rows[1:], 1):
        if not row["bounded_context"]:
            return f"event {i}: bounded context is required"
        for column, what in zip(AGGREGATE, ("bounded context", "aggregate type", "aggregate ID"), strict=True):
            if row[column] != rows[0][column]:
                return f"event {i}: {what} mismatch: {row[column]!r} and {rows[0][column]!r}"
    return None


def _met(expected: Column, head: Column) -> Column:
    return F.when(expected == -1, True).when(expected == 0, head.isNull()).otherwise(F.coalesce(head == expected, F.lit(False)))


def conflicts(new: DataFrame, heads: DataFrame, existing: DataFrame) -> DataFrame:
    """Aggregates or event ids that keep a batch out: (bounded_context, aggregate_type, aggregate_id, event_id, reason).

    reason is 'version' where the head isn't as expected, 'event_id' where an id is in the log
    already or twice in the batch, 'expectation' where an aggregate's events expect different versions.
    """
    by_aggregate = new.groupBy(*AGGREGATE).agg(F.min("expected_version").alias("low"), F.max("expected_version").alias("high"))
    joined = by_aggregate.join(heads.select(*AGGREGATE, F.col("aggregate_version").alias("head")), list(AGGREGATE), "left")
    none = F.lit(None).cast("string")
    version = joined.where((F.col("low") == F.col("high")) & ~_met(F.col("low"), F.col("head"))).select(*AGGREGATE, none.alias("event_id"), F.lit("version").alias("reason"))
    mixed = joined.where("low <> high").select(*AGGREGATE, none.alias("event_id"), F.lit("expectation").alias("reason"))
    ids = new.groupBy("event_id").agg(*(F.min(c).alias(c) for c in AGGREGATE), F.count("*").alias("n"))
    known = ids.join(existing.select("event_id", F.lit(1).alias("known")).dropDuplicates(["event_id"]), "event_id", "left")
    twice = known.where((F.col("n") > 1) | F.col("known").isNotNull()).select(*AGGREGATE, "event_id", F.lit("event_id").alias("reason"))
    return version.unionByName(mixed).unionByName(twice)


def assigned(new: DataFrame, heads: DataFrame) -> DataFrame:
    """The batch with ``aggregate_version``: the head's, or 0, plus the place among the aggregate's events."""
    place = F.row_number().over(Window.partitionBy(*AGGREGATE).orderBy("ordinal"))
    head = heads.select(*AGGREGATE, F.col("aggregate_version").alias("__head"))
    return new.withColumn("__place", place).join(head, list(AGGREGATE), "left").withColumn("aggregate_version", F.coalesce("__head", F.lit(0)) + F.col("__place")).drop("__place", "__head")


def heads_of(events: DataFrame, at: str = "created_at") -> DataFrame:
    """Head versions of aggregates: the highest each."""
    return events.groupBy(*AGGREGATE).agg(F.max("aggregate_version").alias("aggregate_version"), F.max(at).alias("updated_at"))
