"""Reads of the log, as lazy plans over a table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.values import Stream
from tidelog.plans.scope import Scope
from tidelog.schema import EVENT_COLUMNS


def read_events(events: DataFrame, after: int, limit: int, scope: Scope | None = None) -> DataFrame:
    """The first ``limit`` events in scope beyond a position, in order. The scope filters before the limit."""
    wanted = (scope or Scope()).apply(events.where(F.col("global_position") > after))
    return wanted.select(*EVENT_COLUMNS).orderBy("global_position").limit(limit)


def latest_position(events: DataFrame) -> DataFrame:
    """One row: the last position, 0 for an empty log."""
    return events.agg(F.coalesce(F.max("global_position"), F.lit(0).cast("long")).alias("global_position"))


def read_stream(events: DataFrame, bounded_context: str, aggregate_type: str, aggregate_id: str, first: int | None = None, last: int | None = None) -> Stream:
    """One aggregate's events in order of version, both ends of the range included and either one optional."""
    rows = events.where((F.col("bounded_context") == bounded_context) & (F.col("aggregate_type") == aggregate_type) & (F.col("aggregate_id") == aggregate_id))
    if first is not None:
        rows = rows.where(F.col("aggregate_version") >= first)
    if last is not None:
        rows = rows.where(F.col("aggregate_version") <= last)
    return Stream(bounded_context, aggregate_type, aggregate_id, rows.select(*EVENT_COLUMNS).orderBy("aggregate_version"))
