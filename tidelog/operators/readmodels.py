"""Read models: what consumers make of events. ``payload`` is JSON text or its bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.plans.scope import Scope


def decoded(events: DataFrame, schema: str, name: str = "data") -> DataFrame:
    """The payload as a struct under ``name``; null where it isn't JSON."""
    return events.withColumn(name, F.from_json(F.col("payload").cast("string"), schema))


def listed(events: DataFrame, event_type: str, field: str) -> DataFrame:
    """One payload field of all events of a type, in order."""
    return events.where(F.col("event_type") == event_type).select("global_position", F.get_json_object(F.col("payload").cast("string"), f"$.{field}").alias(field)).orderBy("global_position")


def counted(events: DataFrame, scope: Scope | None = None, amount: Column | None = None) -> DataFrame:
    """n_events in scope and, with an amount, its total to two decimals."""
    rows = (scope or Scope()).apply(events)
    sums = [] if amount is None else [F.coalesce(F.sum(F.round(amount, 2).cast("decimal(18,2)")), F.lit(0)).cast("double").alias("revenue")]
    return rows.agg(F.count("*").alias("n_events"), *sums)


def audited(events: DataFrame) -> DataFrame:
    return events.groupBy("bounded_context", "aggregate_type", "event_type").agg(F.count("*").alias("n_events"))


def by_version(events: DataFrame) -> DataFrame:
    """Events of each type, of either known version and of any other."""
    return events.groupBy("event_type").agg(*(F.count_if(F.col("event_version") == v).alias(f"v{v}") for v in (1, 2)), F.count_if(~F.col("event_version").isin(1, 2)).alias("unknown"))


def last_event(events: DataFrame) -> DataFrame:
    """Count, last position, and the time of the last event; 0, 0 and null for an empty log."""
    return events.agg(F.count("*").alias("n_events"), F.coalesce(F.max("global_position"), F.lit(0).cast("long")).alias("last_position"), F.max_by("created_at", "global_position").alias("last_at"))


def status(segments: DataFrame, events: DataFrame) -> DataFrame:
    """Lag of each consumer behind the log: its lowest checkpoint against the last position, with its state and a percentage.

    state: not started at checkpoint 0, caught up at the last position or beyond, else behind.
    """
    top = events.agg(F.coalesce(F.max("global_position"), F.lit(0).cast("long")).alias("head"))
    rows = segments.groupBy("consumer_name").agg(F.min("checkpoint").alias("checkpoint")).crossJoin(F.broadcast(top))
    lag = F.col("head") - F.col("checkpoint")
    state = F.when(F.col("checkpoint") == 0, "NOT_STARTED").when(lag <= 0, "CAUGHT_UP").otherwise("BEHIND")
    return rows.select("consumer_name", "checkpoint", lag.alias("lag"), state.alias("state"), F.when(F.col("head") == 0, 100.0).otherwise(F.round(100.0 * F.col("checkpoint") / F.col("head"), 2)).alias("percent"))


def health(checkpoints: DataFrame, events: DataFrame, now: Column, stale_seconds: float = 300.0) -> DataFrame:
    """(consumer_name, checkpoint, updated_at) with ``health``: STALE if untouched for five minutes, else CAUGHT_UP at the last position or PROCESSING."""
    top = events.agg(F.coalesce(F.max("global_position"), F.lit(0).cast("long")).alias("head"))
    old = F.col("updated_at") < now - F.expr(f"make_dt_interval(0, 0, 0, {stale_seconds})")
    verdict = F.when(old, "STALE").when(F.col("checkpoint") >= F.col("head"), "CAUGHT_UP").otherwise("PROCESSING")
    return checkpoints.crossJoin(F.broadcast(top)).select(*checkpoints.columns, verdict.alias("health"))


def caused_by(events: DataFrame, correlation: str | None = None, causation: str | None = None) -> DataFrame:
    """Events of one correlation, and of one cause, in order."""
    for column, value in (("correlation_id", correlation), ("causation_id", causation)):
        if value is not None:
            events = events.where(F.col(column) == value)
    return events.orderBy("global_position")


def latest(events: DataFrame, *keys: str) -> DataFrame:
    """The last event of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("global_position").desc()))
    return events.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def once(events: DataFrame) -> DataFrame:
    """Each event_id once: its first position."""
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy("global_position"))
    return events.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
