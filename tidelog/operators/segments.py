"""Coordination as transitions: tables of segments and workers in, the next tables out.

Nothing reads a clock: ``now`` is a column or literal that the caller gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.errors import SegmentNotOwnedError
from tidelog.functions.pacing import fair_share
from tidelog.schema import SEGMENT_SCHEMA, WORKER_SCHEMA

def _free() -> Column:
    return F.lit(None).cast("string")


def _mine(consumer: str) -> Column:
    return F.col("consumer_name") == consumer


def initialized(segments: DataFrame, consumer: str, total: int) -> DataFrame:
    """Segments 0 to total - 1 of a consumer where missing, free and at checkpoint 0; what is there keeps owner and
    checkpoint and takes the new total, so those at or beyond it are known to be out of use."""
    wanted = segments.sparkSession.range(total).select(F.lit(consumer).alias("consumer_name"), F.col("id").cast("int").alias("segment_id"), F.lit(total).alias("total_segments"), _free().alias("owner_id"), F.lit(0).cast("long").alias("checkpoint"))
    missing = wanted.join(segments.select("consumer_name", "segment_id"), ["consumer_name", "segment_id"], "left_anti")
    same = segments.withColumn("total_segments", F.when(_mine(consumer), F.lit(total)).otherwise(F.col("total_segments")))
    return same.select(*SEGMENT_SCHEMA.names).unionByName(missing.select(*SEGMENT_SCHEMA.names))


def of_consumer(segments: DataFrame, consumer: str) -> DataFrame:
    return segments.where(_mine(consumer)).orderBy("segment_id")


def next_free(segments: DataFrame, consumer: str, n: int = 1) -> DataFrame:
    """The n lowest segments without owner; none at or beyond the total, to which no aggregate belongs."""
    return segments.where(_mine(consumer) & F.col("owner_id").isNull() & (F.col("segment_id") < F.col("total_segments"))).orderBy("segment_id").limit(n).select("consumer_name", "segment_id")


def _owned_by(segments: DataFrame, chosen: DataFrame, owner: Column) -> DataFrame:
    marked = segments.join(F.broadcast(chosen.withColumn("__chosen", F.lit(True))), ["consumer_name", "segment_id"], "left")
    return marked.withColumn("owner_id", F.when(F.col("__chosen"), owner).otherwise(F.col("owner_id"))).select(*SEGMENT_SCHEMA.names)


def claimed(segments: DataFrame, consumer: str, worker: str, n: int = 1) -> DataFrame:
    """The n lowest free segments become the worker's."""
    return _owned_by(segments, next_free(segments, consumer, n), F.lit(worker))


def released(segments: DataFrame, consumer: str, segment: int, worker: str) -> DataFrame:
    """The segment becomes free if the worker owns it; its checkpoint stays."""
    own = _mine(consumer) & (F.col("segment_id") == segment) & (F.col("owner_id") == worker)
    return segments.withColumn("owner_id", F.when(own, _free()).otherwise(F.col("owner_id")))


def active(workers: DataFrame, consumer: str, now: Column, stale_seconds: float) -> DataFrame:
    """Workers whose heartbeat is at least now less the threshold, by id."""
    return workers.where(_mine(consumer) & (F.col("last_heartbeat") >= now - F.expr(f"make_dt_interval(0, 0, 0, {stale_seconds})"))).orderBy("worker_id")


def stale_segments(segments: DataFrame, workers: DataFrame, consumer: str, now: Column, stale_seconds: float) -> DataFrame:
    """Owned segments whose owner is no active worker, registered or not."""
    alive = active(workers, consumer, now, stale_seconds).select(F.col("worker_id").alias("owner_id"))
    return segments.where(_mine(consumer) & F.col("owner_id").isNotNull()).join(alive, "owner_id", "left_anti").select(*SEGMENT_SCHEMA.names)


def reclaimed(segments: DataFrame, workers: DataFrame, consumer: str, now: Column, stale_seconds: float) -> DataFrame:
    """Those segments become free."""
    return _owned_by(segments, stale_segments(segments, workers, consumer, now, stale_seconds).select("consumer_name", "segment_id"), _free())


def checkpoint_of(segments: DataFrame, consumer: str, segment: int) -> DataFrame:
    """One row: the checkpoint, 0 if there is no such segment."""
    return segments.where(_mine(consumer) & (F.col("segment_id") == segment)).agg(F.coalesce(F.max("checkpoint"), F.lit(0).cast("long")).alias("checkpoint"))


def owned_checkpoint(segments: DataFrame, consumer: str, segment: int, worker: str) -> int:
    row = segments.where(_mine(consumer) & (F.col("segment_id") == segment) & (F.col("owner_id") == worker)).select("checkpoint").first()
    if row is None:
        raise SegmentNotOwnedError(f"segment {segment} of {consumer} isn't owned by {worker}")
    return row.checkpoint


def with_checkpoint(segments: DataFrame, consumer: str, segment: int, position: int, worker: str | None = None) -> DataFrame:
    """The checkpoint set; with a worker, only if that one owns the segment, else SegmentNotOwnedError."""
    if worker is not None:
        owned_checkpoint(segments, consumer, segment, worker)
    here = _mine(consumer) & (F.col("segment_id") == segment)
    return segments.withColumn("checkpoint", F.when(here, F.lit(position).cast("long")).otherwise(F.col("checkpoint")))


def registered(workers: DataFrame, consumer: str, worker: str, now: Column) -> DataFrame:
    """The worker's heartbeat is now."""
    one = workers.sparkSession.range(1).select(F.lit(consumer).alias("consumer_name"), F.lit(worker).alias("worker_id"), now.cast(workers.schema["last_heartbeat"].dataType).alias("last_heartbeat"))
    return deregistered(workers, consumer, worker).unionByName(one)


def deregistered(workers: DataFrame, consumer: str, worker: str) -> DataFrame:
    return workers.where(~(_mine(consumer) & (F.col("worker_id") == worker)))


def purged(workers: DataFrame, consumer: str, now: Column, stale_seconds: float) -> DataFrame:
    """Without the consumer's workers whose heartbeat is older than the threshold."""
    return workers.where(~_mine(consumer) | (F.col("last_heartbeat") >= now - F.expr(f"make_dt_interval(0, 0, 0, {stale_seconds})")))


def fair_shares(workers: DataFrame, total: int) -> DataFrame:
    """(consumer_name, worker_id, share): equal parts of ``total``, one more for the first workers by id."""
    rank = F.row_number().over(Window.partitionBy("consumer_name").orderBy("worker_id")) - 1
    n = F.count("*").over(Window.partitionBy("consumer_name"))
    return workers.select("consumer_name", "worker_id", (F.floor(F.lit(total) / n) + (rank < F.lit(total) % n).cast("int")).cast("long").alias("share"))


def excess(segments: DataFrame, consumer: str, worker: str, share: int) -> DataFrame:
    """Segments the worker owns beyond its share: the highest."""
    own = segments.where(_mine(consumer) & (F.col("owner_id") == worker))
    rank = F.row_number().over(Window.partitionBy("consumer_name").orderBy("segment_id"))
    return own.withColumn("__rank", rank).where(F.col("__rank") > share).select("consumer_name", "segment_id")


def rebalanced(segments: DataFrame, workers: DataFrame, consumer: str, worker: str, total: int, now: Column, stale_seconds: float) -> DataFrame:
    """One worker's turn: free the segments of dead workers, release what is beyond the share, claim up to it.

    The share counts active workers; a worker that isn't among them counts as the last.
    """
    free = reclaimed(segments, workers, consumer, now, stale_seconds)
    names = [r.worker_id for r in active(workers, consumer, now, stale_seconds).collect()]
    share = fair_share(worker, names, total)
    less = _owned_by(free, excess(free, consumer, worker, share), _free())
    held = less.where(_mine(consumer) & (F.col("owner_id") == worker)).count()
    return claimed(less, consumer, worker, share - held) if held < share else less


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], SEGMENT_SCHEMA), spark.createDataFrame([], WORKER_SCHEMA)
