"""Consumers: named handlers of batches, with checkpoints that move in the same commit as their read models."""

from __future__ import annotations

import datetime as dt
import math
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.errors import ConsumerStoppedError, NoConsumersError, SegmentNotOwnedError, is_transient
from tidelog.functions import pacing
from tidelog.functions.hashing import in_segment
from tidelog.functions.notes import note
from tidelog.operators import scans, segments
from tidelog.plans.scope import Scope
from tidelog.sources.log import EventLog

CONTINUOUS, ONE_OFF = "continuous", "one-off"


@dataclass
class Consumer:
    """``handle(events, models)`` gets a batch in order and may put rows for read models into ``models`` by name."""

    name: str
    handle: Callable[[DataFrame, dict[str, DataFrame]], None]
    scope: Scope = field(default_factory=Scope)


@dataclass(frozen=True)
class WorkerConfig:
    """Durations in seconds."""

    total_segments: int = 16
    heartbeat_interval: float = 5.0
    stale_threshold: float = 30.0
    rebalance_interval: float = 10.0
    batch_size: int = 100
    poll_interval: float = 0.1
    max_poll_interval: float = 5.0
    max_post_batch_pause: float = 0.1
    transient_retries: int = 0
    health_audit_interval: float = 0.0
    poll_backoff_factor: float = 2.0
    wakeup_jitter: float = 0.025
    #: Between looks at the log's head that wake waiting segments; 0 leaves them to poll.
    dispatch_interval: float = 0.2
    run_mode: str = CONTINUOUS
    partition: Callable[[Column, int, int], Column] = in_segment
    logger: object = None


class Worker:
    """Runs consumers until stopped, or once until caught up.

    On the driver a consumer has a thread that claims and frees segments, one that sends heartbeats
    however long a handler takes, and one for each segment it owns; data stays in Spark.
    """

    def __init__(self, log: EventLog, config: WorkerConfig | None = None, worker_id: str | None = None):
        self.log, self.config, self.id = log, config or WorkerConfig(), worker_id or str(uuid.uuid4())
        self.stopping = threading.Event()

    def stop(self) -> None:
        """End after the batches that run; segments are freed and the worker is taken off the registry."""
        self.stopping.set()

    def run(self, *consumers: Consumer) -> dict[str, int]:
        """Events handled by consumer. The first error stops all and is raised as ConsumerStoppedError."""
        if not consumers:
            raise NoConsumersError("at least one consumer is required")
        for i, c in enumerate(consumers):
            if c is None:
                raise ValueError(f"consumer at index {i} is None")
        errors: list[tuple[str, BaseException]] = []
        runs = [_Run(self, c) for c in consumers]

        def body(run: _Run) -> None:
            try:
                run.consume()
            except BaseException as error:
                note(self.config.logger, "error", "consumer stopped", consumer=run.consumer.name, error=error)
                errors.append((run.consumer.name, error))
                self.stopping.set()

        wakeup = threading.Thread(target=self._watch, args=(runs,), daemon=True)
        threads = [threading.Thread(target=body, args=(r,), daemon=True) for r in runs]
        for t in (wakeup, *threads):
            t.start()
        for t in threads:
            t.join()
        self.stopping.set()
        wakeup.join()
        if errors:
            name, error = errors[0]
            raise ConsumerStoppedError(f"consumer {name!r} failed: {error}") from error
        return {r.consumer.name: r.handled for r in runs}

    def _watch(self, runs: list[_Run]) -> None:
        """Wake segments that wait when the log has moved on: one poll for all of them, and one signal however often it moved."""
        seen, cfg = 0, self.config
        while cfg.dispatch_interval > 0 and not self.stopping.wait(cfg.dispatch_interval):
            try:
                head = self.log.latest_position()
            except Exception as error:  # a hint only: segments poll as well
                note(cfg.logger, "error", "the log's head can't be read", error=error)
                continue
            if head > seen:
                seen = head
                for r in runs:
                    r.wake()

    def batch(self, c: Consumer, segment: int) -> int:
        """One batch of a segment: read past the checkpoint, handle, and commit models and checkpoint together.

        The segment and the scope filter before the limit, so a batch is full of events that count. A
        batch that isn't full moves the checkpoint to the log's head, so the lag of a scoped consumer
        can reach zero. Events between that are of other segments or out of scope count as skipped.
        """
        cfg, log = self.config, self.log
        state = log.state()
        row = next((r for r in state.segments if r[:2] == (c.name, segment) and r[3] == self.id), None)
        if row is None:
            raise SegmentNotOwnedError(f"segment {segment} of {c.name} isn't owned by {self.id}")
        at = row[4]
        if at >= state.head:
            return 0
        rows = log._events(state, at, state.head).where((F.col("global_position") <= state.head) & cfg.partition(F.col("aggregate_id"), segment, cfg.total_segments))
        events = scans.read_events(rows, at, cfg.batch_size, c.scope).persist()
        try:
            n, last = events.agg(F.count("*"), F.max("global_position")).first()
            models: dict[str, DataFrame] = {}
            if n:
                c.handle(events, models)
            to = last if n == cfg.batch_size else state.head
            log.advance(c.name, segment, self.id, at, to, models)
        finally:
            events.unpersist()
        note(cfg.logger, "debug", "batch handled", consumer=c.name, segment=segment, events=n, skipped=to - at - n, checkpoint=to)
        return n


class _Run:
    """One consumer of one worker."""

    def __init__(self, worker: Worker, consumer: Consumer):
        self.worker, self.consumer, self.log, self.config = worker, consumer, worker.log, worker.config
        self.handled = 0
        self.lock = threading.Lock()
        self.done = threading.Event()
        self.error: BaseException | None = None
        #: By segment: its thread, its signal to end, and its signal to look for events.
        self.segments: dict[int, tuple[threading.Thread, threading.Event, threading.Event]] = {}

    def wake(self) -> None:
        with self.lock:
            for _, _, awake in self.segments.values():
                awake.set()

    def consume(self) -> None:
        cfg, name, me = self.config, self.consumer.name, self.worker.id
        one_off = cfg.run_mode == ONE_OFF
        self.log.transition(lambda s, w: (segments.initialized(s, name, cfg.total_segments), segments.registered(w, name, me, F.current_timestamp())))
        pulse = threading.Thread(target=self._beat, daemon=True)
        pulse.start()
        try:
            while not self._ended():
                state = self.log.transition(self._balanced)
                owned = {r[1] for r in state.segments if r[0] == name and r[3] == me}
                self._follow(owned)
                if one_off:  # each thread ends when its segment is caught up
                    for t, _, _ in list(self.segments.values()):
                        t.join()
                    break
                end = time.monotonic() + cfg.rebalance_interval
                while not self._ended() and time.monotonic() < end:
                    self.worker.stopping.wait(min(0.05, cfg.rebalance_interval))
        finally:
            self._follow(set())
            self.done.set()
            pulse.join()
            self.log.transition(lambda s, w: (self._freed(s, None), segments.deregistered(w, name, me)))
        if self.error:
            raise self.error

    def _ended(self) -> bool:
        return self.worker.stopping.is_set() or self.error is not None

    def _balanced(self, s: DataFrame, w: DataFrame) -> tuple[DataFrame, DataFrame]:
        # the time of the state that was read, not that of the jobs to come
        cfg, name, me, now = self.config, self.consumer.name, self.worker.id, F.lit(dt.datetime.now(dt.UTC))
        if cfg.run_mode == ONE_OFF:  # all that is free, whatever the share
            return segments.claimed(s, name, me, cfg.total_segments), w
        w = segments.purged(segments.registered(w, name, me, now), name, now, cfg.stale_threshold)
        after = segments.rebalanced(s, w, name, me, cfg.total_segments, now, cfg.stale_threshold)
        return after, w

    def _freed(self, s: DataFrame, only: set[int] | None) -> DataFrame:
        own = (F.col("consumer_name") == self.consumer.name) & (F.col("owner_id") == self.worker.id)
        if only is not None:
            own &= F.col("segment_id").isin(sorted(only))
        return s.withColumn("owner_id", F.when(own, F.lit(None).cast("string")).otherwise(F.col("owner_id")))

    def _follow(self, owned: set[int]) -> None:
        """Have a thread for each owned segment and none for others. One whose segment went ends by itself at its next commit."""
        with self.lock:
            gone = {k: v for k, v in self.segments.items() if k not in owned}
            for k in gone:
                del self.segments[k]
            for _, ending, awake in gone.values():
                ending.set()
                awake.set()
        for t, _, _ in gone.values():
            t.join()
        for k in sorted(owned - set(self.segments)):
            ending, awake = threading.Event(), threading.Event()
            t = threading.Thread(target=self._segment, args=(k, ending, awake), daemon=True)
            with self.lock:
                self.segments[k] = (t, ending, awake)
            t.start()

    def _beat(self) -> None:
        """Heartbeats, and audits that find the worker purged and register it again."""
        cfg, name, me = self.config, self.consumer.name, self.worker.id
        audit = pacing.audit_interval(cfg.health_audit_interval, cfg.stale_threshold)
        next_beat, next_audit = time.monotonic() + cfg.heartbeat_interval, time.monotonic() + (audit or math.inf)
        while not self.done.wait(max(0.0, min(next_beat, next_audit) - time.monotonic())):
            try:
                if time.monotonic() >= next_audit:
                    next_audit = time.monotonic() + audit
                    if not any(w[:2] == (name, me) for w in self.log.state().workers):
                        note(cfg.logger, "error", "worker was purged and registers again", consumer=name, worker=me)
                        self.log.beat(name, me)
                if time.monotonic() >= next_beat:
                    next_beat = time.monotonic() + cfg.heartbeat_interval
                    self.log.beat(name, me)
            except Exception as error:
                note(cfg.logger, "error", "heartbeat failed", consumer=name, worker=me, error=error)

    def _segment(self, segment: int, ending: threading.Event, awake: threading.Event) -> None:
        """Batches of a segment until it ends, or in a one-off run until it is caught up."""
        cfg = self.config
        poll, pause = cfg.poll_interval, 0.0
        try:
            while not (ending.is_set() or self._ended()):
                awake.clear()
                n = self._with_retries(segment)
                with self.lock:
                    self.handled += n
                if n:
                    poll, pause = cfg.poll_interval, pacing.post_batch_pause(pause, n, cfg.batch_size, cfg.max_post_batch_pause, cfg.run_mode == ONE_OFF)
                    ending.wait(pause)
                elif cfg.run_mode == ONE_OFF:
                    return
                else:
                    awake.wait(poll)
                    if not ending.is_set():
                        ending.wait(pacing.wakeup_jitter(time.time_ns(), segment, int(cfg.wakeup_jitter * 1e9)) / 1e9)
                    poll = pacing.idle_poll(cfg.poll_interval, poll, cfg.max_poll_interval, cfg.poll_backoff_factor)
        except SegmentNotOwnedError as error:
            if not ending.is_set():  # taken away, and not by this worker
                self.error = self.error or error
        except BaseException as error:
            self.error = self.error or error

    def _with_retries(self, segment: int) -> int:
        for attempt in range(self.config.transient_retries + 1):
            try:
                return self.worker.batch(self.consumer, segment)
            except Exception as error:
                if attempt == self.config.transient_retries or not is_transient(error):
                    raise
                note(self.config.logger, "info", "batch is tried again", consumer=self.consumer.name, segment=segment, attempt=attempt, error=error)
                self.worker.stopping.wait(pacing.retry_delay(attempt))
        return 0
