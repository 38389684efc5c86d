"""Several workers on one log, and what a log keeps through many appends."""

import datetime as dt
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidelog.errors import CommitConflict, ConsumerStoppedError, InvalidPartitionConfigError, SegmentNotOwnedError, is_transient
from tidelog.functions.hashing import in_segment
from tidelog.operators import segments
from tidelog.operators.values import ExpectedVersion
from tidelog.plans.scope import Scope
from tidelog.sources.commits import HINT, Commits, State
from tidelog.sources.log import StoreConfig, init_store
from tidelog.streaming import source
from tidelog.streaming.consumer import ONE_OFF, Consumer, Worker, WorkerConfig

ANY = ExpectedVersion.any()


def event(key="a", **more):
    return {"bounded_context": "Test", "aggregate_type": "Thing", "aggregate_id": key, "event_type": "Happened", "payload": "{}", **more}


@pytest.fixture
def log(spark, tmp_path):
    return init_store(spark, str(tmp_path / "store"))


def fill(log, n, keys=7, ids="format_string('e%d', id)"):
    rows = log.spark.range(n).select(F.lit("Test").alias("bounded_context"), F.lit("Thing").alias("aggregate_type"), F.format_string("agg-%d", F.col("id") % keys).alias("aggregate_id"), F.expr(ids).alias("event_id"), F.lit("Happened").alias("event_type"), F.lit(1).alias("event_version"), F.lit("{}").cast("binary").alias("payload"), *(F.lit(None).cast("string").alias(c) for c in ("trace_id", "correlation_id", "causation_id", "metadata")), F.current_timestamp().alias("created_at"), F.col("id").alias("ordinal"), F.lit(-1).alias("expected_version"))
    return log.append_batch(rows)


def owners(log, consumer="c"):
    return [s[3] for s in log.state().segments if s[0] == consumer]


def until(true, seconds=150.0):
    end = time.monotonic() + seconds
    while not true():
        assert time.monotonic() < end, "not in time"
        time.sleep(0.1)


class Running:
    def __init__(self, worker, consumer):
        self.worker, self.error = worker, None
        self.thread = threading.Thread(target=self._run, args=(consumer,), daemon=True)
        self.thread.start()

    def _run(self, consumer):
        try:
            self.worker.run(consumer)
        except ConsumerStoppedError as error:
            self.error = error

    def stop(self):
        self.worker.stop()
        self.thread.join(90)
        assert not self.thread.is_alive()


CONFIG = {"total_segments": 4, "heartbeat_interval": 0.3, "stale_threshold": 6.0, "rebalance_interval": 0.5, "poll_interval": 0.05, "max_poll_interval": 0.5}


def test_two_workers_share_and_hand_over(log):
    """The second takes its half of the first; each event is handled once; a stopped worker frees its segments for the other."""
    fill(log, 12)

    def handle(events, models):
        models["seen"] = events.select("event_id")

    one = Running(Worker(log, WorkerConfig(**CONFIG), "w1"), Consumer("c", handle))
    until(lambda: owners(log) == ["w1"] * 4)
    two = Running(Worker(log, WorkerConfig(**CONFIG), "w2"), Consumer("c", handle))
    until(lambda: sorted(filter(None, owners(log))) == ["w1", "w1", "w2", "w2"])
    log.append(ANY, [event("late")])
    until(lambda: all(s[4] == 13 for s in log.state().segments))
    one.stop()
    assert "w1" not in owners(log) and not any(w[1] == "w1" for w in log.state().workers)
    until(lambda: owners(log) == ["w2"] * 4)
    two.stop()
    assert one.error is two.error is None and owners(log) == [None] * 4 and not log.state().workers
    seen = [r.event_id for r in log.model("seen").collect()]
    assert len(seen) == 13 == len(set(seen))


def test_a_slow_handler_keeps_its_segments(log):
    """Heartbeats go on while a handler takes longer than the stale threshold."""
    fill(log, 2, 1)
    config = WorkerConfig(**{**CONFIG, "total_segments": 1, "stale_threshold": 3.0})
    busy = Running(Worker(log, config, "w1"), Consumer("c", lambda events, models: time.sleep(10)))
    until(lambda: owners(log) == ["w1"])
    other = Running(Worker(log, config, "w2"), Consumer("c", lambda events, models: None))
    until(lambda: log.state().segments[0][4] == 2)
    assert owners(log) == ["w1"]
    busy.stop()
    other.stop()
    assert busy.error is other.error is None


def test_crashed_worker_is_replaced(log):
    """Segments of a worker whose heartbeat is old go to the one that is there, with their checkpoints."""
    fill(log, 9)
    long_ago = F.lit(dt.datetime.now(dt.UTC) - dt.timedelta(seconds=60))
    log.transition(lambda s, w: (segments.claimed(segments.initialized(s, "c", 4), "c", "dead", 4).withColumn("checkpoint", F.lit(5).cast("long")), segments.registered(w, "c", "dead", long_ago)))
    got = []
    alive = Running(Worker(log, WorkerConfig(**CONFIG), "w2"), Consumer("c", lambda events, models: got.extend(r.global_position for r in events.select("global_position").collect())))
    until(lambda: all(s[4] == 9 for s in log.state().segments))
    alive.stop()
    assert sorted(got) == [6, 7, 8, 9] and alive.error is None


def test_worker_registers_again(log):
    fill(log, 1)
    one = Running(Worker(log, WorkerConfig(**{**CONFIG, "heartbeat_interval": 600.0, "rebalance_interval": 600.0, "health_audit_interval": 0.3}), "w1"), Consumer("c", lambda events, models: None))
    until(lambda: owners(log) == ["w1"] * 4)
    log.transition(lambda s, w: (s, segments.deregistered(w, "c", "w1")))
    until(lambda: [w[:2] for w in log.state().workers] == [("c", "w1")])
    one.stop()
    assert one.error is None


def test_worker_stops_when_a_segment_is_taken(log):
    fill(log, 1, 1)
    one = Running(Worker(log, WorkerConfig(**{**CONFIG, "rebalance_interval": 600.0}), "w1"), Consumer("c", lambda events, models: None))
    until(lambda: all(s[4] == 1 for s in log.state().segments) and owners(log) == ["w1"] * 4)
    log.transition(lambda s, w: (s.withColumn("owner_id", F.lit("thief")), w))
    log.append(ANY, [event()])
    one.thread.join(60)
    assert isinstance(one.error.__cause__, SegmentNotOwnedError) and owners(log) == ["thief"] * 4


def test_checkpoint_never_goes_back(log):
    """A batch whose segment went away and came back is not counted twice."""
    fill(log, 4, 1)
    worker = Worker(log, WorkerConfig(total_segments=1, batch_size=2), "w1")
    log.transition(lambda s, w: (segments.claimed(segments.initialized(s, "c", 1), "c", "w1"), w))

    def handle(events, models):
        models["seen"] = events.select("event_id")
        log.transition(lambda s, w: (segments.with_checkpoint(s, "c", 0, 4), w))  # another had it meanwhile

    with pytest.raises(SegmentNotOwnedError):
        worker.batch(Consumer("c", handle), 0)
    assert log.state().segments[0][4] == 4 and "seen" not in log.state().models


def test_lowered_total(log):
    """Segments beyond a lowered total are never claimed; one-off runs still read every event."""
    fill(log, 8)
    log.transition(lambda s, w: (segments.initialized(s, "c", 6), w))
    assert Worker(log, WorkerConfig(total_segments=3, run_mode=ONE_OFF)).run(Consumer("c", lambda events, models: None)) == {"c": 8}
    assert [s[4] for s in log.state().segments] == [8, 8, 8, 0, 0, 0] and {s[2] for s in log.state().segments} == {3}
    with pytest.raises(InvalidPartitionConfigError):
        in_segment(F.col("x"), 3, 3)


def test_wakeups_coalesce(log, spark):
    """Waiting segments wake at once when the log moves, far sooner than they would poll."""
    fill(log, 1, 1)
    config = WorkerConfig(**{**CONFIG, "total_segments": 1, "poll_interval": 500.0, "max_poll_interval": 500.0, "rebalance_interval": 600.0})
    one = Running(Worker(log, config, "w1"), Consumer("c", lambda events, models: None))
    until(lambda: [s[4] for s in log.state().segments] == [1])
    log.append(ANY, [event()])
    until(lambda: log.state().segments[0][4] == 2)
    one.stop()
    assert one.error is None


def test_transient_errors_are_tried_again(log):
    fill(log, 2, 1)
    tries = []

    def handle(events, models):
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError("gone")

    assert Worker(log, WorkerConfig(total_segments=1, run_mode=ONE_OFF, transient_retries=2)).run(Consumer("c", handle)) == {"c": 2}
    outer = RuntimeError("outer")
    outer.__cause__ = CommitConflict("inner")
    assert len(tries) == 3 and is_transient(outer) and not is_transient(ValueError("x"))


def test_drawn_ids_are_those_written(log):
    fill(log, 6, ids="uuid()")
    rows = log.events().collect()
    assert len({r.event_id for r in rows}) == 6 and not list((log_path := __import__("pathlib").Path(log.path) / "staging").glob("*")), log_path


def test_compaction(spark, tmp_path):
    """Many appends leave few folders, and the same events, heads and conflicts."""
    log = init_store(spark, str(tmp_path / "store"), StoreConfig(merge=3))
    for i in range(10):
        log.append(ANY, [event(f"k{i % 4}", event_id=f"e{i}")])
    state = log.state()
    assert len(state.events) <= 5 and state.events[0][1] == 1 and state.head == 10
    assert all(a[2] + 1 == b[1] for a, b in zip(state.events, state.events[1:], strict=False))
    assert [r.event_id for r in log.read_events(0, 100).collect()] == [f"e{i}" for i in range(10)]
    assert {r.aggregate_id: r.aggregate_version for r in log.heads().collect()} == {"k0": 3, "k1": 3, "k2": 2, "k3": 2}
    with pytest.raises(Exception, match="event_id"):
        log.append(ANY, [event("k0", event_id="e1")])
    assert log.read_stream("Test", "Thing", "k1").version() == 3
    assert log.vacuum(-60) > 0 and log.vacuum(-60) == 0
    assert log.events().count() == 10 and log.heads().count() == 4


def test_snapshots_and_hint(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidelog.sources.commits.SNAPSHOT", 4)
    commits = Commits(spark, str(tmp_path / "store"))
    commits.create()
    opened = []
    read = commits._read
    monkeypatch.setattr(commits, "_read", lambda name: opened.append(name) or read(name))
    state = State()
    for i in range(11):
        state = commits.commit(state, {"events": [(f"events/{i}", i + 1, i + 1)], "workers": [["c", "w", str(i)]]})
    commits.seen = None
    assert commits.latest() == state and len(opened) == 6  # the hint, a snapshot, three commits and the one that isn't there
    assert commits.latest() == state and len(opened) == 7
    with pytest.raises(CommitConflict):
        commits.commit(State(10, 10), {})
    commits.seen = None
    (tmp_path / "store" / "_commits" / HINT).unlink()
    assert commits.latest() == state


def test_batch_source(spark, log):
    source.register(spark)
    read = lambda **o: sorted(r.global_position for r in spark.read.format("tidelog").options(path=log.path, **o).load().collect())
    assert read() == []
    fill(log, 5, 2)
    log.append(ANY, [{**event("x"), "bounded_context": "Other"}])
    assert read() == [1, 2, 3, 4, 5, 6] and read(after="2", until="4") == [3, 4] and read(bounded_contexts="Other,None") == [6] and read(aggregate_types="Nothing") == []
    got = spark.read.format("tidelog").option("path", log.path).load().orderBy("global_position").collect()
    assert got == log.read_events(0, 10, Scope()).collect()
