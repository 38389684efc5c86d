import threading

import pytest
from pyspark.sql import functions as F

from tidelog.errors import ConsumerStoppedError, NoConsumersError, NoEventsError, OptimisticConcurrencyError, SegmentNotOwnedError
from tidelog.operators.values import AppendResult, ExpectedVersion
from tidelog.plans.scope import Scope
from tidelog.sources.log import init_store
from tidelog.streaming import source
from tidelog.streaming.consumer import ONE_OFF, Consumer, Worker, WorkerConfig

ANY, NEW = ExpectedVersion.any(), ExpectedVersion.no_stream()


def event(context="Test", kind="Thing", key="a", **more):
    return {"bounded_context": context, "aggregate_type": kind, "aggregate_id": key, "event_type": "Happened", "payload": '{"test": "data"}', **more}


@pytest.fixture
def log(spark, tmp_path):
    return init_store(spark, str(tmp_path / "store"))


def test_append_and_read(log):
    first = log.append(NEW, [event(event_type=f"Event{i}", metadata="", trace_id="t") for i in range(1, 5)])
    assert (first.from_version(), first.to_version(), first.global_positions) == (0, 4, [1, 2, 3, 4])
    second = log.append(ExpectedVersion.exact(4), [event()])
    assert (second.from_version(), second.to_version(), log.latest_position()) == (4, 5, 5)
    assert AppendResult().from_version() == AppendResult().to_version() == 0
    rows = log.read_events(1, 2).collect()
    assert [r.global_position for r in rows] == [2, 3] and rows[0].metadata is None and rows[0].trace_id == "t" and bytes(rows[0].payload) == b'{"test": "data"}'
    assert [r.global_position for r in log.read_events(3, 10).collect()] == [4, 5]
    stream = log.read_stream("Test", "Thing", "a", 2, 3)
    assert (len(stream), stream.version(), stream.is_empty()) == (2, 3, False)
    assert log.read_stream("Test", "Thing", "b").version() == 0
    assert [tuple(r)[:4] for r in log.heads().collect()] == [("Test", "Thing", "a", 5)]
    assert log.wait_beyond(4, 1) and not log.wait_beyond(5, 0.05, 0.01)


def test_expectations(log):
    with pytest.raises(NoEventsError):
        log.append(ANY, [])
    with pytest.raises(ValueError, match="^bounded context is required"):
        log.append(ANY, [event(context="")])
    with pytest.raises(ValueError, match="event 1: aggregate ID mismatch"):
        log.append(ANY, [event(), event(key="b")])
    with pytest.raises(OptimisticConcurrencyError):
        log.append(ExpectedVersion.exact(1), [event()])
    log.append(NEW, [event(event_id="same")])
    for expected in (NEW, ExpectedVersion.exact(0), ExpectedVersion.exact(2)):
        with pytest.raises(OptimisticConcurrencyError):
            log.append(expected, [event()])
    with pytest.raises(OptimisticConcurrencyError, match="event_id"):
        log.append(ANY, [event(key="other", event_id="same")])
    with pytest.raises(OptimisticConcurrencyError):
        log.append(ANY, [event(event_id="x"), event(event_id="x")])
    assert log.latest_position() == 1
    log.append(ANY, [event()])
    assert log.read_stream("Test", "Thing", "a").version() == 2
    log.append(NEW, [event(context="Other")])


def test_race(log):
    """Of writers that expect the same version one wins; any-appends all come through without gaps."""
    won, lost = [], []

    def write(expected, key):
        try:
            won.append(log.append(expected, [event(key=key)]))
        except OptimisticConcurrencyError as error:
            lost.append(error)

    threads = [threading.Thread(target=write, args=a) for a in [(NEW, "a")] * 3 + [(ANY, "b")] * 2]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 3 and len(lost) == 2
    assert sorted(r.global_position for r in log.events().collect()) == [1, 2, 3]


def test_scopes(log):
    for context, kind in (("Billing", "User"), ("Billing", "Order"), ("Identity", "User"), ("Catalog", "Product")):
        log.append(NEW, [event(context, kind, f"{context}-{kind}")])
    for scope, want in ((Scope(("Billing",)), [1, 2]), (Scope((), ("User",)), [1, 3]), (Scope(("Billing",), ("User",)), [1]), (Scope(("Billing", "Identity"), ("User", "Order")), [1, 2, 3]), (Scope(), [1, 2, 3, 4])):
        assert [r.global_position for r in log.read_events(0, 10, scope).collect()] == want


def _filled(log, n, keys):
    log.append_batch(log.spark.range(n).select(F.lit("Test").alias("bounded_context"), F.lit("Thing").alias("aggregate_type"), F.format_string("agg-%d", F.col("id") % keys).alias("aggregate_id"), F.format_string("e%d", "id").alias("event_id"), F.lit("Happened").alias("event_type"), F.lit(1).alias("event_version"), F.format_string('{"index": %d}', "id").cast("binary").alias("payload"), *(F.lit(None).cast("string").alias(c) for c in ("trace_id", "correlation_id", "causation_id", "metadata")), F.current_timestamp().alias("created_at"), F.col("id").alias("ordinal"), F.lit(-1).alias("expected_version")))


def test_one_off_exactly_once_and_resume(log):
    _filled(log, 20, 20)
    config = WorkerConfig(total_segments=4, batch_size=5, run_mode=ONE_OFF)

    def handle(events, models):
        models["seen"] = events.select("event_id", "global_position")

    assert Worker(log, config).run(Consumer("all", handle)) == {"all": 20}
    seen = log.model("seen").collect()
    assert len(seen) == 20 == len({r.event_id for r in seen})
    state = log.state()
    assert all(s[3] is None and s[4] == 20 for s in state.segments) and not state.workers
    assert Worker(log, config).run(Consumer("all", handle)) == {"all": 0}
    log.append(ANY, [event(key="late")])
    assert Worker(log, config).run(Consumer("all", handle)) == {"all": 1}


def test_failing_handler(log):
    _filled(log, 4, 2)

    def fail(events, models):
        raise RuntimeError("no luck")

    with pytest.raises(ConsumerStoppedError, match="no luck"):
        Worker(log, WorkerConfig(total_segments=1, run_mode=ONE_OFF)).run(Consumer("bad", fail))
    assert all(s[3] is None and s[4] == 0 for s in log.state().segments)
    with pytest.raises(NoConsumersError):
        Worker(log).run()
    with pytest.raises(SegmentNotOwnedError):
        Worker(log).batch(Consumer("bad", fail), 0)


def test_continuous_until_stopped(log):
    _filled(log, 3, 1)
    class Lines(list):
        debug = info = error = list.append

    lines = Lines()
    worker = Worker(log, WorkerConfig(total_segments=2, poll_interval=0.01, logger=lines))
    assert worker.run(Consumer("c", lambda events, models: worker.stop(), Scope(("Test",)))) == {"c": 3}
    assert any(x.startswith("batch handled consumer=c") and "events=3" in x for x in lines)


def test_streaming_source(log, spark, tmp_path):
    _filled(log, 7, 3)
    source.register(spark)
    got = []

    def run():
        q = spark.readStream.format("tidelog").option("path", log.path).load().writeStream.foreachBatch(lambda df, _: got.extend(r.global_position for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)

    run()
    assert sorted(got) == list(range(1, 8))
    log.append(ANY, [event(key="late")])
    run()
    assert sorted(got) == list(range(1, 9))
