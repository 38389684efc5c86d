"""What executors and their Python workers hold at once."""

import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import coder, mixing, textkit, tokens
from tidelog.llm.queries import vocabulary


def test_blocks_are_worked_on_in_groups_of_like_length(monkeypatch):
    """Few lanes at a time, with the bytes of all at once."""
    ids = np.random.default_rng(0).zipf(1.3, 8 * 3100) % 49408
    lanes, model = [], coder._Model

    def counted(n):
        lanes.append(n)
        return model(n)

    monkeypatch.setattr(coder, "_Model", counted)
    prior, frames = coder.compress(ids, 8)
    assert (coder.decompress(prior, b"".join(frames)) == ids).all()
    assert len(lanes) == 6 and min(lanes) >= 1033 and max(lanes) <= 1034
    monkeypatch.setattr(coder, "LANES", len(frames))
    assert coder.compress(ids, 8) == (prior, frames)


def test_short_batches_share_a_release(monkeypatch):
    seen = []
    monkeypatch.setattr(textkit, "release", lambda: seen.append("release"))
    batch = pa.record_batch([pa.array(range(100))], ["a"])
    for b in textkit.lean(iter([batch] * 5), 2 * batch.nbytes):
        seen.append(b.num_rows)
    assert seen == ["release", 100, 100, "release", 100, 100, "release", 100, "release"]


def test_ids_are_counted_bit_by_bit():
    ids = np.random.default_rng(0).integers(0, 49408, 4 << 20).astype(np.uint16)
    tracemalloc.start()
    try:
        prior = coder.Prior.of(ids)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 3 * ids.nbytes
    # the table's frequencies follow the ids' own
    assert (prior.ids == np.arange(49408)).all() and prior.frequencies.sum() == 1 << prior.bits


@pytest.fixture
def fresh(spark):
    """A session of its own, as the limit stays with a session."""
    return spark.newSession()


def largest_batches(df):
    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    return [tuple(r) for r in df.mapInArrow(work, "rows long, bytes long").collect()]


@pytest.mark.parametrize("stage", [corpus_pipeline.quality_rules, corpus_pipeline.near_dedup, corpus_pipeline.decontamination, corpus_pipeline.token_output])
def test_stages_hand_short_batches_to_python(fresh, sf_dir, stage):
    stage(fresh, textkit.table(fresh, sf_dir, "documents").limit(20), sf_dir)
    rows = largest_batches(fresh.range(0, 6000, 1, 1).selectExpr("repeat('a', 2000) AS text"))
    assert sum(n for n, _ in rows) == 6000 and max(b for _, b in rows) < 1.1 * textkit.HANDED_BYTES
    # a longer row goes whole, alone
    long = largest_batches(fresh.range(0, 3, 1, 1).selectExpr("repeat('a', 6000000) AS text"))
    assert [n for n, _ in long] == [1, 1, 1] and min(b for _, b in long) >= 6_000_000


def test_a_limit_of_the_session_stays(fresh):
    fresh.conf.set(textkit.HANDED, "1m")
    textkit.short_batches(fresh)
    assert fresh.conf.get(textkit.HANDED) == "1m"


def test_values_of_the_driver_need_no_python_workers(spark, sf_dir, tmp_path):
    docs = textkit.table(spark, sf_dir, "documents")
    tokens.write(docs, str(tmp_path / "t"), vocabulary())
    for df in (tokens.read(spark, str(tmp_path / "t"), ids=False), mixing.mixed(docs)):
        assert "ExistingRDD" not in df._jdf.queryExecution().toString()
    table = textkit.values(spark, a=pa.array([None, "x"], pa.string()), b=pa.array([1, 2], pa.int64()))
    assert table.collect() == [(None, 1), ("x", 2)]
    assert textkit.values(spark, a=pa.array([], pa.string())).count() == 0
