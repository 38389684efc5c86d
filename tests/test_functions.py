import dataclasses

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog import schema
from tidelog.__main__ import main
from tidelog.errors import OptimisticConcurrencyError, PayloadError, UnknownEventError, is_unique_violation
from tidelog.functions import codec, hashing, pacing
from tidelog.operators.values import ExpectedVersion


def test_fnv_vectors(spark):
    known = {"": 0x811C9DC5, "a": 0xE40C292C, "foobar": 0xBF9CF968}
    texts = [*known, "agg-0", "é", "user@example.com"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.h for r in rows.select("t", hashing.fnv1a32_column(rows.t).alias("h")).collect()}
    assert got == {t: hashing.fnv1a32(t) for t in texts} and {t: got[t] for t in known} == known


def test_fair_share():
    for total, n, want in ((16, 3, [6, 5, 5]), (16, 5, [4, 3, 3, 3, 3]), (16, 17, [1] * 16 + [0]), (100, 7, [15, 15] + [14] * 5), (32, 5, [7, 7, 6, 6, 6]), (1, 10, [1] + [0] * 9)):
        names = [f"w{i:02d}" for i in range(n)]
        assert [pacing.fair_share(w, names[::-1], total) for w in names] == want
    assert pacing.fair_share("me", [], 16) == 16 and pacing.fair_share("zz", ["a", "b"], 16) == 5


@given(st.integers(1, 200), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_shares_add_up(total, n):
    names = [f"w{i:03d}" for i in range(n)]
    shares = [pacing.fair_share(w, names, total) for w in names]
    assert sum(shares) == total and max(shares) - min(shares) <= 1 and shares == sorted(shares, reverse=True)


def test_pacing_vectors():
    ms = lambda *a: round(1000 * pacing.post_batch_pause(*a), 6)
    assert [ms(0, 10, 10, 0.1), ms(0.01, 10, 10, 0.1), ms(0.08, 10, 10, 0.1), ms(0.02, 3, 10, 0.1), ms(0.005, 3, 10, 0.1)] == [5, 20, 100, 10, 0]
    assert pacing.post_batch_pause(0.01, 10, 10, 0.1, one_off=True) == 0
    assert [round(1000 * pacing.retry_delay(i)) for i in (0, 1, 2, 3, 4, 5, 8)] == [25, 50, 100, 200, 400, 500, 500]
    assert [pacing.audit_interval(*a) for a in ((0, 30), (7, 30), (-1, 30), (0, 0))] == [15, 7, 0, 0]
    assert [pacing.idle_poll(*a) for a in ((0.1, 0.1, 5, 2), (0.1, 4, 5, 2), (0.1, 0.3, 5, 1), (0, 1, 5, 2), (0.1, 1, 0, 2))] == [0.2, 5, 0.3, 0, 0.1]
    assert pacing.wakeup_jitter(100, 2, 7) == 103 % 7 and pacing.wakeup_jitter(1, 1, 0) == 0


def test_expected_version():
    assert [str(v) for v in (ExpectedVersion.any(), ExpectedVersion.no_stream(), ExpectedVersion.exact(3))] == ["Any", "NoStream", "Exact(3)"]
    assert ExpectedVersion.exact(0) == ExpectedVersion.no_stream() and ExpectedVersion.any().value == 0 and ExpectedVersion.exact(3).value == 3
    with pytest.raises(ValueError):
        ExpectedVersion.exact(-1)


@dataclasses.dataclass
class Ordered:
    order: str
    amount: float
    tags: list[str]
    note: str | None = None


def test_codec(spark):
    assert [codec.version_of(p) for p in ("a/v1/x", "a.v2.x", "v10/x", "a/x", "a/v3/b/v4", "a/v0/x")] == [1, 2, 10, 1, 3, 1]
    r = codec.Registry()
    r.add(Ordered, 2)
    rows = r.encode("Sales", "Order", "1", [Ordered("o", 1.5, ["x"])], correlation_id="c", metadata={"k": 1})
    assert rows[0]["event_version"] == 2 and rows[0]["metadata"] == '{"k": 1}' and r.event_type_of(Ordered) == "Ordered"
    assert r.decode_all(rows, Ordered) == [Ordered("o", 1.5, ["x"])]
    assert r.decode("Ordered", 2, "{}") == Ordered("", 0.0, [], None)
    for bad, error in ((("Nope", 1, "{}"), UnknownEventError), (("Ordered", 1, "{}"), UnknownEventError), (("Ordered", 2, "{"), PayloadError), (("Ordered", 2, "[]"), PayloadError)):
        with pytest.raises(error, match="event 1"):
            r.decode_all([rows[0], dict(zip(("event_type", "event_version", "payload"), bad, strict=True))])
    with pytest.raises(UnknownEventError):
        r.event_type_of(3)
    df = spark.createDataFrame([("Ordered", 2, '{"order": "q"}'), ("Other", 1, "not json")], "event_type string, event_version int, payload string")
    got = [x.o for x in df.select(r.column("Ordered", 2).alias("o")).collect()]
    assert got[0].order == "q" and got[0].amount == 0.0 and got[1] is None
    assert codec.struct_of(Ordered).simpleString() == "struct<order:string,amount:double,tags:array<string>,note:string>"


def test_errors_and_ddl(tmp_path, spark, capsys):
    assert is_unique_violation(OptimisticConcurrencyError("x")) and is_unique_violation(Exception("Duplicate key value")) and not is_unique_violation(ValueError("x")) and not is_unique_violation(None)
    out = tmp_path / "d" / "init.sql"
    assert main(["ddl", str(tmp_path / "t"), "-output", str(out)]) == 0
    assert oct(out.stat().st_mode)[-3:] == "600" and "consumer_checkpoints" not in out.read_text()
    for _ in range(2):
        for statement in out.read_text().split(";\n"):
            if statement.strip():
                spark.sql(statement)
    assert spark.table("aggregate_heads").columns == schema.HEAD_SCHEMA.names
    for t in ("events", "aggregate_heads", "consumer_segments", "consumer_workers"):
        spark.sql(f"DROP TABLE {t}")
