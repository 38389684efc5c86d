"""Contract queries of the event log, each with the same query in SQL."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.hashing import segment_of
from tidelog.operators import append, readmodels, scans, segments
from tidelog.plans.scope import Scope
from tidelog.schema import AGGREGATE, EVENT_INPUT_SCHEMA, SEGMENT_SCHEMA, WORKER_SCHEMA
from tidelog.sources.derived import activity_log, order_log
from tidelog.sources.log import EventLog, init_store
from tidelog.streaming.consumer import ONE_OFF, Consumer, Worker, WorkerConfig

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_LOG = """WITH placed AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS global_position,
  CASE event_type WHEN 'purchase' THEN 'Sales' WHEN 'error' THEN 'Ops' ELSE 'Identity' END AS bounded_context,
  CASE event_type WHEN 'purchase' THEN 'Order' WHEN 'error' THEN 'Incident' ELSE 'User' END AS aggregate_type,
  CAST(user_id AS VARCHAR) AS aggregate_id FROM events),
log AS (SELECT global_position, bounded_context, aggregate_type, aggregate_id,
  row_number() OVER (PARTITION BY bounded_context, aggregate_type, aggregate_id ORDER BY global_position) AS aggregate_version,
  CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(1 + event_id % 2 AS INTEGER) AS event_version, props AS payload,
  CAST(NULL AS VARCHAR) AS trace_id, CASE WHEN event_id % 3 <> 0 THEN 'corr-' || user_id END AS correlation_id,
  CAST(NULL AS VARCHAR) AS causation_id, CAST(NULL AS VARCHAR) AS metadata, ts AS created_at, value AS amount FROM placed)"""
_COLUMNS = "global_position, bounded_context, aggregate_type, aggregate_id, aggregate_version, event_id, event_type, event_version, payload, trace_id, correlation_id, causation_id, metadata, created_at"


def query(sql: str, log: bool = True) -> Callable:
    """Register a function under its name with its SQL; ``log`` puts the derived log before it."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = (_LOG + ("," if sql.lstrip().startswith("-- with") else "") if log else "") + "\n" + sql.replace("-- with", "", 1)
        return f

    return register


# --- reads


def _reads(name: str, where: str, after: int, limit: int, scope: Scope) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scans.read_events(activity_log(spark, sf_dir), after, limit, scope)

    f.__name__ = name
    query(f"SELECT {_COLUMNS} FROM log WHERE global_position > {after} {where} ORDER BY global_position LIMIT {limit}")(f)


_reads("read_events_from", "", 250, 100, Scope())
_reads("read_events_page2", "", 100, 100, Scope())
_reads("read_scope_context", "AND bounded_context IN ('Ops')", 0, 100, Scope(("Ops",)))
_reads("read_scope_type", "AND aggregate_type IN ('User')", 0, 100, Scope((), ("User",)))
_reads("read_scope_both", "AND bounded_context IN ('Sales') AND aggregate_type IN ('Order')", 0, 100, Scope(("Sales",), ("Order",)))
_reads("read_scope_multi", "AND bounded_context IN ('Sales', 'Ops') AND aggregate_type IN ('Order', 'Incident', 'User')", 50, 100, Scope(("Sales", "Ops"), ("Order", "Incident", "User")))
_reads("read_scope_none", "AND bounded_context IN ('Nowhere')", 0, 100, Scope(("Nowhere",)))


def _streams(name: str, where: str, aggregate: str, first: int | None, last: int | None) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scans.read_stream(activity_log(spark, sf_dir), "Identity", "User", aggregate, first, last).events

    f.__name__ = name
    query(f"SELECT {_COLUMNS} FROM log WHERE bounded_context = 'Identity' AND aggregate_type = 'User' AND aggregate_id = '{aggregate}' {where} ORDER BY aggregate_version")(f)


_streams("stream_full", "", "7", None, None)
_streams("stream_from", "AND aggregate_version >= 3", "7", 3, None)
_streams("stream_to", "AND aggregate_version <= 4", "7", None, 4)
_streams("stream_range", "AND aggregate_version BETWEEN 2 AND 6", "7", 2, 6)
_streams("stream_empty", "", "nobody", None, None)


@query("SELECT coalesce(max(aggregate_version), 0)::BIGINT AS version FROM log WHERE bounded_context = 'Identity' AND aggregate_type = 'User' AND aggregate_id = '7'")
def stream_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.read_stream(activity_log(spark, sf_dir), "Identity", "User", "7").events.agg(F.coalesce(F.max("aggregate_version"), F.lit(0).cast("long")).alias("version"))


@query("SELECT coalesce(max(global_position), 0)::BIGINT AS global_position FROM log")
def latest_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.latest_position(activity_log(spark, sf_dir))


@query("SELECT coalesce(max(global_position), 0)::BIGINT AS global_position FROM log WHERE bounded_context = 'Nowhere'")
def latest_position_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.latest_position(Scope(("Nowhere",)).apply(activity_log(spark, sf_dir)))


@query("SELECT bounded_context, aggregate_type, aggregate_id, max(aggregate_version) AS aggregate_version, max(created_at) AS updated_at FROM log GROUP BY ALL")
def aggregate_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append.heads_of(activity_log(spark, sf_dir))


# --- appends: the orders' customers as new events against the log's heads

_NEW = """new AS (SELECT CASE o_custkey % 2 WHEN 0 THEN 'Identity' ELSE 'Sales' END AS bounded_context, CASE o_custkey % 2 WHEN 0 THEN 'User' ELSE 'Order' END AS aggregate_type,
  CAST(o_custkey AS VARCHAR) AS aggregate_id, CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE 'n-' || o_orderkey END AS event_id, o_orderkey AS ordinal,
  CASE o_custkey % 3 WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE 2 END AS expected_version FROM orders),
heads AS (SELECT bounded_context, aggregate_type, aggregate_id, max(aggregate_version) AS head FROM log GROUP BY ALL)"""


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    even = F.col("o_custkey") % 2 == 0
    expected = F.when(F.col("o_custkey") % 3 == 0, -1).when(F.col("o_custkey") % 3 == 1, 0).otherwise(2)
    key = F.col("o_orderkey").cast("string")
    return o.select(F.when(even, "Identity").otherwise("Sales").alias("bounded_context"), F.when(even, "User").otherwise("Order").alias("aggregate_type"), F.col("o_custkey").cast("string").alias("aggregate_id"), F.when(F.col("o_orderkey") % 7 == 0, key).otherwise(F.concat(F.lit("n-"), key)).alias("event_id"), F.col("o_orderkey").alias("ordinal"), expected.alias("expected_version"))


@query("""-- with """ + _NEW + """
SELECT new.bounded_context, new.aggregate_type, new.aggregate_id, event_id, ordinal,
  coalesce(head, 0) + row_number() OVER (PARTITION BY new.bounded_context, new.aggregate_type, new.aggregate_id ORDER BY ordinal) AS aggregate_version
FROM new LEFT JOIN heads USING (bounded_context, aggregate_type, aggregate_id)""")
def append_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append.assigned(_incoming(spark, sf_dir), append.heads_of(activity_log(spark, sf_dir))).drop("expected_version")


@query("""-- with """ + _NEW + """
SELECT DISTINCT bounded_context, aggregate_type, aggregate_id, NULL::VARCHAR AS event_id, 'version' AS reason FROM new LEFT JOIN heads USING (bounded_context, aggregate_type, aggregate_id)
WHERE NOT CASE expected_version WHEN -1 THEN true WHEN 0 THEN head IS NULL ELSE coalesce(head = expected_version, false) END
UNION ALL
SELECT min(bounded_context), min(aggregate_type), min(aggregate_id), event_id, 'event_id' FROM new GROUP BY event_id HAVING count(*) > 1 OR event_id IN (SELECT event_id FROM log)""")
def append_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = activity_log(spark, sf_dir)
    return append.conflicts(_incoming(spark, sf_dir), append.heads_of(log), log)


@query("SELECT event_id, count(*) AS n FROM (SELECT event_id FROM log UNION ALL SELECT CAST(o_orderkey AS VARCHAR) FROM orders) GROUP BY event_id HAVING count(*) > 1")
def duplicate_event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = activity_log(spark, sf_dir).select("event_id").unionByName(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("event_id")))
    return both.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1")


# --- routing

_FNV = """CAST(list_reduce(list_transform(range(1, length(hex(encode(aggregate_id))) // 2 + 1), lambda i: ('0x' || substring(hex(encode(aggregate_id)), 2 * i - 1, 2))::BIGINT),
  lambda h, b: (xor(h, b) * 16777619) % 4294967296, 2166136261::BIGINT) % {n} AS INTEGER)"""


@query(f"SELECT DISTINCT aggregate_id, {_FNV.format(n=16)} AS segment FROM log")
def segment_of_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity_log(spark, sf_dir).select("aggregate_id").distinct().withColumn("segment", segment_of(F.col("aggregate_id"), 16))


@query(f"SELECT {_FNV.format(n=16)} AS segment, count(*) AS n_events FROM log GROUP BY 1")
def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity_log(spark, sf_dir).groupBy(segment_of(F.col("aggregate_id"), 16).alias("segment")).agg(F.count("*").alias("n_events"))


@query(f"SELECT count(*) AS n_events, count(*) FILTER (WHERE s BETWEEN 0 AND 3) AS n_routed, count(DISTINCT s) AS n_segments FROM (SELECT {_FNV.format(n=4)} AS s FROM log)")
def segment_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = activity_log(spark, sf_dir).select(segment_of(F.col("aggregate_id"), 4).alias("s"))
    return routed.agg(F.count("*").alias("n_events"), F.count_if(F.col("s").between(0, 3)).alias("n_routed"), F.countDistinct("s").alias("n_segments"))


# --- coordination, on small states given in place

_NOW = dt.datetime(2026, 1, 1, 12, 0, 0)
_SEGMENTS = [("orders", 0, 6, "w1", 40), ("orders", 1, 6, "w1", 55), ("orders", 2, 6, "w1", 12), ("orders", 3, 6, "w3", 70), ("orders", 4, 6, None, 0), ("orders", 5, 6, "ghost", 9), ("audit", 0, 2, None, 5), ("audit", 1, 2, "w2", 900)]
_WORKERS = [("orders", "w1", _NOW), ("orders", "w2", _NOW - dt.timedelta(seconds=30)), ("orders", "w3", _NOW - dt.timedelta(seconds=31)), ("audit", "w2", _NOW - dt.timedelta(seconds=5)), ("audit", "w9", _NOW - dt.timedelta(hours=1))]
_STALE = 30.0


def _literal(v: object) -> str:
    return "NULL" if v is None else f"TIMESTAMP '{v}'" if isinstance(v, dt.datetime) else f"'{v}'" if isinstance(v, str) else str(v)


def _values(name: str, columns: list[str], rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


_STATE = "WITH raw AS (WITH " + _values("t", SEGMENT_SCHEMA.names, _SEGMENTS) + " SELECT * FROM t), segments AS (SELECT consumer_name, segment_id::INTEGER AS segment_id, total_segments::INTEGER AS total_segments, owner_id, checkpoint::BIGINT AS checkpoint FROM raw), " + _values("workers", WORKER_SCHEMA.names, _WORKERS)
_LIMIT = f"(TIMESTAMP '{_NOW}' - INTERVAL 30 SECOND)"


def _state(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    workers = spark.createDataFrame(_WORKERS, "consumer_name string, worker_id string, last_heartbeat timestamp_ntz")
    return spark.createDataFrame(_SEGMENTS, SEGMENT_SCHEMA), workers


def _now() -> Column:
    return F.lit(str(_NOW)).cast("timestamp_ntz")


def _on_state(name: str, sql: str, f: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    def g(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(*_state(spark))

    g.__name__ = name
    query(f"{_STATE}\n{sql}", log=False)(g)


#: Three more states: nobody at work, one worker that holds everything, and a consumer whose total was lowered.
_MORE = {
    "idle": ([("orders", i, 5, None, 10 * i) for i in range(5)], [("orders", "w2", _NOW), ("orders", "w4", _NOW)]),
    "full": ([("orders", i, 7, "w1", i) for i in range(7)] + [("audit", 0, 1, "w2", 3)], [("orders", w, _NOW - dt.timedelta(seconds=i)) for i, w in enumerate(["w1", "w2", "w5"])]),
    "shrunk": ([("orders", i, 3, [None, "w2", None, "ghost", None][i], 4) for i in range(5)], [("orders", "w2", _NOW), ("audit", "w1", _NOW)]),
}
_STATES = {"first": (_SEGMENTS, _WORKERS), **_MORE}


def _on_states(name: str, sql: str, f: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Like _on_state, on all states; the SQL has their rows with the state's name."""

    def g(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = None
        for state, (s, w) in _STATES.items():
            rows = f(spark.createDataFrame(s, SEGMENT_SCHEMA), spark.createDataFrame(w, "consumer_name string, worker_id string, last_heartbeat timestamp_ntz")).withColumn("state", F.lit(state))
            out = rows if out is None else out.unionByName(rows)
        return out

    g.__name__ = name
    segments_, workers_ = ([(k, *r) for k, v in _STATES.items() for r in v[i]] for i in range(2))
    query(f"""WITH raw AS (WITH {_values("t", ["state", *SEGMENT_SCHEMA.names], segments_)} SELECT * FROM t),
segments AS (SELECT state, consumer_name, segment_id::INTEGER AS segment_id, total_segments::INTEGER AS total_segments, owner_id, checkpoint::BIGINT AS checkpoint FROM raw),
{_values("workers", ["state", *WORKER_SCHEMA.names], workers_)}{sql}""", log=False)(g)


_SET = "SELECT consumer_name, segment_id, total_segments, {owner} AS owner_id, {checkpoint} AS checkpoint FROM segments"
_on_state("init_segments", "SELECT consumer_name, segment_id, CASE consumer_name WHEN 'audit' THEN 4 ELSE total_segments END::INTEGER AS total_segments, owner_id, checkpoint FROM segments UNION ALL SELECT 'audit', i::INTEGER, 4::INTEGER, NULL, 0::BIGINT FROM range(4) r(i) WHERE i NOT IN (SELECT segment_id FROM segments WHERE consumer_name = 'audit')", lambda s, w: segments.initialized(s, "audit", 4))
_on_state("segments_of_consumer", "SELECT * FROM segments WHERE consumer_name = 'orders' ORDER BY segment_id", lambda s, w: segments.of_consumer(s, "orders"))
_on_states("claim_segment", """,
free AS (SELECT state, min(segment_id) AS segment_id FROM segments WHERE consumer_name = 'orders' AND owner_id IS NULL AND segment_id < total_segments GROUP BY state)
SELECT s.state, consumer_name, s.segment_id, total_segments, CASE WHEN consumer_name = 'orders' AND f.segment_id = s.segment_id THEN 'w2' ELSE owner_id END AS owner_id, checkpoint FROM segments s LEFT JOIN free f USING (state)""", lambda s, w: segments.claimed(s, "orders", "w2"))
_on_state("release_segment", _SET.format(owner="CASE WHEN consumer_name = 'orders' AND segment_id = 1 AND owner_id = 'w1' THEN NULL ELSE owner_id END", checkpoint="checkpoint"), lambda s, w: segments.released(s, "orders", 1, "w1"))
_on_state("release_not_owned", "SELECT * FROM segments", lambda s, w: segments.released(s, "orders", 1, "w2"))
_on_state("reclaim_stale", _SET.format(owner=f"CASE WHEN consumer_name = 'orders' AND owner_id NOT IN (SELECT worker_id FROM workers WHERE consumer_name = 'orders' AND last_heartbeat >= {_LIMIT}) THEN NULL ELSE owner_id END", checkpoint="checkpoint"), lambda s, w: segments.reclaimed(s, w, "orders", _now(), _STALE))
_on_state("reclaim_count", f"SELECT count(*) AS n FROM segments WHERE consumer_name = 'orders' AND owner_id NOT IN (SELECT worker_id FROM workers WHERE consumer_name = 'orders' AND last_heartbeat >= {_LIMIT})", lambda s, w: segments.stale_segments(s, w, "orders", _now(), _STALE).agg(F.count("*").alias("n")))
_on_state("set_checkpoint", _SET.format(owner="owner_id", checkpoint="CASE WHEN consumer_name = 'orders' AND segment_id = 2 THEN 99 ELSE checkpoint END::BIGINT"), lambda s, w: segments.with_checkpoint(s, "orders", 2, 99))
_on_state("owned_checkpoint", _SET.format(owner="owner_id", checkpoint="CASE WHEN consumer_name = 'orders' AND segment_id = 3 THEN 71 ELSE checkpoint END::BIGINT"), lambda s, w: segments.with_checkpoint(s, "orders", 3, 71, "w3"))
_on_state("checkpoint_missing", "SELECT coalesce(max(checkpoint), 0)::BIGINT AS checkpoint FROM segments WHERE consumer_name = 'orders' AND segment_id = 77", lambda s, w: segments.checkpoint_of(s, "orders", 77))
_on_state("active_workers", f"SELECT * FROM workers WHERE consumer_name = 'orders' AND last_heartbeat >= {_LIMIT} ORDER BY worker_id", lambda s, w: segments.active(w, "orders", _now(), _STALE))
_on_state("count_active", f"SELECT count(*) AS n FROM workers WHERE consumer_name = 'orders' AND last_heartbeat >= {_LIMIT}", lambda s, w: segments.active(w, "orders", _now(), _STALE).agg(F.count("*").alias("n")))
_on_state("is_worker_active", f"SELECT worker_id, EXISTS (SELECT 1 FROM workers a WHERE a.consumer_name = 'orders' AND a.worker_id = w.worker_id AND a.last_heartbeat >= {_LIMIT}) AS alive FROM (SELECT DISTINCT worker_id FROM workers) w", lambda s, w: w.select("worker_id").distinct().join(segments.active(w, "orders", _now(), _STALE).select("worker_id", F.lit(True).alias("alive")), "worker_id", "left").select("worker_id", F.coalesce("alive", F.lit(False)).alias("alive")))
_on_state("register_worker", f"SELECT * FROM workers WHERE NOT (consumer_name = 'orders' AND worker_id = 'w3') UNION ALL SELECT 'orders', 'w3', TIMESTAMP '{_NOW}'", lambda s, w: segments.registered(w, "orders", "w3", _now()))
_on_state("deregister_worker", "SELECT * FROM workers WHERE NOT (consumer_name = 'orders' AND worker_id = 'w3')", lambda s, w: segments.deregistered(w, "orders", "w3"))
_on_state("purge_stale_workers", f"SELECT * FROM workers WHERE NOT (consumer_name = 'orders' AND last_heartbeat < {_LIMIT})", lambda s, w: segments.purged(w, "orders", _now(), _STALE))
_on_state("fair_share", "SELECT consumer_name, worker_id, (16 // n + CASE WHEN r < 16 % n THEN 1 ELSE 0 END)::BIGINT AS share FROM (SELECT *, row_number() OVER (PARTITION BY consumer_name ORDER BY worker_id) - 1 AS r, count(*) OVER (PARTITION BY consumer_name) AS n FROM workers)", lambda s, w: segments.fair_shares(w, 16))
_on_state("release_excess", "SELECT consumer_name, segment_id FROM (SELECT *, row_number() OVER (ORDER BY segment_id) AS r FROM segments WHERE consumer_name = 'orders' AND owner_id = 'w1') WHERE r > 2", lambda s, w: segments.excess(s, "orders", "w1", 2))
_on_state("claim_available", "SELECT consumer_name, segment_id FROM segments WHERE owner_id IS NULL AND consumer_name = 'orders' AND segment_id < total_segments ORDER BY segment_id LIMIT 3", lambda s, w: segments.next_free(s, "orders", 3))
_on_states("rebalance", f""",
alive AS (SELECT state, worker_id, row_number() OVER (PARTITION BY state ORDER BY worker_id) - 1 AS place, count(*) OVER (PARTITION BY state) AS n FROM workers WHERE consumer_name = 'orders' AND last_heartbeat >= {_LIMIT}),
share AS (SELECT state, 6 // n + CASE WHEN place < 6 % n THEN 1 ELSE 0 END AS share FROM alive WHERE worker_id = 'w2'),
held AS (SELECT s.*, CASE WHEN consumer_name <> 'orders' OR EXISTS (SELECT 1 FROM alive a WHERE a.state = s.state AND a.worker_id = s.owner_id) THEN owner_id END AS held_by FROM segments s),
mine AS (SELECT *, CASE WHEN consumer_name = 'orders' AND held_by = 'w2' AND row_number() OVER (PARTITION BY state, consumer_name, held_by ORDER BY segment_id) > share THEN NULL ELSE held_by END AS left_by FROM held LEFT JOIN share USING (state)),
counted AS (SELECT *, count(*) FILTER (WHERE consumer_name = 'orders' AND left_by = 'w2') OVER (PARTITION BY state) AS n_held,
  sum(CASE WHEN consumer_name = 'orders' AND left_by IS NULL AND segment_id < total_segments THEN 1 ELSE 0 END) OVER (PARTITION BY state ORDER BY consumer_name = 'orders', segment_id ROWS UNBOUNDED PRECEDING) AS nth_free FROM mine)
SELECT state, consumer_name, segment_id, total_segments, CASE WHEN consumer_name = 'orders' AND left_by IS NULL AND segment_id < total_segments AND nth_free <= share - n_held THEN 'w2' ELSE left_by END AS owner_id, checkpoint FROM counted""", lambda s, w: segments.rebalanced(s, w, "orders", "w2", 6, _now(), _STALE))
_on_state("owned_per_worker", "SELECT owner_id, count(*) AS n FROM segments WHERE owner_id IS NOT NULL AND consumer_name = 'orders' GROUP BY owner_id", lambda s, w: s.where("owner_id IS NOT NULL AND consumer_name = 'orders'").groupBy("owner_id").agg(F.count("*").alias("n")))


def _status(columns: str, *names: str) -> str:
    return _LOG + ", " + _STATE[len("WITH ") :] + f""", lag AS (SELECT consumer_name, min(checkpoint) AS checkpoint, (SELECT coalesce(max(global_position), 0) FROM log) AS head FROM segments GROUP BY consumer_name)
SELECT consumer_name, {columns} FROM lag"""


def _statuses(name: str, columns: str, *keep: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return readmodels.status(_state(spark)[0], activity_log(spark, sf_dir)).select("consumer_name", *keep)

    f.__name__ = name
    query(_status(columns), log=False)(f)


_statuses("lag_by_consumer", "checkpoint, head - checkpoint AS lag", "checkpoint", "lag")
_statuses("status_pct", "CASE WHEN checkpoint = 0 THEN 'NOT_STARTED' WHEN checkpoint >= head THEN 'CAUGHT_UP' ELSE 'BEHIND' END AS state, CASE WHEN head = 0 THEN 100.0 ELSE round(100.0 * checkpoint / head, 2) END::DOUBLE AS percent", "state", "percent")

_CHECKPOINTS = [("old", 10**12, _NOW - dt.timedelta(minutes=6)), ("edge", 7, _NOW - dt.timedelta(minutes=5)), ("done", 10**12, _NOW), ("busy", 3, _NOW - dt.timedelta(seconds=1))]


@query("-- with " + _values("checkpoints", ["consumer_name", "checkpoint", "updated_at"], _CHECKPOINTS) + f"""
SELECT consumer_name, checkpoint::BIGINT AS checkpoint, updated_at, CASE WHEN updated_at < TIMESTAMP '{_NOW}' - INTERVAL 5 MINUTE THEN 'STALE' WHEN checkpoint >= (SELECT max(global_position) FROM log) THEN 'CAUGHT_UP' ELSE 'PROCESSING' END AS health FROM checkpoints""")
def health_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoints = spark.createDataFrame(_CHECKPOINTS, "consumer_name string, checkpoint long, updated_at timestamp_ntz")
    return readmodels.health(checkpoints, activity_log(spark, sf_dir), _now())


@query(f"SELECT {_COLUMNS} FROM log WHERE correlation_id = 'corr-7' ORDER BY global_position")
def correlated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.caused_by(activity_log(spark, sf_dir), correlation="corr-7").drop("amount")


# --- read models


@query("SELECT global_position, CAST(json_extract_string(payload, '$.k') AS VARCHAR) AS k FROM log WHERE event_type = 'signup' ORDER BY global_position")
def user_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.listed(activity_log(spark, sf_dir), "signup", "k")


@query("SELECT count(*) AS n_events FROM log WHERE bounded_context = 'Identity' AND aggregate_type = 'User'")
def user_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.counted(activity_log(spark, sf_dir), Scope(("Identity",), ("User",)))


@query("SELECT count(*) AS n_events, coalesce(sum(round(amount, 2)::DECIMAL(18, 2)), 0)::DOUBLE AS revenue FROM log WHERE bounded_context = 'Sales' AND aggregate_type = 'Order'")
def order_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.counted(activity_log(spark, sf_dir), Scope(("Sales",), ("Order",)), F.col("amount"))


@query("SELECT count(*) AS n_events, coalesce(sum(round(o_totalprice, 2)::DECIMAL(18, 2)), 0)::DOUBLE AS revenue FROM orders", log=False)
def placed_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.counted(order_log(spark, sf_dir), Scope(("Sales",), ("Order",)), F.col("amount"))


@query("SELECT bounded_context, aggregate_type, event_type, count(*) AS n_events FROM log GROUP BY ALL")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.audited(activity_log(spark, sf_dir))


@query("SELECT event_type, count(*) FILTER (WHERE event_version = 1) AS v1, count(*) FILTER (WHERE event_version = 2) AS v2, count(*) FILTER (WHERE event_version NOT IN (1, 2)) AS unknown FROM log GROUP BY ALL")
def decoded_v1_v2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.by_version(activity_log(spark, sf_dir))


@query("SELECT event_type, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k, count(*) AS n FROM log GROUP BY ALL")
def decoded_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.decoded(activity_log(spark, sf_dir), "k bigint").groupBy("event_type", F.col("data.k").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT event_type, event_version, count(*) AS n FROM log WHERE NOT (event_type = 'signup' AND event_version = 1) AND event_type <> 'view' GROUP BY ALL")
def unknown_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = (F.col("event_type") == "view") | ((F.col("event_type") == "signup") & (F.col("event_version") == 1))
    return activity_log(spark, sf_dir).where(~known).groupBy("event_type", "event_version").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_events, coalesce(max(global_position), 0)::BIGINT AS last_position, arg_max(created_at, global_position) AS last_at FROM log")
def last_event_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.last_event(activity_log(spark, sf_dir))


@query("SELECT count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'error') AS n_error FROM log")
def typed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity_log(spark, sf_dir).agg(*(F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in ("click", "error")))


@query(f"SELECT {_COLUMNS} FROM log QUALIFY row_number() OVER (PARTITION BY bounded_context, aggregate_type, aggregate_id ORDER BY global_position DESC) = 1")
def upsert_read_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.latest(activity_log(spark, sf_dir), *AGGREGATE).drop("amount")


@query("SELECT event_id, min(global_position) AS global_position FROM (SELECT event_id, global_position FROM log UNION ALL SELECT event_id, global_position + 1000000 FROM log WHERE aggregate_version = 1) GROUP BY event_id")
def dedupe_event_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = activity_log(spark, sf_dir).select("event_id", "global_position", "aggregate_version")
    again = log.where("aggregate_version = 1").withColumn("global_position", F.col("global_position") + 1000000)
    return readmodels.once(log.unionByName(again)).select("event_id", "global_position")


# --- consumption: the log as a store, read by a worker of 4 segments that is scoped to one context


def _stored(spark: SparkSession, sf_dir: str) -> EventLog:
    """The derived log appended to a new store in the shared folder, in one batch."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="tidelog-")
    log = init_store(spark, f"{root.rstrip('/')}/store-{uuid.uuid4().hex}")
    rows = activity_log(spark, sf_dir)
    log.append_batch(rows.select(*EVENT_INPUT_SCHEMA.names, F.col("global_position").alias("ordinal"), F.lit(-1).alias("expected_version")).withColumn("payload", F.col("payload").cast("binary")))
    return log


_SCOPE = Scope(("Identity",))


def _consumed(log: EventLog) -> tuple[Consumer, Worker]:
    def handle(events: DataFrame, models: dict[str, DataFrame]) -> None:
        models["seen"] = events.select("global_position", segment_of(F.col("aggregate_id"), 4).alias("segment"))

    worker = Worker(log, WorkerConfig(total_segments=4, batch_size=1_000_000, run_mode=ONE_OFF))
    return Consumer("identity", handle, _SCOPE), worker


@query(f"SELECT s.segment::INTEGER AS segment, coalesce(n_processed, 0)::BIGINT AS n_processed, (SELECT max(global_position) FROM log)::BIGINT AS checkpoint FROM range(4) s(segment) LEFT JOIN (SELECT {_FNV.format(n=4)} AS segment, count(*) AS n_processed FROM log WHERE bounded_context = 'Identity' GROUP BY 1) USING (segment)")
def oneoff_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A worker runs once: what its handler put into a read model, and the checkpoints it left, at the log's head."""
    log = _stored(spark, sf_dir)
    consumer, worker = _consumed(log)
    worker.run(consumer)
    seen = log.model("seen").groupBy("segment").agg(F.count("*").alias("n_processed"))
    return log.segments().select(F.col("segment_id").alias("segment"), "checkpoint").join(seen, "segment", "left").select("segment", F.coalesce("n_processed", F.lit(0).cast("long")).alias("n_processed"), "checkpoint")


@query(f"SELECT global_position, {_FNV.format(n=4)} AS segment FROM log WHERE global_position > 120 AND bounded_context = 'Identity'")
def resume_from_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A worker finds checkpoints at 120 and handles what comes after, once."""
    log = _stored(spark, sf_dir)
    consumer, worker = _consumed(log)
    log.transition(lambda s, w: (segments.initialized(s, consumer.name, 4).withColumn("checkpoint", F.lit(120).cast("long")), w))
    worker.run(consumer)
    return log.model("seen")


def _store_reads(name: str, sql: str, f: Callable[[EventLog], DataFrame]) -> None:
    def g(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = f(_stored(spark, sf_dir))
        # payloads are bytes in the store
        return rows.withColumn("payload", F.col("payload").cast("string")) if "payload" in rows.columns else rows

    g.__name__ = name
    query(sql)(g)


_store_reads("store_events_from", f"SELECT {_COLUMNS} FROM log WHERE global_position > 250 AND bounded_context IN ('Sales', 'Ops') ORDER BY global_position LIMIT 100", lambda log: log.read_events(250, 100, Scope(("Sales", "Ops"))))
_store_reads("store_stream", f"SELECT {_COLUMNS} FROM log WHERE bounded_context = 'Identity' AND aggregate_type = 'User' AND aggregate_id = '7' AND aggregate_version >= 2 ORDER BY aggregate_version", lambda log: log.read_stream("Identity", "User", "7", 2).events)
_store_reads("store_heads", "SELECT bounded_context, aggregate_type, aggregate_id, max(aggregate_version) AS aggregate_version, max(created_at) AS updated_at FROM log GROUP BY ALL", lambda log: log.heads())
