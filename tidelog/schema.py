"""Row types of the log's tables, and their DDL as text."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()

#: What a caller gives to an append.
EVENT_INPUT_SCHEMA = T.StructType([
    T.StructField("bounded_context", _S, False),
    T.StructField("aggregate_type", _S, False),
    T.StructField("aggregate_id", _S, False),
    T.StructField("event_id", _S, False),
    T.StructField("event_type", _S, False),
    T.StructField("event_version", _I, False),
    T.StructField("payload", T.BinaryType(), False),
    T.StructField("trace_id", _S),
    T.StructField("correlation_id", _S),
    T.StructField("causation_id", _S),
    T.StructField("metadata", _S),
    T.StructField("created_at", T.TimestampType(), False),
])

#: What the log holds: the input with its place in the whole log and in its aggregate.
EVENT_SCHEMA = T.StructType([T.StructField("global_position", _L, False), *EVENT_INPUT_SCHEMA.fields[:3], T.StructField("aggregate_version", _L, False), *EVENT_INPUT_SCHEMA.fields[3:]])
EVENT_COLUMNS = tuple(EVENT_SCHEMA.names)
AGGREGATE = ("bounded_context", "aggregate_type", "aggregate_id")

HEAD_SCHEMA = T.StructType([*EVENT_INPUT_SCHEMA.fields[:3], T.StructField("aggregate_version", _L, False), T.StructField("updated_at", T.TimestampType(), False)])
SEGMENT_SCHEMA = T.StructType([T.StructField("consumer_name", _S, False), T.StructField("segment_id", _I, False), T.StructField("total_segments", _I, False), T.StructField("owner_id", _S), T.StructField("checkpoint", _L, False)])
WORKER_SCHEMA = T.StructType([T.StructField("consumer_name", _S, False), T.StructField("worker_id", _S, False), T.StructField("last_heartbeat", T.TimestampType(), False)])

_TABLES = (("events", EVENT_SCHEMA), ("aggregate_heads", HEAD_SCHEMA), ("consumer_segments", SEGMENT_SCHEMA), ("consumer_workers", WORKER_SCHEMA))


def ddl(location: str, names: dict[str, str] | None = None) -> str:
    """CREATE TABLE IF NOT EXISTS statements for the four tables as Parquet under ``location``."""
    out = []
    for table, schema in _TABLES:
        name = (names or {}).get(table, table)
        columns = ",\n  ".join(f"{f.name} {f.dataType.simpleString().upper()}{'' if f.nullable else ' NOT NULL'}" for f in schema.fields)
        out.append(f"CREATE TABLE IF NOT EXISTS {name} (\n  {columns}\n) USING PARQUET LOCATION '{location.rstrip('/')}/{name}';\n")
    return "\n".join(out)
