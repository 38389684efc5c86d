"""Typed payloads: a registry of dataclasses by event type and version, JSON both ways, and columns.

A class's version is the first ``v<number>`` folder in its module's path, or 1. Decoding never
guesses: an unknown type, an unknown version or text that isn't the type's JSON is an error that
names the event's index. Missing fields take the type's zero value.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import importlib
import inspect
import json
import pkgutil
import re
import types
import typing
import uuid
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.errors import PayloadError, UnknownEventError

_BASIC = {str: (T.StringType(), ""), int: (T.LongType(), 0), float: (T.DoubleType(), 0.0), bool: (T.BooleanType(), False), dt.datetime: (T.TimestampType(), None), bytes: (T.BinaryType(), b"")}


def version_of(path: str) -> int:
    """The number of the first version folder in a path or dotted name; 1 if there is none or it is below 1."""
    found = re.search(r"(?:^|[/.])v(\d+)(?:[/.]|$)", path)
    return max(int(found[1]), 1) if found else 1


def _spark_type(kind: object) -> tuple[T.DataType, bool]:
    """Spark's type and whether it may be null."""
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (typing.Union, types.UnionType) and type(None) in args:
        inner = [a for a in args if a is not type(None)]
        return _spark_type(inner[0])[0] if len(inner) == 1 else T.StringType(), True
    if origin is list:
        return T.ArrayType(_spark_type(args[0])[0]), False
    if origin is dict:
        return T.MapType(_spark_type(args[0])[0], _spark_type(args[1])[0]), False
    if dataclasses.is_dataclass(kind):
        return struct_of(kind), False
    return (_BASIC[kind][0] if kind in _BASIC else T.StringType()), False


def struct_of(cls: type) -> T.StructType:
    hints = typing.get_type_hints(cls)
    return T.StructType([T.StructField(f.name, *_spark_type(hints[f.name])) for f in dataclasses.fields(cls)])


def _zero(kind: object) -> object:
    origin = typing.get_origin(kind)
    return [] if origin is list else {} if origin is dict else _BASIC[kind][1] if kind in _BASIC else None


class Registry:
    def __init__(self) -> None:
        self.types: dict[str, dict[int, type]] = {}
        self.keys: dict[type, tuple[str, int]] = {}

    def add(self, cls: type, version: int | None = None, name: str | None = None) -> type:
        key = (name or cls.__name__, version or version_of(cls.__module__))
        if (old := self.types.setdefault(key[0], {}).get(key[1])) not in (None, cls):
            raise ValueError(f"{key[0]} version {key[1]} is {old.__qualname__} already")
        self.types[key[0]][key[1]] = cls
        self.keys[cls] = key
        return cls

    @classmethod
    def discover(cls, package: str) -> Registry:
        """All public dataclasses of a package and what is below it, in order of name and version."""
        root = importlib.import_module(package)
        modules = [root, *(importlib.import_module(m.name) for m in pkgutil.walk_packages(getattr(root, "__path__", []), package + "."))]
        found = [c for m in modules for n, c in inspect.getmembers(m, dataclasses.is_dataclass) if not n.startswith("_") and inspect.isclass(c) and c.__module__ == m.__name__]
        if not found:
            raise ValueError(f"no events in {package}")
        out = cls()
        for c in sorted(found, key=lambda c: (c.__name__, version_of(c.__module__))):
            out.add(c)
        return out

    def event_type_of(self, event: object) -> str:
        key = self.keys.get(event if isinstance(event, type) else type(event))
        if key is None:
            raise UnknownEventError(f"unregistered event: {event!r}")
        return key[0]

    def encode(self, bounded_context: str, aggregate_type: str, aggregate_id: str, events: Iterable[object], *, causation_id: str | None = None, correlation_id: str | None = None, trace_id: str | None = None, metadata: dict | None = None) -> list[dict]:
        """Events for an append, each with a new id and the time now."""
        out = []
        for e in events:
            name = self.event_type_of(e)
            out.append({
                "bounded_context": bounded_context, "aggregate_type": aggregate_type, "aggregate_id": aggregate_id, "event_id": str(uuid.uuid4()), "event_type": name, "event_version": self.keys[type(e)][1],
                "payload": json.dumps(dataclasses.asdict(e), default=str).encode(), "trace_id": trace_id, "correlation_id": correlation_id, "causation_id": causation_id, "metadata": json.dumps(metadata or {}), "created_at": dt.datetime.now(dt.UTC),
            })
        return out

    def decode(self, event_type: str, event_version: int, payload: bytes | str) -> object:
        versions = self.types.get(event_type)
        if versions is None:
            raise UnknownEventError(f"unknown event type {event_type!r}")
        if event_version not in versions:
            raise UnknownEventError(f"unknown version {event_version} of {event_type}")
        cls = versions[event_version]
        try:
            raw = json.loads(bytes(payload) if not isinstance(payload, str) else payload)
        except ValueError as error:
            raise PayloadError(f"payload of {event_type} version {event_version}: {error}") from error
        if not isinstance(raw, dict):
            raise PayloadError(f"payload of {event_type} version {event_version} is no object")
        hints = typing.get_type_hints(cls)
        return cls(**{f.name: raw.get(f.name, _zero(hints[f.name])) for f in dataclasses.fields(cls)})

    def decode_all(self, rows: Iterable, wanted: type | None = None) -> list[object]:
        """Rows with event_type, event_version and payload; errors name the index. ``wanted`` is what all must be."""
        out = []
        for i, r in enumerate(rows):
            try:
                event = self.decode(r["event_type"], r["event_version"], r["payload"])
            except (UnknownEventError, PayloadError) as error:
                raise type(error)(f"event {i}: {error}") from error
            if wanted is not None and not isinstance(event, wanted):
                raise PayloadError(f"event {i}: {type(event).__name__} is no {wanted.__name__}")
            out.append(event)
        return out

    def column(self, event_type: str, event_version: int) -> Column:
        """The payload column as a struct where the row has this type and version, else null; bad JSON fails the query."""
        try:
            cls = self.types[event_type][event_version]
        except KeyError:
            raise UnknownEventError(f"unknown event {event_type!r} version {event_version}") from None
        here = (F.col("event_type") == event_type) & (F.col("event_version") == event_version)
        parsed = F.from_json(F.when(here, F.col("payload").cast("string")), struct_of(cls), {"mode": "FAILFAST"})
        zeros = {f.name: _zero(typing.get_type_hints(cls)[f.name]) for f in dataclasses.fields(cls)}
        filled = F.struct(*(F.coalesce(parsed[n], F.lit(z)).alias(n) if isinstance(z, str | int | float | bool) else parsed[n].alias(n) for n, z in zeros.items()))
        return F.when(here, filled)
