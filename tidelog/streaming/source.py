"""The log as a source: ``spark.read.format("tidelog")`` and ``spark.readStream.format("tidelog")``.

Options: ``path``; ``after``, the position to start beyond; ``until``, the last position (batch only);
``bounded_contexts`` and ``aggregate_types``, scopes as comma-separated names. Offsets are positions; a
read is split by the folders that hold its positions, so it is as parallel as the log has folders, and
positions and scope go to the Parquet scan. The state comes from the last snapshot and the commits after
it, and folders are read through the file system of the path's scheme as Python sees it (a shared mount).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidelog.schema import EVENT_COLUMNS, EVENT_SCHEMA
from tidelog.sources.commits import HINT, State, latest_state


@dataclass
class Folder(InputPartition):
    path: str
    after: int
    until: int


class _Log:
    """What both readers share. Nothing of it is a Spark object, so it goes to executors."""

    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://").rstrip("/")
        self.after = int(options.get("after", 0))
        self.until = int(options["until"]) if "until" in options else None
        names = lambda key: [x for x in options.get(key, "").split(",") if x]
        self.scope = [("bounded_context", names("bounded_contexts")), ("aggregate_type", names("aggregate_types"))]

    def state(self) -> State:
        def body(name: str) -> dict | None:
            try:
                with open(f"{self.path}/_commits/{name}") as f:
                    return json.load(f)
            except FileNotFoundError:
                return None
            except json.JSONDecodeError:
                if name == HINT:  # being written
                    return None
                raise

        return latest_state(body)

    def folders(self, after: int, until: int) -> list[InputPartition]:
        return [Folder(os.path.join(self.path, f), after, until) for f, first, last in self.state().events if last > after and first <= until]

    def rows(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        place = ds.field("global_position")
        wanted = [(place > partition.after) & (place <= partition.until), *(ds.field(c).isin(names) for c, names in self.scope if names)]
        rows = ds.dataset(partition.path, format="parquet").scanner(columns=list(EVENT_COLUMNS), filter=reduce(lambda a, b: a & b, wanted))
        for batch in rows.to_batches():
            if len(batch):
                # Parquet's old timestamps come as nanoseconds without a zone
                columns = [batch.column(c).cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC")) if c == "created_at" else batch.column(c) for c in EVENT_COLUMNS]
                yield pa.RecordBatch.from_arrays(columns, list(EVENT_COLUMNS))


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.log = _Log(options)

    def partitions(self) -> list[InputPartition]:
        until = self.log.state().head if self.log.until is None else self.log.until
        # an empty log has one part without rows
        return self.log.folders(self.log.after, until) or [Folder("", 0, 0)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return self.log.rows(partition) if partition.path else iter(())


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.log = _Log(options)

    def initialOffset(self) -> dict:
        return {"position": self.log.after}

    def latestOffset(self) -> dict:
        return {"position": max(self.log.state().head, self.log.after)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.log.folders(start["position"], end["position"])

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return self.log.rows(partition)


class LogDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidelog"

    def schema(self) -> StructType:
        return EVENT_SCHEMA

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(dict(self.options))

    def streamReader(self, schema: StructType) -> LogStreamReader:
        return LogStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogDataSource)
