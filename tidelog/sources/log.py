"""The event log as immutable Parquet folders and a commit log.

Every append leaves a folder of events and one of the heads it changed. ``compact`` merges neighbouring
folders of like size, so a log of any number of appends has a number of folders that grows with its
logarithm, and a reader of heads or streams opens no more than those.
"""

from __future__ import annotations

import datetime as dt
import math
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.errors import CommitConflict, NoEventsError, OptimisticConcurrencyError, SegmentNotOwnedError
from tidelog.functions.notes import note
from tidelog.functions.pacing import retry_delay
from tidelog.operators import append as appends
from tidelog.operators import scans
from tidelog.operators.values import AppendResult, ExpectedVersion, Stream
from tidelog.plans.ordering import numbered
from tidelog.plans.scope import Scope
from tidelog.schema import AGGREGATE, EVENT_COLUMNS, EVENT_INPUT_SCHEMA, EVENT_SCHEMA, HEAD_SCHEMA, SEGMENT_SCHEMA, WORKER_SCHEMA
from tidelog.sources.commits import Commits, State

#: Up to so many new event ids are looked up by value, so that files without them are skipped.
FEW_IDS = 1000
#: Events whose order of append is numbered in one task.
ORDINALS = 1_000_000


@dataclass(frozen=True)
class StoreConfig:
    """Names of the folders, the attempts of an append that loses to another writer, and a logger."""

    events: str = "events"
    heads: str = "aggregate_heads"
    models: str = "models"
    staging: str = "staging"
    attempts: int = 8
    #: Folders of like size that are merged; 0 leaves that to calls of ``compact``.
    merge: int = 16
    logger: object = None


def utc(seconds: float) -> str:
    """Text of one form, so that its order is that of time."""
    return dt.datetime.fromtimestamp(seconds, dt.UTC).isoformat(timespec="microseconds")


def _merged(delta: dict, old: State, new: State) -> dict | None:
    """The change made on the old state for the new one, or None if it would not be the same there."""
    beats, before = {w[:2]: w[2] for w in new.workers}, {w[:2]: w[2] for w in old.workers}
    places, was = {r[:2]: r for r in new.segments}, {r[:2]: r for r in old.segments}
    if beats.keys() != before.keys() or {k: r[:4] for k, r in places.items()} != {k: r[:4] for k, r in was.items()}:
        return None
    left = {(c, w) for c, w, _ in delta["workers"]}
    if any(beats[k] != before[k] for k in before if k not in left):  # one that is to go gave a sign
        return None
    segments = []
    for r in delta["segments"]:
        key = tuple(r[:2])
        moved = key in was and places[key][4] != was[key][4]
        if moved and r[4] != was[key][4]:
            return None
        segments.append([*r[:4], places[key][4] if moved else r[4]])
    return {"segments": segments, "workers": [[c, w, max(t, beats.get((c, w), t))] for c, w, t in delta["workers"]]}


class EventLog:
    def __init__(self, spark: SparkSession, path: str, config: StoreConfig | None = None):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or StoreConfig()
        self.commits = Commits(spark, self.path)
        self.commits.create()

    # reads

    def state(self) -> State:
        return self.commits.latest()

    def _events(self, state: State, after: int = 0, until: int | None = None) -> DataFrame:
        """Events of the folders that can hold positions in (after, until]."""
        folders = [f"{self.path}/{f}" for f, first, last in state.events if last > after and (until is None or first <= until)]
        return self.spark.read.schema(EVENT_SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], EVENT_SCHEMA)

    def events(self) -> DataFrame:
        return self._events(self.state())

    def read_events(self, after: int, limit: int, scope: Scope | None = None) -> DataFrame:
        return scans.read_events(self._events(self.state(), after), after, limit, scope)

    def read_stream(self, bounded_context: str, aggregate_type: str, aggregate_id: str, first: int | None = None, last: int | None = None) -> Stream:
        return scans.read_stream(self.events(), bounded_context, aggregate_type, aggregate_id, first, last)

    def latest_position(self) -> int:
        """From the commits alone."""
        return self.state().head

    def _heads_folder(self, folder: str) -> str:
        return f"{self.path}/{folder.replace(self.config.events, self.config.heads, 1)}"

    def _heads(self, state: State, aggregates: list[str] | None = None) -> DataFrame:
        """Heads of all aggregates, or of those with the ids given, which the files' filters find."""
        folders = [self._heads_folder(f) for f, _, _ in state.events]
        if not folders:
            return self.spark.createDataFrame([], HEAD_SCHEMA)
        rows = self.spark.read.schema(HEAD_SCHEMA).parquet(*folders)
        if aggregates is not None:
            rows = rows.where(F.col("aggregate_id").isin(aggregates))
        return appends.heads_of(rows, "updated_at")

    def heads(self) -> DataFrame:
        """Head version of every aggregate, from the small tables that each commit leaves."""
        return self._heads(self.state())

    def wait_beyond(self, position: int, timeout: float, poll: float = 0.1) -> bool:
        """True once the log is beyond a position. A hint only; progress is in checkpoints."""
        end = time.monotonic() + timeout
        while self.latest_position() <= position:
            if time.monotonic() >= end:
                return False
            time.sleep(poll)
        return True

    # appends

    def append(self, expected: ExpectedVersion, events: Iterable[dict], retry: bool = True) -> AppendResult:
        """Append the events of one aggregate, all or none.

        Missing fields: event_id is drawn, created_at is now, event_version is 1, others are null; an
        empty text counts as null in the optional ones. The result has the values as given.
        """
        rows = [self._filled(e) for e in events]
        if fault := appends.validated(rows):
            raise NoEventsError(fault) if not rows else ValueError(fault)
        df = self.spark.createDataFrame([tuple(r[c] for c in EVENT_INPUT_SCHEMA.names) + (i,) for i, r in enumerate(rows)], T.StructType([*EVENT_INPUT_SCHEMA.fields, T.StructField("ordinal", T.LongType(), False)]))
        before = self.append_batch(df.withColumn("expected_version", F.lit(expected.code)), retry, stage=False)
        made = self._events(before, before.head - len(rows), before.head).where((F.col("global_position") > before.head - len(rows)) & (F.col("global_position") <= before.head))
        places = {r.event_id: r for r in made.select("event_id", "global_position", "aggregate_version").collect()}
        row = T.Row(*EVENT_COLUMNS)
        return AppendResult([row(*((places[r["event_id"]][c] if c in ("global_position", "aggregate_version") else r[c]) for c in EVENT_COLUMNS)) for r in rows])

    @staticmethod
    def _filled(event: dict) -> dict:
        out = {c: event.get(c) for c in EVENT_INPUT_SCHEMA.names}
        for c in ("trace_id", "correlation_id", "causation_id", "metadata"):
            out[c] = out[c] or None
        out["event_id"] = str(out["event_id"] or uuid.uuid4())
        out["event_version"] = 1 if out["event_version"] is None else out["event_version"]
        out["payload"] = bytearray(out["payload"].encode() if isinstance(out["payload"], str) else out["payload"] or b"")
        out["created_at"] = out["created_at"] or dt.datetime.now(dt.UTC)
        for c in AGGREGATE:
            out[c] = out[c] or ""
        return out

    def append_batch(self, events: DataFrame, retry: bool = True, stage: bool = True) -> State:
        """Append events of any number of aggregates, all or none; see operators.append for the two extra columns.

        The batch is written once, and what was written is checked and appended, so a batch whose plan
        gives other values each time (drawn ids) is still one batch; ``stage=False`` leaves that out for
        rows that are values already. A writer that loses a race starts again on the new state: exact and
        no-stream expectations are tested anew, any-expectations succeed. Without ``retry`` the race is a
        conflict.
        """
        staged = f"{self.path}/{self.config.staging}/{uuid.uuid4().hex}"
        try:
            if stage:
                events.write.parquet(staged)
                events = self.spark.read.schema(events.schema).parquet(staged)
            return self._append(events, retry)
        finally:
            if stage:
                self._delete(staged)

    def _delete(self, path: str) -> None:
        self.commits.fs.delete(self.commits._path(path), True)

    def _append(self, events: DataFrame, retry: bool) -> State:
        n, nameless = events.agg(F.count("*"), F.count_if(F.coalesce(F.col("bounded_context"), F.lit("")) == "")).first()
        if nameless:
            raise ValueError("bounded context is required")
        if not n:
            raise NoEventsError("no events to append")
        for attempt in range(self.config.attempts if retry else 1):
            state = self.state()
            folder = f"{self.config.events}/{state.version + 1:020d}-{uuid.uuid4().hex}"
            try:
                after = self._append_on(state, events, n, folder)
                note(self.config.logger, "info", "events appended", version=after.version, first=state.head + 1, last=after.head)
                break
            except CommitConflict:
                note(self.config.logger, "info", "append lost a race", version=state.version + 1, attempt=attempt)
                for f in (f"{self.path}/{folder}", self._heads_folder(folder)):
                    self._delete(f)
                time.sleep(retry_delay(attempt))
        else:
            raise OptimisticConcurrencyError("other writers committed first at every attempt")
        if self.config.merge:
            self.compact()
        return after

    def _append_on(self, state: State, events: DataFrame, n: int, folder: str) -> State:
        few = n <= FEW_IDS
        known = events.select("event_id", "aggregate_id").collect() if few else []
        heads, existing = self._heads(state, sorted({r.aggregate_id for r in known}) if few else None), self._events(state)
        if few:
            existing = existing.where(F.col("event_id").isin([r.event_id for r in known]))
        if bad := appends.conflicts(events, heads, existing).limit(1).collect():
            raise OptimisticConcurrencyError(f"{bad[0].reason}: {bad[0].asDict()}")
        rows = numbered(appends.assigned(events, heads), "global_position", ["ordinal"], F.floor(F.col("ordinal") / ORDINALS), state.head)
        self._write_events(rows, folder)
        self._write_heads(appends.heads_of(self.spark.read.schema(EVENT_SCHEMA).parquet(f"{self.path}/{folder}")), folder)
        # heartbeats, checkpoints and compactions in between don't matter to an append
        return self.commits.commit(state, {"events": [(folder, state.head + 1, state.head + n)]}, lambda a, b: a.head == b.head)

    def _write_events(self, rows: DataFrame, folder: str) -> None:
        """Ids and aggregates are found through the files' Bloom filters, positions through their statistics."""
        out = rows.select(*EVENT_COLUMNS).sortWithinPartitions("global_position").write
        out.option("parquet.bloom.filter.enabled#event_id", "true").option("parquet.bloom.filter.enabled#aggregate_id", "true").parquet(f"{self.path}/{folder}")

    def _write_heads(self, rows: DataFrame, folder: str) -> None:
        rows.sortWithinPartitions(*AGGREGATE).write.option("parquet.bloom.filter.enabled#aggregate_id", "true").parquet(self._heads_folder(folder))

    # compaction

    def compact(self, merge: int | None = None) -> State:
        """Merge runs of ``merge`` neighbouring folders whose numbers of events are of one power of it, until there are none.

        Positions, events and heads stay as they are; readers of an older state keep its folders until ``vacuum``.
        """
        merge = max(2, merge or self.config.merge or 16)
        while chosen := self._mergeable(state := self.state(), merge):
            first, last = chosen[0][1], chosen[-1][2]
            folder = f"{self.config.events}/{state.version + 1:020d}-{uuid.uuid4().hex}"
            rows = self.spark.read.schema(EVENT_SCHEMA).parquet(*(f"{self.path}/{f}" for f, _, _ in chosen))
            files = -(-(last - first + 1) // ORDINALS)
            self._write_events(rows.coalesce(1) if files == 1 else rows.repartitionByRange(files, "global_position"), folder)
            heads = appends.heads_of(self.spark.read.schema(HEAD_SCHEMA).parquet(*(self._heads_folder(f) for f, _, _ in chosen)), "updated_at")
            self._write_heads(heads.coalesce(1) if files == 1 else heads, folder)
            try:
                self.commits.commit(state, {"replaced": [(folder, first, last)]}, lambda a, b: set(chosen) <= set(b.events))
            except CommitConflict:  # others have merged them
                for f in (f"{self.path}/{folder}", self._heads_folder(folder)):
                    self._delete(f)
        return self.state()

    @staticmethod
    def _mergeable(state: State, merge: int) -> list[tuple[str, int, int]]:
        """The last run of ``merge`` or more neighbours of one level, or none."""
        level = lambda e: int(math.log(e[2] - e[1] + 1, merge) + 1e-9)
        run: list[tuple[str, int, int]] = []
        for e in reversed(state.events):
            if run and level(e) != level(run[-1]):
                if len(run) >= merge:
                    break
                run = []
            run.append(e)
        return run[::-1] if len(run) >= merge else []

    def vacuum(self, keep_seconds: float = 3600.0) -> int:
        """Delete folders that no state names and that are older than ``keep_seconds``; how many there were."""
        state, limit, gone = self.state(), (time.time() - keep_seconds) * 1000, 0
        named = {f for f, _, _ in state.events}
        for top in (self.config.events, self.config.heads, self.config.staging):
            root = self.commits._path(f"{self.path}/{top}")
            for status in self.commits.fs.listStatus(root) if self.commits.fs.exists(root) else ():
                name = status.getPath().getName()
                if f"{self.config.events}/{name}" not in named and status.getModificationTime() < limit:
                    self._delete(f"{self.path}/{top}/{name}")
                    gone += 1
        return gone

    # coordination and read models

    def segments(self, state: State | None = None) -> DataFrame:
        return self.spark.createDataFrame(list((state or self.state()).segments), SEGMENT_SCHEMA).coalesce(1)

    def workers(self, state: State | None = None) -> DataFrame:
        """Heartbeats are kept in UTC and come as instants, so drivers in different zones agree."""
        rows = [(c, w, dt.datetime.fromisoformat(t)) for c, w, t in (state or self.state()).workers]
        return self.spark.createDataFrame(rows, WORKER_SCHEMA).coalesce(1)

    def transition(self, step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]) -> State:
        """Commit the coordination tables that ``step`` makes of the present ones; the tables have a row for each segment and worker.

        Heartbeats, checkpoints and appends that others commit meanwhile are merged in; if ownership or
        the registry changed, the step runs again.
        """
        for attempt in range(self.config.attempts * 4):
            state = self.state()
            segments, workers = step(self.segments(state), self.workers(state))
            micros = workers.select("consumer_name", "worker_id", F.unix_micros("last_heartbeat").alias("t")).collect()
            delta = {"segments": sorted((list(r) for r in segments.collect()), key=lambda r: r[:2]), "workers": sorted([r.consumer_name, r.worker_id, utc(r.t / 1e6)] for r in micros)}
            while delta is not None:
                try:
                    return self.commits.commit(state, delta)
                except CommitConflict:
                    newer = self.state()
                    delta, state = _merged(delta, state, newer), newer
            time.sleep(retry_delay(attempt))
        raise CommitConflict("other writers committed first at every attempt")

    def beat(self, consumer: str, worker: str) -> State:
        """The worker's heartbeat is now, whether it was registered or not; a change of one row, without a job."""
        return self.commits.update(lambda s: {"workers": sorted([*([*w] for w in s.workers if w[:2] != (consumer, worker)), [consumer, worker, utc(time.time())]])})

    def advance(self, consumer: str, segment: int, worker: str, at: int, to: int, models: dict[str, DataFrame] | None = None) -> State:
        """Move a checkpoint from ``at`` to ``to`` and show rows of read models, as one commit.

        SegmentNotOwnedError if the worker doesn't own the segment any more, or if its checkpoint isn't
        ``at``: then others have had it in between, and the batch is theirs.
        """
        folders = {}
        for name, rows in (models or {}).items():
            folders[name] = f"{self.config.models}/{name}/{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/{folders[name]}")

        def changed(state: State) -> dict:
            rows = [list(r) for r in state.segments]
            here = next((r for r in rows if r[:2] == [consumer, segment]), None)
            if here is None or here[3] != worker or here[4] != at:
                raise SegmentNotOwnedError(f"segment {segment} of {consumer} isn't owned by {worker} at checkpoint {at}")
            here[4] = to
            return {"segments": rows} | ({"models": folders} if folders else {})

        return self.commits.update(changed, self.config.attempts * 4)

    def model(self, name: str) -> DataFrame:
        """All rows that consumers have put into a read model."""
        return self.spark.read.parquet(*(f"{self.path}/{f}" for f in self.state().models[name]))


def init_store(spark: SparkSession, path: str, config: StoreConfig | None = None) -> EventLog:
    """The store at a path, made if there is none."""
    return EventLog(spark, path, config)
