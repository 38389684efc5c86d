"""The commit log: numbered files, each made by exactly one writer, that say what the store holds.

A reader sees only what a commit names, so no half-written batch and no gap is ever visible. Files
are reached through Hadoop's file systems; a commit is a create that fails if the file is there.
Every SNAPSHOT commits one more file sums up all before it, and a hint says which was the last, so a
reader opens the hint, a snapshot and the few commits after it, however many there have been. The hint
may lag or be missing; it only saves a listing. Compaction (see log.py) keeps the snapshots small.
"""

from __future__ import annotations

import json
import os
import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from tidelog.errors import CommitConflict
from tidelog.functions.pacing import retry_delay

SNAPSHOT = 64
HINT = "_last.json"


@dataclass(frozen=True)
class State:
    """What the store holds at a version. ``events`` lists (folder, first position, last position), in order."""

    version: int = 0
    head: int = 0
    events: tuple[tuple[str, int, int], ...] = ()
    segments: tuple[tuple, ...] = ()
    workers: tuple[tuple, ...] = ()
    models: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def advanced(self, delta: dict) -> State:
        """With a commit's changes: new event folders, folders that one replaces, the coordination tables if they changed, new model folders."""
        models = {k: tuple(v) for k, v in self.models.items()}
        for name, folder in delta.get("models", {}).items():
            models[name] = (*models.get(name, ()), folder)
        events = (*self.events, *(tuple(e) for e in delta.get("events", ())))
        for folder, first, last in delta.get("replaced", ()):
            events = (*(e for e in events if e[2] < first), (folder, first, last), *(e for e in events if e[1] > last))
        rows = lambda key, old: tuple(tuple(r) for r in delta[key]) if key in delta else old
        return State(self.version + 1, events[-1][2] if events else 0, events, rows("segments", self.segments), rows("workers", self.workers), models)

    def summed(self) -> dict:
        return {"version": self.version, "head": self.head, "events": self.events, "segments": self.segments, "workers": self.workers, "models": self.models}

    @staticmethod
    def of(raw: dict) -> State:
        rows = lambda key: tuple(map(tuple, raw[key]))
        return State(raw["version"], raw["head"], rows("events"), rows("segments"), rows("workers"), {k: tuple(v) for k, v in raw["models"].items()})


def commit_name(version: int) -> str:
    return f"{version:020d}.commit.json"


def snapshot_name(version: int) -> str:
    return f"{version:020d}.snapshot.json"


def latest_state(read: Callable[[str], dict | None], state: State | None = None) -> State:
    """The state that files tell of, from a known one on if given; ``read`` gives a file's body, or None if there is none."""
    hint = read(HINT) if state is None else None
    state = state or State()
    if hint and (raw := read(snapshot_name(hint["version"]))):
        state = State.of(raw)
    while (delta := read(commit_name(state.version + 1))) is not None:
        state = state.advanced(delta)
    return state


class Commits:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, f"{path.rstrip('/')}/_commits"
        self.jvm = spark.sparkContext._jvm
        self.seen: State | None = None
        self.fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def create(self) -> None:
        self.fs.mkdirs(self._path(self.folder))

    def _read(self, name: str) -> dict | None:
        path = self._path(f"{self.folder}/{name}")
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            body = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(body)
        except json.JSONDecodeError:
            if name == HINT:  # being written
                return None
            raise

    def _put(self, name: str, body: dict) -> bool:
        """False if the file is there."""
        target, data = f"{self.folder}/{name}", json.dumps(body).encode()
        uri = self.fs.getUri()
        if uri.getScheme() == "file":
            # an exclusive hard link shows the whole file or none, and only to one writer
            plain = self._path(target).toUri().getPath()
            part = f"{plain}.{os.getpid()}.{os.urandom(6).hex()}"
            with open(part, "xb") as out:
                out.write(data)
                out.flush()
                os.fsync(out.fileno())
            try:
                os.link(part, plain)
            except FileExistsError:
                return False
            finally:
                os.unlink(part)
            return True
        try:
            stream = self.fs.create(self._path(target), False)
            stream.write(bytearray(data))
            stream.close()
        except Exception as error:
            if self.fs.exists(self._path(target)):
                return False
            raise error
        return True

    def latest(self) -> State:
        """From the last state that this process has seen, so that only new commits are read; commits never change."""
        self.seen = state = latest_state(self._read, self.seen)
        return state

    def commit(self, state: State, delta: dict, same: Callable[[State, State], bool] | None = None) -> State:
        """Make the next version; CommitConflict if another writer has, but where ``same`` tells that the change is as good on the new state."""
        while not self._put(commit_name(state.version + 1), delta):
            newer = self.latest()
            if same is None or not same(state, newer):
                raise CommitConflict(f"version {state.version + 1} was committed by another writer")
            state = newer
        after = state.advanced(delta)
        if after.version % SNAPSHOT == 0:
            self._put(snapshot_name(after.version), after.summed())
            stream = self.fs.create(self._path(f"{self.folder}/{HINT}"), True)
            stream.write(bytearray(json.dumps({"version": after.version}).encode()))
            stream.close()
        return after

    def update(self, step: Callable[[State], dict], attempts: int = 32) -> State:
        """Commit what ``step`` makes of the state, again on the new one after a lost race."""
        for attempt in range(attempts):
            state = self.latest()
            try:
                return self.commit(state, step(state))
            except CommitConflict:
                if attempt == attempts - 1:
                    raise
                time.sleep(retry_delay(attempt) * random.random())
        raise AssertionError
