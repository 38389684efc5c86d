"""Plain values: expected versions, streams, and the result of an append."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ExpectedVersion:
    """What an append expects of its aggregate: ``any()``, ``no_stream()``, or ``exact(n)``; encoded -1, 0, n."""

    code: int

    @classmethod
    def any(cls) -> ExpectedVersion:
        return cls(-1)

    @classmethod
    def no_stream(cls) -> ExpectedVersion:
        return cls(0)

    @classmethod
    def exact(cls, version: int) -> ExpectedVersion:
        """exact(0) is no_stream()."""
        if version < 0:
            raise ValueError(f"an exact version can't be negative: {version}")
        return cls(version)

    @property
    def is_any(self) -> bool:
        return self.code == -1

    @property
    def is_no_stream(self) -> bool:
        return self.code == 0

    @property
    def is_exact(self) -> bool:
        return self.code > 0

    @property
    def value(self) -> int:
        return max(self.code, 0)

    def __str__(self) -> str:
        return "Any" if self.is_any else "NoStream" if self.is_no_stream else f"Exact({self.code})"


@dataclass(frozen=True)
class Stream:
    """One aggregate's events in order of version; stays lazy until asked."""

    bounded_context: str
    aggregate_type: str
    aggregate_id: str
    events: DataFrame

    def version(self) -> int:
        """Version of the last event, or 0."""
        return int(self.events.agg(F.coalesce(F.max("aggregate_version"), F.lit(0))).first()[0])

    def is_empty(self) -> bool:
        return self.events.isEmpty()

    def __len__(self) -> int:
        return self.events.count()


@dataclass(frozen=True)
class AppendResult:
    """The events just appended, as rows in order, with their positions."""

    events: list[Row] = field(default_factory=list)

    @property
    def global_positions(self) -> list[int]:
        return [e.global_position for e in self.events]

    def from_version(self) -> int:
        """Version of the aggregate before the append; 0 without events."""
        return self.events[0].aggregate_version - 1 if self.events else 0

    def to_version(self) -> int:
        """Version of the aggregate after the append; 0 without events."""
        return self.events[-1].aggregate_version if self.events else 0
