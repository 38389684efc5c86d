"""Scopes: which contexts and aggregate types a read is about."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """Two lists that are both to match; an empty list doesn't restrict."""

    bounded_contexts: tuple[str, ...] = ()
    aggregate_types: tuple[str, ...] = ()

    def predicate(self) -> Column | None:
        """None if nothing is restricted, so that no filter is planned."""
        parts = [F.col(c).isin(*values) for c, values in (("bounded_context", self.bounded_contexts), ("aggregate_type", self.aggregate_types)) if values]
        return None if not parts else parts[0] if len(parts) == 1 else parts[0] & parts[1]

    def apply(self, events: DataFrame) -> DataFrame:
        p = self.predicate()
        return events if p is None else events.where(p)
