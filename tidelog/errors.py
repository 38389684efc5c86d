"""Errors that callers tell apart."""


class LogError(Exception):
    """Base of all errors of the log."""


class NoEventsError(LogError):
    """An append without events."""


class OptimisticConcurrencyError(LogError):
    """The aggregate isn't at the expected version, or an event or version is there already."""


class SegmentNotOwnedError(LogError):
    """The worker that reads or moves a checkpoint doesn't own its segment."""


class ConsumerStoppedError(LogError):
    """A consumer ended by an error, whose text is in the message and which is the cause."""


class NoConsumersError(LogError):
    """A run without consumers."""


class InvalidPartitionConfigError(LogError, ValueError):
    """A segment number outside the total."""


class UnknownEventError(LogError):
    """No type is registered for an event type and version."""


class PayloadError(LogError):
    """A payload that isn't the JSON of its type."""


class CommitConflict(LogError):
    """Another writer made this commit first; a retry can succeed."""


def is_unique_violation(error: BaseException | None) -> bool:
    """True for conflicts of this log, and for errors that carry SQLSTATE 23505 or say so in their text."""
    if error is None:
        return False
    if isinstance(error, OptimisticConcurrencyError | CommitConflict):
        return True
    for name in ("sqlstate", "pgcode", "code", "getSqlState"):
        value = getattr(error, name, None)
        try:
            value = value() if callable(value) else value
        except Exception:
            value = None
        if value == "23505":
            return True
    text = str(error).lower()
    return "duplicate key" in text or "unique constraint" in text


def is_transient(error: BaseException) -> bool:
    """Errors that a retry can clear: lost races, and those that carry SQLSTATE 40001 or 40P01, of a class 08 connection, or say so."""
    seen: BaseException | None = error
    while seen is not None:
        if isinstance(seen, CommitConflict | ConnectionError | TimeoutError):
            return True
        state = getattr(seen, "sqlstate", None) or getattr(seen, "pgcode", None) or ""
        if isinstance(state, str) and (state in ("40001", "40P01") or state.startswith("08")):
            return True
        seen = seen.__cause__
    return False
