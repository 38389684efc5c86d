"""Log lines with named values, for any logger of the standard library's kind; none costs nothing."""

from __future__ import annotations


def note(logger: object, level: str, message: str, **values: object) -> None:
    """``level`` is debug, info or error."""
    if logger is not None:
        getattr(logger, level)(message + "".join(f" {k}={v}" for k, v in values.items()))
