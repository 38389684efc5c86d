"""Arithmetic of waiting: pauses, polling, retries. Durations are in seconds."""

from __future__ import annotations

FIRST_PAUSE = 0.005
FIRST_RETRY, MOST_RETRY = 0.025, 0.5


def post_batch_pause(pause: float, n_read: int, batch_size: int, most: float, one_off: bool = False) -> float:
    """Next pause after a batch: full batches double it from 5 ms up to ``most``, others halve it, below 5 ms to none."""
    if one_off or most <= 0 or batch_size <= 0:
        return 0.0
    if n_read >= batch_size:
        return min(FIRST_PAUSE, most) if pause <= 0 else min(2 * pause, most)
    half = pause / 2
    return half if half >= FIRST_PAUSE else 0.0


def idle_poll(poll: float, current: float, most: float, factor: float) -> float:
    """Next wait while nothing comes: the current one times the factor, up to ``most``."""
    if poll <= 0:
        return 0.0
    if most <= 0:
        return poll
    current = max(current, poll)
    return min(current if factor <= 1 else current * factor, most)


def retry_delay(attempt: int) -> float:
    """25 ms doubling up to half a second."""
    return min(FIRST_RETRY * 2 ** min(max(attempt, 0), 10), MOST_RETRY)


def audit_interval(configured: float, stale: float) -> float:
    """0 asks for half the stale threshold; a negative value turns audits off."""
    if configured < 0:
        return 0.0
    return configured if configured > 0 else max(stale, 0) / 2


def wakeup_jitter(nanos: int, segment: int, jitter_nanos: int) -> int:
    """Spread of segments that wake together."""
    return (nanos + segment + 1) % jitter_nanos if jitter_nanos > 0 else 0


def fair_share(worker: str, workers: list[str], total: int) -> int:
    """Segments that a worker should own: equal parts, one more for the first by id. An unlisted worker counts as the last."""
    ranked = sorted(set(workers))
    rank = ranked.index(worker) if worker in ranked else len(ranked)
    n = max(len(ranked), rank + 1)
    return total // n + (rank < total % n)
