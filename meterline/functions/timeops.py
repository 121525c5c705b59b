"""Time helpers on UTC timestamps."""

from __future__ import annotations


def at(micros: int | None) -> str:
    """A timestamp literal from epoch microseconds."""
    return "CAST(NULL AS TIMESTAMP)" if micros is None else f"timestamp_micros({micros}L)"


def minute_of(ts: str) -> str:
    return f"date_trunc('minute', {ts})"


def plus_millis(ts: str, ms: str) -> str:
    """``ts`` shifted by a fractional number of milliseconds, to the microsecond."""
    return f"timestamp_micros(unix_micros({ts}) + CAST(round({ms} * 1000) AS BIGINT))"


def plus_minutes(ts: str, minutes: int) -> str:
    return f"timestamp_micros(unix_micros({ts}) + {int(minutes) * 60_000_000}L)"


def floor_to(ts: str, seconds: int) -> str:
    """Start of the ``seconds``-wide bucket, counted from the epoch."""
    micros = f"unix_micros({ts})"
    return f"timestamp_micros({micros} - pmod({micros}, {seconds * 1_000_000}L))"


def minutes_between(later: str, earlier: str) -> str:
    return f"((unix_micros({later}) - unix_micros({earlier})) / 60000000D)"


def key_text(ts: str) -> str:
    """Timestamp text inside surrogate keys: seconds and the UTC offset."""
    return f"concat(date_format({ts}, 'yyyy-MM-dd HH:mm:ss'), '+00')"
