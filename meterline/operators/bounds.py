"""Time and id bounds of incremental work.

A bound is computed once and inlined as a literal, so that partition pruning and Parquet row-group
filters can use it. Bounds travel as epoch microseconds, which no session time zone can shift.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from meterline.functions.timeops import at

GATE_MINUTES = 10
MINUTE_LOOKBACK = 30
WINDOW_LOOKBACK = 120
MINUTE_MICROS = 60_000_000


def latest(df: DataFrame, time_col: str) -> int | None:
    """Largest timestamp of a column in epoch microseconds; None for an empty table."""
    return df.selectExpr(f"unix_micros(CAST(max({time_col}) AS TIMESTAMP)) AS m").first()["m"]


def minutes_before(micros: int | None, minutes: float) -> int | None:
    return None if micros is None else micros - int(minutes * MINUTE_MICROS)


def minute_start(micros: int) -> int:
    return micros - micros % MINUTE_MICROS


def gate_of(
    arrivals: DataFrame, minutes: int = GATE_MINUTES, time_col: str = "arrival_timestamp"
) -> int | None:
    """Newest closed minute: the latest minute minus the gate.

    ``arrivals`` only needs the time column; pass the narrowest frame at hand.
    """
    newest = latest(arrivals, time_col)
    return None if newest is None else minutes_before(minute_start(newest), minutes)


def closed_minutes(rows: DataFrame, gate: int | None, minute_col: str = "minute_ts") -> DataFrame:
    """Rows whose minute no longer changes. Rows without a time are never closed."""
    return rows.where("false" if gate is None else f"{minute_col} <= {at(gate)}")


def lookback_bound(target: DataFrame, time_col: str, minutes: int) -> int | None:
    """Start of the range an incremental run recomputes; None means everything."""
    return minutes_before(latest(target, time_col), minutes)


def since(rows: DataFrame, time_col: str, bound: int | None) -> DataFrame:
    return rows if bound is None else rows.where(f"{time_col} >= {at(bound)}")


def before(rows: DataFrame, time_col: str, bound: int | None) -> DataFrame:
    return rows.where("false" if bound is None else f"{time_col} < {at(bound)}")


def fact_range(clean: DataFrame, gate: int | None, start: int | None = None) -> DataFrame:
    """Closed rows of the cleaned fact from minute ``start`` on.

    The minute is derived from the arrival time, so the same limits also hold on ``arrival_timestamp``
    (Parquet row groups) and ``event_date`` (partitions of the stored fact), which can skip files.
    """
    if gate is None:
        return clean.where("false")
    limits = [f"minute_ts <= {at(gate)}"]
    if start is not None:
        limits.append(f"minute_ts >= {at(start)}")
    if "arrival_timestamp" in clean.columns:
        limits.append(f"arrival_timestamp < {at(gate + MINUTE_MICROS)}")
        limits += [f"arrival_timestamp >= {at(start)}"] if start is not None else []
    if "event_date" in clean.columns:
        limits.append(f"event_date <= to_date({at(gate)})")
        limits += [f"event_date >= to_date({at(start)})"] if start is not None else []
    return clean.where(" AND ".join(limits))


def last_id(target: DataFrame, id_col: str = "raw_id") -> int:
    """Progress of a table that is filled in id order: its largest id, 0 if empty."""
    found = target.selectExpr(f"max({id_col}) AS m").first()["m"]
    return 0 if found is None else found


def new_rows(source: DataFrame, last: int, id_col: str = "raw_id") -> DataFrame:
    return source.where(f"{id_col} > {last}")
