"""Efficiency of the recent past, across instances."""

from __future__ import annotations

from pyspark.sql import DataFrame

from meterline.functions import exprs
from meterline.operators.selection import trailing_window

SERIES_METRICS = [
    "queries_count", "exec_ms_avg", "queue_ms_avg", "compile_ms_avg", "scanned_mb_sum", "spilled_mb_sum",
    "spill_to_scan_ratio", "cached_queries", "aborted_queries", "heavy_units_sum", "heavy_unit_avg",
]


def _total(c: str) -> str:
    return f"sum(coalesce(CAST({c} AS DOUBLE), 0D))"


def _over(amount: str, base: str) -> str:
    return f"CASE WHEN {base} > 0 THEN {amount} / {base} ELSE 0D END"


def _weighted(c: str) -> str:
    amount = f"sum(coalesce({c}, 0D) * coalesce(CAST(queries_count AS DOUBLE), 0D))"
    return _over(amount, _total("queries_count"))


def efficiency_rollup(efficiency: DataFrame, minutes: int, newest: int | None = None) -> DataFrame:
    """One row per minute of the trailing window: sums, and averages weighted by query counts.

    Ratios without a denominator are 0 here (the per-instance table has NULL).
    """
    recent = trailing_window(
        efficiency.where("minute_ts IS NOT NULL"), "minute_ts", minutes, newest=newest
    )
    columns = {
        "queries_count": "sum(coalesce(queries_count, 0L))",
        "exec_ms_avg": _weighted("exec_ms_avg"),
        "queue_ms_avg": _weighted("queue_ms_avg"),
        "compile_ms_avg": _over(_total("compile_ms_sum"), _total("queries_count")),
        "scanned_mb_sum": _total("scanned_mb_sum"),
        "spilled_mb_sum": _total("spilled_mb_sum"),
        "spill_to_scan_ratio": _over(_total("spilled_mb_sum"), _total("scanned_mb_sum")),
        "cached_queries": "sum(coalesce(cached_queries, 0L))",
        "aborted_queries": "sum(coalesce(aborted_queries, 0L))",
        "heavy_units_sum": _total("heavy_units_sum"),
        "heavy_unit_avg": _weighted("heavy_unit_avg"),
    }
    return recent.groupBy("minute_ts").agg(*exprs(*[f"{x} AS {c}" for c, x in columns.items()]))


def seconds_and_waste(rollup: DataFrame) -> DataFrame:
    """Adds average seconds and the spilled volume as waste."""
    return rollup.selectExpr(
        "*",
        "exec_ms_avg / 1000D AS exec_s_avg",
        "queue_ms_avg / 1000D AS queue_s_avg",
        "coalesce(spilled_mb_sum, 0D) AS waste_sum",
    )
