"""Tumbling-window leaderboards over several dimensions, and cost shares of their top entries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from meterline.functions import exprs, timeops
from meterline.functions.aggregates import as_double, ratio, score_sum, surrogate_key
from meterline.operators import bounds

WINDOW = "15 minutes"
TOP = 10
PREDATOR_TYPES = ("user", "fingerprint")
# Dimension name -> column, and the text of a missing value (None drops the row).
DIMENSIONS = {
    "user": ("user_id", None),
    "query_type": ("query_type", "UNKNOWN"),
    "workload": ("workload_classification", "UNKNOWN"),
    "access_scope": ("access_scope", "UNKNOWN"),
    "fingerprint": ("feature_fingerprint", "UNKNOWN"),
}
DIMENSION_COLUMNS = [column for column, _ in DIMENSIONS.values()]
ENTRY_KEY = surrogate_key(timeops.key_text("window_start"), "dimension_type", "dimension_value")


def tumbling_window(
    rows: DataFrame, width: str = WINDOW, time_col: str = "arrival_timestamp"
) -> DataFrame:
    """Adds ``window_start`` and ``window_end``; rows without a time drop out."""
    windowed = rows.selectExpr("*", f"window({time_col}, '{width}') AS _w")
    return windowed.selectExpr("*", "_w.start AS window_start", "_w.end AS window_end").drop("_w")


def unpivot_dimensions(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per query and dimension, in a single pass over the input."""
    entries = []
    for name, (column, missing) in DIMENSIONS.items():
        value = f"CAST({column} AS STRING)"
        if missing is not None:
            value = f"coalesce({value}, '{missing}')"
        entries.append(f"named_struct('dimension_type', '{name}', 'dimension_value', {value})")
    return rows.selectExpr(*keep, f"inline(array({', '.join(entries)}))").where(
        "dimension_value IS NOT NULL"
    )


def dimension_totals(rows: DataFrame, width: str = WINDOW) -> DataFrame:
    """Counts and exact score sums per window, dimension and value.

    The sums are partially aggregated before the one shuffle, so a value that owns a third of all rows
    reaches its reducer as one row per task.
    """
    narrow = tumbling_window(rows.select("arrival_timestamp", "heavy_unit", *DIMENSION_COLUMNS), width)
    long = unpivot_dimensions(narrow, ["window_start", "window_end", "heavy_unit"])
    return long.groupBy("window_start", "window_end", "dimension_type", "dimension_value").agg(
        *exprs("count(*) AS queries_count", f"{score_sum()} AS exact_sum")
    )


def rank_totals(totals: DataFrame, top: int = TOP) -> DataFrame:
    """Top entries per window and dimension by score sum, ties by value.

    Spark applies the rank limit before and after the shuffle, so a window sends at most ``top`` rows
    per task and dimension.
    """
    rank = """row_number() OVER (PARTITION BY window_start, dimension_type
        ORDER BY exact_sum DESC NULLS LAST, dimension_value)"""
    ranked = totals.selectExpr("*", f"{rank} AS rank_position").where(f"rank_position <= {int(top)}")
    return ranked.selectExpr(
        f"{ENTRY_KEY} AS lb_key",
        "window_start",
        "window_end",
        "dimension_type",
        "dimension_value",
        "rank_position",
        "queries_count",
        f"{as_double('exact_sum')} AS heavy_units_sum",
    )


def leaderboard(
    rows: DataFrame, width: str = WINDOW, top: int = TOP, since: int | None = None
) -> DataFrame:
    """Most expensive users, query types, workloads, scopes and fingerprints per window.

    ``since`` must be a window start; only windows from there on are computed.
    """
    rows = bounds.since(rows, "arrival_timestamp", since)
    if since is not None and "event_date" in rows.columns:
        rows = rows.where(f"event_date >= to_date({bounds.at(since)})")
    return rank_totals(dimension_totals(rows, width), top)


def resource_predators(
    board: DataFrame, types: tuple[str, ...] = PREDATOR_TYPES, top: int = TOP
) -> DataFrame:
    """Share of each listed user or fingerprint in its window's leaderboard total.

    The total covers leaderboard rows only, and the share is a 0-1 fraction. A group holds at most
    the leaderboard's ``top`` rows, so the two windows are tiny.
    """
    wanted = ", ".join(f"'{t}'" for t in types)
    group = "PARTITION BY window_start, dimension_type"
    total = f"sum(CAST(heavy_units_sum AS DECIMAL(28,12))) OVER ({group})"
    scored = (
        board.where(f"dimension_type IN ({wanted})")
        .selectExpr("*", f"{as_double(total)} AS total_heavy_units")
        .selectExpr("*", f"{ratio('heavy_units_sum', 'total_heavy_units')} AS cost_share_pct")
    )
    rank = f"""row_number() OVER ({group} ORDER BY cost_share_pct DESC NULLS FIRST,
        heavy_units_sum DESC NULLS FIRST, dimension_value)"""
    ranked = scored.drop("rank_position").selectExpr("*", f"{rank} AS rank_position")
    return ranked.where(f"rank_position <= {int(top)}").selectExpr(
        f"{ENTRY_KEY} AS pred_key",
        "window_start",
        "window_end",
        "dimension_type AS predator_type",
        "dimension_value AS predator_value",
        "rank_position",
        "queries_count",
        "heavy_units_sum",
        "total_heavy_units",
        "cost_share_pct",
    )
