"""Questions asked of the leaderboards."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions.timeops import at
from meterline.operators import bounds
from meterline.operators.selection import exact_quantile, resolve_column

LABEL_LENGTH, LABEL_HEAD, LABEL_TAIL = 28, 12, 10
MISSING = "—"
# Report column -> dimension types to try in order.
TOP_VALUE_TYPES = {
    "query_type": ["query_type", "read"],
    "user": ["user", "user_id", "instance_id"],
    "instance_id": ["instance_id", "warehouse", "cluster_id"],
    "access_scope": ["access_scope"],
    "fingerprint": ["fingerprint"],
    "workload": ["workload", "workload_type"],
}
FINGERPRINT_TYPES = ("fingerprint", "feature_fingerprint")
USER_TYPES = ("user", "user_id", "instance_id")
# Names under which a table may carry a predicted cost, a fingerprint and a user.
PREDICTED_COST = ["pred_cost_7d", "predicted_cost_7d", "cost_7d", "next_7d_cost", "forecast_7d_cost"]
FINGERPRINT_NAMES = ["feature_fingerprint", "fingerprint", "fp"]
USER_NAMES = ["user", "user_id", "instance_id", "principal", "actor"]


def latest_window(
    board: DataFrame, time_col: str = "window_end", newest: int | None = None
) -> DataFrame:
    """Rows of the newest window. ``newest`` (epoch microseconds) spares the look-up."""
    newest = bounds.latest(board, time_col) if newest is None else newest
    return board.where("false" if newest is None else f"{time_col} = {at(newest)}")


def top_values(board: DataFrame, newest: int | None = None) -> DataFrame:
    """Best-ranked value of each dimension in the newest window, as one row."""

    def best(names: list[str]) -> str:
        tries = [
            f"min_by(dimension_value, CASE WHEN dimension_type = '{n}' THEN rank_position END)" for n in names
        ]
        return f"coalesce({', '.join(tries)}, '{MISSING}')"

    return latest_window(board, newest=newest).selectExpr(
        *[f"{best(names)} AS top_{label}" for label, names in TOP_VALUE_TYPES.items()]
    )


def search(
    board: DataFrame, dimension: str, text: str = "", top: int = 10, newest: int | None = None
) -> DataFrame:
    """Newest-window entries of one dimension whose value matches ``text``, best ranks first.

    ``text`` is a regular expression, matched anywhere and without case; blank text matches all.
    """
    rows = latest_window(board, newest=newest).where(
        (F.col("dimension_type") == dimension) & F.col("rank_position").isNotNull()
    )
    if text.strip():
        rows = rows.where(F.col("dimension_value").rlike(f"(?i){text.strip()}"))
    return rows.orderBy("rank_position", "dimension_value").limit(top)


def literal_pattern(text: str) -> str:
    """Search text that must match as it stands."""
    return re.escape(text)


def short_label(text: str) -> str:
    """Long labels keep their first 12 and last 10 characters."""
    return f"""CASE WHEN length({text}) > {LABEL_LENGTH}
        THEN concat(left({text}, {LABEL_HEAD}), '…', right({text}, {LABEL_TAIL})) ELSE {text} END"""


def display(rows: DataFrame) -> DataFrame:
    """Table cells: rank, short label, two-decimal score and whole count with thousands separators."""
    return rows.selectExpr(
        "dimension_type",
        "rank_position",
        f"{short_label('dimension_value')} AS label",
        "format_number(heavy_units_sum, 2) AS heavy_units",
        "format_number(CAST(queries_count AS BIGINT), 0) AS queries",
    )


def predator_summary(
    board: DataFrame, predators: DataFrame | None = None, newest: int | None = None
) -> DataFrame:
    """Top fingerprint with its cost, top user, and the total, as one row.

    A predator table with a predicted-cost column answers directly. Otherwise the newest leaderboard
    window does: ``pred_total`` adds up every dimension, so a query counts once per dimension;
    ``pred_total_once`` adds up the fingerprints only.
    """
    cost = None if predators is None else resolve_column(predators, PREDICTED_COST)
    if cost is not None:
        amount = f"coalesce(TRY_CAST({cost} AS DOUBLE), 0D)"

        def at_most(names: list[str]) -> str:
            name = resolve_column(predators, names)
            return f"'{MISSING}'" if name is None else f"max_by(CAST({name} AS STRING), {amount})"

        return predators.selectExpr(
            f"{at_most(FINGERPRINT_NAMES)} AS top_fingerprint",
            f"max({amount}) AS top_fingerprint_cost",
            f"{at_most(USER_NAMES)} AS top_user",
            f"sum({amount}) AS pred_total",
            f"sum({amount}) AS pred_total_once",
        )
    is_print, is_user = f"dimension_type IN {FINGERPRINT_TYPES}", f"dimension_type IN {USER_TYPES}"

    def top(kind: str) -> str:
        # ranks follow the amounts and settle ties
        return f"coalesce(min_by(dimension_value, CASE WHEN {kind} THEN rank_position END), '{MISSING}')"

    prints = f"CASE WHEN {is_print} THEN heavy_units_sum END"
    return latest_window(board, newest=newest).selectExpr(
        f"{top(is_print)} AS top_fingerprint",
        f"coalesce(max({prints}), 0D) AS top_fingerprint_cost",
        f"{top(is_user)} AS top_user",
        "coalesce(sum(heavy_units_sum), 0D) AS pred_total",
        f"coalesce(sum({prints}), 0D) AS pred_total_once",
    )


def hot_rows(rows: DataFrame, metric: str = "heavy_units_sum", q: float = 0.80) -> DataFrame:
    """Largest load, the hot threshold and how many rows reach it. Few rows (5 or less) use the maximum."""
    loads = rows.selectExpr(f"coalesce(CAST({metric} AS DOUBLE), 0D) AS load")
    head = loads.selectExpr("count(*) AS n", "max(load) AS top").first()
    threshold = exact_quantile(loads, "load", q) if head["n"] > 5 else head["top"]
    limit = 0.0 if threshold is None else threshold
    return loads.selectExpr(
        "coalesce(max(load), 0D) AS max_workload",
        f"{limit!r}D AS threshold",
        f"count_if(load >= {limit!r}D) AS hot_rows",
    )
