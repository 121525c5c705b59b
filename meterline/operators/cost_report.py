"""Spend analytics on the per-minute cost series.

The cost table has one row per minute and instance. Every report first sums it to one row per minute
inside a trailing window, so a series holds at most ``window minutes + 1`` rows whatever the data volume;
the ordered windows below run on that small series only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from meterline.functions import exprs, timeops
from meterline.operators import bounds
from meterline.operators.selection import trailing_window

USD_PER_UNIT = 0.08
DAY_MINUTES = 1440
SPIKE_ROWS, SPIKE_MIN_ROWS, SPIKE_Z = 15, 5, 1.5
GRID_SECONDS = 5
IN_TIME = "ORDER BY minute_ts"


def with_usd(rows: DataFrame, rate: float = USD_PER_UNIT) -> DataFrame:
    return rows.selectExpr(
        "*", f"coalesce(CAST(heavy_units_sum AS DOUBLE), 0D) * {float(rate)}D AS usd_per_min"
    )


def minute_cost(
    cost: DataFrame, minutes: int, rate: float = USD_PER_UNIT, newest: int | None = None
) -> DataFrame:
    """The trailing window of a cost table as one row per minute."""
    recent = trailing_window(cost, "minute_ts", minutes, newest=newest)
    series = recent.groupBy("minute_ts").agg(
        *exprs(
            "sum(queries_count) AS queries_count",
            "sum(coalesce(heavy_units_sum, 0D)) AS heavy_units_sum",
        )
    )
    return with_usd(series, rate)


def cost_summary(series: DataFrame, minutes: int) -> DataFrame:
    """Current rate, change, window total, average and projections as one row (zeros if empty)."""
    steps = series.selectExpr("*", f"lag(usd_per_min) OVER ({IN_TIME}) AS before")
    ends = steps.selectExpr(
        "coalesce(max_by(usd_per_min, minute_ts), 0D) AS now",
        "max_by(before, minute_ts) AS before",
        "coalesce(sum(usd_per_min), 0D) AS window_usd",
    )
    average = f"window_usd / {float(minutes)}D"
    return ends.selectExpr(
        "now AS current_usd_per_min",
        "coalesce((now - before) / greatest(before, 1e-9D) * 100D, 0D) AS delta_pct",
        "window_usd",
        f"{average} AS avg_usd_per_min",
        f"{average} * {DAY_MINUTES} AS run_rate_per_day",
        f"{average} * {DAY_MINUTES} AS projected_24h",
        f"{average} * {DAY_MINUTES} * 7 AS projected_7d",
    )


def with_gap_minutes(series: DataFrame, minutes: int) -> DataFrame:
    """Minutes since the previous row, within [0, window]. The first row takes the second row's gap; a
    lone row has none."""
    own = timeops.minutes_between("minute_ts", f"lag(minute_ts) OVER ({IN_TIME})")
    following = timeops.minutes_between(f"lead(minute_ts) OVER ({IN_TIME})", "minute_ts")
    stepped = series.selectExpr("*", f"coalesce({own}, {following}) AS gap")
    clipped = f"CASE WHEN gap IS NOT NULL THEN least(greatest(gap, 0D), {float(minutes)}D) END"
    return stepped.selectExpr(*series.columns, f"{clipped} AS gap_minutes")


def cost_rate_elapsed(series: DataFrame, minutes: int) -> DataFrame:
    """Average rate over the minutes that the rows really span."""
    totals = with_gap_minutes(series, minutes).selectExpr(
        "coalesce(sum(usd_per_min), 0D) AS window_usd",
        f"coalesce(sum(gap_minutes), {float(minutes)}D) AS elapsed_minutes",
    )
    rate = "window_usd / greatest(elapsed_minutes, 1e-9D)"
    return totals.selectExpr("*", f"{rate} AS avg_rate", f"{rate} * {DAY_MINUTES} AS projected_day")


def query_totals(cost: DataFrame, minutes: int, newest: int | None = None) -> DataFrame:
    """Queries of all time and of the trailing window, in one pass."""
    newest = bounds.latest(cost, "minute_ts") if newest is None else newest
    start = timeops.at(bounds.minutes_before(newest, minutes))
    n = "coalesce(queries_count, 0L)"
    return cost.selectExpr(
        f"coalesce(sum({n}), 0L) AS queries_total",
        f"coalesce(sum(CASE WHEN minute_ts >= {start} THEN {n} END), 0L) AS queries_window",
    )


def moving_average(series: DataFrame, rows: int = 5) -> DataFrame:
    frame = f"{IN_TIME} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW"
    return series.selectExpr("*", f"avg(usd_per_min) OVER ({frame}) AS usd_ma")


def cost_spikes(series: DataFrame) -> DataFrame:
    """Severity of each minute against its recent mean, in sample deviations; flat or short series are calm."""
    frame = f"({IN_TIME} ROWS BETWEEN {SPIKE_ROWS - 1} PRECEDING AND CURRENT ROW)"
    measured = series.selectExpr(
        "*",
        f"avg(usd_per_min) OVER {frame} AS mu",
        f"nullif(stddev_samp(usd_per_min) OVER {frame}, 0D) AS sigma",
        f"count(usd_per_min) OVER {frame} >= {SPIKE_MIN_ROWS} AND count(*) OVER () >= {SPIKE_ROWS} AS enough",
    )
    z = "CASE WHEN enough THEN (usd_per_min - mu) / sigma END"
    scored = measured.selectExpr(*series.columns, f"greatest(coalesce({z}, 0D), 0D) AS severity")
    return scored.selectExpr("*", f"severity >= {SPIKE_Z} AS is_spike")


def cost_distribution(series: DataFrame) -> DataFrame:
    """Box-plot numbers of the rate: quartiles, whiskers within 1.5 IQR, outliers beyond."""
    quartiles = "percentile(usd_per_min, array(0.25, 0.5, 0.75)) OVER ()"
    rows = series.selectExpr("usd_per_min AS x", f"{quartiles} AS q")
    inside = "x BETWEEN q[0] - 1.5D * (q[2] - q[0]) AND q[2] + 1.5D * (q[2] - q[0])"
    return rows.selectExpr(
        "first(q[0]) AS q1",
        "first(q[1]) AS median",
        "first(q[2]) AS q3",
        f"min(CASE WHEN {inside} THEN x END) AS whisker_low",
        f"max(CASE WHEN {inside} THEN x END) AS whisker_high",
        f"count_if(NOT ({inside})) AS outliers",
    )


def cumulative_cost(series: DataFrame, minutes: int) -> DataFrame:
    """Running sum of rate times gap; a lone row shows its rate."""
    frame = f"{IN_TIME} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    step = "usd_per_min * coalesce(gap_minutes, 1D)"
    return with_gap_minutes(series, minutes).selectExpr("*", f"sum({step}) OVER ({frame}) AS cum_cost")


def resample_interpolate(
    series: DataFrame, minutes: int, step_seconds: int = GRID_SECONDS, value: str = "usd_per_min"
) -> DataFrame:
    """Mean per grid step with gaps filled linearly in time, cut to the trailing window.

    Each step generates the points up to the next one, so no grid table is joined.
    """
    bins = (
        series.selectExpr(f"{timeops.floor_to('minute_ts', step_seconds)} AS t0", "minute_ts", value)
        .groupBy("t0")
        .agg(*exprs(f"avg({value}) AS y0", "max(minute_ts) AS newest"))
        .selectExpr(
            "t0",
            "y0",
            "lead(t0) OVER (ORDER BY t0) AS t1",
            "lead(y0) OVER (ORDER BY t0) AS y1",
            "max(newest) OVER () AS newest",
        )
    )
    last = f"coalesce(timestamp_micros(unix_micros(t1) - {step_seconds * 1_000_000}L), t0)"
    points = bins.selectExpr("*", f"explode(sequence(t0, {last}, INTERVAL {step_seconds} SECONDS)) AS t")
    share = f"{timeops.minutes_between('t', 't0')} / {timeops.minutes_between('t1', 't0')}"
    return points.where(
        f"t BETWEEN {timeops.plus_minutes('newest', -minutes)} AND newest"
    ).selectExpr("t", f"coalesce(y0 + (y1 - y0) * {share}, y0) AS y")
