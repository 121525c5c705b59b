"""Minute KPIs of the cleaned fact. Each is one hash aggregate with map-side partial sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions import exprs, timeops
from meterline.functions.aggregates import as_double, ratio, score_sum, surrogate_key
from meterline.operators import bounds

PIECE_MINUTES = 1440  # no array of minutes is longer, however long a query runs

MINUTE_KEY = surrogate_key(timeops.key_text("minute_ts"), "instance_id")
WORKLOAD_KEY = surrogate_key(
    timeops.key_text("minute_ts"),
    "instance_id",
    "coalesce(workload_classification, 'UNKNOWN')",
    "coalesce(access_scope, 'UNKNOWN')",
    "coalesce(query_type, 'UNKNOWN')",
)
WORKLOAD_KEYS = ["minute_ts", "instance_id", "workload_classification", "access_scope", "query_type"]
# Aggregates per output column, shared by the batch and streaming forms.
WORKLOAD_MEASURES = {
    "queries_count": "count(*)",
    "heavy_units_sum": as_double(score_sum()),
    "scanned_mb_sum": "sum(mbytes_scanned)",
    "spilled_mb_sum": "sum(mbytes_spilled)",
    "exec_ms_sum": "sum(execution_duration_ms)",
    "queue_ms_sum": "sum(queue_duration_ms)",
    "cluster_size_clean_max": "max(cluster_size_clean)",
    "source_max_raw_id": "max(raw_id)",
}
EFFICIENCY_MEASURES = {
    "queries_count": "count(*)",
    "exec_ms_sum": "sum(execution_duration_ms)",
    "exec_ms_avg": "avg(execution_duration_ms)",
    "queue_ms_sum": "sum(queue_duration_ms)",
    "queue_ms_avg": "avg(queue_duration_ms)",
    "compile_ms_sum": "sum(compile_duration_ms)",
    "scanned_mb_sum": "sum(mbytes_scanned)",
    "spilled_mb_sum": "sum(mbytes_spilled)",
    "heavy_units_sum": as_double(score_sum()),
    "heavy_unit_avg": f"{as_double(score_sum())} / count(*)",
    "cached_queries": "count_if(was_cached = 1)",
    "aborted_queries": "count_if(was_aborted = 1)",
}


def measures(by_name: dict[str, str]):
    return exprs(*[f"{text} AS {name}" for name, text in by_name.items()])


def minute_cluster_workload(clean: DataFrame, gate: int | None, since: int | None = None) -> DataFrame:
    """Load per minute, instance, workload class, access scope and query type."""
    rows = bounds.fact_range(clean, gate, since)
    return finish_workload(rows.groupBy(*WORKLOAD_KEYS).agg(*measures(WORKLOAD_MEASURES)))


def finish_workload(aggregated: DataFrame) -> DataFrame:
    return aggregated.selectExpr(f"{WORKLOAD_KEY} AS kpi_key", *WORKLOAD_KEYS, *WORKLOAD_MEASURES)


def minute_query_efficiency(clean: DataFrame, gate: int | None, since: int | None = None) -> DataFrame:
    """Timings, volumes and waste per minute and instance. Needs no cluster size."""
    rows = bounds.fact_range(clean, gate, since)
    return finish_efficiency(rows.groupBy("minute_ts", "instance_id").agg(*measures(EFFICIENCY_MEASURES)))


def finish_efficiency(aggregated: DataFrame) -> DataFrame:
    return aggregated.selectExpr(
        f"{MINUTE_KEY} AS kpi_key",
        "minute_ts",
        "instance_id",
        *EFFICIENCY_MEASURES,
        f"{ratio('spilled_mb_sum', 'scanned_mb_sum')} AS spill_to_scan_ratio",
    )


def minute_cluster_size(clean: DataFrame, gate: int | None, since: int | None = None) -> DataFrame:
    """Largest cluster size seen per minute and instance."""
    rows = bounds.fact_range(clean, gate, since)
    return rows.groupBy("minute_ts", "instance_id").agg(
        F.expr("max(coalesce(cluster_size_clean, 0D)) AS cluster_size_clean_max")
    )


def minute_shadow_cost(clean: DataFrame, gate: int | None, since: int | None = None) -> DataFrame:
    """Cost units per minute and instance, also per node.

    Sums and cluster size share keys and input, so one aggregate gives both and no join is needed. An
    unknown instance has no cluster size (its size would never match in an equi-join) and counts as 0.
    """
    rows = bounds.fact_range(clean, gate, since)
    size = "max(CASE WHEN instance_id IS NOT NULL THEN cluster_size_clean END)"
    return finish_shadow_cost(
        rows.groupBy("minute_ts", "instance_id").agg(
            *measures(
                {
                    "queries_count": "count(*)",
                    "heavy_units_sum": as_double(score_sum()),
                    "cluster_size_clean_max": f"coalesce({size}, 0D)",
                }
            )
        )
    )


def shadow_cost_from_tables(efficiency: DataFrame, sizes: DataFrame) -> DataFrame:
    """The same table from a stored efficiency KPI and :func:`minute_cluster_size`."""
    joined = efficiency.select("minute_ts", "instance_id", "heavy_units_sum", "queries_count").join(
        sizes, ["minute_ts", "instance_id"], "left"
    )
    return finish_shadow_cost(
        joined.selectExpr(
            "minute_ts",
            "instance_id",
            "coalesce(queries_count, 0L) AS queries_count",
            "coalesce(heavy_units_sum, 0D) AS heavy_units_sum",
            "coalesce(cluster_size_clean_max, 0D) AS cluster_size_clean_max",
        )
    )


def finish_shadow_cost(scored: DataFrame) -> DataFrame:
    return scored.selectExpr(
        f"{MINUTE_KEY} AS kpi_key",
        "minute_ts",
        "instance_id",
        "queries_count",
        "heavy_units_sum",
        "cluster_size_clean_max",
        "heavy_units_sum AS cost_units_per_min",
        f"{ratio('heavy_units_sum', 'cluster_size_clean_max')} AS cost_units_per_min_per_node",
    )


def _with_end_minute(clean: DataFrame, gate: int | None) -> DataFrame:
    return bounds.fact_range(clean, gate).selectExpr(
        "raw_id",
        "instance_id",
        "minute_ts",
        "query_end_timestamp",
        f"{timeops.minute_of('query_end_timestamp')} AS end_minute",
        *[c for c in ("cluster_size_clean",) if c in clean.columns],
    )


def _pieces(first: str, last: str) -> str:
    """Array of (lo, hi) pieces of at most ``PIECE_MINUTES`` minutes that cover ``first`` to ``last``."""
    end = timeops.plus_minutes("p", PIECE_MINUTES - 1)
    starts = f"sequence({first}, {last}, INTERVAL {PIECE_MINUTES} MINUTES)"
    return f"transform({starts}, p -> struct(p AS lo, least({end}, {last}) AS hi))"


def active_minutes(clean: DataFrame, gate: int | None) -> DataFrame:
    """One row per query and minute it runs in, both ends included; reversed or unknown ends give none."""
    return (
        _with_end_minute(clean, gate)
        .where("end_minute >= minute_ts")
        .selectExpr("*", f"explode({_pieces('minute_ts', 'end_minute')}) AS piece")
        .selectExpr(
            "raw_id",
            "instance_id",
            "minute_ts AS start_minute",
            "end_minute",
            "explode(sequence(piece.lo, piece.hi, INTERVAL 1 MINUTE)) AS minute_ts",
        )
    )


def minute_concurrency(clean: DataFrame, gate: int | None, since: int | None = None) -> DataFrame:
    """Queries active, started and ended per minute and instance, and pressure per node.

    Queries are not expanded to their minutes. Each adds a start and an end mark; marks are summed per
    (instance, minute), and a running sum over that summary gives the active count. Minutes between two
    marks are generated from the summary only, so the work is bounded by the rows of the result, however
    long queries run. The cluster size of a minute rides along on the start marks, which saves a join.

    ``since`` (a full minute) recomputes from there on: queries that began earlier but still run then
    count as active.
    """
    rows = _with_end_minute(clean, gate)
    valid, own, start = "coalesce(end_minute >= minute_ts, false)", "true", "minute_ts"
    if since is not None:
        bound = timeops.at(since)
        rows = rows.where(f"query_end_timestamp >= {bound} OR minute_ts >= {bound}")
        own, start = f"(minute_ts >= {bound})", f"greatest(minute_ts, {bound})"
    size = f"CASE WHEN {own} AND instance_id IS NOT NULL THEN coalesce(cluster_size_clean, 0D) END"
    marks = rows.selectExpr(
        "instance_id",
        f"""inline(array(
            named_struct('minute_ts', {start}, 'up', CAST({valid} AS INT), 'down', 0,
                'started', CAST({valid} AND {own} AS INT), 'size', {size}),
            named_struct('minute_ts', CASE WHEN {valid} THEN end_minute END, 'up', 0, 'down', 1,
                'started', 0, 'size', CAST(NULL AS DOUBLE))))""",
    ).where("minute_ts IS NOT NULL")
    summed = marks.groupBy("instance_id", "minute_ts").agg(
        *exprs("sum(up) AS up", "sum(down) AS down", "sum(started) AS started", "max(size) AS size")
    )
    w = Window.partitionBy("instance_id").orderBy("minute_ts")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stepped = summed.withColumns(
        {
            "after": F.sum(F.expr("up - down")).over(running),
            "next_ts": F.lead("minute_ts").over(w),
        }
    )
    gap_start, gap_end = timeops.plus_minutes("minute_ts", 1), timeops.plus_minutes("next_ts", -1)
    gap = f"""CASE WHEN after > 0 AND {gap_end} >= {gap_start}
        THEN {_pieces(gap_start, gap_end)} ELSE array() END"""
    own_slot = "array(struct(minute_ts AS lo, minute_ts AS hi))"
    pieces = stepped.selectExpr("*", f"explode(concat({own_slot}, {gap})) AS piece")
    slots = pieces.selectExpr("*", "explode(sequence(piece.lo, piece.hi, INTERVAL 1 MINUTE)) AS slot")
    marked = "slot = minute_ts"
    # a query that ends in a minute still ran in it
    counted = slots.selectExpr(
        "slot AS minute_ts",
        "instance_id",
        f"after + if({marked}, down, 0L) AS active_queries",
        f"if({marked}, started, 0L) AS started_queries",
        f"if({marked}, down, 0L) AS ended_queries",
        f"if({marked}, size, NULL) AS cluster_size_clean_max",
    )
    return counted.where("active_queries > 0").selectExpr(
        f"{MINUTE_KEY} AS kpi_key",
        "*",
        f"{ratio('active_queries', 'cluster_size_clean_max')} AS query_pressure",
    )
