"""Cluster heat: loads of the busiest clusters over time buckets.

Cells are aggregated first, so everything after :func:`bucket_totals` works on
``clusters x buckets in the window`` rows, and after :func:`top_clusters` on at most 50 clusters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions import exprs, timeops

HOME_TOP, PAGE_TOP = 12, 15
# Metrics a heat map can show.
METRICS = (
    "heavy_units_sum", "queries_count", "scanned_mb_sum", "spilled_mb_sum", "exec_ms_sum", "queue_ms_sum",
)
COMBINE = {"sum": "sum", "mean": "avg"}


def bucket_totals(
    rows: DataFrame, metric: str, bucket_minutes: int = 5, how: str = "sum"
) -> DataFrame:
    """``cluster, bucket_ts, value``: a metric summed (or averaged) per cluster and time bucket."""
    if metric not in rows.columns:
        raise ValueError(f"metric '{metric}' not found. Available: {rows.columns}")
    return (
        rows.where("instance_id IS NOT NULL")
        .selectExpr(
            "CAST(instance_id AS STRING) AS cluster",
            f"{timeops.floor_to('minute_ts', bucket_minutes * 60)} AS bucket_ts",
            f"CAST({metric} AS DOUBLE) AS value",
        )
        .groupBy("cluster", "bucket_ts")
        .agg(F.expr(f"{COMBINE[how]}(value) AS value"))
    )


def top_clusters(
    rows: DataFrame, top: int = PAGE_TOP, how: str = "sum", cluster: str = "cluster", value: str = "value"
) -> DataFrame:
    """The ``top`` clusters by total (or mean) value, ties by name."""
    return (
        rows.where(f"{cluster} IS NOT NULL")
        .groupBy(F.expr(f"CAST({cluster} AS STRING) AS cluster"))
        .agg(F.expr(f"{COMBINE[how]}(CAST({value} AS DOUBLE)) AS total"))
        .orderBy(F.col("total").desc_nulls_last(), "cluster")
        .limit(top)
    )


def keep_clusters(cells: DataFrame, clusters: DataFrame) -> DataFrame:
    return cells.join(clusters.select("cluster"), "cluster", "left_semi")


def heat_grid(cells: DataFrame) -> DataFrame:
    """Every kept cluster at every bucket that any of them has, 0 where a cluster has no value.

    ``cluster_position`` orders clusters by their value in the newest bucket. Each bucket is one row with the
    values of its clusters, and gets the ordered cluster list (a few dozen names) from a one-row subquery, so
    the work is linear in the buckets and spread over tasks.
    """
    newest = cells.groupBy("cluster").agg(*exprs("max(bucket_ts) AS last", "max_by(value, bucket_ts) AS value"))
    named = newest.groupBy().agg(
        *exprs("collect_list(struct(cluster, last, value)) AS found", "max(last) AS hi")
    )
    ranked = "transform(found, c -> struct(if(c.last = hi, 0D - coalesce(c.value, 0D), 0D) AS below, c.cluster AS cluster))"
    names = named.select(F.expr(f"transform(sort_array({ranked}), c -> c.cluster) AS names"))
    buckets = cells.groupBy("bucket_ts").agg(
        F.expr("map_from_entries(collect_list(struct(cluster, value))) AS own")
    )
    grid = buckets.select("bucket_ts", "own", F.posexplode(names.scalar()).alias("at", "cluster"))
    return grid.selectExpr(
        "cluster", "bucket_ts", "coalesce(own[cluster], 0D) AS value", "at + 1 AS cluster_position"
    )


def normalize_per_cluster(grid: DataFrame) -> DataFrame:
    """Values of a cluster scaled to 0-1; a flat cluster becomes 0."""
    own = "OVER (PARTITION BY cluster)"
    spanned = grid.selectExpr("*", f"min(value) {own} AS low", f"max(value) {own} AS high")
    scaled = "(value - low) / coalesce(nullif(high - low, 0D), 1D)"
    return spanned.selectExpr(*[f"{scaled} AS value" if c == "value" else c for c in grid.columns])


def heat_scale(grid: DataFrame) -> DataFrame:
    """Adds ``shade``: the value clipped to the grid's 5th and 95th percentile, square-rooted.

    If both coincide the extremes are used, and a constant grid gets a range of 1.
    """
    marked = grid.selectExpr(
        "*",
        "percentile(value, array(0.05, 0.95)) OVER () AS q",
        "min(value) OVER () AS lo",
        "max(value) OVER () AS hi",
    )
    ends = marked.selectExpr(
        "*", "if(q[1] <= q[0], lo, q[0]) AS low", "if(q[1] <= q[0], hi, q[1]) AS top"
    )
    high = "if(top <= low, low + 1D, top)"
    return ends.selectExpr(*grid.columns, f"sqrt(least(greatest(value, low), {high})) AS shade")


def wide_grid(grid: DataFrame, clusters: list[str]) -> DataFrame:
    """One row per bucket, one column ``cluster_<name>`` per listed cluster (a bounded list), 0 where it has no value."""
    columns = [f"coalesce(sum(value) FILTER (WHERE cluster = '{c}'), 0D) AS `cluster_{c}`" for c in clusters]
    return grid.groupBy("bucket_ts").agg(*exprs(*columns))


def cluster_summary(cells: DataFrame, top: int = PAGE_TOP) -> DataFrame:
    return top_clusters(cells, top)


def cluster_series(cells: DataFrame, cluster: str) -> DataFrame:
    """One cluster's values in time order."""
    return cells.where(F.col("cluster") == str(cluster)).orderBy("bucket_ts")
