"""Physical plans keep the shape that scales."""

import re

import pytest
from pyspark.sql import functions as F

from meterline.operators import bounds, clean, fill, heat_report, kpis, leaderboard
from meterline.operators.staging import stage_trace
from meterline.plans import catalog, refresh
from meterline.sources.telemetry import as_trace, read_events


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, staged, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stored"))
    refresh.full_refresh(staged, root)
    return refresh.read(spark, root, "clean")


BATCH = [n for n in catalog.REGISTRY if not n.startswith("stream_")]


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    text = plan(catalog.REGISTRY[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "Pandas" not in text


def test_leaderboard_scans_once_and_limits_ranks_before_the_shuffle(stored):
    text = plan(leaderboard.leaderboard(stored))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 2
    assert text.count("WindowGroupLimit") == 2 and "partial_sum" in text
    assert "SortAggregate" not in text


@pytest.mark.parametrize(
    "table,unused",
    [
        (kpis.minute_query_efficiency, "cluster_size_clean"),
        (kpis.minute_shadow_cost, "mbytes_scanned"),
        (kpis.minute_cluster_workload, "feature_fingerprint"),
        (kpis.minute_concurrency, "heavy_unit"),
    ],
)
def test_kpis_scan_once_and_prune(stored, table, unused):
    gate = bounds.gate_of(stored)
    start = bounds.minutes_before(gate, 2880)
    text = plan(table(stored, gate, start))
    assert text.count("FileScan") == 1 and "Join" not in text and "partial_" in text
    schema = re.search(r"ReadSchema: (\S+)", text).group(1)
    assert unused not in schema
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text, re.S).group(1)
    assert "arrival_timestamp" in pushed
    assert "event_date" in re.search(r"PartitionFilters: \[(.*?)\]", text, re.S).group(1)


def test_incremental_concurrency_reads_only_days_that_still_run(stored):
    gate = bounds.gate_of(stored)
    start = bounds.minutes_before(gate, 2880)
    days = stored.groupBy(F.to_date("arrival_timestamp").alias("day")).agg(
        F.expr("unix_micros(max(query_end_timestamp)) AS latest_end")
    )
    running = refresh.still_running(stored, days, start)
    text = plan(kpis.minute_concurrency(running, gate, start))
    assert re.search(r"event_date#\d+ >= ", re.search(r"PartitionFilters: \[(.*?)\]", text, re.S).group(1))
    full, pruned = (kpis.minute_concurrency(rows, gate, start) for rows in (stored, running))
    assert full.count() == pruned.count() > 0 and full.exceptAll(pruned).isEmpty()


def test_heat_grid_has_no_window_over_cells(spark):
    cells = spark.createDataFrame(
        [("1", 0, 2.0), ("1", 600, 1.0), ("2", 600, 5.0)], "cluster string, t long, value double"
    ).selectExpr("cluster", "timestamp_seconds(t) AS bucket_ts", "value")
    grid = heat_report.heat_grid(cells)
    assert "Window" not in plan(grid) and "CartesianProduct" not in plan(grid)
    got = sorted((r["cluster"], r["bucket_ts"].minute, r["value"], r["cluster_position"]) for r in grid.collect())
    assert got == [("1", 0, 2.0, 2), ("1", 10, 1.0, 2), ("2", 0, 0.0, 1), ("2", 10, 5.0, 1)]


def test_sliced_fill_shuffles_the_rows_once(stored):
    """The window and the join of carried sizes share one hash partitioning."""
    spark = stored.sparkSession
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = stored.select("raw_id", "instance_id", "arrival_timestamp", "cluster_size", "heavy_unit")
        text = plan(fill.fill_cluster_size(rows))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    wide = [line for line in text.splitlines() if "Exchange hashpartitioning(_instance" in line and "_slice" in line]
    assert "SortMergeJoin" in text and len(wide) <= 3  # rows, the summary's aggregate, the small carried side
    assert "SortAggregate" not in text


def test_row_features_need_no_shuffle(spark, sf_dir):
    trace = as_trace(read_events(spark, sf_dir))
    assert "Exchange" not in plan(clean.enrich(stage_trace(trace)))
