"""Minute KPIs and leaderboards over a stream of cleaned (or enriched) rows.

A minute is emitted once, when it closes. The watermark trails the newest arrival by the gate minus one
minute: a minute's window ends one minute after it starts, so exactly the minutes up to
``newest minute - gate`` are closed, as in batch. State is one row per open minute and key.

Rows behind the watermark are dropped here, and Spark counts them in its progress. Where late rows must correct closed
minutes, use ``streaming.totals`` (sums) or ``streaming.refresh`` (all tables), which drop none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions import exprs
from meterline.functions.aggregates import score_sum
from meterline.operators import bounds, kpis
from meterline.operators.leaderboard import DIMENSION_COLUMNS, WINDOW, rank_totals, unpivot_dimensions
from meterline.sources import tables
from meterline.streaming.totals import generation_of

LATENESS = "10 minutes"


def _per_minute(
    rows: DataFrame, keys: list[str], measures: dict[str, str], gate_minutes: int
) -> DataFrame:
    timed = rows.withWatermark("arrival_timestamp", f"{gate_minutes - 1} minutes")
    grouped = timed.groupBy(F.window("arrival_timestamp", "1 minute").alias("w"), *keys)
    return grouped.agg(*kpis.measures(measures)).selectExpr("w.start AS minute_ts", *keys, *measures)


def efficiency_stream(rows: DataFrame, gate_minutes: int = bounds.GATE_MINUTES) -> DataFrame:
    return kpis.finish_efficiency(
        _per_minute(rows, ["instance_id"], kpis.EFFICIENCY_MEASURES, gate_minutes)
    )


def workload_stream(rows: DataFrame, gate_minutes: int = bounds.GATE_MINUTES) -> DataFrame:
    keys = [k for k in kpis.WORKLOAD_KEYS if k != "minute_ts"]
    return kpis.finish_workload(_per_minute(rows, keys, kpis.WORKLOAD_MEASURES, gate_minutes))


def leaderboard_totals_stream(
    rows: DataFrame, width: str = WINDOW, lateness: str = LATENESS
) -> DataFrame:
    """Totals per closed window, dimension and value; ranks follow per batch."""
    timed = rows.select("arrival_timestamp", "heavy_unit", *DIMENSION_COLUMNS).withWatermark(
        "arrival_timestamp", lateness
    )
    keys = ["dimension_type", "dimension_value"]
    return (
        unpivot_dimensions(timed, ["arrival_timestamp", "heavy_unit"])
        .groupBy(F.window("arrival_timestamp", width).alias("w"), *keys)
        .agg(*exprs("count(*) AS queries_count", f"{score_sum()} AS exact_sum"))
        .selectExpr(
            "w.start AS window_start", "w.end AS window_end", *keys, "queries_count", "exact_sum"
        )
    )


def ranked_writer(path: str, checkpoint: str, top: int = 10) -> Callable[[DataFrame, int], None]:
    """Batch function: rank the windows a batch closes. All rows of a window close in the same batch."""
    write = closed_writer(path, checkpoint)

    def ranked(batch: DataFrame, batch_id: int) -> None:
        write(rank_totals(batch, top), batch_id)

    return ranked


def closed_writer(path: str, checkpoint: str) -> Callable[[DataFrame, int], None]:
    """Batch function: store closed rows, one folder per checkpoint and batch, so that a replayed batch replaces itself.

    A new ``checkpoint`` closes all minutes anew, so readers take the newest one's rows only. Rows are written from the
    tasks that hold them: another shuffle would evaluate the state again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        generation = generation_of(batch.sparkSession, checkpoint)
        batch.write.mode("overwrite").parquet(f"{path}/generation={generation}/batch_id={batch_id}")

    return write


def read_closed(spark, path: str) -> DataFrame:
    rows = tables.read_table(spark, path)
    newest = rows.selectExpr("max(generation)").first()[0]
    return rows.where(F.col("generation") == newest).drop("generation", "batch_id")
