"""Query telemetry derived from the ``events`` table.

Every event becomes one executed query. The formulas are fixed so that the same trace can be written
in SQL; they cover each branch of the cleaning rules (empty fingerprints, aborted and cached queries,
an instance without any known cluster size, blank table lists).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The trace column formulas; ``k`` is the integer in ``props``.
TRACE_FORMULAS = {
    "raw_id": "event_id",
    "instance_id": "CAST(user_id % 8 AS INT)",
    "user_id": "CAST(CASE WHEN k <> 98 THEN user_id END AS INT)",
    "database_id": "CAST(user_id % 5 AS INT)",
    "query_id": "event_id",
    "cluster_size": "CASE WHEN event_id % 3 = 0 AND user_id % 8 <> 7 THEN 2D * (1 + (event_id div 3) % 4) END",
    "arrival_timestamp": "CAST(ts AS TIMESTAMP)",
    "compile_duration_ms": "k * 10D",
    "queue_duration_ms": "(event_id % 50) * 100D",
    "execution_duration_ms": "round(value * 1000)",
    "feature_fingerprint": "CASE WHEN k = 99 THEN '' ELSE concat('fp_', k % 20) END",
    "was_aborted": "CAST(event_type = 'error' AS INT)",
    "was_cached": "CAST(k % 10 = 0 AS INT)",
    "query_type": """CASE event_type WHEN 'click' THEN 'select' WHEN 'view' THEN 'unload'
        WHEN 'purchase' THEN 'insert' WHEN 'signup' THEN 'analyze' END""",
    "num_permanent_tables_accessed": "CAST(k % 4 AS DOUBLE)",
    "num_external_tables_accessed": "CASE WHEN k % 7 = 0 THEN 1D ELSE 0D END",
    "num_system_tables_accessed": "CASE WHEN k % 11 = 0 THEN 1D ELSE 0D END",
    "mbytes_scanned": "k * 150D",
    "mbytes_spilled": "CASE WHEN event_type = 'purchase' THEN k * 20D ELSE 0D END",
    "num_joins": "CAST(k % 3 AS DOUBLE)",
    "num_scans": "CAST(k % 5 AS DOUBLE)",
    "num_aggregations": "CAST(k % 2 AS DOUBLE)",
    "read_table_ids": "CASE WHEN event_type IN ('click', 'view', 'purchase') AND k % 5 <> 4 THEN '1,2' ELSE ' ' END",
    "write_table_ids": "CASE WHEN event_type = 'purchase' OR k % 6 = 0 THEN '3' ELSE '' END",
}


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def as_trace(events: DataFrame) -> DataFrame:
    """Events -> ``raw_id`` and trace columns."""
    # the JSON is read once per row, before the projection that uses it many times
    parsed = events.selectExpr("*", "CAST(get_json_object(props, '$.k') AS INT) AS k")
    return parsed.selectExpr(*[f"{formula} AS {name}" for name, formula in TRACE_FORMULAS.items()])


def read_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_trace(read_events(spark, sf_dir))
