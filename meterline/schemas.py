"""Column contracts of every table, from trace row to KPI."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names and types of a trace row.
TRACE = T.StructType(
    [
        T.StructField("instance_id", T.IntegerType()),
        T.StructField("user_id", T.IntegerType()),
        T.StructField("database_id", T.IntegerType()),
        T.StructField("query_id", T.LongType()),
        T.StructField("cluster_size", T.DoubleType()),
        T.StructField("arrival_timestamp", T.TimestampType()),
        T.StructField("compile_duration_ms", T.DoubleType()),
        T.StructField("queue_duration_ms", T.DoubleType()),
        T.StructField("execution_duration_ms", T.DoubleType()),
        T.StructField("feature_fingerprint", T.StringType()),
        T.StructField("was_aborted", T.IntegerType()),
        T.StructField("was_cached", T.IntegerType()),
        T.StructField("query_type", T.StringType()),
        T.StructField("num_permanent_tables_accessed", T.DoubleType()),
        T.StructField("num_external_tables_accessed", T.DoubleType()),
        T.StructField("num_system_tables_accessed", T.DoubleType()),
        T.StructField("mbytes_scanned", T.DoubleType()),
        T.StructField("mbytes_spilled", T.DoubleType()),
        T.StructField("num_joins", T.DoubleType()),
        T.StructField("num_scans", T.DoubleType()),
        T.StructField("num_aggregations", T.DoubleType()),
        T.StructField("read_table_ids", T.StringType()),
        T.StructField("write_table_ids", T.StringType()),
    ]
)

# A message as any broker or file source delivers it.
MESSAGE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ]
)

# The landing table. ``id`` orders arrivals; ``event`` is one JSON object with its types.
LANDING = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("event", T.VariantType()),
        T.StructField("ingest_ts", T.TimestampType()),
        T.StructField("kafka_topic", T.StringType()),
        T.StructField("kafka_partition", T.IntegerType()),
        T.StructField("kafka_offset", T.LongType()),
        T.StructField("kafka_key", T.StringType()),
    ]
)

MESSAGE_KEY = ["kafka_topic", "kafka_partition", "kafka_offset"]

STAGED_COLUMNS = ["raw_id"] + [
    f.name for f in TRACE.fields if f.name not in ("read_table_ids", "write_table_ids")
] + ["has_read", "has_write"]

# The 28 columns of the cleaned fact, in table order.
CLEAN_COLUMNS = [
    "raw_id", "instance_id", "user_id", "database_id", "query_id", "arrival_timestamp", "minute_ts",
    "compile_duration_ms", "queue_duration_ms", "execution_duration_ms", "mbytes_scanned",
    "mbytes_spilled", "feature_fingerprint", "is_unknown_fingerprint", "was_aborted", "was_cached",
    "query_type", "num_permanent_tables_accessed", "num_external_tables_accessed",
    "num_system_tables_accessed", "cluster_size_clean", "has_read", "has_write",
    "query_end_timestamp", "access_scope", "workload_is_system_metadata", "workload_classification",
    "heavy_unit",
]
