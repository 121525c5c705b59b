"""Trace files and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from meterline.operators import bounds
from meterline.operators.ingest import require_column

PARTITION = "event_date"


def read_trace(
    spark: SparkSession, path: str, time_col: str = "arrival_timestamp", schema: T.StructType | None = None
) -> DataFrame:
    """A Parquet trace; fails early, naming the columns, if the time column is absent."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    trace = reader.parquet(path)
    require_column(trace, time_col)
    return trace


def read_table(spark: SparkSession, source: str) -> DataFrame:
    """A stored table by path or catalog name. Errors propagate."""
    return spark.read.parquet(source) if "/" in source else spark.table(source)


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it lies; nothing happens if it is gone."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _by_day(rows: DataFrame, time_col: str) -> DataFrame:
    """Rows with their day, brought together by day and sorted by time.

    A rebalance merges small days into few tasks and splits a day that holds much of the data over
    many, from the sizes seen at run time. Sorted files have row groups of short time spans.
    """
    dated = rows.withColumn(PARTITION, F.to_date(time_col))
    return dated.hint("rebalance", F.col(PARTITION)).sortWithinPartitions(PARTITION, time_col)


def _write(rows: DataFrame, path: str, mode: str, overwrite: str) -> None:
    writer = rows.write.mode(mode).option("partitionOverwriteMode", overwrite)
    writer.partitionBy(PARTITION).parquet(path)


def write_by_day(rows: DataFrame, path: str, time_col: str) -> None:
    """The whole table anew, one folder per day."""
    _write(_by_day(rows, time_col), path, "overwrite", "static")


def append_by_day(rows: DataFrame, path: str, time_col: str) -> None:
    _write(_by_day(rows, time_col), path, "append", "static")


def overwrite_days(rows: DataFrame, path: str, time_col: str) -> None:
    """Replace exactly the days present in ``rows``; other days stay untouched.

    Spark stages the new files and swaps folders after all tasks are done, so a lost executor only
    repeats tasks, and ``rows`` may be computed from the very table being changed.
    """
    _write(_by_day(rows, time_col), path, "overwrite", "dynamic")


def replace_since(batch: DataFrame, path: str, time_col: str, bound: int | None) -> None:
    """Store ``batch`` as the table's content from ``bound`` on.

    Only the day that ``bound`` cuts is partly kept; it is read back and rewritten with the batch.
    """
    spark = batch.sparkSession
    if bound is None or not table_exists(spark, path):
        write_by_day(batch, path, time_col)
        return
    start = bounds.at(bound)
    cut_day = spark.read.parquet(path).where(
        f"{PARTITION} = to_date({start}) AND {time_col} < {start}"
    )
    kept = cut_day.select(*batch.columns)
    overwrite_days(kept.unionByName(batch), path, time_col)
