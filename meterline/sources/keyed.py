"""Tables with one row per key, in files of value ranges: an upsert rewrites only the files that hold its keys.

Layout: ``data/<write>/*.parquet`` never change once written; ``_versions/<n>`` lists the files of version n with the
range of their ``order`` column; ``_empty`` holds the columns. The newest finished version is the table, so a failure at
any write leaves the version before it, and repeating an upsert gives the same table. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.operators import merge
from meterline.session import shared_dir
from meterline.sources import tables

#: Ranges of a batch's values that are held against the files' ranges.
SPANS = 64


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


@contextmanager
def _once(rows: DataFrame) -> Iterator[DataFrame]:
    """``rows`` computed into a scratch folder that is removed afterwards, also on failure."""
    spark = rows.sparkSession
    scratch = shared_dir(spark, "keyed")
    try:
        rows.write.parquet(scratch)
        yield spark.read.schema(rows.schema).parquet(scratch)
    finally:
        tables.remove(spark, scratch)


def version(spark: SparkSession, path: str) -> int | None:
    """Number of the newest finished version, None without one."""
    fs, folder = _folder(spark, f"{path}/_versions")
    if not fs.exists(folder):
        return None
    numbers = [int(s.getPath().getName()) for s in fs.listStatus(folder)]
    done = [n for n in numbers if fs.exists(_folder(spark, f"{path}/_versions/{n}/_SUCCESS")[1])]
    return max(done, default=None)


def files(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """file, low, high, unordered (rows without a value) and rows of a version's files; the newest unless given."""
    at = version(spark, path) if at is None else at
    if at is None:
        raise ValueError(f"no finished table at {path}")
    return spark.read.parquet(f"{path}/_versions/{at}")


def _load(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    schema = spark.read.parquet(f"{path}/_empty").schema
    return spark.read.schema(schema).parquet(*[f"{path}/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """The table's rows; the plan holds the files of one version, so later upserts do not change it."""
    return _load(spark, path, [r[0] for r in files(spark, path, at).select("file").collect()])


def _short(file_path: str = "_metadata.file_path"):
    return F.regexp_extract(F.col(file_path), "(data/[^/]+/[^/]+)$", 1)


def _add_files(rows: DataFrame, path: str, order: str, parts: int | None) -> DataFrame:
    """Writes ``rows`` as files of ``order`` ranges and returns their entries; without ``parts`` sizes seen at run time
    decide their number."""
    folder = f"{path}/data/{uuid.uuid4().hex}"
    ranged = rows.repartitionByRange(parts, order) if parts else rows.repartitionByRange(order)
    ranged.sortWithinPartitions(order).write.parquet(folder)
    written = rows.sparkSession.read.schema(rows.schema).parquet(folder)
    return written.select(_short().alias("file"), F.col(f"`{order}`").alias("value")).groupBy("file").agg(
        F.min("value").alias("low"), F.max("value").alias("high"),
        F.count_if(F.col("value").isNull()).alias("unordered"), F.count(F.lit(1)).alias("rows"),
    )


def write(rows: DataFrame, path: str, order: str, parts: int | None = None) -> None:
    """``rows`` as the table's next version, whatever it held before. The columns of a table do not change.

    The rows are computed once, into scratch, since ranging reads its input twice.
    """
    with _once(rows) as stored:
        _write(stored, path, order, parts)


def _write(stored: DataFrame, path: str, order: str, parts: int | None) -> None:
    now = version(stored.sparkSession, path)
    stored.limit(0).write.mode("overwrite").parquet(f"{path}/_empty")
    entries = _add_files(stored, path, order, parts)
    entries.write.mode("overwrite").parquet(f"{path}/_versions/{0 if now is None else now + 1}")


def touched(batch: DataFrame, path: str, key: str, order: str) -> list[str]:
    """The files that hold keys of the batch.

    At most SPANS ranges of the batch's values leave the candidates; of these only the keys are read.
    """
    spark = batch.sparkSession
    value = batch.select(F.col(f"`{order}`").alias("value"))
    ranged = value.where("value is not null").repartitionByRange(SPANS, "value").withColumn("span", F.spark_partition_id())
    spans = ranged.groupBy("span").agg(F.min("value").alias("from"), F.max("value").alias("to"))
    listed = files(spark, path)
    near = listed.join(F.broadcast(spans), (F.col("low") <= F.col("to")) & (F.col("high") >= F.col("from")), "left_semi")
    names = {r[0] for r in near.select("file").collect()}
    if not value.where("value is null").isEmpty():
        names |= {r[0] for r in listed.where("unordered > 0").select("file").collect()}
    if not names:
        return []
    held = _load(spark, path, sorted(names)).select(F.col(f"`{key}`").alias("k"), _short().alias("file"))
    return sorted(r[0] for r in held.join(batch.select(F.col(f"`{key}`").alias("k")), "k", "left_semi").select("file").distinct().collect())


def upsert(batch: DataFrame, path: str, key: str, order: str, parts: int | None = None) -> list[str]:
    """Rows whose key is not in the batch, plus the batch, as the next version; returns the files it replaced.

    ``order`` is the column by which files are ranged: the key itself, or one that a key never changes (its minute).
    The batch is computed once, into scratch. Rows with a null key are only ever added; the batch's rows are taken as
    they are, so its keys should be distinct; an empty batch changes nothing.
    """
    spark, now = batch.sparkSession, version(batch.sparkSession, path)
    with _once(batch) as stored:
        if now is None:
            _write(stored, path, order, parts)
            return []
        if stored.isEmpty():
            return []
        old = touched(stored, path, key, order)
        entries = _add_files(merge.upsert_by_key(_load(spark, path, old), stored, key), path, order, parts)
        gone = spark.createDataFrame([(f,) for f in old], "file string")
        entries = files(spark, path, now).join(gone, "file", "left_anti").unionByName(entries)
        entries.write.mode("overwrite").parquet(f"{path}/_versions/{now + 1}")
        return old


def drop_old(spark: SparkSession, path: str) -> int:
    """Deletes what the newest version does not list, versions before it too, and returns the number of files. Not while
    a writer runs or a reader still needs an earlier version."""
    now = version(spark, path)
    kept = {r[0] for r in files(spark, path, now).select("file").collect()}
    fs, folder = _folder(spark, f"{path}/data")
    dropped = 0
    for write_folder in fs.listStatus(folder):
        for file in fs.listStatus(write_folder.getPath()):
            name = f"data/{write_folder.getPath().getName()}/{file.getPath().getName()}"
            if name.endswith(".parquet") and name not in kept:
                fs.delete(file.getPath(), False)
                dropped += 1
    for old in fs.listStatus(_folder(spark, f"{path}/_versions")[1]):
        if int(old.getPath().getName()) != now:
            fs.delete(old.getPath(), True)
    return dropped
