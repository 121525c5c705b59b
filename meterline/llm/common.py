"""Shared parts of the training-data operators: scratch tables, running totals, byte-level word arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 19
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: lineage ends here and rows are fixed."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: str = "text") -> Column:
    """Number of words of a text column (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def running_total(df: DataFrame, groups: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one, per group in the given order.

    A group may hold most rows, so none is gathered: rows are range-partitioned by group and order, each range is
    summed, the few range sums give every range its start, and only rows of one range are ordered in one task.
    """
    n = partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *groups, *order).withColumn("_range", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    sums = ranged.groupBy("_range", *groups).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "_range", *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start")
    )
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy("_range", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = counted.join(starts.withColumnRenamed("_range", "_r"), same)
    return joined.withColumn(out, F.col("_start") + F.col("_inside")).drop(
        "_range", "_r", "_start", "_inside", *[f"_g{i}" for i in range(len(groups))]
    )


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about ``limit`` bytes of ``column``; a longer row stands alone."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, one after the other, and the offsets of its rows (null: empty)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of ``inside`` bytes that do not cross a row's end."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the words, that is of runs without the bytes 0x20 and 0x09 to 0x0D."""
    return spans(~_SPACE[data], offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever the span lies. Spans rise and do not overlap.

    Works on runs of spans of about _CHUNK bytes, so memory beyond ``data`` does not grow with it.
    """
    global _powers
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        begin = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, begin + _CHUNK, "right")))
        piece = data[begin : ends[j - 1]]
        if len(_powers[0]) <= len(piece):
            n = max(len(piece), _CHUNK) + 1
            up, down = np.full(n, _BASE, np.uint64), np.full(n, _UNBASE, np.uint64)
            up[0] = down[0] = 1
            _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
        up, down = _powers
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=total[1:])
        a, b = starts[i:j] - begin, ends[i:j] - begin
        out[i:j] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out
