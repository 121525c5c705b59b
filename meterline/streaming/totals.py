"""Streamed totals that take late rows: what a micro-batch adds is stored beside what earlier ones added.

A batch is aggregated by key, and the partial sums are written as a delta, a folder of its own by day. Reading merges the
deltas of a key, so a row counts in its minute however late it comes, closed minutes are corrected by the next read, and no
row is dropped behind a watermark. The work of a batch depends on its rows alone.

``entries`` lists the deltas that count. An entry is one file, written after its deltas, so a batch counts whole or not
at all; a batch that is delivered again finds its entry and adds nothing. Every ``FANOUT`` deltas of a level are merged
into one of the next, whose entry takes the place of theirs, so a read opens few folders and a value is rewritten once a
level. Entries belong to the checkpoint they came from: a new checkpoint reads its source anew, and its first entry takes
the place of all earlier ones.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.functions import exprs
from meterline.functions.aggregates import as_double, score_sum
from meterline.operators import bounds, kpis
from meterline.operators.leaderboard import dimension_totals, rank_totals
from meterline.sources import tables

FANOUT = 16
ENTRY = "generation STRING, level INT, last_batch LONG, folder STRING, covers ARRAY<STRING>, rows LONG, late_rows LONG, newest LONG"


@dataclass(frozen=True)
class Totals:
    """``add`` aggregates rows by ``keys``, the first of which is a time; ``finish`` makes the output of merged totals.

    Measures are merged as sums, those in ``largest`` as maxima.
    """

    keys: tuple[str, ...]
    add: Callable[[DataFrame], DataFrame]
    finish: Callable[[DataFrame], DataFrame]
    largest: tuple[str, ...] = field(default=())

    def merge(self, parts: DataFrame) -> DataFrame:
        """One row per key; measures keep their types, so merged parts can be merged again."""
        kept = {n: kind for n, kind in parts.dtypes if n not in (*self.keys, tables.PARTITION)}
        return parts.groupBy(*self.keys).agg(
            *exprs(*[f"CAST({'max' if n in self.largest else 'sum'}({n}) AS {kind}) AS {n}" for n, kind in kept.items()])
        )


EXACT = "exact_units"


def _minute_adds(keys: list[str], measures: dict[str, str]) -> Callable[[DataFrame], DataFrame]:
    """Sums instead of averages, and exact scores."""
    kept = {n: text for n, text in measures.items() if not n.endswith("_avg") and n != "heavy_units_sum"}
    return lambda rows: rows.where("minute_ts IS NOT NULL").groupBy(*keys).agg(*kpis.measures({**kept, EXACT: score_sum()}))


def _efficiency(merged: DataFrame) -> DataFrame:
    means = {n: f"{as_double(n.replace('_avg', '_sum'))} / queries_count" for n in ("exec_ms_avg", "queue_ms_avg")}
    units = {"heavy_units_sum": as_double(EXACT), "heavy_unit_avg": f"{as_double(EXACT)} / queries_count"}
    return kpis.finish_efficiency(merged.selectExpr("*", *[f"{text} AS {name}" for name, text in {**means, **units}.items()]))


def _workload(merged: DataFrame) -> DataFrame:
    return kpis.finish_workload(merged.selectExpr("*", f"{as_double(EXACT)} AS heavy_units_sum"))


EFFICIENCY = Totals(("minute_ts", "instance_id"), _minute_adds(["minute_ts", "instance_id"], kpis.EFFICIENCY_MEASURES), _efficiency)
WORKLOAD = Totals(
    tuple(kpis.WORKLOAD_KEYS), _minute_adds(kpis.WORKLOAD_KEYS, kpis.WORKLOAD_MEASURES), _workload,
    largest=("cluster_size_clean_max", "source_max_raw_id"),
)
LEADERBOARD = Totals(
    ("window_start", "window_end", "dimension_type", "dimension_value"),
    lambda rows: dimension_totals(rows).where("window_start IS NOT NULL"), rank_totals,
)


def generation_of(spark: SparkSession, checkpoint: str) -> str:
    """A name that lives as long as the checkpoint and is larger than those of earlier ones."""
    path = f"{checkpoint.rstrip('/')}/generation"
    if not tables.table_exists(spark, path):
        name = f"{time.time_ns() // 1000:020d}-{uuid.uuid4().hex[:8]}"
        spark.createDataFrame([(name,)], "generation STRING").coalesce(1).write.parquet(path)
    return spark.read.parquet(path).first()["generation"]


def entries(spark: SparkSession, root: str) -> list[Row]:
    """Entries that count: those of the newest generation which no other covers. A few per level."""
    path = f"{root}/entries"
    if not tables.table_exists(spark, path):
        return []
    found = spark.read.schema(ENTRY).parquet(path).collect()
    newest = max((r["generation"] for r in found), default=None)
    covered = {name for r in found for name in r["covers"]}
    return [r for r in found if r["generation"] == newest and r["folder"] not in covered]


def progress(spark: SparkSession, root: str) -> dict[str, int | None]:
    """Rows taken, rows that came after their minute had closed, and the newest arrival in microseconds."""
    found = entries(spark, root)
    newest = [r["newest"] for r in found if r["newest"] is not None]
    return {"rows": sum(r["rows"] for r in found), "late_rows": sum(r["late_rows"] for r in found), "newest": max(newest, default=None)}


def _note(spark: SparkSession, root: str, entry: tuple) -> None:
    spark.createDataFrame([entry], ENTRY).coalesce(1).write.mode("overwrite").parquet(f"{root}/entries/entry={entry[3]}")


def _parts(spark: SparkSession, root: str, name: str, folders: list[str], schema: T.StructType) -> DataFrame:
    placed = [T.StructField("delta", T.StringType()), T.StructField(tables.PARTITION, T.DateType())]
    reader = spark.read.schema(T.StructType([*schema.fields, *placed])).option("basePath", f"{root}/{name}")
    return reader.parquet(*[_delta(root, name, f) for f in folders]).drop("delta")


def _delta(root: str, name: str, folder: str) -> str:
    return f"{root}/{name}/delta={folder}"


def _write(part: DataFrame, totals: Totals, path: str) -> None:
    dated = part.withColumn(tables.PARTITION, F.to_date(totals.keys[0]))
    dated.repartition(tables.PARTITION).write.mode("overwrite").partitionBy(tables.PARTITION).parquet(path)


def writer(root: str, wanted: dict[str, Totals], checkpoint: str, gate_minutes: int = bounds.GATE_MINUTES) -> Callable[[DataFrame, int], None]:
    """Batch function for enriched rows. ``checkpoint`` is the stream's own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        generation = generation_of(spark, checkpoint)
        known = entries(spark, root)
        mine = [r for r in known if r["generation"] == generation]
        if any(r["last_batch"] >= batch_id for r in mine):
            return
        newest = max((r["newest"] for r in mine if r["newest"] is not None), default=None)
        gate = None if newest is None else bounds.minutes_before(bounds.minute_start(newest), gate_minutes)
        closed = "false" if gate is None else f"minute_ts <= {bounds.at(gate)}"
        batch = batch.persist()
        try:
            seen = batch.selectExpr("count(*) AS n", f"count_if({closed}) AS late", "unix_micros(max(arrival_timestamp)) AS newest").first()
            if not seen["n"]:
                return
            folder = f"{generation}-{batch_id:012d}"
            schemas = {}
            for name, totals in wanted.items():
                part = totals.add(batch)
                schemas[name] = part.schema
                _write(part, totals, _delta(root, name, folder))
            _note(spark, root, (generation, 0, batch_id, folder, [], seen["n"], seen["late"], seen["newest"]))
        finally:
            batch.unpersist()
        if known and not mine:
            for r in known:
                _remove(spark, root, r["folder"], wanted)
        _merge_levels(spark, root, wanted, schemas)

    return write


def _merge_levels(spark: SparkSession, root: str, wanted: dict[str, Totals], schemas: dict[str, T.StructType]) -> None:
    level = 0
    while len(full := [r for r in entries(spark, root) if r["level"] == level]) >= FANOUT:
        level += 1
        last = max(r["last_batch"] for r in full)
        folder = f"{full[0]['generation']}-{last:012d}-{level}"
        names = [r["folder"] for r in full]
        for name, totals in wanted.items():
            _write(totals.merge(_parts(spark, root, name, names, schemas[name])), totals, _delta(root, name, folder))
        newest = max((r["newest"] for r in full if r["newest"] is not None), default=None)
        counts = sum(r["rows"] for r in full), sum(r["late_rows"] for r in full)
        _note(spark, root, (full[0]["generation"], level, last, folder, names, *counts, newest))
        for old in names:
            _remove(spark, root, old, wanted)


def _remove(spark: SparkSession, root: str, folder: str, wanted: dict[str, Totals]) -> None:
    """Entry first: without it the deltas count no more."""
    for path in (f"{root}/entries/entry={folder}", *[_delta(root, name, folder) for name in wanted]):
        tables.remove(spark, path)


def read_totals(rows: DataFrame, root: str, name: str, totals: Totals, gate: int | None = None, since: int | None = None) -> DataFrame:
    """Merged and finished totals, up to the closed minute ``gate`` and from ``since`` on (both may be None).

    ``rows`` gives the columns of the stream; no row of it is read.
    """
    spark = rows.sparkSession
    schema = totals.add(rows.where("false")).schema
    folders = [r["folder"] for r in entries(spark, root)]
    if not folders:
        return totals.finish(totals.merge(spark.createDataFrame([], schema)))
    parts = _parts(spark, root, name, folders, schema)
    for limit, bound in (("<=", gate), (">=", since)):
        if bound is not None:
            parts = parts.where(f"{totals.keys[0]} {limit} {bounds.at(bound)} AND {tables.PARTITION} {limit} to_date({bounds.at(bound)})")
    return totals.finish(totals.merge(parts))


def closed_gate(spark: SparkSession, root: str, gate_minutes: int = bounds.GATE_MINUTES) -> int | None:
    """Newest closed minute of the stream so far."""
    newest = progress(spark, root)["newest"]
    return None if newest is None else bounds.minutes_before(bounds.minute_start(newest), gate_minutes)
