"""The stored tables and how a batch of new rows brings them up to date.

Layout under one root: ``clean`` (the fact plus the observed ``cluster_size``), ``instance_days`` (per
instance and day: first and last known cluster size, last id, newest arrival) and one folder per KPI, all
partitioned by day. Progress, gate and fill state come from ``instance_days``, never from a scan of the fact.

A refresh gives the same tables as recomputing everything, whatever the batch cuts and however late rows
arrive:

* In-order batches are appended. Their fill starts from the last size per instance in ``instance_days``, so no
  history is read.
* Late rows rewrite the days from the earliest late row on.
* The first size an instance ever reports changes its earlier rows (backward fill), so the days since
  that instance appeared are rewritten.
* KPIs are replaced from the earliest touched minute, or from the usual look-back if that is earlier.

``refresh_log`` makes a refresh safe to repeat. Before its first write a batch notes the bounds it will rewrite from;
after its last write it notes that it is done and the last id it took of each source. Progress is kept per source
(broker topic and partition), so a source whose offsets lag behind the others loses nothing. If a batch is found open,
the days from its bound on are computed again from the staged rows, which overwrites whatever it left half done, and the
KPIs are replaced from its bound too. The log is only appended to, in single commits.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.functions import exprs
from meterline.operators import bounds, kpis
from meterline.operators.clean import enrich
from meterline.operators.ingest import SOURCE_BITS
from meterline.operators.fill import FIRST_SIZE, LAST_SIZE, fill_cluster_size
from meterline.operators.leaderboard import leaderboard, resource_predators
from meterline.operators.staging import stage_events
from meterline.schemas import CLEAN_COLUMNS
from meterline.sources import tables

STORED_COLUMNS = CLEAN_COLUMNS + ["cluster_size"]
MINUTE_MICROS, DAY_MICROS = 60_000_000, 86_400_000_000
WINDOW_MICROS = 900_000_000
KPI_TIME = {
    "minute_cluster_workload": "minute_ts",
    "minute_concurrency_cluster": "minute_ts",
    "minute_query_efficiency": "minute_ts",
    "minute_shadow_cost": "minute_ts",
    "leaderboard_15m": "window_start",
    "resource_predator_15m": "window_start",
}
# days as text order, rows without a time last
DAY_ORDER = "coalesce(day, DATE'9999-12-31')"


@dataclass(frozen=True)
class Layout:
    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(Layout(root).path(table))


#: Files of a log from which on it is shortened.
LOG_FILES = 32
#: Up to so many sources have their progress written into the filter itself; more are joined.
LISTED_SOURCES = 256
LOG = "batch STRING, state STRING, source LONG, last_id LONG, since_minute LONG, since_window LONG"


def _log(spark: SparkSession, path: str, rows: list[tuple], mode: str = "append") -> None:
    """Log rows in one file, so that all of them appear or none."""
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode(mode).parquet(path)


def _note(spark: SparkSession, lay: Layout, rows: list[tuple], mode: str = "append") -> None:
    _log(spark, lay.path("refresh_log"), rows, mode)


def source_of(source_bits: int, id_col: str = "raw_id") -> str:
    """The source in the low bits of an id; without such bits all rows are one source."""
    return f"({id_col} & {(1 << source_bits) - 1}L)" if source_bits else "0L"


def _last_ids(rows: DataFrame, source_bits: int) -> list[tuple[int, int]]:
    """Source and largest id: one row per broker partition."""
    return [tuple(r) for r in rows.groupBy(F.expr(source_of(source_bits)).alias("s")).agg(F.max("raw_id")).collect()]


def _beyond(rows: DataFrame, log: DataFrame, source_bits: int, id_col: str = "raw_id") -> DataFrame:
    """Rows beyond the last id that the log has of their source; a source it does not know gives all of its rows.

    The filter names the sources and their last ids, so that it can act below what computes the other columns: of
    messages that are parsed on the way, those taken before are never parsed again.
    """
    done = log.where("state = 'done' AND source IS NOT NULL").groupBy("source").agg(F.max("last_id").alias("_last"))
    if not source_bits:
        last = done.first()
        return rows if last is None else bounds.new_rows(rows, last["_last"], id_col)
    known = done.limit(LISTED_SOURCES + 1).collect()
    if not known:
        return rows
    if len(known) <= LISTED_SOURCES:
        last_of = ", ".join(f"{r['source']}L, {r['_last']}L" for r in known)
        return rows.where(f"NOT coalesce({id_col} <= try_element_at(map({last_of}), {source_of(source_bits, id_col)}), false)")
    numbered = rows.withColumn("source", F.expr(source_of(source_bits, id_col))).join(done, "source", "left")
    return numbered.where(f"_last IS NULL OR {id_col} > _last").select(*rows.columns)


def _shorten(spark: SparkSession, path: str, most_files: int = LOG_FILES) -> None:
    """Once no batch is open: one row per source and the latest batch in place of all earlier rows.

    The short form is added before the files it stands for go. Reading both gives the same answers, so a failure in
    between does no harm.
    """
    log = spark.read.parquet(path)
    files = log.inputFiles()
    if len(files) <= most_files:
        return
    sources = log.where("source IS NOT NULL").groupBy("source").agg(F.max("last_id").alias("last_id"), F.max("batch").alias("batch"))
    rows = [(r["batch"], "done", r["source"], r["last_id"], None, None) for r in sources.collect()]
    latest = log.where("state = 'done'").agg(F.max("batch")).first()[0]
    spark.createDataFrame([*rows, (latest, "done", None, None, None, None)], LOG).coalesce(1).write.mode("append").parquet(path)
    for file in files:
        tables.remove(spark, file)


def _open(log: DataFrame) -> tuple[list[str], int | None, int | None]:
    """Batches begun and not done, and the earliest bounds they rewrite from (None: everything)."""
    rows = (
        log.groupBy("batch")
        .agg(*exprs("count_if(state = 'done') AS n", "min(since_minute) AS minute", "min(since_window) AS window"))
        .where("n = 0")
        .collect()
    )
    minutes, windows = [r["minute"] for r in rows], [r["window"] for r in rows]
    everything = not rows or None in minutes
    return [r["batch"] for r in rows], None if everything else min(minutes), None if everything else min(windows)


def store_staged(landing: DataFrame, root: str, source_bits: int = SOURCE_BITS) -> DataFrame:
    """Parse landing rows beyond those taken of their source once into the ``staged`` table, and read that table.

    A refresh reads its input several times; events should not be parsed as often. ``staged_log`` notes what was taken of
    each source. Rows that an attempt has stored without coming to note it are not stored again.
    """
    spark, lay = landing.sparkSession, Layout(root)
    path, log_path = lay.path("staged"), lay.path("staged_log")
    if not tables.table_exists(spark, log_path):
        _log(spark, log_path, [], "overwrite")
    log = spark.read.schema(LOG).parquet(log_path)
    fresh = _beyond(landing, log, source_bits, "id")
    if tables.table_exists(spark, path):
        unnoted = _beyond(spark.read.parquet(path), log, source_bits).select(F.col("raw_id").alias("id"))
        # only after a failure is there any; the join would shuffle whole events
        if not unnoted.isEmpty():
            fresh = fresh.join(unnoted, "id", "left_anti")
        tables.append_by_day(stage_events(fresh), path, "arrival_timestamp")
    else:
        tables.write_by_day(stage_events(fresh), path, "arrival_timestamp")
    stored = spark.read.parquet(path).drop(tables.PARTITION)
    batch = uuid.uuid4().hex
    taken = _last_ids(_beyond(stored, log, source_bits), source_bits)
    if taken:
        _log(spark, log_path, [(batch, "done", s, i, None, None) for s, i in taken])
        _shorten(spark, log_path)
    return stored


def full_refresh(staged: DataFrame, root: str, source_bits: int = 0, batch: str | None = None, **slicing) -> None:
    """Every table from scratch."""
    spark = staged.sparkSession
    lay = Layout(root)
    batch = batch or uuid.uuid4().hex
    last = _last_ids(staged, source_bits)
    _note(spark, lay, [(batch, "open", None, None, None, None)], mode="overwrite")
    clean = fill_cluster_size(enrich(staged), **slicing).select(*STORED_COLUMNS)
    tables.write_by_day(clean, lay.path("clean"), "arrival_timestamp")
    _store_instance_days(spark, lay, None)
    _refresh_kpis(spark, lay, bounds.gate_of(read(spark, root, "clean")), None, None)
    _note(spark, lay, [(batch, "done", None, None, None, None), *[(batch, "done", s, i, None, None) for s, i in last]])


def incremental_refresh(
    staged: DataFrame,
    root: str,
    minute_lookback: int = bounds.MINUTE_LOOKBACK,
    window_lookback: int = bounds.WINDOW_LOOKBACK,
    source_bits: int = 0,
    **slicing,
) -> bool:
    """Add the staged rows beyond those taken of their source. False if there are none and no batch is open.

    ``source_bits`` low bits of raw_id name the source; landed messages have ``ingest.SOURCE_BITS``. A redo reads
    the days it rewrites from ``staged``, which must still hold them.
    """
    spark = staged.sparkSession
    lay = Layout(root)
    if not tables.table_exists(spark, lay.path("refresh_log")):
        full_refresh(staged, root, source_bits, **slicing)
        return True
    taken = _beyond(staged, read(spark, root, "refresh_log"), source_bits)
    added = _add(staged, taken, lay, minute_lookback, window_lookback, source_bits, uuid.uuid4().hex, **slicing)
    _shorten(spark, lay.path("refresh_log"))
    return added


def add_batch(rows: DataFrame, root: str, generation: str, batch_id: int, source_bits: int = SOURCE_BITS, **slicing) -> bool:
    """Add the staged rows of one numbered batch of a stream. False if that batch was added before.

    The batch itself says what is new, so no table is searched for it: the work depends on the batch and on the days that
    late rows touch. Rows are appended to ``staged`` first, from where a batch that failed half-way is redone; a redelivered
    batch is appended again there and read once. Another ``generation`` (a new checkpoint, whose source starts anew)
    replaces all tables.
    """
    spark, lay, batch = rows.sparkSession, Layout(root), f"{generation}-{batch_id:012d}"
    known = [] if not tables.table_exists(spark, lay.path("refresh_log")) else read(spark, root, "refresh_log").select("batch", "state").collect()
    if any(r["batch"] == batch and r["state"] == "done" for r in known):
        return False
    rows = rows.dropDuplicates(["raw_id"]).persist()
    try:
        if not any(r["batch"].startswith(generation) and r["state"] == "done" for r in known):
            tables.write_by_day(rows, lay.path("staged"), "arrival_timestamp")
            full_refresh(rows, root, source_bits, batch, **slicing)
            return True
        tables.append_by_day(rows, lay.path("staged"), "arrival_timestamp")
        staged = read(spark, root, "staged")
        _add(staged, rows, lay, bounds.MINUTE_LOOKBACK, bounds.WINDOW_LOOKBACK, source_bits, batch, **slicing)
    finally:
        rows.unpersist()
    _shorten(spark, lay.path("refresh_log"))
    return True


def _add(
    staged: DataFrame, taken: DataFrame, lay: Layout, minute_lookback: int, window_lookback: int, source_bits: int, batch: str, **slicing
) -> bool:
    spark, root = staged.sparkSession, lay.root
    log = read(spark, root, "refresh_log")
    unfinished, open_minute, open_window = _open(log)
    days = read(spark, root, "instance_days") if not unfinished or open_minute is not None else None
    old = None if days is None else days.selectExpr("max(newest) AS newest", "count_if(day IS NULL) AS untimed").first()
    if old is None or old["newest"] is None:
        full_refresh(staged.select(*taken.columns).dropDuplicates(["raw_id"]), root, source_bits, batch, **slicing)
        return True
    last = _last_ids(taken, source_bits)
    if not last and not unfinished:
        return False
    fresh = enrich(taken)
    new = fresh.selectExpr(
        "unix_micros(min(arrival_timestamp)) AS first", "unix_micros(max(arrival_timestamp)) AS newest"
    ).first()

    # rows without a time stay last in the fill order, so they are refilled with any batch
    touched = old["newest"] if new["first"] is None else new["first"]
    newest = max(old["newest"], new["newest"] or old["newest"])
    in_order = not unfinished and not old["untimed"] and new["first"] is not None and new["first"] >= old["newest"]
    reach = _backfill_start(fresh, days, touched, in_order)
    append = in_order and reach is None
    touched = min(t for t in (touched, reach, open_minute) if t is not None)
    minute, window = touched - touched % MINUTE_MICROS, touched
    since_minute = min(minute, bounds.minutes_before(_gate(old["newest"]), minute_lookback))
    since_window = min(window, bounds.minutes_before(old["newest"], window_lookback))
    since_window -= since_window % WINDOW_MICROS
    if unfinished:
        # whole days: a day that the open batch left half replaced is not read back
        since_minute = min(since_minute, open_minute) // DAY_MICROS * DAY_MICROS
        since_window = min(since_window, open_window) // DAY_MICROS * DAY_MICROS

    _note(spark, lay, [(batch, "open", None, None, since_minute, since_window)])
    if append:
        rows = fill_cluster_size(fresh, seeds=_seeds(days, None), **slicing).select(*STORED_COLUMNS)
        tables.append_by_day(rows, lay.path("clean"), "arrival_timestamp")
    else:
        first_day = touched // DAY_MICROS * DAY_MICROS
        if unfinished:
            held = _from_day(staged, first_day) if tables.PARTITION in staged.columns else staged
            held = held.where(f"arrival_timestamp >= {bounds.at(first_day)} OR arrival_timestamp IS NULL")
            again = enrich(held.select(*taken.columns).dropDuplicates(["raw_id"]))
        else:
            again = _from_day(read(spark, root, "clean"), first_day).select(*fresh.columns).unionByName(fresh)
        rows = fill_cluster_size(again, seeds=_seeds(days, first_day), **slicing).select(*STORED_COLUMNS)
        tables.overwrite_days(rows, lay.path("clean"), "arrival_timestamp")
    _store_instance_days(spark, lay, touched)
    _refresh_kpis(spark, lay, _gate(newest), since_minute, since_window)
    done = [(b, "done", None, None, None, None) for b in (batch, *unfinished)]
    _note(spark, lay, done + [(batch, "done", s, i, None, None) for s, i in last])
    return True


def _gate(newest: int) -> int:
    return newest - newest % MINUTE_MICROS - bounds.GATE_MINUTES * MINUTE_MICROS


def _from_day(stored: DataFrame, micros: int) -> DataFrame:
    """Stored rows from a day on, with those that have no time."""
    return stored.where(f"event_date >= to_date({bounds.at(micros)}) OR event_date IS NULL")


def _store_instance_days(spark: SparkSession, lay: Layout, touched: int | None) -> None:
    """Summarize the days from ``touched`` on (or all); sizes are NULL on days without a known one."""
    clean = spark.read.parquet(lay.path("clean"))
    if touched is not None:
        clean = _from_day(clean, touched)
    summary = (
        clean.withColumnRenamed("event_date", "day")
        .groupBy("instance_id", "day")
        .agg(
            *exprs(
                f"{FIRST_SIZE} AS first_size",
                f"{LAST_SIZE} AS last_size",
                "max(raw_id) AS last_id",
                "unix_micros(max(arrival_timestamp)) AS newest",
                "coalesce(unix_micros(max(query_end_timestamp)), unix_micros(max(arrival_timestamp)), 0L) AS latest_end",
            )
        )
    )
    target = lay.path("instance_days")
    if touched is None:
        tables.write_by_day(summary, target, "day")
    else:
        tables.overwrite_days(summary, target, "day")


def _seeds(days: DataFrame, first_day: int | None) -> DataFrame:
    """Last known size per instance before a day (or of all days)."""
    earlier = days.where("last_size IS NOT NULL")
    if first_day is not None:
        earlier = earlier.where(f"day < to_date({bounds.at(first_day)})")
    return earlier.groupBy("instance_id").agg(F.expr(f"max_by(last_size, {DAY_ORDER}) AS seed_size"))


def _backfill_start(
    fresh: DataFrame, days: DataFrame, touched: int, in_order: bool
) -> int | None:
    """Earliest day whose rows get another backward fill from this batch; None if there is none.

    That happens to instances that had no known size before the batch's first day: if they had none at
    all, or if a late row brings a size other than the one their earlier rows took.
    """
    first_day = f"to_date({bounds.at(touched)})"
    unsized = (
        days.groupBy("instance_id")
        .agg(
            *exprs(
                "min(day) AS since",
                f"min_by(first_size, CASE WHEN first_size IS NOT NULL THEN {DAY_ORDER} END) AS taken",
                f"count_if(last_size IS NOT NULL AND day < {first_day}) AS earlier",
            )
        )
        .where(f"earlier = 0 AND since <= {first_day}")
    )
    brought = (
        fresh.where("cluster_size IS NOT NULL")
        .selectExpr("instance_id AS brought_id", "cluster_size")
        .distinct()
    )
    other = "" if in_order else "OR taken <> cluster_size"
    changed = brought.join(unsized, F.expr("brought_id <=> instance_id")).where(f"taken IS NULL {other}")
    return changed.selectExpr("unix_micros(CAST(min(since) AS TIMESTAMP)) AS m").first()["m"]


def still_running(clean: DataFrame, days: DataFrame, minute: int) -> DataFrame:
    """``clean`` from the first day on that has a query ending at ``minute`` or later (or ``minute``'s own day).

    Earlier days are not listed or read. Days stored without their latest end are kept.
    """
    if "latest_end" not in days.columns:
        return clean
    open_days = days.where(f"day IS NOT NULL AND (latest_end IS NULL OR latest_end >= {minute})")
    first = open_days.selectExpr("unix_micros(CAST(min(day) AS TIMESTAMP)) AS m").first()["m"]
    return clean.where(f"event_date >= to_date({bounds.at(min(minute, minute if first is None else first))})")


def _refresh_kpis(
    spark: SparkSession, lay: Layout, gate: int | None, minute: int | None, window: int | None
) -> None:
    clean = spark.read.parquet(lay.path("clean"))
    running = clean if minute is None else still_running(clean, read(spark, lay.root, "instance_days"), minute)
    fresh = {
        "minute_cluster_workload": lambda: kpis.minute_cluster_workload(clean, gate, minute),
        "minute_concurrency_cluster": lambda: kpis.minute_concurrency(running, gate, minute),
        "minute_query_efficiency": lambda: kpis.minute_query_efficiency(clean, gate, minute),
        "minute_shadow_cost": lambda: kpis.minute_shadow_cost(clean, gate, minute),
        "leaderboard_15m": lambda: leaderboard(clean, since=window),
        # the shares read the stored leaderboard, which the entry above has just replaced
        "resource_predator_15m": lambda: resource_predators(
            bounds.since(
                spark.read.parquet(lay.path("leaderboard_15m")).drop("event_date"), "window_start", window
            )
        ),
    }
    for name, compute in fresh.items():
        bound = minute if KPI_TIME[name] == "minute_ts" else window
        tables.replace_since(compute(), lay.path(name), KPI_TIME[name], bound)
