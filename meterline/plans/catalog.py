"""Named queries over the telemetry derived from ``events``.

Every callable takes ``(spark, sf_dir)`` and reads the whole table. Values are brought to one output
form: whole numbers as BIGINT (as DOUBLE where they may be missing), timestamps without zone, doubles
rounded to 6 places. The 1e-9 added before
rounding moves exact decimal ties off the rounding edge, where the last floating digit would decide.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.functions import exprs, timeops
from meterline.operators import (
    board_report, bounds, clean, cost_report, efficiency_report, fill, heat_report, ingest, kpis,
    leaderboard, merge, selection, staging,
)
from meterline.plans import refresh
from meterline.schemas import MESSAGE
from meterline.session import shared_dir
from meterline.sources import keyed, streams, tables
from meterline.sources.telemetry import as_trace, read_events, read_telemetry
from meterline.streaming import ingest as stream_ingest
from meterline.streaming import kpis as stream_kpis
from meterline.streaming import refresh as stream_refresh
from meterline.streaming import totals as stream_totals

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Report windows. The test tables are sparse, so windows are days long where a dashboard has minutes.
DAY = 1440
COST_WINDOW, HEAT_WINDOW, GRID_WINDOW = 7 * DAY, DAY, DAY
HEAT_BUCKET, HEAT_TOP = 15, 5
# The share of history that incremental queries treat as already stored, by event time.
LATEST_DAYS = 3
NULLABLE_NUMBERS = ("user_id",)
# What becomes of a message in ingest_decode_edges, by the last digit of the event id; value is its own text.
DECODE_EDGES = (
    "concat(value, '\\n')", "concat(value, '\\t')", """concat(value, '{"b":2}')""", "concat(value, ' x}')",
    """concat(left(value, length(value) - 1), ',"query_id":', -query_id, '}')""", """concat(value, ',{"b":2}')""",
    "concat(value, '],[', value)", "'null'", """concat('  {"a":', value, '}')""", "concat('[', value, ']')",
)
# An object that ingest_types adds to each message.
PLAN = """concat(left(value, length(value) - 1), ',"plan":{"steps":[', raw_id % 7, ',"', query_id, '",', 0.5 + raw_id, '],"cached":',
    was_cached = 1, ',"none":null}}')"""
INSTANCES = 8
# Files of the stream with late rows.
LATE_FILES = 6
# Messages are made, parsed and staged by tasks of about this many rows, whatever row groups the events lie in.
TASK_ROWS = 100_000
# Messages of one file of stream_dedup: they bound its micro-batches.
FILE_ROWS = 500_000
# Offsets of the landed telemetry start this far apart, so that some partitions lag far behind others.
OFFSET_STEP = 1_000_000


def query(fn: Query) -> Query:
    """Register a query under its function name and bring its result to the output form."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return output_form(fn(spark, sf_dir))

    REGISTRY[fn.__name__] = run
    return run


def output_form(df: DataFrame) -> DataFrame:
    def column(f: T.StructField) -> str:
        if f.name in NULLABLE_NUMBERS:
            form = "CAST({c} AS DOUBLE)"
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            form = "CAST({c} AS BIGINT)"
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            form = "round(CAST({c} AS DOUBLE) + 1e-9D, 6)"
        elif isinstance(f.dataType, T.TimestampType):
            form = "CAST({c} AS TIMESTAMP_NTZ)"
        else:
            form = "{c}"
        return f"{form.format(c=f.name)} AS {f.name}"

    return df.selectExpr(*[column(f) for f in df.schema.fields])


# -- shared inputs -------------------------------------------------------------------------------


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stage_trace(read_telemetry(spark, sf_dir))


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.enrich(_staged(spark, sf_dir))


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_table(_staged(spark, sf_dir))


def _newest(spark: SparkSession, sf_dir: str) -> int | None:
    """Newest arrival; reads one column."""
    return bounds.latest(read_events(spark, sf_dir), "ts")


def _gate(spark: SparkSession, sf_dir: str) -> int | None:
    return bounds.gate_of(read_events(spark, sf_dir), time_col="ts")


def _closed_newest(spark: SparkSession, sf_dir: str, gate: int | None) -> int | None:
    """Newest closed minute that has rows; reads one column."""
    if gate is None:
        return None
    closed = read_events(spark, sf_dir).where(f"ts < {timeops.at(gate + bounds.MINUTE_MICROS)}")
    newest = bounds.latest(closed, "ts")
    return None if newest is None else bounds.minute_start(newest)


def _efficiency(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int | None]:
    gate = _gate(spark, sf_dir)
    table = kpis.minute_query_efficiency(_enriched(spark, sf_dir), gate)
    return table, _closed_newest(spark, sf_dir, gate)


def _cost_series(spark: SparkSession, sf_dir: str, minutes: int) -> DataFrame:
    # cost and efficiency tables agree on counts and heavy units; the latter needs no cluster sizes
    table, newest = _efficiency(spark, sf_dir)
    return cost_report.minute_cost(table, minutes, newest=newest)


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.leaderboard(_enriched(spark, sf_dir))


def _last_window(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int | None]:
    """Leaderboard from the newest window on, and that window's end."""
    newest = _newest(spark, sf_dir)
    if newest is None:
        return _board(spark, sf_dir), None
    start = newest - newest % 900_000_000
    return leaderboard.leaderboard(_enriched(spark, sf_dir), since=start), start + 900_000_000


def _workload_window(spark: SparkSession, sf_dir: str, minutes: int) -> DataFrame:
    gate = _gate(spark, sf_dir)
    newest = _closed_newest(spark, sf_dir, gate)
    since = bounds.minutes_before(newest, minutes)
    return kpis.minute_cluster_workload(_enriched_with_size(spark, sf_dir), gate, since)


def _enriched_with_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched rows with the observed size in place of the filled one, for reports on other measures."""
    return _enriched(spark, sf_dir).withColumnRenamed("cluster_size", "cluster_size_clean")


def _messages(spark: SparkSession, sf_dir: str, value: str = "value", tasks: int | None = None) -> DataFrame:
    """The trace as delivered messages: offsets follow event ids, instances are partitions.

    ``value`` may damage the message text; it sees the trace columns too. With ``tasks`` the events are dealt evenly
    over that many tasks first: ids lie together in a file, and a batch of them would be the work of a few.
    """
    trace = read_telemetry(spark, sf_dir) if tasks is None else as_trace(read_events(spark, sf_dir).repartition(tasks))
    encoded = ingest.encode_messages(trace, left_out=("raw_id",), keep=True)
    return encoded.selectExpr(
        "key",
        f"{value} AS value",
        "'telemetry' AS topic",
        "coalesce(instance_id, 0) AS partition",
        "raw_id AS offset",
    )


def _tasks(spark: SparkSession, sf_dir: str, rows: int = TASK_ROWS) -> int:
    """Tasks of about ``rows`` events."""
    return max(1, -(-read_events(spark, sf_dir).count() // rows))


def _stream_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read_events(spark, sf_dir).schema
    # a pattern, since a file stream does not take a single file as its folder
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    return clean.enrich(staging.stage_trace(as_trace(events)))


def _run_to_end(stream: DataFrame, write, work: str) -> None:
    stream_ingest.start(stream, write, f"{work}/checkpoint", once=True).awaitTermination()


# -- ingest --------------------------------------------------------------------------------------


@query
def ingest_prepare_trace(spark, sf_dir):
    trace = as_trace(tables.read_trace(spark, f"{sf_dir}/events.parquet", time_col="ts"))
    return ingest.prepare_trace(trace).select(
        "raw_id", "query_id", "instance_id", "arrival_timestamp"
    )


@query
def ingest_json_roundtrip(spark, sf_dir):
    landed = ingest.land(_messages(spark, sf_dir), "offset")
    return staging.stage_events(landed)


@query
def ingest_rejects(spark, sf_dir):
    """Aborted queries arrive cut off, cached ones empty, unloads as lists, the rest whole."""

    damaged = """CASE WHEN was_aborted = 1 THEN left(value, 40) WHEN was_cached = 1 THEN ''
        WHEN query_type = 'unload' THEN concat('[', value, ']') ELSE value END"""
    decoded = ingest.decode_messages(_messages(spark, sf_dir, damaged))
    return decoded.groupBy("partition").agg(
        *exprs("count_if(event IS NOT NULL) AS kept", "count_if(event IS NULL) AS rejected")
    )


@query
def ingest_sanitize(spark, sf_dir):
    """Bare NaN and infinity tokens in the message become NULL sizes and volumes."""
    poisoned = """CASE
        WHEN was_aborted = 1 THEN regexp_replace(value, '"cluster_size":[^,]*', '"cluster_size":NaN')
        WHEN query_type = 'insert' THEN regexp_replace(value, '"mbytes_scanned":[^,]*', '"mbytes_scanned":-Infinity')
        ELSE value END"""
    landed = ingest.land(_messages(spark, sf_dir, poisoned), "offset")
    return staging.stage_events(landed).select("raw_id", "cluster_size", "mbytes_scanned")


@query
def ingest_metadata(spark, sf_dir):
    """Origin columns and the copies of them inside the event; of the wall clock only that it is there."""
    inside = [f"try_variant_get(event, '$._kafka_{c}', 'string') AS event_{c}" for c in ("topic", "partition", "offset", "key")]
    stamped = "CAST(ingest_ts IS NOT NULL AND try_variant_get(event, '$._ingest_ts_utc', 'timestamp') IS NOT NULL AS INT) AS stamped"
    landed = ingest.land(_messages(spark, sf_dir))
    return landed.selectExpr("id", "kafka_topic", "kafka_partition", "kafka_offset", "kafka_key", *inside, stamped)


@query
def ingest_decode_edges(spark, sf_dir):
    """Every message lengthened, wrapped, doubled or cut as DECODE_EDGES says, and what the decoder makes of it."""
    value = "CASE " + " ".join(f"WHEN raw_id % 10 = {i} THEN {text}" for i, text in enumerate(DECODE_EDGES)) + " END"
    decoded = ingest.decode_messages(_messages(spark, sf_dir, value))
    inner = [f"try_variant_get(event, '$.{path}', 'double') AS {name}" for path, name in (("query_id", "plain_id"), ("a.query_id", "nested_id"))]
    return decoded.selectExpr("offset AS event_id", "CAST(event IS NOT NULL AS INT) AS valid", *inner)


@query
def ingest_types(spark, sf_dir):
    """JSON types of landed values, plain and nested, and numbers and lists read back from inside."""
    landed = ingest.land(_messages(spark, sf_dir, PLAN), "offset")
    kinds = [
        f"regexp_replace(schema_of_variant(try_variant_get(event, '$.{path}', 'variant')), '[^A-Z].*', '') AS {name}"
        for path, name in (
            ("instance_id", "whole_kind"), ("feature_fingerprint", "text_kind"), ("user_id", "missing_kind"), ("plan.steps", "list_kind"),
            ("plan.steps[1]", "item_kind"), ("plan.cached", "flag_kind"), ("plan.none", "null_kind"),
        )
    ]
    values = [
        "try_variant_get(event, '$.plan.steps[0]', 'bigint') AS first_step", "try_variant_get(event, '$.plan.steps[2]', 'double') AS last_step",
        "CAST(try_variant_get(event, '$.plan.cached', 'boolean') AS INT) AS cached",
    ]
    return landed.selectExpr("id", *kinds, *values)


@query
def ingest_idempotent(spark, sf_dir):
    """Half of the partitions were landed before; then everything is delivered twice."""
    rows = ingest.land(_messages(spark, sf_dir), "offset")
    landed = rows.where("kafka_partition >= 4")
    after = ingest.idempotent_append(rows.unionByName(rows), landed)
    return after.select("id", "kafka_topic", "kafka_partition", "kafka_offset", "kafka_key")


@query
def ingest_read_since(spark, sf_dir):
    """The next batch after the ids of all but the latest days."""
    events = read_events(spark, sf_dir)
    cut = bounds.minutes_before(_newest(spark, sf_dir), LATEST_DAYS * DAY)
    last = bounds.last_id(bounds.before(events, "ts", cut), "event_id")
    return ingest.read_since(read_telemetry(spark, sf_dir), last, id_col="raw_id").select(
        "raw_id", "instance_id", "arrival_timestamp"
    )


# -- staging and cleaning ------------------------------------------------------------------------


@query
def stage_telemetry(spark, sf_dir):
    return _staged(spark, sf_dir)


@query
def clean_access_scope(spark, sf_dir):
    return _enriched(spark, sf_dir).select("raw_id", "access_scope")


@query
def clean_workload(spark, sf_dir):
    return _enriched(spark, sf_dir).select(
        "raw_id", "workload_is_system_metadata", "workload_classification"
    )


@query
def clean_flags(spark, sf_dir):
    return _enriched(spark, sf_dir).select(
        "raw_id", "minute_ts", "feature_fingerprint", "is_unknown_fingerprint", "was_aborted", "was_cached"
    )


@query
def clean_end_timestamp(spark, sf_dir):
    return _enriched(spark, sf_dir).select("raw_id", "query_end_timestamp")


@query
def clean_heavy_unit(spark, sf_dir):
    return _enriched(spark, sf_dir).select("raw_id", "heavy_unit")


@query
def clean_cluster_median(spark, sf_dir):
    rows = _enriched(spark, sf_dir).select("raw_id", "instance_id", "cluster_size")
    return fill.attach_median(rows)


@query
def clean_ffill(spark, sf_dir):
    return fill.forward_fill(_fill_input(spark, sf_dir)).select("raw_id", "cluster_size_ff")


@query
def clean_bfill(spark, sf_dir):
    return fill.backward_fill(_fill_input(spark, sf_dir)).select("raw_id", "cluster_size_bf")


@query
def clean_cluster_size(spark, sf_dir):
    return fill.fill_cluster_size(_fill_input(spark, sf_dir)).select("raw_id", "cluster_size_clean")


def _fill_input(spark, sf_dir):
    return _enriched(spark, sf_dir).select(
        "raw_id", "instance_id", "arrival_timestamp", "cluster_size"
    )


@query
def clean_table(spark, sf_dir):
    return _clean(spark, sf_dir)


# -- incremental work ----------------------------------------------------------------------------


@query
def inc_closed_minutes(spark, sf_dir):
    rows = bounds.fact_range(_enriched(spark, sf_dir), _gate(spark, sf_dir))
    return rows.select("raw_id", "minute_ts", "instance_id")


@query
def inc_lookback(spark, sf_dir):
    """A stored efficiency table some days old, then the look-back range recomputed and replaced."""
    rows, gate = _enriched(spark, sf_dir), _gate(spark, sf_dir)
    old_gate = bounds.minutes_before(gate, LATEST_DAYS * DAY)
    stored = kpis.minute_query_efficiency(rows, old_gate)
    start = bounds.lookback_bound(stored.select("minute_ts"), "minute_ts", bounds.MINUTE_LOOKBACK)
    again = kpis.minute_query_efficiency(rows, gate, start)
    return merge.replace_since(stored, again, "minute_ts", start)


@query
def inc_upsert(spark, sf_dir):
    """Workload rows merged by key: the batch repeats a look-back range of the stored table."""
    rows, gate = _enriched_with_size(spark, sf_dir), _gate(spark, sf_dir)
    old_gate = bounds.minutes_before(gate, LATEST_DAYS * DAY)
    stored = kpis.minute_cluster_workload(rows, old_gate)
    batch = kpis.minute_cluster_workload(rows, gate, bounds.minutes_before(old_gate, DAY))
    return merge.upsert_by_key(stored, batch, "kpi_key").drop("cluster_size_clean_max")


@query
def inc_upsert_files(spark, sf_dir):
    """The same merge on a stored table that rewrites only files with keys of the batch, sizes filled."""
    rows, gate = _clean(spark, sf_dir), _gate(spark, sf_dir)
    old_gate = bounds.minutes_before(gate, LATEST_DAYS * DAY)
    path = shared_dir(spark, "workload")
    keyed.write(kpis.minute_cluster_workload(rows, old_gate), path, "minute_ts")
    batch = kpis.minute_cluster_workload(rows, gate, bounds.minutes_before(old_gate, DAY))
    keyed.upsert(batch, path, "kpi_key", "minute_ts")
    return keyed.read(spark, path)


@query
def inc_progress(spark, sf_dir):
    """Cleaned rows in two steps: the second starts after the last stored id, seeded with known sizes."""
    staged = _staged(spark, sf_dir)
    cut = bounds.minutes_before(_newest(spark, sf_dir), LATEST_DAYS * DAY)
    stored = clean.clean_table(bounds.before(staged, "arrival_timestamp", cut))
    last = bounds.last_id(bounds.before(read_events(spark, sf_dir), "ts", cut), "event_id")
    seeds = (
        staged.where(f"raw_id <= {last}")
        .groupBy("instance_id")
        .agg(F.expr(f"{fill.LAST_SIZE} AS seed_size"))
    )
    step = clean.clean_table(bounds.new_rows(staged, last), seeds=seeds)
    return stored.unionByName(step).select(
        "raw_id", "instance_id", "minute_ts", "cluster_size_clean", "workload_classification", "heavy_unit"
    )


# -- minute KPIs and leaderboards ----------------------------------------------------------------


@query
def kpi_cluster_workload(spark, sf_dir):
    return kpis.minute_cluster_workload(_clean(spark, sf_dir), _gate(spark, sf_dir))


@query
def kpi_active_minutes(spark, sf_dir):
    return kpis.active_minutes(_enriched(spark, sf_dir), _gate(spark, sf_dir))


@query
def kpi_concurrency(spark, sf_dir):
    return kpis.minute_concurrency(_clean(spark, sf_dir), _gate(spark, sf_dir))


@query
def kpi_cluster_size(spark, sf_dir):
    return kpis.minute_cluster_size(_clean(spark, sf_dir), _gate(spark, sf_dir))


@query
def kpi_efficiency(spark, sf_dir):
    return kpis.minute_query_efficiency(_enriched(spark, sf_dir), _gate(spark, sf_dir))


@query
def kpi_shadow_cost(spark, sf_dir):
    return kpis.minute_shadow_cost(_clean(spark, sf_dir), _gate(spark, sf_dir))


@query
def kpi_leaderboard_15m(spark, sf_dir):
    return _board(spark, sf_dir)


@query
def kpi_leaderboard_1d(spark, sf_dir):
    return leaderboard.leaderboard(_enriched(spark, sf_dir), width="1 day")


@query
def kpi_predator_15m(spark, sf_dir):
    return leaderboard.resource_predators(_board(spark, sf_dir))


@query
def kpi_surrogate_key(spark, sf_dir):
    """Key of every query's workload row."""
    return _enriched(spark, sf_dir).selectExpr("raw_id", f"{kpis.WORKLOAD_KEY} AS kpi_key")


# -- efficiency and cost reports -----------------------------------------------------------------


@query
def rep_trailing_window(spark, sf_dir):
    table, newest = _efficiency(spark, sf_dir)
    return selection.trailing_window(table, "minute_ts", COST_WINDOW, ordered=True, newest=newest)


@query
def rep_efficiency_rollup(spark, sf_dir):
    table, newest = _efficiency(spark, sf_dir)
    return efficiency_report.seconds_and_waste(
        efficiency_report.efficiency_rollup(table, COST_WINDOW, newest)
    )


@query
def rep_per_minute_mean(spark, sf_dir):
    table, _ = _efficiency(spark, sf_dir)
    return selection.per_minute_mean(
        table, "minute_ts", ["queries_count", "exec_ms_avg", "queue_ms_avg", "heavy_unit_avg"]
    )


def _latest_metrics(spark, sf_dir, skip_nulls):
    table, newest = _efficiency(spark, sf_dir)
    means = selection.per_minute_mean(
        selection.trailing_window(table, "minute_ts", COST_WINDOW, newest=newest),
        "minute_ts",
        ["queries_count", "exec_ms_avg", "queue_ms_avg", "scanned_mb_sum", "spill_to_scan_ratio"],
    )
    metrics = [c for c in means.columns if c != "minute_ts"]
    return selection.latest_and_delta(means, "minute_ts", metrics, skip_nulls)


@query
def rep_latest_delta(spark, sf_dir):
    return _latest_metrics(spark, sf_dir, skip_nulls=False)


@query
def rep_latest_nonnull_delta(spark, sf_dir):
    return _latest_metrics(spark, sf_dir, skip_nulls=True)


@query
def rep_cost_summary(spark, sf_dir):
    return cost_report.cost_summary(_cost_series(spark, sf_dir, COST_WINDOW), COST_WINDOW)


@query
def rep_cost_elapsed(spark, sf_dir):
    return cost_report.cost_rate_elapsed(_cost_series(spark, sf_dir, COST_WINDOW), COST_WINDOW)


@query
def rep_query_totals(spark, sf_dir):
    table, newest = _efficiency(spark, sf_dir)
    return cost_report.query_totals(table, COST_WINDOW, newest)


@query
def rep_moving_avg(spark, sf_dir):
    return cost_report.moving_average(_cost_series(spark, sf_dir, COST_WINDOW))


@query
def rep_cost_spikes(spark, sf_dir):
    return cost_report.cost_spikes(_cost_series(spark, sf_dir, COST_WINDOW))


@query
def rep_cost_distribution(spark, sf_dir):
    return cost_report.cost_distribution(_cost_series(spark, sf_dir, COST_WINDOW))


@query
def rep_cumulative_cost(spark, sf_dir):
    return cost_report.cumulative_cost(_cost_series(spark, sf_dir, COST_WINDOW), COST_WINDOW)


@query
def rep_resample(spark, sf_dir):
    series = _cost_series(spark, sf_dir, GRID_WINDOW)
    return cost_report.resample_interpolate(series, GRID_WINDOW)


# -- leaderboard reports -------------------------------------------------------------------------


@query
def rep_hot_rows(spark, sf_dir):
    return board_report.hot_rows(_workload_window(spark, sf_dir, COST_WINDOW))


@query
def rep_latest_window(spark, sf_dir):
    board, newest = _last_window(spark, sf_dir)
    return board_report.latest_window(board, newest=newest)


@query
def rep_top_values(spark, sf_dir):
    board, newest = _last_window(spark, sf_dir)
    return board_report.top_values(board, newest)


@query
def rep_leaderboard_search(spark, sf_dir):
    board, newest = _last_window(spark, sf_dir)
    return board_report.search(board, "fingerprint", "P_1", top=5, newest=newest)


@query
def rep_labels(spark, sf_dir):
    """Display cells of the whole leaderboard; values are lengthened so that labels get shortened."""
    board = _board(spark, sf_dir)
    longer = """CASE WHEN dimension_type = 'user' THEN dimension_value
        ELSE concat_ws('/', dimension_type, dimension_value, lb_key) END"""
    return board_report.display(board.withColumn("dimension_value", F.expr(longer)))


@query
def rep_predator_summary(spark, sf_dir):
    board, newest = _last_window(spark, sf_dir)
    return board_report.predator_summary(board, newest=newest)


# -- cluster heat --------------------------------------------------------------------------------


def _heat_cells(spark, sf_dir):
    rows = _workload_window(spark, sf_dir, HEAT_WINDOW)
    cells = heat_report.bucket_totals(rows, "heavy_units_sum", HEAT_BUCKET)
    return heat_report.keep_clusters(cells, heat_report.top_clusters(cells, HEAT_TOP))


@query
def rep_top_clusters(spark, sf_dir):
    """Busiest clusters by mean load of their workload rows."""
    rows = _workload_window(spark, sf_dir, COST_WINDOW)
    return heat_report.top_clusters(
        rows, HEAT_TOP, how="mean", cluster="instance_id", value="heavy_units_sum"
    )


@query
def rep_time_bucket(spark, sf_dir):
    rows = _workload_window(spark, sf_dir, COST_WINDOW)
    return heat_report.bucket_totals(rows, "exec_ms_sum", HEAT_BUCKET)


@query
def rep_heat_grid(spark, sf_dir):
    return heat_report.heat_grid(_heat_cells(spark, sf_dir))


@query
def rep_heat_wide(spark, sf_dir):
    """Mean load per bucket, one column per cluster."""
    rows = _workload_window(spark, sf_dir, HEAT_WINDOW)
    cells = heat_report.bucket_totals(rows, "heavy_units_sum", HEAT_BUCKET, how="mean")
    return heat_report.wide_grid(heat_report.heat_grid(cells), [str(i) for i in range(INSTANCES)])


@query
def rep_heat_normalized(spark, sf_dir):
    return heat_report.normalize_per_cluster(
        heat_report.heat_grid(_heat_cells(spark, sf_dir))
    )


@query
def rep_heat_scaled(spark, sf_dir):
    return heat_report.heat_scale(heat_report.heat_grid(_heat_cells(spark, sf_dir)))


@query
def rep_cluster_summary(spark, sf_dir):
    return heat_report.cluster_summary(_heat_cells(spark, sf_dir), HEAT_TOP)


@query
def rep_cluster_series(spark, sf_dir):
    """The busiest cluster; its column is found by name, as a report would."""
    cells = _heat_cells(spark, sf_dir)
    name = selection.resolve_column(cells, ["Cluster_Name", " CLUSTER "])
    busiest = heat_report.cluster_summary(cells).orderBy(F.desc("total"), name).first()[name]
    return heat_report.cluster_series(cells, busiest)


# -- streams -------------------------------------------------------------------------------------


@query
def stream_efficiency(spark, sf_dir):
    work = shared_dir(spark, "stream-efficiency")
    out = stream_kpis.efficiency_stream(_stream_of_events(spark, sf_dir))
    _run_to_end(out, stream_kpis.closed_writer(f"{work}/out", f"{work}/checkpoint"), work)
    return stream_kpis.read_closed(spark, f"{work}/out")


@query
def stream_cluster_workload(spark, sf_dir):
    """Streams the stored cleaned fact, whose cluster sizes are already filled."""
    work = shared_dir(spark, "stream-workload")
    fact = _clean(spark, sf_dir)
    tables.write_by_day(fact, f"{work}/clean", "arrival_timestamp")
    rows = spark.readStream.schema(fact.schema).parquet(f"{work}/clean")
    _run_to_end(
        stream_kpis.workload_stream(rows), stream_kpis.closed_writer(f"{work}/out", f"{work}/checkpoint"), work
    )
    return stream_kpis.read_closed(spark, f"{work}/out")


@query
def stream_leaderboard(spark, sf_dir):
    work = shared_dir(spark, "stream-leaderboard")
    totals = stream_kpis.leaderboard_totals_stream(_stream_of_events(spark, sf_dir))
    _run_to_end(totals, stream_kpis.ranked_writer(f"{work}/out", f"{work}/checkpoint"), work)
    return stream_kpis.read_closed(spark, f"{work}/out")


def _late_stream(spark: SparkSession, sf_dir: str, work: str) -> DataFrame:
    """Enriched rows in files by delivery: one row in 17 comes 35 minutes late, one in 23 three hours, one in 29 a day."""
    late = """CASE WHEN event_id % 17 = 0 THEN INTERVAL 35 MINUTES WHEN event_id % 23 = 0 THEN INTERVAL 180 MINUTES
        WHEN event_id % 29 = 0 THEN INTERVAL 1440 MINUTES ELSE INTERVAL 0 MINUTES END"""
    events = read_events(spark, sf_dir)
    delivered = events.withColumn("_delivered", F.expr(f"ts + {late}")).repartitionByRange(LATE_FILES, "_delivered").drop("_delivered")
    delivered.write.parquet(f"{work}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{work}/in")
    return clean.enrich(staging.stage_trace(as_trace(stream)))


def _late_totals(spark: SparkSession, sf_dir: str, name: str, totals: stream_totals.Totals, closed: bool) -> DataFrame:
    work = shared_dir(spark, f"stream-late-{name}")
    rows = _late_stream(spark, sf_dir, work)
    _run_to_end(rows, stream_totals.writer(f"{work}/out", {name: totals}, f"{work}/checkpoint"), work)
    gate = stream_totals.closed_gate(spark, f"{work}/out") if closed else None
    return stream_totals.read_totals(_enriched(spark, sf_dir), f"{work}/out", name, totals, gate)


@query
def stream_late_efficiency(spark, sf_dir):
    """Rows up to a day late, long after their minute has closed, give the minutes that a batch gives."""
    return _late_totals(spark, sf_dir, "efficiency", stream_totals.EFFICIENCY, closed=True)


@query
def stream_late_leaderboard(spark, sf_dir):
    return _late_totals(spark, sf_dir, "leaderboard", stream_totals.LEADERBOARD, closed=False)


@query
def stream_dedup(spark, sf_dir):
    """Every message is delivered twice, in files read one per micro-batch."""
    work = shared_dir(spark, "stream-dedup")
    files = _tasks(spark, sf_dir, FILE_ROWS)
    sent = streams.as_messages(_messages(spark, sf_dir, tasks=files)).select(*[f.name for f in MESSAGE.fields])
    sent.write.parquet(f"{work}/in")
    spark.read.schema(MESSAGE).parquet(f"{work}/in").repartition(files).write.mode("append").parquet(f"{work}/in")
    messages = streams.read_message_stream(spark, f"{work}/in", max_files=4)
    _run_to_end(messages, stream_ingest.landing_writer(f"{work}/landing", f"{work}/rejects"), work)
    return stream_ingest.read_landing(spark, f"{work}/landing").select(
        "id", "kafka_topic", "kafka_partition", "kafka_offset", "kafka_key"
    )


# -- stored tables ---------------------------------------------------------------------------------

_STORED: dict[tuple[str, str], str] = {}


def _refreshed(spark: SparkSession, sf_dir: str) -> str:
    """Root of tables that four batches of landed messages have filled, once per application and input.

    Eight partitions at very different offsets. Partition 5 lags: what it sends in the first two batches only lands
    with the third, after all others have moved on.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        root = shared_dir(spark, "stored")
        messages = _messages(spark, sf_dir, tasks=_tasks(spark, sf_dir)).withColumn("offset", F.expr(f"offset + partition * {OFFSET_STEP}"))
        events = read_events(spark, sf_dir).selectExpr("max(event_id) AS n").first()["n"]
        for share in (0.4, 0.6, 0.9, 1.0):
            sent = f"CAST(key AS BIGINT) <= {int(events * share)}" + (" AND partition <> 5" if share < 0.9 else "")
            staged = refresh.store_staged(ingest.land(messages.where(sent)), root)
            refresh.incremental_refresh(staged, root, source_bits=ingest.SOURCE_BITS)
        _STORED[key] = root
    return _STORED[key]


def _event_id(column: str) -> str:
    """The event behind a landed id."""
    return f"((shiftright({column}, {ingest.SOURCE_BITS})) - instance_id * {OFFSET_STEP}) AS {column}"


def _stored(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    rows = refresh.read(spark, _refreshed(spark, sf_dir), table).drop(tables.PARTITION)
    ids = [c for c in ("raw_id", "source_max_raw_id") if c in rows.columns]
    return rows.selectExpr(*[_event_id(c) if c in ids else c for c in rows.columns if c != "cluster_size" or table != "clean"])


def _streamed_root(spark: SparkSession, sf_dir: str) -> str:
    """Root of tables that a stream of messages has filled, once per application and input: three micro-batches, partition 5
    in the last one, days late."""
    key = (spark.sparkContext.applicationId, f"stream {sf_dir}")
    if key not in _STORED:
        work = shared_dir(spark, "stream-refresh")
        messages = _messages(spark, sf_dir, tasks=_tasks(spark, sf_dir)).select(*[f.name for f in MESSAGE.fields])
        n = read_events(spark, sf_dir).selectExpr("max(event_id) AS n").first()["n"]
        delivery = f"CASE WHEN partition = 5 OR offset > {n * 2 // 3} THEN 2 WHEN offset > {n // 3} THEN 1 ELSE 0 END"
        for i in range(3):
            # the stream takes all files of a delivery as one micro-batch, then goes on from its checkpoint
            messages.where(f"{delivery} = {i}").write.mode("append").parquet(f"{work}/in")
            stream = streams.read_message_stream(spark, f"{work}/in")
            stream_refresh.start(stream, f"{work}/tables", f"{work}/checkpoint", once=True).awaitTermination()
        _STORED[key] = f"{work}/tables"
    return _STORED[key]


def _streamed(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    rows = refresh.read(spark, _streamed_root(spark, sf_dir), table).drop(tables.PARTITION)
    ids = [c for c in ("raw_id", "source_max_raw_id") if c in rows.columns]
    return rows.selectExpr(*[f"shiftright({c}, {ingest.SOURCE_BITS}) AS {c}" if c in ids else c for c in rows.columns if c != "cluster_size" or table != "clean"])


@query
def stream_clean(spark, sf_dir):
    """The cleaned fact with filled cluster sizes, from a stream."""
    return _streamed(spark, sf_dir, "clean")


@query
def stream_concurrency(spark, sf_dir):
    """Concurrency of closed minutes from a stream; queries run on over batches."""
    return _streamed(spark, sf_dir, "minute_concurrency_cluster")


@query
def refresh_clean(spark, sf_dir):
    return _stored(spark, sf_dir, "clean")


@query
def refresh_workload(spark, sf_dir):
    return _stored(spark, sf_dir, "minute_cluster_workload")


@query
def refresh_efficiency(spark, sf_dir):
    return _stored(spark, sf_dir, "minute_query_efficiency")


@query
def refresh_concurrency(spark, sf_dir):
    return _stored(spark, sf_dir, "minute_concurrency_cluster")


@query
def refresh_shadow_cost(spark, sf_dir):
    return _stored(spark, sf_dir, "minute_shadow_cost")


@query
def refresh_leaderboard(spark, sf_dir):
    return _stored(spark, sf_dir, "leaderboard_15m")


@query
def refresh_predator(spark, sf_dir):
    return _stored(spark, sf_dir, "resource_predator_15m")
