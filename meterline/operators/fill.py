"""Filling of missing cluster sizes along each instance's history.

A row without a size takes the last known size before it; rows before the first known size take that
first one; an instance never sized takes 1. "Before" means ``(arrival_timestamp, raw_id)`` order with
missing timestamps last.

Only one forward pass is needed for both directions: every row a forward fill cannot reach lies before
the instance's first known size, so its backward fill *is* that first size. (A window running from the
current row to the end would cost O(n^2) in Spark.)

One instance may own a third of all rows, so no window runs over an instance. There is one plan for
every size: rows are windowed per (instance, hour) cell, cells above ``slice_rows`` are cut at quantiles
of their own (time, id) order, and last/first known sizes per slice are carried across slices by a window
over that small summary. No count runs first: whether a cell is cut is decided inside the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions import exprs

SLICE_ROWS = 5_000_000
CELL_UNIT = "hour"
CELL_MICROS = {"minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}
NO_TIME = 2**63 - 1  # sorts missing timestamps last
NO_INSTANCE = -(2**62)  # instances are 32-bit, so no real one collides
MAX_CUTS = 4096  # quantile grid of one hot cell: 20 thousand million rows of one instance and hour at SLICE_ROWS
CUT_STRIDE = 64  # cuts are searched in two steps of at most this many comparisons
DEFAULT_SIZE = 1.0


def instance_median(rows: DataFrame) -> DataFrame:
    """Exact median of the known sizes per instance (state: one counter per distinct size)."""
    return (
        rows.where("cluster_size IS NOT NULL")
        .groupBy("instance_id")
        .agg(F.expr("percentile(cluster_size, 0.5) AS median_cluster_size"))
    )


def attach_median(rows: DataFrame, medians: DataFrame | None = None) -> DataFrame:
    """Each row with its instance's median; Spark broadcasts the one-row-per-instance side if it is small."""
    medians = instance_median(rows) if medians is None else medians
    return rows.join(medians, "instance_id", "left")


def forward_fill(rows: DataFrame, out: str = "cluster_size_ff", **slicing) -> DataFrame:
    """Last known size at or before each row."""
    known = with_known_sizes(rows, **slicing)
    return known.select(*rows.columns, F.col("_last_known").alias(out))


def backward_fill(rows: DataFrame, out: str = "cluster_size_bf", **slicing) -> DataFrame:
    """First known size at or after each row: a forward pass over the reversed order."""
    known = with_known_sizes(rows, reverse=True, **slicing)
    return known.select(*rows.columns, F.col("_last_known").alias(out))


def fill_cluster_size(
    rows: DataFrame, out: str = "cluster_size_clean", seeds: DataFrame | None = None, **slicing
) -> DataFrame:
    """Forward fill, else backward fill, else 1. The median never applies: it needs a known size, and
    then one of the fills already has one.

    ``seeds`` (``instance_id, seed_size``) carries the last size known before the first given row.
    """
    known = with_known_sizes(rows, **slicing)
    parts = [F.col("_last_known"), F.col("_first_known"), F.lit(DEFAULT_SIZE)]
    if seeds is not None:
        known = known.join(
            seeds.select(F.col("instance_id").alias("_seed_id"), "seed_size"),
            F.col("instance_id").eqNullSafe(F.col("_seed_id")),
            "left",
        )
        parts.insert(1, F.col("seed_size"))
    return known.select(*rows.columns, F.coalesce(*parts).alias(out))


def with_known_sizes(
    rows: DataFrame,
    slice_rows: int = SLICE_ROWS,
    cell: str = CELL_UNIT,
    reverse: bool = False,
) -> DataFrame:
    """Rows plus ``_last_known`` (size at or before the row) and ``_first_known`` (first of the instance).

    With ``reverse`` both are taken in descending order.
    """
    order = _row_order(reverse)
    keyed = rows.selectExpr(
        "*",
        f"coalesce(CAST(instance_id AS BIGINT), {NO_INSTANCE}) AS _instance",
        f"coalesce(unix_micros(date_trunc('{cell}', arrival_timestamp)), {NO_TIME}L) AS _cell",
    )
    place = ["_instance", "_cell", "_slice"]
    summary = _cells(keyed)
    cuts = _cuts(keyed, summary, slice_rows, cell)
    keyed = _numbered(keyed, cuts, cell, "left")
    carried = _carry(_edges(keyed, summary, cuts, place, slice_rows, cell), place, reverse)
    # the rows are hashed on the three place columns once: the window and the join share that shuffle
    w = Window.partitionBy(*place).orderBy(*order)
    local = keyed.withColumn("_local", F.last("cluster_size", ignorenulls=True).over(_running(w)))
    return local.join(carried, place, "left").withColumn(
        "_last_known", F.coalesce("_local", "_carry_in")
    )


def _row_order(reverse: bool) -> list[Column]:
    if reverse:
        return [F.col("arrival_timestamp").desc_nulls_first(), F.col("raw_id").desc()]
    return [F.col("arrival_timestamp").asc_nulls_last(), F.col("raw_id").asc()]


def _running(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


# One decimal orders (time, id): struct orderings would force a sort-based aggregate.
POSITION = """CAST(CAST(coalesce(unix_micros(arrival_timestamp), 0L) AS DECIMAL(19,0))
    * CAST('10000000000000000000' AS DECIMAL(20,0)) + CAST(raw_id AS DECIMAL(19,0)) AS DECIMAL(38,0))"""
KNOWN_POSITION = f"CASE WHEN cluster_size IS NOT NULL THEN {POSITION} END"
FIRST_SIZE = f"min_by(cluster_size, {KNOWN_POSITION})"
LAST_SIZE = f"max_by(cluster_size, {KNOWN_POSITION})"


def _cells(keyed: DataFrame) -> DataFrame:
    """Per (instance, cell) with rows: their number, ids and first and last known size. One scan, about (instances x hours)
    rows; everything below is worked out from it."""
    sums = ["count(*) AS _n", "min(raw_id) AS _min_id", "max(raw_id) AS _max_id", f"{FIRST_SIZE} AS _first", f"{LAST_SIZE} AS _last"]
    return keyed.groupBy("_instance", "_cell").agg(*exprs(*sums))


def _edges(keyed: DataFrame, summary: DataFrame, cuts: DataFrame, place: list[str], slice_rows: int, cell: str) -> DataFrame:
    """First and last known size per slice. Cells that are not cut have them in the summary; only cut cells are read
    again, so without such cells nothing is."""
    whole = summary.where(f"_n <= {slice_rows}").selectExpr("_instance", "_cell", "0 AS _slice", "_first", "_last")
    hot = _numbered(keyed.drop("_slice"), cuts, cell, "inner").groupBy(*place).agg(*exprs(f"{FIRST_SIZE} AS _first", f"{LAST_SIZE} AS _last"))
    return whole.unionByName(hot)


def _carry(edges: DataFrame, place: list[str], reverse: bool) -> DataFrame:
    """Per slice: the size carried in from earlier slices, and the instance's first known size."""
    first, last = ("_last", "_first") if reverse else ("_first", "_last")
    order = [F.col(c).desc() if reverse else F.col(c).asc() for c in place[1:]]
    w = Window.partitionBy("_instance").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return edges.select(
        *place,
        F.last(last, ignorenulls=True).over(before).alias("_carry_in"),
        F.first(first, ignorenulls=True).over(whole).alias("_first_known"),
    )


def _spot(cell: str) -> str:
    """A row's place inside its cell as one double: microseconds into the cell, plus the id's share of the cell's id range.

    It never decreases along (time, id), so any cut points give ordered slices, and even rows of one instant are split by
    id.
    """
    return f"""least(CAST(coalesce(unix_micros(arrival_timestamp) - _cell, 0L) AS DOUBLE), {CELL_MICROS[cell]}D)
        + (raw_id - _min_id) / (_max_id - _min_id + 1D)"""


def _cuts(keyed: DataFrame, summary: DataFrame, slice_rows: int, cell: str) -> DataFrame:
    """Cut points of the cells above ``slice_rows`` rows, at quantiles of their own order.

    A cell of n rows gets at most ``n / slice_rows`` cuts, so all cuts together hold at most two doubles per ``slice_rows``
    rows of input (3 MB for a million million rows): that bounds the broadcasts. Where no cell is that large, the broadcast
    is empty and the scan behind it is dropped at run time.
    """
    cells = ["_instance", "_cell"]
    hot = summary.where(f"_n > {slice_rows}").select(*cells, "_n", "_min_id", "_max_id")
    grid = ", ".join(f"{i / MAX_CUTS}D" for i in range(1, MAX_CUTS))
    parts = f"least(ceil(_n / {slice_rows}D), {MAX_CUTS}L)"
    return (
        keyed.join(F.broadcast(hot), cells)
        .groupBy(*cells, "_n", "_min_id", "_max_id")
        .agg(F.expr(f"percentile_approx({_spot(cell)}, array({grid}), {MAX_CUTS * 10}) AS _grid"))
        .selectExpr(
            *cells,
            "_min_id",
            "_max_id",
            f"""transform(sequence(1L, greatest({parts} - 1, 1L)),
                i -> element_at(_grid, CAST(greatest(floor(i * {MAX_CUTS} / {parts}), 1L) AS INT))) AS _cuts""",
        )
        .selectExpr(
            "*", f"transform(sequence(1, size(_cuts), {CUT_STRIDE}), i -> element_at(_cuts, i)) AS _heads"
        )
    )


def _numbered(keyed: DataFrame, cuts: DataFrame, cell: str, how: str) -> DataFrame:
    """Rows with the number of their slice, which keeps the row order: 0 in cells without cuts."""
    # two searches of at most CUT_STRIDE steps: the block of cuts, then the cut inside it
    placed = keyed.join(F.broadcast(cuts), ["_instance", "_cell"], how).selectExpr(
        "*", f"{_spot(cell)} AS _spot"
    ).selectExpr("*", "size(filter(_heads, h -> h <= _spot)) AS _block")
    number = f"""CASE WHEN _cuts IS NULL OR _block = 0 THEN 0 ELSE (_block - 1) * {CUT_STRIDE}
        + size(filter(slice(_cuts, (_block - 1) * {CUT_STRIDE} + 1, {CUT_STRIDE}), c -> c <= _spot)) END"""
    return placed.selectExpr(*keyed.columns, f"{number} AS _slice")
