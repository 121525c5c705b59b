import numpy as np
import pandas as pd
import pytest

from meterline.operators import board_report as board
from meterline.operators import cost_report as cost
from meterline.operators import efficiency_report as eff
from meterline.operators import heat_report as heat
from meterline.operators import selection

MIN = 60_000_000


def table(spark, rows, schema):
    """Rows whose ``minute_ts`` is given as minutes after midnight."""
    df = spark.createDataFrame(rows, schema)
    cols = [f"timestamp_micros(CAST(m * {MIN} AS BIGINT)) AS minute_ts" if c == "m" else c for c in df.columns]
    return df.selectExpr(*cols)


def series(spark, values, minutes=None):
    minutes = range(len(values)) if minutes is None else minutes
    rows = [(float(m), float(v)) for m, v in zip(minutes, values)]
    return table(spark, rows, "m DOUBLE, usd_per_min DOUBLE")


def column(df, name, by="minute_ts"):
    return [r[name] for r in df.orderBy(by).collect()]


RNG = np.random.default_rng(5)
NOISY = list(np.round(RNG.gamma(2.0, 3.0, 40), 3)) + [60.0, 1.0, 2.0]


def test_minute_cost_sums_instances_and_cuts_the_window(spark):
    rows = [(0.0, 1, 1, 1.0), (5.0, 1, 2, 2.0), (5.0, 2, 3, 3.0), (9.0, 1, 4, 4.0), (10.0, None, 5, None)]
    t = table(spark, rows, "m DOUBLE, instance_id INT, queries_count BIGINT, heavy_units_sum DOUBLE")
    got = cost.minute_cost(t, 5).orderBy("minute_ts").collect()
    assert [(r.queries_count, r.usd_per_min) for r in got] == [(5, pytest.approx(0.4)), (4, pytest.approx(0.32)), (5, 0.0)]
    totals = cost.query_totals(t, 5).first()
    assert (totals.queries_total, totals.queries_window) == (15, 14)


@pytest.mark.parametrize(
    "values,current,delta,total", [([2.0, 3.0], 3.0, 50.0, 5.0), ([7.0], 7.0, 0.0, 7.0), ([0.0, 1.0], 1.0, 1e11, 1.0)]
)
def test_cost_summary(spark, values, current, delta, total):
    r = cost.cost_summary(series(spark, values), 5).first()
    assert (r.current_usd_per_min, r.window_usd) == (current, total)
    assert r.delta_pct == pytest.approx(delta)
    assert r.projected_24h == pytest.approx(total / 5 * 1440) and r.projected_7d == pytest.approx(7 * r.projected_24h)


def test_empty_series_give_zeros(spark):
    none = series(spark, [1.0]).where("false")
    assert set(cost.cost_summary(none, 5).first()) == {0.0}
    assert cost.cost_rate_elapsed(none, 5).first().avg_rate == 0.0
    assert cost.moving_average(none).count() == cost.resample_interpolate(none, 5).count() == 0


def test_elapsed_rate_and_cumulative_cost_use_row_gaps(spark):
    s = series(spark, [1.0, 2.0, 4.0], [0, 3, 30])
    r = cost.cost_rate_elapsed(s, 20).first()
    assert (r.window_usd, r.elapsed_minutes) == (7.0, 3 + 3 + 20)
    assert column(cost.cumulative_cost(s, 20), "cum_cost") == [3.0, 9.0, 89.0]
    one = series(spark, [5.0])
    assert cost.cost_rate_elapsed(one, 20).first().elapsed_minutes == 20.0
    assert column(cost.cumulative_cost(one, 20), "cum_cost") == [5.0]


@pytest.mark.parametrize("values", [NOISY, NOISY[:14], NOISY[:15], [3.0] * 15], ids=["long", "14", "15", "flat"])
def test_moving_average_and_spikes_match_pandas(spark, values):
    s = pd.Series(values)
    df = series(spark, values)
    assert column(cost.moving_average(df), "usd_ma") == pytest.approx(list(s.rolling(5, min_periods=1).mean()))
    if len(s) >= 15:
        roll = s.rolling(15, min_periods=5)
        std = roll.std().where(lambda x: x > 1e-12)
        want = ((s - roll.mean()) / std).fillna(0.0).clip(lower=0)
    else:
        want = s * 0
    got = cost.cost_spikes(df)
    assert column(got, "severity") == pytest.approx(list(want), abs=1e-9)
    assert column(got, "is_spike") == list(want >= 1.5)


def test_distribution(spark):
    r = cost.cost_distribution(series(spark, NOISY)).first()
    q1, q2, q3 = np.percentile(NOISY, [25, 50, 75])
    inside = [v for v in NOISY if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    assert (r.q1, r.median, r.q3) == pytest.approx((q1, q2, q3))
    assert (r.whisker_low, r.whisker_high, r.outliers) == (min(inside), max(inside), len(NOISY) - len(inside))


@pytest.mark.parametrize("minutes", [[0, 1, 2], [0, 4, 5], [3]], ids=str)
def test_resampling_matches_pandas(spark, minutes):
    values = [1.0, 5.0, 2.0][: len(minutes)]
    idx = pd.to_datetime(np.array(minutes) * 60, unit="s")
    want = pd.Series(values, index=idx).resample("5s").mean().interpolate(method="time")
    want = want[want.index >= idx.max() - pd.Timedelta(minutes=3)]
    got = cost.resample_interpolate(series(spark, values, minutes), 3).orderBy("t").collect()
    assert [r.t for r in got] == list(want.index.to_pydatetime())
    assert [r.y for r in got] == pytest.approx(list(want))


def test_rollup_weights_by_count_and_has_zero_ratios(spark):
    rows = [
        (0.0, 1, 10.0, 1.0, 5.0, 0.0, 2.0, 0.1, 1, 0, 0.1), (0.0, 3, 20.0, 2.0, 7.0, 0.0, None, 0.3, 0, 1, 0.3),
        (-9.0, 5, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1, 1, 1.0),
    ]
    names = "m DOUBLE, queries_count BIGINT, exec_ms_avg DOUBLE, queue_ms_avg DOUBLE, compile_ms_sum DOUBLE, scanned_mb_sum DOUBLE, spilled_mb_sum DOUBLE, heavy_units_sum DOUBLE, cached_queries BIGINT, aborted_queries BIGINT, heavy_unit_avg DOUBLE"
    r = eff.seconds_and_waste(eff.efficiency_rollup(table(spark, rows, names), 5)).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.queries_count, r.exec_ms_avg, r.queue_ms_avg, r.compile_ms_avg) == (4, 17.5, 1.75, 3.0)
    assert (r.spill_to_scan_ratio, r.waste_sum, r.exec_s_avg) == (0.0, 2.0, 0.0175)


def test_latest_values_with_and_without_nulls(spark):
    t = table(spark, [(0.0, 1.0, None, 1.0), (1.0, 4.0, 2.0, None), (2.0, 9.0, None, None)], "m DOUBLE, a DOUBLE, b DOUBLE, c DOUBLE")
    zero = {r.metric: (r.latest, r.delta) for r in selection.latest_and_delta(t, "minute_ts", ["a", "b", "c"]).collect()}
    assert zero == {"a": (9.0, 5.0), "b": (0.0, -2.0), "c": (0.0, 0.0)}
    skip = {r.metric: (r.latest, r.delta) for r in selection.latest_and_delta(t, "minute_ts", ["a", "b", "c"], True).collect()}
    assert skip == {"a": (9.0, 5.0), "b": (2.0, None), "c": (1.0, None)}
    assert selection.latest_and_delta(t.where("c > 5"), "minute_ts", ["c"], True).count() == 0


def test_resolve_column_ignores_case_and_blanks(spark):
    df = spark.createDataFrame([(1, 2)], "`Minute_TS ` INT, x INT")
    assert selection.resolve_column(df, ["ts", "minute_ts"]) == "Minute_TS "
    assert selection.resolve_column(df, ["nope"]) is None


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("kind", ["spread", "ties", "single", "few", "pair"])
def test_exact_quantile_matches_numpy(spark, q, kind):
    rng = np.random.default_rng(3)
    values = {"spread": rng.normal(size=25_000), "ties": rng.integers(0, 4, 9_000) * 1.0, "single": np.array([7.0]), "few": rng.normal(size=236), "pair": np.array([1.0, 4.0])}[kind]
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    assert selection.exact_quantile(df, "v", q) == pytest.approx(np.quantile(values, q), abs=1e-12)


def board_rows(spark):
    rows = [
        ("2024-01-01 00:15:00", "user", "old", 1, 9, 99.0), ("2024-01-01 00:30:00", "user", "7", 1, 1234, 3.5),
        ("2024-01-01 00:30:00", "user", "8", 2, 2, 1.5), ("2024-01-01 00:30:00", "fingerprint", "Fp.One", 1, 3, 1234.567),
        ("2024-01-01 00:30:00", "fingerprint", "fpXone", 2, 3, 2.0), ("2024-01-01 00:30:00", "workload_type", "Read", 1, 1, 1.0),
    ]
    df = spark.createDataFrame(rows, "e STRING, dimension_type STRING, dimension_value STRING, rank_position INT, queries_count BIGINT, heavy_units_sum DOUBLE")
    return df.selectExpr("CAST(e AS TIMESTAMP) AS window_end", "* EXCEPT (e)")


def test_board_questions(spark):
    b = board_rows(spark)
    assert board.latest_window(b).count() == 5 and board.latest_window(b.where("false")).count() == 0
    top = board.top_values(b).first()
    assert (top.top_user, top.top_fingerprint, top.top_workload, top.top_query_type) == ("7", "Fp.One", "Read", "—")
    found = [r.dimension_value for r in board.search(b, "fingerprint", " FP.ONE ").collect()]
    assert found == ["Fp.One", "fpXone"]
    assert [r.dimension_value for r in board.search(b, "fingerprint", board.literal_pattern("fp.one")).collect()] == ["Fp.One"]
    assert [r.dimension_value for r in board.search(b, "user", top=1).collect()] == ["7"]
    s = board.predator_summary(b).first()
    assert (s.top_fingerprint, s.top_fingerprint_cost, s.top_user) == ("Fp.One", 1234.567, "7")
    assert (s.pred_total, s.pred_total_once) == (pytest.approx(1242.567), pytest.approx(1236.567))
    p = spark.createDataFrame([("a", "u", "2"), ("b", "v", "x"), ("c", "w", "5")], "FP STRING, actor STRING, cost_7d STRING")
    assert tuple(board.predator_summary(b, p).first()) == ("c", 5.0, "w", 7.0, 7.0)


def test_labels_and_number_formats(spark):
    long = "abcdefghijkl-middle-0123456789"
    b = board_rows(spark).where("rank_position = 1").selectExpr("* EXCEPT (dimension_value)", f"if(dimension_type = 'user', '{long}', '{long[:28]}') AS dimension_value")
    got = {(r.dimension_type, r.heavy_units): (r.label, r.queries) for r in board.display(b).collect()}
    assert got[("user", "3.50")] == ("abcdefghijkl…0123456789", "1,234")
    assert got[("fingerprint", "1,234.57")] == (long[:28], "3")


@pytest.mark.parametrize("n,threshold,hot", [(5, 5.0, 1), (6, 5.0, 2), (10, 8.2, 2)])
def test_hot_rows_threshold(spark, n, threshold, hot):
    rows = spark.createDataFrame([(float(i + 1),) for i in range(n)] + [(None,)][: n == 0], "heavy_units_sum DOUBLE")
    r = board.hot_rows(rows).first()
    assert (r.max_workload, r.threshold, r.hot_rows) == (float(n), pytest.approx(threshold), hot)


def heat_rows(spark):
    rows = [(0.0, 1, 4.0), (1.0, 1, 2.0), (6.0, 1, 1.0), (30.0, 1, 0.0), (2.0, 2, 3.0), (31.0, 2, 8.0), (3.0, 3, 0.5), (12.0, 3, 0.1), (0.0, None, 99.0)]
    return table(spark, rows, "m DOUBLE, instance_id INT, heavy_units_sum DOUBLE")


def test_heat_grid_normalization_and_shades(spark):
    cells = heat.bucket_totals(heat_rows(spark), "heavy_units_sum", 5)
    assert {(r.cluster, r.value) for r in cells.collect() if r.bucket_ts.minute == 0} == {("1", 6.0), ("2", 3.0), ("3", 0.5)}
    top = heat.top_clusters(cells, 2)
    assert [(r.cluster, r.total) for r in top.collect()] == [("2", 11.0), ("1", 7.0)]
    grid = heat.heat_grid(heat.keep_clusters(cells, top)).persist()
    got = {(r.cluster, r.bucket_ts.minute): (r.value, r.cluster_position) for r in grid.collect()}
    # the bucket of cluster 3 alone (minute 10) is not part of the grid
    assert got == {("1", 0): (6.0, 2), ("1", 5): (1.0, 2), ("1", 30): (0.0, 2), ("2", 0): (3.0, 1), ("2", 5): (0.0, 1), ("2", 30): (8.0, 1)}
    norm = {(r.cluster, r.bucket_ts.minute): r.value for r in heat.normalize_per_cluster(grid).collect()}
    assert norm[("1", 0)] == 1.0 and norm[("2", 0)] == pytest.approx(3 / 8)
    values = [v for v, _ in got.values()]
    lo, hi = np.quantile(values, [0.05, 0.95])
    shades = {(r.cluster, r.bucket_ts.minute): r.shade for r in heat.heat_scale(grid).collect()}
    assert shades[("2", 30)] == pytest.approx(np.sqrt(hi)) and shades[("1", 5)] == pytest.approx(1.0)
    flat = heat.heat_scale(grid.selectExpr("cluster", "bucket_ts", "4D AS value", "cluster_position"))
    assert {r.shade for r in flat.collect()} == {2.0}
    wide = heat.wide_grid(grid, ["1", "2"]).orderBy("bucket_ts").collect()
    assert [(r["cluster_1"], r["cluster_2"]) for r in wide] == [(6.0, 3.0), (1.0, 0.0), (0.0, 8.0)]
    assert [r.value for r in heat.cluster_series(cells, 1).collect()] == [6.0, 1.0, 0.0]
    means = heat.top_clusters(heat_rows(spark), 1, "mean", "instance_id", "heavy_units_sum").first()
    assert (means.cluster, means.total) == ("2", 5.5)
    with pytest.raises(ValueError, match="nope"):
        heat.bucket_totals(heat_rows(spark), "nope")


def test_constant_cluster_normalizes_to_zero(spark):
    cells = heat.bucket_totals(table(spark, [(0.0, 1, 5.0), (7.0, 1, 5.0)], "m DOUBLE, instance_id INT, v DOUBLE"), "v", 5)
    assert {r.value for r in heat.normalize_per_cluster(heat.heat_grid(cells)).collect()} == {0.0}


def test_per_minute_mean(spark):
    t = table(spark, [(0.2, 1.0), (0.7, 3.0), (1.0, None)], "m DOUBLE, a DOUBLE")
    assert column(selection.per_minute_mean(t, "minute_ts", ["a"]), "a") == [2.0, None]
