import hashlib

import pytest

from meterline.operators import bounds, clean, kpis, leaderboard, merge, staging

DAY = 86_400_000_000


@pytest.fixture(scope="module")
def fact(staged):
    return clean.clean_table(staged).persist()


@pytest.fixture(scope="module")
def gate(fact):
    return bounds.gate_of(fact)


def test_gate_keeps_closed_minutes_only(fact, gate):
    newest = bounds.latest(fact, "minute_ts")
    assert gate == newest - 10 * 60_000_000
    assert bounds.latest(bounds.closed_minutes(fact, gate), "minute_ts") <= gate
    assert bounds.closed_minutes(fact, None).count() == 0


def test_concurrency_equals_expansion(fact, gate, same):
    active = kpis.active_minutes(fact, gate)
    counts = active.selectExpr(
        "minute_ts", "instance_id", "int(start_minute = minute_ts) AS s", "int(end_minute = minute_ts) AS e"
    ).groupBy("minute_ts", "instance_id")
    want = counts.agg({"*": "count", "s": "sum", "e": "sum"}).selectExpr(
        "minute_ts", "instance_id", "`count(1)` AS active_queries", "`sum(s)` AS started_queries", "`sum(e)` AS ended_queries"
    )
    got = kpis.minute_concurrency(fact, gate)
    same(got.select(want.columns), want)
    sized = got.where("cluster_size_clean_max IS NOT NULL").select("minute_ts", "instance_id", "cluster_size_clean_max")
    starts = kpis.minute_cluster_size(fact, gate)
    same(sized, starts.join(got.select("minute_ts", "instance_id"), ["minute_ts", "instance_id"], "left_semi"))
    ended = got.agg({"started_queries": "sum", "ended_queries": "sum"}).first()
    assert ended[0] == ended[1] == bounds.closed_minutes(fact, gate).count()


@pytest.mark.parametrize("days", [0, 3, 40])
def test_concurrency_since_counts_queries_begun_earlier(fact, gate, same, days):
    start = bounds.minutes_before(gate, 1440 * days)
    full = bounds.since(kpis.minute_concurrency(fact, gate), "minute_ts", start)
    same(kpis.minute_concurrency(fact, gate, start), full)


def test_concurrency_edges(make_trace):
    t = make_trace(
        # reversed: gives no minute, but its size counts for the minute it began in
        dict(raw_id=1, instance_id=1, arrival_timestamp="2024-01-01 00:00:30", execution_duration_ms=-90000.0, cluster_size=9.0),
        dict(raw_id=2, instance_id=1, arrival_timestamp="2024-01-01 00:00:40", execution_duration_ms=130000.0, cluster_size=2.0),
        # unknown instance: no size, no key
        dict(raw_id=3, arrival_timestamp="2024-01-01 00:00:40", execution_duration_ms=1000.0, cluster_size=2.0),
        dict(raw_id=4, instance_id=2, arrival_timestamp="2024-01-01 00:00:40", cluster_size=0.0),
        dict(raw_id=5, instance_id=1, arrival_timestamp="2024-01-01 01:00:00"),
    )
    fact = clean.clean_table(staging.stage_trace(t))
    got = kpis.minute_concurrency(fact, bounds.gate_of(fact)).collect()
    rows = sorted((r.instance_id or 0, str(r.minute_ts)[14:16], r.active_queries, r.cluster_size_clean_max, r.query_pressure, r.kpi_key is None) for r in got)
    assert rows == [
        (0, "00", 1, None, None, True),
        (1, "00", 1, 9.0, pytest.approx(1 / 9), False),
        (1, "01", 1, None, None, False),
        (1, "02", 1, None, None, False),
        (2, "00", 1, 0.0, None, False),
    ]
    cost = {r.instance_id: (r.cluster_size_clean_max, r.cost_units_per_min_per_node) for r in kpis.minute_shadow_cost(fact, bounds.gate_of(fact)).collect()}
    assert cost[None] == (0.0, None) and cost[2] == (0.0, None)


def test_ratio_is_null_without_scans(make_trace):
    t = make_trace(
        dict(raw_id=1, instance_id=1, arrival_timestamp="2024-01-01 00:00:00", mbytes_spilled=5.0),
        dict(raw_id=2, instance_id=1, arrival_timestamp="2024-01-01 02:00:00"),
    )
    rows = clean.enrich(staging.stage_trace(t))
    r = kpis.minute_query_efficiency(rows, bounds.gate_of(rows)).first()
    assert (r.spilled_mb_sum, r.spill_to_scan_ratio, r.queries_count) == (5.0, None, 1)
    assert r.kpi_key == hashlib.md5(b"2024-01-01 00:00:00+00-1").hexdigest()


def test_shadow_cost_equals_its_join_form(fact, gate, same):
    joined = kpis.shadow_cost_from_tables(
        kpis.minute_query_efficiency(fact, gate), kpis.minute_cluster_size(fact, gate)
    )
    same(kpis.minute_shadow_cost(fact, gate), joined)


def test_workload_keys_are_unique(fact, gate):
    table = kpis.minute_cluster_workload(fact, gate)
    assert table.select("kpi_key").distinct().count() == table.count()


def test_leaderboard_ties_missing_values_and_limit(make_trace):
    same_score = [dict(raw_id=i, user_id=i, arrival_timestamp="2024-01-01 00:07:00", was_cached=1, query_type="select") for i in range(12)]
    none = dict(raw_id=99, arrival_timestamp="2024-01-01 00:07:00", was_cached=1)
    untimed = dict(raw_id=100, user_id=1)
    rows = clean.enrich(staging.stage_trace(make_trace(*same_score, none, untimed)))
    board = leaderboard.leaderboard(rows).collect()
    users = sorted((r.rank_position, r.dimension_value) for r in board if r.dimension_type == "user")
    assert [v for _, v in users] == sorted(str(i) for i in range(12))[:10]
    kinds = {(r.dimension_type, r.dimension_value): r.queries_count for r in board if r.dimension_type != "user"}
    assert kinds[("query_type", "UNKNOWN")] == 1 and kinds[("query_type", "select")] == 12
    assert {(str(r.window_start)[11:16], str(r.window_end)[11:16]) for r in board} == {("00:00", "00:15")}


def test_predator_shares_sum_to_one(fact):
    board = leaderboard.leaderboard(fact)
    shares = leaderboard.resource_predators(board).groupBy("window_start", "predator_type").agg({"cost_share_pct": "sum"})
    assert shares.where("abs(`sum(cost_share_pct)` - 1) > 1e-9").count() == 0


def test_leaderboard_since_equals_full(fact, same):
    newest = bounds.latest(fact, "arrival_timestamp")
    start = newest - 5 * DAY - (newest - 5 * DAY) % 900_000_000
    full = bounds.since(leaderboard.leaderboard(fact), "window_start", start)
    same(leaderboard.leaderboard(fact, since=start), full)


def test_merges_are_idempotent_and_drop_stale_rows(spark, same):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "k STRING, v INT").selectExpr("*", "timestamp_micros(v * 60000000L) AS t")
    batch = spark.createDataFrame([("b", 3)], "k STRING, v INT").selectExpr("*", "timestamp_micros(120000000L) AS t")
    once = merge.upsert_by_key(target, batch, "k")
    same(once, merge.upsert_by_key(once, batch, "k"))
    assert sorted((r.k, r.v) for r in once.collect()) == [("a", 1), ("b", 3)]
    ranged = merge.replace_since(target, batch.selectExpr("'c' AS k", "v", "t"), "t", 120_000_000)
    assert sorted((r.k, r.v) for r in ranged.collect()) == [("a", 1), ("c", 3)]
