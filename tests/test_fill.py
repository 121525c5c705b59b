import random

import pytest

from meterline.operators import fill


def brute_force(rows):
    """(id, instance, time, size) -> id: (forward, backward, clean), by plain scans."""
    out = {}
    order = sorted(rows, key=lambda r: (r[2] is None, r[2] or "", r[0]))
    for inst in {r[1] for r in rows}:
        own = [r for r in order if r[1] == inst]
        for i, r in enumerate(own):
            ff = next((x[3] for x in reversed(own[: i + 1]) if x[3] is not None), None)
            bf = next((x[3] for x in own[i:] if x[3] is not None), None)
            out[r[0]] = (ff, bf, ff if ff is not None else bf if bf is not None else 1.0)
    return out


def random_rows(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # one hot instance, one hot instant, missing times and instances
        inst = rng.choice([1, 1, 1, 1, 2, 3, None])
        minute = rng.choice([30, 30, 30, rng.randrange(0, 600)])
        time = None if rng.random() < 0.05 else f"2024-01-0{1 + minute // 300} {minute // 60:02d}:{minute % 60:02d}:00"
        size = None if inst == 3 or rng.random() < 0.7 else float(rng.choice([2, 4, 8]))
        rows.append((i, inst, time, size))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "raw_id BIGINT, instance_id INT, t STRING, cluster_size DOUBLE")
    return df.selectExpr("raw_id", "instance_id", "CAST(t AS TIMESTAMP) AS arrival_timestamp", "cluster_size")


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(
    "slicing",
    [
        dict(),
        dict(cell="minute"),
        dict(slice_rows=5),
        dict(slice_rows=7, cell="day"),
        dict(slice_rows=20),
    ],
    ids=str,
)
def test_every_slicing_equals_plain_scans(spark, seed, slicing):
    rows = random_rows(seed)
    df = frame(spark, rows).persist()
    want = brute_force(rows)
    clean = {r.raw_id: r.cluster_size_clean for r in fill.fill_cluster_size(df, **slicing).collect()}
    ff = {r.raw_id: r.cluster_size_ff for r in fill.forward_fill(df, **slicing).collect()}
    bf = {r.raw_id: r.cluster_size_bf for r in fill.backward_fill(df, **slicing).collect()}
    assert {k: (ff[k], bf[k], clean[k]) for k in want} == want


def test_building_the_plan_runs_no_job(spark):
    df = frame(spark, random_rows(3))
    tracker = spark.sparkContext.statusTracker()
    before = max(tracker.getJobIdsForGroup(None), default=-1)
    fill.fill_cluster_size(df)
    assert max(tracker.getJobIdsForGroup(None), default=-1) == before


def test_hot_instant_is_cut_by_id(spark):
    """All rows at one instant of one instance: slices stay small and ordered."""
    rows = [(i, 1, "2024-01-01 00:00:00", None) for i in range(1000)]
    keyed = frame(spark, rows).selectExpr("*", "1L AS _instance", "unix_micros(arrival_timestamp) AS _cell")
    sliced = fill._numbered(keyed, fill._cuts(keyed, fill._cells(keyed), 50, "hour"), "hour", "left")
    cut = sliced.groupBy("_slice").agg({"raw_id": "count"}).collect()
    assert len(cut) >= 19 and max(r[1] for r in cut) <= 60
    edges = sliced.selectExpr("_slice", "raw_id").orderBy("raw_id").collect()
    assert [r[0] for r in edges] == sorted(r[0] for r in edges)


def test_seed_applies_before_the_first_known_size(spark):
    df = frame(spark, [(1, 1, "2024-01-01 00:00:00", None), (2, 1, "2024-01-01 00:01:00", 4.0), (3, 2, "2024-01-01 00:00:00", None)])
    seeds = spark.createDataFrame([(1, 16.0)], "instance_id INT, seed_size DOUBLE")
    got = {r.raw_id: r.cluster_size_clean for r in fill.fill_cluster_size(df, seeds=seeds).collect()}
    assert got == {1: 16.0, 2: 4.0, 3: 1.0}


def test_without_large_cells_the_input_is_read_twice(spark, tmp_path):
    """Once for the summary, once for the rows: the scans for cut points are dropped when the plan sees none."""
    frame(spark, random_rows(3)).write.parquet(f"{tmp_path}/rows")
    filled = fill.fill_cluster_size(spark.read.parquet(f"{tmp_path}/rows"))
    filled.collect()
    plan = filled._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert final.count("FileScan parquet") - final.count("ReusedExchange") <= 2
