"""Streams that take late rows, repeats, failures and new checkpoints."""

import pytest
from pyspark.sql import functions as F

from meterline.operators import bounds, clean, ingest, kpis, leaderboard, staging
from meterline.plans import refresh
from meterline.sources import streams
from meterline.sources.telemetry import read_telemetry
from meterline.streaming import refresh as sr
from meterline.streaming import totals as st


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return clean.clean_table(staging.stage_trace(read_telemetry(spark, sf_dir))).persist()


WANTED = {"efficiency": st.EFFICIENCY, "workload": st.WORKLOAD, "leaderboard": st.LEADERBOARD}


def assert_equal_to_batch(rows, root, same):
    spark = rows.sparkSession
    gate = st.closed_gate(spark, root)
    assert gate == bounds.gate_of(rows)
    same(st.read_totals(rows, root, "efficiency", st.EFFICIENCY, gate), kpis.minute_query_efficiency(rows, gate))
    same(st.read_totals(rows, root, "workload", st.WORKLOAD, gate), kpis.minute_cluster_workload(rows, gate))
    same(st.read_totals(rows, root, "leaderboard", st.LEADERBOARD), leaderboard.leaderboard(rows))


def test_late_rows_repeats_and_merges_give_the_batch_tables(spark, rows, tmp_path, same, monkeypatch):
    monkeypatch.setattr(st, "FANOUT", 3)
    root, checkpoint = f"{tmp_path}/out", f"{tmp_path}/c"
    write = st.writer(root, WANTED, checkpoint)
    # rows 35 and 180 minutes and a day behind the newest one of the batch before
    slot = """CASE WHEN raw_id % 17 = 0 THEN 1 + floor((unix_seconds(arrival_timestamp) + 2100) / 500000)
        WHEN raw_id % 23 = 0 THEN 2 + floor((unix_seconds(arrival_timestamp) + 10800) / 500000) ELSE floor(unix_seconds(arrival_timestamp) / 500000) END"""
    slots = rows.withColumn("slot", F.expr(slot)).persist()
    numbers = sorted(r.slot for r in slots.select("slot").distinct().collect())
    assert len(numbers) >= 6
    late, newest = 0, None
    for i, number in enumerate(numbers):
        batch = slots.where(f"slot = {number}").drop("slot")
        if newest is not None:
            late += batch.where(f"minute_ts <= {bounds.at(bounds.minutes_before(bounds.minute_start(newest), 10))}").count()
        newest = max(newest or 0, bounds.latest(batch, "arrival_timestamp"))
        write(batch, i)
        write(batch, i)
    assert st.progress(spark, root) == {"rows": 1000, "late_rows": late, "newest": newest} and late > 50
    assert len(st.entries(spark, root)) <= 4
    assert_equal_to_batch(rows, root, same)
    since = bounds.minutes_before(newest, 3 * 1440)
    gate = st.closed_gate(spark, root)
    same(st.read_totals(rows, root, "efficiency", st.EFFICIENCY, gate, since), kpis.minute_query_efficiency(rows, gate).where(f"minute_ts >= {bounds.at(since)}"))


def test_a_failed_batch_counts_once_and_a_new_checkpoint_starts_anew(spark, rows, tmp_path, same, monkeypatch):
    root = f"{tmp_path}/out"
    write = st.writer(root, WANTED, f"{tmp_path}/c1")
    write(rows.where("raw_id < 300"), 0)
    note = st._note
    monkeypatch.setattr(st, "_note", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        write(rows.where("raw_id >= 300"), 1)
    monkeypatch.setattr(st, "_note", note)
    assert st.progress(spark, root)["rows"] == 300
    write(rows.where("raw_id >= 300"), 1)
    assert_equal_to_batch(rows, root, same)
    again = st.writer(root, WANTED, f"{tmp_path}/c2")
    again(rows.where("raw_id % 2 = 0"), 0)
    assert st.progress(spark, root)["rows"] == 500
    again(rows.where("false"), 1)
    again(rows.where("raw_id % 2 = 1"), 2)
    assert_equal_to_batch(rows, root, same)


def test_nothing_streamed_yet(spark, rows, tmp_path):
    assert st.read_totals(rows, f"{tmp_path}/none", "efficiency", st.EFFICIENCY).collect() == []
    assert st.progress(spark, f"{tmp_path}/none") == {"rows": 0, "late_rows": 0, "newest": None}


TABLES = ["clean", "instance_days", *refresh.KPI_TIME]


class Lost(Exception):
    pass


def test_stream_batches_that_fail_or_repeat_give_a_full_refresh(spark, sf_dir, tmp_path, same, monkeypatch):
    late = "CASE WHEN raw_id % 17 = 0 THEN arrival_timestamp - INTERVAL 3 HOURS WHEN raw_id = 777 THEN NULL ELSE arrival_timestamp END"
    staged = staging.stage_trace(read_telemetry(spark, sf_dir).withColumn("arrival_timestamp", F.expr(late))).persist()
    root = f"{tmp_path}/stream"
    monkeypatch.setattr(refresh, "LOG_FILES", 4)
    refresh._shorten.__defaults__ = (4,)
    refresh.full_refresh(staged, f"{tmp_path}/full")
    # another checkpoint has filled the tables before
    refresh.add_batch(staged.where("raw_id < 50"), root, "1-old", 0)
    write = refresh.tables._write
    parts = ["raw_id < 300", "raw_id BETWEEN 300 AND 499", "raw_id BETWEEN 500 AND 699", "raw_id >= 700"]
    for number, (part, lost_at) in enumerate(zip(parts, [4, 1, 2, 6], strict=True)):
        count = [0]

        def fails(rows, path, mode, overwrite, lost_at=lost_at, count=count):
            write(rows, path, mode, overwrite)
            count[0] += 1
            if count[0] == lost_at:
                raise Lost

        monkeypatch.setattr(refresh.tables, "_write", fails)
        with pytest.raises(Lost):
            refresh.add_batch(staged.where(part), root, "2-new", number)
        monkeypatch.setattr(refresh.tables, "_write", write)
        assert refresh.add_batch(staged.where(part), root, "2-new", number)
        assert not refresh.add_batch(staged.where(part), root, "2-new", number)
    assert len(refresh.read(spark, root, "refresh_log").inputFiles()) <= 6
    for name in TABLES:
        same(refresh.read(spark, f"{tmp_path}/full", name), refresh.read(spark, root, name))


def test_refresh_runs_on_an_interval(spark, sf_dir, tmp_path, same):
    trace = read_telemetry(spark, sf_dir)
    sent = ingest.encode_messages(trace, left_out=("raw_id",)).selectExpr(
        "key", "value", "'t' AS topic", "CAST(CAST(key AS BIGINT) % 3 AS INT) AS partition", "CAST(key AS BIGINT) AS offset"
    )
    source, root = f"{tmp_path}/in", f"{tmp_path}/tables"
    sent.where("offset < 600").coalesce(1).write.parquet(source)
    query = sr.start(streams.read_message_stream(spark, source, max_files=1), root, f"{tmp_path}/c", interval="1 second")
    try:
        query.processAllAvailable()
        sent.where("offset >= 600").coalesce(1).write.mode("append").parquet(source)
        query.processAllAvailable()
    finally:
        query.stop()
    got = refresh.read(spark, root, "clean").selectExpr("query_id AS raw_id", "cluster_size_clean", "heavy_unit", "minute_ts")
    same(got, clean.clean_table(staging.stage_trace(trace)).select(*got.columns))
