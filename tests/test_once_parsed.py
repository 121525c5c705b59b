"""Messages are parsed once and evenly: refreshes of landed batches, streams of large files, deliveries that repeat."""

import glob

import pytest
from pyspark.sql import functions as F

from meterline.operators import ingest
from meterline.plans import catalog, refresh
from meterline.streaming import ingest as si

BITS = ingest.SOURCE_BITS


def messages(spark, n=60, partitions=3):
    value = """concat('{"query_id":', id, '}') AS value"""
    return spark.range(n).selectExpr("CAST(id AS STRING) AS key", value, "'t' AS topic", f"CAST(id % {partitions} AS INT) AS partition", "id AS offset")


def log_of(spark, last):
    rows = [("a", "done", s, i, None, None) for s, i in last.items()]
    return spark.createDataFrame([*rows, ("a", "done", None, None, None, None), ("b", "open", 2, 1 << 60, None, None)], refresh.LOG)


def test_taken_messages_are_dropped_before_they_are_parsed(spark):
    log = log_of(spark, {0: 30 << BITS, 1: 31 << BITS | 1})
    fresh = refresh._beyond(ingest.land(messages(spark)), log, BITS, "id")
    plan = fresh._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate explode") :]
    assert "try_element_at" in below or str(30 << BITS) in below
    assert "Join" not in plan
    want = [i for i in range(60) if i % 3 == 2 or i > 31]
    assert sorted(r.kafka_offset for r in fresh.select("kafka_offset").collect()) == want


@pytest.mark.parametrize("listed", [256, 1])
def test_unknown_sources_and_missing_ids_are_fresh(spark, monkeypatch, listed):
    monkeypatch.setattr(refresh, "LISTED_SOURCES", listed)
    rows = spark.createDataFrame([(8,), (16,), (24,), (9,), (17,), (10,), (None,)], "raw_id LONG")
    got = refresh._beyond(rows, log_of(spark, {0: 16, 1: 9}), 3)
    assert sorted(r.raw_id or -1 for r in got.collect()) == [-1, 10, 17, 24]


def test_rows_stored_but_not_noted_are_stored_once(spark, tmp_path, monkeypatch):
    root, landed = str(tmp_path), ingest.land(messages(spark))
    refresh.store_staged(landed.where("kafka_offset < 20"), root)
    log = refresh._log
    monkeypatch.setattr(refresh, "_log", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        refresh.store_staged(landed.where("kafka_offset < 40"), root)
    monkeypatch.setattr(refresh, "_log", log)
    staged = refresh.store_staged(landed, root)
    assert sorted(r.query_id for r in staged.select("query_id").collect()) == list(range(60))


def test_one_large_file_is_landed_by_many_tasks(spark, tmp_path):
    """One input task; the rows are decoded and written by as many as there are cores, each message once."""
    batch = messages(spark, 400, 2).coalesce(1)
    write = si.landing_writer(f"{tmp_path}/landing", f"{tmp_path}/rejects")
    write(batch.unionByName(batch.where("offset < 100")), 0)
    files = glob.glob(f"{tmp_path}/landing/kafka_topic=t/kafka_partition=0/*.parquet")
    assert len(files) == spark.sparkContext.defaultParallelism > 1
    write(batch, 1)
    landed = si.read_landing(spark, f"{tmp_path}/landing")
    assert sorted(r.kafka_offset for r in landed.select("kafka_offset").collect()) == list(range(400))
    assert si.read_rejects(spark, f"{tmp_path}/rejects").count() == 0


def test_neighbouring_ids_are_the_work_of_all_tasks(spark, sf_dir, same):
    dealt = catalog._messages(spark, sf_dir, tasks=4)
    batch = dealt.where("offset BETWEEN 100 AND 299")
    assert batch.select(F.spark_partition_id().alias("p")).distinct().count() == 4
    same(dealt, catalog._messages(spark, sf_dir))


def test_a_streamed_delivery_of_many_files_is_one_batch(spark, sf_dir, same, monkeypatch):
    monkeypatch.setattr(catalog, "_STORED", {})
    monkeypatch.setattr(catalog, "_tasks", lambda *a: 3)
    got = catalog.REGISTRY["stream_clean"](spark, sf_dir)
    (root,) = catalog._STORED.values()
    assert len(spark.read.parquet(f"{root}/../in").inputFiles()) == 9
    log = refresh.read(spark, root, "refresh_log").where("state = 'done'")
    assert log.select("batch").distinct().count() == 3
    same(got, catalog.REGISTRY["clean_table"](spark, sf_dir))
