import pytest
from pyspark.sql import functions as F

from meterline.operators import staging
from meterline.plans import refresh
from meterline.sources.telemetry import read_telemetry

TABLES = ["clean", "instance_days", *refresh.KPI_TIME]


def awkward(spark, sf_dir):
    """Late rows (hours and days), a row without time, one instance sized only at the very end and one
    sized late."""
    t = read_telemetry(spark, sf_dir)
    late = """CASE WHEN raw_id % 17 = 0 THEN arrival_timestamp - INTERVAL 3 HOURS
        WHEN raw_id % 101 = 0 THEN arrival_timestamp - INTERVAL 50 HOURS
        WHEN raw_id = 777 THEN NULL ELSE arrival_timestamp END"""
    size = """CASE WHEN instance_id = 7 AND raw_id > 800 THEN 4D
        WHEN instance_id = 6 AND raw_id < 500 THEN NULL ELSE cluster_size END"""
    return t.withColumn("arrival_timestamp", F.expr(late)).withColumn("cluster_size", F.expr(size))


@pytest.mark.parametrize(
    "shape,cuts", [("late", [250, 600, 601, 850]), ("in_order", [400, 700])], ids=["late", "in_order"]
)
def test_batches_give_the_same_tables_as_a_full_refresh(spark, sf_dir, tmp_path, same, shape, cuts):
    trace = awkward(spark, sf_dir) if shape == "late" else read_telemetry(spark, sf_dir)
    staged = staging.stage_trace(trace).persist()
    refresh.full_refresh(staged, f"{tmp_path}/full")
    for cut in [*cuts, 10_000]:
        assert refresh.incremental_refresh(staged.where(f"raw_id < {cut}"), f"{tmp_path}/inc")
    assert not refresh.incremental_refresh(staged, f"{tmp_path}/inc")
    for name in TABLES:
        same(refresh.read(spark, f"{tmp_path}/full", name), refresh.read(spark, f"{tmp_path}/inc", name))


def test_a_lagging_source_loses_nothing(spark, sf_dir, tmp_path, same):
    """Source 5 sends its early rows last; their ids lie below those of every other source."""
    t = read_telemetry(spark, sf_dir).withColumn("raw_id", F.expr("(raw_id + instance_id * 100000) * 8 + instance_id"))
    staged = staging.stage_trace(t).persist()
    refresh.full_refresh(staged, f"{tmp_path}/full", source_bits=3)
    for part in ("query_id < 500 AND instance_id <> 0", "query_id < 800", "true"):
        assert refresh.incremental_refresh(staged.where(part), f"{tmp_path}/inc", source_bits=3)
    assert not refresh.incremental_refresh(staged, f"{tmp_path}/inc", source_bits=3)
    for name in TABLES:
        same(refresh.read(spark, f"{tmp_path}/full", name), refresh.read(spark, f"{tmp_path}/inc", name))


class Lost(Exception):
    pass


@pytest.mark.parametrize("late", [False, True])
def test_a_batch_that_fails_after_any_write_is_redone(spark, sf_dir, tmp_path, same, monkeypatch, late):
    trace = awkward(spark, sf_dir) if late else read_telemetry(spark, sf_dir)
    staged = staging.stage_trace(trace).persist()
    refresh.full_refresh(staged, f"{tmp_path}/full")
    root = f"{tmp_path}/inc"
    refresh.incremental_refresh(staged.where("raw_id < 200"), root)
    write = refresh.tables._write
    for step, cut in enumerate([400, 600, 800, 900], 1):
        count = [0]

        def fails(rows, path, mode, overwrite):
            write(rows, path, mode, overwrite)
            count[0] += 1
            if count[0] == (1, 2, 5, 8)[step - 1]:
                raise Lost

        monkeypatch.setattr(refresh.tables, "_write", fails)
        with pytest.raises(Lost):
            refresh.incremental_refresh(staged.where(f"raw_id < {cut}"), root)
        monkeypatch.setattr(refresh.tables, "_write", write)
        if step % 2:
            assert refresh.incremental_refresh(staged.where(f"raw_id < {cut}"), root)
    assert refresh.incremental_refresh(staged, root)
    assert not refresh.incremental_refresh(staged, root)
    for name in TABLES:
        same(refresh.read(spark, f"{tmp_path}/full", name), refresh.read(spark, root, name))
