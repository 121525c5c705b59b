import pytest
from pyspark.sql import functions as F

from meterline.operators import merge
from meterline.sources import keyed


def table(spark, n=20_000):
    return spark.range(n).select(
        "id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("minute"), (F.col("id") % 7).alias("value")
    )


def changed(rows, where):
    return rows.where(where).withColumn("value", F.col("value") + 100)


def entries(spark, path):
    return {r.file: r.rows for r in keyed.files(spark, path).collect()}


@pytest.mark.parametrize("order", ["id", "minute"])
def test_a_thousand_keys_rewrite_only_their_files(spark, tmp_path, same, order):
    path, rows = f"{tmp_path}/t", table(spark)
    keyed.write(rows, path, order, parts=20)
    before = entries(spark, path)
    batch = changed(table(spark, 20_500), "id between 7000 and 7499 or id >= 20000")
    old = keyed.upsert(batch, path, "id", order, parts=2)
    after = entries(spark, path)
    assert len(before) >= 15 and 1 <= len(old) <= 2
    assert set(before) - set(after) == set(old) and sum(after.values()) == 20_500
    same(keyed.read(spark, path), merge.upsert_by_key(rows, batch, "id"))
    same(keyed.read(spark, path, 0), rows)


def test_scattered_keys_and_nulls(spark, tmp_path, same):
    path, rows = f"{tmp_path}/t", table(spark, 3000)
    rows = rows.withColumn("minute", F.when(F.col("id") % 50 != 3, F.col("minute"))).unionByName(
        spark.createDataFrame([(None, None, 1)], "id long, minute timestamp, value long")
    )
    keyed.write(rows, path, "minute", parts=8)
    batch = changed(rows, "id % 450 = 3 or id between 10 and 12 or id is null")
    assert len(keyed.upsert(batch, path, "id", "minute")) < 4
    want = merge.upsert_by_key(rows, batch, "id")
    same(keyed.read(spark, path), want)
    # the same again: nulls are added, keys replaced
    keyed.upsert(batch.where("id is not null"), path, "id", "minute")
    same(keyed.read(spark, path), want)


def test_empty_batch_empty_table_and_first_upsert(spark, tmp_path, same):
    path, rows = f"{tmp_path}/t", table(spark, 50)
    keyed.upsert(rows.limit(0), path, "id", "id")
    assert keyed.read(spark, path).schema.names == rows.columns and keyed.read(spark, path).count() == 0
    keyed.upsert(rows, path, "id", "id")
    keyed.upsert(rows.limit(0), path, "id", "id")
    assert keyed.version(spark, path) == 1
    same(keyed.read(spark, path), rows)
    with pytest.raises(ValueError, match="no finished table"):
        keyed.read(spark, f"{tmp_path}/none")


@pytest.mark.parametrize("fails", ["touched", "_add_files", "upsert_by_key", "files"])
def test_a_failed_upsert_leaves_the_table(spark, tmp_path, same, monkeypatch, fails):
    path, rows = f"{tmp_path}/t", table(spark, 2000)
    keyed.write(rows, path, "id", parts=4)
    batch = changed(rows, "id < 300")
    where = merge if fails == "upsert_by_key" else keyed
    real = getattr(where, fails)

    def broken(*args, **options):
        if fails == "files" and len(args) < 3:
            return real(*args, **options)
        if fails == "_add_files":
            real(*args, **options)
        raise OSError("lost")

    monkeypatch.setattr(where, fails, broken)
    with pytest.raises(OSError, match="lost"):
        keyed.upsert(batch, path, "id", "id")
    monkeypatch.undo()
    same(keyed.read(spark, path), rows)
    (tmp_path / "t/_versions/1").mkdir()  # a version that was begun and not finished
    keyed.upsert(batch, path, "id", "id")
    want = merge.upsert_by_key(rows, batch, "id")
    same(keyed.read(spark, path), want)
    assert keyed.drop_old(spark, path) >= 1
    same(keyed.read(spark, path), want)
    assert {f"data/{p.parent.name}/{p.name}" for p in (tmp_path / "t/data").rglob("*.parquet")} == set(entries(spark, path))


def test_touched_reads_only_candidates_and_keys(spark, tmp_path):
    path, rows = f"{tmp_path}/t", table(spark)
    keyed.write(rows, path, "id", parts=20)
    seen, real = [], keyed._load

    def load(spark, path, names):
        seen.append(names)
        return real(spark, path, names)

    keyed._load = load
    try:
        assert len(keyed.touched(changed(rows, "id = 5 or id = 19990"), path, "id", "id")) == 2
    finally:
        keyed._load = real
    assert len(seen[0]) == 2
