import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from meterline.llm import decontaminate, fertility, minhash
from meterline.llm.queries import _workers_find_us

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    _workers_find_us(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    kept = docs
    names = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        names.append(name)
        assert kept.columns == docs.columns
        ids, was = {r.doc_id for r in kept.select("doc_id").collect()}, {r.doc_id for r in before.select("doc_id").collect()}
        assert ids <= was
        if name == "quality_rules":
            assert ids == {r.doc_id for r in fertility.quality(before).where("kept").collect()}
        if name == "near_duplicates":
            assert ids == {r.doc_id for r in minhash.near_duplicates(before, 80).where("kept").collect()}
        if name == "decontamination":
            leaks = decontaminate.find_leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert was - ids == {r.doc_id for r in leaks.collect()}
    assert names == ["quality_rules", "near_duplicates", "decontamination", "mix_sources"]
    packed = corpus_pipeline.packed_rows(spark, kept, SF).collect()
    assert {d for r in packed for d in r.doc_ids} == ids
    assert all(len(np.frombuffer(r.input_ids, "<u2")) == 2048 for r in packed)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 10


def test_stages_carry_columns_with_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    names = ["kept", "n_words", "base_failed", "component_id", "of_text", "_of_id", "_key", "_doc", "_copy", "_mix", "row", "size"]
    wide = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names}).cache()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SF)
        rows = out.collect()
        assert out.columns == wide.columns and rows
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)


def test_near_duplicates_drops_texts_and_not_ids(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (2, "an entirely different text of the same id"), (None, None)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame([rows[0], *rows[2:]], out.schema).collect()))
