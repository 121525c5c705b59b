from meterline.operators import bounds, clean, ingest, kpis, staging
from meterline.plans import refresh
from meterline.schemas import TRACE
from meterline.sources import streams, tables
from meterline.sources.telemetry import read_telemetry
from meterline.streaming import ingest as si
from meterline.streaming import kpis as sk


def sent(spark, sf_dir):
    rows = ingest.encode_messages(read_telemetry(spark, sf_dir))
    return rows.selectExpr("key", "value", "'t' AS topic", "CAST(CAST(key AS BIGINT) % 3 AS INT) AS partition", "CAST(key AS BIGINT) AS offset")


def run(stream, write, checkpoint):
    si.start(stream, write, checkpoint, once=True).awaitTermination()


def test_restarts_and_replays_land_each_message_once(spark, sf_dir, tmp_path):
    source, landing, rejects = (str(tmp_path / n) for n in ("in", "landing", "rejects"))
    rows = sent(spark, sf_dir)
    lost = [("x", "{oops", "t", 9, 1), ("y", "{no origin", None, None, None), ("y", "{another", None, None, None)]
    broken = spark.createDataFrame(lost, "key STRING, value STRING, topic STRING, partition INT, offset BIGINT")
    rows.where("offset < 600").repartition(3).write.parquet(source)
    write = si.landing_writer(landing, rejects)
    messages = streams.read_message_stream(spark, source, max_files=1)
    run(messages, write, str(tmp_path / "c1"))
    assert si.read_landing(spark, landing).count() == 600
    # more files, some of them repeating messages; the same checkpoint goes on
    rows.where("offset >= 500").unionByName(broken).repartition(2).write.mode("append").parquet(source)
    run(messages, write, str(tmp_path / "c1"))
    # a lost checkpoint replays everything
    run(messages, write, str(tmp_path / "c2"))
    landed = si.read_landing(spark, landing)
    assert landed.count() == 1000 == landed.select("id").distinct().count()
    assert si.read_rejects(spark, rejects).count() == 3


def test_landed_messages_stage_like_the_trace(spark, sf_dir, tmp_path, same):
    source, landing = str(tmp_path / "in"), str(tmp_path / "landing")
    sent(spark, sf_dir).write.parquet(source)
    run(streams.read_message_stream(spark, source), si.landing_writer(landing), str(tmp_path / "c"))
    got = refresh.store_staged(si.read_landing(spark, landing), str(tmp_path / "tables")).drop("raw_id")
    same(got, staging.stage_trace(read_telemetry(spark, sf_dir)).drop("raw_id"))


def test_stream_in_many_batches_equals_batch_for_closed_minutes(spark, sf_dir, tmp_path, same):
    """Files in time order, one per micro-batch, with a restart in the middle."""
    trace = read_telemetry(spark, sf_dir)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = trace.schema
    for i, cut in enumerate([250, 500, 750]):
        trace.where(f"raw_id >= {cut - 250} AND raw_id < {cut}").coalesce(1).write.mode("append").parquet(source)
    stream = clean.enrich(
        staging.stage_trace(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    )
    write = sk.closed_writer(out, str(tmp_path / "c"))
    run(sk.efficiency_stream(stream), write, str(tmp_path / "c"))
    trace.where("raw_id >= 750").coalesce(1).write.mode("append").parquet(source)
    run(sk.efficiency_stream(stream), write, str(tmp_path / "c"))
    rows = clean.enrich(staging.stage_trace(trace))
    same(sk.read_closed(spark, out), kpis.minute_query_efficiency(rows, bounds.gate_of(rows)))
    # a new checkpoint over old output closes every minute again, and each counts once
    run(sk.efficiency_stream(stream), sk.closed_writer(out, str(tmp_path / "c2")), str(tmp_path / "c2"))
    same(sk.read_closed(spark, out), kpis.minute_query_efficiency(rows, bounds.gate_of(rows)))
    assert set(f.name for f in TRACE.fields) <= set(trace.columns)
    assert tables.table_exists(spark, out)
