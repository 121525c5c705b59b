import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.operators import ingest, staging
from meterline.sources import streams, tables
from meterline.sources.telemetry import read_telemetry


def messages(spark, *values):
    rows = [(str(i), v, "t", i % 2, i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "key STRING, value STRING, topic STRING, partition INT, offset BIGINT")


def test_trace_needs_its_time_column(spark, tmp_path, sf_dir):
    spark.range(3).write.parquet(str(tmp_path / "x"))
    with pytest.raises(ValueError, match="arrival_timestamp.*id"):
        tables.read_trace(spark, str(tmp_path / "x"))
    assert tables.read_trace(spark, f"{sf_dir}/events.parquet", time_col="ts").count() == 1000


def test_prepare_drops_bad_times_and_sorts(spark):
    df = spark.createDataFrame([(1, "2024-01-02"), (2, "junk"), (3, "2024-01-01 05:00:00+02:00"), (4, None)], "id INT, t STRING")
    got = ingest.prepare_trace(df, "t").collect()
    assert [(r.id, str(r.t)) for r in got] == [(3, "2024-01-01 03:00:00"), (1, "2024-01-02 00:00:00")]


def test_only_whole_json_objects_are_accepted(spark):
    good = ['{"a":1}', ' {"a":{"b":2}} ', "{}", '{"a":1}\n', '{"a":1}\t', '{"a":1,"a":2}']
    bad = ["", "null", "12", "[1]", '[{"a":1}]', "{bad", '{"a":1} x', None, '{"a":1}{"b":2}', '{"a":1} x}', '{"a":1},{"b":2}']
    bad += ['{"a":1}],[{"b":1}', '{"a":1},', "]"]
    bad += ['{"a":1}}', '{"a":1,}', '{"a":[1}', '{"a":{"b":1}', '{"a":"x}', '{"a":"b\\"}', "{", "}", "{,}", '{"a"}', '{"a":01}', '{"_ingest_ts_utc":"x"} {}']
    good += ["{ }", '{"a":{}}', '{"a":"}"}', '{"a":"{"}', '{"a":"\\\\"}', '{"a":[{}]}', '{"a":NaN}', '{"a":"NaN, \\"NaN","b":-Infinity}', '{"é漢":"😀"}']
    decoded = ingest.decode_messages(messages(spark, *good, *bad))
    assert {r.value for r in decoded.where("event IS NOT NULL").collect()} == set(good)
    assert ingest.accepted(decoded).count() == len(good)
    assert ingest.rejected(decoded).count() == len(bad)


def event_of(spark, text):
    return json.loads(ingest.land(messages(spark, text)).selectExpr("to_json(event) AS e").first().e)


def test_values_keep_their_types(spark):
    text = '{"a":1,"b":1.5,"c":true,"d":null,"e":"1","f":[1,"x",{"g":[]}],"h":{},"i":12345678901234567890,"j":-0.25,"k":1e3}'
    got = event_of(spark, text)
    sent = json.loads(text)
    assert {k: got[k] for k in sent} == sent and [type(got[k]) for k in sent] == [type(sent[k]) for k in sent]


def test_nonfinite_numbers_become_null_at_any_depth(spark):
    text = """{"a":NaN,"b":-Infinity,"c":"NaN","d":{"x":[1,NaN,-2,+INF],"y":"k: NaN, \\" -Infinity"},"e":1.5,"f":-1e-400,"g":[1e400,-2.5E+999,1e308,12e0309],
        "I":[-3,4e+05]}"""
    got = event_of(spark, text)
    assert got["a"] is None and got["b"] is None and got["c"] == "NaN" and got["e"] == 1.5
    assert got["d"] == {"x": [1, None, -2, None], "y": 'k: NaN, " -Infinity'}
    assert got["g"] == [None, None, 1e308, None] and got["f"] == 0 and got["I"] == [-3, 400000.0]
    assert got["_kafka_topic"] == "t" and got["_kafka_offset"] == 0 and got["_kafka_partition"] == 0 and got["_kafka_key"] == "0"


def test_long_texts_with_nonfinite_numbers(spark):
    text = '{"x":[' + ",".join(['"a\\"b"', "-1.5", "NaN", "{}"] * 20_000) + "]}"
    got = event_of(spark, text)
    assert got["x"] == ['a"b', -1.5, None, {}] * 20_000


def test_of_repeated_names_the_last_counts_at_any_depth(spark):
    got = event_of(spark, '{"a":1,"b":{"c":1,"c":2},"a":2,"_kafka_topic":"mine"}')
    assert got["a"] == 2 and got["b"] == {"c": 2} and got["_kafka_topic"] == "t"


def test_events_as_text_are_staged_like_variants(spark, make_trace, same):
    texts = ['{"query_id":"12345678901234567","was_aborted":"1.0","cluster_size":"","mbytes_scanned":1.5,"query_type":"","instance_id":null}',
             '{"query_id":7,"was_aborted":1.0,"cluster_size":"NaN","mbytes_scanned":"2.5","arrival_timestamp":"2024-01-01 05:00:00+02:00"}',
             '{"query_id":"x","num_joins":"y","cluster_size":4,"feature_fingerprint":5}']
    landed = ingest.land(messages(spark, *texts), "offset")
    as_text = landed.selectExpr("id", "to_json(event) AS event")
    same(staging.stage_events(landed), staging.stage_events(as_text))
    got = staging.stage_events(landed).orderBy("raw_id").collect()
    assert [r.query_id for r in got] == [12345678901234567, 7, None] and [r.was_aborted for r in got] == [1, 1, 0]
    assert [r.cluster_size for r in got] == [None, None, 4.0] and [r.mbytes_scanned for r in got] == [1.5, 2.5, 0.0]
    assert str(got[1].arrival_timestamp) == "2024-01-01 03:00:00" and got[2].feature_fingerprint == "5" and got[0].query_type is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|malformed"):
        staging.stage_events(landed, strict=True).collect()


def test_ids_name_topic_and_partition(spark):
    rows = [("t", 4096, 5), ("t", 0, 6), ("t", 0, 5), ("u", 0, 5), ("u", 1_000_000, 5)]
    df = spark.createDataFrame(rows, "topic STRING, partition INT, offset BIGINT")
    ids = [r[0] for r in df.selectExpr(ingest.arrival_id(topics=("t", "u"))).collect()]
    assert len(set(ids)) == len(rows)
    for bad in (("t", 1 << 20, 1), ("other", 0, 1), ("t", 0, 1 << 40)):
        with pytest.raises(Exception, match="no id for this"):
            spark.createDataFrame([bad], df.schema).selectExpr(ingest.arrival_id(topics=("t", "u"))).collect()


def test_typed_sanitizer_walks_structs_arrays_and_maps(spark):
    nan, inf = float("nan"), float("inf")
    schema = "a DOUBLE, s STRUCT<x: DOUBLE, y: STRING>, l ARRAY<DOUBLE>, m MAP<STRING, ARRAY<DOUBLE>>"
    df = spark.createDataFrame([(nan, (inf, "k"), [1.0, -inf], {"k": [nan, 2.0]})], schema)
    r = ingest.sanitize_nonfinite(df).first()
    assert r.a is None and r.s.x is None and r.s.y == "k" and r.l == [1.0, None] and r.m == {"k": [None, 2.0]}
    assert ingest.sanitize_nonfinite(df).schema.simpleString() == T._parse_datatype_string(schema).simpleString()


def test_encode_decode_equals_direct_staging(spark, sf_dir, same):
    trace = read_telemetry(spark, sf_dir)
    sent = ingest.encode_messages(trace).selectExpr(
        "key", "value", "'t' AS topic", "0 AS partition", "CAST(key AS BIGINT) AS offset"
    )
    landed = ingest.land(sent, "offset")
    same(staging.stage_events(landed), staging.stage_trace(trace))


def test_missing_query_id_gives_a_null_key(spark):
    df = spark.createDataFrame([(None, 1), (5, 2)], "query_id BIGINT, x INT")
    assert sorted(str(r.key) for r in ingest.encode_messages(df).collect()) == ["5", "None"]


def test_redelivery_changes_nothing(spark, same):
    batch = ingest.land(messages(spark, *['{"a":1}'] * 6)).drop("ingest_ts")
    batch = batch.drop("event").selectExpr("id", "'{}' AS event", *[c for c in batch.columns if c not in ("id", "event")])
    empty = batch.where("false")
    once = ingest.idempotent_append(batch.unionByName(batch), empty)
    assert once.count() == 6
    same(ingest.idempotent_append(batch, once), once)


def test_read_since_pages_through_all_rows(spark):
    rows = spark.range(25).withColumnRenamed("id", "raw_id")
    seen, last = [], -1
    while page := [r.raw_id for r in ingest.read_since(rows, last, 10, "raw_id").collect()]:
        seen, last = seen + page, page[-1]
    assert seen == list(range(25))


def test_kafka_options_start_at_earliest():
    got = streams.kafka_options("h:1", "t", max_offsets=7)
    assert got == {"kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "earliest", "maxOffsetsPerTrigger": "7"}
