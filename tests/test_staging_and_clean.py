import pytest
from pyspark.errors import PySparkException

from meterline.operators import clean, fill, staging
from meterline.schemas import CLEAN_COLUMNS, STAGED_COLUMNS

T0 = "2024-01-01 10:00:00"


def landing(spark, *events):
    return spark.createDataFrame([(i + 1, e) for i, e in enumerate(events)], "id BIGINT, event STRING")


def test_json_text_becomes_typed_values(spark):
    event = (
        '{"instance_id":"3","user_id":4,"query_id":"9007199254740993","cluster_size":"2.5",'
        '"arrival_timestamp":"2024-01-01 10:00:00+00:00","was_cached":"1.0","was_aborted":"",'
        '"read_table_ids":"  ","write_table_ids":" 7 ","feature_fingerprint":"","query_type":""}'
    )
    row = staging.stage_events(landing(spark, event, None)).collect()
    assert len(row) == 1 and row[0].asDict().keys() == set(STAGED_COLUMNS)
    r = row[0]
    assert (r.instance_id, r.user_id, r.query_id, r.cluster_size) == (3, 4, 9007199254740993, 2.5)
    assert (r.was_cached, r.was_aborted, r.has_read, r.has_write) == (1, 0, False, True)
    assert r.feature_fingerprint == "UNKNOWN_FINGERPRINT" and r.query_type is None
    assert r.execution_duration_ms == 0.0 and str(r.arrival_timestamp) == T0


def test_tolerant_and_strict_casts(spark):
    bad = landing(spark, '{"instance_id":"x","mbytes_scanned":"NaN","cluster_size":"Infinity"}')
    r = staging.stage_events(bad).first()
    assert (r.instance_id, r.mbytes_scanned, r.cluster_size) == (None, 0.0, None)
    with pytest.raises(PySparkException):
        staging.stage_events(bad, strict=True).collect()


def test_typed_trace_drops_nonfinite_numbers(make_trace):
    t = make_trace({"raw_id": 1, "cluster_size": float("nan"), "mbytes_spilled": float("-inf")})
    r = staging.stage_trace(t).first()
    assert (r.cluster_size, r.mbytes_spilled) == (None, 0.0)


SCOPES = [
    (dict(num_external_tables_accessed=1.0, num_system_tables_accessed=1.0), "External (Data Lake)"),
    (dict(num_system_tables_accessed=2.0, num_permanent_tables_accessed=1.0), "System Internal"),
    (dict(num_permanent_tables_accessed=1.0), "Core Warehousing"),
    (dict(), "Metadata only"),
]
CLASSES = [
    (dict(num_system_tables_accessed=1.0, read_table_ids="1"), "System/Metadata"),
    (dict(query_type="VACUUM", read_table_ids="1"), "System/Metadata"),
    (dict(query_type="select", read_table_ids="1", write_table_ids="2"), "Read/Write"),
    (dict(read_table_ids="1"), "Read only"),
    (dict(write_table_ids="2"), "Write only"),
    (dict(query_type="select"), "Unknown/Other"),
]
SCORES = [
    (dict(was_cached=1, was_aborted=1, execution_duration_ms=9e9), 0.05),
    (dict(was_aborted=1, execution_duration_ms=9e9), 0.10),
    (dict(), 0.05),
    (dict(execution_duration_ms=150000.0), 0.2),
    (dict(execution_duration_ms=9e9, mbytes_scanned=5120.0, mbytes_spilled=512.0), 0.7),
    (dict(execution_duration_ms=9e9, mbytes_scanned=9e9, mbytes_spilled=9e9), 1.0),
]


@pytest.mark.parametrize(
    "cases,column",
    [(SCOPES, "access_scope"), (CLASSES, "workload_classification"), (SCORES, "heavy_unit")],
)
def test_row_features(make_trace, cases, column):
    rows = [{"raw_id": i, **values} for i, (values, _) in enumerate(cases)]
    got = clean.enrich(staging.stage_trace(make_trace(*rows))).orderBy("raw_id").collect()
    want = [w for _, w in cases]
    assert [r[column] for r in got] == (pytest.approx(want) if column == "heavy_unit" else want)


def test_fingerprints_and_end_times(make_trace):
    t = make_trace(
        dict(raw_id=1, feature_fingerprint="unknown", arrival_timestamp=T0, execution_duration_ms=61500.25),
        dict(raw_id=2, feature_fingerprint="fp", arrival_timestamp=T0, execution_duration_ms=-1000.0),
        dict(raw_id=3, feature_fingerprint=None),
    )
    a, b, c = clean.enrich(staging.stage_trace(t)).orderBy("raw_id").collect()
    assert (a.is_unknown_fingerprint, b.is_unknown_fingerprint, c.is_unknown_fingerprint) == (True, False, True)
    assert str(a.query_end_timestamp) == "2024-01-01 10:01:01.500250"
    assert str(b.query_end_timestamp) == "2024-01-01 09:59:59"
    assert c.query_end_timestamp is None and c.minute_ts is None


def test_clean_table_has_its_28_columns(staged):
    rows = clean.clean_table(staged)
    assert rows.columns == CLEAN_COLUMNS and len(CLEAN_COLUMNS) == 28
    assert rows.where("heavy_unit < 0.05 OR heavy_unit > 1 OR cluster_size_clean IS NULL").count() == 0


def test_median_interpolates_and_keeps_unsized_instances(make_trace):
    t = make_trace(
        dict(raw_id=1, instance_id=1, cluster_size=2.0),
        dict(raw_id=2, instance_id=1, cluster_size=5.0),
        dict(raw_id=3, instance_id=2),
    )
    got = {r.raw_id: r.median_cluster_size for r in fill.attach_median(t).collect()}
    assert got == {1: 3.5, 2: 3.5, 3: None}
