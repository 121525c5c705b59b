from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from meterline.session import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
           "spark.sql.maxMetadataStringLength": "20000", "spark.sql.debug.maxToStringFields": "200"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def staged(spark, sf_dir):
    from meterline.operators.staging import stage_trace
    from meterline.sources.telemetry import read_telemetry

    return stage_trace(read_telemetry(spark, sf_dir)).persist()


@pytest.fixture(scope="session")
def make_trace(spark):
    """Trace rows from dicts; columns left out are NULL. Times are text."""
    from meterline.schemas import TRACE

    def make(*rows: dict):
        fields = {"raw_id": "BIGINT", **{f.name: f.dataType.simpleString() for f in TRACE.fields}}
        schema = ", ".join(
            f"{n} {'STRING' if t == 'timestamp' else t}" for n, t in fields.items()
        )
        data = [tuple(r.get(n) for n in fields) for r in rows]
        df = spark.createDataFrame(data, schema)
        return df.withColumn("arrival_timestamp", df.arrival_timestamp.cast("timestamp"))

    return make


def same(left, right) -> None:
    """Both frames hold the same rows, duplicates included."""
    right = right.select(*left.columns)
    assert left.count() == right.count()
    assert left.exceptAll(right).count() == 0


@pytest.fixture(scope="session", name="same")
def same_fixture():
    return same
