"""Typed staging of landed JSON events or of a typed trace (same rules, same columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from meterline.functions import values as V
from meterline.schemas import STAGED_COLUMNS, TRACE

UNKNOWN_FINGERPRINT = "UNKNOWN_FINGERPRINT"
ID_LISTS = ("read_table_ids", "write_table_ids")
# Columns whose missing value stays NULL; every other number defaults to 0.
NULLABLE = {
    "instance_id", "user_id", "database_id", "query_id", "cluster_size", "arrival_timestamp", "query_type",
}


def _from_text(f: T.StructField, text: str, strict: bool) -> str:
    if f.name in ID_LISTS:
        return text
    if isinstance(f.dataType, T.TimestampType):
        return V.to_time(text, strict)
    if isinstance(f.dataType, (T.IntegerType, T.LongType)):
        return V.to_whole(text, f.dataType.simpleString(), strict)
    if isinstance(f.dataType, T.DoubleType):
        return V.to_number(text, strict)
    return V.empty_to_null(text)


def _from_typed(f: T.StructField) -> str:
    if isinstance(f.dataType, T.DoubleType):
        return V.finite(f"CAST({f.name} AS DOUBLE)")
    if isinstance(f.dataType, T.StringType):
        return f.name if f.name in ID_LISTS else V.empty_to_null(f.name)
    return f"CAST({f.name} AS {f.dataType.simpleString()})"


def _staged_columns(raw_id: str, read: dict[str, str]) -> list[str]:
    """Defaults over the values read, in table order."""
    out = {
        "raw_id": raw_id,
        "has_read": V.has_items(read["read_table_ids"]),
        "has_write": V.has_items(read["write_table_ids"]),
    }
    for f in TRACE.fields:
        value = read[f.name]
        if f.name == "feature_fingerprint":
            value = f"coalesce({value}, '{UNKNOWN_FINGERPRINT}')"
        elif f.name not in NULLABLE:
            value = f"coalesce({value}, CAST(0 AS {f.dataType.simpleString()}))"
        out[f.name] = value
    return [f"{out[name]} AS {name}" for name in STAGED_COLUMNS]


def raw_scan(landing: DataFrame) -> DataFrame:
    """Landing rows that carry an event."""
    return landing.where("event IS NOT NULL")


def stage_events(landing: DataFrame, strict: bool = False) -> DataFrame:
    """Landed events -> staged rows. ``event`` is a VARIANT, or JSON text.

    A field may be a JSON number or text, so all are read as text, in one pass over the event, and then cast. ``strict``
    raises on text that does not fit its type; by default it reads as missing.
    """
    is_text = dict(landing.dtypes)["event"] == "string"
    fields = ", ".join(f"{f.name}{' ' if is_text else ':'}STRING" for f in TRACE.fields)
    read = f"from_json(event, '{fields}')" if is_text else f"try_variant_get(event, '$', 'struct<{fields}>')"
    rows = raw_scan(landing).selectExpr("id AS raw_id", f"{read} AS e").select("raw_id", "e.*")
    return rows.selectExpr(*_staged_columns("raw_id", {f.name: _from_text(f, f.name, strict) for f in TRACE.fields}))


def stage_trace(trace: DataFrame) -> DataFrame:
    """A typed trace (``raw_id`` + trace columns) -> staged rows, without a JSON detour."""
    return trace.selectExpr(*_staged_columns("raw_id", {f.name: _from_typed(f) for f in TRACE.fields}))
