"""Cleaning of single values: empty text, tolerant casts, non-finite numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def empty_to_null(x: str) -> str:
    return f"nullif({x}, '')"


def finite(x: str) -> str:
    """A double with NaN and both infinities replaced by NULL (NaN sorts above infinity)."""
    return f"CASE WHEN abs({x}) < double('Infinity') THEN {x} END"


def to_number(text: str, strict: bool = False) -> str:
    value = f"{'CAST' if strict else 'TRY_CAST'}({empty_to_null(text)} AS DOUBLE)"
    return finite(value)


def to_whole(text: str, type_name: str, strict: bool = False) -> str:
    """Integer from text. ``strict`` raises on ``'1.0'``; the tolerant form reads it as 1."""
    value = empty_to_null(text)
    if strict:
        return f"CAST({value} AS {type_name})"
    # a direct read first: going through double would round 64-bit ids
    return (
        f"coalesce(TRY_CAST({value} AS {type_name}), "
        f"TRY_CAST(TRY_CAST({value} AS DOUBLE) AS {type_name}))"
    )


def to_time(text: str, strict: bool = False) -> str:
    return f"{'CAST' if strict else 'TRY_CAST'}({empty_to_null(text)} AS TIMESTAMP)"


def has_items(id_list: str) -> str:
    """True if a comma list holds anything but blanks."""
    return f"{empty_to_null(f'trim({id_list})')} IS NOT NULL"


def sanitize(c: Column, dtype: T.DataType) -> Column:
    """Non-finite numbers to NULL at any depth of structs, arrays and maps."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(F.abs(c) < float("inf"), c)
    if isinstance(dtype, T.ArrayType) and _has_float(dtype.elementType):
        return F.transform(c, lambda x: sanitize(x, dtype.elementType))
    if isinstance(dtype, T.MapType) and _has_float(dtype.valueType):
        return F.transform_values(c, lambda _k, v: sanitize(v, dtype.valueType))
    if isinstance(dtype, T.StructType) and _has_float(dtype):
        fields = [sanitize(c.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def _has_float(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _has_float(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_float(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(_has_float(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.DoubleType, T.FloatType))
