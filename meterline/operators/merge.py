"""Merging a recomputed batch into a table, as DataFrames (no storage involved)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from meterline.operators import bounds


def upsert_by_key(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Target rows whose key is not in the batch, plus the batch."""
    kept = target.join(batch.select(key), key, "left_anti")
    return kept.unionByName(batch.select(*target.columns))


def replace_since(target: DataFrame, batch: DataFrame, time_col: str, bound: int | None) -> DataFrame:
    """Target rows before ``bound`` plus the batch, which holds every row from ``bound`` on.

    Unlike a merge by key this also drops rows that the recompute no longer yields (values that left a
    top ten), needs no join, and works for rows with NULL keys.
    """
    kept = bounds.before(target, time_col, bound)
    return kept.unionByName(batch.select(*target.columns))

