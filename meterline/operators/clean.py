"""The cleaned fact: row features first, then the filled cluster size."""

from __future__ import annotations

from pyspark.sql import DataFrame

from meterline.functions import scoring, timeops
from meterline.operators.fill import fill_cluster_size
from meterline.schemas import CLEAN_COLUMNS

MEASURES = (
    "compile_duration_ms", "queue_duration_ms", "execution_duration_ms", "mbytes_scanned", "mbytes_spilled",
)


def enrich(staged: DataFrame) -> DataFrame:
    """Everything about a query that its own row tells; no shuffle. Keeps the observed ``cluster_size``."""
    derived = {m: scoring.or_zero(m) for m in MEASURES}
    derived.update(
        minute_ts=timeops.minute_of("arrival_timestamp"),
        is_unknown_fingerprint=scoring.is_unknown_fingerprint(),
        query_end_timestamp=timeops.plus_millis(
            "arrival_timestamp", scoring.or_zero("execution_duration_ms")
        ),
        access_scope=scoring.access_scope(),
        workload_is_system_metadata=scoring.is_system_metadata(),
        workload_classification=scoring.workload_classification(scoring.is_system_metadata()),
        heavy_unit=scoring.heavy_unit(),
    )
    names = [c for c in CLEAN_COLUMNS if c != "cluster_size_clean"] + ["cluster_size"]
    return staged.selectExpr(*[f"{derived.get(c, c)} AS {c}" for c in names])


def clean_table(staged: DataFrame, seeds: DataFrame | None = None, **slicing) -> DataFrame:
    """Staged rows -> the 28-column cleaned fact."""
    return fill_cluster_size(enrich(staged), seeds=seeds, **slicing).select(*CLEAN_COLUMNS)
