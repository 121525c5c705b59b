"""Row-level features of one executed query: flags, scopes, workload class and cost score."""

from __future__ import annotations

# Query types that never touch user data.
SYSTEM_QUERY_TYPES = (
    "analyze", "vacuum", "commit", "rollback", "begin", "set", "show", "describe", "explain",
)
# Fingerprints that mean "none".
UNKNOWN_FINGERPRINTS = ("UNKNOWN", "UNKNOWN_FINGERPRINT")
# Fixed values of the cost model: saturation points and weights per resource, and the flat scores.
EXEC_MS_CAP, SCAN_MB_CAP, SPILL_MB_CAP = 300000.0, 10240.0, 1024.0
EXEC_WEIGHT, SCAN_WEIGHT, SPILL_WEIGHT = 0.4, 0.4, 0.2
CACHED_SCORE, ABORTED_SCORE, MIN_SCORE, MAX_SCORE = 0.05, 0.10, 0.05, 1.0


def or_zero(x: str) -> str:
    return f"coalesce({x}, 0D)"


def is_unknown_fingerprint(fingerprint: str = "feature_fingerprint") -> str:
    return f"coalesce({fingerprint} = '' OR upper({fingerprint}) IN {UNKNOWN_FINGERPRINTS}, true)"


def access_scope(
    external: str = "num_external_tables_accessed",
    system: str = "num_system_tables_accessed",
    permanent: str = "num_permanent_tables_accessed",
) -> str:
    """Widest kind of table a query touched; external wins over system, system over permanent."""
    return f"""CASE WHEN {or_zero(external)} > 0 THEN 'External (Data Lake)'
        WHEN {or_zero(system)} > 0 THEN 'System Internal'
        WHEN {or_zero(permanent)} > 0 THEN 'Core Warehousing'
        ELSE 'Metadata only' END"""


def is_system_metadata(
    system_tables: str = "num_system_tables_accessed", query_type: str = "query_type"
) -> str:
    return (
        f"({or_zero(system_tables)} > 0 "
        f"OR coalesce(lower({query_type}) IN {SYSTEM_QUERY_TYPES}, false))"
    )


def workload_classification(
    system_metadata: str = "workload_is_system_metadata",
    has_read: str = "has_read",
    has_write: str = "has_write",
) -> str:
    return f"""CASE WHEN {system_metadata} THEN 'System/Metadata'
        WHEN {has_read} AND {has_write} THEN 'Read/Write'
        WHEN {has_read} THEN 'Read only'
        WHEN {has_write} THEN 'Write only'
        ELSE 'Unknown/Other' END"""


def heavy_unit(
    was_cached: str = "was_cached",
    was_aborted: str = "was_aborted",
    exec_ms: str = "execution_duration_ms",
    scanned_mb: str = "mbytes_scanned",
    spilled_mb: str = "mbytes_spilled",
    *,
    exec_cap: float = EXEC_MS_CAP,
    scan_cap: float = SCAN_MB_CAP,
    spill_cap: float = SPILL_MB_CAP,
) -> str:
    """Cost score of one query in [0.05, 1]: a weighted mix of saturating resource shares."""

    def share(amount: str, cap: float, weight: float) -> str:
        return f"{weight}D * least({or_zero(amount)} / {cap}D, 1D)"

    mix = " + ".join(
        (
            share(exec_ms, exec_cap, EXEC_WEIGHT),
            share(scanned_mb, scan_cap, SCAN_WEIGHT),
            share(spilled_mb, spill_cap, SPILL_WEIGHT),
        )
    )
    return f"""CASE WHEN {was_cached} = 1 THEN {CACHED_SCORE}D
        WHEN {was_cached} <> 1 AND {was_aborted} = 1 THEN {ABORTED_SCORE}D
        ELSE least({MAX_SCORE}D, greatest({MIN_SCORE}D, {mix})) END"""
