"""Aggregates whose result does not depend on the order rows arrive in, ratios and keys."""

from __future__ import annotations

# Scores lie in [0, 1]; twelve decimals keep every digit a report shows.
SCORE_TYPE = "DECIMAL(18,12)"


def score_sum(score: str = "heavy_unit") -> str:
    """Sum of cost scores as an exact decimal.

    Floating sums change in the last digits with task order, retries and batch cuts, which would
    reorder tied leaderboard rows. The decimal sum is the same whatever the partitioning.
    """
    return f"sum(CAST({score} AS {SCORE_TYPE}))"


def as_double(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def ratio(numerator: str, denominator: str) -> str:
    """``numerator / denominator``, NULL where the denominator is 0."""
    return f"({as_double(numerator)} / nullif({as_double(denominator)}, 0D))"


def surrogate_key(*parts: str) -> str:
    """md5 over ``-``-joined parts; NULL if any part is NULL."""
    pieces = ", '-', ".join(f"CAST({p} AS STRING)" for p in parts)
    return f"md5(concat({pieces}))"
