"""SQL expression text: helpers that take and return expressions, and run no jobs.

Wide projections are written as SQL text because one parsed expression costs the driver one call, where a
Column tree costs several per operator. Use ``exprs`` to pass the text where Columns are expected.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exprs(*texts: str) -> list[Column]:
    return [F.expr(t) for t in texts]
