"""The stored tables, kept up to date by a stream of staged rows: one refresh per micro-batch.

The checkpoint is the progress. A batch is known by the checkpoint it came from and its number, so a batch that is delivered
again adds nothing, and one that failed between two writes is finished. Cleaning, filling and concurrency use what is
stored of earlier batches: the last known cluster size per instance, and the days with queries still running. Rows that
come late rewrite the days from theirs on, however late they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from meterline.operators import ingest, staging
from meterline.plans import refresh
from meterline.streaming import ingest as landing
from meterline.streaming.totals import generation_of

REFRESH_INTERVAL = "30 seconds"


def staged_stream(messages: DataFrame) -> DataFrame:
    """Staged rows of a stream of messages; messages that are no JSON object drop out (land them to keep them)."""
    return staging.stage_events(ingest.land(messages))


def refresh_writer(root: str, checkpoint: str, source_bits: int = ingest.SOURCE_BITS, **slicing) -> Callable[[DataFrame, int], None]:
    """Batch function for staged rows. ``checkpoint`` is the stream's own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            refresh.add_batch(batch, root, generation_of(batch.sparkSession, checkpoint), batch_id, source_bits, **slicing)

    return write


def start(messages: DataFrame, root: str, checkpoint: str, once: bool = False, interval: str = REFRESH_INTERVAL, **slicing) -> StreamingQuery:
    """Refresh every ``interval``, or until the source is drained."""
    return landing.start(staged_stream(messages), refresh_writer(root, checkpoint, **slicing), checkpoint, once, interval)
