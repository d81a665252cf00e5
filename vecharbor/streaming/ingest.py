"""Streaming ingestion into a plane, once a batch whatever is replayed.

The plane's watermark is the last batch whose rows are durable: a batch at or below it is
skipped. Rows and watermark are published by one manifest rename each, rows first; a batch cut
between the two is replayed as mirror writes, which give the same table again. ``seq`` is one
order over all batches: a row that comes late does not overwrite a newer one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.plane import Plane


def apply_batch(plane: Plane, rows: DataFrame, batch_id: int) -> bool:
    """Mirror rows (node_id, seq, embedding, key) of one batch; False if it was applied before."""
    if batch_id + 1 <= plane.watermark:
        return False
    if not rows.isEmpty():
        plane.mirror(rows, ordered=True)
    plane.flush(watermark=batch_id + 1)
    return True


def ingest(plane: Plane, stream: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Start ingesting ``stream``; one query a plane, as a plane has one writer.

    Rows come in chunks in order if the source bounds them (``maxFilesPerTrigger`` of a file source).
    """

    def each(rows: DataFrame, batch_id: int) -> None:
        apply_batch(plane, rows, batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
