"""Structured Streaming into a collection: each micro-batch is one atomic write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..store import Collection


def ingest_records(collection: Collection, stream: DataFrame, checkpoint: str, order: str | None = None, *, available_now: bool = True) -> StreamingQuery:
    """Puts the records (id, embedding, metadata, text) of a stream; see Collection.add_frame() for order.

    A batch that is tried again after a failure puts the same records again, which
    changes nothing.
    """

    def put(batch: DataFrame, _: int) -> None:
        collection.add_frame(batch, order)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest_edges(collection: Collection, stream: DataFrame, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Puts the edges (source_id, target_id, relation, metadata) of a stream."""

    def put(batch: DataFrame, _: int) -> None:
        collection.add_edge_frame(batch)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
