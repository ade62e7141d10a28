"""Streaming ingest: each micro-batch is one atomic commit of upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.mutations import Versions, upserted


def ingest(stream: DataFrame, versions: Versions, key: str, seq: list[str], checkpoint: str, content_hash: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Upsert a stream's documents: what a micro-batch holds is seen together, at its commit.

    A batch that runs again after a failure upserts the same rows, so nothing is doubled. Late
    rows are upserts like others: within a batch the highest seq of a key counts.
    """

    def commit(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        now = versions.read() if versions.current() is not None else batch.limit(0)
        versions.commit(upserted(now, batch, key, seq, content_hash))

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
