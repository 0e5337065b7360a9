"""The index kept up to date from a stream of analysed facts: each micro-batch is one upsert and one version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lumidex.operators.index import upsert
from lumidex.sources.photo_index import update_index


def follow(facts: DataFrame, root: str, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Starts a query that upserts every batch of ``facts`` (a streaming DataFrame with ``path``) into the index at ``root``.

    The version that holds a batch tells its number under the stream's name (by default its
    checkpoint), so a batch that is retried after a failure is in the index once, and other writers' versions are kept.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            update_index(batch.sparkSession, root, lambda current: upsert(current, batch), (name or checkpoint, number))

    return facts.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
