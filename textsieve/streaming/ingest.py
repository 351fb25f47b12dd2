"""Indexing a stream: each micro-batch is a run of its own, and runs are merged now and then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from textsieve.sources.index import TrigramIndex


def ingest(stream: DataFrame, root: str, checkpoint: str, compact_every: int = 8, once: bool = True) -> StreamingQuery:
    """Appends a stream's rows to the index in `root`.

    A batch that was interrupted and comes again may be indexed twice; postings are sets, so
    searches are none the worse, and the next merge leaves one of each.
    """

    def write(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        index = TrigramIndex(batch.sparkSession, root)
        index.append(batch)
        if (number + 1) % compact_every == 0:
            index.compact()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
