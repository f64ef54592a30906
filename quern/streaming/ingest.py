"""Indexing documents as they arrive."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quern.plans.engine import SearchEngine


def ingest(arriving: DataFrame, engine: SearchEngine, checkpoint: str, available_now: bool = True, every: str = "10 seconds") -> StreamingQuery:
    """Feed a stream of documents (title, body, created_at) into an engine, a micro-batch at a time, in order.

    How much a batch takes is set where the stream is read (maxFilesPerTrigger), which bounds what waits. Each batch is a part
    of the index, named by the checkpoint and its number; a batch that is repeated after a restart isn't added twice.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def add(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            engine.index(batch, batch=f"{stream}.{number}")

    writer = arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
