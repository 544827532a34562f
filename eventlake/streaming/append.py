"""Group commit: a stream of events appended to a log, one manifest for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.log import EventLog


def append_stream(events: DataFrame, log: EventLog, checkpoint: str, order: list[str] | None = None, interval: str | None = None) -> StreamingQuery:
    """Starts the query: all that arrives within `interval` is one append (None: what is there now, then it ends). A batch
    that is run again after a failure is not appended twice."""

    def commit(batch: DataFrame, number: int) -> None:
        log.append(batch, order=order, batch=f"{checkpoint}#{number}")

    writer = events.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
