"""Continuous writes into a dataset by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..errors import invalid
from ..operators.dataset import Dataset, WriteReport


def write_stream(dataset: Dataset, frame: DataFrame, checkpoint: str, trigger: dict | None = None, on_report=None, **options) -> StreamingQuery:
    """Starts a query that appends each micro-batch of ``frame`` to the dataset, late rows as new parts of their old partition.

    ``trigger`` is what ``DataStreamWriter.trigger`` takes (all that is there
    now, by default); ``on_report`` gets each batch's number and WriteReport. A
    batch that runs again after a failure between its write and its commit is
    written again: a reader that must not see that twice keeps a key to tell.
    """
    if not frame.isStreaming:
        raise invalid("write_stream", "a continuous write needs a streaming DataFrame")

    def each(batch: DataFrame, number: int) -> None:
        report: WriteReport = dataset.write(batch, **options)
        if on_report:
            on_report(number, report)

    return frame.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
