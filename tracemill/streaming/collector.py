"""The resumable batch collector as a stream: each micro-batch of verdicts is merged into the table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracemill.operators.backtracking import merge


def collect_verdicts(stream: DataFrame, read_table, write_table, checkpoint: str):
    """Start a query that merges arrivals by the batch rules; replayed batches change nothing.

    read_table() gives the verdicts so far, write_table(df, epoch) stores the merged ones.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        write_table(merge(read_table(), batch), epoch)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
