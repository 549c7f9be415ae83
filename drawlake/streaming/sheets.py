"""Sheets that arrive as a stream: each micro-batch goes through the same sheet operators.

A sheet is complete within one batch; there is no state between batches. Results carry the
batch number, so a batch that is retried after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def run_sheets(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    def each(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
