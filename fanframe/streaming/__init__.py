"""Stateless operators on streams: row, cell and value functions take a streaming DataFrame as it is.

Group and window functions need all of a group and are for tables; on streams, run them per
micro-batch with for_each_batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery


def for_each_batch(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Write transform(batch) of every micro-batch to Parquet, all that is there now.

    Each batch has a folder of its own and is written anew if it is run again.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
