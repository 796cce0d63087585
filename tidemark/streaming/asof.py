"""A stream of rows joined as-of with a static history, batch by batch: an extension beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.temporal import asof_bucketed


def stream_asof(stream: DataFrame, history: DataFrame, sink: str, left_time: str, right_time: str, by: list[str], values: list[str], tie: list[str] | None = None) -> DataStreamWriter:
    """A writer that appends each micro-batch, joined as the batch operator joins it, to Parquet under ``sink``. A batch that
    is run again after a failure replaces its own folder, so every row is written once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        asof_bucketed(batch, history, left_time, right_time, by, values, tie).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write)
