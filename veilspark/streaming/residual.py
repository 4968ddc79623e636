"""The search for leftovers over pages as they are published (micro-batches)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.verify import residual_texts


def watch(files: DataFrame, patterns: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """files: a stream of event_id, rel, content; patterns: event_id, name_idx, pattern (static).
    Every batch that is available is searched, and leftovers are appended once to Parquet."""

    def search(batch: DataFrame, number: int) -> None:
        residual_texts(batch, patterns).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(search).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
