"""Index requests as a stream: each micro-batch becomes one generation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexigrid.plans.engine import Engine
from lexigrid.sources import requests


def follow(engine: Engine, folder: str, checkpoint: str, compact_every: int = 0, available_now: bool = False) -> StreamingQuery:
    """Index the JSON lines of files that appear in folder.

    Late timestamps need no watermark, as postings have their place by (ts, id); a batch that is run again after its
    commit is known by its number and left out. compact_every: batches between compactions, 0 for none.
    """
    lines = engine.spark.readStream.text(folder)
    docs = requests.documents(lines, "value", engine.config.now)

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            engine.index_values(requests.values(batch), f"{checkpoint}:{number}")
        if compact_every and number % compact_every == compact_every - 1:
            engine.compact()

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
