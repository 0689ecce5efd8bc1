"""An extension: sources that arrive as a stream, blocked and scored against a fixed target table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.normalize import normalized
from tessera.plans.resolve import infer


def score_stream(stream: DataFrame, targets: DataFrame, model: PipelineModel, write: Callable[[DataFrame, int], None], checkpoint: str, cap: int = 8) -> StreamingQuery:
    """Each micro-batch of records(entity_id, business_name, business_address, country) becomes matches, handed to write(df, batch id)."""
    fixed = normalized(targets).persist()

    def batch(df: DataFrame, number: int) -> None:
        _, matched = infer(model, normalized(df), fixed, cap, use_tfidf=False)
        write(matched, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
