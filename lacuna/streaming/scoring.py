"""Scoring a stream of pairs: the batch score is a stateless stream-static join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from lacuna.plans.estimators import CompletionModel


def score_stream(model: CompletionModel, pairs: DataFrame, checkpoint: str) -> DataStreamWriter:
    """A writer for the scored pairs of a streaming frame; the caller names the sink and starts it."""
    if not pairs.isStreaming:
        raise ValueError("pairs is not a streaming frame; use transform")
    return model.transform(pairs).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
