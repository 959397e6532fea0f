"""The scoring projection on streams: it keeps no state, so it runs as it is on every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.scoring import Model, score_all


def score_stream(stream: DataFrame, models: list[Model], entity_id: str, path: str, checkpoint: str) -> StreamingQuery:
    """Scores a stream of entities into Parquet; exactly once by the sink's log."""
    scores = score_all(stream, models, entity_id)
    return scores.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_positives(scores: DataFrame, time: str, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Positive results for each model and window; rows later than the watermark are left out."""
    return scores.withWatermark(time, late).groupBy(F.window(time, size), "model_id").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("positives"))
