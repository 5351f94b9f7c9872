"""Predictions over a stream of new samples: stateless, so each micro-batch is the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodemill.operators.boosting import Booster, predict

SAMPLES = "row_idx long, iid string, x array<double>"


def score_stream(spark: SparkSession, source: str, booster: Booster, sink: str, checkpoint: str, schema: str = SAMPLES) -> StreamingQuery:
    """Parquet files that appear in ``source`` are scored once each into ``sink``."""
    new = spark.readStream.schema(schema).parquet(source)
    out: DataFrame = predict(new, booster).drop("x")
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
