"""The same row-local transforms on a stream. TOKEN numbers whole documents and is for tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from redactory.operators.detect import Config
from redactory.plans.engine import redact


def redact_stream(segments: DataFrame, config: Config = Config()) -> DataFrame:
    """segments: a streaming DataFrame with a text column."""
    if config.strategy == "TOKEN":
        raise ValueError("TOKEN needs whole documents")
    return redact(segments, config)


def run(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, config: Config = Config()):
    """Redacts the Parquet files that arrive in a folder, each once, into another; returns the query."""
    rows = spark.readStream.schema(schema).parquet(source)
    return redact_stream(rows, config).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
