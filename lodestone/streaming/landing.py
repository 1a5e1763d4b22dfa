"""Operators over a landing folder as a stream: new files are read once, whatever the operator is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import pii


def arriving(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply a stateless operator to what has arrived and append its rows; exactly once by the checkpoint."""
    return step(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def anonymize_arriving(spark: SparkSession, path: str, out: str, checkpoint: str, entities: list[str]) -> StreamingQuery:
    """Documents (doc_id, text) with the pattern types replaced."""
    return run(arriving(spark, path, "doc_id long, text string"), lambda df: pii.anonymize(df, entities=entities).select("doc_id", F.col("anonymised").alias("text")), out, checkpoint)


def first_contents(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """stream: ts, content. Contents seen within the delay come once."""
    return stream.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256)).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["sha256"])
