"""Job events as streams: append-only logs, and consumers that can read a log again without seeing an event twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def follow_events(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """The log's events as a stream, each (job_id, sequence) once; what is remembered of it is forgotten after delay."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["job_id", "sequence"])


def follow_status(events: DataFrame) -> DataFrame:
    """The last status of each job, in update mode."""
    return events.groupBy("job_id").agg(F.max_by("type", "sequence").alias("status"), F.max("sequence").alias("last_sequence"))


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there, and then stop; out is a folder of Parquet files."""
    query: StreamingQuery = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", out).start()
    query.awaitTermination()
