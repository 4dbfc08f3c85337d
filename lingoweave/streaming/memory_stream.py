"""A translation memory kept up to date from a stream of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.results import MEMORY_KEY


def update_memory(batch: DataFrame, path: str) -> None:
    """Add a batch to the log at ``path``: one row per key of the batch, its newest. Writing a batch again does no harm: the newest row counts on reading."""
    newest = batch.groupBy("source", "context", "source_lang", "target_lang").agg(F.max_by(F.struct("target", "provider", "updated_at"), F.struct("updated_at", "target")).alias("_r"))
    newest.select("source", "context", "source_lang", "target_lang", "_r.*").write.mode("append").parquet(path)


def stream_memory(spark: SparkSession, source: str, path: str, checkpoint: str, schema: str | None = None) -> None:
    """Read all new files at ``source``, update the log at ``path``, stop. Progress is kept at ``checkpoint``, so a run that was cut off goes on where it was."""
    kind = schema or spark.read.parquet(source).schema
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 64).parquet(source)
    query = stream.writeStream.foreachBatch(lambda df, _: update_memory(df, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def compacted(log: DataFrame) -> DataFrame:
    """The log with one row per key, the newest."""
    keys = [*MEMORY_KEY, "source_lang", "target_lang"]
    return log.groupBy(*keys).agg(F.max_by(F.struct("target", "provider", "updated_at"), F.struct("updated_at", "target")).alias("_r")).select(*keys, "_r.*")
