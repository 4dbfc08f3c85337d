"""Lines added to log files, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import log_source


def tail(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming DataFrame (line, source) of the log files that come into a folder."""
    return spark.readStream.option("maxFilesPerTrigger", 64).text(folder).select(F.col("value").alias("line"), log_source(F.col("value")).alias("source"))
