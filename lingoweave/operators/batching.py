"""Batches of texts for a provider: at most so many texts and characters in a row."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import text

MAX_CHARS = 12_000


def entry_chars() -> F.Column:
    return (F.length(text(F.col("source"))) + F.length(text(F.col("context_text")))).cast("bigint")


def char_batches(entries: DataFrame, max_entries: int = 30, max_chars: int = MAX_CHARS, block: int = 100_000) -> DataFrame:
    """``entries`` (file, ord, source, context_text) with ``block``, ``batch_no`` and ``chars``: greedy batches in order within each file.

    A batch ends where the next text would make it longer than ``max_chars`` or ``max_entries``; a longer text is a batch of its own. Greedy batching
    is a chain, so a file is cut into blocks of ``block`` places of ``ord`` that are batched apart: no task gets a whole hot file, at
    the price of one batch that may be short per block. The rows of a block stream through sorted, in constant memory.
    """
    rows = entries.select("file", F.floor(F.col("ord") / block).cast("bigint").alias("block"), F.col("ord").cast("bigint").alias("ord"), entry_chars().alias("chars"))
    ordered = rows.repartition("file", "block").sortWithinPartitions("file", "block", "ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, no, count, total = None, 0, 0, 0
        for batch in batches:
            numbers = []
            for file, blk, chars in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if (file, blk) != at:
                    at, no, count, total = (file, blk), 0, 0, 0
                elif count >= max_entries or total + chars > max_chars:
                    no, count, total = no + 1, 0, 0
                count, total = count + 1, total + chars
                numbers.append(no)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=["file", "block", "ord", "chars", "batch_no"])

    return ordered.mapInArrow(run, "file string, block bigint, ord bigint, chars bigint, batch_no bigint")


def batch_summary(batches: DataFrame) -> DataFrame:
    """Size of each batch, with an estimate of the answer's tokens."""
    chars = F.sum("chars")
    return batches.groupBy("file", "block", "batch_no").agg(F.count(F.lit(1)).alias("entries"), chars.alias("chars"), output_tokens(chars).alias("tokens"))


def output_tokens(chars: F.Column) -> F.Column:
    """Estimated tokens of an answer: one and a half per character and a reserve, between 1,024 and 16,384."""
    return F.least(F.greatest(F.floor(chars * 1.5).cast("bigint") + 512, F.lit(1024).cast("bigint")), F.lit(16384).cast("bigint"))


def auto_batch_size(entries: DataFrame, target_tokens: int = 8000) -> DataFrame:
    """One row (batch_size): texts per batch for a size in tokens, from the mean length of the first 20; 30 without texts."""
    first = entries.orderBy("ord").limit(20).select(entry_chars().alias("c"))
    mean = F.avg("c") / 3.5
    size = F.least(F.greatest(F.floor(F.lit(float(target_tokens)) / F.greatest(mean, F.lit(1.0))).cast("bigint"), F.lit(1).cast("bigint")), F.lit(60).cast("bigint"))
    return first.agg(F.when(F.count(F.lit(1)) == 0, F.lit(30).cast("bigint")).otherwise(size).alias("batch_size"))
