"""Records that are the same but for formatting: collapse and count them.

Two Bloom filters, of canonical digests seen once and seen again, are built by each task and merged block by block. Only
rows that the merged filter of repeats may hold are shuffled and grouped exactly; all others are singletons
where they stand. A filter never misses a repeat, so the result doesn't depend on its size. Where one filter would be too large, the digests are split
into ranges that have one each, worked off one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import folder, store
from .canonical import letters_digits
from .filters import MOST_BITS, filter_bits, get, merged_filter, positions


def canonical_digest(text: Column, fields: Column, separators: str = r"[|;,/]") -> Column:
    """128-bit digest of a record's letters and digits; null where the text or the list of fields has none.

    Fields are compared one by one in any order; fields without letters or digits don't count.
    """
    parts = F.array_sort(F.filter(F.transform(F.split(fields, separators), letters_digits), lambda x: x != ""))
    body = letters_digits(text)
    return F.when((body != "") & (F.size(parts) > 0), F.unhex(F.md5(F.concat_ws("|", body, F.array_join(parts, "|")))))


def _digests(column: pa.Array) -> np.ndarray:
    """(n, 2) words of a binary column of 16 bytes without nulls."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]: offsets[-1]].view(np.uint64).reshape(-1, 2) if len(column) else np.empty((0, 2), np.uint64)


def repeat_filter(df: DataFrame, digest: str, size: int) -> np.ndarray:
    """Bitmap that holds every digest occurring more than once in ``df``; ``size`` / 8 bytes, at most 128 MB, come to the driver."""
    return merged_filter(df.select(digest), _digests, size, True)


class Copies:
    """Groups of records that agree in their letters and digits.

    ``rows`` needs the columns ``ord`` (unique) and ``digest`` (null: the record is left out). ``members`` has
    (first_ord, ord) of every row of a group of two or more, ``records`` one row (first_ord, copies) for every group,
    singletons among them. An empty table gives empty results.

    A group may hold any share of all rows: its size and smallest ord are combined on the map side; groups above a
    thousandth of the rows, of which there can be a thousand, are joined by broadcast, the others by shuffle.
    """

    def __init__(self, rows: DataFrame, bits_per_row: int = 16, most_bits: int = MOST_BITS):
        """``most_bits``: size of a filter from which on the digests are split into ranges."""
        spark = rows.sparkSession
        found = rows.where("digest is not null").select("ord", "digest")
        base = folder(spark, "digests")
        found.write.parquet(f"{base}/all")
        whole = spark.read.schema(found.schema).parquet(f"{base}/all")
        n = whole.count()
        ranges = max(1, -(-n * bits_per_row // most_bits))
        if ranges > 1:
            # the last four bytes name the range; the filters use the others first
            part = F.floor(F.conv(F.hex(F.substring("digest", 13, 4)), 16, 10).cast("bigint") * ranges / float(1 << 32)).cast("int")
            whole.withColumn("part", part).write.partitionBy("part").parquet(f"{base}/ranges")
            whole = spark.read.parquet(f"{base}/ranges")
        size = filter_bits(-(-n // ranges), bits_per_row, most_bits)

        def probe(again: object) -> object:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        may = get(again.value, positions(_digests(batch.column(1)), size))
                        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(may)], names=["ord", "digest", "may"])

            return run

        for k in range(ranges):
            own = whole.where(F.col("part") == k).select("ord", "digest") if ranges > 1 else whole
            sent = spark.sparkContext.broadcast(repeat_filter(own, "digest", size))
            # of what is seen once only the number goes on
            probed = own.mapInArrow(probe(sent), "ord bigint, digest binary, may boolean").withColumn("digest", F.when(F.col("may"), F.col("digest")))
            probed.write.partitionBy("may").parquet(f"{base}/probed/range={k}")
            sent.destroy()
        self.probed = spark.read.schema("ord bigint, digest binary, may boolean").parquet(f"{base}/probed")
        self.likely = self.probed.where("may").select("ord", "digest")
        self.groups = store(self.likely.groupBy("digest").agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("copies")), "groups")
        self.hot = self.groups.where(F.col("copies") > max(1, n // 1000)).select("digest", "first_ord")

    @property
    def members(self) -> DataFrame:
        hot = F.broadcast(self.hot)
        rest = self.likely.join(F.broadcast(self.hot.select("digest")), "digest", "left_anti")
        repeated = self.groups.where("copies > 1").select("digest", "first_ord")
        return (self.likely.join(hot, "digest").select("first_ord", "ord")
                .unionByName(rest.join(repeated, "digest").select("first_ord", "ord")))

    @property
    def records(self) -> DataFrame:
        single = self.probed.where("not may").select(F.col("ord").alias("first_ord"), F.lit(1).cast("bigint").alias("copies"))
        return single.unionByName(self.groups.select("first_ord", "copies"))


def entry_copies(entries: DataFrame) -> Copies:
    """Copies among entries by source and context."""
    return Copies(entries.select(F.col("ord").cast("bigint").alias("ord"), canonical_digest(F.col("source"), F.col("context")).alias("digest")))
