"""Bounded samples of distinct rows, the same for the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F


def sample_distinct(rows: DataFrame, columns: list[str], smallest: int, frequent: int = 0, salt: str = "", by: str | None = None) -> list[Row]:
    """(*columns, n) of distinct rows with their number of occurrences, in order: the ``smallest`` ones by hash (of each value of ``by``, one of the columns) and the ``frequent`` most frequent.

    Only hashes are shuffled to choose; the chosen, a bounded number, are sent to a second scan that fetches the rows. Repeated rows are
    combined on the map side, so one may have any share of the table.
    """
    spark = rows.sparkSession
    keyed = rows.select(*columns, F.xxhash64(F.lit(salt), *columns).alias("_h"))
    own = [by] if by else []
    counts = keyed.groupBy(*own, "_h").agg(F.count(F.lit(1)).alias("n"))
    if by:  # the limit on the rank is applied before the shuffle too
        some = counts.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy("_h"))).where(F.col("k") <= smallest).select("_h")
    else:
        some = counts.orderBy("_h").limit(smallest).select("_h")
    chosen = {r[0] for r in some.collect()}
    if frequent:
        chosen |= {r[0] for r in counts.where("n > 1").orderBy(F.desc("n"), "_h").limit(frequent).select("_h").collect()}
    picked = F.broadcast(spark.createDataFrame([(h,) for h in sorted(chosen)], "_h bigint"))
    found = keyed.join(picked, "_h").groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted(found, key=lambda r: tuple("" if x is None else str(x) for x in r))
