"""Lookups that hold where one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row for each key, ``count`` = its rows in ``rows``), without ``count``.

    Keys with more than a thousandth of ``total`` rows, at most a thousand, are broadcast; the others are shuffled.
    """
    hot = groups.where(F.col(count) > max(1, total // 1000)).drop(count)
    cold = groups.where(F.col(count) <= max(1, total // 1000)).drop(count)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))
