"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(columns: list[str]) -> Column:
    """128-bit digest of string columns; null counts as the empty string.

    Each value is preceded by its length, so that no two different lists of values share a text.
    """
    parts = []
    for c in columns:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        parts += [F.length(v).cast("string"), F.lit(":"), v]
    return F.unhex(F.md5(F.concat(*parts)))


def snapshot_changes(
    df: DataFrame,
    keys: list[str],
    values: list[str],
    snapshot: str = "snapshot_no",
    taken_at: str = "taken_at",
    order: str = "ord",
) -> DataFrame:
    """Rows (snapshot, *keys, change) of every record that differs from the snapshot before it.

    ``change`` is ``added``, ``removed`` or ``changed``. Of several rows of one identity in a snapshot the one
    with the largest ``order`` counts (a null order is smallest; equal orders: the larger digest). Snapshots follow
    each other by ``taken_at`` (its smallest value in the snapshot, then the snapshot number). Null and '' are
    equal values; a null key is a key of its own; rows without a snapshot number are left out; other columns are ignored.

    Plan: one aggregation with map-side combine reduces repeated rows, so a hot identity shrinks before it is
    moved; values travel as 16-byte digests. The survivors are hashed by key once; EXCEPT ALL in both directions
    and the full join of what remains all reuse that partitioning.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    state = (
        df.where(F.col(snapshot).isNotNull())
        .select(F.col(snapshot).cast("bigint").alias("_s"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                F.struct(F.col(order).alias("o"), fingerprint(values).alias("d")).alias("_v"))
    )
    ids = [f"_k{i}" for i in range(len(keys))]
    state = state.groupBy("_s", *ids).agg(F.max("_v").alias("_v")).select("_s", *ids, F.col("_v.d").alias("_d"))
    state = state.repartition(n, *ids)

    # one row per snapshot: the window without a partition sees only these
    in_order = Window.orderBy("_t", "_s")
    steps = (
        df.where(F.col(snapshot).isNotNull()).groupBy(F.col(snapshot).cast("bigint").alias("_s")).agg(F.min(taken_at).alias("_t"))
        .select("_s", F.lead("_s").over(in_order).alias("_next"))
    ).where("_next is not null")
    # Nothing is filtered above the repartition, so that its exchange is the same for all four inputs and runs once.
    cols = ["_s", *ids, "_d"]
    after = state.select(cols)
    before = state.join(F.broadcast(steps), "_s").select(F.col("_next").alias("_s"), *ids, "_d")
    new = after.exceptAll(before).alias("a")
    old = before.exceptAll(after).alias("b")
    same = F.lit(True)
    for c in ["_s", *ids]:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    both = new.join(old, same, "full_outer").withColumn("_at", F.coalesce("a._s", "b._s"))
    # the first snapshot has none before it
    both = both.join(F.broadcast(steps.select(F.col("_next").alias("_at"))), "_at")
    return both.select(
        F.col("_at").alias(snapshot),
        *[F.coalesce(f"a.{i}", f"b.{i}").alias(k) for i, k in zip(ids, keys)],
        F.when(F.col("b._s").isNull(), "added").when(F.col("a._s").isNull(), "removed").otherwise("changed").alias("change"),
    )
