from datetime import datetime

from lingoweave.operators.snapshots import snapshot_changes
from lingoweave.plans import catalogue

SCHEMA = "snapshot_no bigint, taken_at timestamp, file string, key string, source string, target string, ord bigint, _s string, change string"


def rows(*data):
    return [(n, datetime(2025, 1, n % 28 + 1) if at is None else at, f, k, s, t, o, "x", "y") for n, at, f, k, s, t, o in data]


def changes(spark, data):
    df = spark.createDataFrame(rows(*data), SCHEMA)
    return {tuple(r) for r in snapshot_changes(df, ["file", "key"], ["source", "target"]).collect()}


def test_added_removed_changed(spark):
    got = changes(spark, [
        (1, None, "a", "k1", "s", "t", 1), (1, None, "a", "k2", "s", "t", 2), (1, None, "a", "k3", None, "t", 3), (1, None, "a", "k5", "s", "t", 9),
        (4, None, "a", "k1", "s", "T", 4), (4, None, "a", "k3", "", "t", 5), (4, None, "a", "k4", "s", "t", 6), (4, None, "a", "k5", "s", "t", 10),
    ])
    assert got == {(4, "a", "k1", "changed"), (4, "a", "k2", "removed"), (4, "a", "k4", "added")}


def test_order_is_by_time_not_by_number_and_the_largest_ord_counts(spark):
    early, late = datetime(2025, 1, 1), datetime(2025, 2, 1)
    got = changes(spark, [(9, early, "a", "k", "one", "t", 5), (9, early, "a", "k", "old", "t", 1), (3, late, "a", "k", "one", "t", 2), (3, late, "a", "k", "one", "t", 2)])
    assert got == set()


def test_nulls_moves_of_text_between_columns_and_hot_identity(spark):
    data = [(1, None, None, None, "ab", "c", i) for i in range(500)] + [(2, None, None, None, "a", "bc", 1)]
    assert changes(spark, data) == {(2, None, None, "changed")}


def test_empty_and_single(spark):
    assert changes(spark, []) == set()
    assert changes(spark, [(1, None, "a", "k", "s", "t", 1)]) == set()


def test_diff_of_all_deliveries(spark, tmp_path):
    data = rows((2, None, "a", "k", "s", "t", 1), (5, None, "a", "k", "S", "t", 2), (9, None, "a", "k", "S", "u", 3), (9, None, "a", "l", "x", "y", 4), (11, None, "a", "l", "x", "y", 5))
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/text_snapshots.parquet")
    got = {(r.snapshot_no, r.key, r.status) for r in catalogue.queries()["diff_deliveries"](spark, str(tmp_path)).collect()}
    assert got == {(5, "k", "changed (was: t)"), (9, "k", "unchanged"), (9, "l", "new"), (11, "l", "unchanged"), (11, "k", "removed")}
