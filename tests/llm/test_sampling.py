from pyspark.sql import functions as F

from lingoweave.llm.sampling import sample_distinct


def test_sample(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, "warm").otherwise(F.col("id").cast("string")).alias("t"), (F.col("id") % 2).alias("l"), F.lit(1).alias("n"))
    s = sample_distinct(rows, ["t"], 50, 2, "x")
    assert 50 <= len(s) <= 52 and {"hot", "warm"} <= {r.t for r in s} and next(r.n for r in s if r.t == "hot") == 1000
    assert s == sample_distinct(rows.repartition(3), ["t"], 50, 2, "x") and s != sample_distinct(rows, ["t"], 50, 2, "y")
    by = sample_distinct(rows, ["t", "l"], 20, salt="x", by="l")
    assert sorted(r.l for r in by) == [0] * 20 + [1] * 20
    assert sample_distinct(rows.limit(0), ["t"], 5, 5) == [] and len(sample_distinct(rows, ["t"], 10**6)) == rows.select("t").distinct().count()
    nulls = spark.createDataFrame([(None, "a"), (None, "a"), ("x", None)], "t string, u string")
    assert [(r.t, r.u, r.n) for r in sample_distinct(nulls, ["t", "u"], 5)] == [(None, "a", 2), ("x", None, 1)]
