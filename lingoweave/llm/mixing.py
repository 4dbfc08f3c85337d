"""Mix sources to target shares of a total size measured in tokens.

Each source gets its share of the size of all documents with a target, at most ``max_repeats`` times its own size. The whole part of
that multiple is taken as copies of every document; the rest is a Pareto sample: documents are ranked by random odds divided
by the odds of their inclusion, and the first are taken until the source's size is reached.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import store

#: public vocabulary file and the pattern that cuts a text before byte pairs are merged
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def count_tokens(documents: DataFrame, tokenizer: str = TOKENIZER, text: str = "text") -> DataFrame:
    """``documents`` without ``text``, with ``tokens``: the number of tokens of the whole text, 0 for null. The vocabulary file, which only the driver needs to have, is sent to the executors."""
    names = [c for c in documents.columns if c not in (text, "tokens")]
    rows = documents.select(*names, text)
    documents.sparkSession.sparkContext.addFile(tokenizer)
    file = tokenizer.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(file), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*names, "tokens"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{schema}, tokens bigint")


def allocate(sizes: dict[str, int], weights: dict[str, float], repeats: dict[str, int], total: float) -> dict[str, float]:
    """Size of each source in the mixture: shares by weight, none above ``repeats`` times its size, what is cut off goes to the others by weight."""
    most = {s: float(sizes.get(s, 0) * max(0, repeats[s])) for s in weights}
    out = {s: 0.0 for s in weights}
    open_, left = {s for s in weights if weights[s] > 0 and most[s] > 0}, float(total)
    while open_ and left > 0:
        unit = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * unit >= most[s]}
        if not full:
            out.update({s: weights[s] * unit for s in open_})
            break
        for s in full:
            out[s] = most[s]
            left -= most[s]
        open_ -= full
    return out


def inclusion_scale(classes: list[tuple[float, float, float]], need: float) -> float:
    """c such that documents taken with probability min(1, c * mean weight of their class) have ``need`` tokens on average.

    ``classes``: (mean weight, documents, tokens).
    """
    low, high = 0.0, 1.0
    expected = lambda c: sum(min(1.0, c * w) * t for w, _, t in classes)
    while expected(high) < need and high < 1e12:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if expected(mid) < need else (low, mid)
    return high


class Mixture:
    """``chosen``: (doc_id, source, tokens, copies) of every document that is used; ``shares``: one row per target source and source of documents.

    ``targets`` (source, weight, max_repeats) is a small dimension table, read by the driver; null sources, null or non-positive weights are no targets, and
    of several rows of a source the first by weight counts. Documents of other sources, and those without tokens, are not used. Within a source the
    inclusion probability grows with the square root of a document's tokens (``power``): long documents fill the share with fewer
    records, short ones stay represented. Ranks come from a hash of ``seed`` and ``doc_id``: the same input gives the same mixture. No
    group is collected: the place where a source's sample ends is found on a histogram of ranks, and only documents in that one
    bucket are ordered.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 1, power: float = 0.5):
        spark = documents.sparkSession
        dims = targets.where("source is not null and weight > 0").groupBy("source").agg(F.max(F.struct("weight", "max_repeats")).alias("t")).select("source", "t.*").collect()
        self.weights = {r.source: float(r.weight) for r in dims}
        repeats = {r.source: int(r.max_repeats if r.max_repeats is not None else sys.maxsize >> 20) for r in dims}
        self.sized = store(count_tokens(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text"), tokenizer), "tokens")
        # token classes of an eighth of an octave: a few hundred for each target source, whatever the input
        scale = F.floor(F.log2("tokens") * 8).cast("int")
        wanted = self.sized.where((F.col("tokens") > 0) & F.col("source").isin(list(self.weights))) if self.weights else self.sized.limit(0)
        histogram = wanted.groupBy("source", scale.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.avg(F.pow("tokens", F.lit(power))).alias("w")).collect()
        self.sizes: dict[str, int] = {}
        for r in histogram:
            self.sizes[r.source] = self.sizes.get(r.source, 0) + r.t
        self.total = sum(self.sizes.values())
        self.goal = allocate(self.sizes, self.weights, repeats, self.total)
        plan = []
        for s, size in sorted(self.sizes.items()):
            whole, rest = divmod(self.goal.get(s, 0.0), size)
            c = inclusion_scale([(r.w, r.n, r.t) for r in histogram if r.source == s], rest)
            plan.append((s, int(whole), float(rest), float(c)))
        plans = F.broadcast(spark.createDataFrame(plan, "source string, whole int, rest double, c double"))
        unit = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        odds = lambda x: F.log(x) - F.log1p(-x)
        p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-12), F.col("c") * F.pow("tokens", F.lit(power))))
        ranked = wanted.join(plans, "source").withColumn("rank", odds(unit) - odds(p))
        ranked = ranked.withColumn("bucket", F.floor(F.col("rank") * 200).cast("bigint"))
        buckets = ranked.where("rest > 0").groupBy("source", "bucket").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
        # one row for each source and bucket: at most some ten thousand a source
        upto = F.sum("t").over(Window.partitionBy("source").orderBy("bucket"))
        edges = buckets.withColumn("upto", upto).where(F.col("upto") - F.col("t") < F.col("rest")).groupBy("source").agg(
            F.max("bucket").alias("edge"), F.max(F.struct("bucket", (F.col("upto") - F.col("t")).alias("b"))).getField("b").alias("before"))
        ranked = ranked.join(F.broadcast(edges), "source", "left")
        inside = ranked.where("bucket = edge").withColumn("upto", F.sum("tokens").over(Window.partitionBy("source").orderBy("rank", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before"))
        # before the edge every document is taken once more, behind it none; at the edge one that crosses the end is taken if more than half of it lies before
        far = ranked.where("edge is null or bucket <> edge").withColumn("more", F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False)))
        near = inside.withColumn("more", F.col("upto") - F.col("tokens") / 2 <= F.col("rest"))
        both = far.select("doc_id", "source", "tokens", "whole", "more").unionByName(near.select("doc_id", "source", "tokens", "whole", "more"))
        self.chosen = both.select("doc_id", "source", "tokens", (F.col("whole") + F.col("more").cast("int")).cast("bigint").alias("copies")).where("copies > 0")

    @property
    def shares(self) -> DataFrame:
        spark = self.sized.sparkSession
        used = self.chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.max("copies").alias("most_copies"))
        size = self.sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
        goals = spark.createDataFrame([(s, w, self.goal.get(s, 0.0) / self.total if self.total else 0.0) for s, w in sorted(self.weights.items())], "source string, weight double, planned double")
        every = size.join(F.broadcast(goals), "source", "full_outer").join(F.broadcast(used), "source", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
        everything = F.sum(zero("used")).over(Window.partitionBy(F.lit(0)))  # one row per source
        return every.select("source", "weight", F.round("planned", 6).alias("planned"), zero("documents").alias("documents"), zero("tokens").alias("tokens"), zero("used").alias("used"), zero("most_copies").alias("most_copies"),
                            F.round(F.when(everything > 0, zero("used") / everything).otherwise(0.0), 6).alias("share"))
