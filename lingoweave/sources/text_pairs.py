"""Lines ``original=translation``: parse, extract, apply. And other games' tables and plain lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE, blank, strip, text


def read_lines(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(file, line_no, line) of text files; whole files are split, so that numbers are those of the file."""
    df = spark.read.option("wholetext", "true").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines(df.where(~F.lower("file").endswith("resizer.txt")), "value")


def lines(df: DataFrame, body: str) -> DataFrame:
    """(file, line_no, line) from whole texts; numbers start at 1."""
    parts = F.posexplode(F.split(F.regexp_replace(text(F.col(body)), "^﻿", ""), r"\r\n|\r|\n", -1)).alias("i", "line")
    return df.select("file", parts).select("file", (F.col("i") + 1).cast("bigint").alias("line_no"), "line")


def parse_pairs(rows: DataFrame, line: str = "line") -> DataFrame:
    """``rows`` with ``original`` and ``translation`` of lines that are pairs: split at the first ``=``; comments, directives and lines without an original are left out."""
    v = text(F.col(line))
    bare = strip(v)
    keep = (bare != "") & ~bare.startswith("#") & ~bare.startswith("r:") & ~bare.startswith("sr:") & F.contains(v, F.lit("="))
    original = F.substring_index(v, "=", 1)
    translation = F.substring(v, F.length(original) + 2, F.length(v))
    return rows.where(keep).withColumn("original", strip(original)).withColumn("translation", strip(translation)).where("original <> ''")


def pair_entries(rows: DataFrame, skip_translated: bool = False) -> DataFrame:
    """(file, key, source, context, ord): one entry per original and file, the first line's place."""
    p = parse_pairs(rows)
    if skip_translated:
        p = p.where("translation = ''")
    return p.groupBy("file", "original").agg(F.min("line_no").alias("ord")).select("file", F.col("original").alias("key"), F.col("original").alias("source"), F.lit("xunity").alias("context"), "ord")


def apply_pairs(rows: DataFrame, results: DataFrame) -> DataFrame:
    """``rows`` (file, line_no, line) with the results' targets put in; blank targets and other lines stay as they are.

    ``results`` (file, source, target, ord): the last of repeated ones holds.
    """
    t = results.where(~blank(F.col("target"))).groupBy("file", F.col("source").alias("original")).agg(F.max_by("target", "ord").alias("_t"))
    pairs = parse_pairs(rows).select("file", "line_no", "original")
    known = pairs.join(t, ["file", "original"]).select("file", "line_no", F.concat("original", F.lit("="), F.regexp_replace("_t", r"[\r\n]+", r"\\n")).alias("_new"))
    return rows.join(known, ["file", "line_no"], "left").select("file", "line_no", F.coalesce("_new", "line").alias("line"))


def join_lines(rows: DataFrame) -> DataFrame:
    """(file, body): lines put together again; a file is one text anyhow."""
    return rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), "\n").alias("body"))


def cells(df: DataFrame, row_no: str, columns: list[str]) -> DataFrame:
    """(key, source) of the cells of a table with more than one sign; the key is ``row:i:col:name``."""
    names = F.array(*[F.struct(F.lit(c).alias("c"), strip(F.col(c).cast("string")).alias("v")) for c in columns])
    return (df.select(F.col(row_no).alias("_n"), F.explode(names).alias("x")).where(F.length("x.v") > 1)
            .select(F.concat(F.lit("row:"), F.col("_n").cast("string"), F.lit(":col:"), F.col("x.c")).alias("key"), F.col("x.v").alias("source")))


def line_entries(rows: DataFrame) -> DataFrame:
    """(file, key, source) of plain lines with more than one sign; the key is ``line:n``."""
    s = F.regexp_replace("line", f"^{SPACE}+|{SPACE}+$", "")
    return rows.select("file", F.concat(F.lit("line:"), F.col("line_no").cast("string")).alias("key"), s.alias("source")).where(F.length("source") > 1)
